"""Operator 1: best-fit packing with certified bin counts.

Documents are tokenized and cut only where they exceed the sequence length. The pieces are dealt
into partitions of bounded size; each partition runs best-fit decreasing and compares its bin
count with a dual-feasible-function lower bound. Where the two agree the count is certified.
Partitions with a gap hand back all their pieces, certified ones only what lies in their
slack bins; those exchange places and are packed again, until a round brings nothing.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, gathered, settled, slices, str_list, strings

#: Characters of text that are tokenized at a time, and words from which a worker starts to remember anew: the words before stay at hand until then.
SLICE_CHARS, REMEMBERED = 1_500_000, 100_000
#: Marks that end words, letters and digits of Latin scripts, and the last of these.
MARKS, LATIN = ".,;:!?*%#$&|", "\u024f"
ALNUM = "".join(c for c in map(chr, range(ord(LATIN) + 1)) if c.isalpha() or c.isdecimal())
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", nr long, part long, bin long, offset long, fill long, part_bins long, part_bound long"


class WordTokenizer:
    """Ids of whole texts by way of their words.

    The tokenizer normalises, lower-cases and splits at white space before it merges, so a text's
    ids are those of its white-space words in order; each distinct word of a slice is encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        simple, plain, odd = [], [], []
        for w in words:
            if not w.isalpha():
                odd.append(w)
            elif w.isascii():
                simple.append(w)
            else:
                (plain if max(w) <= LATIN else odd).append(w)
        if simple:  # nothing to normalise but case, nothing to split: the merges alone
            merged, ids, ends = self.tokenizer.model.tokenize, [], []
            for word in simple:
                ids += [token.id for token in merged(word.lower())]
                ends.append(len(ids))
            self._note(simple, np.array(ids, np.uint32), np.array(ends))
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(plain):
                self._note(plain, ids, cuts)
            else:
                odd += plain
        for word, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            self.known[word] = np.array(found.ids, np.uint32).tobytes()

    def _note(self, words: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        raw, at = ids.tobytes(), 0
        for word, end in zip(words, (ends * 4).tolist(), strict=True):
            self.known[word] = raw[at:end]
            at = end

    def _runs(self, words: list[str]) -> list[bytes]:
        """Each word's ids as little-endian unsigned 32-bit numbers."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        known, before, new = self.known, self.before, []
        for w in words:
            if w not in known:
                if (run := before.get(w)) is not None:
                    known[w] = run
                else:
                    new.append(w)
        if new:
            self._learn(new)
        return [known[w] for w in words]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and how many each text has."""
        rows, words = ascii_words(texts, lower=False)
        coded = words.dictionary_encode()
        # after letters and digits, marks other than an apostrophe are tokens of their own, and case doesn't count
        full, core, tail = coded.dictionary, pc.utf8_rtrim(coded.dictionary, MARKS), pc.utf8_ltrim(coded.dictionary, ALNUM)
        size = pc.binary_length
        apart = pc.and_(pc.equal(pc.add(size(core), size(tail)), size(full)), pc.greater(size(core), 0))
        core = pc.if_else(apart, pc.ascii_lower(core), full).dictionary_encode()
        tail = pc.if_else(apart, tail, "").dictionary_encode()
        runs = self._runs(str_list(core.dictionary)) + self._runs(str_list(tail.dictionary))
        lengths = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        flat = np.frombuffer(b"".join(runs), np.uint32)
        both = np.stack([np.asarray(core.indices), np.asarray(tail.indices) + len(core.dictionary)], 1)
        ids, n = gathered(flat, np.cumsum(lengths) - lengths, lengths, both[np.asarray(coded.indices)].ravel())
        return ids, np.bincount(rows, weights=n.reshape(-1, 2).sum(1), minlength=len(texts)).astype(np.int64)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32.

    A null text counts as empty; an empty text is the end id alone. A null doc_id is kept as it is,
    repeated rows are packed each for itself, other columns are left out.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _TOKENIZERS.get(tokenizer) or _TOKENIZERS.setdefault(tokenizer, WordTokenizer(tokenizer))
        for batch in batches:
            texts, doc_ids = strings(batch.column(1)), batch.column(0)
            for low, high in slices(texts, SLICE_CHARS):
                ids, n = coder.texts(texts.slice(low, high - low))
                whole = np.empty(len(ids) + len(n), np.uint32)
                last = np.cumsum(n + 1) - 1
                whole[last] = end_id
                inner = np.ones(len(whole), bool)
                inner[last] = False
                whole[inner] = ids
                pieces = -(-(n + 1) // capacity)
                of = np.repeat(np.arange(len(n)), pieces)
                number = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = number * capacity
                length = np.minimum(capacity, (n + 1)[of] - start)
                begin = (last - n)[of] + start
                view = memoryview(whole).cast("B")
                crc = np.fromiter((zlib.crc32(view[a * 4 : b * 4]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)), np.int64, len(of))
                yield pa.RecordBatch.from_arrays([doc_ids.slice(low, high - low).take(pa.array(of)), pa.array(number.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and the bins' fills. Among the bins with room, the tightest gets the item."""
    order = np.argsort(-lengths, kind="stable")
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    fills: list[int] = []
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fit = rooms >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_at[room].pop()
            if not open_at[room]:
                rooms ^= 1 << room
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        if left:
            open_at[left].append(b)
            rooms |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def bin_bound(lengths: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can go below, by two families of dual feasible functions."""
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    number, total = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for least in np.flatnonzero(count[: capacity // 2 + 1]):
        if least:  # items over capacity - least count as whole bins, those under least not at all
            large = number[capacity - least + 1] if least > 0 else 0
            middle = total[capacity - least] - total[least - 1]
            best = max(best, int(large + -(-int(middle) // capacity)))
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = 4096, part_items: int = 16_384, slack: float = 0.99) -> DataFrame:
    """Sequences for the rows of ``pieces`` (PIECES): adds part, bin, offset and sequence_id.

    ``part_items`` is about how many pieces one task packs: rows are dealt by their own numbers, so equal ones spread too. A
    round hands on the pieces of every partition whose bin count exceeds its lower bound, and of bins filled below ``slack``;
    they are dealt anew into as many partitions as they need. Rounds go on as long as each saves a bin.
    An empty input gives no rows.
    """

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        lengths = group["length"].to_numpy(np.int64)
        bins, offsets, fills = best_fit_decreasing(lengths, capacity)
        return group.assign(bin=bins, offset=offsets, fill=fills[bins], part_bins=len(fills), part_bound=bin_bound(lengths, capacity))

    fields = [*(c.split()[0] for c in PIECES.split(", ")), "nr"]
    pool, kept, before, first_part = settled(pieces.withColumn("nr", F.monotonically_increasing_id())), [], None, 0
    while True:
        rows, tokens = pool.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        if before is not None and (not rows or -(-tokens // capacity) >= before):
            break
        parts = max(1, -(-rows // part_items))
        dealt = pool.select(*fields, (F.lit(first_part) + F.pmod(F.xxhash64("nr", F.lit(len(kept))), F.lit(parts))).alias("part"))
        now = settled(dealt.groupBy("part").applyInPandas(packed, PACKED))
        if before is not None and now.where("offset = 0").count() >= before:
            break
        if before is not None:
            kept[-1] = kept[-1].where(~slack_of(capacity, slack))
        kept.append(now)
        first_part += parts
        pool = now.where(slack_of(capacity, slack))
        before = pool.where("offset = 0").count()
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out.withColumn("sequence_id", F.shiftleft(F.col("part"), 24) + F.col("bin"))


def slack_of(capacity: int, slack: float):
    return (F.col("part_bins") > F.col("part_bound")) | (F.col("fill") < F.lit(int(capacity * slack)))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Every document's pieces with their places in sequences of at most ``capacity`` ids.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset. See ``token_pieces`` for
    nulls, empty texts, repeated rows and other columns; an empty table gives no rows.
    """
    return pack(token_pieces(docs, tokenizer, capacity, end_id), capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
