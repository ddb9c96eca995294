"""Operator 8: encoding and decoding with a SentencePiece model by a batched Viterbi recursion.

The model at hand is a BPE model: its ids come from merging the best-scored neighbours, leftmost first, and
the path of the best score sum gives other ids (a test shows it). But each prefix of a word has one encoding, whose last piece is the
one that stands fast against the last piece of the encoding before it: merging the two anew gives the same two.
So the forward recursion goes over end positions, distinct words of equal length together: substring hashes
probe the sorted piece keys, pairs that do not stand fast count as minus infinity, vectorised maxima store backpointers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, slices, strings
from .ngram_join import mixed

#: Characters worked on at a time; words longer than this go alone; words, and for long ones pairs of pieces, that a worker remembers.
SLICE_CHARS, LONGEST, REMEMBERED = 1_500_000, 40, 200_000
#: Bits of the tables that say which hashes need no search.
_MAYBE = 22
SPACE, BYTES_FROM = "▁", 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.iinfo(np.int64).max


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        keys = np.array([self._key_of(self.pieces[i]) for i in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(normal, np.int32)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.may_be_key = np.zeros(1 << _MAYBE, bool)
        self.may_be_key[(self.keys >> np.uint64(64 - _MAYBE)).astype(np.int64)] = True
        self.longest_piece = max(len(self.pieces[i]) for i in normal)
        # characters come first, then pieces in the order in which they are merged
        ranked = sorted(normal, key=lambda i: (len(self.pieces[i]) > 1, -model.get_score(i), i))
        self.rank = np.full(n, -1, np.int64)
        self.rank[ranked] = np.arange(len(ranked))
        self.id_of = {self.pieces[i]: i for i in normal}
        self._learn_splits(ranked)
        self.known = np.full(n, False)
        self.known[[i for i in normal if self.left[i] >= 0]] = True
        self.fast: dict[tuple[int, int], bool] = {}
        self.remembered: dict[str, bytes] = {}
        raw = [bytes([i - BYTES_FROM]) if model.is_byte(i) else b"" if model.is_control(i) else " ⁇ ".encode() if model.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        self.raw_lengths = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def _learn_splits(self, ranked: list[int]) -> None:
        """For each piece the two that its last merge joins (itself twice for a character, -1 if merges never make it), and for each two pieces what they join to."""
        n, pieces, id_of = len(self.pieces), self.pieces, self.id_of
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        joins: dict[int, int] = {}
        for i in ranked:
            text = pieces[i]
            if len(text) == 1:
                self.left[i] = self.right[i] = i
                continue
            halves = [(x, y) for k in range(1, len(text)) if (x := id_of.get(text[:k])) is not None and (y := id_of.get(text[k:])) is not None]
            joins.update(((x * n + y), i) for x, y in halves)
        self.join_keys = np.array(sorted(joins), np.int64)
        self.may_join = np.zeros(1 << _MAYBE, bool)
        self.may_join[self._slot(self.join_keys)] = True
        self.join_ids = np.array([joins[k] for k in self.join_keys.tolist()], np.int64)
        # in the order of merges: a piece is made where its two halves stand fast against each other but for itself
        rank = self.rank
        by_size: dict[int, list[tuple[int, int, int]]] = {}
        for key, i in joins.items():
            by_size.setdefault(len(pieces[i]), []).append((i, key // n, key % n))
        for size in sorted(by_size):
            i, x, y = (np.array(column, np.int64) for column in zip(*by_size[size], strict=True))
            ok = (self.left[x] >= 0) & (self.left[y] >= 0) & (rank[x] < rank[i]) & (rank[y] < rank[i])
            i, x, y = i[ok], x[ok], y[ok]
            made = self.stands(x, y, first_limit=rank[i])
            self.left[i[made]], self.right[i[made]] = x[made], y[made]

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _BASE) >> np.uint64(64 - _MAYBE)).astype(np.int64)

    def _joined_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The rank of what two pieces join to, or a number above all."""
        key = x * len(self.pieces) + y
        out = np.full(len(key), _NONE)
        maybe = np.flatnonzero(self.may_join[self._slot(key)])
        at = np.minimum(np.searchsorted(self.join_keys, key[maybe]), len(self.join_keys) - 1)
        hit = self.join_keys[at] == key[maybe]
        out[maybe[hit]] = self.rank[self.join_ids[at[hit]]]
        return out

    def stands(self, x: np.ndarray, y: np.ndarray, first_limit: np.ndarray | int = _NONE) -> np.ndarray:
        """Whether merging the texts of two pieces anew ends with the same two.

        Walks back over the merges that made the two, latest first: none of the neighbours that met at the seam
        in between may join to a piece that comes before the merge that parted them; at a tie the left place merges first.
        """
        x, y = x.copy(), y.copy()
        limit = np.broadcast_to(np.asarray(first_limit, np.int64), x.shape).copy()
        out, at = np.ones(len(x), bool), np.arange(len(x))
        while len(at):
            bad = self._joined_rank(x, y) < limit
            out[at[bad]] = False
            at, x, y = at[~bad], x[~bad], y[~bad]
            if not len(at):
                break
            rx, ry = self.rank[x], self.rank[y]
            part_x, part_y = self.right[x] != x, self.left[y] != y
            take_x = part_x & ((rx > ry) | ~part_y)
            live = part_x | part_y
            limit = np.where(take_x, rx, ry + 1)
            x, y = np.where(take_x, self.right[x], x), np.where(take_x, y, self.left[y])
            at, x, y, limit = at[live], x[live], y[live], limit[live]
        return out

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
        for i in range(codes.shape[1]):
            out[:, i + 1] = out[:, i] * _BASE + codes[:, i] + np.uint64(1)
        return out

    def _key_of(self, piece: str) -> np.uint64:
        codes = np.frombuffer(piece.encode("utf-32-le"), np.uint32).astype(np.uint64)[None]
        return mixed(self._prefixes(codes)[:, -1] + np.uint64(len(piece)))[0]

    def _probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some hashes of substrings are pieces' ones, and the pieces."""
        maybe = np.flatnonzero(self.may_be_key[(key >> np.uint64(64 - _MAYBE)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[maybe]), len(self.keys) - 1)
        found = self.key_ids[at].astype(np.int64)
        hit = (self.keys[at] == key[maybe]) & self.known[found]
        return maybe[hit], found[hit]

    def _ids_of_length(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words of one length, end to end in the words' order, and their numbers."""
        n, length = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length).astype(np.uint64)
        prefix = self._prefixes(codes)
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(length, _BASE)]))
        last, back = np.full((length + 1, n), -1, np.int64), np.zeros((length + 1, n), np.int64)
        for end in range(1, length + 1):
            start = np.arange(max(0, end - self.longest_piece), end)
            key = mixed(prefix[:, end, None] - prefix[:, start] * power[end - start] + (end - start).astype(np.uint64))
            at, piece = self._probe(key.ravel())
            row, size = at // len(start), end - start[at % len(start)]
            before = last[end - size, row]
            stands = before < 0  # an unknown character or the word's begin joins with nothing
            ask = np.flatnonzero(~stands)
            stands[ask] = self.stands(before[ask], piece[ask])
            row, size, piece = row[stands], size[stands], piece[stands]
            np.maximum.at(back[end], row, size)
            best = size == back[end, row]
            last[end, row[best]] = piece[best]
            np.maximum(back[end], 1, out=back[end])  # a character without a piece
        # walk back, all words together
        at, ends = np.full(n, length), np.zeros((length + 1, n), bool)
        every = np.arange(n)
        while (live := at > 0).any():
            ends[at[live], every[live]] = True
            at = np.where(live, at - back[at, every], 0)
        row, end = np.nonzero(ends.T)
        ids, counts = last[end, row], np.bincount(row, minlength=n)
        if (ids >= 0).all():
            return ids.astype(np.int32), counts
        unknown = np.flatnonzero(ids < 0)  # its bytes
        raw = [words[r][e - 1].encode("utf-8", "surrogatepass") for r, e in zip(row[unknown].tolist(), end[unknown].tolist(), strict=True)]
        repeat = np.ones(len(ids), np.int64)
        repeat[unknown] = [len(b) for b in raw]
        out = np.repeat(ids, repeat).astype(np.int32)
        out[out < 0] = np.frombuffer(b"".join(raw), np.uint8).astype(np.int32) + BYTES_FROM
        return out, np.bincount(row, weights=repeat, minlength=n).astype(np.int64)

    def _long(self, word: str) -> np.ndarray:
        """The same recursion for one long word."""
        if len(self.fast) > REMEMBERED:
            self.fast.clear()
        fast, known, last, back = self.fast, self.known, [-1] * (len(word) + 1), [1] * (len(word) + 1)
        for end in range(1, len(word) + 1):
            for size in range(min(end, self.longest_piece), 0, -1):
                piece = self.id_of.get(word[end - size : end])
                if piece is None or not known[piece]:
                    continue
                pair = (last[end - size], piece)
                if pair[0] >= 0 and pair not in fast:
                    fast[pair] = bool(self.stands(np.array(pair[:1]), np.array(pair[1:]))[0])
                if pair[0] < 0 or fast[pair]:
                    last[end], back[end] = piece, size
                    break
        out: list[list[int]] = []
        end = len(word)
        while end:
            out.append([last[end]] if last[end] >= 0 else [b + BYTES_FROM for b in word[end - 1].encode("utf-8", "surrogatepass")])
            end -= back[end]
        return np.array([i for ids in reversed(out) for i in ids], np.int32)

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and their numbers."""
        if len(self.remembered) > REMEMBERED:
            self.remembered.clear()
        known = self.remembered
        by_length: dict[int, list[str]] = {}
        for word in words:
            if word not in known:
                by_length.setdefault(len(word), []).append(word)
        for length, new in by_length.items():
            if length > LONGEST:
                known.update((word, self._long(word).tobytes()) for word in new)
            else:
                ids, counts = self._ids_of_length(new)
                raw, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
                known.update((word, raw[a:b]) for word, a, b in zip(new, [0, *ends[:-1]], ends, strict=True))
        runs = [known[word] for word in words]
        return np.frombuffer(b"".join(runs), np.int32), np.fromiter(map(len, runs), np.int64, len(runs)) // 4

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and how many each has; an empty text has none."""
        texts = pc.replace_substring(texts, SPACE, " ")
        lists = pc.split_pattern(texts, " ")
        parts, row = lists.flatten(), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
        nonempty = np.asarray(pc.binary_length(texts)) > 0
        keep = nonempty[row]
        parts, row = parts.filter(pa.array(keep)), row[keep]
        # a run of spaces belongs to the word after it, or is a word of its own at a text's end
        full = np.asarray(pc.binary_length(parts)) > 0
        last = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
        close = np.flatnonzero(full | last)
        spaces = np.diff(np.concatenate([[-1], close]))
        coded = parts.take(pa.array(close)).dictionary_encode()
        codes = np.asarray(coded.indices).astype(np.int64)
        names = coded.dictionary.to_pylist()
        most = 1 + int(spaces.max(initial=1))
        pairs, pick = np.unique(codes * most + spaces, return_inverse=True)
        distinct = [SPACE * (p % most) + names[p // most] for p in pairs.tolist()]
        flat, counts = self.words(distinct)
        ids, n = gathered(flat, np.cumsum(counts) - counts, counts, pick)
        return ids, np.bincount(row[close], weights=n, minlength=len(texts)).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of id sequences that lie end to end; bytes that are no UTF-8 read as U+FFFD."""
        flat, n = gathered(self.raw, self.raw_starts, self.raw_lengths, ids)
        if not len(counts):
            return pa.array([], pa.string())
        ends = np.cumsum(np.bincount(np.repeat(np.arange(len(counts)), counts), weights=n, minlength=len(counts)).astype(np.int64))
        raw = flat.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        first = np.cumsum(counts) - counts
        return pa.array([t[1:] if c and t.startswith(" ") and self.pieces[ids[f]].startswith(SPACE) else t for t, c, f in zip(texts, counts.tolist(), first.tolist(), strict=True)], pa.string())


_CODECS: dict[str, PieceCodec] = {}


def _codec(path: str) -> PieceCodec:
    return _CODECS.get(path) or _CODECS.setdefault(path, PieceCodec(path))


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, ids, n_ids, round_trip (the ids decode to the text).

    A null text counts as empty and has no ids. Repeated rows each get a row; a null doc_id stays null;
    other columns are left out. A text that holds U+2581 doesn't come back: the model reads it as a space.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            texts = strings(batch.column(1))
            for low, high in slices(texts, SLICE_CHARS):
                part = texts.slice(low, high - low)
                ids, n = codec.encode(part)
                same = pc.equal(codec.decode(ids, n), part)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), pa.array(n), same], ["doc_id", "ids", "n_ids", "round_trip"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(rows, "doc_id long, ids array<int>, n_ids long, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``encoded(doc_id, ids)`` to doc_id, text; null ids give an empty text, ids outside the model fail."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in batches:
            lists = batch.column(1)
            counts = np.asarray(pc.fill_null(lists.value_lengths(), 0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), codec.decode(np.asarray(lists.flatten()).astype(np.int64), counts)], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(rows, "doc_id long, text string")
