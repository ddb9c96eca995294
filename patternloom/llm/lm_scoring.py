"""Operator 10: language-model scores by a hidden Markov model.

Words are counted over the training documents. Each that is seen ``OWN`` times is a symbol of its own, whatever the size of the corpus; the
rarer ones are grouped by their endings, within which they follow their counts, with a Good-Turing share for words never seen: all of
these are one token a group. Emissions of the most frequent symbols go to every task, those of the others are a table that is joined in each round.
Baum-Welch sums expected counts per partition and then by symbol (a partition's emissions travel as a sum and shares in 255ths); scoring runs
the scaled forward recursion over each whole text, so a score is the exact log likelihood.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, settled, slices, stored, str_list, strings

SLICE_CHARS = 1_500_000
#: Occurrences that give a word emissions of its own. Six states' shares of a rarer word could not be told from chance.
OWN = 32
#: Words whose emissions and whose counts may go to every task (those of rarer ones are joined), groups of endings
#: of the words without emissions of their own, tokens that are worked on at a time, tokens from which sequences are long: those are worked on apart from others.
SYMBOLS, ENDINGS, HEAD, BATCH, LONG = 1 << 19, 1_024, 1 << 19, 400_000, 2_048
#: Tokens whose moves are summed at a time.
AT_ONCE = 1 << 15
#: Symbols whose expected emissions travel together, and tasks whose sums one task adds up.
BUCKET, SUMMED = 1024, 512
#: Part of a state's distribution that follows the corpus instead of the state.
BACKOFF = 0.02


@dataclass(frozen=True)
class Vocabulary:
    """Bounded tables over the training counts: the head words by hash, and the groups."""

    hashes: np.ndarray
    counts: np.ndarray
    symbols: np.ndarray
    tokens: int
    types: int
    ends: int
    group_tokens: np.ndarray
    group_once: np.ndarray
    symbol_tokens: np.ndarray
    tail_words: int  # symbols that are joined, and their tokens
    tail_tokens: int

    @property
    def weight(self) -> float:
        """The tokens of all symbols, half a one added to each."""
        return float((self.symbol_tokens + 0.5).sum() + self.tail_tokens + 0.5 * self.tail_words)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    @property
    def unseen(self) -> np.ndarray:
        return (self.group_once + 0.5) / (self.group_tokens + self.group_once + 1)

    @property
    def known_share(self) -> np.ndarray:
        """log10 of a known word's share of its group, but for its count."""
        return np.log10((1 - self.unseen) / np.maximum(1, self.group_tokens))


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray  # symbol by state


def _word_hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, str_list(words)), np.uint64, len(words)).view(np.int64)


def _endings(words: pa.Array) -> np.ndarray:
    last = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    groups = np.fromiter((zlib.crc32(x.encode()) % ENDINGS for x in last.dictionary.to_pylist()), np.int64, len(last.dictionary))
    return groups[np.asarray(last.indices)]


def held_out_of(doc_id, folds: int = 5, fold: int = 1):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def word_counts(docs: DataFrame) -> DataFrame:
    """``h, ending, c``: the words of all texts by their 64-bit hash, their group and their count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(0))
            for low, high in slices(texts, SLICE_CHARS):
                _, words = ascii_words(texts.slice(low, high - low), lower=True)
                coded = words.dictionary_encode()
                n = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
                yield pa.RecordBatch.from_arrays([pa.array(_word_hashes(coded.dictionary)), pa.array(_endings(coded.dictionary).astype(np.int32)), pa.array(n)], ["h", "ending", "c"])

    return docs.select("text").mapInArrow(count, "h long, ending int, c long").groupBy("h").agg(F.min("ending").alias("ending"), F.sum("c").alias("c"))


def _least_count(counts: DataFrame, most: int) -> int:
    """The least c at which no more than ``most`` words have a count of c or more, by steps of a quarter of a power of 2."""
    step = F.floor(F.log2("c") * 4).cast("int")
    by_step = sorted(((r["step"], r["n"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, total = 1 << 62, 0
    for s, n in by_step:
        total += n
        if total > most:
            break
        least = int(np.ceil(2 ** (s / 4) - 1e-9))
    return least


def vocabulary(counts: DataFrame, documents: int) -> Vocabulary:
    total = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    head_from = _least_count(counts, min(HEAD, SYMBOLS))
    head = counts.where(F.col("c") >= head_from).toArrow()
    hashes, c = np.asarray(head["h"]).astype(np.int64), np.asarray(head["c"]).astype(np.int64)
    order = np.argsort(hashes)
    hashes, c = hashes[order], c[order]
    own = c >= OWN  # words seen once stand for those never seen
    symbols = np.where(own, np.cumsum(own) - 1, -1).astype(np.int32)
    groups = counts.where(F.col("c") < OWN).groupBy("ending").agg(F.sum("c").alias("c"), F.count_if(F.col("c") == 1).alias("once")).collect()
    group_tokens, once = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in groups:
        group_tokens[r["ending"]], once[r["ending"]] = r["c"], r["once"]
    tokens = np.concatenate([c[own], group_tokens, [documents]]).astype(float)
    tail = counts.where((F.col("c") >= OWN) & (F.col("c") < (int(c.min()) if len(c) else 1 << 62))).agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    return Vocabulary(hashes, c, symbols, int(total[1]) + documents, int(total[0]) + (documents > 0), documents, group_tokens, once, tokens, int(tail[0]), int(tail[1]))


def _read(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """Each document's symbols (the end last) and what its head words give; rarer words are listed for the join."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = shared.value
        own = int((v.symbols >= 0).sum())
        end, known_share, correction = own + ENDINGS, v.known_share, np.log10(v.unseen) - v.known_share
        for batch in batches:
            texts = strings(batch.column(2))
            for low, high in slices(texts, SLICE_CHARS):
                n = high - low
                row, words = ascii_words(texts.slice(low, n), lower=True)
                coded = words.dictionary_encode()
                h, group, codes = _word_hashes(coded.dictionary), _endings(coded.dictionary), np.asarray(coded.indices)
                at = np.minimum(np.searchsorted(v.hashes, h), max(0, len(v.hashes) - 1))
                found = v.hashes[at] == h if len(v.hashes) else np.zeros(len(h), bool)
                count = np.where(found, v.counts[at] if len(v.hashes) else 0, 0)
                symbol = np.where(found, v.symbols[at] if len(v.hashes) else -1, -1)
                share = np.where(symbol >= 0, 0.0, known_share[group] + np.where(found, np.log10(np.maximum(1, count)), 0.0))
                symbol = np.where(symbol >= 0, symbol, own + group)
                tokens = np.bincount(row, minlength=n)
                ends = np.cumsum(tokens + 1)
                flat = np.full(int(ends[-1]), end, np.int32)
                inner = np.ones(len(flat), bool)
                inner[ends - 1] = False
                flat[inner] = symbol[codes]
                bounds = np.concatenate([[0], ends]) * 4
                raw = flat.tobytes()
                rare = ~found[codes]
                lists = np.concatenate([[0], np.cumsum(np.bincount(row[rare], minlength=n))]).astype(np.int32)
                base = np.bincount(row, weights=np.where(found, v.base(count), 0.0)[codes], minlength=n).astype(float) + v.base(np.array([v.ends]))
                known = np.bincount(row, weights=found[codes], minlength=n).astype(np.int64) + (v.ends > 0)
                shares = np.bincount(row, weights=share[codes], minlength=n).astype(float)
                place = (np.flatnonzero(inner) - (ends - tokens - 1)[row])[rare].astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(h[codes[rare]]), pa.array(correction[group[codes[rare]]]), pa.array(known_share[group[codes[rare]]]), pa.array(place)], ["h", "unseen", "known", "place"])
                columns = [batch.column(0).slice(low, n), batch.column(1).slice(low, n), pa.array(tokens + 1), pa.array(known), pa.array(base), pa.array(shares)]
                columns += [pa.array([raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()), pa.ListArray.from_arrays(pa.array(lists), structs)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "known", "base", "share", "symbols", "rare"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(rows, "doc_id long, held_out boolean, n_tokens long, known long, base double, share double, symbols binary, rare array<struct<h:long,unseen:double,known:double,place:int>>")


def _time_major(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences, longest first, laid out step by step: symbols, how many sequences each step has, the order."""
    lengths = np.array([len(p) for p in parts])
    order = np.argsort(-lengths, kind="stable")
    active = np.searchsorted(-lengths[order], -np.arange(1, lengths.max() + 1), side="right")
    flat = np.concatenate([parts[i] for i in order])
    rank, step = np.repeat(np.arange(len(parts)), lengths[order]), np.arange(len(flat)) - np.repeat(np.cumsum(lengths[order]) - lengths[order], lengths[order])
    out = np.empty_like(flat)
    out[(np.cumsum(active) - active)[step] + rank] = flat
    return out, active, order


def log10_likelihoods(model: Hmm, parts: list[np.ndarray]) -> np.ndarray:
    """The scaled forward recursion over whole sequences, side by side."""
    if not parts:
        return np.zeros(0)
    symbols, active, order = _time_major(parts)
    logs, at = np.zeros(len(parts)), 0
    alpha, ones = np.tile(model.start, (len(parts), 1)), np.ones(len(model.start))
    for t, n in enumerate(active.tolist()):
        alpha = (alpha[:n] @ model.moves if t else alpha) * model.emits[symbols[at : at + n]]
        scale = alpha @ ones
        alpha /= scale[:, None]
        logs[:n] += np.log10(scale)
        at += n
    out = np.empty(len(parts))
    out[order] = logs
    return out


def expected_counts(model: Hmm, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch's expected starts, moves and emissions of some sequences."""
    k, symbols_all = len(model.start), model.emits.shape[0]
    symbols, active, _ = _time_major(parts)
    steps = list(zip(active.tolist(), (np.cumsum(active) - active).tolist(), strict=True))
    ahead = model.emits[symbols]
    alphas, scales, ones = np.empty_like(ahead), np.empty(len(symbols)), np.ones(k)
    for t, (n, a) in enumerate(steps):
        alpha = alphas[a : a + n]
        if t:
            np.dot(alphas[before : before + n], model.moves, out=alpha)
            alpha *= ahead[a : a + n]
        else:
            np.multiply(model.start, ahead[:n], out=alpha)
        scale = np.dot(alpha, ones, out=scales[a : a + n])
        alpha /= scale[:, None]
        before = a
    ahead /= scales[:, None]  # times a token's beta, in place: what its move and its emission give from there on
    back = np.ascontiguousarray(model.moves.T)
    for (_, a), (n, b) in zip(steps[-2::-1], steps[:0:-1], strict=True):
        ahead[a : a + n] *= np.dot(ahead[b : b + n], back)
    last, moves = np.repeat(active[:-1], active[1:]), np.zeros((k, k))
    for low in range(0, len(last), AT_ONCE):  # tokens with one before them, and the places of those
        here = np.arange(low, min(low + AT_ONCE, len(last))) + active[0]
        prior, then = here - last[low : low + AT_ONCE], ahead[here[0] : here[-1] + 1]
        some = alphas[prior]
        moves += some.T @ then
        then[:] = some * np.dot(then, back)  # the prior tokens' posteriors
    gammas = alphas
    gammas[np.arange(len(last)) + active[0] - last] = ahead[active[0] :]
    emitted = np.stack([np.bincount(symbols, weights=gammas[:, s], minlength=symbols_all) for s in range(k)], 1)
    return gammas[: active[0]].sum(0), moves * model.moves, emitted


def _grouped(sequences: list[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Whole sequences in groups of about ``BATCH`` tokens, long ones together: a step of the recursion then has many."""
    for some in ([s for s in sequences if len(s) < LONG], [s for s in sequences if len(s) >= LONG]):
        group, size = [], 0
        for s in some:
            group.append(s)
            size += len(s)
            if size >= BATCH:
                yield group
                group, size = [], 0
        if group:
            yield group


def _packed(emitted: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Expected emissions by buckets of ``BUCKET`` symbols: of each symbol its place, its sum over the states, and their shares in 255ths."""
    full = np.flatnonzero(emitted.any(1))
    total = emitted[full].sum(1)
    shares, place = np.rint(emitted[full] / total[:, None] * 255).astype(np.uint8), (full % BUCKET).astype(np.uint16)
    buckets, begin = np.unique(full // BUCKET, return_index=True)
    ends = np.append(begin[1:], len(full))[: len(begin)]
    return buckets, [place[a:b].tobytes() + total[a:b].astype(np.float32).tobytes() + shares[a:b].tobytes() for a, b in zip(begin.tolist(), ends.tolist(), strict=True)]


def _unpacked(raw: bytes, states: int) -> np.ndarray:
    n = len(raw) // (6 + states)
    place, total = np.frombuffer(raw, np.uint16, n), np.frombuffer(raw[2 * n : 6 * n], np.float32)
    shares = np.frombuffer(raw, np.uint8, n * states, 6 * n).reshape(n, states).astype(float)
    out = np.zeros((BUCKET, states))
    out[place] = shares / shares.sum(1, keepdims=True) * total[:, None]
    return out


def _sum_of(group: pd.DataFrame, states: int, packed: bool) -> pd.DataFrame:
    """The sum of a group's parts of one bucket; bucket -1 has moves and starts."""
    bucket = int(group["bucket"].iloc[0])
    parts = (_unpacked(raw, states) if packed and bucket >= 0 else np.frombuffer(raw, float) for raw in group["sums"])
    return pd.DataFrame({"bucket": [bucket], "sums": [sum(parts).tobytes()]})


TAIL = "tail array<struct<h:long,c:long,places:array<int>,emits:array<double>>>"


def _with_tail(model: Hmm, batch: pa.RecordBatch) -> tuple[Hmm, list[np.ndarray], np.ndarray, np.ndarray]:
    """The model with the batch's joined symbols added, the batch's sequences in them, and the added symbols' hashes and counts."""
    parts = [np.frombuffer(x, np.int32) for x in batch.column("symbols").to_pylist()]
    added: dict[int, int] = {}
    emits, counts = [], []
    for i, tail in enumerate(batch.column("tail").to_pylist()):
        if tail:
            parts[i] = parts[i].copy()
            for word in tail:
                if word["h"] not in added:
                    added[word["h"]] = len(model.emits) + len(added)
                    emits.append(word["emits"])
                    counts.append(word["c"])
                parts[i][word["places"]] = added[word["h"]]
    if added:
        model = replace(model, emits=np.concatenate([model.emits, np.array(emits)]))
    return model, parts, np.fromiter(added, np.int64, len(added)), np.array(counts, np.int64)


def _joined(rows: DataFrame, tail: DataFrame | None, table: DataFrame | None) -> DataFrame:
    """``rows`` with the emissions of their joined symbols: ``tail(uid, h, c, places)``, ``table(h, emits)``."""
    if tail is None:
        return rows.withColumn("tail", F.lit(None).cast(TAIL.removeprefix("tail ")))
    known = tail.join(table, "h").groupBy("uid").agg(F.collect_list(F.struct("h", "c", "places", "emits")).alias("tail"))
    return rows.join(known, "uid", "left")


def train(read: DataFrame, v: Vocabulary, tail: DataFrame | None, states: int = 6, rounds: int = 5, seed: int = 5) -> tuple[Hmm, DataFrame | None]:
    """Baum-Welch over all training documents, each whole.

    ``tail(uid, h, c, places)`` are the tokens of joined symbols. Beside the model comes those symbols' ``h, emits``.
    """
    sc = read.sparkSession.sparkContext
    corpus = (v.symbol_tokens + 0.5) / v.weight
    random = np.random.default_rng(seed)
    emits = corpus[:, None] * np.exp(random.normal(scale=0.6, size=(len(corpus), states)))
    model = Hmm(np.full(states, 1 / states), np.full((states, states), 0.02 / (states - 1)) + np.eye(states) * (0.98 - 0.02 / (states - 1)), emits / emits.sum(0) * corpus.sum())
    rows = read.where("not held_out").select("uid", "symbols")
    share = (F.col("c") + 0.5) / v.weight
    table = None if tail is None else tail.groupBy("h").agg(F.first("c").alias("c")).select("h", F.array(*[share] * states).alias("emits"))
    learning = None if tail is None else tail.join(rows.select("uid"), "uid", "left_semi")
    names = [f"s{s}" for s in range(states)]
    salts = -(-rows.rdd.getNumPartitions() // SUMMED)
    for _ in range(rounds):
        shared = sc.broadcast(model)

        def partial(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            now: Hmm = shared.value
            starts, moves, emitted = np.zeros(states), np.zeros((states, states)), np.zeros_like(now.emits)
            for batch in batches:
                model, parts, words, counts = _with_tail(now, batch)
                more = np.zeros((len(words), states))
                for group in _grouped(parts):
                    a, b, c = expected_counts(model, group)
                    starts += a
                    moves += b
                    emitted += c[: len(emitted)]
                    more += c[len(emitted) :]
                if len(words):
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.int32()), pa.nulls(len(words), pa.binary()), pa.array(words), pa.array(counts), *(pa.array(more[:, s].astype(np.float32)) for s in range(states))], ["bucket", "salt", "sums", "h", "c", *names])
            buckets, packed = _packed(emitted)
            salt = np.full(len(buckets) + 1, TaskContext.get().partitionId() % salts, np.int32)
            sums = pa.array([*packed, np.concatenate([moves, starts[None]]).tobytes()], pa.binary())
            none = [pa.nulls(len(salt), pa.int64()), pa.nulls(len(salt), pa.int64()), *(pa.nulls(len(salt), pa.float32()) for _ in names)]
            yield pa.RecordBatch.from_arrays([pa.array(np.append(buckets, -1).astype(np.int32)), pa.array(salt), sums, *none], ["bucket", "salt", "sums", "h", "c", *names])

        found = _joined(rows, learning, table).select("symbols", "tail").mapInArrow(partial, "bucket int, salt int, sums binary, h long, c long, " + ", ".join(f"{s} float" for s in names))
        if tail is not None:
            found = stored(found)
            by_word = found.where("bucket is null").groupBy("h").agg(F.max("c").alias("c"), *(F.sum(s).alias(s) for s in names))
        summed = found.where("bucket is not null").groupBy("bucket", "salt").applyInPandas(lambda g: _sum_of(g, states, True), "bucket int, sums binary")
        if salts > 1:
            summed = summed.groupBy("bucket").applyInPandas(lambda g: _sum_of(g, states, False), "bucket int, sums binary")
        emitted = np.zeros((-(-len(corpus) // BUCKET) * BUCKET, states))
        for r in summed.toArrow().to_pylist():
            part = np.frombuffer(r["sums"], float).reshape(-1, states)
            if r["bucket"] < 0:
                moves, starts = part[:-1] + 0.1, part[-1] + 0.1
            else:
                emitted[r["bucket"] * BUCKET : (r["bucket"] + 1) * BUCKET] = part
        emitted = emitted[: len(corpus)]
        of_state = emitted.sum(0)
        if tail is not None:
            of_state = of_state + np.array([x or 0.0 for x in by_word.agg(*(F.sum(s) for s in names)).first()])
        of_state = np.maximum(of_state, 1e-9)
        model = replace(model, start=starts / starts.sum(), moves=moves / moves.sum(1, keepdims=True), emits=(1 - BACKOFF) * emitted / of_state + BACKOFF * corpus[:, None])
        if tail is not None:
            learned = F.array(*((1 - BACKOFF) / float(of_state[i]) * F.col(s) + BACKOFF * share for i, s in enumerate(names)))
            table = stored(by_word.select("h", learned.alias("emits")))
        shared.unpersist()
        if tail is not None:
            sc._jvm.System.gc()  # the shuffle files of rounds that are done go
    return model, table


def lm_scores(docs: DataFrame, states: int = 6, rounds: int = 5) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id) mod 5 is 1 are held out, all others teach. Tokens are lower-cased words and one end. A null text counts as
    empty: the end alone. Rows without doc_id teach and are not held out; repeated rows count as often as they
    stand and each get a row. Without training documents the score is the base score. Texts are never cut, in training neither; a task
    holds some 200 bytes for each token of its longest text. All words of a group that training never saw are one token of the model.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("held_out", held_out_of(F.col("doc_id")))
    learned = texts.where("not held_out")
    counts = settled(word_counts(learned))
    v = vocabulary(counts, learned.count())
    read = settled(_read(texts, sc.broadcast(v)).withColumn("uid", F.monotonically_increasing_id()))
    rare = read.select("uid", F.explode("rare").alias("w")).select("uid", "w.*").groupBy("uid", "h").agg(F.count("*").alias("n"), F.first("unseen").alias("unseen"), F.first("known").alias("known"), F.collect_list("place").alias("places"))
    below = counts.where(F.col("c") < _floor(v)).select("h", "c")
    divisor = float(v.tokens + 0.5 * (v.types + 1))
    joined = rare.join(below, "h", "left").withColumn("c0", F.coalesce("c", F.lit(0)))
    tail = None
    if v.tail_words:
        joined = stored(joined)
        tail = joined.where(F.col("c0") >= OWN).select("uid", "h", "c", "places")
    if v.tokens:
        model, table = train(read, v, tail, states, rounds)
        shared = sc.broadcast(model)

        def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                now, parts, _, _ = _with_tail(shared.value, batch)
                logs = np.empty(len(parts))
                long = np.array([len(p) >= LONG for p in parts], bool)
                for of in (long, ~long):
                    logs[of] = log10_likelihoods(now, [parts[i] for i in np.flatnonzero(of)])
                yield pa.RecordBatch.from_arrays([*batch.columns[2:8], batch.column("uid"), pa.array(logs)], ["doc_id", "held_out", "n_tokens", "known", "base", "share", "uid", "log"])

        rows = _joined(read.select("uid", "symbols", "doc_id", "held_out", "n_tokens", "known", "base", "share"), tail, table)
        scored = rows.select("uid", "symbols", "doc_id", "held_out", "n_tokens", "known", "base", "share", "tail").mapInArrow(forward, "doc_id long, held_out boolean, n_tokens long, known long, base double, share double, uid long, log double")
    else:
        scored = read.select("doc_id", "held_out", "n_tokens", "known", "base", "share", "uid", F.lit(0.0).alias("log"))
    share = F.when(F.col("c0") >= OWN, -F.col("known")).when(F.col("c0") > 0, F.log10(F.greatest("c0", F.lit(1)))).otherwise(F.col("unseen"))
    more = joined.groupBy("uid").agg(F.sum(F.when(F.col("c0") > 0, F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * F.log10((F.col("c0") + 0.5) / divisor)).alias("more_base"), F.sum(F.col("n") * share).alias("more_share"))
    out = scored.join(more, "uid", "left")
    base = F.col("base") + F.coalesce("more_base", F.lit(0.0))
    score = F.col("log") + F.col("share") + F.coalesce("more_share", F.lit(0.0)) if v.tokens else base
    return out.select("doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def _floor(v: Vocabulary) -> int:
    """Words of a lower count are not among the head's."""
    return int(v.counts.min()) if len(v.counts) else 1 << 62
