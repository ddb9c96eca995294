"""Operator 7: a quality classifier over document statistics.

Random Fourier features approximate a Gaussian kernel over the standardised statistics. Each
partition sums its rows' normal equations; the ridge scores fitted from these sums are calibrated
isotonically on scores that the rows' own folds had no part in.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_words, bitmap, free_name, in_bitmap, settled, slices, strings

SLICE_CHARS = 1_500_000
#: Classes of bytes whose shares are statistics.
_GROUPS = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " ", "\n", "\t\r", ".", ",", "!?", ";:", "'\"", "()[]{}", "|", "*#$%&@", "<>/\\=+_~^`-"]
_OTHER, _WIDE, CLASSES = len(_GROUPS), len(_GROUPS) + 1, len(_GROUPS) + 2
_CLASS = np.full(256, _OTHER, np.uint8)
for _i, _group in enumerate(_GROUPS):
    _CLASS[list(_group.encode())] = _i
_CLASS[128:] = _WIDE
_BLANK = np.zeros(CLASSES, bool)
_BLANK[3:6] = True
FOLDS, BINS, LAMBDAS = 5, 2048, (1e-3, 1e-2, 1e-1, 1.0, 10.0)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of numbers for every text; for an empty one all are defined too. The squares of word lengths stop at 100 bytes a word."""
    n = len(texts)
    flat, sizes = np.frombuffer(b"".join(texts.cast(pa.binary()).to_pylist()), np.uint8), np.asarray(pc.binary_length(texts)).astype(np.int64)
    classes, row = _CLASS[flat], np.repeat(np.arange(n), sizes)
    by_class = np.bincount(row * CLASSES + classes, minlength=n * CLASSES).reshape(n, CLASSES).astype(float)
    blank = _BLANK[classes]
    last = np.ones(len(flat), bool)  # of its text
    last[:-1] = row[1:] != row[:-1]
    ends = ~blank & (last | np.append(blank[1:], True))
    starts = ~blank & np.append(True, blank[:-1] | last[:-1])
    at_ends = np.bincount(row[ends] * CLASSES + classes[ends], minlength=n * CLASSES).reshape(n, CLASSES)
    at_starts = np.bincount(row[starts] * CLASSES + classes[starts], minlength=n * CLASSES).reshape(n, CLASSES)
    words = np.maximum(1, at_ends.sum(1))
    length = np.diff(np.flatnonzero(np.append(starts, True)))  # from a word's start to the next one's
    squares = np.bincount(row[starts], weights=np.minimum(length, 100).astype(float) ** 2, minlength=n)
    distinct = []
    lists = pc.split_pattern(texts, "\n")
    lines = lists.flatten()
    for of, parts in (ascii_words(texts, lower=True), (np.asarray(pc.list_parent_indices(lists)).astype(np.int64), lines)):
        codes = np.asarray(parts.dictionary_encode().indices).astype(np.int64)
        pairs = np.unique(of.astype(np.int64) * (len(parts) + 1) + codes) // (len(parts) + 1)
        distinct.append(np.bincount(pairs, minlength=n) / np.maximum(1, np.bincount(of, minlength=n)))
    chars = np.maximum(1, sizes)[:, None]
    return np.column_stack([np.log1p(sizes), np.sqrt(by_class / chars), at_ends / words[:, None], at_starts / words[:, None], np.log1p(sizes / words), np.log1p(squares / words), np.log1p(sizes / (by_class[:, 4] + 1)), *distinct, np.log1p(words)])


WIDTH = statistics(pa.array(["a"])).shape[1]


@dataclass(frozen=True)
class Model:
    """Everything a score needs; its size doesn't depend on the data's."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(z))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weights, self.knots, self.levels), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray, means: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising levels of the least-squares fit by pooling neighbours that fall."""
    pools: list[list[float]] = []
    for v, w, m in zip(values.tolist(), weights.tolist(), means.tolist(), strict=True):
        pools.append([v * w, w, m * w])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
    p = np.array(pools)
    return p[:, 0] / p[:, 1], p[:, 2] / p[:, 1]


def labelled_statistics(docs: DataFrame, labels: DataFrame, train_mod: int = 3, held_out: int = 1) -> DataFrame:
    """x, y, fold of the documents that may teach: those with a label and crc32(doc_id) mod ``train_mod`` other than ``held_out``."""
    crc = F.crc32(F.col("doc_id").cast("long").cast("string"))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
    known = settled(known.where(F.pmod(crc, F.lit(train_mod)) != held_out))
    # most texts without a label are left out before their statistics are made; the join drops the others
    labelled = docs.sparkSession.sparkContext.broadcast(bitmap(known.select("doc_id"), known.count()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(labelled.value, np.asarray(batch.column(0)))))
            texts = strings(batch.column(1))
            for low, high in slices(texts, SLICE_CHARS):
                x = statistics(texts.slice(low, high - low))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])

    may = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).where(F.pmod(crc, F.lit(train_mod)) != held_out)
    x = may.mapInArrow(measured, "doc_id long, x array<double>")
    return x.join(known, "doc_id").select("x", "y", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))


def _summed(rows: DataFrame, terms, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of ``terms(x, y, fold)``, an array of ``shape``, by way of partial sums per partition."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for f in frames:
            if len(f):
                total += terms(np.stack(f["x"].to_numpy()), f["y"].to_numpy(), f["fold"].to_numpy())
        yield pd.DataFrame({"i": np.arange(total.shape[0]), "v": list(total.reshape(total.shape[0], -1))})

    parts = rows.mapInPandas(partial, "i int, v array<double>").select("i", F.posexplode("v").alias("j", "v"))
    sums, out = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas(), np.zeros((shape[0], int(np.prod(shape[1:]))))
    out[sums["i"], sums["j"]] = sums["v"]
    return out.reshape(shape)


def fit(docs: DataFrame, labels: DataFrame, dim: int = 192, seed: int = 7) -> Model:
    """The model of all labelled rows that may teach. Without any, every score is 0.5."""
    rows = settled(labelled_statistics(docs, labels))
    moments = _summed(rows, lambda x, y, _: np.stack([x.sum(0), (x * x).sum(0), np.full(x.shape[1], len(x))]), (3, WIDTH))
    n = max(1.0, moments[2, 0])
    mean = moments[0] / n
    scale = np.sqrt(np.maximum(moments[1] / n - mean * mean, 0))
    scale = np.where(scale > 1e-9, scale, 1.0)
    random = np.random.default_rng(seed)
    empty = Model(mean, scale, random.normal(size=(WIDTH, dim)) / np.sqrt(WIDTH), random.uniform(0, 2 * np.pi, dim), np.zeros(dim + 1), np.zeros(1), np.full(1, 0.5))
    if moments[2, 0] < 2:
        return empty

    def normal(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        f = np.column_stack([empty.features(x), y])
        return np.stack([f[fold == k].T @ f[fold == k] for k in range(FOLDS)])

    sums = _summed(rows, normal, (FOLDS, dim + 2, dim + 2))

    def solved(s: np.ndarray, ridge: float) -> np.ndarray:
        penalty = np.eye(dim + 1) * ridge
        penalty[-1, -1] = 1e-9
        return np.linalg.solve(s[:-1, :-1] + penalty, s[:-1, -1])

    whole = sums.sum(0)

    def loss(ridge: float) -> float:
        out = 0.0
        for k in range(FOLDS):
            w, s = solved(whole - sums[k], ridge), sums[k]
            out += w @ s[:-1, :-1] @ w - 2 * w @ s[:-1, -1]
        return out

    ridge = min(LAMBDAS, key=loss)
    apart = np.stack([solved(whole - sums[k], ridge) for k in range(FOLDS)])

    def histogram(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        s = np.einsum("ij,ij->i", empty.features(x), apart[fold])
        b = np.clip(((s + 0.5) * (BINS / 2)).astype(int), 0, BINS - 1)  # scores from -0.5 to 1.5
        return np.stack([np.bincount(b, weights=w, minlength=BINS) for w in (np.ones(len(s)), np.clip(s, -0.5, 1.5), y)])

    counts, scores, hits = _summed(rows, histogram, (3, BINS))
    full = counts > 0
    knots, levels = isotonic(scores[full] / counts[full], counts[full], hits[full] / counts[full])
    # a slight slope keeps the order of scores within a level
    return Model(mean, scale, empty.directions, empty.phases, solved(whole, ridge), np.concatenate([[-0.6], knots, [1.6]]), np.concatenate([[max(0.0, levels[0] - 0.01)], levels, [min(1.0, levels[-1] + 0.01)]]))


def scored(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """``docs`` with the score added as ``name``, from whole texts; a null text counts as empty. Other columns pass through.

    ``name`` must not be a column of ``docs``; see ``free_name``.
    """
    fields = docs.columns
    text = fields.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch.column(text))
            for low, high in slices(texts, SLICE_CHARS):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(statistics(texts.slice(low, high - low))))], [*fields, name])

    from pyspark.sql.types import DoubleType, StructType

    return docs.mapInArrow(score, StructType([*docs.schema.fields]).add(name, DoubleType()))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that a model fitted on their own labelled rows scores ``least`` or more; all columns, whatever their names."""
    name = free_name(docs.columns, "quality_score")
    return scored(docs, fit(docs, labels), name).where(F.col(name) >= least).select(*docs.columns)


def quality_scores(docs: DataFrame, labels: DataFrame, dim: int = 192) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted.

    Learns from the labelled rows whose crc32(doc_id) mod 3 isn't 1, all of them. Rows without
    doc_id never teach and are scored as held_out null; a null text counts as empty; repeated rows are each
    scored, and repeated labels averaged; labels that are null are left out.
    """
    model = fit(docs, labels, dim)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    return rows.select("doc_id", held.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
