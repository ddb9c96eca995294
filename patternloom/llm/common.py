"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _checkpoints(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # one machine: a temporary folder serves
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed once and kept in the cluster's shared checkpoint folder.

    A temporary folder is set only where the session runs on one machine and names none; a cluster without one is an error.
    """
    _checkpoints(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``settled``, as a Parquet table in the same folder: for many rows, which take less room so."""
    path = f"{_checkpoints(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (Spark tells no case apart)."""
    known = {c.lower() for c in taken}
    while name.lower() in known:
        name = f"_{name}"
    return name


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as one plain string array, null read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "")


def str_list(texts: pa.Array) -> list[str]:
    """The strings of an array without nulls; ``to_pylist`` takes ten times as long, as it makes a scalar of each."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def slices(texts: pa.Array, chars: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``chars`` bytes of text each; a longer text has a range to itself."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64) + 1) if len(texts) else np.zeros(0)
    at = 0
    while at < len(texts):
        floor = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, floor + chars, side="right")))
        yield at, to
        at = to


def ascii_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, pa.Array]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of every text: the row of each word, and the words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, rows = lists.flatten(), np.asarray(pc.list_parent_indices(lists)).astype(np.int32)
    full = pc.greater(pc.binary_length(words), 0)
    if not pc.all(full).as_py() and len(words):
        words, rows = words.filter(full), rows[np.asarray(full)]
    return rows, words


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``flat[starts[p]:starts[p]+lengths[p]]`` for each p of ``pick``, end to end, and their lengths."""
    n = lengths[pick]
    total = int(n.sum())
    shift = np.repeat(starts[pick] - (np.cumsum(n) - n), n)
    return flat[shift + np.arange(total, dtype=shift.dtype)], n


def _places(values: np.ndarray, bits: int) -> list[np.ndarray]:
    h, shift = values.view(np.uint64), np.uint64(64 - (bits.bit_length() - 1))
    return [((h ^ (h >> np.uint64(31))) * np.uint64(m) >> shift).astype(np.int64) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]


def bitmap(values: DataFrame, count: int, most_bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter over the one long column of ``values``: 16 bits a value, ``most_bits`` (a power of 2) at most, so 8 MB.

    It is for leaving rows out early that a later join would drop; where it is full, it leaves fewer out.
    """
    bits = min(most_bits, max(1 << 10, 1 << (16 * count).bit_length()))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_places(np.asarray(batch.column(0)), bits))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    got = values.mapInArrow(words, "word int, bits long").groupBy("word").agg({"bits": "bit_or"}).toDF("word", "bits").toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[np.asarray(got["word"])] = np.asarray(got["bits"]).view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values may be among those of ``bitmap``; those that were are."""
    hit = np.ones(len(values), bool)
    for at in _places(values, len(words) * 64):
        hit &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit
