"""Operator 4: near duplicates among embeddings.

Signs against random hyperplanes put each vector into one bucket of each of several tables; equal
vectors count as one first. Buckets are cut into blocks and every pair of blocks is a task, so no
bucket is a task's whole burden. A task compares its blocks by exact cosine in double
precision, counts the links of each vector, a pair only in the first table that brings its vectors together,
and emits counts and spanning links, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import settled
from .components import components

#: Vectors of a block; the chance of missing a pair exactly at the threshold that the tables leave.
BLOCK, MISSED = 1024, 1e-6


def table_plan(n: int, threshold: float, per_bucket: int = 256) -> tuple[int, int]:
    """Bits a table and tables: buckets of about ``per_bucket`` unrelated vectors, and tables for ``MISSED``."""
    agree = 1 - math.acos(threshold) / math.pi
    bits = max(4, math.ceil(math.log2(max(2, n / per_bucket))))
    return bits, math.ceil(math.log(MISSED) / math.log1p(-(agree**bits)))


def _tile(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Counts (b null) and spanning links of one pair of blocks of one bucket."""
    table = int(group["table"].iloc[0])
    same = bool(group["i"].iloc[0] == group["j"].iloc[0])
    side = group["block"].to_numpy() == group["i"].iloc[0]
    x = np.stack(group["v"].to_numpy()).astype(float)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    ids, copies, signs = group["node"].to_numpy(np.int64), group["copies"].to_numpy(np.int64), np.stack(group["signs"].to_numpy())
    left, right = np.flatnonzero(side), np.flatnonzero(side if same else ~side)
    if not len(left) or not len(right):
        return pd.DataFrame({"a": pd.Series([], dtype="int64"), "b": pd.Series([], dtype="Int64"), "n": pd.Series([], dtype="int64")})
    links, edges_a, edges_b = np.zeros(len(ids), np.int64), [], []
    for low in range(0, len(left), 256):
        rows = left[low : low + 256]
        p, q = np.nonzero(x[rows] @ x[right].T >= threshold)
        p, q = rows[p], right[q]
        if same:
            p, q = p[p < q], q[p < q]
        new = ~(signs[p, :table] == signs[q, :table]).any(1)
        p, q = p[new], q[new]
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        edges_a.append(p)
        edges_b.append(q)
    p, q = np.concatenate(edges_a), np.concatenate(edges_b)
    label = np.arange(len(ids))
    while len(p):
        least = label.copy()
        np.minimum.at(least, p, label[q])
        np.minimum.at(least, q, label[p])
        least = least[least]
        if (least == label).all():
            break
        label = least
    far, linked = np.flatnonzero(label != np.arange(len(ids))), np.flatnonzero(links)
    return pd.DataFrame({"a": np.concatenate([ids[linked], ids[label[far]]]), "b": pd.array([pd.NA] * len(linked) + ids[far].tolist(), dtype="Int64"), "n": np.concatenate([links[linked], np.zeros(len(far), np.int64)])})


def embedding_dedup(vectors: DataFrame, threshold: float = 0.95, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Links join vectors with a cosine of ``threshold`` or more, equal ones included. Vectors that are null, empty, zero or
    hold null or non-finite numbers link with nothing, and each is its own component; so do
    vectors of different lengths. Repeated rows are vectors of their own. An empty table gives no rows.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("v"))
    sound = F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False))
    plain = F.transform("v", lambda e: F.when(e == 0, F.lit(0)).otherwise(e)).cast(kind)  # no negative zeros
    rows = rows.select("vec_id", F.when(sound, plain).alias("v"))
    coded = rows.where("v is not null").select("vec_id", F.col("v"), F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("h2"))
    nodes = settled(coded.groupBy("h", "h2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.any_value("v").alias("v")).where("node is not null"))
    count = nodes.count()
    bits, tables = table_plan(count, threshold)

    @F.pandas_udf("array<int>")
    def signs_of(v: pd.Series) -> pd.Series:
        signs = [None] * len(v)
        lengths = v.map(len).to_numpy()
        for size in np.unique(lengths):
            at = np.flatnonzero(lengths == size)
            x = np.stack(v.iloc[at].to_numpy()).astype(float)
            planes = np.random.default_rng([seed, int(size)]).normal(size=(int(size), tables * bits))
            code = ((x @ planes) > 0).reshape(len(x), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))
            for i, s in zip(at, code.astype(np.int32), strict=True):
                signs[i] = s
        return pd.Series(signs)

    ready = settled(nodes.select("node", "copies", F.size("v").alias("size"), "v", signs_of("v").alias("signs")))
    placed = ready.select("node", "size", F.posexplode("signs").alias("table", "bucket"))
    loads = placed.groupBy("size", "table", "bucket").count().where("count > 1").select("size", "table", "bucket", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    dealt = placed.join(loads, ["size", "table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    tiles = dealt.select("node", "size", "table", "bucket", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("node", "size", "table", "bucket", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    found = settled(tiles.join(ready.select("node", "copies", "v", "signs"), "node").groupBy("size", "table", "bucket", "i", "j").applyInPandas(lambda group: _tile(group, threshold), "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").cast(LongType()).alias("n"))
    labels = components(found.where("b is not null").select("a", "b"))
    per_node = nodes.join(links, "node", "left").join(labels, "node", "left").select("h", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("label", "node").alias("component_id"))
    out = rows.select("vec_id", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2")).join(per_node, ["h", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def sql(threshold: float = 0.95) -> str:
    """The same rows as ``embedding_dedup`` in DuckDB's SQL, from the cosine of every pair."""
    return f"""WITH RECURSIVE vectors AS MATERIALIZED (SELECT row_number() OVER () AS u, CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS MATERIALIZED (SELECT u, e FROM vectors WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.u AS a, b.u AS b FROM sound a JOIN sound b ON a.u <> b.u AND len(a.e) = len(b.e) WHERE CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) END >= {threshold}),
reached AS (SELECT u, vec_id AS c FROM vectors UNION SELECT link.b, reached.c FROM reached JOIN link ON reached.u = link.a),
component AS (SELECT u, min(c) AS component_id FROM reached GROUP BY u),
links AS (SELECT a AS u, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, coalesce(vec_id = component_id, true) AS kept FROM vectors JOIN component USING (u) LEFT JOIN links USING (u)"""
