"""Operator 5: URL rules by cascades of Bloom filters.

A cascade holds a list of keys exactly over a known universe, here every key that any URL of the
corpus can be looked up by. Its first filter encodes the list, the next the universe's keys that
the first takes for listed, the next the listed keys that this takes for others, and so on until
none is left. A lookup asks the filters in turn and needs no join. The first filter is made so tight that it takes about as many of the other
keys as are listed: all filters grow with the list, by the logarithm of the universe only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled

#: Share of other keys that the filters after the first let through, and the most bits that a filter may have: filters go to every task.
SHARE, MOST_BITS = 1 / 16, 1 << 28
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def _hashed(key: Column) -> Column:
    return F.struct(key.alias("key"), F.xxhash64(key).alias("x"), F.xxhash64(F.lit("#"), key).alias("y"))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every rule key that would fit: each suffix of the host with each path prefix of a rule's length, longest first."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("h")))
    prefixes = F.filter(F.array(*(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths)), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct((-F.length(s["h"]) - F.length(p)).alias("order"), (-F.length(s["h"])).alias("host_order"), F.concat(s["h"], p).alias("k")))))
    return F.when(host != "", F.transform(F.array_sort(pairs), lambda s: _hashed(s["k"]))).otherwise(F.array().cast("array<struct<key:string,x:bigint,y:bigint>>"))


def first_share(listed: int, others: int) -> float:
    """The share of other keys that the first filter may let through, so that about as many are as keys are listed."""
    return min(0.5, max(1, listed) / max(1, others))


def filter_shape(count: int, share: float) -> tuple[int, int]:
    """Bits and probes of a Bloom filter of ``count`` keys that lets ``share`` of others through."""
    probes = max(1, round(-math.log2(share)))
    return max(64, -(-math.ceil(count * probes / math.log(2)) // 64) * 64), probes


class Cascade:
    """Filters as bit arrays with their numbers of probes, asked in turn."""

    def __init__(self, filters: list[tuple[np.ndarray, int]]):
        self.filters = filters

    @staticmethod
    def probes(x: np.ndarray, y: np.ndarray, bits: int, probes: int, level: int) -> Iterator[np.ndarray]:
        a, b = x.view(np.uint64), y.view(np.uint64) | np.uint64(1)
        for i in range(probes):
            yield (((a + np.uint64(i + 64 * level) * b) >> np.uint64(11)) % np.uint64(bits)).astype(np.int64)

    def passes(self, level: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        filter_, probes = self.filters[level]
        hit = np.ones(len(x), bool)
        for at in self.probes(x, y, len(filter_) * 64, probes, level):
            hit &= (filter_[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return hit

    def listed(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Exact for keys of the universe: the first filter that says no decides, by its place."""
        out, open_ = np.full(len(x), len(self.filters) % 2 == 1), np.ones(len(x), bool)
        for level in range(len(self.filters)):
            stops = open_.copy()
            stops[open_] = ~self.passes(level, x[open_], y[open_])
            out[stops] = level % 2 == 1
            open_ &= ~stops
        return out


def _filter(keys: DataFrame, count: int, share: float, level: int) -> tuple[np.ndarray, int]:
    """The Bloom filter of ``keys(x, y)``, its words put together by partial ORs, and its number of probes."""
    bits, probes = filter_shape(count, share)
    if bits > MOST_BITS:
        raise ValueError(f"a filter of {count} keys needs {bits} bits; {MOST_BITS} may be sent to every task")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.asarray(batch.column(i)) for i in (0, 1))
            at = np.concatenate(list(Cascade.probes(x, y, bits, probes, level)))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    got = keys.select("x", "y").mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[np.asarray(got["word"]).astype(np.int64)] = np.asarray(got["bits"]).astype(np.int64)
    return out, probes


def build_cascade(listed: DataFrame, universe: DataFrame, others: int | None = None) -> Cascade:
    """The cascade that tells ``listed(x, y)`` from the other keys of ``universe(x, y)``, of which there are about ``others``."""
    listed = settled(listed.select("x", "y").distinct())
    count = listed.count()
    if others is None:
        others = universe.agg(F.approx_count_distinct("x")).first()[0]
    filters = [_filter(listed, count, first_share(count, others), 0)]

    def passing(keys: DataFrame) -> DataFrame:
        level, cascade = len(filters) - 1, keys.sparkSession.sparkContext.broadcast(Cascade(list(filters)))

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = (np.asarray(batch.column(i)) for i in (0, 1))
                yield batch.filter(pa.array(cascade.value.passes(level, x, y)))

        return settled(keys.select("x", "y").mapInArrow(keep, "x long, y long").distinct())

    inside, outside = listed, universe.select("x", "y")
    outside = passing(outside).join(listed, ["x", "y"], "left_anti")
    while count := outside.count():
        # what the last filter takes wrongly, encoded by the next; the sides change places each time
        filters.append(_filter(outside, count, SHARE, len(filters)))
        inside, outside = outside, passing(inside)
    return Cascade(filters)


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict.

    ``rules`` are (verdict, host, path); a rule fits its host and all subdomains if the path starts
    with the rule's, and the longest (then the one of the longer host) wins; of equal ones block wins. Without a rule the
    cascades find no listed key: allow, rule null. A null URL or one without ``://`` has an empty host and path.
    Repeated rows are each judged; other columns are left out. No rules: all pages are allowed. A list whose filter needs more than
    ``MOST_BITS`` (about five million rules) is an error.
    """
    spark: SparkSession = pages.sparkSession
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    lengths = sorted({len(path) for _, _, path in rules})
    keyed = urls.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), lengths))
    universe = keyed.select(F.explode("keys").alias("k")).select("k.x", "k.y")
    listed = spark.createDataFrame(rules, "verdict string, host string, path string").where("host <> ''").select("verdict", _hashed(F.concat("host", "path")).alias("k")).select("verdict", "k.x", "k.y")
    others = universe.agg(F.approx_count_distinct("x")).first()[0]
    cascades = {v: spark.sparkContext.broadcast(build_cascade(listed.where(F.col("verdict") == v), universe, others)) for v in ("block", "allow")}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            keys, row = lists.flatten(), np.asarray(lists.value_lengths()).astype(np.int64)
            row = np.repeat(np.arange(len(row)), row)
            x, y = (np.asarray(keys.field(i)) for i in (1, 2))
            hits = {v: c.value.listed(x, y) for v, c in cascades.items()}
            first = np.full(len(batch), len(keys), np.int64)
            np.minimum.at(first, row[hits["block"] | hits["allow"]], np.flatnonzero(hits["block"] | hits["allow"]))
            none = first == len(keys)
            safe = pa.array(first, mask=none)
            blocked = np.append(hits["block"], False)[first]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], keys.field(0).take(safe), pa.array(np.where(blocked, "block", "allow"))], ["page_id", "host", "path", "rule", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return keyed.select("page_id", "host", "path", "keys").mapInArrow(judge, f"page_id {kind}, host string, path string, rule string, verdict string")


#: The rules of the registered query: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def sql(rules: list[tuple[str, str, str]]) -> str:
    """The same as DuckDB SQL over ``pages``."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    return f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {values}),
cut AS (SELECT page_id, row_number() OVER () AS nr, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
urls AS (SELECT page_id, nr, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
fits AS (SELECT nr, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY nr ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, verdict DESC) AS place
  FROM urls JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (nr)"""
