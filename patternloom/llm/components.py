"""Distributed connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Neighbours from which a node's least one goes to every task instead of being joined, and the most such nodes.
HEAVY, HEAVIES = 512, 1 << 18


def _with_least(rows: DataFrame, least: DataFrame, heavy: int) -> DataFrame:
    """``rows(u, v)`` with ``m`` of ``least(u, m, d)``; nodes of ``heavy`` rows or more are few, so no task gets all of one's rows."""
    few = F.broadcast(least.where(F.col("d") >= heavy).select("u", F.col("m").alias("known")))
    marked = rows.join(few, "u", "left")
    rest = marked.where("known is null").select("u", "v").join(least.where(F.col("d") < heavy).select("u", "m"), "u")
    return marked.where("known is not null").select("u", "v", F.col("known").alias("m")).unionByName(rest)


def _large_star(edges: DataFrame, heavy: int) -> DataFrame:
    """Every larger neighbour of a node moves to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("d"))
    return _with_least(both, least, heavy).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, heavy: int) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
    moved = _with_least(down, least, heavy).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many ``edges(u, v)`` there are, and how many nodes still have two edges up, or one each way: none in stars around their least nodes."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, label)``: label is the least node reachable, for every node that has an edge.

    Self-links and repeated edges do no harm; rows with a null end are ignored; no edges give no rows.
    Each round is kept in the shared checkpoint folder; only two numbers reach the driver. Rounds end when all edges are stars around
    their least nodes, which takes no round more to see. Of m edges at most ``HEAVIES`` nodes' least neighbours are broadcast: those of
    2m / ``HEAVIES`` neighbours or more, and of ``HEAVY`` at least.
    """
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        count, unsettled = _state(now)
        if not unsettled:
            break
        heavy = max(HEAVY, -(-2 * count // HEAVIES))
        now = stored(_small_star(_large_star(now, heavy).distinct(), heavy).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
