"""Numeric profiles of columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .patterns import joined_by, running
from .settling import settled

#: Groups up to which their medians go to every task; those of more are joined by key.
BROADCAST_GROUPS = 1 << 17


def nth(values: DataFrame, column: str, k: int) -> DataFrame:
    """One row: the k-th least value, from 0."""
    counts = values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    return running(counts, ["v"], "c").where((F.col("end") > k) & (F.col("end") - F.col("c") <= k)).select("v")


def profile(values: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """n, min, q1, median, q3, max, mad, mean, sse, sd, overall or per group.

    Quartiles are elements: those at (n-1)/4, (n-1)/2 and 3(n-1)/4, rounded down. mad is the median distance from the
    median. Nulls are left out; a group without values has none; a null key is a group of its own.
    """
    keys = by or []
    rows = values.where(F.col(column).isNotNull()).select(*keys, F.col(column).cast("double").alias("v"))

    def picked(counts: DataFrame, value: str, places: dict[str, tuple[int, int]]) -> DataFrame:
        """Elements by rank from the counts of distinct values, which ``running`` sums up by ranges, in groups too."""
        ranked = running(counts, [value], "c", keys)
        at = lambda num, den: F.floor((F.col("n") - 1) * num / den)
        hit = lambda p: (F.col("end") > at(*p)) & (F.col("end") - F.col("c") <= at(*p))
        return ranked.groupBy(*keys).agg(*(F.max(F.when(hit(p), F.col(value))).alias(name) for name, p in places.items()))

    counts = rows.groupBy(*keys, "v").agg(F.count("*").alias("c"))
    quartiles = picked(counts, "v", {"q1": (1, 4), "median": (1, 2), "q3": (3, 4)})
    basic = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("sse"), F.stddev_samp("v").alias("sd"))
    together = settled(joined_by(basic, quartiles, keys) if keys else basic.crossJoin(quartiles))
    middle = together.select(*keys, "median")
    if not keys or together.count() <= BROADCAST_GROUPS:
        middle = F.broadcast(middle)  # joined by key, all of a group's values would meet in one task
    away = (joined_by(counts, middle, keys) if keys else counts.crossJoin(middle)).withColumn("d", F.abs(F.col("v") - F.col("median")))
    mad = picked(away.groupBy(*keys, "d").agg(F.sum("c").alias("c")), "d", {"mad": (1, 2)})
    return joined_by(together, mad, keys) if keys else together.crossJoin(mad)
