"""Sparse two-dimensional arrays: ``cells(name, x, y, cnt)``, mostly x a time bin and y a host."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hist_to_array(comp_hist: DataFrame, bin_width: int = 3600, host: str | None = None, ptn: str | None = None) -> DataFrame:
    """``epoch, host, cnt`` summed over patterns."""
    rows = comp_hist.where(F.col("bin_width") == bin_width)
    if host is not None:
        rows = rows.where(F.col("host") == host)
    if ptn is not None:
        rows = rows.where(F.col("ptn") == ptn)
    return rows.groupBy("epoch", "host").agg(F.sum("msg_count").alias("cnt"))


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """``x, y, cnt``: the cells of both, with the lesser count."""
    return a.select("x", "y", F.col("cnt").alias("p")).join(b.select("x", "y", F.col("cnt").alias("q")), ["x", "y"]).select("x", "y", F.least("p", "q").alias("cnt"))


def support(cells: DataFrame, names: list[str]) -> DataFrame:
    """One row: the sum over the cells that all named arrays have of their least count."""
    wanted = [*dict.fromkeys(names)]
    common = cells.where(F.col("name").isin(wanted)).groupBy("x", "y").agg(F.countDistinct("name").alias("k"), F.min("cnt").alias("cnt")).where(F.col("k") == len(wanted))
    return common.agg(F.coalesce(F.sum("cnt"), F.lit(0)).cast("long").alias("support"))


def totals(cells: DataFrame) -> DataFrame:
    """``name, total_count, cell_count``."""
    return cells.groupBy("name").agg(F.sum("cnt").alias("total_count"), F.count("*").alias("cell_count"))


def heat_map(cells: DataFrame, width: int = 64, height: int = 64, x_bin: int = 1, y_bin: int = 1) -> DataFrame:
    """``row, col, cnt``: counts in at most ``width`` x ``height`` boxes, each a multiple of the input's bins. Totals stay."""
    span = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = lambda low, high, unit, n: F.ceil((F.col(high) - F.col(low) + unit) / (unit * n)) * unit
    span = span.select("x0", "y0", box("x0", "x1", x_bin, width).alias("xb"), box("y0", "y1", y_bin, height).alias("yb"))
    at = cells.crossJoin(F.broadcast(span))
    return at.select(F.floor((F.col("y") - F.col("y0")) / F.col("yb")).alias("row"), F.floor((F.col("x") - F.col("x0")) / F.col("xb")).alias("col"), "cnt").groupBy("row", "col").agg(F.sum("cnt").alias("cnt"))


def out_of_order(cells: DataFrame) -> DataFrame:
    """Cells that occur more than once in an array; a proper array has none."""
    return cells.groupBy("name", "x", "y").agg(F.count("*").alias("n")).where("n > 1")
