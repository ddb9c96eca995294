"""Occurrence histograms in bins of a minute, an hour and a day.

The finest bins are counted first; coarser ones are sums of them, so a message is exploded once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

WIDTHS = (60, 3600, 86400)
#: Rows of a histogram that one task may put together.
TASK_ROWS = 1 << 18


def _rolled(finest: DataFrame, keys: list[str], count: str, widths: tuple[int, ...]) -> DataFrame:
    """All widths from counts in bins of the least: every other one has to be a multiple of it."""
    if any(w % widths[0] for w in widths):
        raise ValueError("bin widths have to be multiples of the first")
    each = finest.withColumn("bin_width", F.explode(F.array(*(F.lit(w) for w in widths))))
    start = X.bin_start(F.col("epoch"), F.col("bin_width"))
    return each.withColumn("epoch", start).groupBy("bin_width", "epoch", *keys).agg(F.sum(count).alias(count))


def _epoch(width: int):
    return X.bin_start(F.floor(F.col("epoch_us") / 1_000_000), width).alias("epoch")


def token_hist(typed: DataFrame, widths: tuple[int, ...] = WIDTHS) -> DataFrame:
    """``bin_width, epoch, tkn_text, tkn_count`` of every element, marks and spaces included."""
    flat = typed.select(_epoch(widths[0]), F.explode("argv.text").alias("tkn_text"))
    return _rolled(flat.groupBy("epoch", "tkn_text").agg(F.count("*").alias("tkn_count")), ["tkn_text"], "tkn_count", widths)


def pattern_hist(typed: DataFrame, widths: tuple[int, ...] = WIDTHS, total: bool = True) -> DataFrame:
    """``bin_width, epoch, ptn, msg_count``; with ``total`` a row per bin whose ptn is null: all patterns."""
    counts = _rolled(typed.groupBy(_epoch(widths[0]), "ptn").agg(F.count("*").alias("msg_count")), ["ptn"], "msg_count", widths)
    if not total:
        return counts
    return counts.groupingSets([("bin_width", "epoch", "ptn"), ("bin_width", "epoch")], "bin_width", "epoch", "ptn").agg(F.sum("msg_count").alias("msg_count"))


def parts_of(messages: int, widths: tuple[int, ...] = WIDTHS) -> int:
    """So many partitions that each gets about ``TASK_ROWS`` rows at most of a histogram of so many messages."""
    return max(1, -(-messages * len(widths) // TASK_ROWS))


def component_hist(typed: DataFrame, widths: tuple[int, ...] = WIDTHS, parts: int | None = None) -> DataFrame:
    """``bin_width, epoch, host, ptn, msg_count``.

    With ``parts`` the finest counts are dealt by host and pattern into so many partitions. Bins compress well, so partitions
    cut by shuffled bytes alone hold too many rows for the memory of a task that reads several such tables.
    """
    counts = typed.groupBy(_epoch(widths[0]), "host", "ptn").agg(F.count("*").alias("msg_count"))
    if parts:
        counts = counts.repartition(parts, "host", "ptn")
    return _rolled(counts, ["host", "ptn"], "msg_count", widths)


def merged_counts(old: DataFrame, change: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Counters after a change of signed counts; counters that come to 0 go."""
    return old.unionByName(change).groupBy(*keys).agg(F.sum(count).alias(count)).where(F.col(count) > 0)


def hist_filter(hist: DataFrame, bin_width: int | None = None, begin: int | None = None, end: int | None = None, **equal) -> DataFrame:
    """Rows of a bin width whose bin starts in [begin, end], both included; further columns by equality. 0 or None: any.

    A time bound asks for a bin width.
    """
    if (begin or end) and not bin_width:
        raise ValueError("a time bound needs a bin width")
    out = hist
    if bin_width:
        out = out.where(F.col("bin_width") == bin_width)
    if begin:
        out = out.where(F.col("epoch") >= begin)
    if end:
        out = out.where(F.col("epoch") <= end)
    for name, value in equal.items():
        if value:
            out = out.where(F.col(name) == value)
    return out


def message_count(ptn_hist: DataFrame, ptns: DataFrame, ptn: str | None = None, begin: int | None = None, end: int | None = None) -> DataFrame:
    """One row msg_count: messages of a pattern (None: all) in a range, from the tables instead of the messages.

    Without times a pattern's own count answers. Else bins of an hour, of a minute for ranges of up to an hour;
    the range's start is rounded down and its end up, which is excluded.
    """
    if ptn is not None and not begin and not end:
        return ptns.where(F.col("ptn") == ptn).agg(F.coalesce(F.sum("msg_count"), F.lit(0)).cast("long").alias("msg_count"))
    rows = ptn_hist.where(F.col("ptn").isNull() if ptn is None else F.col("ptn") == ptn)
    minutes = rows.where("bin_width = 60").agg(F.min("epoch").alias("low"), F.max("epoch").alias("high"))
    span = minutes.select(F.coalesce(F.lit(begin or None).cast("long"), "low").alias("low"), F.coalesce(F.lit(end or None).cast("long"), "high").alias("high"))
    width = F.when(F.col("high") - F.col("low") > 3600, 3600).otherwise(60)
    span = span.select(width.alias("width"), (F.floor(F.col("low") / width) * width).alias("low"), (F.ceil(F.col("high") / width) * width).alias("high"))
    found = rows.crossJoin(F.broadcast(span)).where("bin_width = width and epoch >= low and epoch < high")
    return found.agg(F.coalesce(F.sum("msg_count"), F.lit(0)).cast("long").alias("msg_count"))


def series(hist: DataFrame, by: list[str], count: str) -> DataFrame:
    """Per key the number of bins, and their starts and counts as arrays in time order."""
    pairs = F.array_sort(F.collect_list(F.struct("epoch", count)))
    return hist.groupBy(*by).agg(F.count("*").alias("n"), pairs.alias("p")).select(*by, "n", F.col("p.epoch").alias("x"), F.col(f"p.{count}").alias("y"))


def duration(hist: DataFrame) -> DataFrame:
    """One row: seconds from the first to the last bin's start."""
    return hist.agg((F.max("epoch") - F.min("epoch")).alias("seconds"))


def component_distribution(comp_hist: DataFrame, ptn: str, bin_width: int = 3600, begin: int | None = None, end: int | None = None) -> DataFrame:
    """``host, msg_count, share`` of a pattern."""
    rows = hist_filter(comp_hist, bin_width, begin, end, ptn=ptn).groupBy("host").agg(F.sum("msg_count").alias("msg_count"))
    total = rows.agg(F.sum("msg_count").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("host", "msg_count", (F.col("msg_count") / F.col("total")).alias("share"))
