"""Filters, seeks, limits and summaries over messages and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def message_filter(messages: DataFrame, ptn: str | None = None, host: str | None = None, begin_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Messages of a pattern, of a host, in [begin, end]; None or 0: any. A bound below one second is none."""
    out = messages
    if ptn is not None:
        out = out.where(F.col("ptn") == ptn)
    if host is not None:
        out = out.where(F.col("host") == host)
    if begin_us and begin_us >= 1_000_000:
        out = out.where(F.col("epoch_us") >= begin_us)
    if end_us and end_us >= 1_000_000:
        out = out.where(F.col("epoch_us") <= end_us)
    return out


def message_order(ptn: str | None = None, host: str | None = None) -> list[str]:
    """By time and host; of one pattern or host only: by time first too, then the rest."""
    return ["ptn", "epoch_us", "host"] if ptn is not None else ["host", "epoch_us", "ptn"] if host is not None else ["epoch_us", "host", "ptn"]


def seek(rows: DataFrame, key: dict, forward: bool = True, order: list[str] | None = None) -> DataFrame:
    """The first row at or after a key, or the last at or before it; keys compare field by field."""
    fields = order or [*key]
    here, wanted = F.struct(*fields), F.struct(*(F.lit(key[f]).alias(f) for f in fields))
    found = rows.where(here >= wanted if forward else here <= wanted)
    return found.orderBy(*(F.col(f).asc() if forward else F.col(f).desc() for f in rows_order(rows, fields))).limit(1)


def rows_order(rows: DataFrame, fields: list[str]) -> list[str]:
    """The key's fields, then all others, so that ties are settled."""
    return fields + [c for c, kind in rows.dtypes if c not in fields and not kind.startswith(("array", "map", "struct"))]


def page(rows: DataFrame, order: list[str], size: int, after: dict | None = None) -> DataFrame:
    """The next ``size`` rows after the key of the last one seen."""
    if after is not None:
        rows = rows.where(F.struct(*order) > F.struct(*(F.lit(after[f]).alias(f) for f in order)))
    return rows.orderBy(*order).limit(size)


def page_up(rows: DataFrame, order: list[str], size: int, before: dict) -> DataFrame:
    """The ``size`` rows that come last before the key of the first one seen, in ascending order."""
    rows = rows.where(F.struct(*order) < F.struct(*(F.lit(before[f]).alias(f) for f in order)))
    return rows.orderBy(*(F.col(f).desc() for f in order)).limit(size).orderBy(*order)


def limited(messages: DataFrame, n: int, order: list[str] | None = None) -> DataFrame:
    """The first ``n`` messages by time, host and text."""
    return messages.orderBy(*(order or ["epoch_us", "host", "body"])).limit(n)


def pattern_filter(ptns: DataFrame, begin_us: int | None = None, end_us: int | None = None, regex: str | None = None, ids: str | None = None) -> DataFrame:
    """Patterns first seen in [begin, end], whose text matches from its start, whose ptn_id is in an id set."""
    out = ptns
    if begin_us:
        out = out.where(F.col("first_seen") >= begin_us)
    if end_us:
        out = out.where(F.col("first_seen") <= end_us)
    if regex:
        out = out.where(F.col("ptn").rlike(f"^(?:{regex})"))
    if ids:
        out = out.where(X.in_id_set(F.col("ptn_id"), ids))
    return out


def token_filter(tokens: DataFrame, types: str) -> DataFrame:
    return tokens.where(X.has_mask(F.col("type_mask"), types))


def component_query(tokens: DataFrame, regex: str | None = None, ids: str | None = None) -> DataFrame:
    """Tokens whose first type is host name, by expression (from the start) and id set."""
    out = tokens.where(X.first_type(F.col("type_mask")) == 5)
    if regex:
        out = out.where(F.col("tkn_text").rlike(f"^(?:{regex})"))
    if ids:
        out = out.where(X.in_id_set(F.col("tkn_id"), ids))
    return out


def component_range(tokens: DataFrame) -> DataFrame:
    """One row: the least and the largest host id."""
    return tokens.where(X.has_mask(F.col("type_mask"), "HOSTNAME")).agg(F.min("tkn_id").alias("comp_id_min"), F.max("tkn_id").alias("comp_id_max"))


def summary(ptns: DataFrame) -> DataFrame:
    """One row: patterns, messages, whole messages a pattern (null without any), first and last message."""
    totals = ptns.agg(F.count("*").alias("ptn_count"), F.coalesce(F.sum("msg_count"), F.lit(0)).cast("long").alias("msg_count"), F.min("first_seen").alias("first_us"), F.max("last_seen").alias("last_us"))
    per = F.when(F.col("ptn_count") > 0, F.floor(F.col("msg_count") / F.col("ptn_count")))
    return totals.withColumn("msg_per_ptn", per.cast("long"))


def filtered_summary(comp_hist: DataFrame) -> DataFrame:
    """The same from hourly component counts that a filter has left: distinct patterns, messages, first and last bin."""
    hours = comp_hist.where("bin_width = 3600")
    return hours.agg(F.countDistinct("ptn").alias("ptn_count"), F.coalesce(F.sum("msg_count"), F.lit(0)).cast("long").alias("msg_count"), F.min("epoch").alias("first_epoch"), F.max("epoch").alias("last_epoch"))
