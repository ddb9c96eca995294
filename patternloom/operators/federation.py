"""Several stores read as one.

Ids differ from store to store, so tables meet by token text and pattern text. Counts add up,
masks are OR-ed, first times are least and last times greatest; partial aggregation does the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def tokens(tables: list[DataFrame]) -> DataFrame:
    return union(tables).groupBy("tkn_text").agg(F.bit_or("type_mask").alias("type_mask"), F.sum("tkn_count").alias("tkn_count"))


def patterns(tables: list[DataFrame]) -> DataFrame:
    return union(tables).groupBy("ptn").agg(F.max("tkn_count").alias("tkn_count"), F.sum("msg_count").alias("msg_count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def hist(tables: list[DataFrame], count: str) -> DataFrame:
    rows = union(tables)
    return rows.groupBy(*(c for c in rows.columns if c != count)).agg(F.sum(count).alias(count))


def messages(tables: list[DataFrame]) -> DataFrame:
    """All messages with the number of their store; order by epoch_us, host, store to merge the streams."""
    return union([t.withColumn("store", F.lit(i)) for i, t in enumerate(tables)])


def id_map(store_tokens: DataFrame, all_tokens: DataFrame, name: str = "tkn_id", text: str = "tkn_text") -> DataFrame:
    """``local_id, tkn_id`` of one store against the union."""
    return store_tokens.select(F.col(name).alias("local_id"), text).join(all_tokens.select(name, text), text).select("local_id", name)
