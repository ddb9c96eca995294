"""Tags of patterns: ``tags(ptn_id, attr_type, attr_value)`` and their types ``attr_types(attr_type)``.

Every operation returns the new table; tables change by being written anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["ptn_id", "attr_type", "attr_value"]


class Exists(ValueError):
    """What is to be added is there already."""


class Missing(ValueError):
    """What is asked for isn't there."""


def _one(tags: DataFrame, ptn_id: int, attr_type: str, value: str) -> DataFrame:
    return tags.sparkSession.createDataFrame([(ptn_id, attr_type, value)], "ptn_id long, attr_type string, attr_value string")


def new_type(types: DataFrame, name: str) -> DataFrame:
    if len(name) >= 512:
        raise ValueError("an attribute name has fewer than 512 characters")
    if find_type(types, name):
        raise Exists(name)
    return types.unionByName(types.sparkSession.createDataFrame([(name,)], "attr_type string"))


def find_type(types: DataFrame, name: str) -> bool:
    return not types.where(F.col("attr_type") == name).isEmpty()


def has_value(tags: DataFrame, ptn_id: int, attr_type: str, value: str) -> bool:
    return not tags.where((F.col("ptn_id") == ptn_id) & (F.col("attr_type") == attr_type) & (F.col("attr_value") == value)).isEmpty()


def add(tags: DataFrame, more: DataFrame) -> DataFrame:
    """``tags`` with the rows of ``more`` that aren't there yet."""
    return tags.unionByName(more.select(*KEY).distinct().join(tags, KEY, "left_anti"))


def add_value(tags: DataFrame, types: DataFrame, ptn_id: int, attr_type: str, value: str) -> DataFrame:
    """One more value; its type has to exist and the value not."""
    if not find_type(types, attr_type):
        raise Missing(attr_type)
    if has_value(tags, ptn_id, attr_type, value):
        raise Exists(f"{ptn_id} {attr_type}={value}")
    return tags.unionByName(_one(tags, ptn_id, attr_type, value))


def remove(tags: DataFrame, gone: DataFrame) -> DataFrame:
    return tags.join(gone.select(*KEY).distinct(), KEY, "left_anti")


def remove_value(tags: DataFrame, ptn_id: int, attr_type: str, value: str) -> DataFrame:
    if not has_value(tags, ptn_id, attr_type, value):
        raise Missing(f"{ptn_id} {attr_type}={value}")
    return remove(tags, _one(tags, ptn_id, attr_type, value))


def unset(tags: DataFrame, ptn_id: int, attr_type: str) -> DataFrame:
    """Without any value of a type at a pattern."""
    return tags.where(~((F.col("ptn_id") == ptn_id) & (F.col("attr_type") == attr_type)))


def set_values(tags: DataFrame, new: DataFrame) -> DataFrame:
    """``tags`` where the rows of ``new`` replace all values of their type at their pattern."""
    rest = tags.join(new.select("ptn_id", "attr_type").distinct(), ["ptn_id", "attr_type"], "left_anti")
    return rest.select(*KEY).unionByName(new.select(*KEY).distinct())


def get(tags: DataFrame) -> DataFrame:
    """``ptn_id, attr_type, attr_value``: the first value by its order."""
    return tags.groupBy("ptn_id", "attr_type").agg(F.min("attr_value").alias("attr_value"))


def tag_filter(tags: DataFrame, ptn_id: int | None = None, attr_type: str | None = None, attr_value: str | None = None) -> DataFrame:
    if attr_value is not None and attr_type is None:
        raise ValueError("a value needs its type")
    for name, value in (("ptn_id", ptn_id), ("attr_type", attr_type), ("attr_value", attr_value)):
        if value is not None:
            tags = tags.where(F.col(name) == value)
    return tags


def values_of(tags: DataFrame, attr_type: str) -> DataFrame:
    return tags.where(F.col("attr_type") == attr_type).select("attr_value").distinct()


def listed(tags: DataFrame) -> DataFrame:
    """``ptn_id, attrs``: all ``type=value`` of a pattern in order, joined by commas."""
    pair = F.concat_ws("=", "attr_type", "attr_value")
    return tags.groupBy("ptn_id").agg(F.array_join(F.array_sort(F.collect_set(pair)), ",").alias("attrs"))


def patterns_tagged(ptns: DataFrame, tags: DataFrame, attr_type: str, attr_value: str | None = None) -> DataFrame:
    return ptns.join(tag_filter(tags, None, attr_type, attr_value), "ptn_id", "left_semi")


def tag_ids(tags: DataFrame, ranges: list[tuple[int, int]], attr_type: str, value: str) -> DataFrame:
    """Rows that tag every id of some ranges."""
    spans = tags.sparkSession.createDataFrame(ranges, "low long, high long")
    return spans.select(F.explode(F.sequence("low", "high")).alias("ptn_id"), F.lit(attr_type).alias("attr_type"), F.lit(value).alias("attr_value"))
