"""From messages to tokens, patterns and wildcard tables.

A message is ``epoch_us, host, body``. Its elements are the host and the simple tokens of the body.
Everything here is one pass of expressions and partial aggregates; ids are given out on distinct
tokens and patterns only.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import types as T
from ..functions import lexer
from ..functions import text as X
from .settling import settled


def numbered(rows: DataFrame, order: list[str], start: int, name: str) -> DataFrame:
    """``rows`` with dense numbers from ``start`` in the order of the given columns, which tell rows apart.

    Rows are dealt by range, kept in the shared checkpoint folder, so that a lost executor renumbers none, and numbered
    within; only the sizes of the ranges reach the driver.
    """
    ranged = settled(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["count"] for r in ranged.groupBy("_part").count().collect()}
    offsets, total = [], start
    for part in sorted(sizes):
        offsets.append((part, total))
        total += sizes[part]
    table = rows.sparkSession.createDataFrame(offsets, "_part int, _offset long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_place", place).join(F.broadcast(table), "_part").withColumn(name, F.col("_offset") + F.col("_place")).drop("_part", "_place", "_offset")


def running(rows: DataFrame, order: list[str], weight: str, keys: list[str] | None = None) -> DataFrame:
    """``rows`` with end, the sum of ``weight`` up to and with a row in the given order, and n, the sum of all.

    With ``keys`` both are sums within a group, null keys being one. Rows are dealt by range of keys and order, so a
    large group is spread over ranges; only the ranges' sums are added up in one place.
    """
    keys = keys or []
    ranged = settled(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy(*keys, "_part").agg(F.sum(weight).alias("_weight"))
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = F.sum("_weight").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_weight")
    parts = parts.select(*keys, "_part", before.alias("_offset"), F.sum("_weight").over(group).alias("n"))
    within = F.sum(weight).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = joined_by(ranged.withColumn("_sum", within), parts, [*keys, "_part"])
    return joined.withColumn("end", F.col("_offset") + F.col("_sum")).drop("_part", "_sum", "_offset")


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``, joined by ``keys`` of which nulls are equal."""
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(other, same, how).drop(*(f"_right_{k}" for k in keys))


def elements(messages: DataFrame, grammar: str | None = None) -> DataFrame:
    """``messages`` with argv, an array of (pos, text, parsed): the host, a space, and the tokens of the body.

    They are the simple tokens or, with a grammar of the lexer, its typed ones.
    """
    if grammar is None:
        parsed = F.transform(X.simple_tokens(F.col("body")), lambda t, i: F.struct((i + 2).cast("int").alias("pos"), t.alias("text"), X.parsed_type(t).cast("int").alias("parsed")))
    else:
        messages = messages.withColumn("_lexed", lexer.tokens(F.col("body"), grammar))
        parsed = F.transform("_lexed", lambda t, i: F.struct((i + 2).cast("int").alias("pos"), t["text"].alias("text"), t["type"].alias("parsed")))
    head = F.array(F.struct(F.lit(0).alias("pos"), F.col("host").alias("text"), F.lit(T.HOSTNAME).alias("parsed")), F.struct(F.lit(1).alias("pos"), F.lit(" ").alias("text"), F.lit(T.WHITESPACE).alias("parsed")))
    return messages.withColumn("argv", F.concat(head, parsed)).drop("_lexed")


def token_dictionary(messages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``tkn_text, type_mask, tkn_count``: every token with the types it has had and how often it occurs.

    ``known(tkn_text, type_mask)`` are dictionary entries; their types are added, tokens that occur nowhere have
    a count of 0. A token known as word or host name is not text any more.
    """
    seen = elements(messages).select(F.explode("argv").alias("e")).groupBy(F.col("e.text").alias("tkn_text")).agg(F.bit_or(F.expr("shiftleft(1L, e.parsed - 1)")).alias("type_mask"), F.count("*").alias("tkn_count"))
    if known is not None:
        seen = seen.unionByName(known.select("tkn_text", F.col("type_mask").cast("long"), F.lit(0).cast("long").alias("tkn_count")))
        seen = seen.groupBy("tkn_text").agg(F.bit_or("type_mask").alias("type_mask"), F.sum("tkn_count").alias("tkn_count"))
    fixed = X.has_mask(F.col("type_mask"), "WORD,HOSTNAME")
    return seen.withColumn("type_mask", F.when(fixed, F.col("type_mask").bitwiseAND(F.lit(~T.mask("TEXT")))).otherwise(F.col("type_mask")))


def with_token_ids(dictionary: DataFrame) -> DataFrame:
    """The dictionary with tkn_id: hosts from 256, all other tokens from 2,000,001 or after the last host, by text."""
    host = X.has_mask(F.col("type_mask"), "HOSTNAME")
    hosts = numbered(dictionary.where(host), ["tkn_text"], T.FIRST_HOST_ID, "tkn_id")
    last = hosts.agg(F.max("tkn_id")).first()[0] or 0
    return hosts.unionByName(numbered(dictionary.where(~host), ["tkn_text"], max(T.FIRST_TOKEN_ID, last + 1), "tkn_id"))


def typed(messages: DataFrame, words: Iterable[str] | None = None, dictionary: DataFrame | None = None, grammar: str | None = None) -> DataFrame:
    """``messages`` with argv of (pos, text, type) and the pattern's text ``ptn``; ``grammar`` as in ``elements``.

    ``words`` is a word list that is part of the query and needs no shuffle; ``dictionary`` (tkn_text, type_mask)
    of any size is joined by token instead, element by element; adaptive skew joins split the rows of common tokens.
    """
    rows = elements(messages, grammar)
    if dictionary is None:
        known = [*(words or [])]
        kind = lambda e: F.when(e["parsed"] == T.HOSTNAME, T.HOSTNAME).when(e["text"].isin(known), T.WORD).otherwise(e["parsed"])
        argv = F.transform("argv", lambda e: F.struct(e["pos"].alias("pos"), e["text"].alias("text"), kind(e).cast("int").alias("type")))
        rows = rows.withColumn("argv", argv)
    else:
        keyed = rows.withColumn("_id", F.struct(F.xxhash64("epoch_us", "host", "body"), F.monotonically_increasing_id()))
        flat = keyed.select(*messages.columns, "_id", F.explode("argv").alias("e"))
        flat = flat.join(dictionary.select("tkn_text", "type_mask"), F.col("e.text") == F.col("tkn_text"), "left")
        one = F.struct(F.col("e.pos").alias("pos"), F.col("e.text").alias("text"), X.resolved_type(F.col("type_mask"), F.col("e.parsed")).cast("int").alias("type"))
        rows = flat.groupBy("_id", *messages.columns).agg(F.array_sort(F.collect_list(one)).alias("argv")).drop("_id")
    return rows.withColumn("ptn", F.array_join(F.transform("argv", lambda e: X.rendered(e["text"], e["type"])), ""))


def patterns(typed_messages: DataFrame) -> DataFrame:
    """``ptn, tkn_count, msg_count, first_seen, last_seen`` (microseconds)."""
    return typed_messages.groupBy("ptn").agg(F.max(F.size("argv")).cast("long").alias("tkn_count"), F.count("*").alias("msg_count"), F.min("epoch_us").alias("first_seen"), F.max("epoch_us").alias("last_seen"))


def with_pattern_ids(ptns: DataFrame, start: int = T.FIRST_PATTERN_ID) -> DataFrame:
    """Patterns with ptn_id from 256, by first_seen and text."""
    return numbered(ptns, ["first_seen", "ptn"], start, "ptn_id")


def pattern_tokens(typed_messages: DataFrame) -> DataFrame:
    """``ptn, pos, tkn_text, tkn_count``: what filled each wildcard position of each pattern."""
    flat = typed_messages.select("ptn", F.explode("argv").alias("e")).where(~F.col("e.type").isin(*T.FIXED))
    return flat.groupBy("ptn", F.col("e.pos").alias("pos"), F.col("e.text").alias("tkn_text")).agg(F.count("*").alias("tkn_count"))


def position_tokens(typed_messages: DataFrame) -> DataFrame:
    """As ``pattern_tokens`` with the fixed positions too: one token each, with the pattern's count."""
    flat = typed_messages.select("ptn", F.explode("argv").alias("e"))
    return flat.groupBy("ptn", F.col("e.pos").alias("pos"), F.col("e.text").alias("tkn_text")).agg(F.count("*").alias("tkn_count"))


def patterns_with_token(typed_messages: DataFrame, token: str) -> DataFrame:
    """``ptn, msg_count, match_pos``: patterns that a token occurs in, at a fixed place or among the wildcard's fillers."""
    at = position_tokens(typed_messages).where(F.col("tkn_text") == token).groupBy("ptn").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_set("pos")), lambda p: p.cast("string"))).alias("match_pos"))
    return patterns(typed_messages).join(at, "ptn").select("ptn", "msg_count", "match_pos")


def retyped(messages: DataFrame, old_words: Iterable[str], new_words: Iterable[str]) -> DataFrame:
    """``old_ptn, new_ptn, msg_count`` of the messages whose pattern a change of the word list moves."""
    tokens = elements(messages)
    kind = lambda known: F.array_join(F.transform("argv", lambda e: F.when(e["parsed"] == T.HOSTNAME, "<host>").when(e["text"].isin([*known]), e["text"]).otherwise(X.rendered(e["text"], e["parsed"]))), "")
    both = tokens.select(kind(old_words).alias("old_ptn"), kind(new_words).alias("new_ptn")).where("old_ptn <> new_ptn")
    return both.groupBy("old_ptn", "new_ptn").agg(F.count("*").alias("msg_count"))


def english_ratio(ptn: Column) -> Column:
    """Share of a pattern's elements that are words: those neither wildcard nor mark nor space."""
    parts = F.regexp_extract_all(ptn, F.lit(r"(<[a-z0-9]+>|\w+|.)"), F.lit(1))
    return F.size(F.filter(parts, lambda t: t.rlike(r"^\w+$"))) / F.size(parts)


def order_of(name: str) -> list[Column]:
    """Sort columns by name: a field, with ``_asc`` or ``_desc`` (``eng`` is short for ``eng_ratio``); the pattern's text breaks ties."""
    field, _, way = name.rpartition("_") if name.endswith(("_asc", "_desc")) else (name, "", "")
    field = {"eng": "eng_ratio"}.get(field.lower(), field.lower())
    if field not in ("ptn_id", "first_seen", "last_seen", "tkn_count", "msg_count", "eng_ratio"):
        raise ValueError(f"unknown pattern order: {name}")
    column = F.col(field)
    falling = way == "desc" or (not way and field == "eng_ratio")
    return [column.desc() if falling else column.asc(), F.col("ptn").asc()]
