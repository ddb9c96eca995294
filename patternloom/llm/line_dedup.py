"""Operator 2: lines that a large share of a host's pages carry are boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, settled

#: Up to so many boilerplate lines in all (16 bytes each) go to every task; more are joined by host.
BROADCAST_LINES = 200_000
#: White space that does not tell lines apart at their ends.
EDGES = " \t\r"


def _key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    trimmed = F.btrim(line, F.lit(EDGES))
    return F.struct(F.xxhash64(trimmed).alias("x"), F.xxhash64(F.lit("#"), trimmed).alias("y"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``host, dropped``: the keys of the lines on more than ``ratio`` of a host's pages and on ``min_pages`` at least.

    A host has at most (its lines a page / ratio) such lines, so a row is small whatever the host's size.
    """
    pages = docs.select(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("pages"))
    filled = F.filter(_lines(F.col("text")), lambda line: F.btrim(line, F.lit(EDGES)) != "")
    each = pages.select("host", F.explode(F.array_distinct(F.transform(filled, _key))).alias("line"))
    counts = each.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(totals, "host").where(F.col("n") > F.lit(float(ratio)) * F.col("pages")).groupBy("host").agg(F.collect_list("line").alias("dropped"))


def line_dedup(docs: DataFrame, host: str = "source", ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``docs`` with its boilerplate lines removed from ``text``, and n_lines, n_dropped added.

    Lines are compared without white space at their ends, told apart by 128-bit hashes; blank lines
    always stay. A page counts once for a line however often it repeats it. A null host counts as the
    empty host; a null text stays null with 0 lines; an empty text is one blank line. Repeated rows are
    pages of their own. Other columns pass through unchanged, but n_lines and n_dropped take the place of columns of those names.
    """
    found = settled(boilerplate(docs, host, ratio, min_pages))
    size = found.agg(F.coalesce(F.sum(F.size("dropped")), F.lit(0))).first()[0]
    at, dropped, kept = (free_name(docs.columns, name) for name in ("host_", "dropped_", "kept_"))
    small = found.select(F.col("host").alias(at), F.col("dropped").alias(dropped))
    rows = docs.withColumn(at, F.coalesce(F.col(host).cast("string"), F.lit("")))
    rows = rows.join(F.broadcast(small) if size <= BROADCAST_LINES else small, at, "left")
    lines = _lines(F.col("text").cast("string"))
    rest = F.filter(lines, lambda line: ~F.array_contains(F.col(dropped), _key(line)))
    rows = rows.withColumn(kept, F.when(F.col(dropped).isNull(), lines).otherwise(rest))
    count = lambda a: F.coalesce(F.when(F.col("text").isNotNull(), F.size(a)), F.lit(0)).cast("long")
    others = [F.array_join(kept, "\n").alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return rows.select(*others, count(lines).alias("n_lines"), (count(lines) - count(F.col(kept))).alias("n_dropped"))


def sql(columns: str, ratio: float = 0.1, min_pages: int = 3, documents: str = "documents") -> str:
    """The same over ``documents`` with host ``source``, as DuckDB SQL that selects ``columns``."""
    return f"""
WITH numbered AS (SELECT *, row_number() OVER () AS line_dedup_nr FROM {documents}),
pages AS (SELECT line_dedup_nr AS nr, coalesce(source, '') AS site, text AS body FROM numbered),
lines AS (SELECT nr, site, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS pos FROM pages WHERE body IS NOT NULL),
keyed AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS k FROM lines),
counts AS (SELECT site, k, count(DISTINCT nr) AS n FROM keyed WHERE k <> '' GROUP BY site, k),
totals AS (SELECT site, count(*) AS total FROM pages GROUP BY site),
bad AS (SELECT site, k FROM counts JOIN totals USING (site) WHERE n >= {min_pages} AND n > {ratio}::DOUBLE * total),
kept AS (SELECT nr, count(*) AS n_lines, count(*) FILTER (WHERE bad.k IS NOT NULL) AS n_dropped,
  coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bad.k IS NULL), '') AS new_text
  FROM keyed LEFT JOIN bad ON keyed.site = bad.site AND keyed.k = bad.k GROUP BY nr),
clean AS (SELECT numbered.* EXCLUDE (text, line_dedup_nr), kept.new_text AS text, coalesce(kept.n_lines, 0) AS n_lines, coalesce(kept.n_dropped, 0) AS n_dropped
  FROM numbered LEFT JOIN kept ON numbered.line_dedup_nr = kept.nr)
SELECT {columns} FROM clean"""
