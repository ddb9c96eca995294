"""Operator 3: document fingerprints, in DataFrame functions only.

A fingerprint is the bottom-k sketch of a text's word shingles: the k least of their distinct
64-bit hashes. Sketches of parts merge to the sketch of the whole; they estimate resemblance,
containment and the number of distinct shingles, and are exact for texts of fewer than k shingles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settled

K, WORDS = 128, 5


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda would compute an expression again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k least distinct hashes, rising; a text of fewer words is one shingle, one without words has an empty sketch."""
    hashed = F.transform(F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        return F.when(F.size(h) >= words, F.transform(F.sequence(F.lit(0), F.size(h) - words), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(words))))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.slice(F.sort_array(F.array_distinct(let(hashed, shingles))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty ones, 0 if one is empty."""
    return let(merged(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact below k."""
    share = (F.get(a, F.lit(k - 1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too; 1 for an empty a."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_string(a: Column) -> Column:
    """Hexadecimal, 16 digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def successors(ids: DataFrame) -> DataFrame:
    """``ids(doc_id, n)``, distinct and not null, with next_id: the next larger id, after the last the first.

    Ids are dealt by range; within a range a window finds the successor, and one row per range,
    as many as there are partitions, tells where the next one begins.
    """
    ranged = settled(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy("doc_id")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()
    follow = {a["part"]: b["first"] for a, b in zip(firsts, firsts[1:] + firsts[:1], strict=True)}
    after = ids.sparkSession.createDataFrame(list(follow.items()), "part int, follow long")
    near = ranged.withColumn("next_id", F.lead("doc_id").over(order))
    return near.join(F.broadcast(after), "part").select("doc_id", "n", F.coalesce("next_id", "follow").alias("next_id"))


def fingerprint_documents(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document's, by rising doc_id, after the last the first. A null text counts as empty. Rows that repeat a doc_id
    each get a row, and the largest text stands for that id as the next one; a row without
    doc_id has no next document: it is edited by an empty text. An empty table gives no rows.
    """
    # no alias on an id that is a long already: one side of the self-join would keep it, and their shuffles differ
    doc_id = F.col("doc_id") if docs.schema["doc_id"].dataType.simpleString() == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    texts = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = texts.where("doc_id is not null").select("doc_id", F.length("text").alias("n")).groupBy("doc_id").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    ids = settled(ids)
    repeats = ids.where("rows > 1").limit(1).count() > 0
    asked = successors(ids.select("doc_id", "n")).select(F.col("next_id").alias("doc_id"), F.col("doc_id").alias("owner"), F.floor(F.col("n") / 4).cast("int").alias("take"))
    # both joins deal the texts by doc_id alike, so they are shuffled once
    given = texts.where("doc_id is not null").join(asked, "doc_id")
    if repeats:
        given = given.groupBy("owner", "take").agg(F.max("text").alias("text"))
    given = given.select("owner", F.expr("substring(text, 1, take)").alias("prefix"), sketch(F.col("text"), k, words).alias("next_sketch"))
    # null ids apart: the two joins then read the same rows, and their shuffle is one
    named = texts.where("doc_id is not null")
    rows = named.join(given, named["doc_id"] == given["owner"], "left").select("doc_id", "text", "prefix", "next_sketch")
    rows = rows.unionByName(texts.where("doc_id is null").select("doc_id", "text", F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("array<bigint>").alias("next_sketch")))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, int(n_chars - floor(n_chars / 4)))"), F.coalesce(F.expr("substring(prefix, 1, int(floor(n_chars / 4)))"), F.lit(""))))
    rows = rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), sketch(F.col("text"), k, words).alias("a"), sketch(F.col("edited"), k, words).alias("b"), F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("c"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_string(F.col("a")).alias("fingerprint"), as_string(F.col("b")).alias("edited_fingerprint"), resemblance(F.col("a"), F.col("b"), k).alias("near_edited"), resemblance(F.col("a"), F.col("c"), k).alias("near_next"))
