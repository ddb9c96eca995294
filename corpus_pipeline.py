"""A corpus pipeline over ``documents``: quality, boilerplate lines, near duplicates, packing.

Each stage takes what its predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm import line_dedup, ngram_join, packing, quality
from patternloom.llm.common import settled, table

#: A document whose calibrated quality is below this is rejected.
LEAST_QUALITY = 0.5
#: Near duplicates share this part of their five-word shingles.
WORDS, SIMILARITY = 5, 0.8


def _share_code(spark: SparkSession) -> None:
    env, here = spark.sparkContext.environment, os.path.dirname(os.path.abspath(__file__))
    if here not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [here, env.get("PYTHONPATH", "")]))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of this stage's own input, doesn't reject.

    Null and empty texts are scored as empty ones; repeated rows are judged alike; without labels all scores are 0.5 and all rows
    stay; an empty table stays empty. All columns, also ones named as the score, come back.
    """
    _share_code(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that their source repeats; n_chars follows the text.

    A null text stays null with a null n_chars; a null source is a source; repeated rows are pages of their own; all
    rows and columns come back, columns that have the names of the operator's counts included.
    """
    _share_code(spark)
    clean = line_dedup.line_dedup(docs.select("source", "text", F.struct(*docs.columns).alias("row")), host="source")
    of = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)}
    return clean.select(*(of.get(c, F.col("row")[c]).alias(c) for c in docs.columns))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least doc_id, of each group of near duplicates.

    Rows are told apart as rows, not by doc_id: of repeated rows one stays, rows that differ under one doc_id are
    judged each. Null and blank texts have no duplicates and stay.
    """
    _share_code(spark)
    return ngram_join.one_of_each(docs, n=WORDS, threshold=SIMILARITY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, with their places in training sequences.

    A null or empty text is the end id alone, a null doc_id stays null, repeated rows are packed each; no documents, no pieces.
    """
    _share_code(spark)
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", keep_good), ("line dedup", drop_boilerplate), ("n-gram Jaccard join", one_of_each), ("best-fit packing", packed)]
#: The classifier and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages rows are kept in the shared checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = settled(docs)
    return docs
