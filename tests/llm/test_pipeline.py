import itertools
import re

import corpus_pipeline
from patternloom.llm import queries
from patternloom.llm.common import table

DATA = "/root/testdata/sf0.001"


def five(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    good = corpus_pipeline.keep_good(spark, docs, DATA)
    kept = {r["doc_id"] for r in good.collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DATA, "labels").collect()}
    assert good.columns == docs.columns and sum((i in kept) == (q == 1) for i, q in labels.items()) >= 0.95 * len(labels)

    clean = corpus_pipeline.drop_boilerplate(spark, good, DATA)
    assert clean.columns == docs.columns and clean.where("n_chars <> length(text)").count() == 0 and {r["doc_id"] for r in clean.collect()} == kept

    one = corpus_pipeline.one_of_each(spark, clean, DATA)
    texts = {r["doc_id"]: five(r["text"]) for r in clean.collect()}
    links = [(a, b) for a, b in itertools.combinations(sorted(texts), 2) if texts[a] and len(texts[a] & texts[b]) * 100 >= 80 * len(texts[a] | texts[b])]
    label = {i: i for i in texts}
    for _ in range(20):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    left = {r["doc_id"] for r in one.collect()}
    assert one.columns == docs.columns and left == {i for i in texts if label[i] == i} and links

    packed = corpus_pipeline.packed(spark, one, DATA)
    assert {r["doc_id"] for r in packed.collect()} == left


def test_run_is_its_stages(spark):
    assert len(corpus_pipeline.STAGES) == 4 and corpus_pipeline.run(spark, DATA).count() > 100
    assert len(queries.queries()) == 10


def test_queries_are_registered():
    import __spark_entry__

    known = __spark_entry__.queries()
    assert {*queries.queries(), "pipeline"} <= known.keys() and {"op2_line_dedup", "op5_url_filters"} <= __spark_entry__.oracle_sql().keys()


def test_stages_on_odd_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long, uid long, quality_score string, n_lines int, host string"
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, long, "en", "s", 9, 1, "a", 1, "h"), (1, long, "en", "s", 9, 1, "a", 1, "h"), (1, "another text under one id", "en", "s", 9, 2, "b", 2, "h"), (None, long + " x", "en", None, 9, 3, "c", 3, None), (None, None, None, None, None, None, None, None, None), (4, "", "de", "s", 0, 4, "d", 4, "h"), (4, "", "de", "s", 0, 4, "d", 4, "h"), (5, "x " * 40000, "de", "s", 0, 4, "d", 4, "h")]
    docs = spark.createDataFrame(rows, kind)
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        empty = stage(spark, docs.limit(0), DATA)
        assert empty.count() == 0 and (number == 3 or empty.columns == docs.columns)
    clean = corpus_pipeline.drop_boilerplate(spark, docs, DATA)
    assert clean.columns == docs.columns and clean.count() == len(rows) and {r["host"] for r in clean.collect()} == {"h", None}
    assert corpus_pipeline.keep_good(spark, docs, DATA).columns == docs.columns
    one = corpus_pipeline.one_of_each(spark, docs, DATA)
    left = sorted(((r["doc_id"], (r["text"] or "")[:9], r["uid"]) for r in one.collect()), key=str)
    assert one.columns == docs.columns and left == sorted([(1, long[:9], 1), (1, "another t", 2), (None, "", None), (4, "", 4), (4, "", 4), (5, "x x x x x", 4)], key=str)
    assert corpus_pipeline.packed(spark, docs, DATA).count() == len(rows) + 40001 // 4096
