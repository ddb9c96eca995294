import itertools
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from patternloom.llm import embedding_dedup, fingerprints, line_dedup, ngram_join
from patternloom.llm import components as components_module
from patternloom.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def component_of(ids, links):
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def corpus():
    r = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(n)] for n in (6, 12, 40, 90, 200, 400)]
    texts = []
    for b in base:
        for _ in range(12):
            t = list(b)
            for _ in range(r.randrange(0, max(2, len(b) // 18))):
                t[r.randrange(len(t))] = r.choice(words)
            texts.append(" ".join(t))
    # many close copies of one text that are only partly close to each other: compared in blocks
    for _ in range(70):
        t = list(base[4])
        for _ in range(r.choice((1, 2, 4, 5))):
            t[r.randrange(len(t))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(t))
    return texts + ["", None, " \n\t", "one", "ONE", "one two", "One  Two\n", "a b c", "A b\tc", "é É x", "z " * 5000]


@pytest.mark.parametrize(("n", "threshold"), [(3, 0.9), (5, 0.8)])
def test_ngram_join(spark, n, threshold, monkeypatch):
    monkeypatch.setattr(ngram_join, "PAIRED", 20)
    monkeypatch.setattr(ngram_join, "BLOCK", 32)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, set_id int, key string").repartition(3)
    sets = {i: shingles(t, n) for i, t in enumerate(texts)}
    parts = round(threshold * 100)
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= parts * len(sets[a] | sets[b])]
    want = component_of(sets, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs, n, threshold).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}


def test_ngram_join_corner_cases(spark):
    kind = "doc_id long, text string"
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (7, "A b c d"), (None, None)], kind))
    assert sorted(((r[0], r[2]) for r in got.collect()), key=str) == [(5, 5), (5, 5), (7, 5), (None, 5), (None, None)]
    assert ngram_join.ngram_jaccard_join(spark.createDataFrame([], kind)).count() == 0


def test_similar_sets_share_a_prefix_key():
    r = np.random.default_rng(3)
    filters = ngram_join.Order(40, 0, ((r.integers(0, 2**63, 64).astype(np.uint64), np.zeros(1, np.int64), np.full(1, 4096)),), False)
    for percent in (80, 90):
        for _ in range(400):
            m = int(np.exp(r.uniform(np.log(2), np.log(1500))))
            a = np.unique(r.integers(0, 2**63, m).astype(np.uint64) * np.uint64(2))
            k = int(r.integers(0, int(m * 0.2) + 1))
            gone = int(r.integers(0, k + 1))
            b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2**63, k - gone).astype(np.uint64)]))
            same = len(np.intersect1d(a, b))
            if percent <= 100 * same / (len(a) + len(b) - same) < 100:
                keys, counts = ngram_join.prefix_keys(np.concatenate([a, b]), np.array([len(a), len(b)]), filters, percent)
                assert len(np.intersect1d(keys[: counts[0]], keys[counts[0] :]))


def test_global_order_ranks_by_count(spark):
    texts = [f"all docs say this {'some of them that' if i % 8 == 0 else ''} w{i}" for i in range(64)]
    order = ngram_join.global_order(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), 1)
    import pyarrow as pa

    rank = order.rank(ngram_join.shingle_sets(pa.array(["all", "some", "w5"]), 1)[0]).tolist()
    assert order.all_shared and [ngram_join.LEVELS[i - 1] if i else 1 for i in rank] == [64, 8, 1]


def test_word_hashes():
    import pyarrow as pa

    texts = ["", " one\tTwo ", "two", "one", "\n", "é É ab", "ba", "one"]
    hashes, counts = ngram_join.word_hashes(pa.array(["skipped", *texts]).slice(1))
    words = [w for t in texts for w in shingle_words(t)]
    assert counts.tolist() == [len(shingle_words(t)) for t in texts]
    assert len({*zip(words, hashes.tolist(), strict=True)}) == len({*words}) == len({*hashes.tolist()})
    assert ngram_join.shingle_sets(pa.array([], pa.string()), 3)[1].tolist() == []


def shingle_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


@pytest.mark.parametrize("heavy", [512, 2])
def test_components(spark, heavy, monkeypatch):
    monkeypatch.setattr(components_module, "HEAVY", heavy)
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    real = [e for e in edges if None not in e and e[0] != e[1]]
    want = component_of({x for e in real for x in e}, real * 2)
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    r = np.random.default_rng(4)
    centre = r.normal(size=(12, 64))
    x = np.concatenate([centre[r.integers(0, 12, 150)] + r.normal(size=(150, 64)) * r.uniform(0.05, 0.35, (150, 1)), r.normal(size=(200, 64))]).astype(np.float32)
    x[5], x[6], x[7] = x[4], x[4] * 3, -x[4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 64), (1003, [float("nan")] + [1.0] * 63), (1004, [float("inf")] + [1.0] * 63), (1005, [None] + [1.0] * 63), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    df = spark.createDataFrame([(a, b, 1, "n") for a, b in rows + odd], "vec_id long, embedding array<float>, node int, h string")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    like = u @ u.T >= 0.95
    np.fill_diagonal(like, False)
    links = [*zip(*np.nonzero(like), strict=True)]
    want = component_of(range(len(x)), [(int(a), int(b)) for a, b in links] * 2)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(df).collect()}
    assert len(links) > 500
    assert {i: got[i] for i in range(len(x))} == {i: (int(like[i].sum()), want[i], want[i] == i) for i in range(len(x))}
    assert all(got[i] == (0, i, True) for i in range(1000, 1006)) and got[1006] == (1, 1006, True) and got[1007] == (1, 1006, False)
    assert embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embeddings_lose_no_link(spark):
    """20,000 vectors, many pairs just above and below the threshold, against brute force: seven bits a table and 22 tables."""
    r = np.random.default_rng(8)
    centre = r.normal(size=(4000, 64))
    x = np.concatenate([centre, np.repeat(centre[:800], 20, axis=0) + r.normal(size=(16000, 64)) * r.uniform(0.15, 0.35, (16000, 1))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    counts, label = np.zeros(len(x), np.int64), {i: i for i in range(len(x))}
    links = []
    for low in range(0, len(x), 2000):
        p, q = np.nonzero(u[low : low + 2000] @ u.T >= 0.95)
        p, q = p[p + low != q] + low, q[p + low != q]
        np.add.at(counts, p, 1)
        links += [*zip(p.tolist(), q.tolist(), strict=True)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>")
    got = embedding_dedup.embedding_dedup(df).toPandas().sort_values("vec_id")
    assert embedding_dedup.table_plan(len(x), 0.95)[0] == 7 and len(links) > 10_000
    assert (got["n_links"].to_numpy() == counts).all() and got["component_id"].tolist() == [label[i] for i in range(len(x))]


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def test_fingerprints(spark):
    import hashlib

    texts = {1: "a b c d e f g h", 3: "", 4: None, 8: "one two", 9: " ".join(f"w{i}" for i in range(900)), 20: " ".join(f"w{i}" for i in range(300, 1100)), 21: "é🎉 " * 9}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()] + [(None, "lost", "x", 1)], "doc_id long, text string, owner string, n int")
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_documents(df).collect()}
    ids = sorted(texts)
    for i, nxt in zip(ids, ids[1:] + ids[:1], strict=True):
        t, after = texts[i] or "", texts[nxt] or ""
        k = len(t) // 4
        edited = t[: len(t) - k] + after[:k]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        slack = 0 if len(shingles(t, 5) | shingles(edited, 5)) < 128 else 0.15
        assert abs(got[i]["near_edited"] - jaccard(shingles(t, 5), shingles(edited, 5))) <= slack
        slack = 0 if len(shingles(t, 5) | shingles(after, 5)) < 128 else 0.15
        assert abs(got[i]["near_next"] - jaccard(shingles(t, 5), shingles(after, 5))) <= slack
    assert got[None]["n_chars"] == 4 and got[3]["fingerprint"] == got[4]["fingerprint"] == ""
    assert fingerprints.fingerprint_documents(df.limit(0)).count() == 0
    twice = fingerprints.fingerprint_documents(df.unionByName(df.where("doc_id = 8")))
    assert twice.count() == len(texts) + 2


def test_sketches_merge(spark):
    from pyspark.sql import functions as F

    a, b = " ".join(f"w{i}" for i in range(500)), " ".join(f"w{i}" for i in range(400, 900))
    r = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"), fingerprints.sketch(F.concat_ws(" ", "a", F.lit("|"), "b")).alias("c"))
    row = r.select(fingerprints.distinct_shingles(F.col("a")).alias("n"), fingerprints.containment(F.col("a"), F.col("c")).alias("inside"), fingerprints.resemblance(fingerprints.merged(F.col("a"), F.col("b")), F.col("c")).alias("whole")).first()
    assert abs(row["n"] - 496) < 130 and row["inside"] > 0.75 and row["whole"] > 0.9


def test_line_dedup_equals_sql(spark):
    r = random.Random(3)
    rows = []
    for i in range(120):
        lines = [f"line {r.randrange(60)} " for _ in range(r.randrange(6))] + (["  Menu\t"] if i % 3 else []) + (["", "Menu"] if i % 5 == 0 else [])
        rows.append((i, None if i == 7 else "\n".join(lines), None if i % 11 == 0 else f"s{i % 4}", "h"))
    rows.append((5, "Menu\nMenu", "s1", "h"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, host string")
    got = line_dedup.line_dedup(df.drop("host"), ratio=0.1, min_pages=3)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(line_dedup.sql("doc_id, text, n_lines, n_dropped")).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect())
    assert got.agg({"n_dropped": "sum"}).first()[0] > 50
    assert line_dedup.line_dedup(df).columns[:4] == df.columns and line_dedup.line_dedup(df.limit(0)).count() == 0
    shuffled = [line_dedup.line_dedup(df), None]
    line_dedup.BROADCAST_LINES, kept = -1, line_dedup.BROADCAST_LINES
    try:
        shuffled[1] = line_dedup.line_dedup(df)
        assert sorted(map(str, shuffled[0].collect())) == sorted(map(str, shuffled[1].collect()))
    finally:
        line_dedup.BROADCAST_LINES = kept


def in_duckdb(sql, **tables):
    """Rows of ``sql`` over tables given as Spark DataFrames."""
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return sorted(con.execute(sql).fetchall(), key=str)


def test_ngram_join_equals_sql(spark):
    texts = [*corpus()[:90], "", None, " \n\t", "one", "ONE", "one two", "One  Two\n", "a b c", "A b\tc", "a b c", "é É x"]
    docs = spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[3])], "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        got = ngram_join.ngram_jaccard_join(docs, n, percent / 100).collect()
        assert sorted(map(tuple, got), key=str) == in_duckdb(ngram_join.sql(n, percent), documents=docs)


def test_embeddings_equal_sql(spark):
    r = np.random.default_rng(6)
    x = np.repeat(r.normal(size=(10, 32)), 8, axis=0) + r.normal(size=(80, 32)) * r.uniform(0.05, 0.4, (80, 1))
    odd = [(1000, None), (1001, []), (1002, [0.0] * 32), (1003, [float("nan")] + [1.0] * 31), (1005, [None] + [1.0] * 31), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (3, x[3].tolist())]
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *odd], "vec_id long, embedding array<float>")
    want = in_duckdb(embedding_dedup.sql(), embeddings=df)
    assert sorted(map(tuple, embedding_dedup.embedding_dedup(df).collect()), key=str) == want
    assert sum(n for _, n, _, _ in want) > 100


def test_stars_need_no_round(spark, monkeypatch):
    """Edges that are stars around their least nodes are seen to be so without a round; labels are merged without starting over."""
    monkeypatch.setattr(components_module, "_large_star", None)
    stars = spark.createDataFrame([(1, 5), (7, 1), (1, 9), (2, 3), (3, 3)], "a long, b long")
    labels = components(stars)
    assert dict(map(tuple, labels.collect())) == {1: 1, 5: 1, 7: 1, 9: 1, 2: 2, 3: 2}
    monkeypatch.undo()
    more = spark.createDataFrame([(9, 3), (20, 3), (5, 7), (30, 31)], "a long, b long")
    merged = ngram_join._merged(labels, more).collect()
    assert len(merged) == 9 and dict(map(tuple, merged)) == {1: 1, 5: 1, 7: 1, 9: 1, 2: 1, 3: 1, 20: 1, 30: 30, 31: 30}
