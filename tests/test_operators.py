import itertools

import pytest
from pyspark.sql import functions as F

from patternloom.operators import arrays, association, attributes, clusters, federation, histograms, messages, numeric, patterns

from .conftest import rows

WORDS = ["This", "is", "pattern", "Zero", "One"]
T0 = 1531785600


@pytest.fixture(scope="module")
def log(spark):
    """4 ticks x 4 hosts x 2 templates with a running number."""
    data = [((T0 + 21600 * t) * 10**6 + i, f"node{h}", f"This is pattern {w}: {t * 10 + h}") for t in range(4) for h in range(4) for i, w in enumerate(("Zero", "One"))]
    return spark.createDataFrame(data, "epoch_us long, host string, body string").cache()


@pytest.fixture(scope="module")
def typed(log):
    return patterns.typed(log, WORDS).cache()


def test_patterns(typed):
    got = rows(patterns.patterns(typed).select("ptn", "tkn_count", "msg_count", "first_seen"))
    assert got == [("<host> This is pattern One: <dec>", 12, 16, T0 * 10**6 + 1), ("<host> This is pattern Zero: <dec>", 12, 16, T0 * 10**6)]


def test_dictionary_join_types_as_the_word_list_does(spark, log, typed):
    known = spark.createDataFrame([(w, 1 << 16) for w in WORDS], "tkn_text string, type_mask long")
    dictionary = patterns.token_dictionary(log, known)
    assert rows(patterns.typed(log, dictionary=dictionary).select("epoch_us", "host", "ptn")) == rows(typed.select("epoch_us", "host", "ptn"))
    assert dict(dictionary.where("tkn_text in ('This', 'node1')").select("tkn_text", "tkn_count").collect()) == {"This": 32, "node1": 8}


def test_counters_agree(typed):
    hist, comp = histograms.pattern_hist(typed), histograms.component_hist(typed)
    for width in histograms.WIDTHS:
        assert hist.where(f"bin_width = {width} and ptn is null").agg(F.sum("msg_count")).first()[0] == 32
        assert hist.where(f"bin_width = {width} and ptn is not null").agg(F.sum("msg_count")).first()[0] == 32
        assert comp.where(f"bin_width = {width}").agg(F.sum("msg_count")).first()[0] == 32
    assert histograms.token_hist(typed).where("bin_width = 60").agg(F.sum("tkn_count")).first()[0] == typed.agg(F.sum(F.size("argv"))).first()[0]
    wild = patterns.pattern_tokens(typed).groupBy("ptn", "pos").agg(F.sum("tkn_count").alias("n"))
    assert {r["n"] for r in wild.collect()} == {16}


def test_message_count(typed):
    hist, ptns = histograms.pattern_hist(typed), patterns.patterns(typed)
    ptn = "<host> This is pattern Zero: <dec>"
    count = lambda *a: histograms.message_count(hist, ptns, *a).first()[0]
    assert count(ptn) == 16 and count(None, T0, T0 + 3600) == 8 and count(ptn, T0, T0 + 21601) == 8 and count("none") == 0


def test_hist_filter_needs_a_width(typed):
    with pytest.raises(ValueError, match="bin width"):
        histograms.hist_filter(histograms.pattern_hist(typed), begin=5)


def test_filters_and_seeks(typed):
    assert messages.message_filter(typed, host="node1", begin_us=(T0 + 1) * 10**6).count() == 6
    assert messages.message_filter(typed, begin_us=5).count() == 32  # below a second: none
    assert messages.seek(typed.select("epoch_us", "host"), {"epoch_us": (T0 + 1) * 10**6}).first()[0] == (T0 + 21600) * 10**6
    assert messages.seek(typed.select("epoch_us", "host"), {"epoch_us": (T0 + 1) * 10**6}, False).first()[0] == T0 * 10**6 + 1
    first = messages.page(typed.select("epoch_us", "host"), ["epoch_us", "host"], 5).collect()
    after = messages.page(typed.select("epoch_us", "host"), ["epoch_us", "host"], 5, first[-1].asDict()).collect()
    assert len(after) == 5 and after[0] > first[-1]
    with pytest.raises(ValueError, match="order"):
        patterns.order_of("nope")


def test_match_and_reprocess(spark, log, typed):
    got = patterns.patterns_with_token(typed, "13").collect()
    assert [(r["msg_count"], r["match_pos"]) for r in got] == [(16, "11"), (16, "11")]
    moved = patterns.retyped(log, [w for w in WORDS if w != "Zero"], WORDS)
    assert rows(moved) == [("<host> This is pattern *: <dec>", "<host> This is pattern Zero: <dec>", 16)]
    assert patterns.retyped(log, WORDS, WORDS).count() == 0


def test_ids_are_dense(spark, log):
    ids = patterns.with_token_ids(patterns.token_dictionary(log))
    hosts = sorted(r[0] for r in ids.where("tkn_text like 'node%'").select("tkn_id").collect())
    assert hosts == [256, 257, 258, 259]
    other = sorted(r[0] for r in ids.where("tkn_id > 1000").select("tkn_id").collect())
    assert other == list(range(2_000_001, 2_000_001 + len(other)))


def test_ids_beyond_the_host_range(spark, log, monkeypatch):
    import __spark_entry__
    from patternloom.plans import catalogue

    monkeypatch.setattr(patterns.T, "FIRST_HOST_ID", 2_000_001 - 2)  # room for two hosts
    ids = patterns.with_token_ids(patterns.token_dictionary(log)).collect()
    assert sorted(r["tkn_id"] for r in ids) == list(range(1_999_999, 1_999_999 + len(ids)))
    monkeypatch.setattr(catalogue, "token_dictionary", lambda s, d: patterns.token_dictionary(log))
    assert sorted(r["tkn_id"] for r in __spark_entry__.queries()["host_ids"](spark, "").collect()) == list(range(1_999_999, 2_000_003))


def test_attributes(spark):
    kind = "ptn_id long, attr_type string, attr_value string"
    tags, types = spark.createDataFrame([(1, "a", "x"), (1, "a", "y"), (2, "a", "x")], kind), spark.createDataFrame([("a",)], "attr_type string")
    with pytest.raises(attributes.Exists):
        attributes.new_type(types, "a")
    with pytest.raises(attributes.Missing):
        attributes.add_value(tags, types, 1, "b", "x")
    with pytest.raises(attributes.Exists):
        attributes.add_value(tags, types, 1, "a", "x")
    with pytest.raises(attributes.Missing):
        attributes.remove_value(tags, 2, "a", "y")
    with pytest.raises(ValueError, match="type"):
        attributes.tag_filter(tags, attr_value="x")
    assert rows(attributes.unset(tags, 1, "a")) == [(2, "a", "x")]
    assert rows(attributes.set_values(tags, spark.createDataFrame([(1, "a", "z")], kind))) == [(1, "a", "z"), (2, "a", "x")]
    assert rows(attributes.listed(tags)) == [(1, "a=x,a=y"), (2, "a=x")]
    assert attributes.tag_ids(tags, [(1, 3)], "b", "v").count() == 3


def test_federation(typed, log):
    halves = [typed.where("host < 'node2'"), typed.where("host >= 'node2'")]
    assert rows(federation.patterns([patterns.patterns(h) for h in halves])) == rows(patterns.patterns(typed))
    assert rows(federation.hist([histograms.component_hist(h) for h in halves], "msg_count")) == rows(histograms.component_hist(typed).select("bin_width", "epoch", "host", "ptn", "msg_count"))


def grid(name, x0, y0, size, x=0, hole=None):
    return [(name, x + i, j, 100) for i in range(x0, x0 + size) for j in range(y0, y0 + size) if hole is None or not hole(i, j)]


def test_array_rules(spark):
    """Four grids, each with a hole in another quadrant, meet in a target: only all four together imply it."""
    cells = []
    for k in range(2):
        x = 16 * k
        for q in range(4):
            a, b = q % 2, q // 2
            cells += grid(f"input{4 * k + q}", 0, 0, 16, x, lambda i, j, a=a, b=b: i // 8 == a and j // 8 == b and not (4 <= i < 12 and 4 <= j < 12))
        cells += grid(f"target{k}", 4, 4, 8, x)
    df = spark.createDataFrame(cells, "name string, x long, y long, cnt long")
    got = association.mine(df, [f"input{i}" for i in range(8)], ["target0", "target1"], conf=0.75, sig=0.25, diff=0.10)
    assert sorted(r[0] for r in association.as_text(got).collect()) == ["{input0,input1,input2,input3}=>{target0}", "{input4,input5,input6,input7}=>{target1}"]
    assert association.redundant(got).count() == 0
    assert arrays.support(df, ["input0", "target0"]).first()[0] == 6400
    assert arrays.heat_map(df, 4, 4).agg(F.sum("cnt")).first()[0] == df.agg(F.sum("cnt")).first()[0]


def test_item_rules(spark):
    """Items that share one bit of a nibble with a target each: support is the number of shared bits."""
    bits = {"a": [0, 4], "b": [0, 5], "c": [1, 4], "t": [0, 1, 2, 3]}
    df = spark.createDataFrame([(n, x, 0, 1) for n, xs in bits.items() for x in xs], "name string, x long, y long, cnt long")
    got = association.mine(df, ["a", "b", "c"], ["t"], conf=0.9, sig=0.2, diff=0.1)
    expected = set()
    for k in range(1, 4):
        for s in itertools.combinations("abc", k):
            common = set.intersection(*(set(bits[n]) for n in s))
            if common and common <= set(bits["t"]) and not any(set(e) < set(s) for e in expected):
                expected.add(s)
    assert {tuple(r["lhs"].split(",")) for r in got.collect()} == expected == {("a", "b")}


def test_meta_clusters(spark):
    ptns = [("alpha beta gamma delta <dec>",), ("alpha beta gamma delta <hex>",), ("alpha beta gamma omega <dec>",), ("one two three four",)]
    got = {r["ptn"]: (r["meta"], r["meta_ptn"]) for r in clusters.meta_clusters(spark.createDataFrame(ptns, "ptn string")).collect()}
    assert len({got[p[0]][0] for p in ptns[:3]}) == 1 and got[ptns[3][0]] == (ptns[3][0], ptns[3][0])
    assert got[ptns[0][0]][1].startswith("alpha beta gamma *")
    assert clusters.meta_clusters(spark.createDataFrame([], "ptn string")).count() == 0


def test_numeric(spark):
    values = [5.0, 1.0, 4.0, 4.0, 9.0, 2.0, 7.0, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    r = numeric.profile(df, "v").first()
    have = sorted(v for v in values if v is not None)
    n = len(have)
    assert (r["n"], r["min"], r["q1"], r["median"], r["q3"], r["max"]) == (n, 1.0, have[(n - 1) // 4], have[(n - 1) // 2], have[3 * (n - 1) // 4], 9.0)
    assert r["mad"] == sorted(abs(v - have[3]) for v in have)[3]
    assert [numeric.nth(df, "v", k).first()[0] for k in range(3)] == have[:3]


def test_numeric_by_group(spark):
    """Groups of which one holds most rows, a null key, a group without values; the hot one lies in several ranges."""
    data = [("hot", float(i % 997)) for i in range(6000)] + [(None, 3.0), (None, 1.0), ("few", 2.0), ("none", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in numeric.profile(df, "v", ["k"]).collect()}
    assert set(got) == {"hot", None, "few"}
    for k, r in got.items():
        have = sorted(v for key, v in data if key == k and v is not None)
        n = len(have)
        middle = have[(n - 1) // 2]
        assert (r["n"], r["q1"], r["median"], r["q3"], r["mad"]) == (n, have[(n - 1) // 4], middle, have[3 * (n - 1) // 4], sorted(abs(v - middle) for v in have)[(n - 1) // 2])
    ends = patterns.running(df.where("v is not null").groupBy("k", "v").count(), ["v"], "count", ["k"]).where("k = 'hot'").orderBy("v").collect()
    assert [r["end"] for r in ends][-1] == 6000 and all(r["n"] == 6000 for r in ends)


def test_federated_histograms_are_dealt_by_rows(typed, log):
    """Each store's bins lie in as many partitions as asked for, and their sum keeps them: no task gets all stores' rows by their bytes."""
    assert [histograms.parts_of(n) for n in (0, 1, histograms.TASK_ROWS, 10**8)] == [1, 1, 3, -(-3 * 10**8 // histograms.TASK_ROWS)]
    stores = [typed.where(f"epoch_us % 2 = {i}") for i in range(2)]
    got = federation.hist([histograms.component_hist(s, parts=7) for s in stores], "msg_count")
    assert got.rdd.getNumPartitions() == 7
    want = histograms.component_hist(typed).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_profiles_deal_large_groups_over_tasks(spark, monkeypatch):
    """Distances from the medians join no rows by key alone where groups are few; where they are many the results are the same."""
    values = spark.createDataFrame([(None if i % 5 == 0 else i % 3, float(i * i % 101)) for i in range(300)], "k int, v double")
    got = numeric.profile(values, "v", ["k"])
    monkeypatch.setattr(numeric, "settled", lambda df: df)
    monkeypatch.setattr("patternloom.operators.patterns.settled", lambda df: df)
    few = numeric.profile(values, "v", ["k"])
    assert "strategy=broadcast" in few._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(numeric, "BROADCAST_GROUPS", 0)
    many = numeric.profile(values, "v", ["k"])
    assert "strategy=broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, many.collect()))
