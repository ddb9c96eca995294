import collections
import itertools
import math
import re
import time
import zlib

import duckdb
import numpy as np
import pytest

from patternloom.llm import html_text, lm_scoring, quality, url_filter
from patternloom.llm.common import table

DATA = "/root/testdata/sf0.01"


def test_url_rules_equal_sql(spark):
    urls = ["http://EX.example.com/en/7?x", "https://example.com/en/71#t", "x://com/en/", "http://b.com/en", "ftp://a.net/de/81", "http://example.net/de/", "http://org/es/1", "http://nocom/en/9", None, "no scheme", "", "://", "a://?q", "http://a.b.example.net/de/8/x", "http://com:80/en/1", "http://com/en/?/en/7"]
    df = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls * 2)], "page_id long, url string, keys string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    want = con.execute(url_filter.sql(url_filter.RULES)).fetchall()
    got = [tuple(r) for r in url_filter.url_verdicts(df, url_filter.RULES).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert url_filter.url_verdicts(df.limit(0), url_filter.RULES).count() == 0


def test_cascade_is_exact_where_filters_err(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "SHARE", 1 / 2)  # many false positives, several levels
    monkeypatch.setattr(url_filter, "first_share", lambda listed, others: 1 / 2)
    from pyspark.sql import functions as F

    keys = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed")).select("key", "listed", F.xxhash64("key").alias("x"), F.xxhash64(F.lit("#"), "key").alias("y"))
    cascade = url_filter.build_cascade(keys.where("listed"), keys)
    rows = keys.toPandas()
    assert len(cascade.filters) > 3
    assert (cascade.listed(rows["x"].to_numpy(), rows["y"].to_numpy()) == rows["listed"].to_numpy()).all()


def test_first_filter_follows_the_universe():
    """However many other keys there are, the first filter lets through about as many of them as it lists."""
    for others in (10**3, 10**6, 10**10):
        share = url_filter.first_share(100, others)
        assert share * others <= 101 and url_filter.filter_shape(100, share)[0] <= 100 * 60
    assert url_filter.filter_shape(0, 0.5)[0] == 64


def test_url_rules_of_the_contract(spark):
    assert sorted(url_filter.RULES) == [("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "com", "/en/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    urls = ["http://a.net/de/1", "http://example.net/de/7", "http://example.net/de/81", "http://net/de/", "http://b.com/en/7", "http://b.example.com/en/7", "http://c.org/es/"]
    got = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.RULES).orderBy("page_id").collect()
    want = [("net/de/", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("net/de/", "allow"), ("com/en/", "block"), ("example.com/en/7", "allow"), ("org/es/", "block")]
    assert [(r["rule"], r["verdict"]) for r in got] == want


def test_url_without_rules(spark):
    df = spark.createDataFrame([(1, "http://a.com/x", "r")], "page_id long, url string, rule string")
    assert [tuple(r) for r in url_filter.url_verdicts(df, []).collect()] == [(1, "a.com", "/x", None, "allow")]


def test_html(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body>
    <nav><ul><li><a href="/a">menu</a></ul></nav><!-- <p>hidden</p> --><div class="ad">buy</div>
    <article><h1>A &amp; B</h1><p><b>one&nbsp; two<br><p>three <i>fo</i>ur</p><div class="comments"><p>first!</p></div><form>send</form></article><footer>&copy; x</footer></body>"""
    assert html_text.Page(page).text() == "A & B\none two\nthree four"
    rows = [(1, "http://h/1", page, "x"), (2, None, None, "x"), (3, "http://h/3", "", "x"), (4, "bad", "<p>plain &lt;text&gt;", "x"), (4, "bad", "no markup at all", "x"), (5, "http://h/5", "<div><<<p>odd<", "x")]
    got = sorted(tuple(r) for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, low string")).select("page_id", "text", "n_chars").collect())
    assert got[:4] == [(1, "A & B\none two\nthree four", 24), (2, "", 0), (3, "", 0), (4, "no markup at all", 16)]
    assert (4, "plain <text>", 12) in got and html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, low string").limit(0)).count() == 0


def test_html_repeated_branches_go(spark):
    pages = [(i, f"http://site/{i}", f"<body><div class=x><p>Same words on every page</div><div class=y><p>Text number {i} of its own</div></body>") for i in range(20)]
    got = html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert {r["text"] for r in got.collect()} == {f"Text number {i} of its own" for i in range(20)}


def test_html_repeated_branches_of_an_article_go(spark):
    page = "<body><article><h1>Title {0}</h1><p>Text number {0} of its own</p><div class=x><p>Same words on every page</div></article><div class=y><p>More of text {0}</div><div class=z><p>Same end</div></body>"
    pages = [(i, f"http://site/{i}", page.format(i)) for i in range(20)] + [(100 + i, f"http://mirror/{i}", "<article><p>One text for all</article>") for i in range(20)]
    got = html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string"))
    want = {i: f"Title {i}\nText number {i} of its own\nMore of text {i}" for i in range(20)} | {100 + i: "One text for all" for i in range(20)}
    assert {r["page_id"]: r["text"] for r in got.collect()} == want


def test_html_names_leave_wrappers_and_headings():
    article = "<article><h1>Title</h1><p>Main text of the page</p></article>"
    for wrapper in ("div class='content no-sidebar'", "div class='layout has-sidebar'", "div class='article page-with-comments'", "div class=menu-open", "form id=form1"):
        assert html_text.Page(f"<{wrapper}>{article}<div class=sidebar>other</div></{wrapper.split()[0]}>").text() == "Title\nMain text of the page"
    assert html_text.Page("<article><div class=entry-header><h1>Title</h1></div><p>Main text</p></article>").text() == "Title\nMain text"
    assert html_text.Page("<div><p>Main text of the page</p></div><article class=comment><p>first!</p></article>").text() == "Main text of the page"
    assert html_text.Page("<div class=menu-open><p>All of the text</p></div>").text() == "All of the text"
    assert html_text.Page("<div class=ad>only an advert</div><article></article>").text() == ""
    assert html_text.Page("<p>one <span class=ad>buy</span> two</p>").text() == "one\ntwo"


def test_html_long_and_deep_pages():
    import time

    began = time.time()
    assert html_text.Page("<div class=ad>" * 100_000 + "<p>in</p>" + "</b>" * 100_000).blocks
    assert html_text.Page("<div>" * 100_000 + "text" + "</div>" * 100_000 + "<ul>" + "<li>x" * 50_000).text().startswith("text\nx\nx")
    assert "c" in html_text.Page("<a b='c " * 125_000).text()
    assert html_text.Page("<a b='c " * 50_000 + "><p>end</p>").text().endswith("end")
    assert html_text.Page("<!-- " + "<p " * 200_000).text() == "" and html_text.Page("<script>" * 50_000).text() == ""
    assert time.time() - began < 30


def test_style_tree_is_its_definition(spark):
    r = np.random.default_rng(2)
    page = lambda i: f"<body><div class=m><p>menu {i % 2 if i % 9 == 0 else 0}</div><article><p>text {i}</p>{'<p>more</p>' if r.random() < 0.5 else ''}</article><div class=x{i}>{'<b>' * (i % 3)}same</div></body>"
    rows = [(i, f"http://h{i % 3}/{i}", page(i)) for i in range(60)]
    parsed = html_text.parsed_pages(spark.createDataFrame([(a, b, f"h{a % 3}", c) for a, b, c in rows], "page_id long, url string, host string, html string"))
    seen = {"content": collections.defaultdict(collections.Counter), "presentation": collections.defaultdict(collections.Counter)}
    for i, _, source in rows:
        p = html_text.Page(source, f"h{i % 3}")
        for chain, parent, main, text in p.blocks:
            seen["content"][(f"h{i % 3}", chain, main, parent)][text] += 1
        for chain, steps in p.shapes.items():
            seen["presentation"][(f"h{i % 3}", chain)][tuple(steps)] += 1

    def importance(counter):
        shares = [n / (sum(counter.values()) + 1) for n in [*counter.values(), 1]]
        return -sum(s * math.log(s) for s in shares) / math.log(sum(counter.values()) + 1)

    unsigned = lambda x: x % 2**64
    content, presentation = html_text.style_nodes(parsed)
    got = {(r["host"], unsigned(r["chain"]), r["main"], unsigned(r["parent"])): r["importance"] for r in content.collect()}
    assert got.keys() == seen["content"].keys() and all(math.isclose(got[k], importance(seen["content"][k]), abs_tol=1e-12) for k in got)
    also = {(r["host"], unsigned(r["chain"])): r["importance"] for r in presentation.collect()}
    assert also.keys() == seen["presentation"].keys() and all(math.isclose(also[k], importance(seen["presentation"][k]), abs_tol=1e-12) for k in also)
    low = set()
    for k, v in got.items():
        if (0.9 * v + 0.1 * also.get((k[0], k[3]), 1.0)) * (1.5 if k[2] else 1) < 0.2:
            low.add((k[0], k[1], k[2]))
    want = {}
    for i, _, source in rows:
        blocks = html_text.Page(source, f"h{i % 3}").blocks
        want[i] = "\n".join(text for chain, _, main, text in blocks if (f"h{i % 3}", chain, main) not in low)
    assert low and {r["page_id"]: r["text"] for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_html_main_text_beside_an_article(spark):
    teaser = html_text.Page("<article>teaser</article><div><p>The real long text</p></div>").text()
    beside = html_text.Page("<div><p>article-like text</p></div><main><div>only main</div></main>").text()
    assert teaser == "teaser\nThe real long text" and beside == "article-like text\nonly main"


def test_html_on_the_pages(spark):
    import html

    for r in html_text.extract_text(table(spark, DATA, "pages")).join(table(spark, DATA, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b)


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["held_out"] == held["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and len(held) > 50
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad).mean() > 0.97 and ((held["score"] >= 0.5) == (held["predicted"] == 1)).all()
    assert (held["predicted"] == held["quality"]).mean() > 0.95


def test_quality_corner_cases(spark):
    docs = spark.createDataFrame([(1, "fine words"), (1, "fine words"), (2, ""), (3, None), (None, "x"), (4, "é " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")
    scores = [r["score"] for r in quality.quality_scores(docs, labels).collect()]
    assert len(scores) == 6 and all(0 <= s <= 1 for s in scores)
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


def test_isotonic():
    x, y = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert y.tolist() == sorted(y.tolist()) and math.isclose(float(np.interp(1.5, x, y)), 0.5)


def test_statistics_are_defined():
    import pyarrow as pa

    x = quality.statistics(pa.array(["", " ", "\n", "é", "A b\nA b", "*** %%%"]))
    assert np.isfinite(x).all() and x.shape == (6, quality.WIDTH)
    assert quality.statistics(pa.array([], pa.string())).shape == (0, quality.WIDTH)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) + [None]


def test_lm_score_is_its_model(spark, monkeypatch):
    """The whole score by hand: the chain's likelihood over symbols, times each word's share of its group."""
    monkeypatch.setattr(lm_scoring, "OWN", 3)
    texts = ["to be or not to be", "to be a bee or a tree", "be a bee to a tree or two", "once upon a time to be", "new words in zzz"]
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1][:4] + [next(i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1)]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(2)
    kept, train = [], lm_scoring.train
    monkeypatch.setattr(lm_scoring, "train", lambda *args: kept.append((args[1], train(*args))) or kept[-1][1])
    got = {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs, states=2, rounds=2).collect()}
    v, (model, _) = kept[0]
    import pyarrow as pa

    counts = collections.Counter(w for i, t in zip(ids[:4], texts, strict=False) for w in t.split())
    group = lambda w: int(lm_scoring._endings(pa.array([w]))[0])
    rare = [w for w in counts if counts[w] < 3]
    tokens, once = collections.Counter(), collections.Counter()
    for w in rare:
        tokens[group(w)] += counts[w]
        once[group(w)] += counts[w] == 1
    own = {int(h): s for h, s in zip(v.hashes, v.symbols, strict=True) if s >= 0}
    assert len(own) == sum(n >= 3 for n in counts.values())
    for i, text in zip(ids, texts, strict=True):
        symbols, share = [], 0.0
        for w in text.split():
            h = int(lm_scoring._word_hashes(pa.array([w]))[0])
            if h in own:
                symbols.append(own[h])
                continue
            g = group(w)
            unseen = (once[g] + 0.5) / (tokens[g] + once[g] + 1)
            share += math.log10(unseen if w not in counts else (1 - unseen) * counts[w] / tokens[g])
            symbols.append(len(own) + g)
        assert math.isclose(got[i], math.log10(all_paths(model, [*symbols, len(own) + lm_scoring.ENDINGS])) + share, rel_tol=1e-9)


@pytest.mark.parametrize("head", [1 << 19, 300])
def test_lm_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    if head < 1000:
        monkeypatch.setattr(lm_scoring, "SYMBOLS", 100)
    docs = table(spark, DATA, "documents").where("doc_id < 250").select("doc_id", "text").unionByName(spark.createDataFrame([(9001, ""), (9002, None), (9003, "Zzz zzz ZZZ")], "doc_id long, text string"))
    rows = docs.collect()
    counts = collections.Counter()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 1:
            counts.update(words(r["text"]))
    total, types = sum(counts.values()), len(counts)
    got = {r["doc_id"]: r for r in lm_scoring.lm_scores(docs, states=3, rounds=3).collect()}
    for r in rows:
        t, g = words(r["text"]), got[r["doc_id"]]
        base = sum(math.log10((counts.get(w, 0) + 0.5) / (total + 0.5 * (types + 1))) for w in t)
        assert (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(t), sum(w in counts for w in t), total)
        assert math.isclose(g["base_score"], base, rel_tol=1e-9, abs_tol=1e-9) and g["score"] < 0
    held = [g for g in got.values() if g["held_out"]]
    if head > 1000:
        assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)


def test_lm_emissions_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "OWN", 2)
    texts = ["aa xone aa xone", "bb yone bb yone", "aa xtwo aa xtwo", "bb ytwo bb ytwo"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = lambda: {r["doc_id"]: r["score"] for r in lm_scoring.lm_scores(docs, states=2, rounds=1).collect()}
    want = score()
    monkeypatch.setattr(lm_scoring, "SYMBOLS", 0)  # all emissions are joined
    found, read, train = {}, {}, lm_scoring.train

    def kept(*args):
        read["model"], read["table"] = train(*args)
        found.update({r["h"]: r["emits"] for r in read["table"].collect()})
        return read["model"], read["table"]

    monkeypatch.setattr(lm_scoring, "train", kept)
    got = score()
    assert len(found) == 6 and np.allclose(np.array(list(found.values())).sum(0) + read["model"].emits.sum(0), 1)
    assert got.keys() == want.keys() and all(math.isfinite(x) and abs(x - want[i]) < 2 for i, x in got.items())


def test_lm_corner_cases(spark):
    assert lm_scoring.lm_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    only_held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm_scoring.lm_scores(spark.createDataFrame([(only_held, "a b", "w")], "doc_id long, text string, h string")).first()
    assert r["held_out"] and r["train_tokens"] == 0 and r["score"] == r["base_score"] == 0.0
    twice = lm_scoring.lm_scores(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a")], "doc_id long, text string"), states=2, rounds=2).collect()
    assert len(twice) == 3


def test_expected_emissions_travel(spark):
    import pandas as pd

    r = np.random.default_rng(1)
    parts = [r.gamma(0.3, 50, (3000, 6)) * (r.random((3000, 1)) < 0.5) for _ in range(3)]
    rows = [(b, raw) for x in parts for b, raw in zip(*lm_scoring._packed(x), strict=True)]
    got = np.concatenate([np.frombuffer(lm_scoring._sum_of(pd.DataFrame([x for x in rows if x[0] == b], columns=["bucket", "sums"]), 6, True)["sums"][0], float).reshape(-1, 6) for b in range(3)])[:3000]
    want = sum(parts)
    assert np.allclose(got.sum(1), want.sum(1), rtol=1e-5) and (np.abs(got - want) <= want.sum(1, keepdims=True) / 100).all()


def test_long_sequences_are_grouped_apart():
    parts = [np.zeros(n, np.int32) for n in (5, 3000, 7, 2048, 2047)]
    assert [[len(x) for x in g] for g in lm_scoring._grouped(parts)] == [[5, 7, 2047], [3000, 2048]]


def all_paths(model, symbols):
    k = len(model.start)
    return sum(model.start[p[0]] * math.prod(model.moves[a, b] for a, b in itertools.pairwise(p)) * math.prod(model.emits[s, x] for s, x in zip(symbols, p, strict=True)) for p in itertools.product(range(k), repeat=len(symbols)))


def test_forward_and_expected_counts_are_exact():
    r = np.random.default_rng(1)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = lm_scoring.Hmm(norm(r.random(3), 0), norm(r.random((3, 3)), 1), norm(r.random((5, 3)), 0))
    parts = [r.integers(0, 5, n).astype(np.int32) for n in (1, 4, 2, 6, 4)]
    want = [math.log10(all_paths(model, p.tolist())) for p in parts]
    assert np.allclose(lm_scoring.log10_likelihoods(model, parts), want)
    starts, moves, emitted = lm_scoring.expected_counts(model, parts)
    assert math.isclose(starts.sum(), 5) and math.isclose(moves.sum(), sum(len(p) - 1 for p in parts)) and math.isclose(emitted.sum(), sum(map(len, parts)))
    better = lm_scoring.Hmm(starts / starts.sum(), norm(moves, 1), norm(emitted, 0))
    assert lm_scoring.log10_likelihoods(better, parts).sum() > sum(want)


def test_expected_counts_are_the_textbooks(monkeypatch):
    """Against each sequence's own forward and backward recursion, also where moves are summed few at a time."""
    r = np.random.default_rng(2)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = lm_scoring.Hmm(norm(r.random(3), 0), norm(r.random((3, 3)), 1), norm(r.random((5, 3)), 0))
    monkeypatch.setattr(lm_scoring, "AT_ONCE", 7)
    for lengths in ((1, 40, 2, 6, 6, 13), (1, 1), (9,)):
        parts = [r.integers(0, 5, n).astype(np.int32) for n in lengths]
        starts, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
        for p in parts:
            alpha, beta = [model.start * model.emits[p[0]]], [np.ones(3)]
            for x in p[1:]:
                alpha.append(alpha[-1] @ model.moves * model.emits[x])
            for x in p[:0:-1]:
                beta.insert(0, model.moves @ (model.emits[x] * beta[0]))
            whole = alpha[-1].sum()
            starts += alpha[0] * beta[0] / whole
            for t, x in enumerate(p):
                emitted[x] += alpha[t] * beta[t] / whole
                if t:
                    moves += np.outer(alpha[t - 1], model.emits[x] * beta[t]) * model.moves / whole
        got = lm_scoring.expected_counts(model, parts)
        assert all(np.allclose(a, b, rtol=1e-12) for a, b in zip(got, (starts, moves, emitted), strict=True))


def test_words_are_hashed_without_a_scalar_each():
    """Hashing costs less than Arrow's ``to_pylist`` alone, which made up most of it."""
    import pyarrow as pa
    import xxhash

    words = pa.array([f"word{i}é" for i in range(200_000)])

    def least(f):
        times = []
        for _ in range(3):
            begun = time.process_time()
            f()
            times.append(time.process_time() - begun)
        return min(times)

    assert lm_scoring._word_hashes(words[:3]).tolist() == np.array([xxhash.xxh3_64_intdigest(f"word{i}é") for i in range(3)], np.uint64).view(np.int64).tolist()
    assert lm_scoring._word_hashes(words[:0]).tolist() == []
    assert least(lambda: lm_scoring._word_hashes(words)) < 0.8 * least(words.to_pylist)
