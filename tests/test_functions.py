import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patternloom import types as T
from patternloom.functions import distance, lexer, times
from patternloom.functions import text as X


def names(line, grammar="syslog"):
    return [(t, T.NAME[n]) for t, n in lexer.lex(line, grammar)]


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ("a.b-c.", [("a.b-c", "TEXT"), (".", "SEPARATOR")]),
        ("12ab", [("12ab", "HEX_INT")]),
        ("0x1f", [("0x1f", "HEX_INT")]),
        ("deadbeef", [("deadbeef", "TEXT")]),
        ("3.", [("3.", "FLOAT")]),
        ("42", [("42", "DEC_INT")]),
        ("10.0.0.1/24", [("10.0.0.1/24", "IP4_ADDR")]),
        ("00:1a:2b:3c:4d:5e", [("00:1a:2b:3c:4d:5e", "ETH_ADDR")]),
        ("don't", [("don", "TEXT"), ("'", "SEPARATOR"), ("t", "TEXT")]),
        ("/var/log x", [("/var/log", "PATH"), (" ", "WHITESPACE"), ("x", "TEXT")]),
        ("http://a.b/c", [("http://a.b/c", "URL")]),
        ("", []),
    ],
)
def test_lexer_takes_the_longest_match(line, expected):
    assert names(line) == expected


def test_second_grammar():
    assert names("deadbeef", "cray") == [("deadbeef", "NUMBER")]
    assert names("c0-0c1s2n3", "cray") == [("c0-0c1s2n3", "HOSTNAME")]
    assert names("1-3,5", "cray") == [("1-3,5", "DEC_LIST")]
    assert names("#001#002", "cray") == [("#001#002", "HASH_LIST")]


@given(st.text(max_size=60))
def test_lexer_loses_nothing(line):
    assert "".join(t for t, _ in lexer.lex(line)) == line


def test_headers(spark):
    lines = [
        ("<1>1 2016-12-31T01:02:03.456789-06:00 node00001 body here", "versioned", "node00001", "body here", 1483167723456789),
        ("<1>1 2016-12-31 01:02:03 node00001 body", "versioned", "node00001", "body", 1483146123000000),
        ("<1>Dec 31 01:02:03 node00001 body", "priority", "node00001", "body", 1483146123000000),
        ("2016-12-31T01:02:03.5Z node00001 body", "plain", "node00001", "body", 1483146123500000),
        ("2016-12-31 01:02:03 | HWERR[c0-0c0]: body", "hwerr", "c0-0c0", ": body", 1483146123000000),
        ("no header at all", None, None, None, None),
        (None, None, None, None, None),
    ]
    df = spark.createDataFrame([(x[0],) for x in lines], "line string").select(lexer.header(F.col("line")).alias("h"))
    got = df.select("h.format", "h.host", "h.body", lexer.epoch_us(F.col("h.ts"), 2016)).collect()
    assert [tuple(r) for r in got] == [x[1:] for x in lines]


def test_types():
    assert T.parse_types("WORD,HOSTNAME") == T.parse_types("HOSTNAME|WORD") == (1 << 16) | (1 << 4)
    assert T.first_type(T.parse_types("WORD|TEXT")) == T.WORD and T.first_type(0) == 0
    assert not T.is_wildcard(T.WHITESPACE) and T.is_wildcard(T.DEC_INT)
    with pytest.raises(LookupError):
        T.parse_types("NOPE")


def test_id_sets():
    assert X.parse_id_set("1,5-10,21-30,55,11") == [(1, 1), (5, 11), (21, 30), (55, 55)]
    assert X.format_id_set(X.parse_id_set("3,1,2,9")) == "1-3,9"
    with pytest.raises(ValueError, match="empty"):
        X.parse_id_set("5-3")


def test_bins_and_durations():
    assert [X.parse_duration(x) for x in ("d", "2h", "30m", "15")] == [86400, 7200, 1800, 15]
    assert [X.auto_bin_width(x) for x in (60, 3660, 219600)] == [60, 3600, 86400]


def test_text_columns(spark):
    df = spark.createDataFrame([("é\tA\n",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(X.sanitize(F.col("t"))).collect()] == ["XXXA", "", None]
    assert df.select(X.escaped(F.lit("a bé"))).first()[0] == "a\\x20b\\xC3\\xA9"
    assert spark.range(1).select(X.pattern_of(X.simple_tokens(F.lit("click at 12,  x")), ["click"])).first()[0] == "click * <dec>,  *"


def brute(a, b):
    import functools

    @functools.cache
    def d(i, j):
        if not i or not j:
            return i + j
        return min(d(i - 1, j) + 1, d(i, j - 1) + 1, d(i - 1, j - 1) + (a[i - 1] != b[j - 1]))

    @functools.cache
    def c(i, j):
        if not i or not j:
            return 0
        return max(c(i - 1, j), c(i, j - 1), c(i - 1, j - 1) + 1 if a[i - 1] == b[j - 1] else 0)

    return d(len(a), len(b)), c(len(a), len(b))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=9), st.lists(st.integers(0, 3), max_size=9))
def test_distances(a, b):
    edit, common = brute(tuple(a), tuple(b))
    assert distance.edit_distance(a, b) == edit
    assert distance.common_length(a, b) == common
    places = distance.common_places(a, b)
    assert len(places) == common and places == sorted(set(places))


def test_distance_udfs(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 3]), ([], [4])], "a array<long>, b array<long>")
    got = df.select(distance.levenshtein_ids("a", "b"), distance.lcs_length("a", "b"), distance.lcs_distance(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1), (1, 0, 1)]


@pytest.mark.parametrize("session_zone", ["UTC", "America/New_York"])
def test_times(spark, session_zone):
    was = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", session_zone)
    try:
        texts = ["2016-12-31T01:02:03.456789-06:00", "2016-12-31 01:02:03", "2016-12-31 01:02:03.5", "2016-13-01 00:00:00", "x", "", None]
        df = spark.createDataFrame([(x,) for x in texts], "t string")
        assert [r[0] for r in df.select(times.parse_time(F.col("t"), "America/Chicago")).collect()] == [1483167723456789, 1483167723000000, 1483167723000000, None, None, None, None]
        numbers = spark.createDataFrame([(1483167723456789,), (1467331200000000,), (-1,), (None,)], "us long")
        shown = numbers.select(times.format_time(F.col("us"), "America/Chicago"), times.format_time(F.col("us"))).collect()
        assert [r[0] for r in shown] == ["2016-12-31T01:02:03.456789-06:00", "2016-06-30T19:00:00.000000-05:00", "1969-12-31T17:59:59.999999-06:00", None]
        assert shown[2][1] == "1969-12-31T23:59:59.999999+00:00"
        loose = spark.createDataFrame([(x,) for x in ["2016-12-31 01:02:03", "100", "0x10", "010", "-5", "0", "09", "1e3", "", None]], "t string")
        assert [r[0] for r in loose.select(times.parse_loose(F.col("t"))).collect()] == [1483146123, 100, 16, 8, -5, 0, -1, -1, -1, None]
        dates = spark.createDataFrame([("2016/12/31 01:02",), ("2016-12-31 01:02",)], "t string")
        assert [r[0] for r in dates.select(times.parse_date(F.col("t"))).collect()] == [1483146120, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_query_fields(spark):
    df = spark.createDataFrame([("a=1&b=x%20y+z&&c&d=%zz&a=2=3",), ("",), (None,)], "t string")
    got = [r[0] and [tuple(f) for f in r[0]] for r in df.select(times.query_fields(F.col("t"))).collect()]
    assert got == [[("a", "1"), ("b", "x y z"), ("c", None), ("d", None), ("a", "2=3")], [], None]


def test_user_types(spark, tmp_path):
    from patternloom.sources import lines

    (tmp_path / "types.txt").write_text("_RACK_ 40\nCAGE 41\nPLAIN\n")
    d = lines.read_dictionary(spark, str(tmp_path / "types.txt"), "TYPE")
    assert {r["tkn_text"]: r["type_mask"] for r in d.collect()} == {"_RACK_": 1 | 1 << 39, "CAGE": 1 | 1 << 40, "PLAIN": 1}
    assert {tuple(r) for r in lines.user_types(d).collect()} == {("RACK", 40), ("CAGE", 41)}


def test_times_compute_each_input_once(spark):
    """The local time stands once in the plan however often its parts are used; the cost of a row grew with the product of the uses."""
    rows = spark.range(2).selectExpr("id * 86399999999 + 1710054000000000 AS u")
    text = times.format_time(F.col("u"), "Asia/Kolkata")
    both = rows.select(text.alias("text"), times.parse_time(text).alias("u"), times.parse_loose(text).alias("loose"), times.parse_date(text).alias("minute"))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("convert_timezone") == 4
    assert [tuple(r) for r in both.select("text", "u").collect()] == [("2024-03-10T12:30:00.000000+05:30", 1710054000000000), ("2024-03-11T12:29:59.999999+05:30", 1710140399999999)]
