"""The registered queries over the driver's tables, and the SQL that each is held against.

``events`` stand in for log messages: the user is the host, the body a line of words and numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as T
from ..functions import lexer, times
from ..functions import text as X
from ..functions.distance import levenshtein_ids
from ..operators import arrays, association, attributes, clusters, federation, histograms, messages, numeric, patterns
from ..sources import lines

WORDS = ["click", "view", "purchase", "signup", "error", "value", "k"]
#: Before "value" is known as a word.
FEWER = [w for w in WORDS if w != "value"]
#: A pattern of the events, and times in the month they cover.
PTN = '<host> click value <dec> {"k": <dec>}'
T0, T1 = 1704672000, 1705276800
WEIGHTS = [("error", 1.5), ("purchase", 2.0), ("fail", 1.5), ("sign ?up", 0.5)]
TAGS = [(256, "kind", "odd"), (257, "kind", "even"), (257, "level", "high"), (258, "kind", "odd"), (258, "kind", "three"), (259, "level", "low"), (260, "kind", "even")]
MORE = [(256, "kind", "odd"), (256, "kind", "three"), (259, "kind", "new"), (259, "kind", "new")]
GONE = [(257, "kind", "even"), (260, "level", "none")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = sql if sql.lstrip().upper().startswith("WITH") else f"WITH {VIEWS} {sql}"
        return f

    return add


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _pattern_sql(words: list[str]) -> str:
    return f"""'<host> ' || array_to_string(list_transform(regexp_extract_all(body, '(\\w+|.)', 1), lambda t: CASE WHEN t IN ({_quoted(words)}) THEN t
  WHEN regexp_full_match(t, '\\s+') THEN ' ' WHEN regexp_full_match(t, '[0-9]+') THEN '<dec>' WHEN regexp_full_match(t, '\\W') THEN t ELSE '*' END), '')"""


def _rows_sql(rows: list[tuple]) -> str:
    return ", ".join(f"({p}, '{t}', '{v}')" for p, t, v in rows)


VIEWS = f"""ev AS (SELECT event_id, user_id, epoch_us(ts) AS epoch_us, 'user' || user_id AS host,
  event_type || ' value ' || CAST(floor(value) AS BIGINT) || ' ' || props AS body FROM events),
msg AS (SELECT *, {_pattern_sql(WORDS)} AS ptn FROM ev),
elem AS (SELECT epoch_us, host, ptn, unnest(list_concat([host, ' '], regexp_extract_all(body, '(\\w+|.)', 1))) AS tkn_text,
  unnest(range(2 + len(regexp_extract_all(body, '(\\w+|.)', 1)))) AS pos FROM msg),
ptns AS (SELECT ptn, CAST(max(2 + len(regexp_extract_all(body, '(\\w+|.)', 1))) AS BIGINT) AS tkn_count, count(*) AS msg_count, min(epoch_us) AS first_seen, max(epoch_us) AS last_seen FROM msg GROUP BY ptn),
widths(bin_width) AS (VALUES (60), (3600), (86400)),
comp AS (SELECT bin_width, epoch_us // 1000000 // bin_width * bin_width AS epoch, host, ptn, count(*) AS msg_count FROM msg, widths GROUP BY ALL),
tags(ptn_id, attr_type, attr_value) AS (VALUES {_rows_sql(TAGS)}),
more(ptn_id, attr_type, attr_value) AS (VALUES {_rows_sql(MORE)}),
gone(ptn_id, attr_type, attr_value) AS (VALUES {_rows_sql(GONE)}),
cells AS (SELECT event_type AS name, epoch_us(ts) // 1000000 // 3600 AS x, user_id AS y, count(*) AS cnt FROM events GROUP BY ALL)"""


def events_as_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, user_id, epoch_us, host, body``."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    body = F.concat_ws(" ", "event_type", F.lit("value"), F.floor("value").cast("long").cast("string"), "props")
    return events.select("event_id", "user_id", micros.alias("epoch_us"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("host"), body.alias("body"))


def typed_events(spark: SparkSession, sf_dir: str, words: list[str] | None = None) -> DataFrame:
    return patterns.typed(events_as_messages(spark, sf_dir), words or WORDS)


def with_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with their pattern's text only: nothing is exploded."""
    rows = events_as_messages(spark, sf_dir)
    return rows.withColumn("ptn", F.concat(F.lit("<host> "), X.pattern_of(X.simple_tokens(F.col("body")), WORDS)))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    return rows.groupBy(F.col("event_type").alias("name"), F.floor(seconds / 3600).alias("x"), F.col("user_id").alias("y")).agg(F.count("*").alias("cnt"))


def tag_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "ptn_id long, attr_type string, attr_value string")


def _hist_queries() -> None:
    for width in histograms.WIDTHS:
        query(f"SELECT epoch_us // 1000000 // {width} * {width} AS epoch, tkn_text, count(*) AS tkn_count FROM elem GROUP BY ALL", f"tkn_hist_{width}")(lambda s, d, w=width: histograms.token_hist(typed_events(s, d)).where(F.col("bin_width") == w).drop("bin_width"))
        query(f"SELECT epoch_us // 1000000 // {width} * {width} AS epoch, coalesce(ptn, '(all)') AS ptn, count(*) AS msg_count FROM msg GROUP BY GROUPING SETS ((1, ptn), (1))", f"ptn_hist_{width}")(lambda s, d, w=width: histograms.pattern_hist(with_pattern(s, d)).where(F.col("bin_width") == w).select("epoch", F.coalesce("ptn", F.lit("(all)")).alias("ptn"), "msg_count"))


_hist_queries()


@query("SELECT * FROM comp")
def comp_hist(spark, sf_dir):
    return histograms.component_hist(with_pattern(spark, sf_dir))


@query("SELECT epoch, host, ptn, msg_count FROM comp WHERE bin_width = 3600 AND host = 'user7' AND epoch BETWEEN 1704672000 AND 1705276800")
def comp_hist_filter(spark, sf_dir):
    hist = histograms.component_hist(with_pattern(spark, sf_dir))
    return histograms.hist_filter(hist, 3600, T0, T1, host="user7").drop("bin_width")


@query(f"""SELECT tkn_text, CAST(bit_or(CASE WHEN pos = 0 THEN 16 WHEN regexp_full_match(tkn_text, '\\s+') THEN 262144 WHEN regexp_full_match(tkn_text, '[0-9]+') THEN 2048
  WHEN regexp_full_match(tkn_text, '\\W') THEN 131072 WHEN tkn_text IN ({_quoted(WORDS)}) THEN 65536 ELSE 524288 END) AS BIGINT) AS type_mask, count(*) AS tkn_count FROM elem GROUP BY tkn_text""")
def token_dictionary(spark, sf_dir):
    known = spark.createDataFrame([(w, 1 << 16) for w in WORDS], "tkn_text string, type_mask long")
    return patterns.token_dictionary(events_as_messages(spark, sf_dir), known)


@query("SELECT tkn_text, count(*) AS tkn_count FROM (SELECT unnest(regexp_extract_all(text, '(\\w+|.)', 1)) AS tkn_text FROM documents) GROUP BY tkn_text")
def document_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.explode(X.simple_tokens(F.col("text"))).alias("tkn_text")).groupBy("tkn_text").agg(F.count("*").alias("tkn_count"))


@query("SELECT tkn_text, tkn_count FROM (SELECT tkn_text, count(*) AS tkn_count, min(pos) AS pos FROM elem GROUP BY tkn_text) WHERE pos = 0")
def token_type_filter(spark, sf_dir):
    return messages.token_filter(token_dictionary(spark, sf_dir), "HOSTNAME").select("tkn_text", "tkn_count")


@query("SELECT tkn_text FROM (SELECT DISTINCT host AS tkn_text FROM msg) WHERE regexp_matches(tkn_text, '^(?:user1[0-9]$)')")
def comp_query(spark, sf_dir):
    return messages.component_query(token_dictionary(spark, sf_dir), "user1[0-9]$").select("tkn_text")


@query("SELECT host AS tkn_text, 255 + row_number() OVER (ORDER BY host) AS tkn_id FROM (SELECT DISTINCT host FROM msg)")
def host_ids(spark, sf_dir):
    ids = patterns.with_token_ids(token_dictionary(spark, sf_dir))
    return ids.where(X.has_mask(F.col("type_mask"), "HOSTNAME")).select("tkn_text", "tkn_id")


@query("SELECT 256 AS comp_id_min, 255 + count(DISTINCT host) AS comp_id_max FROM msg")
def comp_id_range(spark, sf_dir):
    return messages.component_range(patterns.with_token_ids(token_dictionary(spark, sf_dir)))


@query("SELECT * FROM ptns")
def pattern_summary(spark, sf_dir):
    return patterns.patterns(typed_events(spark, sf_dir))


@query("SELECT ptn, 255 + row_number() OVER (ORDER BY first_seen, ptn) AS ptn_id FROM ptns")
def pattern_ids(spark, sf_dir):
    return patterns.with_pattern_ids(pattern_summary(spark, sf_dir)).select("ptn", "ptn_id")


def _order_queries() -> None:
    for name, sql in (("msg_count_desc", "msg_count DESC"), ("first_seen", "first_seen"), ("last_seen_desc", "last_seen DESC"), ("tkn_count_desc", "tkn_count DESC"), ("eng_ratio", "eng_ratio DESC")):
        ratio = "len(list_filter(regexp_extract_all(ptn, '(<[a-z0-9]+>|\\w+|.)', 1), lambda t: regexp_full_match(t, '\\w+')))::DOUBLE / len(regexp_extract_all(ptn, '(<[a-z0-9]+>|\\w+|.)', 1))"

        def top(s, d, name=name):
            ptns = pattern_summary(s, d).withColumn("eng_ratio", patterns.english_ratio(F.col("ptn")))
            return ptns.orderBy(*patterns.order_of(name)).limit(3).select("ptn", "msg_count", "eng_ratio")

        query(f"SELECT ptn, msg_count, eng_ratio FROM (SELECT *, {ratio} AS eng_ratio FROM ptns) ORDER BY {sql}, ptn LIMIT 3", f"pattern_order_{name}")(top)


_order_queries()


@query("SELECT ptn, pos, tkn_text, count(*) AS tkn_count FROM elem WHERE regexp_full_match(tkn_text, '[0-9]+') OR pos = 0 GROUP BY ALL")
def pattern_tokens(spark, sf_dir):
    return patterns.pattern_tokens(typed_events(spark, sf_dir))


@query("SELECT ptn, pos, count(DISTINCT tkn_text) AS n_tokens, count(*) AS tkn_count FROM elem GROUP BY ptn, pos")
def position_tokens(spark, sf_dir):
    return patterns.position_tokens(typed_events(spark, sf_dir)).groupBy("ptn", "pos").agg(F.count("*").alias("n_tokens"), F.sum("tkn_count").alias("tkn_count"))


@query("SELECT ptn, msg_count, match_pos FROM ptns JOIN (SELECT ptn, string_agg(pos, ',' ORDER BY pos) AS match_pos FROM (SELECT DISTINCT ptn, pos FROM elem WHERE tkn_text = '42') GROUP BY ptn) USING (ptn)")
def pattern_match(spark, sf_dir):
    return patterns.patterns_with_token(typed_events(spark, sf_dir), "42")


@query("SELECT ptn, msg_count FROM ptns WHERE regexp_matches(ptn, '^(?:.*(click|view))')")
def ptn_regex_query(spark, sf_dir):
    return messages.pattern_filter(pattern_summary(spark, sf_dir), regex=".*(click|view)").select("ptn", "msg_count")


@query("SELECT ptn, ptn_id FROM (SELECT ptn, 255 + row_number() OVER (ORDER BY first_seen, ptn) AS ptn_id FROM ptns) WHERE ptn_id = 256 OR ptn_id BETWEEN 258 AND 259")
def id_set_filter(spark, sf_dir):
    return messages.pattern_filter(pattern_ids(spark, sf_dir), ids="256,258-259")


def _message_queries() -> None:
    for name, args, sql in (
        ("ptn", {"ptn": PTN}, f"ptn = '{PTN}'"),
        ("comp", {"host": "user7"}, "host = 'user7'"),
        ("time", {"begin_us": T0 * 10**6, "end_us": T1 * 10**6}, f"epoch_us BETWEEN {T0}000000 AND {T1}000000"),
        ("mixed", {"ptn": PTN, "host": "user7", "begin_us": T0 * 10**6}, f"ptn = '{PTN}' AND host = 'user7' AND epoch_us >= {T0}000000"),
    ):
        query(f"SELECT event_id, epoch_us, host, ptn, body FROM msg WHERE {sql}", f"msg_filter_{name}")(lambda s, d, args=args: messages.message_filter(with_pattern(s, d), **args).select("event_id", "epoch_us", "host", "ptn", "body"))
    for way, op, order in (("fwd", ">=", ""), ("rev", "<=", "DESC")):
        query(f"SELECT epoch_us, host, ptn, body, event_id FROM msg WHERE epoch_us {op} {T0}000000 ORDER BY epoch_us {order}, event_id {order} LIMIT 1", f"msg_seek_{way}")(lambda s, d, f=way == "fwd": messages.seek(with_pattern(s, d).select("event_id", "epoch_us", "host", "ptn", "body"), {"epoch_us": T0 * 10**6}, f))


_message_queries()


@query("SELECT event_id, epoch_us, host FROM msg ORDER BY epoch_us, host, event_id LIMIT 100")
def msg_limit(spark, sf_dir):
    return messages.limited(events_as_messages(spark, sf_dir), 100, ["epoch_us", "host", "event_id"]).select("event_id", "epoch_us", "host")


@query(f"SELECT event_id, epoch_us, host FROM msg WHERE (epoch_us, host, event_id) > ({T0}000000, 'user3', 0) ORDER BY epoch_us, host, event_id LIMIT 50")
def msg_page(spark, sf_dir):
    order = ["epoch_us", "host", "event_id"]
    return messages.page(events_as_messages(spark, sf_dir).select(*order), order, 50, {"epoch_us": T0 * 10**6, "host": "user3", "event_id": 0})


@query(f"SELECT count(*) AS msg_count FROM msg WHERE epoch_us // 1000000 >= {T0} AND epoch_us // 1000000 < {T1}")
def msg_count_range(spark, sf_dir):
    rows = with_pattern(spark, sf_dir)
    return histograms.message_count(histograms.pattern_hist(rows), pattern_plain(rows), None, T0, T1)


@query(f"SELECT count(*) AS msg_count FROM msg WHERE ptn = '{PTN}'")
def msg_count_ptn(spark, sf_dir):
    rows = with_pattern(spark, sf_dir)
    return histograms.message_count(histograms.pattern_hist(rows), pattern_plain(rows), PTN)


def pattern_plain(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ptn").agg(F.count("*").alias("msg_count"))


@query("SELECT count(*) AS ptn_count, CAST(sum(msg_count) AS BIGINT) AS msg_count, min(first_seen) AS first_us, max(last_seen) AS last_us, CAST(sum(msg_count) // count(*) AS BIGINT) AS msg_per_ptn FROM ptns")
def summary(spark, sf_dir):
    return messages.summary(pattern_summary(spark, sf_dir))


@query("SELECT count(DISTINCT ptn) AS ptn_count, CAST(sum(msg_count) AS BIGINT) AS msg_count, min(epoch) AS first_epoch, max(epoch) AS last_epoch FROM comp WHERE bin_width = 3600 AND host = 'user7'")
def summary_filtered(spark, sf_dir):
    return messages.filtered_summary(comp_hist(spark, sf_dir).where("host = 'user7'"))


@query(f"SELECT host, CAST(sum(msg_count) AS BIGINT) AS msg_count, sum(msg_count)::DOUBLE / (SELECT sum(msg_count) FROM comp WHERE bin_width = 3600 AND ptn = '{PTN}' AND epoch BETWEEN {T0} AND {T1}) AS share FROM comp WHERE bin_width = 3600 AND ptn = '{PTN}' AND epoch BETWEEN {T0} AND {T1} GROUP BY host")
def comp_dist(spark, sf_dir):
    return histograms.component_distribution(comp_hist(spark, sf_dir), PTN, 3600, T0, T1)


@query("SELECT ptn, count(*) AS n, string_agg(epoch, ',' ORDER BY epoch) AS x, string_agg(c, ',' ORDER BY epoch) AS y FROM (SELECT ptn, epoch, CAST(sum(msg_count) AS BIGINT) AS c FROM comp WHERE bin_width = 86400 GROUP BY ptn, epoch) GROUP BY ptn")
def hist_series(spark, sf_dir):
    hist = histograms.pattern_hist(with_pattern(spark, sf_dir), total=False).where("bin_width = 86400")
    return histograms.series(hist, ["ptn"], "msg_count").select("ptn", "n", F.concat_ws(",", F.col("x").cast("array<string>")).alias("x"), F.concat_ws(",", F.col("y").cast("array<string>")).alias("y"))


@query("SELECT max(epoch) - min(epoch) AS seconds FROM comp WHERE bin_width = 60")
def hist_duration(spark, sf_dir):
    return histograms.duration(histograms.pattern_hist(with_pattern(spark, sf_dir)).where("bin_width = 60"))


@query("SELECT bin_width, epoch, ptn, msg_count FROM (SELECT bin_width, epoch, ptn, CAST(sum(CASE WHEN host = 'user7' THEN 0 ELSE msg_count END) AS BIGINT) AS msg_count FROM comp GROUP BY ALL) WHERE msg_count > 0")
def hist_retract(spark, sf_dir):
    rows = with_pattern(spark, sf_dir)
    taken = histograms.pattern_hist(rows.where("host = 'user7'"), total=False).withColumn("msg_count", -F.col("msg_count"))
    return histograms.merged_counts(histograms.pattern_hist(rows, total=False), taken, ["bin_width", "epoch", "ptn"], "msg_count")


@query("SELECT * FROM tags UNION SELECT * FROM more")
def attr_add(spark, sf_dir):
    return attributes.add(tag_table(spark, TAGS), tag_table(spark, MORE))


@query("SELECT * FROM tags EXCEPT SELECT * FROM gone")
def attr_rm(spark, sf_dir):
    return attributes.remove(tag_table(spark, TAGS), tag_table(spark, GONE))


@query("SELECT * FROM tags WHERE (ptn_id, attr_type) NOT IN (SELECT (ptn_id, attr_type) FROM more) UNION SELECT * FROM more")
def attr_set(spark, sf_dir):
    return attributes.set_values(tag_table(spark, TAGS), tag_table(spark, MORE))


@query("SELECT * FROM tags WHERE NOT (ptn_id = 258 AND attr_type = 'kind')")
def attr_unset(spark, sf_dir):
    return attributes.unset(tag_table(spark, TAGS), 258, "kind")


@query("SELECT ptn_id, attr_type, min(attr_value) AS attr_value FROM tags GROUP BY ALL")
def attr_get(spark, sf_dir):
    return attributes.get(tag_table(spark, TAGS))


@query("SELECT ptn_id, string_agg(attr_type || '=' || attr_value, ',' ORDER BY attr_type || '=' || attr_value) AS attrs FROM tags GROUP BY ptn_id")
def attr_list(spark, sf_dir):
    return attributes.listed(tag_table(spark, TAGS))


@query("SELECT DISTINCT attr_value FROM tags WHERE attr_type = 'kind'")
def attr_values(spark, sf_dir):
    return attributes.values_of(tag_table(spark, TAGS), "kind")


@query("SELECT ptn, ptn_id FROM (SELECT ptn, 255 + row_number() OVER (ORDER BY first_seen, ptn) AS ptn_id FROM ptns) WHERE ptn_id IN (SELECT ptn_id FROM tags WHERE attr_type = 'kind' AND attr_value = 'odd')")
def patterns_tagged(spark, sf_dir):
    return attributes.patterns_tagged(pattern_ids(spark, sf_dir), tag_table(spark, TAGS), "kind", "odd")


@query(f"SELECT epoch, host, CAST(sum(msg_count) AS BIGINT) AS cnt FROM comp WHERE bin_width = 3600 AND ptn = '{PTN}' GROUP BY ALL")
def hist_to_array(spark, sf_dir):
    return arrays.hist_to_array(comp_hist(spark, sf_dir), 3600, ptn=PTN)


@query("SELECT x, y, least(a.cnt, b.cnt) AS cnt FROM cells a JOIN cells b USING (x, y) WHERE a.name = 'click' AND b.name = 'view'")
def array_intersect(spark, sf_dir):
    c = cells(spark, sf_dir)
    return arrays.intersect(c.where("name = 'click'"), c.where("name = 'view'"))


@query("SELECT CAST(coalesce(sum(m), 0) AS BIGINT) AS support FROM (SELECT min(cnt) AS m FROM (SELECT name, x // 24 AS x, y, sum(cnt) AS cnt FROM cells GROUP BY ALL) WHERE name IN ('click', 'view', 'error') GROUP BY x, y HAVING count(*) = 3)")
def support(spark, sf_dir):
    return arrays.support(daily(spark, sf_dir), ["click", "view", "error"])


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("name", F.floor(F.col("x") / 24).alias("x"), "y").agg(F.sum("cnt").alias("cnt"))


@query("SELECT name, CAST(sum(cnt) AS BIGINT) AS total_count, count(*) AS cell_count FROM cells GROUP BY name")
def array_totals(spark, sf_dir):
    return arrays.totals(cells(spark, sf_dir))


@query("""SELECT CAST(floor((y - y0) / yb) AS BIGINT) AS row, CAST(floor((x - x0) / xb) AS BIGINT) AS col, CAST(sum(cnt) AS BIGINT) AS cnt FROM cells,
  (SELECT x0, y0, ceil((x1 - x0 + 1) / 64) AS xb, ceil((y1 - y0 + 1) / 64) AS yb FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells)) GROUP BY ALL""")
def heat_map(spark, sf_dir):
    return arrays.heat_map(cells(spark, sf_dir))


_ITEMS, _TARGETS = ["click", "view", "purchase", "signup"], ["error"]


@query("""SELECT lhs, rhs, 1 AS depth, ab::DOUBLE / a AS conf, ab::DOUBLE / b AS sig FROM (
  SELECT i.name AS lhs, 'error' AS rhs, CAST(sum(least(i.cnt, t.cnt)) AS BIGINT) AS ab FROM d i JOIN d t USING (x, y) WHERE i.name <> 'error' AND t.name = 'error' GROUP BY i.name)
  JOIN (SELECT name AS lhs, CAST(sum(cnt) AS BIGINT) AS a FROM d GROUP BY name) USING (lhs) JOIN (SELECT name AS rhs, CAST(sum(cnt) AS BIGINT) AS b FROM d GROUP BY name) USING (rhs)
  WHERE ab::DOUBLE / b >= 0.1 AND ab::DOUBLE / a >= 0.3""")
def assoc_rules_single(spark, sf_dir):
    return association.mine(weekly(spark, sf_dir), _ITEMS, _TARGETS, conf=0.3, sig=0.1, diff=0.05, max_depth=1)


SQL["assoc_rules_single"] = SQL["assoc_rules_single"].replace(" SELECT lhs, rhs, 1", ", d AS (SELECT name, x // 168 AS x, y, sum(cnt) AS cnt FROM cells GROUP BY ALL) SELECT lhs, rhs, 1", 1)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).groupBy("name", F.floor(F.col("x") / 168).alias("x"), "y").agg(F.sum("cnt").alias("cnt"))


@query()
def assoc_rules(spark, sf_dir):
    return association.mine(weekly(spark, sf_dir), _ITEMS, _TARGETS, conf=0.7, sig=0.05, diff=0.05)


@query("""SELECT l_returnflag, count(*) AS n, min(v) AS min, max(v) AS max, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS sd, max(v) FILTER (WHERE r = (c - 1) // 4) AS q1, max(v) FILTER (WHERE r = (c - 1) // 2) AS median, max(v) FILTER (WHERE r = 3 * (c - 1) // 4) AS q3
  FROM (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS r, count(*) OVER (PARTITION BY l_returnflag) AS c FROM lineitem) GROUP BY l_returnflag""")
def numeric_stats(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_returnflag", "l_extendedprice")
    return numeric.profile(rows, "l_extendedprice", ["l_returnflag"]).select("l_returnflag", "n", "min", "max", F.round("mean", 4).alias("mean"), F.round("sd", 4).alias("sd"), "q1", "median", "q3")


@query("""WITH v AS (SELECT c_acctbal AS v, row_number() OVER (ORDER BY c_acctbal) - 1 AS r, count(*) OVER () AS c FROM customer), m AS (SELECT max(v) AS m FROM v WHERE r = (c - 1) // 2),
a AS (SELECT abs(v - m) AS d, row_number() OVER (ORDER BY abs(v - m)) - 1 AS r, c FROM v, m) SELECT (SELECT m FROM m) AS median, (SELECT max(d) FROM a WHERE r = (c - 1) // 2) AS mad""")
def numeric_mad(spark, sf_dir):
    return numeric.profile(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_acctbal").select("median", "mad")


@query("WITH v AS (SELECT o_totalprice AS v FROM orders ORDER BY o_totalprice LIMIT 1 OFFSET 1000) SELECT v FROM v")
def nth_element(spark, sf_dir):
    return numeric.nth(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_totalprice", 1000)


@query(f"SELECT score, count(*) AS ptn_count, CAST(sum(msg_count) AS BIGINT) AS msg_count FROM (SELECT msg_count, {' + '.join(f"CASE WHEN regexp_matches(ptn, '(?i){p}') THEN {w}::DOUBLE ELSE 0 END" for p, w in WEIGHTS)} AS score FROM ptns) WHERE score >= 1 GROUP BY score")
def weighted_patterns(spark, sf_dir):
    ptns = pattern_plain(with_pattern(spark, sf_dir)).withColumn("score", X.keyword_score(F.col("ptn"), WEIGHTS))
    return ptns.where("score >= 1").groupBy("score").agg(F.count("*").alias("ptn_count"), F.sum("msg_count").alias("msg_count"))


@query("WITH b AS (SELECT CASE WHEN l_quantity >= 40 THEN 4 WHEN l_quantity >= 25 THEN 3 WHEN l_quantity >= 10 THEN 2 WHEN l_quantity >= 5 THEN 1 ELSE 0 END AS bin FROM lineitem) SELECT bin, count(*) AS n FROM b GROUP BY bin")
def metric_bins(spark, sf_dir):
    _, bin_ = X.metric_bin(F.col("l_quantity"), "quantity:5,10,25,40")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def _stores(rows: DataFrame) -> list[DataFrame]:
    return [rows.where(F.col("user_id") % 4 == i) for i in range(4)]


@query("SELECT * FROM ptns")
def federate_patterns(spark, sf_dir):
    return federation.patterns([patterns.patterns(s) for s in _stores(typed_events(spark, sf_dir))])


@query("SELECT tkn_text, count(*) AS tkn_count FROM elem GROUP BY tkn_text")
def federate_tokens(spark, sf_dir):
    return federation.tokens([patterns.token_dictionary(s) for s in _stores(events_as_messages(spark, sf_dir))]).select("tkn_text", "tkn_count")


@query("SELECT * FROM comp")
def federate_hist(spark, sf_dir):
    rows = with_pattern(spark, sf_dir)
    parts = histograms.parts_of(rows.count())
    return federation.hist([histograms.component_hist(s, parts=parts) for s in _stores(rows)], "msg_count")


@query("SELECT event_id, epoch_us, host, user_id % 4 AS store FROM msg")
def federate_messages(spark, sf_dir):
    return federation.messages([s.select("event_id", "epoch_us", "host") for s in _stores(events_as_messages(spark, sf_dir))])


@query(f"SELECT old_ptn, new_ptn, count(*) AS msg_count FROM (SELECT {_pattern_sql(FEWER)} AS old_ptn, {_pattern_sql(WORDS)} AS new_ptn FROM ev) WHERE old_ptn <> new_ptn GROUP BY ALL")
def reprocess_delta(spark, sf_dir):
    return patterns.retyped(events_as_messages(spark, sf_dir), FEWER, WORDS)


@query()
def meta_cluster(spark, sf_dir):
    kinds = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat_ws(" ", F.lit("<host>"), "p_brand", "p_type").alias("ptn")).distinct()
    return clusters.meta_clusters(kinds.unionByName(pattern_plain(with_pattern(spark, sf_dir)).select("ptn")))


@query("SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\n$', ''), '[\\x00-\\x1F\\x7F]', 'X', 'g'), '[\\x{80}-\\x{7FF}]', 'XX', 'g'), '[\\x{800}-\\x{FFFF}]', 'XXX', 'g'), '[^\\x00-\\x7F]', 'XXXX', 'g') AS line FROM documents")
def sanitize(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.sanitize(F.col("text")).alias("line"))


@query("WITH p AS (SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1) SELECT p_partkey, CAST(distance AS INTEGER) AS distance FROM p")
def id_distance(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.transform(F.split("p_name", ""), lambda c: F.ascii(c)).alias("ids"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("ids").alias("next"))
    return part.join(after, "p_partkey").select("p_partkey", levenshtein_ids("ids", "next").alias("distance"))


# log lines made of the events: three headers, and a body whose tokens have many types
_CLASSES = [
    (T.NUMBER["IP4_ADDR"], r"\d{1,3}(?:\.\d{1,3}){3}"),
    (T.NUMBER["FLOAT"], r"[0-9]+\.[0-9]*"),
    (T.NUMBER["HEX_INT"], r"0x[0-9a-f]+"),
    (T.NUMBER["TEXT"], r"[A-Za-z_][A-Za-z0-9\-_.]*[A-Za-z0-9\-_]|[A-Za-z]"),
    (T.NUMBER["DEC_INT"], r"[0-9]+"),
    (T.NUMBER["PATH"], r"(?:/[A-Za-z0-9_\-~.]+)+"),
    (T.NUMBER["WHITESPACE"], r"\s+"),
    (T.NUMBER["SEPARATOR"], r"."),
]
_LEXED = f"regexp_extract_all(body, '({'|'.join(c for _, c in _CLASSES)})', 1)"
_TYPE = "CASE " + " ".join(f"WHEN regexp_full_match(t, '{c}') THEN {n}" for n, c in _CLASSES) + " END"
LINES = f"""{VIEWS}, lin AS (SELECT event_id, event_type AS kind, ts, 'node' || user_id AS host,
  event_type || ' from 10.0.' || user_id % 256 || '.7 at /var/log/u' || user_id || ' took ' || CAST(floor(value) AS BIGINT) || '.5 of 0x' || lower(hex(user_id)) || ' ' || props AS body FROM events)"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``event_id, host, body, line``: clicks with an ISO time, views with a local one, the rest with a short one."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts, user = F.col("ts").cast("timestamp_ntz"), F.col("user_id").cast("string")
    number = F.floor("value").cast("long").cast("string")
    body = F.concat("event_type", F.lit(" from 10.0."), (F.col("user_id") % 256).cast("string"), F.lit(".7 at /var/log/u"), user, F.lit(" took "), number, F.lit(".5 of 0x"), F.lower(F.hex("user_id")), F.lit(" "), "props")
    host = F.concat(F.lit("node"), user)
    time = F.when(F.col("event_type") == "click", F.concat(F.lit("1 "), F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))).when(F.col("event_type") == "view", F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(ts, "MMM d HH:mm:ss"))
    return events.select("event_id", host.alias("host"), body.alias("body"), F.concat(F.lit("<1>"), time, F.lit(" "), host, F.lit(" "), body).alias("line"))


@query(f"""WITH {LINES} SELECT event_id, CASE kind WHEN 'click' THEN epoch_us(ts) ELSE epoch_us(date_trunc('second', ts)) END AS epoch_us, host, body,
  CASE kind WHEN 'click' THEN 'versioned' ELSE 'priority' END AS format FROM lin""")
def parse_headers(spark, sf_dir):
    rows = event_lines(spark, sf_dir).select("event_id", lexer.header(F.col("line")).alias("h"))
    return rows.select("event_id", lexer.epoch_us(F.col("h.ts"), 2024).alias("epoch_us"), "h.host", "h.body", "h.format")


@query(f"WITH {LINES} SELECT {_TYPE} AS type, count(*) AS tkn_count, count(DISTINCT t) AS n_tokens FROM (SELECT unnest({_LEXED}) AS t FROM lin) GROUP BY 1")
def lex_syslog(spark, sf_dir):
    tokens = event_lines(spark, sf_dir).select(F.explode(lexer.tokens(F.col("body"))).alias("t")).groupBy("t.text", "t.type").agg(F.count("*").alias("n"))
    return tokens.groupBy("type").agg(F.sum("n").alias("tkn_count"), F.count("*").alias("n_tokens"))


_SHOWN = " ".join(f"WHEN {n} THEN {x}" for n, x in [(8, "'<ip4>'"), (13, "'<float>'"), (11, "'<hex>'"), (12, "'<dec>'"), (15, "'<path>'"), (19, "' '"), (18, "t")])


@query(f"""WITH {LINES} SELECT ptn, count(*) AS msg_count FROM (SELECT '<host> ' || array_to_string(list_transform({_LEXED},
  lambda t: CASE WHEN t IN ({_quoted(WORDS)}) THEN t ELSE CASE {_TYPE} {_SHOWN} ELSE '*' END END), '') AS ptn FROM lin) GROUP BY ptn""")
def typed_patterns(spark, sf_dir):
    return patterns.typed(event_lines(spark, sf_dir), WORDS, grammar="syslog").groupBy("ptn").agg(F.count("*").alias("msg_count"))


@query("SELECT event_id, epoch_us(ts) - 19800000000 AS epoch_us, strftime(ts + INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%S.%f') || '+05:30' AS text, epoch_us(ts) // 60000000 * 60 - 19800 AS minute, epoch_us(ts) // 1000000 AS loose FROM events")
def time_arguments(spark, sf_dir):
    rows = events_as_messages(spark, sf_dir).select("event_id", "epoch_us", times.format_time(F.col("epoch_us"), "Asia/Kolkata").alias("text"))
    plain = times.format_time(F.col("epoch_us"))
    parsed = times.parse_time(F.substring(plain, 1, 26), "Asia/Kolkata")
    minute = F.replace(F.replace(F.substring(plain, 1, 16), F.lit("-"), F.lit("/")), F.lit("T"), F.lit(" "))
    loose = times.parse_loose(F.replace(F.substring(plain, 1, 19), F.lit("T"), F.lit(" ")))
    return rows.select("event_id", parsed.alias("epoch_us"), "text", times.parse_date(minute, "Asia/Kolkata").alias("minute"), loose.alias("loose"))


@query("SELECT p_partkey, p_name AS name, p_brand AS brand FROM part")
def query_string(spark, sf_dir):
    text = F.concat(F.lit("name="), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("&brand="), F.url_encode("p_brand"))
    fields = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", times.query_fields(text).alias("f"))
    return fields.select("p_partkey", F.col("f.value")[0].alias("name"), F.col("f.value")[1].alias("brand"))


@query(f"SELECT event_id, epoch_us, host FROM msg WHERE ptn = '{PTN}' ORDER BY ptn, epoch_us, host, event_id LIMIT 20")
def msg_order(spark, sf_dir):
    rows = messages.message_filter(with_pattern(spark, sf_dir), ptn=PTN)
    return messages.limited(rows, 20, messages.message_order(ptn=PTN) + ["event_id"]).select("event_id", "epoch_us", "host")


@query(f"SELECT event_id, epoch_us, host FROM msg WHERE (epoch_us, host, event_id) < ({T1}000000, 'user3', 0) ORDER BY epoch_us DESC, host DESC, event_id DESC LIMIT 50")
def msg_page_up(spark, sf_dir):
    order = ["epoch_us", "host", "event_id"]
    return messages.page_up(events_as_messages(spark, sf_dir).select(*order), order, 50, {"epoch_us": T1 * 10**6, "host": "user3", "event_id": 0})


@query("SELECT ptn, msg_count, first_seen FROM ptns WHERE first_seen BETWEEN 1704067210000000 AND 1704153600000000")
def ptn_filter_time(spark, sf_dir):
    return messages.pattern_filter(pattern_summary(spark, sf_dir), 1704067210000000, 1704153600000000).select("ptn", "msg_count", "first_seen")


@query("SELECT ptn, msg_count FROM (SELECT *, len(list_filter(regexp_extract_all(ptn, '(<[a-z0-9]+>|\\w+|.)', 1), lambda t: regexp_full_match(t, '\\w+')))::DOUBLE / len(regexp_extract_all(ptn, '(<[a-z0-9]+>|\\w+|.)', 1)) AS r FROM ptns) ORDER BY r, ptn LIMIT 3")
def pattern_order_eng_asc(spark, sf_dir):
    ptns = pattern_summary(spark, sf_dir).withColumn("eng_ratio", patterns.english_ratio(F.col("ptn")))
    return ptns.orderBy(*patterns.order_of("eng_asc")).limit(3).select("ptn", "msg_count")


@query(f"SELECT epoch, tkn_count FROM (SELECT epoch_us // 1000000 // 3600 * 3600 AS epoch, count(*) AS tkn_count FROM elem WHERE tkn_text = 'error' GROUP BY ALL) WHERE epoch BETWEEN {T0} AND {T1}")
def tkn_hist_filter(spark, sf_dir):
    hist = histograms.token_hist(typed_events(spark, sf_dir))
    return histograms.hist_filter(hist, 3600, T0, T1, tkn_text="error").select("epoch", "tkn_count")


@query(f"SELECT epoch, CAST(sum(msg_count) AS BIGINT) AS msg_count FROM comp WHERE bin_width = 60 AND ptn = '{PTN}' AND epoch BETWEEN {T0} AND {T1} GROUP BY epoch")
def ptn_hist_filter(spark, sf_dir):
    hist = histograms.pattern_hist(with_pattern(spark, sf_dir))
    return histograms.hist_filter(hist, 60, T0, T1, ptn=PTN).select("epoch", "msg_count")


@query(f"SELECT * FROM comp WHERE (bin_width, epoch, host) >= (3600, {T0}, 'user7') ORDER BY bin_width, epoch, host, ptn, msg_count LIMIT 1")
def hist_seek(spark, sf_dir):
    return messages.seek(comp_hist(spark, sf_dir), {"bin_width": 3600, "epoch": T0, "host": "user7"})


@query(f"SELECT ptn, CAST(sum(msg_count) AS BIGINT) AS msg_count FROM comp WHERE bin_width = 86400 AND epoch BETWEEN {T0} AND {T1} GROUP BY ptn")
def hist_auto_bin(spark, sf_dir):
    hist = histograms.pattern_hist(with_pattern(spark, sf_dir), total=False)
    return histograms.hist_filter(hist, X.auto_bin_width(T1 - T0), T0, T1).groupBy("ptn").agg(F.sum("msg_count").alias("msg_count"))


@query("SELECT * FROM tags WHERE attr_type = 'kind' AND attr_value = 'even'")
def tag_filter(spark, sf_dir):
    return attributes.tag_filter(tag_table(spark, TAGS), attr_type="kind", attr_value="even")


@query("SELECT * FROM tags WHERE (attr_type, attr_value) <= ('kind', 'odd') ORDER BY attr_type DESC, attr_value DESC, ptn_id DESC LIMIT 1")
def tag_seek(spark, sf_dir):
    return messages.seek(tag_table(spark, TAGS), {"attr_type": "kind", "attr_value": "odd"}, forward=False)


@query("WITH r AS (SELECT unnest(range(256, 261)) AS ptn_id UNION ALL SELECT unnest(range(300, 303))) SELECT ptn_id, 'kind' AS attr_type, 'ranged' AS attr_value FROM r")
def tag_id_ranges(spark, sf_dir):
    return attributes.tag_ids(tag_table(spark, TAGS), X.parse_id_set("256-258,258-260,300-302"), "kind", "ranged")


@query("SELECT tkn_text, count(*) AS tkn_count FROM elem WHERE tkn_text = 'error' GROUP BY tkn_text")
def tkn_find(spark, sf_dir):
    return token_dictionary(spark, sf_dir).where("tkn_text = 'error'").select("tkn_text", "tkn_count")


def _parts_as_dictionary(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col(text).alias("tkn_text"), F.col("p_size").cast("long").alias("tkn_id"), F.col("p_partkey").alias("seq"))


@query("SELECT CAST(p_size AS BIGINT) AS tkn_id, arg_max(p_name, p_partkey) AS tkn_text FROM part GROUP BY p_size")
def tkn_alias(spark, sf_dir):
    return lines.last_of_alias(_parts_as_dictionary(spark, sf_dir, "p_name"))


@query("SELECT p_brand AS tkn_text, count(DISTINCT p_size) AS n FROM part GROUP BY p_brand HAVING n > 1")
def tkn_id_conflicts(spark, sf_dir):
    return lines.conflicting_ids(_parts_as_dictionary(spark, sf_dir, "p_brand"))


@query(f"""WITH {VIEWS}, d AS ({SQL["token_dictionary"].split(VIEWS, 1)[1]}) SELECT CAST(log2(type_mask & -type_mask) AS INTEGER) + 1 AS type, count(*) AS n_tokens FROM d GROUP BY 1""")
def tkn_first_types(spark, sf_dir):
    return token_dictionary(spark, sf_dir).groupBy(X.first_type(F.col("type_mask")).alias("type")).agg(F.count("*").alias("n_tokens"))


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CASE WHEN p > '20' AND p < '7F' THEN chr(CAST('0x' || p AS INTEGER)) ELSE '\x' || p END), '') AS text FROM documents""")
def escape_bytes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", X.escaped(F.col("text")).alias("text"))


@query("SELECT n_name || ' is in ' || n_regionkey AS text FROM nation")
def row_format(spark, sf_dir):
    return lines.formatted(spark.read.parquet(f"{sf_dir}/nation.parquet"), "%(n_name)s is in %(n_regionkey)s")


@query("""SELECT a.id AS local_id, b.id AS tkn_id FROM (SELECT host, 255 + row_number() OVER (ORDER BY host) AS id FROM (SELECT DISTINCT host FROM msg WHERE user_id % 4 = 0)) a
  JOIN (SELECT host, 255 + row_number() OVER (ORDER BY host) AS id FROM (SELECT DISTINCT host FROM msg)) b USING (host)""")
def store_id_map(spark, sf_dir):
    rows = events_as_messages(spark, sf_dir)
    hosts = lambda r: patterns.with_token_ids(patterns.token_dictionary(r)).where(X.has_mask(F.col("type_mask"), "HOSTNAME"))
    return federation.id_map(hosts(_stores(rows)[0]), hosts(rows))



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
