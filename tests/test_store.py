import socket
import threading
import time

import pytest
from pyspark.sql import functions as F

from patternloom.plans.store import Store, union
from patternloom.sources import lines, udp
from patternloom.streaming import ingest

from .conftest import rows

WORDS = ["job", "started", "ended"]
A = [(1_600_000_000_000_000 + i * 10**6, f"h{i % 2}", f"job {i} started") for i in range(10)]
B = [(1_600_000_500_000_000 + i * 10**6, "h1", f"job {i} ended") for i in range(4)]
KIND = "epoch_us long, host string, body string"


def test_batches_merge(spark, tmp_path):
    one, two = Store(spark, f"{tmp_path}/one"), Store(spark, f"{tmp_path}/two")
    one.ingest(spark.createDataFrame(A, KIND), WORDS)
    one.ingest(spark.createDataFrame(B, KIND), WORDS)
    two.ingest(spark.createDataFrame(A + B, KIND), WORDS)
    for name in ("tokens", "patterns", "ptn_tkn", "tkn_hist", "ptn_hist", "comp_hist"):
        assert rows(one.table(name).drop("tkn_id", "ptn_id")) == rows(two.table(name).drop("tkn_id", "ptn_id")), name
    assert one.table("messages").count() == 14 and one.version == "2"
    assert union([one, two], "patterns").agg(F.sum("msg_count")).first()[0] == 28


def test_reprocess(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.ingest(spark.createDataFrame(A + B, KIND), ["job", "started"])
    before = rows(store.table("tkn_hist"))
    moved = rows(store.reprocess(WORDS))
    assert moved == [("<host> job <dec> *", "<host> job <dec> ended", 4)]
    counts = dict(store.table("patterns").select("ptn", "msg_count").collect())
    assert counts == {"<host> job <dec> started": 10, "<host> job <dec> ended": 4, "<host> job <dec> *": 0}
    assert rows(store.table("tkn_hist")) == before and store.table("messages").count() == 14
    assert rows(store.reprocess(WORDS)) == []


def test_batches_of_streams_count_once(spark, tmp_path):
    store, day = Store(spark, f"{tmp_path}/s"), spark.createDataFrame(A[:1], KIND)
    store.ingest(day, WORDS, 0, "x")
    store.replace("tags", spark.createDataFrame([(256, "kind", "odd")], "ptn_id long, attr_type string, attr_value string"))
    store.ingest(day, WORDS, 1, "x")
    store.reprocess(["job"])
    store.ingest(day, WORDS, 2, "x")
    store.ingest(day, WORDS, 2, "x")  # replayed
    store.ingest(day, WORDS, 0, "y")
    assert store.table("messages").count() == 4 and store.table("tags").count() == 1
    assert store.table("patterns").agg(F.sum("msg_count")).first()[0] == 4


def test_restarted_stream_repeats_no_batch(spark, tmp_path):
    import shutil

    (tmp_path / "in").mkdir()
    spark.createDataFrame(A, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/p0")
    store, run = Store(spark, f"{tmp_path}/s"), lambda: ingest.into_store(spark.readStream.schema(KIND).parquet(f"{tmp_path}/in/*"), store, f"{tmp_path}/c", WORDS).awaitTermination()
    run()
    shutil.rmtree(tmp_path / "c" / "commits")  # the store has the batch, the checkpoint does not
    run()
    assert store.table("messages").count() == 10


def test_unfinished_manifest_is_none(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.ingest(spark.createDataFrame(A, KIND), WORDS)
    (tmp_path / "s" / "_manifest-000000000002").write_text('{"version": "2", "tab')
    assert store.table("messages").count() == 10
    store.ingest(spark.createDataFrame(B, KIND), WORDS)
    assert store.table("messages").count() == 14


def test_ids_last(spark, tmp_path, monkeypatch):
    from patternloom.plans import store as store_module

    monkeypatch.setattr(store_module, "COMPACT", 2)
    store = Store(spark, f"{tmp_path}/s")
    store.add_dictionary(spark.createDataFrame([("alpha", 3_000_000, 1 << 16, 0), ("beta", 3_000_000, 1 << 16, 1), ("gamma", None, 1 << 16, 2)], "tkn_text string, tkn_id long, type_mask long, seq long"))
    assert rows(store.token_of([3_000_000])) == [(3_000_000, "beta")]
    store.ingest(spark.createDataFrame(A, KIND), WORDS)
    first = dict(store.table("patterns").select("ptn", "ptn_id").collect()) | dict(store.table("tokens").select("tkn_text", "tkn_id").collect())
    store.ingest(spark.createDataFrame([(5, "a0", "early 7 ended")], KIND), WORDS)  # earlier, and first by text
    later = dict(store.table("patterns").select("ptn", "ptn_id").collect()) | dict(store.table("tokens").select("tkn_text", "tkn_id").collect())
    assert first["<host> job <dec> started"] == 256 and later["<host> * <dec> ended"] == 257
    assert first["h0"] == 256 and later["a0"] == 258 and first["gamma"] == 3_000_001 and later["early"] > max(v for k, v in first.items() if v is not None)
    assert {k: later[k] for k in first} == first and None not in later.values()
    try:
        store.add_dictionary(spark.createDataFrame([("alpha", 5, 1 << 16, 0)], "tkn_text string, tkn_id long, type_mask long, seq long"))
        raise AssertionError
    except ValueError:
        pass


def test_queries_over_a_store(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.ingest(spark.createDataFrame(A + B, KIND), WORDS)
    store.replace("tags", spark.createDataFrame([(257, "kind", "end")], "ptn_id long, attr_type string, attr_value string"))
    assert [r["ptn_id"] for r in store.find_patterns(order="msg_count_desc").collect()] == [256, 257]
    assert [r["ptn_id"] for r in store.find_patterns(attr_type="kind").collect()] == [257]
    assert [r["ptn_id"] for r in store.find_patterns(token="9").collect()] == [256]
    assert {r["tkn_text"] for r in store.find_tokens("HOSTNAME").collect()} == {"h0", "h1"}
    assert store.find_messages(ptn_id=257, host="h1").count() == 4
    assert store.find_hist("ptn_hist", bin_width=86400).agg(F.sum("msg_count")).first()[0] == 14
    store.reject(spark.createDataFrame([("rubbish",)], "line string"))
    assert rows(store.table("rejected")) == [("rubbish",)]


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, part in enumerate((A, B)):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(f"{tmp_path}/in/p{i}")
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    store, whole = Store(spark, f"{tmp_path}/s"), Store(spark, f"{tmp_path}/w")
    ingest.into_store(source, store, f"{tmp_path}/c", WORDS).awaitTermination()
    whole.ingest(spark.createDataFrame(A + B, KIND), WORDS)
    assert rows(store.table("ptn_hist")) == rows(whole.table("ptn_hist")) and store.table("messages").count() == 14


def test_sources(spark, tmp_path):
    (tmp_path / "log").write_text("<1>1 2016-12-31T01:02:03Z n1 job 1 started\nrubbish\n")
    good, bad = lines.parsed(lines.read_lines(spark, f"{tmp_path}/log"))
    assert rows(good.select("host", "body")) == [("n1", "job 1 started")] and rows(bad) == [("rubbish",)]
    (tmp_path / "dict").write_text("# words\nalpha 7\nbeta 7\ngamma # plain\n\n")
    words = lines.read_dictionary(spark, f"{tmp_path}/dict", "WORD")
    assert rows(words.select("tkn_text", "tkn_id")) == [("alpha", 7), ("beta", 7), ("gamma", None)]
    assert rows(lines.last_of_alias(words)) == [(7, "beta")]
    (tmp_path / "types").write_text("a WORD,HOSTNAME\na TEXT\n")
    assert rows(lines.read_typed_tokens(spark, f"{tmp_path}/types")) == [("a", (1 << 16) | (1 << 4) | (1 << 19))]
    (tmp_path / "odd_types").write_text("a WORD,NOTYPE\n")
    with pytest.raises(Exception, match="unknown token type: NOTYPE"):
        lines.read_typed_tokens(spark, f"{tmp_path}/odd_types").collect()
    (tmp_path / "tags").write_text("256 kind odd one\nnothing\n")
    assert rows(lines.read_tags(spark, f"{tmp_path}/tags")) == [(256, "kind", "odd one")]
    (tmp_path / "m.csv").write_text("sec,usec,x,comp,y,load,temp\n5,0,0,3,0,1.5,20\n")
    assert rows(lines.read_metrics(spark, f"{tmp_path}/m.csv")) == [(5, 3, 1.5, "load"), (5, 3, 20.0, "temp")]
    assert lines.read_numeric(spark, f"{tmp_path}/m.csv", exclude=[0, 1, 2]).columns == ["comp", "y", "load", "temp"]
    assert lines.synthetic(spark, 10).count() == 10
    assert rows(lines.formatted(spark.createDataFrame([(1, "x")], "a int, b string"), "%(a)s:%(b)s")) == [("1:x",)]


def test_udp(spark, tmp_path):
    probe = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    probe.bind(("127.0.0.1", 0))
    port = probe.getsockname()[1]
    probe.close()
    udp.register(spark)
    out = spark.readStream.format("udp_lines").option("host", "127.0.0.1").option("port", port).load().writeStream.format("memory").queryName("udp_seen").option("checkpointLocation", f"{tmp_path}/c").start()

    def send():
        s = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        for i in range(200):
            s.sendto(f"line {i % 3}\n".encode(), ("127.0.0.1", port))
            time.sleep(0.05)

    threading.Thread(target=send, daemon=True).start()
    until = time.time() + 40
    while time.time() < until and spark.table("udp_seen").count() < 3:
        time.sleep(0.5)
    out.stop()
    assert {"line 0", "line 1", "line 2"} <= {r["value"] for r in spark.table("udp_seen").collect()}
