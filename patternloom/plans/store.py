"""A store: a folder of Parquet tables that batches add to, read as DataFrames.

Every batch writes new folders and then one new manifest, which names all folders of every table; so a batch is seen whole or
not at all, and a crash between leaves the store as it was. Counters are kept as the batches' own counts and summed when they are
read; now and then they are put together. Ids of tokens and patterns are given out once and only grow.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import types as T
from ..functions import text as X
from ..operators import federation, histograms, messages, patterns

VERSION = "2"
#: Folders of a counter table from which on a batch puts them together.
COMPACT = 16
SCHEMAS = {
    "messages": "epoch_us long, host string, body string, ptn string, dt string",
    "tokens": "tkn_text string, type_mask long, tkn_count long",
    "patterns": "ptn string, tkn_count long, msg_count long, first_seen long, last_seen long",
    "ptn_tkn": "ptn string, pos int, tkn_text string, tkn_count long",
    "tkn_hist": "bin_width int, epoch long, tkn_text string, tkn_count long",
    "ptn_hist": "bin_width int, epoch long, ptn string, msg_count long",
    "comp_hist": "bin_width int, epoch long, host string, ptn string, msg_count long",
    "tags": "ptn_id long, attr_type string, attr_value string",
    "attr_types": "attr_type string",
    "tkn_ids": "tkn_text string, tkn_id long, seq long",
    "ptn_ids": "ptn string, ptn_id long",
    "rejected": "line string",
}
_COUNT = {"ptn_tkn": "tkn_count", "tkn_hist": "tkn_count", "ptn_hist": "msg_count", "comp_hist": "msg_count"}
_SUMMED = [*_COUNT, "tokens", "patterns"]


def _columns(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


@dataclass
class Store:
    """Tables under ``path``. One writer at a time: of two that meet, the later one to commit fails and changes nothing."""

    spark: SparkSession
    path: str

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _state(self) -> dict:
        """What the newest whole manifest says."""
        fs, read = self._fs(), self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        for found in sorted(fs.globStatus(self._path("_manifest-*")) or [], key=lambda f: f.getPath().getName(), reverse=True):
            stream = fs.open(found.getPath())
            try:
                return json.loads(read.toString(stream, "UTF-8"))
            except json.JSONDecodeError:  # its writer was cut off
                continue
            finally:
                stream.close()
        return {"version": VERSION, "number": 0, "streams": {}, "tables": {}, "next": {"host": T.FIRST_HOST_ID, "token": T.FIRST_TOKEN_ID, "pattern": T.FIRST_PATTERN_ID, "seq": 0}}

    def _commit(self, state: dict) -> None:
        """A new manifest under a name that none has; an unfinished one of that number is no manifest and makes way."""
        fs = self._fs()
        state["number"] += 1
        at = self._path(f"_manifest-{state['number']:012d}")
        if fs.exists(at) and self._state()["number"] < state["number"]:
            fs.delete(at, False)
        out = fs.create(at, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()

    @property
    def version(self) -> str:
        return self._state()["version"]

    def _put(self, state: dict, name: str, rows: DataFrame, replace: bool = False, partition: str | None = None) -> None:
        at = f"{name}/{uuid.uuid4().hex}"
        writer = rows.select(*_columns(name)).write
        (writer.partitionBy(partition) if partition else writer).parquet(f"{self.path}/{at}")
        state["tables"][name] = [at] if replace else [*state["tables"].get(name, []), at]

    def _raw(self, state: dict, name: str) -> DataFrame:
        parts = [self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{at}") for at in state["tables"].get(name, [])]
        return federation.union(parts) if parts else self.spark.createDataFrame([], SCHEMAS[name])

    def _summed(self, state: dict, name: str) -> DataFrame:
        rows = self._raw(state, name)
        if name == "tokens":
            rows = federation.tokens([rows])
            fixed = X.has_mask(F.col("type_mask"), "WORD,HOSTNAME")
            return rows.withColumn("type_mask", F.when(fixed, F.col("type_mask").bitwiseAND(F.lit(~T.mask("TEXT")))).otherwise(F.col("type_mask")))
        if name == "patterns":
            return federation.patterns([rows])
        return federation.hist([rows], _COUNT[name]) if name in _COUNT else rows

    def table(self, name: str) -> DataFrame:
        """A table; an empty one where nothing has been written yet. Tokens and patterns come with their ids."""
        state = self._state()
        rows = self._summed(state, name)
        if name == "tokens":
            return rows.join(self._raw(state, "tkn_ids").select("tkn_text", "tkn_id"), "tkn_text", "left")
        return rows.join(self._raw(state, "ptn_ids"), "ptn", "left") if name == "patterns" else rows

    def replace(self, name: str, rows: DataFrame) -> None:
        """A table's new rows, which may be made from the old ones."""
        state = self._state()
        self._put(state, name, rows, replace=True)
        self._commit(state)

    def _number_tokens(self, state: dict, tokens: DataFrame) -> None:
        """Ids for those of ``tokens(tkn_text, type_mask)`` that have none yet, after the largest given out."""
        new = tokens.select("tkn_text", "type_mask").join(self._raw(state, "tkn_ids"), "tkn_text", "left_anti")
        host = X.has_mask(F.col("type_mask"), "HOSTNAME")
        for kind, rows in (("host", new.where(host)), ("token", new.where(~host))):
            found = patterns.numbered(rows.select("tkn_text"), ["tkn_text"], state["next"][kind], "tkn_id")
            self._ids(state, kind, found.withColumn("seq", F.lit(state["next"]["seq"]).cast("long")), "tkn_ids", "tkn_id")
        if state["next"]["host"] > T.FIRST_TOKEN_ID:
            raise ValueError("there are more hosts than ids below those of other tokens")

    def _ids(self, state: dict, kind: str, rows: DataFrame, table: str, column: str) -> None:
        self._put(state, table, rows)
        last = self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.path}/{state['tables'][table][-1]}").agg(F.max(column)).first()[0]
        if last is None:
            state["tables"][table].pop()
        else:
            state["next"][kind] = max(state["next"][kind], last + 1)

    def _number_patterns(self, state: dict, ptns: DataFrame) -> None:
        new = ptns.select("ptn", "first_seen").join(self._raw(state, "ptn_ids"), "ptn", "left_anti")
        self._ids(state, "pattern", patterns.numbered(new, ["first_seen", "ptn"], state["next"]["pattern"], "ptn_id"), "ptn_ids", "ptn_id")

    def add_dictionary(self, words: DataFrame) -> None:
        """Adds ``words(tkn_text, tkn_id, type_mask, seq)`` with a count of 0; a given id is kept, the others follow the largest.

        One id for several texts makes them aliases, see ``token_of``. A text that already has another id is an error.
        """
        state = self._state()
        given = words.where("tkn_id is not null").groupBy("tkn_text").agg(F.min("tkn_id").alias("tkn_id"), F.max("tkn_id").alias("other"), F.max("seq").alias("seq"))
        known = self._raw(state, "tkn_ids").select("tkn_text", F.col("tkn_id").alias("known"))
        checked = given.join(known, "tkn_text", "left")
        if clash := checked.where("tkn_id <> other or known <> tkn_id").select("tkn_text").first():
            raise ValueError(f"{clash[0]} has another id already")
        order = F.col("seq") + state["next"]["seq"] + 1
        last = words.agg(F.max("seq")).first()[0]
        self._ids(state, "token", checked.where("known is null").select("tkn_text", "tkn_id", order.alias("seq")), "tkn_ids", "tkn_id")
        state["next"]["seq"] += (last or 0) + 1
        self._number_tokens(state, words.groupBy("tkn_text").agg(F.bit_or("type_mask").alias("type_mask")))
        self._put(state, "tokens", words.groupBy("tkn_text").agg(F.bit_or("type_mask").cast("long").alias("type_mask"), F.lit(0).cast("long").alias("tkn_count")))
        self._commit(state)

    def token_of(self, ids: list[int]) -> DataFrame:
        """``tkn_id, tkn_text`` of some ids: of aliases the one added last."""
        rows = self._raw(self._state(), "tkn_ids").where(F.col("tkn_id").isin(ids))
        return rows.groupBy("tkn_id").agg(F.max_by("tkn_text", F.struct("seq", "tkn_text")).alias("tkn_text"))

    def ingest(self, new_messages: DataFrame, words: list[str] | None = None, batch: int | None = None, stream: str = "") -> None:
        """Adds messages(epoch_us, host, body) and all that is counted over them.

        Batches of a ``stream`` come in rising numbers; one whose number is not above the stream's last does nothing.
        """
        state = self._state()
        if batch is not None and batch <= state["streams"].get(stream, -1):
            return
        typed = patterns.typed(new_messages.select("epoch_us", "host", "body"), words or []).persist()
        day = F.date_format(F.timestamp_micros("epoch_us"), "yyyy-MM-dd")
        self._put(state, "messages", typed.withColumn("dt", day), partition="dt")
        known = self.spark.createDataFrame([(w, T.mask("WORD")) for w in words], "tkn_text string, type_mask long") if words else None
        self._put(state, "tokens", patterns.token_dictionary(new_messages, known))
        self._put(state, "patterns", patterns.patterns(typed))
        self._counters(state, typed)
        self._put(state, "tkn_hist", histograms.token_hist(typed))
        typed.unpersist()
        last = lambda name: self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{state['tables'][name][-1]}")
        self._number_tokens(state, last("tokens"))
        self._number_patterns(state, last("patterns"))
        for name in _SUMMED:
            if len(state["tables"][name]) >= COMPACT:
                self._put(state, name, self._summed(state, name), replace=True)
        if batch is not None:
            state["streams"][stream] = batch
        self._commit(state)

    def _counters(self, state: dict, typed: DataFrame, replace: bool = False) -> None:
        """What is counted by pattern."""
        self._put(state, "ptn_tkn", patterns.pattern_tokens(typed), replace)
        self._put(state, "ptn_hist", histograms.pattern_hist(typed, total=False), replace)
        self._put(state, "comp_hist", histograms.component_hist(typed), replace)

    def reject(self, lines: DataFrame) -> None:
        """Keeps ``lines(line)`` that no header was found in."""
        state = self._state()
        self._put(state, "rejected", lines)
        self._commit(state)

    def reprocess(self, words: list[str]) -> DataFrame:
        """Types all messages anew by another word list, rewrites what depends on patterns, returns ``old_ptn, new_ptn, msg_count``.

        Token counts stay; patterns that no message has any more stay with a count of 0 and their ids. Streams go on with their next batch.
        """
        state = self._state()
        typed = patterns.typed(self._raw(state, "messages").select("epoch_us", "host", "body", F.col("ptn").alias("old_ptn")), words).persist()
        moves = f"{self.path}/moves/{uuid.uuid4().hex}"
        typed.where("old_ptn <> ptn").groupBy("old_ptn", F.col("ptn").alias("new_ptn")).agg(F.count("*").alias("msg_count")).write.parquet(moves)
        now = patterns.patterns(typed)
        gone = self._summed(state, "patterns").join(now.select("ptn"), "ptn", "left_anti").withColumn("msg_count", F.lit(0).cast("long"))
        self._put(state, "patterns", now.unionByName(gone), replace=True)
        self._counters(state, typed, replace=True)
        self._put(state, "messages", typed.withColumn("dt", F.date_format(F.timestamp_micros("epoch_us"), "yyyy-MM-dd")), replace=True, partition="dt")
        typed.unpersist()
        self._number_patterns(state, self._summed(state, "patterns"))
        self._commit(state)
        return self.spark.read.schema("old_ptn string, new_ptn string, msg_count long").parquet(moves)

    # queries over the store's tables
    def find_patterns(self, order: str = "ptn_id", attr_type: str | None = None, attr_value: str | None = None, token: str | None = None, **limits) -> DataFrame:
        """Patterns in an order, tagged or with a token among their wildcards' fillers, in the limits of ``messages.pattern_filter``."""
        from ..operators import attributes

        rows = messages.pattern_filter(self.table("patterns"), **limits)
        if attr_type:
            rows = attributes.patterns_tagged(rows, self.table("tags"), attr_type, attr_value)
        if token:
            rows = rows.join(self.table("ptn_tkn").where(F.col("tkn_text") == token), "ptn", "left_semi")
        return rows.withColumn("eng_ratio", patterns.english_ratio(F.col("ptn"))).orderBy(*patterns.order_of(order)).drop("eng_ratio")

    def find_tokens(self, types: str | None = None) -> DataFrame:
        """Tokens with their ids, of some types."""
        rows = self.table("tokens")
        return rows.where(X.has_mask(F.col("type_mask"), types)) if types else rows

    def find_messages(self, ptn_id: int | None = None, **limits) -> DataFrame:
        """Messages with ptn_id, of a pattern, in the limits of ``messages.message_filter``."""
        ids = self._raw(self._state(), "ptn_ids")
        rows = messages.message_filter(self.table("messages"), **limits)
        return rows.join(ids if ptn_id is None else ids.where(F.col("ptn_id") == ptn_id), "ptn")

    def find_hist(self, name: str, **limits) -> DataFrame:
        """A histogram table in the limits of ``histograms.hist_filter``."""
        return histograms.hist_filter(self.table(name), **limits)


def union(stores: list[Store], name: str) -> DataFrame:
    """One table of several stores, merged by text."""
    tables = [s.table(name) for s in stores]
    if name == "tokens":
        return federation.tokens([t.drop("tkn_id") for t in tables])
    if name == "patterns":
        return federation.patterns([t.drop("ptn_id") for t in tables])
    return federation.hist(tables, _COUNT[name]) if name in _COUNT else federation.messages(tables)
