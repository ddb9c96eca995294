"""Streams of lines into a store, and histograms of a stream.

By default every message counts in its own bin however late it is: each micro-batch is merged into the tables. With a
watermark Spark keeps the counts itself and drops what comes later.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import Store


def into_store(messages: DataFrame, store: Store, checkpoint: str, words: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Starts the stream ``messages(epoch_us, host, body)`` into a store.

    The store remembers the last batch of each stream, which its checkpoint folder names; so a batch that is repeated
    after a failure or a restart counts once, whatever else changed the store in between.
    """

    def merge(batch: DataFrame, number: int) -> None:
        store.ingest(batch, words, number, stream=checkpoint)

    writer = messages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(messages: DataFrame, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """``epoch, ptn, msg_count`` of tumbling windows of a stream with ptn, with a bound on lateness."""
    timed = messages.withColumn("ts", F.timestamp_micros("epoch_us")).withWatermark("ts", lateness)
    counted = timed.groupBy(F.window("ts", width), "ptn").agg(F.count("*").alias("msg_count"))
    return counted.select(F.unix_timestamp("window.start").alias("epoch"), "ptn", "msg_count")
