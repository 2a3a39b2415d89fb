"""Streams over the same operators: cleaning needs no state, intake keeps the first request of each key for a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from corpusmill.operators.cleaning import CleaningLimits, clean_documents

#: Keyed state with timers needs this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, files_per_batch: int = 100) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def stream_clean(docs: DataFrame, limits: CleaningLimits = CleaningLimits()) -> DataFrame:
    """Cleaning of a stream of ``(doc_id, text)``: the batch operator, which is one narrow stage."""
    return clean_documents(docs, limits)


class FirstRequests(StatefulProcessor):
    """Per key the fingerprint of the first request, and a timer that takes it away."""

    def __init__(self, ts: str, order: list[str], keep_ms: int) -> None:
        self.ts, self.order, self.keep_ms = ts, order, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", T.StructType([T.StructField("fingerprint", T.StringType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """Requests of one key in one batch, which bounds them, in their order; nulls last."""
        requests = sorted(rows, key=lambda r: [(r[c] is None, r[c]) for c in (self.ts, *self.order)])
        held = self.first.get()
        known = held[0] if held else requests[0]["fingerprint"]
        decided = ["replay" if r["fingerprint"] == known else "conflict" for r in requests]
        if not held:
            self.first.update((known,))
            self.handle.registerTimer(int(requests[0][self.ts].timestamp() * 1000) + self.keep_ms)
            decided[0] = "accepted"
        named = Row(*requests[0].__fields__, "decision")
        for request, decision in zip(requests, decided, strict=True):
            yield named(*request, decision)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.first.clear()
        yield from ()

    def close(self) -> None:
        pass


def stream_intake(requests: DataFrame, keys: list[str], ts: str = "ts", order: list[str] | None = None, delay: str = "1 hour") -> DataFrame:
    """``decision`` beside the columns of each request: ``accepted``, ``replay`` or ``conflict``, as ``resolve_intake``
    decides them.

    The first request of a key that arrives (of a batch, by ``ts`` and ``order``) is remembered until the watermark has
    passed its time by ``delay``; a later one is the first anew. Requests behind the watermark have no decision: they are
    dropped. Keys must not be null.
    """
    keep_ms = int(pd.Timedelta(delay).total_seconds() * 1000)
    timed = requests.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    schema = T.StructType([*timed.schema.fields, T.StructField("decision", T.StringType())])
    keyed = timed.groupBy(*keys)
    return keyed.transformWithState(FirstRequests(ts, order or [], keep_ms), schema, "Append", "EventTime")


def run_available(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Process what is there, appending Parquet; restarting with the same checkpoint goes on where it ended. The store
    that keyed state needs is named to this query alone."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE[0])
    conf.set(*STATE_STORE)
    try:
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(STATE_STORE[0], before)
    query.awaitTermination()
    return query
