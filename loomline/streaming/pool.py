"""A pool of ids that are given out once: keyed state of what is taken, what has failed and when it may come again.

Offers and reports of failure are files that streams pick up. Each id has one small state, which ends after a time to live,
so that what is kept is bounded by the ids of that time, not by all that ever came.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GIVEN = "id string, attempt int, payload string"
STATE = "attempts int, waits boolean, payload string"


class Pool(StatefulProcessor):
    """Gives an id out when it is first offered, and again, a while after a failure, until its attempts are used up."""

    def __init__(self, attempts: int, retry_ms: int, keep_ms: int) -> None:
        self.most, self.retry_ms, self.keep_ms = attempts, retry_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("id", STATE, ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        out = []
        for part in rows:
            for event, payload in zip(part["event"], part["payload"], strict=True):
                if event == "offered" and known is None:
                    known = (1, False, payload)
                    out.append((key[0], 1, payload))
                elif event == "failed" and known is not None and not known[1] and known[0] < self.most:
                    known = (known[0], True, known[2])
                    self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.retry_ms)
        if known is not None:
            self.state.update(known)
        yield pd.DataFrame(out, columns=["id", "attempt", "payload"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.state.get() if self.state.exists() else None
        if known is not None and known[1]:
            self.state.update((known[0] + 1, False, known[2]))
            yield pd.DataFrame([(key[0], known[0] + 1, known[2])], columns=["id", "attempt", "payload"])
        else:
            yield pd.DataFrame([], columns=["id", "attempt", "payload"])

    def close(self) -> None:
        pass


def pool(events: DataFrame, attempts: int = 3, retry_ms: int = 600_000, keep_ms: int = 30 * 86_400_000) -> DataFrame:
    """(id, attempt, payload) for each time an id of the stream events(id, event, payload) is given out; event is offered or failed.

    An id is given out once for all its offers, then retry_ms after a failure, `attempts` times in all. An id not heard of
    for keep_ms is forgotten. Null ids are left out.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.where("id is not null").groupBy("id").transformWithStateInPandas(statefulProcessor=Pool(attempts, retry_ms, keep_ms), outputStructType=GIVEN, outputMode="Append", timeMode="ProcessingTime")


def pool_pass(spark: SparkSession, offers: str, failures: str, target: str, checkpoint: str, condition: str = "true", **limits: int) -> None:
    """One pass: new JSON files of offers (id, payload) that meet a condition and of failures (id); what is given out is appended to target as Parquet.

    Ids whose time has come are given out again by the next pass that has a new file; batches without data, which would
    follow one another for ever while there may be timers, are off.
    """
    offered = spark.readStream.schema("id string, payload string").json(offers).where(condition).select("id", F.lit("offered").alias("event"), "payload")
    failed = spark.readStream.schema("id string").json(failures).select("id", F.lit("failed").alias("event"), F.lit(None).cast("string").alias("payload"))
    given = pool(offered.unionByName(failed), **limits)
    empty = "spark.sql.streaming.noDataMicroBatches.enabled"
    was = spark.conf.get(empty)
    spark.conf.set(empty, "false")
    try:  # a query takes its settings when it starts
        query = given.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(empty, was)
    query.awaitTermination()


def consume_pass(spark: SparkSession, source: str, checkpoint: str, use) -> None:
    """use(batch, number) for what is new at source since this consumer's last pass.

    The stream goes by the sink's own log, so files of a pass that has not been committed are not seen.
    """
    stream = spark.readStream.schema(GIVEN).parquet(source)
    stream.writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
