"""Streaming twins of the run-log operators, over a folder to which attempts are appended."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ATTEMPT_SCHEMA = "call_id string, attempt_index int, run_id string, provider string, status string, total_tokens bigint, timestamp_utc string"


def read_attempts(spark: SparkSession, folder: str, schema: str = ATTEMPT_SCHEMA, fmt: str = "json") -> DataFrame:
    """A stream of appended attempts with their event time, at; attempts without a readable time are left out."""
    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    return stream.withColumn("at", F.try_to_timestamp("timestamp_utc")).filter("at is not null")


def once_each(stream: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first delivery of every attempt, remembered as long as late ones are waited for."""
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["call_id", "attempt_index"])


def rate_windows(stream: DataFrame, length: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Starts and tokens per provider and tumbling window; windows are final once the watermark has passed them."""
    per = stream.withWatermark("at", delay).groupBy(F.window("at", length).alias("w"), "provider").agg(F.count("*").alias("starts"), F.sum("total_tokens").alias("tokens"))
    return per.select(F.col("w.start").alias("window_start"), "provider", "starts", "tokens")


def call_outcomes(stream: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """(call_id, attempts, last_status) of every call once it succeeded or its event time has been idle; state is one small row a call."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = "call_id string, attempts bigint, last_status string"  # noqa: F841
        if state.hasTimedOut:
            n, _, last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], n, last)], columns=["call_id", "attempts", "last_status"])
            return
        n, high, last = state.get if state.exists else (0, -1, None)
        newest = 0
        for batch in batches:
            n += len(batch)
            top = batch.loc[batch["attempt_index"].idxmax()]
            if top["attempt_index"] > high:
                high, last = int(top["attempt_index"]), top["status"]
            newest = max(newest, int(batch["at"].max().timestamp() * 1000))
        if last == "success":
            state.remove()
            yield pd.DataFrame([(key[0], n, last)], columns=["call_id", "attempts", "last_status"])
        else:
            state.update((n, high, last))
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + idle_ms)

    keyed = stream.withWatermark("at", "10 minutes").select("call_id", "attempt_index", "status", "at").groupBy("call_id")
    return keyed.applyInPandasWithState(run, "call_id string, attempts bigint, last_status string", "n bigint, high bigint, last string", "append", GroupStateTimeout.EventTimeTimeout)
