"""Usage accounting on a stream: windows, sessions, a day's counters kept by upsert, and an hourly budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyforge.operators.ledger import upsert

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Calls by hour and type; events later than ``delay`` are dropped."""
    hours = events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "event_type")
    return hours.agg(F.count("*").alias("calls")).select(F.col("window.start").alias("start"), "event_type", "calls")


def sliding(events: DataFrame, delay: str = "1 hour", length: str = "1 hour", step: str = "15 minutes") -> DataFrame:
    """Calls in overlapping windows."""
    windows = events.withWatermark("ts", delay).groupBy(F.window("ts", length, step))
    return windows.agg(F.count("*").alias("calls")).select(F.col("window.start").alias("start"), "calls")


def user_sessions(events: DataFrame, gap: str = "12 hours", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: events no more than ``gap`` apart."""
    groups = events.withWatermark("ts", delay).groupBy("user_id", F.session_window("ts", gap))
    return groups.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id")).select("user_id", F.col("session_window.start").alias("start"), "n", "first_id")


def once(requests: DataFrame, key: str, delay: str = "1 hour") -> DataFrame:
    """Requests without those repeated within the delay."""
    return requests.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def over_budget(events: DataFrame, limit: int) -> DataFrame:
    """user_id, event_id, calls: the first event of each user with over ``limit`` calls in the hour up to it; warns once.

    The state of a user is the times of the last hour, at most limit + 1 of them, and whether the warning is out.
    """

    def f(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, warned = state.get if state.exists else ([], False)
        out = []
        for row in pd.concat(list(batches)).sort_values(["ts", "event_id"]).itertuples():
            now = row.ts.value // 1000
            times = [t for t in times if t >= now - 3_600_000_000][-limit:] + [now]
            if len(times) > limit and not warned:
                warned = True
                out.append((key[0], row.event_id, len(times)))
        state.update((times, warned))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "calls"]).astype({"user_id": "int64", "event_id": "int64", "calls": "int64"})

    groups = events.select("user_id", "ts", "event_id").groupBy("user_id")
    return groups.applyInPandasWithState(f, "user_id long, event_id long, calls long", "times array<long>, warned boolean", "append", GroupStateTimeout.NoTimeout)


class DailyCounters:
    """Counters of each day and type in a folder of numbered versions; a batch that is run again changes nothing."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def start(self, events: DataFrame, checkpoint: str):
        return events.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def merge(self, batch: DataFrame, number: int) -> None:
        """Adds a batch to the version before it; version n follows from version n - 1 alone."""
        new = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("calls"))
        if number:
            old = batch.sparkSession.read.parquet(f"{self.folder}/{number - 1}")
            sums = old.unionByName(new).groupBy("day", "event_type").agg(F.sum("calls").alias("calls"))
            new = upsert(old, sums, ["day", "event_type"])
        new.write.mode("overwrite").parquet(f"{self.folder}/{number}")

    def read(self, spark: SparkSession, number: int) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{number}")
