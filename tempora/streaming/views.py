"""Incrementally maintained views over the event log with Structured Streaming.

Each view is a table of partial aggregates that merge: a micro-batch is
aggregated alone and appended under its batch id, and the view is the aggregate
of the parts. A batch that is run again after a failure replaces its own part,
so every view is exactly-once, and views equal their batch queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class View:
    """A view from a partial and a merging aggregate."""

    def __init__(self, path: str, partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]):
        self.path, self.partial, self.merge = path, partial, merge

    def update(self, batch: DataFrame, batch_id: int) -> None:
        self.partial(batch).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.merge(spark.read.parquet(self.path).drop("batch"))

    def compact(self, spark: SparkSession, upto: int) -> None:
        """Merge the parts of batches up to a number into one, in a new folder that then holds instead."""
        whole = spark.read.parquet(self.path)
        new = f"{self.path}-upto-{upto}"
        self.merge(whole.filter(F.col("batch") <= upto).drop("batch")).write.mode("overwrite").parquet(f"{new}/batch={upto}")
        for b in [r["batch"] for r in whole.filter(F.col("batch") > upto).select("batch").distinct().collect()]:
            whole.filter(F.col("batch") == b).drop("batch").write.mode("overwrite").parquet(f"{new}/batch={b}")
        self.path = new


def latest_value(path: str, key: str = "key", order: str = "seq", value: str = "value") -> View:
    """Last write wins, for each key."""
    pick = lambda df: df.groupBy(key).agg(F.max(F.struct(order, value)).alias("r")).select(key, f"r.{order}", f"r.{value}")
    return View(path, pick, pick)


def counters(path: str, key: str = "key", kind: str = "kind") -> View:
    """Events of each kind, for each key."""
    return View(path, lambda df: df.groupBy(key, kind).agg(F.count("*").alias("n")), lambda df: df.groupBy(key, kind).agg(F.sum("n").alias("n")))


def run(stream: DataFrame, views: list[View], checkpoint: str, available_now: bool = True):
    """Start maintaining the views; with ``available_now`` the query ends when all present input is taken."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for v in views:
                v.update(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "1 hour", size: str = "1 day", key: str = "kind") -> DataFrame:
    """Counts by event time; rows later than ``late`` after the watermark are dropped, windows are final then."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def distinct_once(stream: DataFrame, key: str, time: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key inside the watermark: idempotent writes."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
