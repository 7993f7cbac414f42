"""Progressive versions of the long-running operators on Structured Streaming (T-01 to T-07).

A run reads what files there are in micro-batches and publishes the state after each in the shared folder, where any number
of watchers read it; a newer run of the same name ends the older, and a run that exceeds its time says that it is cut.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeloom.operators.rounds import shared_folder


def file_stream(spark: SparkSession, folder: str, pattern: str, per_batch: int = 1) -> DataFrame:
    """A stream over the Parquet files of ``folder`` whose names match, ``per_batch`` files at a time, the oldest first."""
    schema = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").parquet(folder)


class Run:
    """A running stream whose states are tables: ``states`` has a column ``batch``, ``state`` is the last one."""

    def __init__(self, result: DataFrame, mode: str = "complete", interval: str | None = None):
        self.schema, self.mode = result.schema, mode
        self.spark = result.sparkSession
        self.path = f"{shared_folder(self.spark)}/lakeloom-stream/{uuid.uuid4().hex}"
        path = self.path

        def publish(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/states/batch={number}")  # the same table again if the batch is run again

        writer = result.writeStream.foreachBatch(publish).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint")
        self.query: StreamingQuery = (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
        self.cut = False

    def finish(self, seconds: float | None = None) -> Run:
        """Waits for the end of what there is to read, or stops after so many seconds and sets ``cut``."""
        if seconds is None:
            self.query.awaitTermination()
        elif not self.query.awaitTermination(max(1, round(seconds))):
            self.query.stop()
            self.cut = True
        return self

    def states(self) -> DataFrame:
        """All states published so far, in tables that stay as they are."""
        empty = self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0))
        if not self.query.recentProgress and not self.query.lastProgress:
            return empty
        return self.spark.read.schema(empty.schema).option("basePath", f"{self.path}/states").parquet(f"{self.path}/states")

    def state(self) -> DataFrame:
        """The last state, or all rows so far where batches add to each other."""
        states = self.states()
        if self.mode != "complete":
            return states.drop("batch")
        last = states.agg(F.max("batch")).first()[0]
        return states.where(F.col("batch") == F.lit(last if last is not None else 0)).drop("batch")


class Runs:
    """Runs by name: watchers share one, a newer one ends the older, and one older than ``most_seconds`` is started anew (0: always)."""

    def __init__(self, most_seconds: float = 1800.0, most_runs: int = 8):
        self.most_seconds, self.most_runs = most_seconds, most_runs
        self.known: dict[str, tuple[float, Run]] = {}

    def start(self, name: str, make: Callable[[], Run]) -> Run:
        if name in self.known:
            self.known.pop(name)[1].query.stop()
        while len(self.known) >= self.most_runs:  # the one that was asked for longest ago
            self.known.pop(next(iter(self.known)))[1].query.stop()
        run = make()
        self.known[name] = (time.monotonic(), run)
        return run

    def watch(self, name: str, make: Callable[[], Run]) -> Run:
        """The run of that name, started if there is none that is fresh."""
        if name in self.known:
            began, run = self.known.pop(name)
            self.known[name] = (began, run)
            if self.most_seconds and time.monotonic() - began <= self.most_seconds:
                return run
        return self.start(name, make)


def final_state(result: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a streaming aggregation over all there is and gives its final state as a table."""
    return Run(result, mode).finish().state()


def totals(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Rows and sums per group so far."""
    return stream.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total"))
