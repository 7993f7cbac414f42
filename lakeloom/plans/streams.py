"""Queries whose rows are the final state of a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lakeloom.operators.rounds import shared_folder
from lakeloom.plans.registry import query
from lakeloom.sources.tables import table
from lakeloom.streaming import progress


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_progress(spark, d):
    return progress.final_state(progress.totals(progress.file_stream(spark, d, "events.parquet"), "event_type", "value"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_daily(spark, d):
    """Extension: tumbling days with a watermark."""
    stream = progress.file_stream(spark, d, "events.parquet").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")
    daily = stream.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return progress.final_state(daily.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n"))


@query(" UNION ALL ".join(f"SELECT {k}::INT AS batch, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 4 <= {k} GROUP BY event_type" for k in range(4)))
def stream_partials(spark, d):
    """Totals after each of four files, as watchers see them while the run goes on."""
    folder = f"{shared_folder(spark)}/lakeloom-parts/{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    for k in range(4):
        events.where(F.col("event_id") % 4 == k).coalesce(1).write.parquet(f"{folder}/{k}")
    run = progress.Run(progress.totals(progress.file_stream(spark, folder, "*.parquet"), "event_type", "value")).finish()
    return run.states().select("batch", "event_type", "n", "total")
