"""Runs of streams: partial states, sharing, newer runs, staleness and time budgets."""

from __future__ import annotations

from lakeloom.streaming import progress


def test_runs(spark, sf):
    made = []

    def make():
        made.append(progress.Run(progress.totals(progress.file_stream(spark, sf, "events.parquet"), "event_type", "value")))
        return made[-1]

    runs = progress.Runs(most_seconds=1000, most_runs=2)
    one = runs.watch("a", make)
    assert runs.watch("a", make) is one and len(made) == 1
    assert one.finish().state().count() == one.states().where("batch = 0").count() > 0
    again = runs.start("a", make)
    assert again is not one and not one.query.isActive
    runs.watch("b", make)
    runs.watch("c", make)
    assert list(runs.known) == ["b", "c"] and not again.query.isActive
    always = progress.Runs(most_seconds=0)
    assert always.watch("a", make) is not always.watch("a", make)
    for run in made:
        run.query.stop()


def test_time_budget(spark, sf):
    endless = progress.Run(progress.totals(spark.readStream.format("rate").load().withColumnRenamed("value", "v"), "timestamp", "v"), interval="1 second")
    assert endless.finish(seconds=1).cut and not endless.query.isActive
    assert not progress.Run(progress.totals(progress.file_stream(spark, sf, "events.parquet"), "event_type", "value")).finish(seconds=100).cut
