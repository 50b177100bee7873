"""Watching a run: novelty of relabels over event time, streaks, and change fractions.

Each measure has a batch form and, where it makes sense, a Structured Streaming form over the
same expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def novelty(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """``(start, events, distinct_users, novelty)`` for each window of ``events (ts, user_id)``.

    ``late``: the watermark's delay, for a stream.  Distinct users are counted by two grouped
    steps in a batch; a stream keeps them as a set in each window's state.
    """
    at = F.window("ts", size, slide) if slide else F.window("ts", size)
    if events.isStreaming:
        events = events.withWatermark("ts", late or "10 minutes")
        out = events.groupBy(at.alias("w")).agg(F.count("*").alias("events"), F.size(F.collect_set("user_id")).cast("long").alias("distinct_users"))
    else:
        once = events.groupBy(at.alias("w"), "user_id").agg(F.count("*").alias("n"))
        out = once.groupBy("w").agg(F.sum("n").alias("events"), F.count("user_id").alias("distinct_users"))
    return out.select(F.col("w.start").alias("start"), "events", "distinct_users", (F.col("distinct_users") / F.col("events")).alias("novelty"))


def calm_streaks(ratios: DataFrame, threshold: float, wanted: int) -> DataFrame:
    """``(start, novelty, streak, settled)``: how many windows in a row, up to each, are below the threshold.

    Windows are one row an hour or so: ordering them in one place is bounded by time, not by data.
    """
    order = Window.orderBy("start")
    broken = F.sum((F.col("novelty") >= threshold).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    run = ratios.withColumn("_b", broken)
    streak = F.sum((F.col("novelty") < threshold).cast("long")).over(Window.partitionBy("_b").orderBy("start").rowsBetween(Window.unboundedPreceding, 0))
    return run.withColumn("streak", streak).select("start", "novelty", "streak", (F.col("streak") >= wanted).alias("settled"))


def change_fraction(last_change: DataFrame, iteration: int, window: int) -> DataFrame:
    """One row ``(parcels, recent, fraction)`` of ``last_change (parcel_id, iteration)``."""
    recent = F.count(F.when(F.lit(iteration) - F.col("iteration") < window, 1))
    return last_change.agg(F.count("*").alias("parcels"), recent.alias("recent")).withColumn("fraction", F.when(F.col("parcels") > 0, F.col("recent") / F.col("parcels")).otherwise(1.0))


def trailing_ratio(events: DataFrame, window: int) -> DataFrame:
    """``(iteration, events, distinct_parcels, ratio)`` of the last ``window`` iterations up to each one.

    ``events (iteration, parcel)``. An event is seen by the windows of the ``window``
    iterations from its own on, so a distinct (window, parcel) count is an ordinary grouping.
    """
    marks = events.select("iteration").distinct()
    seen = events.select("parcel", F.explode(F.sequence(F.col("iteration"), F.col("iteration") + window - 1)).alias("iteration"))
    counted = seen.groupBy("iteration", "parcel").agg(F.count("*").alias("n")).groupBy("iteration").agg(F.sum("n").alias("events"), F.count("*").alias("distinct_parcels"))
    return marks.join(counted, "iteration").select("iteration", "events", "distinct_parcels", (F.col("distinct_parcels") / F.col("events")).alias("ratio"))


def watch_streaks(ratios: DataFrame, threshold: float, wanted: int) -> DataFrame:
    """The streaming twin of :func:`calm_streaks` for ``(run_id, start, novelty)``: state is one counter a run."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        for frame in frames:
            rows = []
            for start, value in sorted(zip(frame["start"], frame["novelty"], strict=True)):
                streak = streak + 1 if value < threshold else 0
                rows.append((key[0], start, value, streak, streak >= wanted))
            yield pd.DataFrame(rows, columns=["run_id", "start", "novelty", "streak", "settled"])
        state.update((streak,))

    return ratios.groupBy("run_id").applyInPandasWithState(step, "run_id string, start timestamp, novelty double, streak long, settled boolean", "streak long", "append", "NoTimeout")


def merged_stats(progress: DataFrame) -> DataFrame:
    """One row over the latest message of each worker: ``(iteration, temperature, accepted, rejected, boundary, score)``."""
    last = progress.groupBy("worker").agg(F.max_by(F.struct(*progress.columns), "iteration").alias("m")).select("m.*")
    return last.agg(
        F.max("iteration").alias("iteration"), F.max("temperature").alias("temperature"), F.sum("accepted").alias("accepted"), F.sum("rejected").alias("rejected"), F.sum("boundary").alias("boundary"),
        (F.sum("num") / F.sum("den")).alias("score"),
    )
