"""Job telemetry: the current row of every job, and progress per event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.text import clock, micros

NO_ETA = "--:--"
BAR_CELLS = 50


def status_aggregates(fields: Sequence[str], seq: str = "seq", ts: str = "ts", reset: str | None = None) -> list[Column]:
    """The fold of status events as mergeable aggregates, for batch and stream alike.

    Every event lists the fields it carries in `present`, so an explicit NULL
    overwrites an older value while a missing field keeps it. The first real
    start time wins; an event flagged `reset` puts its own start time instead.
    """
    has = lambda field: F.array_contains("present", field)
    order = F.col(seq)
    newest = [F.max_by(F.struct(f), F.when(has(f), order)).getField(f).alias(f) for f in fields if f != "started_at"]
    real = has("started_at") & F.coalesce(F.col("started_at") != 0, F.lit(False))
    started = F.coalesce(
        F.min_by("started_at", F.when(real, order)), F.max_by("started_at", F.when(has("started_at"), order))
    )
    if reset:
        started = F.coalesce(F.max_by("started_at", F.when(real & F.col(reset), order)), started)
    return [*newest, started.alias("started_at"), F.max(ts).alias("updated_at")]


def fold_job_status(
    events: DataFrame,
    fields: Sequence[str] = ("status", "current", "total", "message"),
    job: str = "job_id",
    seq: str = "seq",
    ts: str = "ts",
    reset: str | None = None,
) -> DataFrame:
    """Status events -> one current row per job. Only partial results are shuffled."""
    return events.groupBy(job).agg(*status_aggregates(fields, seq, ts, reset))


def progress_columns(started: Column, now: Column, current: Column, total: Column) -> dict[str, Column]:
    """Progress figures of one event, from start and event time in seconds."""
    percent = (
        F.when(total > 0, F.least(F.lit(99), F.floor(current / total * 100))).otherwise(F.lit(0)).cast("int")
    )
    elapsed = now - started
    eta = F.when(percent > 0, elapsed / percent * (100 - percent))
    speed = F.when((percent > 0) & (elapsed > 0), current / elapsed).otherwise(F.lit(0.0))
    return {
        "percent": percent,
        "elapsed": elapsed,
        "eta": eta,
        "speed": speed,
        "elapsed_text": clock(elapsed),
        "eta_text": F.when(eta.isNotNull() & (eta != 0), clock(eta)).otherwise(F.lit(NO_ETA)),
    }


def terminal_bar(df: DataFrame) -> DataFrame:
    """Adds the one-line progress bar as a terminal shows it."""
    filled = F.floor(F.col("percent") / 2).cast("int")
    return df.withColumn(
        "terminal_style",
        F.concat(
            F.col("percent").cast("string"),
            F.lit("%|"),
            F.repeat(F.lit("█"), filled),
            F.repeat(F.lit(" "), BAR_CELLS - filled),
            F.lit("| "),
            F.concat_ws("/", F.col("current").cast("string"), F.col("total").cast("string")),
            F.lit(" ["),
            F.concat_ws("<", "elapsed_text", "eta_text"),
            F.format_string(", %.2fit/s]", F.col("speed")),
        ),
    )


def job_progress(events: DataFrame, job: str = "job_id", seq: str = "seq", ts: str = "ts") -> DataFrame:
    """Adds percent, elapsed time, ETA and speed to every status event. A job starts at its
    first real start time; until there is one, times that follow from it are NULL.

    The start comes from a grouped minimum joined back, not from a window: the
    join can split a job that holds most of the events, a window cannot.
    """
    real = F.coalesce(F.col("started_at") != 0, F.lit(False))
    starts = events.groupBy(job).agg(F.min(F.when(real, F.struct(seq, "started_at"))).alias("_first"))
    now = micros(F.col(ts)) / 1_000_000
    started = F.when(F.col(seq) >= F.col(f"_first.{seq}"), F.col("_first.started_at"))
    return (
        events.join(starts, job)
        .withColumns(progress_columns(started, now, F.col("current"), F.col("total")))
        .drop("_first")
    )


def throughput(events: DataFrame, job: str = "job_id", ts: str = "ts", width: str = "1 minute") -> DataFrame:
    """Events and distinct progress per job and tumbling window."""
    return (
        events.groupBy(job, F.window(ts, width))
        .agg(F.count(F.lit(1)).alias("events"), F.min("current").alias("first_item"), F.max("current").alias("last_item"))
        .select(job, F.col("window.start").alias("window_start"), "events", "first_item", "last_item")
    )


def read_side_progress(status: DataFrame, now: Column) -> DataFrame:
    """What a status reader adds to unfinished jobs: elapsed time and ETA at `now` (seconds)."""
    open_job = (
        F.col("started_at").isNotNull() & (F.col("progress") < 100) & (F.col("status") != "error")
    )
    elapsed = now - F.col("started_at")
    eta = F.when(open_job & (F.col("progress") > 0), elapsed / F.col("progress") * (100 - F.col("progress")))
    return status.withColumns(
        {
            "elapsed_time": F.when(open_job, elapsed).otherwise(F.col("elapsed_time")),
            "estimated_time_remaining": F.coalesce(eta, F.col("estimated_time_remaining")),
        }
    )
