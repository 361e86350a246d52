"""Job status as a stream: the current row of every job, and throughput per minute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.jobs import status_aggregates


def stream_job_status(
    events: DataFrame,
    fields: Sequence[str] = ("status", "current", "total", "message"),
    job: str = "job_id",
    seq: str = "seq",
    ts: str = "ts",
) -> DataFrame:
    """The same fold as in batch. Use output mode `update`: each trigger gives the jobs that changed."""
    return events.groupBy(job).agg(*status_aggregates(fields, seq, ts))


def write_current_status(status: DataFrame, path: str, checkpoint: str, job: str = "job_id", **trigger):
    """Starts a query that appends the changed rows of each trigger, numbered by `batch`.

    The batch number makes a repeated trigger harmless: it rewrites its own folder.
    """

    def save(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return (
        status.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_current(spark, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of every key from the folders above."""
    written = spark.read.parquet(path)
    row = F.struct(*[c for c in written.columns if c not in (*keys, "batch")])
    return written.groupBy(*keys).agg(F.max_by(row, "batch").alias("_row")).select(*keys, "_row.*")


def read_current_status(spark, path: str, job: str = "job_id") -> DataFrame:
    """The newest row of every job from the folders above."""
    return read_current(spark, path, [job])


def stream_throughput(
    events: DataFrame, job: str = "job_id", ts: str = "ts", width: str = "1 minute", lateness: str = "10 minutes"
) -> DataFrame:
    """Events and item range per job and tumbling window; a window is final when the watermark passes it."""
    return (
        events.withWatermark(ts, lateness)
        .groupBy(job, F.window(ts, width))
        .agg(F.count(F.lit(1)).alias("events"), F.min("current").alias("first_item"), F.max("current").alias("last_item"))
        .select(job, F.col("window.start").alias("window_start"), "events", "first_item", "last_item")
    )
