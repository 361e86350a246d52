"""Running a stream over what is there now, and the given tables as streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.plans.tables import Tables
from lexiloom.session import shared_folder

FAR = "9000-01-01 00:00:00"


class StreamTables(Tables):
    """The same logical tables, read as streams of files."""

    def given(self, name: str) -> DataFrame:
        """A table's own file, or its folder of files, as a stream. A stream follows folders, so a file is picked from its own."""
        table = super().given(name)
        reader = self.spark.readStream.schema(table.schema)
        files = table.inputFiles()
        if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
            return reader.option("pathGlobFilter", f"{name}.parquet").parquet(self.folder)
        return reader.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        return self.given(name)


def _place(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_to_end(stream: DataFrame, mode: str = "append", place: str | None = None) -> DataFrame:
    """Everything the stream gives for the files present, kept in the shared folder."""
    spark = stream.sparkSession
    place = place or _place(spark)
    query = (
        stream.writeStream.format("parquet")
        .option("compression", "zstd")
        .outputMode(mode)
        .option("checkpointLocation", f"{place}/checkpoint")
        .option("path", f"{place}/rows")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{place}/rows")


def run_past_the_end(rows: DataFrame, work: Callable[[DataFrame], DataFrame], ts: str = "ts") -> DataFrame:
    """Everything `work` gives for the rows present when none are to follow, also for those it lets wait for a watermark.

    After the files present, a row of a far time and nothing else moves the
    watermark on. It comes from a folder of its own, empty until then, so a
    query that stopped goes on where it was.
    """
    spark = rows.sparkSession
    place = _place(spark)
    last = spark.range(1).select(*[(F.lit(FAR).cast(f.dataType) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
    last.limit(0).write.parquet(f"{place}/end")
    stream = work(rows.unionByName(spark.readStream.schema(last.schema).parquet(f"{place}/end")))
    run_to_end(stream, place=place)
    last.write.mode("append").parquet(f"{place}/end")
    return run_to_end(stream, place=place)


def run_updates_to_end(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of every key after the files present, from a stream in update mode."""
    from lexiloom.streaming.jobs import read_current, write_current_status

    place = _place(stream.sparkSession)
    write_current_status(stream, f"{place}/rows", f"{place}/checkpoint").awaitTermination()
    return read_current(stream.sparkSession, f"{place}/rows", keys)


def run_status_to_end(status: DataFrame, job: str = "job_id") -> DataFrame:
    """The current row of every job after the files present."""
    return run_updates_to_end(status, [job])
