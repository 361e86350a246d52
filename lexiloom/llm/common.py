"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexiloom.session import shared_folder


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the session's shared checkpoint folder, which every executor can reach."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as a table in the shared folder and read it back.

    The result no longer depends on the tasks that made it, so an executor lost
    later costs no recomputation.
    """
    path = f"{run_folder(df.sparkSession, name)}/table"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of `df` has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out
