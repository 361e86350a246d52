"""Loading the ledger tables with their declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiloom.schemas import LEDGER_TABLES


def read_ledger(
    spark: SparkSession,
    table: str,
    path: str | None = None,
    jdbc_url: str | None = None,
    partition_column: str = "user_id",
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    **options: str,
) -> DataFrame:
    """One ledger table from parquet (`path` is its folder) or over JDBC.

    Over JDBC, `bounds` of the numeric partition column split the read into
    `partitions` range queries; filters and columns are pushed down either way.
    """
    schema = LEDGER_TABLES[table]
    if path is not None:
        return spark.read.schema(schema).parquet(path)
    if jdbc_url is None:
        raise ValueError("give either a path or a JDBC address")
    reader = spark.read.format("jdbc").options(url=jdbc_url, dbtable=table, **options)
    if bounds is not None:
        lower, upper = bounds
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=lower, upperBound=upper, numPartitions=partitions
        )
    names = [column.split()[0] for column in schema.split(", ")]
    return reader.load().select(*names)
