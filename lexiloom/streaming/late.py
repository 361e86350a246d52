"""Counting rows that came too late."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class LateRows(StreamingQueryListener):
    """Rows that watermarks dropped, by name of the query, or its id if it has none.

    Spark counts them in each stateful operator of a trigger; this adds up the
    triggers of all queries of a session, also of those that have ended.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryStarted(self, event) -> None:
        self.dropped[event.name or str(event.id)] += 0

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.dropped[progress.name or str(progress.id)] += sum(o.numRowsDroppedByWatermark for o in progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        pass


def count_late_rows(spark: SparkSession) -> LateRows:
    """Counts late rows of all queries that start from now on; `spark.streams.removeListener` ends it."""
    listener = LateRows()
    spark.streams.addListener(listener)
    return listener
