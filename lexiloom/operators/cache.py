"""Replay of an expiring answer cache over a log of requests.

Per key, in time order: a request is answered from the cache while its time is
before `set time + ttl`. A hit does not renew the entry. A miss sets it anew,
provided that its answer can be stored. So the set times form a chain in which
each link depends on the one before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.text import micros
from lexiloom.operators.skew import GROUP_ROWS, cut_into_slices, join_keeping_nulls, split_hot
from lexiloom.session import materialize

SECOND = 1_000_000


def serve(at: int | None, storable: bool, expires: int | None, ttl: int) -> tuple[bool, int | None]:
    """(hit, when the entry expires afterwards) for one request. A request without a time finds and keeps nothing."""
    if at is None:
        return False, expires
    if expires is not None and at < expires:
        return True, expires
    return False, at + ttl if storable else expires


def ttl_cache_replay(
    requests: DataFrame,
    key: str = "key",
    ts: str = "ts",
    tie: str = "id",
    storable: str | None = None,
    ttl_seconds: int = fixed.CACHE_SECONDS,
    max_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Adds `hit` to every request.

    `storable` names a boolean column (false: the answer was empty or could not
    be read, so it is not kept). Ordinary keys are folded in one sorted pass. Keys
    with more than `max_rows` requests are solved by pointer jumping, which
    spreads one key over all tasks.
    """
    timed = requests.withColumn("_at", micros(F.col(ts))).withColumn(
        "_keep", F.coalesce(F.col(storable), F.lit(False)) if storable else F.lit(True)
    )
    ttl = ttl_seconds * SECOND
    usual, hot = split_hot(timed, [key], max_rows)
    result = _fold_usual(usual, key, tie, ttl)
    if hot is not None:
        result = result.unionByName(_jump_hot(hot, key, tie, ttl, max_rows))
    return result.drop("_at", "_keep")


def _fold_usual(timed: DataFrame, key: str, tie: str, ttl: int) -> DataFrame:
    """One sorted pass per task. Spark sorts and spills; the fold holds one number, whatever the key's length."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, expires = object(), None
        for batch in batches:
            hits = []
            for this, at, keep in zip(*(batch.column(c).to_pylist() for c in (key, "_at", "_keep"))):
                this = "NaN" if this != this else this  # one key to Spark, but unequal to itself here
                if this != current:
                    current, expires = this, None
                hit, expires = serve(at, keep, expires, ttl)
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], names=[*batch.schema.names, "hit"])

    schema = timed.withColumn("hit", F.lit(True)).schema
    # Only the three columns above are looked at; all others pass as they came.
    return timed.repartition(key).sortWithinPartitions(key, "_at", tie).mapInArrow(fold, schema)


def _first_at_or_after(nodes: DataFrame, key: str, ttl: int, max_rows: int) -> DataFrame:
    """(key, at, next): for every time the first time not before `at + ttl`, NULL at the end.

    Times and their probes are cut into the same slices; within a slice the
    answer is the smallest later time, beyond it the smallest of a later slice.
    """
    targets = nodes.select(key, F.col("at").alias("_at"), F.col("at").alias("_target"), F.lit(None).cast("long").alias("_from"))
    probes = nodes.select(key, (F.col("at") + ttl).alias("_at"), F.lit(None).cast("long").alias("_target"), F.col("at").alias("_from"))
    sliced = materialize(cut_into_slices(targets.unionByName(probes), [key], F.col("_at"), max_rows))
    # Looking ahead is looking back in falling order: a frame that grows from the
    # start is updated row by row, one that shrinks to the end is recomputed.
    falling = Window.partitionBy(key, "_slice").orderBy(F.col("_at").desc())
    ahead = falling.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    later = Window.partitionBy(key).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    heads = sliced.groupBy(key, "_slice").agg(F.min("_target").alias("_head"))
    carried = heads.select(key, "_slice", F.min("_head").over(later).alias("_carried"))
    found = sliced.withColumn("_near", F.min("_target").over(ahead)).filter(F.col("_from").isNotNull())
    return join_keeping_nulls(found, F.broadcast(carried), [key, "_slice"]).select(
        key, F.col("_from").alias("at"), F.coalesce("_near", "_carried").alias("next")
    )


def _jump_hot(timed: DataFrame, key: str, tie: str, ttl: int, max_rows: int) -> DataFrame:
    nodes = materialize(timed.filter("_keep AND _at IS NOT NULL").select(key, F.col("_at").alias("at")).distinct())
    jumps = materialize(_first_at_or_after(nodes, key, ttl, max_rows).filter(F.col("next").isNotNull()))
    reached = materialize(nodes.groupBy(key).agg(F.min("at").alias("at")))
    # Each round doubles the length of the jumps, so a chain of n links needs log2(n) rounds.
    while not jumps.isEmpty():
        onward = join_keeping_nulls(reached, jumps, [key, "at"], "inner").select(key, F.col("next").alias("at"))
        reached = materialize(reached.unionByName(onward))
        doubled = jumps.withColumnsRenamed({"at": "_start", "next": "at"})
        jumps = materialize(
            join_keeping_nulls(doubled, jumps, [key, "at"], "inner").select(key, F.col("_start").alias("at"), "next")
        )
    # Two sets of a key are at least one ttl apart, so a cell of that width holds
    # one of them at most; a request is served from its own cell or the one before.
    cell = lambda c: F.floor(F.col(c) / ttl).cast("long")
    setters = join_keeping_nulls(
        timed.filter("_keep").withColumnRenamed("_at", "at"), reached, [key, "at"], "left_semi"
    ).groupBy(key, "at").agg(F.min(tie).alias("_tie"))
    marks = (
        setters.select(key, "at", "_tie", F.explode(F.array(cell("at"), cell("at") + 1)).alias("_cell"))
        .groupBy(key, "_cell")
        .agg(
            F.max(F.when(cell("at") == F.col("_cell"), F.struct("at", "_tie"))).alias("_own"),
            F.max(F.when(cell("at") < F.col("_cell"), F.col("at"))).alias("_earlier"),
        )
    )
    placed = join_keeping_nulls(timed.withColumn("_cell", cell("_at")), marks, [key, "_cell"])
    after_own = (F.col("_at") > F.col("_own.at")) | (
        (F.col("_at") == F.col("_own.at")) & (F.col(tie) > F.col("_own._tie"))
    )
    served = F.coalesce(F.col("_at") < F.col("_earlier") + ttl, F.lit(False)) | (
        F.col("_own").isNotNull() & after_own
    )
    return placed.withColumn("hit", served).drop("_cell", "_own", "_earlier")
