"""Replay of a translation cache of bounded size over the lookups of jobs.

The cache drops its least recently used fifth when a new text finds it full. So
what it holds are always the texts used last, as many as it has at that moment,
and a lookup hits if fewer other texts were used since the text's last use (its
reuse distance) than the cache holds. Distances depend on the lookups alone; the
number of texts held is one number that only misses change.

A job's lookups are cut into slices. The texts used last before a slice are put
together from the last uses in the slices before, so all slices find their
distances side by side. They also find side by side what each number of texts
held before a slice becomes, of which there are a fifth of the cache's size at
most. Reading these small tables in turn gives the number before each slice, and
with it every hit. A task holds as many texts as the cache does.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.operators.skew import GROUP_ROWS, cut_into_slices, join_keeping_nulls, split_hot
from lexiloom.session import materialize


class RecentTexts:
    """The last `size` texts used, and how many others were used since each."""

    def __init__(self, size: int):
        self.size, self.clock, self.place, self.order = size, 0, {}, []
        self.text_at: dict[int, str] = {}

    def use(self, text: str) -> int | None:
        """How many other texts were used since this one; None if `size` or more, or if it was never used."""
        distance, before = None, self.place.pop(text, None)
        if before is not None:
            at = bisect_left(self.order, before)
            distance = len(self.order) - 1 - at
            del self.order[at], self.text_at[before]
        elif len(self.order) == self.size:
            del self.place[self.text_at.pop(self.order.pop(0))]
        self.clock += 1
        self.place[text] = self.clock
        self.text_at[self.clock] = text
        self.order.append(self.clock)
        return distance


def _drops(max_size: int) -> int:
    """Texts dropped at a time."""
    drops = int(max_size * fixed.CACHE_DROPPED_SHARE)
    if drops < 1:
        raise ValueError("a cache this small never drops a text")
    return drops


def _in_order(rows: DataFrame, order: Sequence[str], *before: str) -> DataFrame:
    return rows.repartition("_job", "_slice").sortWithinPartitions("_job", "_slice", *before, *order)


def _latest_before(sliced: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """(_job, _slice, key, _depth): the last `size` texts used before each slice but a job's first; the last one has depth 0."""
    place = F.struct(*order)
    used = sliced.groupBy("_job", "_slice", "key").agg(F.max(place).alias("_last"))
    rank = F.row_number().over(Window.partitionBy("_job", "_slice").orderBy(F.desc("_last")))
    tails = used.withColumn("_rank", rank).filter(F.col("_rank") <= size)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        job = number = None
        recent: OrderedDict[str, None] = OrderedDict()
        for batch in batches:
            jobs, slices, keys = (batch.column(c).to_pylist() for c in ("_job", "_slice", "key"))
            for own_job, own_slice, key in zip(jobs, slices, keys):
                if number is None or own_job != job:
                    recent, job, number = OrderedDict(), own_job, own_slice
                elif own_slice != number:
                    texts = list(recent)[::-1]
                    columns = [[job] * len(texts), [own_slice] * len(texts), texts, list(range(len(texts)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, found)], names=found.names)
                    number = own_slice
                recent[key] = None
                recent.move_to_end(key)
                if len(recent) > size:
                    recent.popitem(last=False)

    found = pa.schema([("_job", pa.string()), ("_slice", pa.int32()), ("key", pa.string()), ("_depth", pa.int32())])
    ordered = tails.select("_job", F.col("_slice").cast("int"), "key", "_last").repartition("_job").sortWithinPartitions("_job", "_slice", "_last")
    return ordered.drop("_last").mapInArrow(carry, "_job string, _slice int, key string, _depth int")


def reuse_distances(sliced: DataFrame, seeds: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """Adds `_distance`: other texts used since a text's last use in its job, NULL if `size` or more or none was."""
    names = [c for c in sliced.columns if c not in ("_job", "_slice", "key")]
    empty = [F.lit(None).cast(sliced.schema[c].dataType).alias(c) for c in names]
    both = sliced.select("_job", "_slice", "key", *names, F.lit(None).cast("int").alias("_depth")).unionByName(
        seeds.select("_job", "_slice", "key", *empty, "_depth")
    )

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, recent = None, RecentTexts(size)
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("_job", "_slice", "key"))
            for job, number, key in zip(*columns):
                if (job, number) != current:
                    current, recent = (job, number), RecentTexts(size)
                out.append(recent.use(key))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*batch.schema.names, "_distance"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema.fields)
    # A slice's seeds come first, the text used longest ago before the others.
    ordered = both.repartition("_job", "_slice").sortWithinPartitions("_job", "_slice", F.col("_depth").desc_nulls_last(), *order)
    measured = ordered.mapInArrow(measure, f"{fields}, _distance int")
    return measured.filter(F.col("_depth").isNull()).drop("_depth")


def _held_after(held, distance: int | None, max_size: int, drops: int):
    """(lookup misses, texts held afterwards) for some numbers of texts held before."""
    miss = np.ones(len(held), dtype=bool) if distance is None else distance >= held
    return miss, np.where(miss, np.where(held >= max_size, held - drops, held) + 1, held)


def _tables(measured: DataFrame, starts: DataFrame, order: Sequence[str], max_size: int) -> DataFrame:
    """(_job, _slice, entries, ends): what each number of texts held before a slice becomes."""
    drops = _drops(max_size)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entries, held = None, None, None

        def row():
            columns = [pa.array([current[0]], pa.string()), pa.array([current[1]], pa.int32())]
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (entries, held)]
            return pa.RecordBatch.from_arrays([*columns, *lists], names=["_job", "_slice", "entries", "ends"])

        for batch in batches:
            for job, number, known, distance in zip(*(batch.column(c).to_pylist() for c in ("_job", "_slice", "_known", "_distance"))):
                if (job, number) != current:
                    if current is not None:
                        yield row()
                    # Before the first drop the cache holds all texts used; from then on it is never emptier than after a drop.
                    current, entries = (job, number), np.array([known]) if known < max_size else np.arange(max_size - drops + 1, max_size + 1)
                    held = entries
                if distance is None or distance > max_size - drops:
                    held = _held_after(held, distance, max_size, drops)[1]
        if current is not None:
            yield row()

    rows = join_keeping_nulls(measured, starts, ["_job", "_slice"], "inner").select("_job", "_slice", *order, "_known", "_distance")
    return _in_order(rows, order).mapInArrow(fold, "_job string, _slice int, entries array<bigint>, ends array<bigint>")


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """The number of texts held before each slice of a job."""
    group = group.sort_values("_slice")
    held, out = 0, []
    for entries, ends in zip(group["entries"], group["ends"]):
        out.append(held)
        held = int(ends[list(entries).index(held)])
    return group[["_job", "_slice"]].assign(_held=out)


def bounded_cache_replay(
    lookups: DataFrame, job: str = "job", order: Sequence[str] = ("doc_id", "para_idx"), max_size: int = fixed.CACHE_SIZE, max_rows: int | None = GROUP_ROWS
) -> DataFrame:
    """Adds `hit` and `held` (texts in the cache after the lookup) to the lookups of every job, taken by the numbers in `order`.

    Rows without a `key` are not looked up and don't come out. Each job starts
    with an empty cache. `order` tells a job's lookups apart.
    """
    drops = _drops(max_size)
    rows = lookups.filter(F.col("key").isNotNull()).withColumn("_job", F.col(job).cast("string"))
    usual, hot = split_hot(rows, ["_job"], max_rows)
    sliced = usual.withColumn("_slice", F.lit(0))
    seeds = starts = None
    if hot is not None:
        cut = cut_into_slices(hot, ["_job"], F.col(order[0]), max_rows, ties=[F.col(c) for c in order[1:]])
        cut = materialize(cut.withColumn("_slice", F.col("_slice").cast("int")))
        seeds = materialize(_latest_before(cut, order, max_size))
        sliced = sliced.unionByName(cut)
    none = sliced.limit(0).select("_job", "_slice", "key", F.lit(0).alias("_depth"))
    measured = reuse_distances(sliced, none if seeds is None else seeds, order, max_size)
    if hot is not None:
        measured = materialize(measured)
        known = seeds.groupBy("_job", "_slice").agg(F.count(F.lit(1)).cast("int").alias("_known"))
        slices = cut.select("_job", "_slice").distinct()  # one row per slice
        starts = join_keeping_nulls(slices, known, ["_job", "_slice"]).na.fill(0, ["_known"])
        tables = _tables(measured, F.broadcast(materialize(starts)), order, max_size)
        held = materialize(tables.groupBy("_job").applyInPandas(_walk, "_job string, _slice int, _held int"))
        measured = join_keeping_nulls(measured, F.broadcast(held), ["_job", "_slice"])
    else:
        measured = measured.withColumn("_held", F.lit(0))
    measured = measured.withColumn("_held", F.coalesce("_held", F.lit(0)))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, 0
        for batch in batches:
            hits, sizes = [], []
            for own_job, number, start, distance in zip(*(batch.column(c).to_pylist() for c in ("_job", "_slice", "_held", "_distance"))):
                if (own_job, number) != current:
                    current, held = (own_job, number), start
                hit = distance is not None and distance < held
                if not hit:
                    held = (held - drops if held >= max_size else held) + 1
                hits.append(hit)
                sizes.append(held)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits), pa.array(sizes, pa.int32())], names=[*batch.schema.names, "hit", "held"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields)
    answered = _in_order(measured, order).mapInArrow(answer, f"{fields}, hit boolean, held int")
    return answered.select(*lookups.columns, "hit", "held")


def bounded_cache_stats(replayed: DataFrame, job: str = "job", order: Sequence[str] = ("doc_id", "para_idx")) -> DataFrame:
    """Hits, misses, lookups, hit rate in percent and final size per job."""
    hits, total = F.sum(F.col("hit").cast("long")), F.count(F.lit(1))
    return replayed.groupBy(job).agg(
        hits.alias("hits"), (total - hits).alias("misses"), total.alias("total_requests"), (hits / total * 100).alias("hit_rate"),
        F.max_by("held", F.struct(*order)).alias("cache_size"),
    )
