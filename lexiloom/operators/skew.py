"""Groups too large for one task, and ordered work on them.

A window or a grouped fold sends every row of a group to one task. That is fine
for ordinary groups. A group that holds, say, a third of a table is first cut
into *slices*: ranges of the ordering value taken from approximate quantiles of
that group, so the cut follows the data. Ordered work then runs per (group,
slice), and a small table with one row per slice carries the state over the
slice borders. Results are the same as for one big window.

Sizes of what is broadcast here: a hot group has more than `max_rows` rows, so
there are fewer than `rows / max_rows` hot groups, and every hot group gets
`ceil(rows of it / max_rows)` slices at most. With the default that is under
two million small rows for a table of 10^12 rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.session import materialize

GROUP_ROWS = 1_000_000
MAX_SLICES = 1024
_STRIDE = 32


def join_keeping_nulls(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on `keys` where NULL matches NULL; the right side's keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


# Rows of a group at the limit that a sample is meant to hold, so that it is judged within a few percent.
SAMPLED_ROWS = 2000


def hot_groups(df: DataFrame, keys: Sequence[str], max_rows: int = GROUP_ROWS) -> DataFrame:
    """Keys with more than about `max_rows` rows, and their estimated counts.

    Keys are counted in a sample, so most keys never reach the shuffle. Which
    groups count as hot decides only how work is spread, never a result.
    """
    share = min(1.0, SAMPLED_ROWS / max_rows)
    seen = df.select(*keys) if share == 1.0 else df.select(*keys).sample(share, seed=1)
    counted = seen.groupBy(*keys).agg((F.count(F.lit(1)) / F.lit(share)).cast("long").alias("_rows"))
    return counted.filter(F.col("_rows") > max_rows)


def split_hot(
    df: DataFrame, keys: Sequence[str], max_rows: int | None = GROUP_ROWS
) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary groups, rows of hot groups or None when there are none).

    Looking for hot groups is one narrow scan of a sample: only the key columns are read.
    `max_rows=None` skips it, for callers who know that their groups are small.
    """
    if max_rows is None:
        return df, None
    # Fewer than rows / max_rows keys; kept, so that both sides agree on them.
    hot = hot_groups(df, keys, max_rows).select(*keys)
    if hot.isEmpty():
        return df, None
    names = F.broadcast(materialize(hot))
    return join_keeping_nulls(df, names, keys, "left_anti"), join_keeping_nulls(df, names, keys, "left_semi")


def cut_into_slices(
    df: DataFrame, keys: Sequence[str], order: Column, max_rows: int = GROUP_ROWS, slices: int = MAX_SLICES, ties: Sequence[Column] = ()
) -> DataFrame:
    """Adds `_slice`: 0-based ranges of the numeric `order`, each near `max_rows` rows per group.

    One cut gives a group at most `slices` borders; slices that are still too
    large are cut again. Rows with equal `order` share a slice, unless numeric
    `ties` are given that the caller sorts by next: then crowds of one value are
    cut by those. The borders are approximate quantiles; their precision affects
    only how even the slices are.
    """
    cut = _cut_once(df, keys, order, max_rows, slices)
    by, at = [*keys, "_slice"], order.cast("double")
    counted = cut.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), (F.min(at) == F.max(at)).alias("_one_value"))
    large = counted.filter(F.col("_n") > 2 * max_rows).select(*by, "_one_value")
    large = materialize(large if ties else large.filter(~F.col("_one_value")))
    if large.isEmpty():
        return cut
    first = f"_outer{len(keys)}"  # another name at each depth
    outer = [*keys, first]
    marked = join_keeping_nulls(cut, F.broadcast(large), by).withColumnRenamed("_slice", first)
    kept = marked.filter(F.col("_one_value").isNull()).drop("_one_value").withColumn("_slice", F.lit(0))
    ranges = marked.filter(~F.col("_one_value")).drop("_one_value")
    parts = [kept, cut_into_slices(ranges, outer, order, max_rows, slices, ties)]
    if ties:
        crowds = marked.filter("_one_value").drop("_one_value")
        parts.append(cut_into_slices(crowds, outer, ties[0], max_rows, slices, ties[1:]))
    whole = reduce(DataFrame.unionByName, [p.withColumn("_slice", F.col("_slice").cast("int")) for p in parts])
    whole = materialize(whole.withColumnRenamed("_slice", "_inner"))
    in_turn = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(first, "_inner")
    numbers = whole.select(*outer, "_inner").distinct().withColumn("_slice", F.row_number().over(in_turn) - 1)
    return join_keeping_nulls(whole, F.broadcast(numbers), [*outer, "_inner"]).drop(first, "_inner")


def _cut_once(df: DataFrame, keys: Sequence[str], order: Column, max_rows: int, slices: int) -> DataFrame:
    """Even numbers are ranges between borders, odd ones the borders themselves: a crowded value gets a slice of its own."""
    at = order.cast("double")
    points = [i / slices for i in range(1, slices)]
    sketch = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"), F.percentile_approx(at, F.lit(points), 10 * slices).alias("_points")
    )
    wanted = F.least(F.lit(slices), F.ceil(F.col("_rows") / F.lit(max_rows))).cast("int")
    step = F.greatest(F.lit(1), F.floor(F.lit(slices) / wanted)).cast("int")
    borders = sketch.select(
        *keys,
        F.when(wanted <= 1, F.array().cast("array<double>"))
        .otherwise(F.array_distinct(F.filter("_points", lambda _, i: (i + 1) % step == 0)))
        .alias("_borders"),
    )
    # Two short scans instead of one over all borders: every 32nd, then the 32 between.
    coarse = F.filter("_borders", lambda _, i: (i + 1) % F.lit(_STRIDE) == 0)
    passed = F.size(F.filter(coarse, lambda b: b < F.col("_sliced_by"))) * F.lit(_STRIDE)
    fine = F.slice("_borders", F.col("_passed") + 1, F.lit(_STRIDE))
    if keys:
        joined = join_keeping_nulls(df, F.broadcast(borders), keys)
    else:
        # One group: its borders are at most `slices` numbers and become a literal.
        joined = df.withColumn("_borders", F.array(*[F.lit(b) for b in borders.first()["_borders"]]).cast("array<double>"))
    place = F.col("_passed") + F.size(F.filter(fine, lambda b: b < F.col("_sliced_by")))
    on_border = F.coalesce(F.get("_borders", F.col("_place")) == F.col("_sliced_by"), F.lit(False))
    return (
        joined.withColumn("_sliced_by", at)
        .withColumn("_passed", passed)
        .withColumn("_place", place)
        .withColumn("_slice", F.col("_place") * 2 + on_border.cast("int"))
        .drop("_borders", "_sliced_by", "_passed", "_place")
    )


def running_count(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position in `order` within `keys`, over slices set by `cut_into_slices`."""
    here = Window.partitionBy(*keys, "_slice").orderBy(*order)
    totals = df.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return (
        join_keeping_nulls(df.withColumn(name, F.row_number().over(here)), F.broadcast(offsets), [*keys, "_slice"])
        .withColumn(name, F.col(name) + F.col("_before"))
        .drop("_before")
    )


def running_islands(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    shown: Column,
    compared: Column,
    breaks,
    name: str,
) -> DataFrame:
    """0-based island numbers over slices.

    `breaks(previous_shown, compared)` says that a row starts a new island after
    its predecessor. Only the first and last row of a slice matter across the
    border, so the carried table holds one row per slice.
    """
    here = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    marked = (
        df.withColumn("_shown", shown)
        .withColumn("_compared", compared)
        .withColumn("_pos", F.row_number().over(here))
        .withColumn("_prev", F.lag("_shown").over(here))
        .withColumn(
            "_step",
            F.when((F.col("_pos") > 1) & breaks(F.col("_prev"), F.col("_compared")), 1).otherwise(0),
        )
        .withColumn("_local", F.sum("_step").over(upto))
    )
    borders = marked.groupBy(*keys, "_slice").agg(
        F.max_by("_shown", "_pos").alias("_last"),
        F.min_by("_compared", "_pos").alias("_first"),
        F.sum("_step").alias("_inner"),
    )
    by_slice = Window.partitionBy(*keys).orderBy("_slice")
    crossing = F.when(breaks(F.lag("_last").over(by_slice), F.col("_first")), 1).otherwise(0)
    carried = (
        borders.withColumn("_crossing", crossing)
        .withColumn("_inner_before", F.coalesce(F.sum("_inner").over(by_slice.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("_crossings", F.sum("_crossing").over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*keys, "_slice", (F.col("_inner_before") + F.col("_crossings")).alias("_offset"))
    )
    return (
        join_keeping_nulls(marked, F.broadcast(carried), [*keys, "_slice"])
        .withColumn(name, F.col("_local") + F.col("_offset"))
        .drop("_shown", "_compared", "_pos", "_prev", "_step", "_local", "_offset")
    )


HOUR = 3_600_000_000


def take_ranks(
    df: DataFrame, keys: Sequence[str], at: Column, order: Sequence[Column], skip: int, limit: int, nulls_first: bool,
    name: str = "_rank", ties: Sequence[Column] = (), max_rows: int = GROUP_ROWS,
) -> DataFrame:
    """The rows at positions `skip + 1` to `skip + limit` of every group, with their position as `name`.

    `order` is a total order that starts with the number `at` (microseconds,
    rising). Rows are counted per hour first. That tells which hours hold the
    wanted positions, at most one more than there are positions, so only rows
    of these hours are sorted, wherever in the group they lie. Groups with more
    than `max_rows` rows in such hours are cut into slices, by time and then by
    the numeric `ties`, and counted through slice by slice.
    """
    hour, group = F.floor(at / F.lit(HOUR)), keys
    by_hour = F.col("_hour").asc_nulls_first() if nulls_first else F.col("_hour").asc_nulls_last()
    hours = df.groupBy(*keys, hour.alias("_hour")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy(by_hour).rowsBetween(Window.unboundedPreceding, 0)
    counted = hours.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_ahead", F.col("_upto") - F.col("_n"))
    wanted = counted.filter((F.col("_upto") > skip) & (F.col("_ahead") < skip + limit))
    before = wanted.select(*keys, "_hour", F.min("_ahead").over(Window.partitionBy(*group)).alias("_ahead"))
    near = join_keeping_nulls(df.withColumn("_hour", hour), before, [*keys, "_hour"], "inner")
    crowded = wanted.groupBy(*keys).agg(F.sum("_n").alias("_n")).filter(F.col("_n") > max_rows).select(*keys)
    usual, crowds = near, None
    if not crowded.isEmpty():  # fewer than rows / max_rows groups
        names = F.broadcast(materialize(crowded))
        usual, crowds = (join_keeping_nulls(near, names, keys, how) for how in ("left_anti", "left_semi"))
    ranked = usual.withColumn("_pos", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    if crowds is not None:
        edge = F.lit(-(2**62) if nulls_first else 2**62)  # rows without a time are a crowd of their own
        sliced = materialize(cut_into_slices(crowds, keys, F.coalesce(at, edge), max_rows, ties=ties))
        ranked = ranked.unionByName(running_count(sliced, keys, order, "_pos").drop("_slice"))
    ranked = ranked.withColumn(name, (F.col("_pos") + F.col("_ahead")).cast("int"))
    return ranked.filter((F.col(name) > skip) & (F.col(name) <= skip + limit)).drop("_hour", "_ahead", "_pos")
