"""Rows at given positions of a table's order, found by counting instead of sorting.

The order is taken as a row of 64-bit numbers (time, then parts of the key that
breaks ties). Counts per range of the first number tell in which range a position
lies; that range is counted again in finer ones, and a crowd of one value by the
next number, until the range holds few enough rows to be sorted by one task. Each
round counts in `BINS` ranges at most, and a 64-bit number takes seven rounds at
the worst; a table of few rows takes none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions.text import micros

BINS = 1024
SORTED_ROWS = 10_000
# Bytes of a text that one number holds, and numbers that a text is ordered by; texts that agree in these are sorted together.
TEXT_BYTES, TEXT_NUMBERS = 6, 6


@dataclass(frozen=True)
class Number:
    """One number of the order, rising, and where its missing values stand."""

    value: Column
    nulls_first: bool
    wide: bool = False  # may need more bits than a double holds
    unfinished: Column | None = None  # rows with equal numbers that may differ further on, before the next number counts

    def before(self, bound: int | None) -> Column:
        """The number comes before `bound` (None: a missing value)."""
        if bound is None:
            return F.lit(False) if self.nulls_first else self.value.isNotNull()
        return F.coalesce(self.value < F.lit(bound), F.lit(self.nulls_first))

    def after(self, bound: int | None) -> Column:
        if bound is None:
            return self.value.isNotNull() if self.nulls_first else F.lit(False)
        return F.coalesce(self.value > F.lit(bound), F.lit(not self.nulls_first))

    def equals(self, bound: int | None) -> Column:
        return self.value.isNull() if bound is None else F.coalesce(self.value == F.lit(bound), F.lit(False))


def numbers_of(df: DataFrame, name: str, descending: bool = False) -> list[Number]:
    """The numbers a column is ordered by, as Spark sorts it; none for kinds that numbers don't order."""
    kind, column = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        values = [micros(column)]
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        values = [column.cast("long")]
    elif isinstance(kind, T.StringType):
        part = lambda i: F.substring(F.encode(column, "UTF-8"), TEXT_BYTES * i + 1, TEXT_BYTES)
        values = [F.conv(F.rpad(F.hex(part(i)), 2 * TEXT_BYTES, "0"), 16, 10).cast("long") for i in range(TEXT_NUMBERS)]
    else:
        values = []
    numbers = [Number(F.bitwise_not(v) if descending else v, not descending, isinstance(kind, T.LongType)) for v in values]
    if isinstance(kind, T.StringType):
        numbers[-1] = replace(numbers[-1], unfinished=F.octet_length(column) > TEXT_BYTES * TEXT_NUMBERS)
    return numbers


def small_numbers(numbers: Sequence[Number]) -> list[Column]:
    """The same order by numbers that doubles hold exactly: wide ones by halves. Missing values become the least or the largest."""
    out = []
    for number in numbers:
        bound = 2**63 if number.wide else 2**50
        whole = F.coalesce(number.value, F.lit(-bound if number.nulls_first else bound - 1))
        out += [F.shiftright(whole, 32), whole.bitwiseAND(F.lit(2**32 - 1))] if number.wide else [whole]
    return out


@dataclass(frozen=True)
class Region:
    """Rows next to each other in the order: `fixed` values of the first numbers, and a range of the next one.

    `before` rows come before them; `rows` lie inside.
    """

    numbers: tuple[Number, ...]
    fixed: tuple[int | None, ...]
    low: int | None
    high: int | None
    before: int
    rows: int

    def _beyond(self, far, bound) -> Column:
        """Rows on one side: equal in the first numbers and beyond in the one after them."""
        equal, cases = F.lit(True), []
        for number, value in zip(self.numbers, (*self.fixed, bound)):
            cases.append(equal & far(number, value))
            equal = equal & number.equals(value)
        return reduce(Column.__or__, cases, F.lit(False))

    def starts_after(self) -> Column:
        """The row comes before this region."""
        return self._beyond(Number.before, self.low)

    def ends_before(self) -> Column:
        """The row comes after this region."""
        return self._beyond(Number.after, self.high)


def locate(df: DataFrame, numbers: Sequence[Number], rank: int, sorted_rows: int = SORTED_ROWS) -> Region | None:
    """A region that holds the row at `rank` (from 1); None if there is no such row.

    It has at most `sorted_rows` rows, unless more rows agree in all numbers, or
    in all the numbers of long texts.
    """
    inside, fixed, before, numbers = F.lit(True), (), 0, tuple(numbers)
    n = None
    for number in numbers:
        scope = df.filter(inside)
        row = scope.agg(F.count(F.lit(1)), F.count(number.value), F.min(number.value), F.max(number.value)).first()
        n, present, low, high = row
        if n < rank - before:
            return None
        missing = n - present
        ahead = missing if number.nulls_first else present
        in_missing = missing > 0 and (rank - before <= ahead if number.nulls_first else rank - before > ahead)
        if in_missing:
            before, n, low, high = before + (0 if number.nulls_first else present), missing, None, None
        else:
            before, n = before + (missing if number.nulls_first else 0), present
        while n > sorted_rows and low != high:
            shift = max(0, ((high - low) // BINS).bit_length())
            bins = scope.filter(number.value.between(low, high)).groupBy(F.shiftright(number.value, shift).alias("bin")).count()
            for place, count in sorted(bins.collect()):
                if rank - before <= count:
                    break
                before += count
            low, high, n = max(low, place << shift), min(high, (place + 1 << shift) - 1), count
        crowd = inside & number.equals(low)
        if n <= sorted_rows or number.unfinished is not None and not df.filter(crowd & number.unfinished).isEmpty():
            return Region(numbers, fixed, low, high, before, n)
        inside, fixed = crowd, (*fixed, low)
    if n is None:
        n = df.count()
        return Region((), (), None, None, 0, n) if rank <= n else None
    return Region(numbers, fixed[:-1], fixed[-1], fixed[-1], before, n)


def rows_at(
    df: DataFrame, numbers: Sequence[Number], order: Sequence[Column], skip: int, limit: int, sorted_rows: int = SORTED_ROWS, name: str = "_rank"
) -> DataFrame:
    """The rows at positions `skip + 1` to `skip + limit`, with their position as `name`.

    Only the regions of the first and the last of them and what lies between are
    sorted: at most `limit + 2 * sorted_rows` rows, wherever they are and however
    crowded their times.
    """
    first = locate(df, numbers, skip + 1, sorted_rows)
    if first is None:
        return df.limit(0).withColumn(name, F.lit(0).cast("long"))
    wanted = df.filter(~first.starts_after())
    if skip + limit <= first.before + first.rows:
        wanted = wanted.filter(~first.ends_before())
    elif (last := locate(df, numbers, skip + limit, sorted_rows)) is not None:
        wanted = wanted.filter(~last.ends_before())
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + F.lit(first.before)
    ranked = wanted.withColumn(name, place.cast("long"))
    return ranked.filter((F.col(name) > skip) & (F.col(name) <= skip + limit))


def first_rows(df: DataFrame, numbers: Sequence[Number], order: Sequence[Column], n: int, sorted_rows: int = SORTED_ROWS) -> DataFrame:
    """The first `n` rows. Those before the region in which the bound falls stay where they are; only that region is sorted."""
    if n <= 0:
        return df.limit(0)
    region = locate(df, numbers, n, sorted_rows)
    if region is None:
        return df
    sure = df.filter(region.starts_after())
    at_bound = df.filter(~region.starts_after() & ~region.ends_before())
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    kept = at_bound.withColumn("_place", place).filter(F.col("_place") <= n - region.before).drop("_place")
    return sure.unionByName(kept)
