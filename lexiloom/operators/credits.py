"""Replay of credit movements with refusals.

Per user, in order: an amount must be positive; adding always works; subtracting
is refused while the balance is smaller than the amount, and a refusal leaves
the balance alone. A running sum would be wrong after the first refusal.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.text import micros
from lexiloom.operators.skew import GROUP_ROWS, cut_into_slices, join_keeping_nulls, split_hot
from lexiloom.session import materialize, shared_folder

OK, INSUFFICIENT, BAD_AMOUNT, NO_USER = "ok", "insufficient", "bad_amount", "no_such_user"


def move(kind: str | None, amount: int | None, balance: int) -> tuple[str, int]:
    """(verdict, balance afterwards) for one movement; a missing amount is no amount."""
    if amount is None or amount <= 0:
        return BAD_AMOUNT, balance
    if kind == "add":
        return OK, balance + amount
    return (OK, balance - amount) if balance >= amount else (INSUFFICIENT, balance)


def _fold_in_order(keys: list[str], opening: str):
    """A pass over rows sorted by `keys`, time and seq: every new key starts from its `opening` balance."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        current, balance = None, 0
        for batch in batches:
            verdicts, balances = [], []
            columns = [batch.column(c).to_pylist() for c in (opening, "kind", "amount", *keys)]
            for start, kind, amount, *key in zip(*columns):
                if key != current:
                    current, balance = key, start
                verdict, balance = move(kind, amount, balance)
                verdicts.append(verdict)
                balances.append(balance)
            added = [pa.array(verdicts, pa.string()), pa.array(balances, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "verdict", "balance"])

    return fold


def _fold_sorted(rows: DataFrame, keys: list[str], opening: str) -> DataFrame:
    """Adds `verdict` and `balance`. Spark sorts and spills; the fold holds one number."""
    judged = T.StructType([*rows.schema, T.StructField("verdict", T.StringType()), T.StructField("balance", T.LongType())])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "_at", "seq").mapInArrow(_fold_in_order(keys, opening), judged)


def replay_credits(
    events: DataFrame,
    accounts: DataFrame | None = None,
    start: int = fixed.START_CREDITS,
    max_rows: int | None = GROUP_ROWS,
) -> DataFrame:
    """Adds `verdict` and the running `balance` to movements (user_id, seq, ts, kind, amount).

    With `accounts` (user_id, credits) everyone starts from their own balance
    and movements of unknown users are refused; otherwise all start from `start`.

    A movement without an amount, or with none above 0, is a `bad_amount` and
    leaves the balance alone.

    Users with more than `max_rows` movements are cut into time slices. A slice
    in which the balance cannot run short changes it by a plain sum, so its
    effect is known without a replay. For the others, refusals bring different
    balances together: all slices find side by side which balances they can end
    with, and then, also side by side, what each balance the slice before can
    end with becomes. The balance before each slice is read off these small
    tables, and all slices are replayed side by side. So the passes over a user's
    movements don't grow with the number of slices. Only after a slice that can
    end with more than `MAX_BALANCES` balances the next one that may run short is
    replayed by itself.
    """
    timed = events.withColumn("_at", micros(F.col("ts")))
    strangers = None
    if accounts is None:
        known = timed.withColumn("_start", F.lit(start).cast("long"))
    else:
        opening = accounts.select("user_id", F.col("credits").cast("long").alias("_start"))
        joined = timed.join(opening, "user_id", "left")
        known = joined.filter(F.col("_start").isNotNull())
        strangers = joined.filter(F.col("_start").isNull())
    usual, hot = split_hot(known, ["user_id"], max_rows)
    result = _fold_sorted(usual, ["user_id"], "_start")
    if hot is not None:
        result = result.unionByName(_replay_hot(hot, max_rows))
    if strangers is not None:
        result = result.unionByName(
            strangers.withColumn("verdict", F.lit(NO_USER)).withColumn("balance", F.lit(None).cast("long"))
        )
    return result.drop("_at", "_start")


# Balances a slice's table may hold, and ranges of balances that are told apart on the way to them.
MAX_BALANCES, MAX_RANGES = 1024, 16_384


def _slice_needs(sliced: DataFrame) -> DataFrame:
    """Per slice: its sum without refusals, the balance it needs so that none happens, and the largest amount taken."""
    good = F.coalesce(F.col("amount"), F.lit(0)) > 0
    adds = F.coalesce(F.col("kind") == "add", F.lit(False))
    moved = F.when(~good, 0).when(adds, F.col("amount")).otherwise(-F.col("amount"))
    order = Window.partitionBy("user_id", "_slice").orderBy("_at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return (
        sliced.withColumn("_moved", moved.cast("long"))
        .withColumn("_sum", F.sum("_moved").over(order))
        .groupBy("user_id", "_slice")
        .agg(
            F.sum("_moved").alias("change"),
            F.greatest(F.lit(0), -F.min("_sum")).alias("needed"),
            F.coalesce(F.max(F.when(good & ~adds, F.col("amount"))), F.lit(0)).alias("largest"),
        )
    )


def _bounds(group: pd.DataFrame) -> pd.DataFrame:
    """The least and the largest balance before each slice.

    Refusals only leave more than the plain sum does. And after the last refusal,
    at which less than the refused amount was there, the rest adds up plainly.
    """
    group = group.sort_values("_slice")
    low = high = int(group["_balance"].iloc[0])
    lows, highs = [], []
    for change, needed, largest in zip(group["change"], group["needed"], group["largest"]):
        lows.append(low)
        highs.append(high)
        if low < needed:
            low, high = max(0, low + int(change)), max(high + int(change), int(largest) - 1 + int(change) + int(needed))
        else:
            low, high = low + int(change), high + int(change)
    return group.assign(low=lows, high=highs).drop(columns="_balance")


class Reachable:
    """The balances that some range of balances can become: separate ranges in order."""

    def __init__(self, low: int, high: int):
        self.lows, self.highs, self.shift = np.array([low]), np.array([high]), 0

    def add(self, amount: int) -> None:
        self.shift += amount

    def take(self, amount: int) -> None:
        need = amount - self.shift
        if self.lows[0] >= need:
            self.shift -= amount
        elif self.highs[-1] >= need:
            stay, go = self.lows < need, self.highs >= need
            lows = np.concatenate([self.lows[stay], np.maximum(self.lows[go], need) - amount])
            highs = np.concatenate([np.minimum(self.highs[stay], need - 1), self.highs[go] - amount])
            order = np.argsort(lows, kind="stable")
            lows, reach = lows[order], np.maximum.accumulate(highs[order])
            first = np.concatenate([[True], lows[1:] > reach[:-1] + 1])
            self.lows, self.highs = lows[first], reach[np.concatenate([first[1:], [True]])]
            if len(self.lows) > MAX_RANGES:  # what lies between counts as reachable too
                self.lows, self.highs = self.lows[:1], self.highs[-1:]

    def ends(self) -> list[int] | None:
        if int((self.highs - self.lows + 1).sum()) > MAX_BALANCES:
            return None
        return [b + self.shift for low, high in zip(self.lows.tolist(), self.highs.tolist()) for b in range(low, high + 1)]


class Balances:
    """What each of some balances becomes."""

    def __init__(self, entries: list[int]):
        self.now, self.shift = np.array(entries, dtype="int64"), 0
        self.low, self.high = int(self.now.min()), int(self.now.max())

    def add(self, amount: int) -> None:
        self.shift += amount

    def take(self, amount: int) -> None:
        need = amount - self.shift
        if self.low >= need:
            self.shift -= amount
        elif self.high >= need:
            self.now[self.now >= need] -= amount
            self.low, self.high = int(self.now.min()), int(self.now.max())

    def ends(self) -> list[int]:
        return (self.now + self.shift).tolist()


def _ends_of_slices(rows: DataFrame, start, given: list[str]) -> DataFrame:
    """(user_id, _slice, ends) of slices whose movements all go through what `start` makes of the `given` columns."""

    def fold(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0]], user), pa.array([current[1]], pa.int32()), pa.array([state.ends()], pa.list_(pa.int64()))],
                names=["user_id", "_slice", "ends"],
            )

        current, state, user = None, None, pa.int64()
        for batch in batches:
            user = batch.schema.field("user_id").type
            at_start = [batch.column(c) for c in given]
            columns = [batch.column(c).to_pylist() for c in ("user_id", "_slice", "kind", "amount")]
            for i, (user_id, number, kind, amount) in enumerate(zip(*columns)):
                if (user_id, number) != current:
                    if current is not None:
                        yield row()
                    current, state = (user_id, number), start(*(c[i].as_py() for c in at_start))
                if amount is not None and amount > 0:
                    if kind == "add":
                        state.add(amount)
                    else:
                        state.take(amount)
        if current is not None:
            yield row()

    columns = rows.select("user_id", "_slice", "_at", "seq", "kind", "amount", *given)
    kind = rows.schema["user_id"].dataType.simpleString()
    ordered = columns.repartition("user_id", "_slice").sortWithinPartitions("user_id", "_slice", "_at", "seq")
    return ordered.mapInArrow(fold, f"user_id {kind}, _slice int, ends array<bigint>")


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """The balances that may come before each slice that can run short, where they are few."""
    group = group.sort_values("_slice")
    now, out = [int(group["_balance"].iloc[0])], []
    for low, needed, change, ends in zip(group["low"], group["needed"], group["change"], group["ends"]):
        out.append(now if low < needed else None)
        if low < needed:
            now = None if ends is None else [int(b) for b in ends]
        elif now is not None:
            now = [b + int(change) for b in now]
    return group[["user_id", "_slice"]].assign(entries=out)


def _balance_tables(sliced: DataFrame, needs: DataFrame, openings: DataFrame) -> DataFrame:
    """(user_id, _slice, entries, ends): what each balance that may come before a slice becomes, for slices that can run short."""
    opened = join_keeping_nulls(needs, openings, ["user_id"], "inner")
    keys = f"user_id {sliced.schema['user_id'].dataType.simpleString()}, _slice int"
    bounds = opened.select("user_id", F.col("_slice").cast("int"), "change", "needed", "largest", "_balance")
    bounds = materialize(bounds.groupBy("user_id").applyInPandas(_bounds, f"{keys}, change long, needed long, largest long, low long, high long"))
    short = bounds.filter(F.col("low") < F.col("needed"))
    ranged = join_keeping_nulls(sliced, F.broadcast(short.select("user_id", "_slice", "low", "high")), ["user_id", "_slice"], "inner")
    ends = materialize(_ends_of_slices(ranged, Reachable, ["low", "high"]))
    before = join_keeping_nulls(join_keeping_nulls(bounds, ends, ["user_id", "_slice"]), openings, ["user_id"], "inner")
    entries = materialize(before.select("user_id", "_slice", "low", "needed", "change", "ends", "_balance").groupBy("user_id").applyInPandas(_entries, f"{keys}, entries array<bigint>"))
    few = entries.filter(F.col("entries").isNotNull())
    asked = join_keeping_nulls(sliced, F.broadcast(few.select("user_id", "_slice")), ["user_id", "_slice"], "inner")
    # The entries travel with a slice's first row only.
    first = Window.partitionBy("user_id", "_slice").orderBy("_at", "seq")
    heads = few.select("user_id", "_slice", F.lit(1).alias("_row"), "entries")
    marked = join_keeping_nulls(asked.withColumn("_row", F.row_number().over(first)), heads, ["user_id", "_slice", "_row"]).drop("_row")
    tables = _ends_of_slices(marked, Balances, ["entries"])
    return materialize(join_keeping_nulls(few, tables, ["user_id", "_slice"], "inner"))


def _advance(group: pd.DataFrame) -> pd.DataFrame:
    """Balances before the next slices, up to the first one that may run short and has no table."""
    group = group.sort_values("_slice")
    balance, out = int(group["_balance"].iloc[0]), []
    for change, needed, entries, ends in zip(group["change"], group["needed"], group["entries"], group["ends"]):
        out.append((balance, False))
        if balance >= needed:
            balance += int(change)
        elif entries is not None:
            balance = dict(zip(entries, ends))[balance]
        else:
            out[-1] = (balance, True)
            break
    return group[["user_id", "_slice"]].head(len(out)).assign(_entry=[b for b, _ in out], _open=[o for _, o in out])


def _replay_hot(hot: DataFrame, max_rows: int) -> DataFrame:
    # Kept by slice, so that a round reads the slices it replays and no others.
    place = f"{shared_folder(hot.sparkSession)}/slices-{uuid.uuid4().hex}"
    cut = cut_into_slices(hot, ["user_id"], F.col("_at"), max_rows, ties=[F.col("seq")])
    cut.repartition("_slice", "user_id").write.partitionBy("_slice").parquet(place)
    sliced = hot.sparkSession.read.schema(cut.schema).parquet(place)
    # One row per slice and hot user, so a user's rows fit one task.
    needs = materialize(_slice_needs(sliced))
    openings = materialize(sliced.groupBy("user_id").agg(F.first("_start").alias("_balance")))
    needs = materialize(join_keeping_nulls(needs, _balance_tables(sliced, needs, openings), ["user_id", "_slice"]))
    state, entries = openings.withColumn("_next", F.lit(0)), None
    kind = hot.schema["user_id"].dataType.simpleString()
    while True:
        ahead = join_keeping_nulls(needs, state, ["user_id"], "inner").filter(F.col("_slice") >= F.col("_next"))
        known = materialize(
            ahead.select("user_id", F.col("_slice").cast("int"), "change", "needed", "entries", "ends", "_balance")
            .groupBy("user_id")
            .applyInPandas(_advance, f"user_id {kind}, _slice int, _entry long, _open boolean")
        )
        if known.isEmpty():
            break
        step = known.select("user_id", "_slice", "_entry")
        entries = step if entries is None else materialize(entries.unionByName(step))
        short = known.filter("_open").select("user_id", "_slice", "_entry")
        # One slice for each hot user at most.
        numbers = [row["_slice"] for row in short.select("_slice").distinct().collect()]
        if not numbers:
            break
        replayed = join_keeping_nulls(sliced.filter(F.col("_slice").isin(numbers)), F.broadcast(short), ["user_id", "_slice"], "inner")
        ended = _fold_sorted(replayed, ["user_id", "_slice"], "_entry").groupBy("user_id").agg(
            F.max_by("balance", F.struct("_at", "seq")).alias("_balance"), (F.max("_slice") + 1).alias("_next")
        )
        state = materialize(ended)
    opened = join_keeping_nulls(sliced.drop("_start"), F.broadcast(entries), ["user_id", "_slice"], "inner")
    return _fold_sorted(opened.withColumnRenamed("_entry", "_start"), ["user_id", "_slice"], "_start").drop("_slice")
