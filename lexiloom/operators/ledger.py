"""Reading the usage ledger: filters, lookups, totals, pages and billing."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.text import iso_text, micros
from lexiloom.operators.selection import numbers_of, rows_at, small_numbers
from lexiloom.operators.skew import take_ranks

PURCHASE, USAGE = "purchase", "usage"
MAX_LIMIT = 1000
# Spark prunes ranks inside each task before the shuffle up to this rank; deeper pages are found by counts per hour.
TASK_PRUNED_RANKS = 1000


def _all_of(conditions: Iterable[Column]) -> Column:
    return reduce(Column.__and__, conditions, F.lit(True))


def _clock_time(value) -> Column:
    """A literal without a zone, so that the comparison reaches the scan."""
    return F.lit(str(value)).cast("timestamp_ntz")


def transaction_condition(user_id=None, start=None, end=None, transaction_type=None) -> Column:
    """All given conditions on a transaction; both dates are inclusive.

    A type other than purchase or usage filters nothing.
    """
    wanted = (transaction_type or "").lower()
    conditions = []
    if user_id is not None:
        conditions.append(F.col("user_id") == user_id)
    if start is not None:
        conditions.append(F.col("created_at") >= _clock_time(start))
    if end is not None:
        conditions.append(F.col("created_at") <= _clock_time(end))
    if wanted in (PURCHASE, USAGE):
        conditions.append(F.col("transaction_type") == wanted)
    return _all_of(conditions)


def filter_transactions(df: DataFrame, user_id=None, start=None, end=None, transaction_type=None) -> DataFrame:
    """Rows that meet every given condition."""
    return df.filter(transaction_condition(user_id, start, end, transaction_type))


def filter_history(df: DataFrame, user_id=None, start=None, end=None, source=None, target=None) -> DataFrame:
    """History rows that meet every given condition; languages match exactly."""
    conditions = []
    if user_id is not None:
        conditions.append(F.col("user_id") == user_id)
    if start is not None:
        conditions.append(F.col("created_at") >= _clock_time(start))
    if end is not None:
        conditions.append(F.col("created_at") <= _clock_time(end))
    if source:
        conditions.append(F.col("source_language") == source)
    if target:
        conditions.append(F.col("target_language") == target)
    return df.filter(_all_of(conditions))


def match_username(df: DataFrame, pattern: str | None) -> DataFrame:
    """Usernames containing `pattern` in any case; `%` and `_` in it are wildcards."""
    return df.filter(F.col("username").ilike(f"%{pattern}%")) if pattern else df


def transactions_of_username(transactions: DataFrame, users: DataFrame, pattern: str) -> DataFrame:
    """Transactions of the users whose name matches."""
    matching = match_username(users.select("user_id", "username"), pattern)
    return transactions.join(matching, "user_id")


def enrich_username(df: DataFrame, users: DataFrame, fallback: bool = False) -> DataFrame:
    """Adds `username`; without a user it is NULL, or `User <id>` with `fallback`.

    No broadcast hint: the user table grows with the business, so its size
    decides between a broadcast and a shuffled join.
    """
    named = df.join(users.select("user_id", "username"), "user_id", "left")
    return name_or_id(named) if fallback else named


def name_or_id(named: DataFrame) -> DataFrame:
    """`username`, or `User <id>` where it is NULL."""
    default = F.concat(F.lit("User "), F.col("user_id").cast("string"))
    return named.withColumn("username", F.coalesce("username", default))


def public_users(users: DataFrame) -> DataFrame:
    """Users without the password; the scan never reads that column."""
    shown = ["username", "email", "created_at", "updated_at", "last_login", "is_active", "credits", "account_type"]
    return users.select(F.col("user_id").alias("id"), *[c for c in shown if c in users.columns])


def ledger_output(df: DataFrame, amounts: tuple[str, ...] = ("amount",)) -> DataFrame:
    """Output shape: money as double, time as ISO text."""
    return df.withColumns(
        {**{c: F.col(c).cast("double") for c in amounts if c in df.columns}, "created_at": iso_text(F.col("created_at"))}
    )


def normalize_transaction_type(kind: Column) -> Column:
    """`purchase` in any case stays; everything else is usage."""
    return F.when(F.lower(kind) == PURCHASE, PURCHASE).otherwise(USAGE)


def payment_outcome(payments: DataFrame) -> DataFrame:
    """Adds `success` and `outcome` by the provider's status."""
    status = F.col("status")
    outcome = F.when(status == "PAID", "paid").when(status == "CANCELLED", "cancelled").otherwise("pending")
    return payments.withColumn("outcome", outcome).withColumn("success", F.coalesce(status == "PAID", F.lit(False)))


def ledger_totals(df: DataFrame, wanted: Column | None = None, totals_scope: str = "all") -> DataFrame:
    """One row: `total` of the wanted rows, and purchase and usage sums, in one pass.

    With scope `all` the sums ignore `wanted`; with `filtered` they follow it.
    """
    chosen = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    summed_rows = F.lit(True) if totals_scope == "all" else chosen

    def summed(kind: str) -> Column:
        amount = F.when(summed_rows & (F.col("transaction_type") == kind), F.col("amount"))
        return F.coalesce(F.sum(amount), F.lit(0)).cast("double")

    return df.agg(
        F.count(F.when(chosen, 1)).alias("total"),
        summed(PURCHASE).alias("total_purchase"),
        summed(USAGE).alias("total_usage"),
    )


def _check_page(skip: int, limit: int, max_limit: int) -> None:
    if skip < 0:
        raise ValueError("skip must not be negative")
    if not 1 <= limit <= max_limit:
        raise ValueError(f"limit must be between 1 and {max_limit}")


def order_by_time(df: DataFrame, direction: str = "desc", time: str = "created_at", tie: str = "id") -> DataFrame:
    """Newest first unless `direction` is asc; the id makes the order repeatable."""
    if (direction or "").lower() == "asc":
        return df.orderBy(F.col(time).asc(), F.col(tie).asc())
    return df.orderBy(F.col(time).desc(), F.col(tie).desc())


def page(
    df: DataFrame,
    skip: int = 0,
    limit: int = 100,
    direction: str = "desc",
    time: str = "created_at",
    tie: str = "id",
    max_limit: int = MAX_LIMIT,
) -> DataFrame:
    """One page of the table in time order, also where one moment holds all rows.

    For the first `TASK_PRUNED_RANKS` rows every task keeps no more than these;
    deeper pages are found by counting and cost the same at any depth.
    """
    _check_page(skip, limit, max_limit)
    rising = (direction or "").lower() == "asc"
    order = [F.col(time).asc(), F.col(tie).asc()] if rising else [F.col(time).desc(), F.col(tie).desc()]
    if skip + limit <= TASK_PRUNED_RANKS:
        return df.orderBy(*order).offset(skip).limit(limit)
    numbers = [n for name in (time, tie) for n in numbers_of(df, name, descending=not rising)]
    return order_by_time(rows_at(df, numbers, order, skip, limit).drop("_rank"), direction, time, tie)


def page_per_user(
    df: DataFrame, skip: int = 0, limit: int = 100, direction: str = "desc", time: str = "created_at", tie: str = "id"
) -> DataFrame:
    """The same page of every user in one job, with `position` and the user's `total`."""
    _check_page(skip, limit, MAX_LIMIT)
    last = skip + limit
    rising = (direction or "").lower() == "asc"
    order = [F.col(c).asc() if rising else F.col(c).desc() for c in (time, tie)]
    if last > TASK_PRUNED_RANKS:
        at = micros(F.col(time)) * (1 if rising else -1)
        ties = small_numbers(numbers_of(df, tie, descending=not rising))
        wanted = take_ranks(df, ["user_id"], at, order, skip, limit, nulls_first=rising, name="position", ties=ties)
    else:
        ranked = df.withColumn("position", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
        wanted = ranked.filter(F.col("position") <= last).filter(F.col("position") > skip)
    totals = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"))
    return wanted.join(totals, "user_id")


def bill_usage(df: DataFrame, text: str = "input_text", utc: str = "created_at", divisor: int = 1) -> DataFrame:
    """Adds `character_count`, `credits_used` (one per `divisor` characters, at least 1) and `local_time` (UTC+7)."""
    length = F.length(text)
    credits = F.greatest(F.lit(1), F.ceil(length / F.lit(divisor))).cast("decimal(10,2)")
    shift = F.expr(f"INTERVAL '{fixed.LOCAL_OFFSET_HOURS}' HOUR")
    return df.withColumns(
        {"character_count": length, "credits_used": credits, "local_time": F.col(utc) + shift}
    )
