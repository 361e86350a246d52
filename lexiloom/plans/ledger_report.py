"""The ledger report: one page of transactions with names, its totals, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.operators.ledger import (
    enrich_username,
    ledger_output,
    ledger_totals,
    match_username,
    order_by_time,
    page,
    transaction_condition,
)


def transactions_report(
    transactions: DataFrame,
    users: DataFrame,
    skip: int = 0,
    limit: int = 10,
    direction: str = "desc",
    start=None,
    end=None,
    transaction_type: str | None = None,
    username: str | None = None,
    totals_scope: str = "all",
) -> DataFrame:
    """Filtered transactions, newest first, with username and the totals on every row.

    The page is cut before names are looked up, so the join sees `limit` rows
    only. `totals_scope` is `all` (sums over the whole ledger) or `filtered`.
    """
    wanted = transaction_condition(None, start, end, transaction_type)
    rows = transactions
    if username:
        named_so = match_username(users.select("user_id", "username"), username).select("user_id", F.lit(True).alias("_named_so"))
        rows = transactions.join(named_so, "user_id", "left")
        wanted = wanted & F.coalesce("_named_so", F.lit(False))
    totals = ledger_totals(rows, wanted, totals_scope)
    chosen = page(rows.filter(wanted).select(*transactions.columns), skip, limit, direction)
    return order_by_time(ledger_output(_beside(enrich_username(chosen, users), totals)), direction)


def revenue_report(
    transactions: DataFrame, users: DataFrame, skip: int = 0, limit: int = 100, direction: str = "desc", start=None, end=None
) -> DataFrame:
    """Purchases only, `User <id>` where the user is gone, with `total` and `total_revenue`."""
    wanted = transaction_condition(None, start, end, "purchase")
    totals = ledger_totals(transactions, wanted).select("total", F.col("total_purchase").alias("total_revenue"))
    named = enrich_username(page(transactions.filter(wanted), skip, limit, direction), users, fallback=True)
    return order_by_time(ledger_output(_beside(named, totals)), direction)


def _beside(rows: DataFrame, one_row: DataFrame) -> DataFrame:
    """Puts the columns of a one-row table on every row of a page."""
    one = F.lit(1).alias("_one")
    return rows.select("*", one).join(F.broadcast(one_row.select("*", one)), "_one").drop("_one")
