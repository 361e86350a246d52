"""Changes to the ledger in batches: deletes, patches, sign-ups and their verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.session import materialize


def orphans(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose user does not exist."""
    return df.join(users.select("user_id"), "user_id", "left_anti")


def delete_effects(deleted: DataFrame, transactions: DataFrame, history: DataFrame) -> DataFrame:
    """Per user to delete: refused while there are transactions, else how many history rows go along."""
    held = transactions.groupBy("user_id").agg(F.count(F.lit(1)).alias("transactions"))
    owned = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("history_rows"))
    refused = F.col("transactions") > 0
    return (
        deleted.select("user_id")
        .distinct()
        .join(held, "user_id", "left")
        .join(owned, "user_id", "left")
        .select(
            "user_id",
            F.coalesce("transactions", F.lit(0)).alias("transactions"),
            F.when(F.coalesce(refused, F.lit(False)), "refused").otherwise("deleted").alias("outcome"),
            F.when(F.coalesce(refused, F.lit(False)), 0)
            .otherwise(F.coalesce("history_rows", F.lit(0)))
            .cast("long")
            .alias("cascaded"),
        )
    )


def _asks_for_delete(changes: DataFrame) -> Column:
    """Every row of a feed without `action`; otherwise those whose action is `delete`."""
    return F.coalesce(F.col("action") == "delete", F.lit(False)) if "action" in changes.columns else F.lit(True)


def history_delete_verdicts(changes: DataFrame, history: DataFrame) -> DataFrame:
    """Adds `outcome` to a change feed: deleted, not_owner, not_found or already_gone, and other_action for what is no delete request.

    The first owner's request for a row takes it; later requests do not find it.
    """
    asks = _asks_for_delete(changes)
    owners = history.select(F.col("id").alias("history_id"), F.col("user_id").alias("_owner"))
    judged = changes.join(owners, "history_id", "left").withColumn(
        "_fits", asks & F.coalesce(F.col("_owner") == F.col("user_id"), F.lit(False))
    )
    first = (
        judged.filter("_fits").groupBy("history_id").agg(F.min("seq").alias("_first"))
    )
    return (
        judged.join(first, "history_id", "left")
        .withColumn(
            "outcome",
            F.when(~asks, "other_action")
            .when(F.col("_owner").isNull(), "not_found")
            .when(F.col("seq") > F.col("_first"), "already_gone")
            .when(F.col("_fits"), "deleted")
            .otherwise("not_owner"),
        )
        .drop("_owner", "_fits", "_first")
    )


def apply_history_deletes(history: DataFrame, changes: DataFrame) -> DataFrame:
    """History without the rows that their owners deleted."""
    gone = changes.filter(_asks_for_delete(changes)).select(F.col("history_id").alias("id"), "user_id").distinct()
    return history.join(gone, ["id", "user_id"], "left_anti")


def clear_history(history: DataFrame, cleared_users: DataFrame) -> DataFrame:
    """History without any row of the given users."""
    return history.join(cleared_users.select("user_id").distinct(), "user_id", "left_anti")


def apply_changes(
    base: DataFrame, changes: DataFrame, key: str, seq: str, fields: Sequence[str], action: str = "action"
) -> DataFrame:
    """Base table + change feed -> new table.

    A `delete` removes the row; a `patch` sets the fields it gives (NULL or an
    empty text keeps the old value). Per row the newest value of each field
    wins; patches before the last delete have no effect. Rows that the base does
    not hold are not created. One aggregate per feed, no window.
    """
    is_delete = F.col(action) == "delete"
    given = {f: F.col(f).isNotNull() & (F.col(f).cast("string") != "") for f in fields}
    folded = changes.groupBy(key).agg(
        F.max(F.when(is_delete, F.col(seq))).alias("_deleted_at"),
        *[
            F.max_by(F.col(f), F.when(~is_delete & given[f], F.col(seq))).alias(f"_new_{f}")
            for f in fields
        ],
    )
    return (
        base.join(folded, key, "left")
        .filter(F.col("_deleted_at").isNull())
        .withColumns({f: F.coalesce(F.col(f"_new_{f}"), F.col(f)) for f in fields})
        .drop("_deleted_at", *[f"_new_{f}" for f in fields])
    )


def change_outcomes(judged: DataFrame, batch: Sequence[str] = ()) -> DataFrame:
    """Rows per outcome, per batch when batch columns are given."""
    return judged.groupBy(*batch, "outcome").agg(F.count(F.lit(1)).alias("changes"))


def register_defaults(signups: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New accounts with their defaults; `duplicate` names the field that is taken, if any.

    A field is taken when an earlier sign-up or an existing user has it.
    """
    firsts = {
        field: signups.groupBy(field).agg(F.min("seq").alias(f"_first_{field}")) for field in ("username", "email")
    }
    return _with_defaults(signups, firsts, existing)


def _with_defaults(signups: DataFrame, firsts: dict[str, DataFrame], existing: DataFrame | None) -> DataFrame:
    """Sign-ups judged by the number (`_first_...`) of the sign-up that took each name and e-mail first."""
    judged = signups
    for field, first in firsts.items():
        judged = judged.join(first, field, "left")
        taken = F.coalesce(F.col("seq") > F.col(f"_first_{field}"), F.lit(False))
        if existing is not None:
            known = existing.select(field).distinct().withColumn(f"_known_{field}", F.lit(True))
            judged = judged.join(known, field, "left")
            taken = taken | F.coalesce(F.col(f"_known_{field}"), F.lit(False))
        judged = judged.withColumn(f"_taken_{field}", taken)
    return judged.select(
        *signups.columns,
        F.lit(fixed.START_CREDITS).cast("long").alias("credits"),
        F.lit(fixed.ACCOUNT_TYPE).alias("account_type"),
        F.lit(True).alias("is_active"),
        F.when(F.col("_taken_username"), "username").when(F.col("_taken_email"), "email").alias("duplicate"),
    )


def accepted_in_turn(signups: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """`seq, username, email` of the sign-ups that go through when they are taken one after the other by `seq`.

    A sign-up goes through if no existing user, and no earlier sign-up that went
    through, has its name or e-mail; a refused one takes nothing. Missing fields
    clash with nothing, and `seq` tells sign-ups apart. Rounds instead of turns:
    whoever is the first of all still open by name and by e-mail goes through,
    which settles all others with that name or e-mail. A round is two minima and
    joins, so a name of a third of all sign-ups is no problem, and is stored. In
    random order rounds grow with the logarithm of the table; a chain of sign-ups
    each of which clashes with the next one only takes as many rounds as half of
    its length.
    """
    fields = ("username", "email")
    undecided = signups.select("seq", *fields)
    if existing is not None:
        for field in fields:
            undecided = undecided.join(existing.select(field), field, "left_anti")
    undecided = materialize(undecided)
    accepted = undecided.limit(0)
    while not undecided.isEmpty():
        judged, first = undecided, F.lit(True)
        for field in fields:
            firsts = undecided.groupBy(field).agg(F.min("seq").alias(f"_first_{field}"))
            judged = judged.join(firsts, field, "left")
            first = first & (F.col(field).isNull() | (F.col("seq") == F.col(f"_first_{field}")))
        through = materialize(judged.filter(first).select("seq", *fields))
        accepted = accepted.unionByName(through)
        rest = undecided
        for field in (*fields, "seq"):
            rest = rest.join(through.select(field), field, "left_anti")
        undecided = materialize(rest.select("seq", *fields))
    return accepted


def register_in_turn(signups: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """As `register_defaults`, but a field is taken only by an existing user or an earlier sign-up that went through."""
    accepted = accepted_in_turn(signups, existing)
    firsts = {field: accepted.groupBy(field).agg(F.min("seq").alias(f"_first_{field}")) for field in ("username", "email")}
    return _with_defaults(signups, firsts, existing)


def validate_user_changes(changes: DataFrame, users: DataFrame) -> DataFrame:
    """Adds `outcome` to user changes: ok or the reason of refusal.

    Changes have `user_id`, `action` (role, active, add, subtract or delete) and
    `value` as text.
    """
    known = users.select("user_id").withColumn("_known", F.lit(True))
    value = F.col("value")
    amount = F.expr("try_cast(value AS BIGINT)")
    bad = (
        ((F.col("action") == "role") & ~value.isin(*fixed.ACCOUNT_TYPES))
        | ((F.col("action") == "active") & ~value.isin("0", "1"))
        | (F.col("action").isin("add", "subtract") & ~F.coalesce(amount > 0, F.lit(False)))
    )
    reason = F.when(F.col("action") == "role", "bad_role").when(F.col("action") == "active", "bad_status")
    return (
        changes.join(known, "user_id", "left")
        .withColumn(
            "outcome",
            F.when(F.col("_known").isNull(), "no_such_user")
            .when(F.coalesce(bad, F.lit(True)), reason.otherwise("bad_amount"))
            .otherwise("ok"),
        )
        .drop("_known")
    )


def patch_config(base: DataFrame, patch: DataFrame, key: str = "id") -> DataFrame:
    """Partial updates of many tenants' settings: NULL keeps, empty patches are refused, missing rows are inserted.

    `outcome` says what happened: unchanged, refused, updated or inserted.
    Refused patches of rows that do not exist leave nothing behind.
    """
    fields = [c for c in base.columns if c != key]
    filled = F.lit(False)
    for f in fields:
        filled = filled | F.col(f"_p_{f}").isNotNull()
    renamed = patch.select(key, F.lit(True).alias("_patched"), *[F.col(f).alias(f"_p_{f}") for f in fields])
    joined = base.withColumn("_based", F.lit(True)).join(renamed, key, "full")
    return (
        joined.withColumn(
            "outcome",
            F.when(F.col("_patched").isNull(), "unchanged")
            .when(~filled, "refused")
            .when(F.col("_based").isNull(), "inserted")
            .otherwise("updated"),
        )
        .filter(F.col("_based").isNotNull() | (F.col("outcome") == "inserted"))
        .select(key, *[F.coalesce(F.col(f"_p_{f}"), F.col(f)).alias(f) for f in fields], "outcome")
    )
