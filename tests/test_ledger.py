"""Ledger rules by hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import accounts, jobs, ledger

TX = "id long, user_id long, amount decimal(10,2), transaction_type string, created_at timestamp_ntz, payment_method string"


@pytest.fixture(scope="module")
def tx(spark):
    from decimal import Decimal

    day = lambda d, h=0, us=0: dt.datetime(2024, 1, d, h, 0, 0, us)
    return spark.createDataFrame(
        [
            (1, 1, Decimal("10.50"), "purchase", day(1), "bank"), (2, 1, Decimal("0.25"), "usage", day(2), None),
            (3, 2, Decimal("5.00"), "usage", day(2), None), (4, 9, Decimal("7.00"), "purchase", day(3, 5, 120), "card"),
        ],
        TX,
    )


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "Anna_B"), (2, "bob%")], "user_id long, username string")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_filters_are_inclusive_and_unknown_types_filter_nothing(tx):
    f = ledger.filter_transactions
    assert ids(f(tx, start="2024-01-02", end="2024-01-02")) == [2, 3]
    assert ids(f(tx, start=dt.datetime(2024, 1, 2), end=dt.datetime(2024, 1, 3))) == [2, 3]
    assert ids(f(tx, user_id=1, transaction_type="USAGE")) == [2]
    assert ids(f(tx, transaction_type="all")) == ids(f(tx, transaction_type="refund")) == ids(f(tx)) == [1, 2, 3, 4]


def test_username_patterns(tx, users):
    of = ledger.transactions_of_username
    assert ids(of(tx, users, "anna_b")) == [1, 2] and ids(of(tx, users, "NNA")) == [1, 2]
    assert ids(of(tx, users, "a%b")) == [1, 2] and ids(of(tx, users, "b_b")) == [3] and ids(of(tx, users, "x")) == []
    assert ledger.match_username(users, None).count() == 2


def test_names_and_output(tx, users):
    shown = {r["id"]: r for r in ledger.ledger_output(ledger.enrich_username(tx, users)).collect()}
    assert shown[4]["username"] is None and shown[4]["created_at"] == "2024-01-03T05:00:00.000120"
    assert shown[1]["created_at"] == "2024-01-01T00:00:00" and shown[1]["amount"] == 10.5
    assert {r["username"] for r in ledger.enrich_username(tx, users, True).filter("user_id = 9").collect()} == {"User 9"}


def test_totals_scopes(tx):
    second = ledger.transaction_condition(user_id=2)
    r = ledger.ledger_totals(tx, second).first()
    assert (r["total"], r["total_purchase"], r["total_usage"]) == (1, 17.5, 5.25)
    r = ledger.ledger_totals(tx, second, "filtered").first()
    assert (r["total"], r["total_purchase"], r["total_usage"]) == (1, 0.0, 5.0)
    assert ledger.ledger_totals(tx).first()["total"] == 4
    r = ledger.ledger_totals(tx.filter("false")).first()
    assert (r["total"], r["total_purchase"]) == (0, 0.0)


def test_pages(tx):
    assert [r["id"] for r in ledger.page(tx, 0, 3).collect()] == [4, 3, 2]
    assert [r["id"] for r in ledger.page(tx, 1, 2, "ASC").collect()] == [2, 3]
    assert ledger.page(tx, 9, 2).count() == 0
    for skip, limit in ((-1, 5), (0, 0), (0, 1001)):
        with pytest.raises(ValueError):
            ledger.page(tx, skip, limit)
        with pytest.raises(ValueError):
            ledger.page_per_user(tx, skip, limit)
    with pytest.raises(ValueError):
        ledger.page(tx, 0, 101, max_limit=100)


def test_filter_and_columns_reach_the_scan(spark, sf):
    from lexiloom.plans.tables import Tables

    rows = ledger.filter_transactions(Tables(spark, sf).transactions(), 7, "2024-01-05", None, "usage")
    plan = rows.select("amount")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,7)" in plan and "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan
    assert "props" not in plan


def test_public_users(spark):
    df = spark.createDataFrame([(1, "a", "secret")], "user_id long, username string, password string")
    assert ledger.public_users(df).columns == ["id", "username"]


def test_types_and_payments(spark):
    df = spark.createDataFrame([("Purchase",), ("usage",), ("x",), (None,)], "k string")
    assert [r["t"] for r in df.select(ledger.normalize_transaction_type(F.col("k")).alias("t")).collect()] == ["purchase", "usage", "usage", "usage"]
    pay = spark.createDataFrame([("PAID",), ("CANCELLED",), ("EXPIRED",), (None,)], "status string")
    assert [(r["outcome"], r["success"]) for r in ledger.payment_outcome(pay).collect()] == [
        ("paid", True), ("cancelled", False), ("pending", False), ("pending", False)
    ]


def test_billing(spark):
    at = dt.datetime(2024, 1, 1, 20)
    df = spark.createDataFrame([("", at), ("a" * 250, at), ("ở" * 3, at)], "input_text string, created_at timestamp_ntz")
    got = [(r["character_count"], int(r["credits_used"]), r["local_time"]) for r in ledger.bill_usage(df).collect()]
    assert got == [(0, 1, dt.datetime(2024, 1, 2, 3)), (250, 250, dt.datetime(2024, 1, 2, 3)), (3, 3, dt.datetime(2024, 1, 2, 3))]
    assert [int(r["credits_used"]) for r in ledger.bill_usage(df, divisor=100).collect()] == [1, 3, 1]


def test_history_deletes(spark):
    history = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "id long, user_id long")
    changes = spark.createDataFrame([(1, 1, 6), (2, 1, 5), (3, 1, 5), (4, 9, 5), (5, 3, 6), (6, 1, 6)], "seq long, history_id long, user_id long")
    got = {r["seq"]: r["outcome"] for r in accounts.history_delete_verdicts(changes, history).collect()}
    assert got == {1: "not_owner", 2: "deleted", 3: "already_gone", 4: "not_found", 5: "deleted", 6: "already_gone"}
    assert ids(accounts.apply_history_deletes(history, changes)) == [2]
    assert ids(accounts.clear_history(history, spark.createDataFrame([(5,), (5,)], "user_id long"))) == [3]


def test_change_feed(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "user_id long, username string, email string")
    feed = spark.createDataFrame(
        [(1, 1, "patch", "a1", None), (2, 1, "patch", "a2", ""), (3, 1, "patch", None, "x3"), (4, 2, "delete", None, None), (5, 2, "patch", "late", None), (6, 8, "patch", "n", "n")],
        "seq long, user_id long, action string, username string, email string",
    )
    got = sorted(map(tuple, accounts.apply_changes(base, feed, "user_id", "seq", ["username", "email"]).collect()))
    assert got == [(1, "a2", "x3"), (3, "c", "z")]


def test_signups(spark):
    known = spark.createDataFrame([("taken", "t@x")], "username string, email string")
    rows = [(1, "a", "a@x"), (2, "a", "b@x"), (3, "c", "a@x"), (4, "taken", "n@x"), (5, "d", "t@x"), (6, "e", "e@x")]
    got = {r["seq"]: r["duplicate"] for r in accounts.register_defaults(spark.createDataFrame(rows, "seq long, username string, email string"), known).collect()}
    assert got == {1: None, 2: "username", 3: "email", 4: "username", 5: "email", 6: None}
    first = accounts.register_defaults(spark.createDataFrame(rows, "seq long, username string, email string")).filter("seq = 6").first()
    assert (first["credits"], first["account_type"], first["is_active"]) == (5000, "standard", True)


def test_user_changes(spark):
    users = spark.createDataFrame([(1,)], "user_id long")
    rows = [("role", "2", "ok"), ("role", "3", "bad_role"), ("role", None, "bad_role"), ("active", "1", "ok"), ("active", "2", "bad_status"),
            ("add", "5", "ok"), ("add", "0", "bad_amount"), ("subtract", "x", "bad_amount"), ("delete", None, "ok")]
    df = spark.createDataFrame([(1, a, v, w) for a, v, w in rows] + [(2, "add", "5", "no_such_user")], "user_id long, action string, value string, want string")
    for r in accounts.validate_user_changes(df, users).collect():
        assert r["outcome"] == r["want"], r
    assert accounts.change_outcomes(accounts.validate_user_changes(df, users)).count() == 5


def test_config_patch(spark):
    schema = "id int, name_web string, price int"
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3)], schema)
    patch = spark.createDataFrame([(1, None, 9), (2, None, None), (4, "n", None), (5, None, None)], schema)
    got = sorted(map(tuple, accounts.patch_config(base, patch).collect()))
    assert got == [(1, "a", 9, "updated"), (2, "b", 2, "refused"), (3, "c", 3, "unchanged"), (4, "n", None, "inserted")]


def test_orphans_and_delete_effects(spark, tx, users):
    assert ids(accounts.orphans(tx, users)) == [4]
    history = spark.createDataFrame([(1, 1), (2, 7), (3, 7)], "id long, user_id long")
    doomed = spark.createDataFrame([(1,), (7,), (8,), (7,)], "user_id long")
    got = sorted(map(tuple, accounts.delete_effects(doomed, tx, history).collect()))
    assert got == [(1, 2, "refused", 0), (7, 0, "deleted", 2), (8, 0, "deleted", 0)]


EVENTS = "job_id long, seq long, ts timestamp_ntz, status string, started_at double, current long, total long, message string, present array<string>, reset boolean"


def event(seq, **fields):
    values = {"status": None, "started_at": None, "current": None, "total": None, "message": None, **fields}
    reset = values.pop("reset", False)
    present = [f for f in fields if f != "reset"]
    at = dt.datetime(2024, 1, 1, 0, 0, seq)
    return (1, seq, at, values["status"], values["started_at"], values["current"], values["total"], values["message"], present, reset)


def test_status_fold(spark):
    events = [
        event(1, status="started", started_at=100.0, message="m1"), event(2, status="processing", current=1, total=4),
        event(3, started_at=300.0, message=None), event(4, current=2),
    ]
    df = spark.createDataFrame(events, EVENTS)
    r = jobs.fold_job_status(df).first()
    assert (r["status"], r["started_at"], r["current"], r["total"], r["message"]) == ("processing", 100.0, 2, 4, None)
    assert r["updated_at"] == dt.datetime(2024, 1, 1, 0, 0, 4)
    again = spark.createDataFrame([*events, event(5, started_at=500.0, reset=True), event(6, started_at=600.0)], EVENTS)
    assert jobs.fold_job_status(again, reset="reset").first()["started_at"] == 500.0
    empty = spark.createDataFrame([event(1, started_at=0.0), event(2, started_at=7.0)], EVENTS)
    assert jobs.fold_job_status(empty).first()["started_at"] == 7.0


def test_progress(spark):
    start = dt.datetime(1970, 1, 1, 0, 0, 0)
    at = lambda s: start + dt.timedelta(seconds=s)
    rows = [(1, 1, at(100), 100.0, 0, 10), (1, 2, at(150), 150.0, 5, 10), (1, 3, at(4000), 0.0, 10, 10), (1, 4, at(200), 0.0, 1, 0)]
    df = spark.createDataFrame(rows, "job_id long, seq long, ts timestamp_ntz, started_at double, current long, total long")
    got = {r["seq"]: r for r in jobs.terminal_bar(jobs.job_progress(df)).collect()}
    assert (got[1]["percent"], got[1]["eta"], got[1]["speed"], got[1]["eta_text"]) == (0, None, 0.0, "--:--")
    assert (got[2]["percent"], got[2]["elapsed"], got[2]["eta"], got[2]["speed"]) == (50, 50.0, 50.0, 0.1)
    assert (got[3]["percent"], got[3]["elapsed_text"], got[3]["eta_text"]) == (99, "01:05:00", "00:00:39")
    assert got[4]["percent"] == 0
    assert got[2]["terminal_style"] == "50%|" + "█" * 25 + " " * 25 + "| 5/10 [00:00:50<00:00:50, 0.10it/s]"


@pytest.mark.parametrize("seed", range(3))
def test_signups_in_turn_equal_a_plain_loop(spark, seed):
    import random

    rng = random.Random(seed)
    pick = lambda kind, n: rng.choice([None, f"{kind}0", *(f"{kind}{rng.randrange(n)}" for _ in range(6))])
    signups = [(i, pick("n", 40), pick("e", 25)) for i in rng.sample(range(1000), 150)]
    users = [("n1", "x"), ("y", "e2"), (None, None)]
    names, mails, want = {n for n, _ in users if n}, {e for _, e in users if e}, {}
    for seq, name, mail in sorted(signups):
        want[seq] = "username" if name in names else "email" if mail in mails else None
        if want[seq] is None:
            names |= {name} - {None}
            mails |= {mail} - {None}
    frame = spark.createDataFrame(signups, "seq long, username string, email string").repartition(3)
    existing = spark.createDataFrame(users, "username string, email string")
    got = {r["seq"]: r["duplicate"] for r in accounts.register_in_turn(frame, existing).collect()}
    assert got == want and None in want.values()
    loose = {r["seq"]: r["duplicate"] for r in accounts.register_defaults(frame, existing).collect()}
    assert loose != want
    assert accounts.register_in_turn(frame.limit(0)).count() == 0


def test_a_chain_of_clashes_alternates(spark):
    chain = [(i, f"n{i // 2}", f"e{(i + 1) // 2}") for i in range(9)]
    got = accounts.register_in_turn(spark.createDataFrame(chain, "seq long, username string, email string")).collect()
    assert [r["duplicate"] for r in sorted(got)] == [None, "username", None, "username", None, "username", None, "username", None]
