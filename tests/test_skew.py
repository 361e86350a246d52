"""Hot groups: cut into slices, same rows as one big window or a plain loop."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lexiloom.operators import ledger, memory, ocr
from lexiloom.operators.cache import ttl_cache_replay
from lexiloom.operators import credits
from lexiloom.operators.credits import replay_credits
from lexiloom.operators.skew import cut_into_slices, running_count, running_islands, split_hot
from lexiloom.plans.tables import Tables


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


@pytest.fixture
def points(spark):
    rnd = random.Random(5)
    data = [("hot" if rnd.random() < 0.6 else rnd.choice("abc"), rnd.randint(0, 300), i) for i in range(2000)]
    data += [(None, rnd.randint(0, 300), i) for i in range(2000, 2300)]
    return spark.createDataFrame(data, "k string, v int, i int")


def test_split_hot_finds_null_groups_too(points):
    usual, hot = split_hot(points, ["k"], 290)
    assert {r["k"] for r in hot.select("k").distinct().collect()} == {"hot", None}
    assert usual.count() + hot.count() == points.count()
    assert split_hot(points, ["k"], 10_000)[1] is None
    assert split_hot(points, ["k"], None)[1] is None


def test_slices_follow_the_order_and_keep_ties_together(points):
    sliced = cut_into_slices(points, ["k"], F.col("v"), max_rows=100, slices=64)
    spans = sliced.groupBy("k", "_slice").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    by_key = {}
    for r in spans.collect():
        by_key.setdefault(r["k"], []).append((r["_slice"], r["lo"], r["hi"], r["n"]))
    assert len(by_key["hot"]) >= 8
    for parts in by_key.values():
        parts.sort()
        assert all(a[2] < b[1] for a, b in zip(parts, parts[1:]))
        assert max(p[3] for p in parts) < 300


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_count(points, keys):
    got = running_count(cut_into_slices(points, keys, F.col("v"), 50, 64), keys, [F.col("v"), F.col("i")], "n")
    one = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("v", "i")
    assert rows(got, "k", "i", "n") == rows(points.withColumn("n", F.row_number().over(one)), "k", "i", "n")


def test_running_islands(points):
    far = lambda prev, this: this - prev > 2
    order = [F.col("v"), F.col("i")]
    got = running_islands(cut_into_slices(points, ["k"], F.col("v"), 50, 64), ["k"], order, F.col("v"), F.col("v"), far, "island")
    one = Window.partitionBy("k").orderBy(*order)
    want = points.withColumn("b", F.when(F.col("v") - F.lag("v").over(one) > 2, 1).otherwise(0)).withColumn(
        "island", F.sum("b").over(one.rowsBetween(Window.unboundedPreceding, 0))
    )
    assert rows(got, "k", "i", "island") == rows(want, "k", "i", "island")
    assert want.agg(F.max("island")).first()[0] > 3


def loop_cache(requests, ttl):
    """(id, hit) by walking through each key's requests."""
    result, expires = {}, {}
    for key, at, number, keep in sorted(requests, key=lambda r: (str(r[0]), r[1], r[2])):
        hit = key in expires and at < expires[key]
        result[number] = hit
        if not hit and keep:
            expires[key] = at + ttl
    return result


@pytest.mark.parametrize("max_rows", [None, 60])
@pytest.mark.parametrize("ttl", [1, 40, 100_000])
def test_cache_replay_equals_a_loop(spark, max_rows, ttl):
    rnd = random.Random(ttl)
    data = [
        ("hot" if rnd.random() < 0.7 else rnd.choice(["a", "b"]), rnd.randint(0, 2500), i, rnd.random() < 0.7)
        for i in range(1200)
    ]
    day = F.lit("2024-03-01").cast("timestamp_ntz")
    df = spark.createDataFrame(data, "key string, s int, id int, keep boolean").withColumn(
        "ts", day + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))
    )
    got = ttl_cache_replay(df, storable="keep", ttl_seconds=ttl, max_rows=max_rows)
    assert {r["id"]: r["hit"] for r in got.collect()} == loop_cache(data, ttl)


def loop_credits(events, opening):
    result, balance = {}, dict(opening)
    for user, at, seq, kind, amount in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        if user not in balance:
            result[seq] = ("no_such_user", None)
            continue
        if amount <= 0:
            verdict = "bad_amount"
        elif kind == "add":
            verdict = "ok"
            balance[user] += amount
        elif balance[user] < amount:
            verdict = "insufficient"
        else:
            verdict = "ok"
            balance[user] -= amount
        result[seq] = (verdict, balance[user])
    return result


@pytest.mark.parametrize("max_rows,rich", [(None, True), (80, True), (80, False)])
def test_credit_replay_equals_a_loop(spark, max_rows, rich):
    rnd = random.Random(3)
    data = [
        (1 if rnd.random() < 0.6 else rnd.randint(2, 4), rnd.randint(0, 900), i, rnd.choice(["add", "subtract"]), rnd.randint(-2, 60))
        for i in range(900)
    ]
    opening = {1: 100_000 if rich else 20, 2: 0, 3: 50}
    day = F.lit("2024-03-01").cast("timestamp_ntz")
    df = spark.createDataFrame(data, "user_id long, s int, seq long, kind string, amount long").withColumn(
        "ts", day + F.make_dt_interval(secs=F.col("s").cast("decimal(18,6)"))
    )
    accounts = spark.createDataFrame(list(opening.items()), "user_id long, credits long")
    got = replay_credits(df, accounts, max_rows=max_rows)
    assert {r["seq"]: (r["verdict"], r["balance"]) for r in got.collect()} == loop_credits(data, opening)


def test_hot_images_merge_and_number_alike(spark, sf):
    t = Tables(spark, sf)
    # All boxes in a few images, a third of them in one.
    crowd = F.when((F.col("x_max") * 7 + F.col("y_max")) % 3 == 0, 0).otherwise(F.col("image_id") % 4).cast("long")
    boxes = t.boxes().withColumn("image_id", crowd).withColumn("y_min", F.col("y_min") + ((F.col("x_max") * 31 + F.col("y_max") + 100) % 97 * 40).cast("int")).withColumn(
        "y_max", F.col("y_min") + 12
    )
    columns = ["image_id", "line", "group_no", "x_min", "y_min", "x_max", "y_max", "text", "confidence", "boxes"]
    plain = ocr.merge_nearby_boxes(boxes, 2, 5, max_rows=None)
    assert rows(ocr.merge_nearby_boxes(boxes, 2, 5, max_rows=200), *columns) == rows(plain, *columns)
    assert plain.select("image_id", "line").distinct().count() > 100
    images = spark.createDataFrame([(i, 500, 300) for i in range(4)], "image_id long, width int, height int")
    numbered = ocr.number_regions(boxes, images, max_rows=None)
    assert rows(ocr.number_regions(boxes, images, max_rows=200), *numbered.columns) == rows(numbered, *numbered.columns)


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_deep_pages(spark, sf, direction):
    rows_ = Tables(spark, sf).transactions()
    top = ledger.order_by_time(rows_, direction).offset(700).limit(50)
    deep = ledger.page(rows_, 700, 50, direction)
    assert [r["id"] for r in deep.collect()] == [r["id"] for r in top.collect()]


def test_large_retention(spark, sf):
    known = Tables(spark, sf).memory()
    assert rows(memory.tm_retain(known, 70), "key") == rows(known.orderBy(F.desc("last_used"), *memory.IDENTITY).limit(70), "key")


def test_deep_pages_of_users(spark, sf, monkeypatch):
    rows_ = Tables(spark, sf).transactions()
    plain = ledger.page_per_user(rows_, 20, 30)
    monkeypatch.setattr(ledger, "TASK_PRUNED_RANKS", 5)
    assert rows(ledger.page_per_user(rows_, 20, 30), "id", "position", "total") == rows(plain, "id", "position", "total")


@pytest.mark.parametrize("max_rows", [None, 2])
def test_replays_leave_other_columns_and_missing_values_alone(spark, max_rows):
    moves = [(1, 1, 100, "add"), (2, 1, None, "add"), (3, 1, 50, "subtract"), (4, 1, 999999, "subtract"), (5, 2, None, None), (6, 1, 60, "subtract")]
    df = spark.createDataFrame([(s, u, k, a, s, 2**53 + 1 if s % 2 else None) for s, u, a, k in moves], "seq long, user_id long, kind string, amount long, n int, big long").withColumn("ts", F.timestamp_seconds("n"))
    got = {r.seq: (r.verdict, r.balance, r.big) for r in replay_credits(df, start=10, max_rows=max_rows).collect()}
    assert got == {
        1: ("ok", 110, 2**53 + 1), 2: ("bad_amount", 110, None), 3: ("ok", 60, 2**53 + 1), 4: ("insufficient", 60, None),
        5: ("bad_amount", 10, 2**53 + 1), 6: ("ok", 0, None),
    }
    keys = [2**53, 2**53 + 1, None, 2**53 + 1, None, None]
    requests = spark.createDataFrame([(i, k, i if i < 5 else None, None) for i, k in enumerate(keys)], "id long, key long, n int, other long").withColumn("ts", F.timestamp_seconds("n"))
    hits = {r.id: (r.key, r.hit) for r in ttl_cache_replay(requests, ttl_seconds=60, max_rows=max_rows).collect()}
    assert hits == {0: (2**53, False), 1: (2**53 + 1, False), 2: (None, False), 3: (2**53 + 1, True), 4: (None, True), 5: (None, False)}


def test_pages_of_rows_with_one_time_or_none(spark):
    same = spark.createDataFrame([(i, None if i % 3 == 0 else 5) for i in range(300)], "id long, n int").withColumn("created_at", F.timestamp_seconds("n").cast("timestamp_ntz"))
    for direction in ("asc", "desc"):
        for skip in (0, 90, 250):
            want = ledger.order_by_time(same, direction).offset(skip).limit(40)
            assert rows(ledger.page(same, skip, 40, direction), "id") == rows(want, "id")
    assert ledger.page(same.limit(0)).count() == 0


def test_slices_are_cut_again_and_crowded_values_by_their_ties(spark):
    points = spark.createDataFrame([(i % 2, 5.0 if i % 3 else float(i), i) for i in range(3000)], "k int, v double, tie long")
    cut = cut_into_slices(points, ["k"], F.col("v"), max_rows=50, slices=4, ties=[F.col("tie")])
    sizes = [r["count"] for r in cut.groupBy("k", "_slice").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 200
    got = [(r.k, r._slice, r.v, r.tie) for r in cut.collect()]
    for k in (0, 1):
        own = sorted((v, tie, s) for group, s, v, tie in got if group == k)
        assert [s for _, _, s in own] == sorted(s for _, _, s in own)
    together = cut_into_slices(points, ["k"], F.col("v"), max_rows=50, slices=4)
    assert together.filter("v = 5").groupBy("k").agg(F.countDistinct("_slice").alias("n")).filter("n > 1").count() == 0


def test_a_bulk_load_with_one_time_replays_like_a_loop(spark):
    data = [(i, 1, "add" if i % 4 == 0 else "subtract", i % 11) for i in range(400)]
    df = spark.createDataFrame(data, "seq long, user_id long, kind string, amount long").withColumn("ts", F.timestamp_seconds(F.lit(7)))
    columns = ("seq", "verdict", "balance")
    assert rows(replay_credits(df, start=5, max_rows=30), *columns) == rows(replay_credits(df, start=5, max_rows=None), *columns)


def test_deep_pages_per_user(spark, sf, monkeypatch):
    rows_ = Tables(spark, sf).transactions()
    want = rows(ledger.page_per_user(rows_, 3, 4), "id", "position", "total")
    monkeypatch.setattr(ledger, "TASK_PRUNED_RANKS", 1)
    assert rows(ledger.page_per_user(rows_, 3, 4), "id", "position", "total") == want


def scarce(n, seed=4):
    """Movements of one account that is short of credits all the time."""
    rnd = random.Random(seed)
    return [(i, 1, "add" if rnd.random() < 0.4 else "subtract", rnd.randint(1, 50)) for i in range(n)]


def replayed(spark, monkeypatch, data, max_rows, start=30):
    """(rows, passes over all slices or some): replays and tables."""
    passes = []
    for name in ("_fold_sorted", "_ends_of_slices"):
        plain = getattr(credits, name)
        monkeypatch.setattr(credits, name, lambda df, *a, plain=plain: passes.append(df) or plain(df, *a))
    df = spark.createDataFrame(data, "seq long, user_id long, kind string, amount long").withColumn("ts", F.timestamp_seconds("seq"))
    got = rows(credits.replay_credits(df, start=start, max_rows=max_rows), "seq", "verdict", "balance")
    monkeypatch.undo()
    return got, passes


def test_passes_over_a_hot_account_do_not_grow_with_its_slices(spark, monkeypatch):
    data = scarce(1500)
    balance, want = 30, []
    for seq, _, kind, amount in data:
        verdict, balance = credits.move(kind, amount, balance)
        want.append((seq, verdict, balance))
    counts = []
    for max_rows in (400, 60):
        got, passes = replayed(spark, monkeypatch, data, max_rows)
        assert got == sorted(want, key=repr)
        counts.append(len(passes))
    assert counts[0] == counts[1]


def test_without_tables_a_round_reads_only_the_slices_it_replays(spark, monkeypatch):
    monkeypatch.setattr(credits, "MAX_BALANCES", 0)
    data = [(i, 1, "add" if i < 200 else "subtract", 1 if i < 200 else 3) for i in range(400)]
    df = spark.createDataFrame(data, "seq long, user_id long, kind string, amount long").withColumn("ts", F.timestamp_seconds("seq"))
    read = []
    plain = credits._fold_sorted
    monkeypatch.setattr(credits, "_fold_sorted", lambda df, keys, opening: read.append(df) or plain(df, keys, opening))
    assert credits.replay_credits(df, start=0, max_rows=50).count() == 400
    rounds = [d.count() for d in read[1:-1]]  # without the ordinary users and the last pass
    assert rounds and all(n < 200 for n in rounds)
    scan = read[1]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_slice" in scan or "PartitionFilters: [isnotnull(_slice" in scan


@pytest.mark.parametrize("seed", range(20))
def test_reachable_balances(monkeypatch, seed):
    rnd = random.Random(seed)
    low = rnd.randrange(50)
    high = low + rnd.randrange(200)
    moves = [(rnd.random() < 0.4, rnd.randint(1, 40)) for _ in range(rnd.randrange(60))]

    def after(balance):
        for adds, amount in moves:
            balance = credits.move("add" if adds else "subtract", amount, balance)[1]
        return balance

    reachable, balances = credits.Reachable(low, high), credits.Balances(list(range(low, high + 1)))
    for state in (reachable, balances):
        for adds, amount in moves:
            (state.add if adds else state.take)(amount)
    want = [after(b) for b in range(low, high + 1)]
    assert balances.ends() == want
    assert reachable.ends() == sorted(set(want))
    monkeypatch.setattr(credits, "MAX_RANGES", 1)
    hull = credits.Reachable(low, high)
    for adds, amount in moves:
        (hull.add if adds else hull.take)(amount)
    assert set(want) <= set(hull.ends())

