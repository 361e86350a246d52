"""Positions found by counting equal positions found by sorting."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.operators import ledger, memory, selection
from lexiloom.operators.selection import first_rows, locate, numbers_of, rows_at

SCHEMA = "id long, at long, key string, lang string"


def table(spark, kind, n=400):
    rng = random.Random(kind)
    moments = {"spread": lambda: rng.randrange(-(10**15), 10**16), "one hour": lambda: 10**12 + rng.randrange(3_600_000_000), "one moment": lambda: 7, "missing": lambda: rng.choice([None, None, 5, 6])}
    keys = ["a", "ab", "ü", "long key one", "long key two", "long key that goes on and on and on 1", "long key that goes on and on and on 2", "", None]
    rows = [(rng.choice([i - 50, -(2**62) + i, 2**62 - i]), moments[kind](), rng.choice(keys), rng.choice(["de", None])) for i in range(n)]
    df = spark.createDataFrame([(i, at, k, x) for i, at, k, x in rows], SCHEMA)
    return df.withColumn("created_at", F.timestamp_micros("at").cast("timestamp_ntz")).repartition(4).cache()


@pytest.mark.parametrize("kind", ["spread", "one hour", "one moment", "missing"])
@pytest.mark.parametrize("rising", [True, False])
def test_pages_at_any_depth(spark, kind, rising):
    df = table(spark, kind)
    way = [F.col(c).asc() if rising else F.col(c).desc() for c in ("created_at", "id", "key", "lang")]
    numbers = [n for c in ("created_at", "id") for n in numbers_of(df, c, descending=not rising)]
    want = [tuple(r) for r in df.orderBy(*way).collect()]
    for skip, limit in ((0, 5), (37, 60), (390, 50), (399, 1), (400, 3)):
        got = rows_at(df, numbers, way, skip, limit, sorted_rows=9).orderBy("_rank").drop("_rank")
        assert [tuple(r) for r in got.collect()] == want[skip : skip + limit]
        region = locate(df, numbers, skip + 1, 9)
        assert (region is None) == (skip >= 400)
        if region:
            same = [r[:2] + r[4:] for r in want[region.before : region.before + region.rows]]
            assert region.before <= skip < region.before + region.rows
            assert region.rows <= 9 or len(set(same)) == 1  # a crowd of rows that agree in time and id


@pytest.mark.parametrize("kind", ["spread", "one moment", "missing"])
def test_first_rows_by_texts(spark, kind):
    df = table(spark, kind)
    way = [F.col("created_at").desc(), F.col("key").asc(), F.col("lang").asc(), F.col("id").asc()]
    numbers = [*numbers_of(df, "created_at", descending=True), *(n for c in ("key", "lang", "id") for n in numbers_of(df, c))]
    for n in (0, 1, 150, 399, 400, 1000):
        got = first_rows(df, numbers, way, n, sorted_rows=7)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, df.orderBy(*way).limit(n).collect()))


def test_texts_are_ordered_as_their_bytes_are(spark):
    texts = ["", "a", "a\x01", "ab", "b", "é", "中文 text", "\U0001f600", "seven77", "seven777", "seven7a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    numbers = numbers_of(df, "t")
    got = [r[0] for r in df.orderBy(*(n.value.asc() for n in numbers)).collect()]
    assert got == [r[0] for r in df.orderBy("t").collect()]


def test_no_task_sorts_a_crowded_moment(spark, monkeypatch):
    """A page and the retained entries of a table whose rows share one moment: the sort sees only rows next to the bound."""
    for module in (selection,):
        monkeypatch.setattr(module, "SORTED_ROWS", 20)
    monkeypatch.setattr(rows_at, "__defaults__", (20, "_rank"))
    monkeypatch.setattr(first_rows, "__defaults__", (20,))
    df = spark.range(5000).select("id", (F.col("id") % 7).alias("user_id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at")).cache()
    page = ledger.page(df, skip=4000, limit=50)
    assert [r["id"] for r in page.collect()] == list(range(999, 949, -1))
    kept = memory.tm_retain(
        df.select(F.md5(F.col("id").cast("string")).alias("key"), F.lit("vi").alias("target_lang"), F.lit("General").alias("style"), F.lit("s").alias("source"), F.lit("t").alias("target"), F.col("created_at").alias("last_used")), 1234
    )
    smallest = sorted(r[0] for r in df.select(F.md5(F.col("id").cast("string"))).collect())[:1234]
    assert sorted(r["key"] for r in kept.collect()) == smallest
    numbers = [n for c in ("created_at", "id") for n in numbers_of(df, c, descending=True)]
    assert locate(df, numbers, 4001, 20).rows <= 20


def test_deep_pages_of_users_in_one_moment(spark, monkeypatch):
    from lexiloom.operators import skew

    ranks = skew.take_ranks
    monkeypatch.setattr(ledger, "take_ranks", lambda *a, **k: ranks(*a, **k, max_rows=100))
    df = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 5 + 2).cast("long").alias("user_id"), F.when(F.col("id") % 4 > 0, F.lit("2024-01-01")).cast("timestamp_ntz").alias("created_at")).cache()
    for direction in ("asc", "desc"):
        got = ledger.page_per_user(df, skip=990, limit=40, direction=direction)
        rising = direction == "asc"
        for user in (1, 2, 6):
            own = df.filter(F.col("user_id") == user).orderBy(*(F.col(c).asc() if rising else F.col(c).desc() for c in ("created_at", "id"))).collect()
            want = [(990 + i + 1, r["id"], len(own)) for i, r in enumerate(own[990:1030])]
            assert sorted((r["position"], r["id"], r["total"]) for r in got.filter(F.col("user_id") == user).collect()) == want
