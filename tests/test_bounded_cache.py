"""The replay of a bounded cache equals a plain loop over a cache."""

import random

import pytest

from lexiloom.operators.bounded_cache import RecentTexts, bounded_cache_replay, bounded_cache_stats


def plain_cache(lookups, size):
    """(job, doc_id, para_idx) -> (hit, texts held) with a list of texts in order of use."""
    caches, out = {}, {}
    for job, doc, para, key in sorted((r for r in lookups if r[3] is not None), key=lambda r: (str(r[0]), r[1], r[2])):
        texts = caches.setdefault(job, [])
        hit = key in texts
        if hit:
            texts.remove(key)
        elif len(texts) >= size:
            del texts[: int(size * 0.2)]
        texts.append(key)
        out[job, doc, para] = hit, len(texts)
    return out


def lookups_of(seed, n=1200):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        job = "large" if rnd.random() < 0.7 else rnd.choice(["small", None, "other"])
        # Some texts come all the time, some come back after long, some once.
        key = rnd.choice([f"k{rnd.randrange(12)}", f"k{rnd.randrange(60)}", f"k{(i // 3) % 45}", f"once{i}", None])
        rows.append((job, i // 7, i % 7, key))
    return rows


@pytest.mark.parametrize("max_rows", [None, 150])
@pytest.mark.parametrize("size", [5, 20, 50])
def test_replay_equals_a_plain_loop(spark, max_rows, size):
    rows = lookups_of(size)
    frame = spark.createDataFrame(rows, "job string, doc_id long, para_idx int, key string").repartition(3)
    replayed = bounded_cache_replay(frame, max_size=size, max_rows=max_rows)
    got = {(r.job, r.doc_id, r.para_idx): (r.hit, r.held) for r in replayed.collect()}
    want = plain_cache(rows, size)
    assert got == want
    assert any(hit for hit, _ in want.values()) and max(held for _, held in want.values()) == size
    stats = {r.job: (r.hits, r.misses, r.cache_size) for r in bounded_cache_stats(replayed).collect()}
    for job in {r[0] for r in rows}:
        own = [v for k, v in sorted(want.items(), key=lambda x: x[0][1:]) if k[0] == job]
        assert stats[job] == (sum(h for h, _ in own), sum(not h for h, _ in own), own[-1][1])


def test_a_crowded_document_and_no_lookups(spark):
    rows = [("one", 1, i, f"k{i * i % 23}") for i in range(400)]
    frame = spark.createDataFrame(rows, "job string, doc_id long, para_idx int, key string")
    got = {(r.job, r.doc_id, r.para_idx): (r.hit, r.held) for r in bounded_cache_replay(frame, max_size=8, max_rows=40).collect()}
    assert got == plain_cache(rows, 8)
    assert bounded_cache_replay(frame.limit(0), max_size=8).count() == 0
    with pytest.raises(ValueError):
        bounded_cache_replay(frame, max_size=4)


def test_reuse_distances_count_other_texts():
    recent = RecentTexts(3)
    assert [recent.use(t) for t in "abacbbdca"] == [None, None, 1, None, 2, 0, None, 2, None]
