"""Best-fit packing, hard-negative mining and source divergence against brute force on small tables."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from lexiloom.llm import best_fit, divergence, hard_negatives
from lexiloom.llm.queries import registry, vocabulary
from lexiloom.llm.tokens import word_ids
from pyspark.sql import types as T


# --- best-fit packing -----------------------------------------------------------
def plain_best_fit(lengths, capacity):
    """Room left in each sequence after best-fit decreasing, piece by piece."""
    rooms = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(rooms) if room >= length]
        if fitting:
            rooms[min(fitting, key=lambda i: rooms[i])] -= length
        else:
            rooms.append(capacity - length)
    return sorted(rooms)


def filled(counts, capacity):
    """(room left per sequence) of the runs, after checking that every piece has one place and none overlap."""
    runs = sorted(best_fit.best_fit_decreasing(counts, capacity))
    places = defaultdict(list)
    for (length, number, first, each, offset), after in zip(runs, [*runs[1:], None], strict=False):
        end = after[1] if after and after[0] == length else counts[length]
        assert number < end
        for n in range(end - number):
            places[first + n // each].append((offset + n % each * length, length))
    assert sum(len(p) for p in places.values()) == sum(counts.values())
    assert sorted(places) == list(range(len(places)))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return sorted(capacity - sum(length for _, length in own) for own in places.values())


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_runs_do_what_best_fit_does_piece_by_piece(case):
    capacity, lengths = case
    assert filled(Counter(lengths), capacity) == plain_best_fit(lengths, capacity)


def test_runs_stay_few_for_many_pieces():
    rng = random.Random(1)
    counts = {length: rng.randrange(10**9) for length in range(1, 4097)}
    runs = best_fit.best_fit_decreasing(counts, 4096)
    assert len(runs) < 4 * 4096 * 13
    tokens = sum(length * n for length, n in counts.items())
    assert sum(counts.values()) > 10**12 and -(-tokens // 4096) <= 1 + max(first for _, _, first, _, _ in runs)


def test_best_fit_of_odd_documents(spark, documents):
    long_text = " ".join(f"word{i}" for i in range(9000))
    rows = [(1, None), (2, ""), (3, "one two three"), (3, "one two three"), (4, long_text), (None, "no id"), (5, "é中 " * 50)]
    got = best_fit.pack(best_fit.token_pieces(documents(rows), vocabulary()))
    rows_got = got.toPandas()
    encode = word_ids(vocabulary()).tokenizer.encode
    want = Counter()
    for doc_id, text in rows:
        ids = [*encode(text or "", add_special_tokens=False).ids, 1]
        for piece, at in enumerate(range(0, len(ids), 4096)):
            want[(doc_id, piece, at, tuple(ids[at : at + 4096]))] += 1
    key = lambda r: (None if math.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, tuple(np.frombuffer(r.ids, "<u4").tolist()))
    assert Counter(key(r) for r in rows_got.itertuples()) == want
    sequences = best_fit.packed_sequences(got).toPandas().set_index("sequence_id")
    assert sequences.n_tokens.max() <= 4096
    for r in rows_got.itertuples():
        own = sequences.ids[r.sequence_id][r.offset : r.offset + r.length]
        assert np.array_equal(own, np.frombuffer(r.ids, "<u4"))
    assert sorted(4096 - sequences.n_tokens) == plain_best_fit(rows_got.length.tolist(), 4096)
    assert best_fit.packing_digest(documents([]), vocabulary()).count() == 0


def test_best_fit_query_equals_plain_best_fit(spark, sf):
    got = registry()["op11_best_fit_packing"](spark, sf).toPandas()
    used = got.groupby("sequence_id").length.sum()
    assert sorted(4096 - used) == plain_best_fit(got.length.tolist(), 4096)
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    ids = {r.doc_id: [*word_ids(vocabulary()).tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in texts.itertuples()}
    import zlib

    for r in got.itertuples():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and r.length == min(4096, len(ids[r.doc_id]) - r.start)
        assert r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())


# --- hard negatives ---------------------------------------------------------------
VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())]
    + [T.StructField(name, T.StringType()) for name in ("row", "tile", "part", "query", "rank", "low")]
)


def plain_negatives(rows, every, positives=5, negatives=3):
    valid = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        valid.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    out = []
    for vec_id, label, vector in valid:
        if vec_id % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(vector, v)), i, lab) for i, lab, v in valid if i != vec_id)
        for score, positive, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and 50 * -score <= 100 * -s[0] <= 95 * -score][:negatives]
            out += [(vec_id, positive, rank, i, -score, -s) for rank, (s, i, _) in enumerate(inside, 1)]
    return sorted(out)


def mined(spark, rows, every, partitions=3):
    frame = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], VECTORS).repartition(partitions)
    got = hard_negatives.hard_negatives(frame, anchor_every=every).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


def crowded(seed, n, copies):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in rng.choice(centres)], rng.randrange(4)) for i in range(n)]
    return rows + [(n + i, list(rows[3][1]), 1 + i % 2) for i in range(copies)]


def test_hard_negatives_of_many_small_parts(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "PART_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 4)
    monkeypatch.setattr(hard_negatives, "FANOUT", 3)
    monkeypatch.setattr(hard_negatives, "BLOCK_QUERIES", 7)
    rows = crowded(5, 500, 200)  # a crowd of copies with ties in every score
    want = plain_negatives(rows, 10)
    assert len(want) > 300
    assert mined(spark, rows, 10) == want


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [0.1 * i, 1.0, -0.5], i % 3) for i in range(1, 40)]
    rows += [(50, None, 1), (100, [nan, 1.0], 1), (150, [inf, 1.0], 1), (200, [None, 1.0], 1), (250, [1.0, 2.0], None), (None, [1.0], 1)]
    rows += [(300, [], 1), (350, [0.5], 1), (400, [0.3] * 5, 1), (450, [1e300, 1.0], 2), (51, [-1e300, 0.5], 0), (52, [1e18, 0.0], 0)]
    rows += [(500, [0.2, 0.4, 0.1], 1), (500, [0.3, 0.4, 0.1], 2), (53, [0.2, 0.4, 0.1], 1), (53, [0.2, 0.4, 0.1], 1)]
    want = [r for r in plain_negatives(rows, 50) if abs(r[4]) < 2**60]
    got = [r for r in mined(spark, rows, 50) if abs(r[4]) < 2**60]
    assert got == want and len(want) > 10
    assert mined(spark, [], 50) == [] and mined(spark, [(50, [1.0], 1)], 50) == []


def test_a_tree_has_each_row_once_inside_its_boxes():
    rng = np.random.default_rng(1)
    vectors, labels = np.floor(rng.normal(size=(1000, 5)) * 50), rng.integers(0, 3, 1000)
    tree = hard_negatives.Tree(vectors, labels, np.arange(1000), np.arange(1000))
    assert sorted(tree.ids) == list(range(1000)) and len(tree.levels[-1][0]) <= hard_negatives.FANOUT
    low, high, first, last = tree.levels[0]
    for leaf in range(len(low)):
        own = slice(leaf * 32, leaf * 32 + 32)
        assert (tree.vectors[own] >= low[leaf]).all() and (tree.vectors[own] <= high[leaf]).all()
        assert (tree.labels[own] >= first[leaf]).all() and (tree.labels[own] <= last[leaf]).all()


# --- source divergence -------------------------------------------------------------
DOCS = T.StructType([T.StructField(n, T.StringType()) for n in ("text", "lang", "source", "term", "n", "item", "rank", "own", "block")])


def plain_divergence(rows):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        in_docs = Counter(t for d in docs if d[0] == lang for t in set(d[2]))
        kept = [t for t, n in in_docs.items() if n >= 10]
        counts = {s: Counter(t for d in docs if d[:2] == (lang, s) for t in d[2] if in_docs[t] >= 10) for s in {d[1] for d in docs if d[0] == lang}}

        def shares(c):
            return {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}

        whole, of = shares(sum(counts.values(), Counter())), {s: shares(c) for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s, c in counts.items():
            pairs = sorted((-sum(f(of[s][t], of[o][t]) for t in kept), o.encode(), o) for o in counts if o != s)
            out += [(lang, s, "pair", o, -v, rank) for rank, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(of[s][t], whole[t]), t.encode(), t) for t in kept if c[t] and of[s][t] > whole[t])[:10]
            out += [(lang, s, "term", t, -v, rank) for rank, (v, _, t) in enumerate(terms, 1)]
    return sorted(out)


def audited(spark, rows):
    frame = spark.createDataFrame([(*r, *["x"] * 6) for r in rows], DOCS).repartition(3)
    return sorted(tuple(r) for r in divergence.source_divergence(frame).collect())


def texts(seed, n, sources):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["Été", "中文", "�", "Zz", "zZ", "\U0001f600"]
    rows = []
    for _ in range(n):
        source = f"s{min(rng.randrange(sources), rng.randrange(sources))}"
        own = [rng.choice(words) if rng.random() < 0.8 else rng.choice(words[:3]) for _ in range(rng.randrange(40))]
        rows.append((rng.choice([" ", "1", "-", "\n"]).join(own), rng.choice(["en", "de", None]), source))
    return rows


@pytest.mark.parametrize("block_terms, block_sources, held", [(2048, 64, 200_000), (20, 3, 50)])
def test_divergence_equals_brute_force(spark, monkeypatch, block_terms, block_sources, held):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", block_sources)
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    monkeypatch.setattr(divergence, "CUT_BYTES", 30)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 100_000 if block_terms == 2048 else 1)
    rows = texts(block_terms, 300, 9) + [(None, "en", "only"), ("", "en", ""), ("same words here " * 5, "en", None)] * 2 + [("lone", "fr", "a"), ("lone", "fr", "b"), ("x", "it", "a")]
    want = plain_divergence(rows)
    assert len({r[:2] for r in want}) > 20 and ("fr", "a", "pair", "b", 0, 1) in want
    assert audited(spark, rows) == want


def test_divergence_of_no_rows_and_of_a_long_text(spark):
    assert audited(spark, []) == []
    rows = [("word " * 300_000, "en", "a"), *[("Word other", "en", "b")] * 12]
    assert audited(spark, rows) == plain_divergence(rows)


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    n, total, terms = 3 * 10**17, 9 * 10**17, 10**9
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(total).alias("total"), F.lit(terms).alias("terms"))
    got = row.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (n + 2) // (total + 2 * terms)
