"""Near-duplicate documents: banded MinHash candidates with sequential Bayesian verification.

Documents with the same shingle set are one class from the start. A class has a
MinHash signature in two parts. Bands of the first part find candidates. The
second part is compared batch by batch: after each batch the posterior chance
that the similarity reaches the threshold follows from the agreements so far
(uniform prior), and a pair is given up as soon as it is under `MISS`. Then a
bound that is always right: shingles are counted in `CELLS` cells by hash, and
two sets differ in at least as many shingles as their counts do. Survivors are
decided on their full sets.

Candidates are not all pairs of a bucket. First every member meets its
bucket's smallest member; what is linked then is one component. Only members
of different components that still share a bucket meet after that, since a link
inside a component changes nothing. They do so in blocks of at most `BLOCK`
members, as array operations: only survivors become rows, and a crowded bucket
is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .graph import components
from .shingles import Shingler, mixed, parts

#: At similarity 0.8 all bands miss with a chance of (1 - 0.8^5)^40, about 1e-7.
BANDS, ROWS = 40, 5
#: Hashes of a verification batch, batches, and the chance at which a pair is given up wrongly.
BATCH, BATCHES, MISS = 14, 4, 1e-6
#: Cells of the counts that bound the difference of two sets; members of a block; rows of blocks that one task takes together.
CELLS, BLOCK, TOGETHER = 512, 1024, 4096
#: Rows of a block that are compared with another block at once.
STRIPE = 128
SKETCH = "doc_id LONG, n_shingles LONG, set_high LONG, set_low LONG, bands ARRAY<LONG>, signature BINARY"


def least_agreements(percent: int) -> list[int]:
    """For each batch, how many agreements so far keep a pair: fewer leave a posterior chance under MISS.

    With a uniform prior, the chance that the similarity is at least t after m
    of n agreements is that of at most m successes in n + 1 trials with chance t.
    """
    t, out = percent / 100, []
    for n in range(BATCH, BATCH * BATCHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < MISS:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """A row per document: set size, a 128-bit hash of the set, band hashes, verification signature."""

    def sketch(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        shingler = Shingler(words)
        n_hashes = BANDS * ROWS + BATCH * BATCHES
        seeds = mixed(np.arange(1, 2 * n_hashes + 1, dtype=np.uint64))
        times, plus = (seeds[:n_hashes] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[n_hashes:] >> np.uint64(32)).astype(np.uint32)
        band_seeds = mixed(np.arange(1001, 1001 + BANDS, dtype=np.uint64))
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for first, end in parts(texts):
                sizes, highs, lows, bands, signatures = [], [], [], [], []
                for own in shingler.sets(texts[first:end]):
                    digest = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
                    sizes.append(len(own))
                    highs.append(int.from_bytes(digest[:8], "little", signed=True))
                    lows.append(int.from_bytes(digest[8:], "little", signed=True))
                    if not len(own):
                        bands.append([])
                        signatures.append(b"")
                        continue
                    low, least = (own >> np.uint64(32)).astype(np.uint32), None
                    for at in range(0, len(low), 1024):
                        block = low[at : at + 1024, None] * times
                        block += plus
                        found = block.min(axis=0)
                        least = found if least is None else np.minimum(least, found)
                    keys = band_seeds.copy()
                    for row in range(ROWS):
                        keys = mixed(keys * np.uint64(31) + least[row : BANDS * ROWS : ROWS].astype(np.uint64))
                    bands.append(keys.view(np.int64))
                    signatures.append(least[BANDS * ROWS :].tobytes())
                arrays = [ids.slice(first, end - first), pa.array(sizes, pa.int64()), pa.array(highs, pa.int64()), pa.array(lows, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_shingles", "set_high", "set_low", "bands", "signature"])

    return stored(docs.select("doc_id", "text").mapInArrow(sketch, SKETCH), "sketches")


def _profiles(classes: DataFrame, wanted: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(rep, n, signature, cells, shingles) of the wanted classes; their sets are made anew from the texts."""

    def full(batches: Iterator) -> Iterator:
        import hashlib

        import numpy as np
        import pyarrow as pa

        shingler = Shingler(words)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for first, end in parts(texts):
                highs, cells, sets = [], [], []
                for own in shingler.sets(texts[first:end]):
                    data = own.tobytes()
                    highs.append(int.from_bytes(hashlib.blake2b(data, digest_size=16).digest()[:8], "little", signed=True))
                    cells.append(np.minimum(np.bincount((own % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 65535).astype("<u2").tobytes())
                    sets.append(data)
                arrays = [batch.column("rep").slice(first, end - first), pa.array(highs, pa.int64()), pa.array(cells, pa.binary()), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["rep", "set_high", "cells", "shingles"])

    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep", "left_semi")
    sets = texts.mapInArrow(full, "rep LONG, set_high LONG, cells BINARY, shingles BINARY").dropDuplicates(["rep", "set_high"])
    own = classes.select("rep", "set_high", F.col("n_shingles").alias("n"), "signature").dropDuplicates(["rep", "set_high"])
    return stored(own.join(sets, ["rep", "set_high"]).drop("set_high"), "profiles")


def _survivors(one, two, limits: list[int], percent: int):
    """Rows of index pairs (i, j) between two blocks of members that neither test gives up. A block: sizes, signatures, cells."""
    import numpy as np

    found_i, found_j = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    (n_one, sig_one, cells_one), (n_two, sig_two, cells_two) = one, two
    for start in range(0, len(n_one), STRIPE):
        own = n_one[start : start + STRIPE, None]
        i, j = np.nonzero(np.minimum(own, n_two) * 100 >= np.maximum(own, n_two) * percent)
        i += start
        agreed = np.zeros(len(i), dtype=np.int64)
        for number, least in enumerate(limits):
            span = slice(number * BATCH, (number + 1) * BATCH)
            agreed += (sig_one[i, span] == sig_two[j, span]).sum(axis=1)
            alive = agreed >= least
            i, j, agreed = i[alive], j[alive], agreed[alive]
        for at in range(0, len(i), 8192):
            a, b = i[at : at + 8192], j[at : at + 8192]
            apart = np.abs(cells_one[a].astype(np.int32) - cells_two[b]).sum(axis=1)
            total = n_one[a] + n_two[b]
            good = (total - apart) * 100 >= (total + apart) * percent
            found_i.append(a[good])
            found_j.append(b[good])
    return np.concatenate(found_i), np.concatenate(found_j)


def _members(table):
    """Sizes, signatures and cells of the rows of an Arrow table as arrays."""
    import numpy as np

    def matrix(name: str, kind: str):
        return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind).reshape(table.num_rows, -1)

    return table.column("n").to_numpy(), matrix("signature", "<u4"), matrix("cells", "<u2")


def _with_leaders(shared: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of each member with its bucket's smallest one that the tests don't give up."""
    limits = least_agreements(percent)

    def compare(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                names = ("n", "signature", "cells")
                one, two = (_members(part.select([f"{c}_{x}" for c in names]).rename_columns(names)) for x in "ab")
                alive = np.flatnonzero(np.minimum(one[0], two[0]) * 100 >= np.maximum(one[0], two[0]) * percent)
                agreed = np.zeros(len(alive), dtype=np.int64)
                for number, least in enumerate(limits):
                    span = slice(number * BATCH, (number + 1) * BATCH)
                    agreed += (one[1][alive, span] == two[1][alive, span]).sum(axis=1)
                    alive, agreed = alive[agreed >= least], agreed[agreed >= least]
                apart = np.abs(one[2][alive].astype(np.int32) - two[2][alive]).sum(axis=1)
                total = one[0][alive] + two[0][alive]
                yield part.select(["a", "b"]).take(alive[(total - apart) * 100 >= (total + apart) * percent])

    pairs = shared.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    one, two = (profiles.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("n", "signature", "cells"))) for x in "ab")
    both = pairs.join(two, "b").join(one, "a")
    return both.mapInArrow(compare, "a LONG, b LONG").distinct()


def _crossing(members: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs of a bucket's members in different components that the tests don't give up."""
    limits = least_agreements(percent)
    sizes = members.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    together = max(1, members.count() // TOGETHER)
    placed = members.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    meetings = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("low"), F.greatest("block", k).alias("high")))
    met = placed.select("bucket", "rep", "root", "block", "blocks", F.explode(meetings).alias("m")).select("bucket", "rep", "root", "block", "m.low", "m.high", "blocks")
    group = F.when(F.col("blocks") == 1, F.pmod("bucket", F.lit(together))).otherwise(F.xxhash64("bucket", "low", "high"))

    def compare(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("bucket", "ascending"), ("low", "ascending"), ("high", "ascending"), ("block", "ascending")])
        keys = [table.column(c).to_numpy() for c in ("bucket", "low", "high")]
        reps, roots, block = (table.column(c).to_numpy() for c in ("rep", "root", "block"))
        members, n = _members(table), table.num_rows
        edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), n]
        found = [np.zeros((2, 0), dtype=np.int64)]
        for low, high in zip(edges, edges[1:], strict=False):
            middle = low + int((block[low:high] == keys[1][low]).sum())
            first, second = slice(low, middle), slice(low if keys[1][low] == keys[2][low] else middle, high)
            i, j = _survivors([x[first] for x in members], [x[second] for x in members], limits, percent)
            a, b = reps[first][i], reps[second][j]
            other = (roots[first][i] != roots[second][j]) & (a != b)
            found.append(np.stack([np.minimum(a, b)[other], np.maximum(a, b)[other]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": pairs[0], "b": pairs[1]})

    profiled = met.join(profiles.drop("shingles"), "rep").withColumn("group", group)
    return profiled.groupBy("group").applyInArrow(compare, "a LONG, b LONG").distinct()


def _linked(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets reach the threshold."""

    def decide(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                one, two = (np.frombuffer(batch.column(c)[i].as_py(), dtype=np.uint64) for c in ("set_a", "set_b"))
                both = len(np.intersect1d(one, two, assume_unique=True))
                if 100 * both >= percent * (len(one) + len(two) - both):
                    good.append(i)
            yield batch.select(["a", "b"]).take(np.array(good, dtype=np.int64))

    one, two = (profiles.select(F.col("rep").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
    both = stored(pairs, "likely").join(two, "b").join(one, "a")
    return stored(both.select("a", "b", "set_a", "set_b").mapInArrow(decide, "a LONG, b LONG").distinct(), "verified")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Two documents are linked if 100 * intersection >= percent * union of their
    sets of `words`-word shingles. A null text, or one without words, has no
    shingle and is linked with nothing. A row with a null id is linked with
    nothing and kept: its component is null. Rows that share an id are one
    document to the links and get a row each. Other columns are not read; an
    empty table gives no row.
    """
    rows = sketches(docs, words)
    sound = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    sets = sound.groupBy("set_high", "set_low").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    mapped = rows.select("doc_id", "n_shingles", "set_high", "set_low").join(sets, ["set_high", "set_low"], "left")
    mapped = mapped.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    first = sound.join(sets, ["set_high", "set_low"], "left").where("rep IS NULL OR rep = doc_id")
    classes = stored(first.select(F.col("doc_id").alias("rep"), "set_high", "n_shingles", "bands", "signature"), "classes")

    buckets = classes.select(F.explode("bands").alias("bucket"), "rep")
    leaders = buckets.groupBy("bucket").agg(F.min("rep").alias("leader"), F.max("rep").alias("last")).where("leader < last").drop("last")
    shared = stored(buckets.join(leaders, "bucket"), "buckets")
    profiles = _profiles(classes, shared.select("rep").distinct(), docs, words)
    links = _linked(_with_leaders(shared, profiles, percent), profiles, percent)
    crossing = _crossing(_unsettled(shared, components(links)), profiles, percent)
    roots = components(links.unionByName(_linked(crossing, profiles, percent)))
    found = mapped.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left")
    component = F.coalesce("root", "rep")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _unsettled(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(bucket, rep, root) of the buckets whose members are in more than one component."""
    rooted = shared.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"))
    mixed_buckets = rooted.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    return stored(rooted.join(mixed_buckets, "bucket"), "unsettled")
