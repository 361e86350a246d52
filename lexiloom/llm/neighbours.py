"""Near-duplicate vectors by NN-descent.

Equal vectors with equal labels are one class. First neighbours come from
random hyperplane codes: in each of several tables, classes sorted by label,
code and a random projection meet the next few in that order. Then the graph is
refined: each class meets the neighbours of some of its neighbours, through as
many of them as the current list length allows; while a list is longer than
that (saturated), the length grows fourfold. Edges under the threshold but over
`FLOOR` serve as paths only. The bits of a code and the number of tables follow
the size of each label. When nothing new turns up, a sample of classes is
compared with all others, for labels of each size; where too few of their true
links were found, more tables are added, and in the end these labels are
compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, pi

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .graph import components

FLOOR = 0.92
#: Classes that share a code on average, classes met in sorted order, chance of a link that all first tables miss.
BUCKET, LAG, MISS = 16, 4, 1e-4
#: Neighbours that a class goes through in a round, and the list length at first.
PIVOTS, LIST = 3, 32
#: Classes compared with all others in the audit of a label size, at first and at most, links that make it sure enough,
#: the share of them that must have been found, rounds of new tables.
AUDITED, MOST_AUDITED, SEEN, LEAST_RECALL, AUDITS = 128, 2048, 200, 0.98, 3
#: Classes of a block of the exact comparison.
BLOCK = 1024


def sound(label: Column, vector: Column) -> Column:
    """Whether a row takes part: a label, no null or non-finite component, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit_vectors(rows):
    """Rows of an Arrow list column of one length as unit vectors in double precision."""
    import numpy as np

    flat = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True))


def by_length(*columns):
    """Index arrays of the rows whose vectors all have one length, for each such length."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = [pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in columns]
    same = np.all([x == lengths[0] for x in lengths], axis=0)
    for n in np.unique(lengths[0][same]):
        yield np.flatnonzero(same & (lengths[0] == n))


def _first_edges(classes: DataFrame, tables: dict[int, int], seed: int) -> DataFrame:
    """(a, b, cosine) of classes next to each other in some table; `tables` has their number by the bits of a label's codes."""

    def coded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        planes: dict[tuple[int, int], object] = {}
        for batch in batches:
            for own in by_length(batch.column("vector")):
                widths = batch.column("bits").to_numpy()[own]
                for bits in map(int, np.unique(widths)):
                    part = batch.take(pa.array(own[widths == bits]))
                    units = unit_vectors(part.column("vector"))
                    n = units.shape[1]
                    if (n, bits) not in planes:
                        planes[n, bits] = np.random.default_rng([seed, n]).standard_normal((n, tables[bits] * (bits + 1)))
                    sides = (units @ planes[n, bits]).reshape(len(units), tables[bits], bits + 1)
                    codes = ((sides[:, :, :bits] > 0) << np.arange(bits)).sum(axis=2)
                    for number in range(tables[bits]):
                        columns = [part.column("rep"), part.column("label_key"), pa.array(np.full(len(units), number)), pa.array(codes[:, number]), pa.array(sides[:, number, bits]), part.column("vector")]
                        yield pa.RecordBatch.from_arrays(columns, names=["rep", "label_key", "number", "code", "place", "vector"])

    def adjacent(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        before = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if before is None else [before, batch]).combine_chunks()
            if table.num_rows:
                for own in by_length(table.column("vector").combine_chunks()):
                    part = table.take(pa.array(own))
                    units = unit_vectors(part.column("vector").combine_chunks())
                    reps, keys = part.column("rep").to_numpy(), [part.column(c).to_numpy() for c in ("label_key", "number", "code")]
                    for lag in range(1, min(LAG, len(own) - 1) + 1):
                        cosine = (units[:-lag] * units[lag:]).sum(axis=1)
                        good = np.flatnonzero((cosine >= FLOOR) & np.all([k[:-lag] == k[lag:] for k in keys], axis=0))
                        one, two = reps[:-lag][good], reps[lag:][good]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two)), pa.array(cosine[good])], names=["a", "b", "cosine"])
                before = table.slice(max(0, table.num_rows - LAG)).to_batches()[0]

    kind = classes.schema["vector"].dataType.simpleString()
    order = ["label_key", "number", "code", "place"]
    sides = classes.select("rep", "label_key", "bits", "vector").mapInArrow(coded, f"rep LONG, label_key LONG, number LONG, code LONG, place DOUBLE, vector {kind}")
    # by range, so that one crowded code is spread over tasks
    return sides.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(adjacent, "a LONG, b LONG, cosine DOUBLE").where("a < b")


def _measured(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) with their cosine, those under FLOOR left out."""

    def cosines(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for own in by_length(batch.column("one"), batch.column("two")):
                for at in range(0, len(own), 4096):
                    part = batch.take(pa.array(own[at : at + 4096]))
                    cosine = (unit_vectors(part.column("one")) * unit_vectors(part.column("two"))).sum(axis=1)
                    good = pa.array(np.flatnonzero(cosine >= FLOOR))
                    yield pa.RecordBatch.from_arrays([part.column("a").take(good), part.column("b").take(good), pa.array(cosine).take(good)], names=["a", "b", "cosine"])

    one, two = (classes.select(F.col("rep").alias(x), F.col("vector").alias(v), F.col("label_key").alias(f"label_{x}")) for x, v in (("a", "one"), ("b", "two")))
    both = pairs.join(one, "a").join(two, "b").where("label_a = label_b")
    return both.select("a", "b", "one", "two").mapInArrow(cosines, "a LONG, b LONG, cosine DOUBLE")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))


def _refined(edges: DataFrame, classes: DataFrame) -> DataFrame:
    """NN-descent until no list is saturated and no edge is new."""
    length = LIST
    while True:
        ways = _both_ways(edges)
        lists = stored(
            ways.select(
                "a", "b", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b")).alias("rank"),
                F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("b"))).alias("turn"),
            ),
            "lists",
        )
        # neighbours drawn in one order for all: members of a crowd go through the same few
        through = lists.where(F.col("turn") <= PIVOTS).select("a", F.col("b").alias("pivot"))
        reached = lists.where(F.col("rank") <= length).select(F.col("a").alias("pivot"), F.col("b").alias("c"))
        pairs = through.join(reached, "pivot").where("a <> c").select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
        new = stored(_measured(pairs.join(edges.select("a", "b"), ["a", "b"], "left_anti"), classes), "new")
        grown, saturated = new.count(), lists.where(F.col("rank") > length).limit(1).count()
        if not grown and not saturated:
            return edges
        edges = edges.unionByName(new)
        length *= 4 if saturated else 1


def audit(edges: DataFrame, classes: DataFrame, sizes: dict[int, int], threshold: float, audited: int) -> dict[int, tuple[int, int]]:
    """By bits, the true links of about `audited` random classes and how many of them `edges` holds; `sizes` has the number of classes by bits."""
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << 30))
    drawn = F.coalesce(*(F.when(F.col("bits") == bits, place < min(1 << 30, ceil((1 << 30) * audited / n))) for bits, n in sizes.items()), F.lit(False))
    sample = classes.where(drawn).select("rep", "label_key", "bits", "vector").toArrow()
    if not sample.num_rows:
        return {}

    def compared(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        queries = sample.combine_chunks()
        q_bits, q_vectors = queries.column("bits").to_numpy(), queries.column("vector").combine_chunks()
        groups = []
        for own in by_length(q_vectors):
            for bits in np.unique(q_bits[own]):
                mine = own[q_bits[own] == bits]
                for at in range(0, len(mine), 256):
                    few = pa.array(mine[at : at + 256])
                    groups.append((bits, queries.take(few), unit_vectors(q_vectors.take(few))))
        for batch in batches:
            for own in by_length(batch.column("vector")):
                widths = batch.column("bits").to_numpy()[own]
                for width in np.unique(widths):
                    part = batch.take(pa.array(own[widths == width]))
                    units = unit_vectors(part.column("vector"))
                    for bits, asked, asked_units in groups:
                        if bits != width or asked_units.shape[1] != units.shape[1]:
                            continue
                        labels = part.column("label_key").to_numpy()[:, None] == asked.column("label_key").to_numpy()
                        rows, columns = np.nonzero((units @ asked_units.T >= threshold) & labels)
                        one, two = part.column("rep").to_numpy()[rows], asked.column("rep").to_numpy()[columns]
                        yield pa.RecordBatch.from_arrays([pa.array(two), pa.array(one), pa.array(np.full(len(one), bits, dtype=np.int64))], names=["a", "b", "bits"])

    true = classes.where(F.col("bits").isin(list(sizes))).select("rep", "label_key", "bits", "vector").mapInArrow(compared, "a LONG, b LONG, bits LONG").where("a <> b")
    found = _both_ways(edges.where(F.col("cosine") >= threshold)).select("a", "b", F.lit(1).alias("hit"))
    return {r.bits: (r.total, r.hits) for r in true.join(found, ["a", "b"], "left").groupBy("bits").agg(F.count("*").alias("total"), F.count("hit").alias("hits")).collect()}


def _short(edges: DataFrame, classes: DataFrame, sizes: dict[int, int], threshold: float) -> list[int]:
    """The bits whose labels lack links; the sample grows until enough links are seen."""
    short, left, audited = [], dict(sizes), AUDITED
    while left:
        seen = audit(edges, classes, left, threshold, audited)
        for bits, n in list(left.items()):
            total, hits = seen.get(bits, (0, 0))
            if total >= SEEN or audited >= min(n, MOST_AUDITED):
                del left[bits]
                if (hits / total if total else 1.0) < LEAST_RECALL:
                    short.append(bits)
        audited *= 4
    return short


def _exact_edges(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, cosine) of all links, by comparing each label's blocks of classes with each other."""

    def compared(group):
        import numpy as np
        import pyarrow as pa

        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for own in by_length(group.column("vector").combine_chunks()):
            part = group.take(pa.array(own))
            units, reps, blocks = unit_vectors(part.column("vector").combine_chunks()), part.column("rep").to_numpy(), part.column("block").to_numpy()
            left, right = blocks == part.column("low").to_numpy(), blocks == part.column("high").to_numpy()
            one, two = np.nonzero(units[left] @ units[right].T >= threshold)
            # both ways within a block, either way between two
            a, b = reps[left][one], reps[right][two]
            cosine = (units[left][one] * units[right][two]).sum(axis=1)
            out.append((np.minimum(a, b), np.maximum(a, b), cosine))
        a, b, cosine = (np.concatenate(x) for x in zip(*out, strict=True))
        good = a < b
        return pa.table({"a": a[good], "b": b[good], "cosine": cosine[good]})

    blocks = F.ceil(F.col("n_label") / BLOCK).cast("long")
    parts = classes.select("rep", "label_key", "vector", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64(F.lit("block"), "rep"), F.col("blocks")))
    met = parts.select("rep", "label_key", "vector", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    met = met.select("rep", "label_key", "vector", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    return met.groupBy("label_key", "low", "high").applyInArrow(compared, "a LONG, b LONG, cosine DOUBLE").distinct()


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of `vectors` (vec_id, embedding, label).

    Rows with a null label, a null or zero vector, or one with null or
    non-finite components link with nothing; so do rows with a null id, whose
    component is null and which are kept. Vectors of different length aren't
    compared. Equal rows, and rows that share an id, are vectors each and count
    as links of each other if their vectors are linked. Other columns are not
    read; an empty table gives no row.
    """
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
    whole = rows.where(sound(F.col("label"), F.col("vector")) & F.col("vec_id").isNotNull())
    classes = stored(
        whole.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")).withColumn("label_key", F.xxhash64("label")).drop("label"), "classes"
    )
    bits = F.ceil(F.log2(F.greatest(F.lit(2.0), F.col("n_label") / BUCKET))).cast("long")
    labels = classes.groupBy("label_key").agg(F.count("*").alias("n_label")).withColumn("bits", bits)
    classes = stored(classes.join(labels, "label_key"), "sized")
    sizes = {r.bits: r.n for r in classes.groupBy("bits").agg(F.count("*").alias("n")).collect()}
    tables = {n: ceil(log(MISS) / log(1 - 0.9 * (1 - acos(threshold) / pi) ** n)) for n in sizes}
    edges, short = None, list(sizes)
    for seed in range(AUDITS):
        first = _first_edges(classes.where(F.col("bits").isin(short)), tables, seed)
        found = first if edges is None else first.unionByName(edges)
        edges = stored(_refined(stored(found.groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "edges"), classes), "edges")
        short = _short(edges, classes, {n: sizes[n] for n in short}, threshold)
        if not short:
            break
    if short:
        exact = _exact_edges(classes.where(F.col("bits").isin(short)), threshold)
        edges = stored(edges.unionByName(exact).groupBy("a", "b").agg(F.max("cosine").alias("cosine")), "edges")
    links = edges.where(F.col("cosine") >= threshold).select("a", "b")
    sizes = classes.select(F.col("rep").alias("b"), "n")
    linked = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(sizes, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    counted = classes.join(linked, "rep", "left").join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    counted = counted.select(F.xxhash64("label_key", "vector").alias("__key"), "label_key", "vector", F.coalesce("root", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    keyed = rows.withColumn("__sound", sound(F.col("label"), F.col("vector")) & F.col("vec_id").isNotNull()).withColumn("__key", F.when(F.col("__sound"), F.xxhash64(F.xxhash64("label"), "vector")))
    own = keyed.alias("l").join(counted.alias("r"), (F.col("l.__key") == F.col("r.__key")) & (F.col("l.vector") == F.col("r.vector")), "left")
    component = F.coalesce("component_id", "vec_id")
    return own.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
