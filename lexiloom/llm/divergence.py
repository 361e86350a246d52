"""Source divergence audit: how far the term shares of each language's sources lie apart, by count-level bitmaps.

Each language keeps the terms that stand in enough of its documents. For every
source and every count, a bitmap holds the terms with that count there. The
terms that have count a in one source and count b in another are the AND of two
bitmaps, and a term's contribution depends on the two counts alone, so a pair's
divergence is the sum over its cells of popcount times contribution. Count 0 has
no bitmap: its cells are what the other cells leave over.

Terms are dealt by hash into blocks of about `BLOCK_TERMS`, sources into blocks
of about `BLOCK_SOURCES`; a task compares two blocks of sources over one block of
terms. Bitmaps keep only words that aren't zero, and all they cost grows with
(source, term) pairs, not with texts. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LEAST_DOCUMENTS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
BLOCK_TERMS, BLOCK_SOURCES = 2048, 64
#: Counted terms a task holds before it hands them on, and the bytes of a text it cuts at a time.
HELD_TERMS, CUT_BYTES = 200_000, 1 << 20
#: Rows up to which a table of languages or groups is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Letters A-Z become small; what is no letter to the rule (ASCII without A-Z and a-z) becomes a blank.
FOLDED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x61 <= b <= 0x7A else 32 for b in range(256))
COUNTS = "lang BINARY, source BINARY, term BINARY, n LONG, n_docs LONG"
HALVES = "lang BINARY, a BINARY, b BINARY, value LONG"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """A text's terms in order, in lists of about `CUT_BYTES`."""
    folded, at = text.translate(FOLDED), 0
    while at < len(folded):
        end = folded.find(b" ", at + CUT_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) of every group, and one row per group with an empty term. Missing values count as ''."""

    def rows(groups: dict) -> pa.RecordBatch:
        flat = [(*group, t, n, docs_with[t]) for group, (counts, docs_with) in groups.items() for t, n in counts.items()]
        columns = list(zip(*flat, strict=True)) or [[]] * 5
        kinds = [pa.binary()] * 3 + [pa.int64()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["lang", "source", "term", "n", "n_docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[bytes, bytes], tuple[Counter, Counter]] = {}
        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang"), batch.column("source"), batch.column("text"), strict=True):
                group = (lang.as_py(), source.as_py())
                if group not in groups:
                    groups[group] = (Counter({b"": 0}), Counter())
                counts, docs_with = groups[group]
                before, own = len(counts), set()
                for terms in terms_of(text.as_py()):
                    counts.update(terms)
                    own.update(terms)
                docs_with.update(own)
                held += len(counts) - before
                if held > HELD_TERMS:
                    yield rows(groups)
                    groups, held = {}, 0
        yield rows(groups)

    plain = docs.select(*(F.coalesce(F.col(c).cast("binary"), F.lit(b"")).alias(c) for c in ("lang", "source", "text")))
    counted = plain.mapInArrow(count, COUNTS).groupBy("lang", "source", "term")
    return stored(counted.agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "terms")


def _beside(df: DataFrame, small: DataFrame, keys: list[str]) -> DataFrame:
    """`df` with the columns of a table that has one row per language or group; sent to all tasks if it is short."""
    return df.join(F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small, keys)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 terms)), exactly; 1 without terms."""
    wide = [c.cast("decimal(20,0)") for c in (n + 2, F.greatest(total + 2 * terms, F.lit(1)))]
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide[0], wide[1])


def contribution(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares end at about 10^9, so this stays in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def level_bitmaps(occurrences: DataFrame) -> DataFrame:
    """(lang, block, source, n, word, bits): per source and count the terms of a block with that count, as 64-bit words that aren't zero."""
    bit = F.expr("shiftleft(1L, cast(position & 63 as int))")
    words = occurrences.select("lang", "block", "source", "n", F.expr("cast(position div 64 as int)").alias("word"), bit.alias("bit"))
    return words.groupBy("lang", "block", "source", "n", "word").agg(F.bit_or("bit").alias("bits"))


def _pair_sum(a, b, n_terms: int) -> int:
    """Sum over a block's terms of the contributions of sources `a` and `b`: joint cells by AND and popcount, zeros by complement."""
    import numpy as np

    def f(p, q):
        return (p - q) * (p - q) // (p + q)

    joint = np.zeros((len(a["p"]), len(b["p"])), dtype=np.int64)
    if joint.size:
        both = np.bitwise_count(a["bits"][:, None] & b["levels"][:, a["word"]].T)
        joint = np.add.reduceat(both, a["starts"], axis=0, dtype=np.int64)
    total = (joint * f(a["p"][:, None], b["p"][None, :])).sum()
    total += ((a["sizes"] - joint.sum(axis=1)) * f(a["p"], b["zero"])).sum()
    total += ((b["sizes"] - joint.sum(axis=0)) * f(b["p"], a["zero"])).sum()
    neither = n_terms - a["sizes"].sum() - b["sizes"].sum() + joint.sum()
    return int(total + neither * f(a["zero"], b["zero"]))


def compare_blocks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs of two blocks of sources over one block of terms. Rows with `word` -1 name a source, its share at count 0 and the block's size."""
    import numpy as np

    table = pa.Table.from_batches(list(batches)).sort_by([("source", "ascending"), ("n", "ascending"), ("word", "ascending")])
    names, side = table.column("source").to_pylist(), np.asarray(table.column("own"))
    n, word, p, bits = (np.asarray(table.column(c)) for c in ("n", "word", "p", "bits"))
    width = int(word.max()) + 1
    borders = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
    sources = []
    for at, end in zip(borders, [*borders[1:], len(names)], strict=True):  # a source's first row is the one that names it
        own = slice(at + 1, end)
        level, starts = np.unique(n[own], return_index=True)
        index = np.searchsorted(level, n[own])
        levels = np.zeros((len(level), width), dtype=np.uint64)
        levels[index, word[own]] = bits[own].astype(np.uint64)
        sources.append(
            {"name": names[at], "side": side[at], "zero": p[at], "n_terms": bits[at], "p": p[own][starts], "starts": starts, "word": word[own],
             "bits": bits[own].astype(np.uint64), "levels": levels, "sizes": np.bitwise_count(levels).sum(axis=1, dtype=np.int64)}
        )
    lang, i, j = key[0].as_py(), key[2].as_py(), key[3].as_py()
    for a in sources:
        beside = [b for b in sources if (a["name"] < b["name"] if i == j else (a["side"], b["side"]) == (i, j))]
        if beside:
            values = [_pair_sum(a, b, int(a["n_terms"])) for b in beside]
            columns = [pa.array(c, pa.binary()) for c in ([lang] * len(beside), [a["name"]] * len(beside), [b["name"] for b in beside])]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.int64())], names=["lang", "a", "b", "value"])


def source_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank) of all sources of all languages.

    Part `pair` ranks the other sources of a language by their divergence from a
    source over all kept terms; part `term` the ten kept terms a source uses more
    than its language does. Each row is a document, also one that repeats; a
    missing text, language or source counts as ''. A language without kept terms
    gives pairs of value 0, a language with one source none. Other columns are
    not read. An empty table gives no row.
    """
    counts = term_counts(docs)
    kept = counts.where("n > 0").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("n_docs").alias("n_docs"))
    kept = kept.where(F.col("n_docs") >= LEAST_DOCUMENTS).drop("n_docs")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("lang_n").alias("lang_total"))
    sources = counts.where("n = 0").select("lang", "source")
    langs = sources.groupBy("lang").agg(F.count("*").alias("n_sources")).join(sizes, "lang", "left").na.fill(0, ["n_terms", "lang_total"])
    langs = stored(
        langs.withColumn("n_blocks", F.greatest(F.ceil(F.col("n_terms") / BLOCK_TERMS), F.lit(1)))
        .withColumn("source_blocks", F.ceil(F.col("n_sources") / BLOCK_SOURCES)),
        "langs",
    )
    blocked = _beside(kept, langs.select("lang", "n_blocks", "n_terms", "lang_total"), ["lang"])
    blocked = blocked.withColumn("block", F.pmod(F.xxhash64("term"), F.col("n_blocks")))
    place = F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1
    whole = share(F.col("lang_n"), F.col("lang_total"), F.col("n_terms")).alias("q")
    terms = stored(blocked.select("lang", "block", "term", place.alias("position"), whole), "kept")
    found = stored(counts.where("n > 0").drop("n_docs").join(terms, ["lang", "term"]), "found")

    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = _beside(sources.join(totals, ["lang", "source"], "left").na.fill(0, ["total"]), langs, ["lang"])
    own_block = F.pmod(F.xxhash64("source"), F.col("source_blocks")).cast("int")
    groups = stored(groups.select("lang", "source", "total", "n_terms", "n_blocks", "source_blocks", "n_sources", own_block.alias("own")), "groups")
    per_group = groups.select("lang", "source", "total", "n_terms", "source_blocks", "own")

    lines = _pairs(found, terms, groups, per_group).unionByName(_top_terms(found, per_group))
    texts = [F.col(c).cast("string").alias(c) for c in ("lang", "source")]
    return lines.select(*texts, "part", F.col("item").cast("string").alias("item"), "value", "rank")


def _pairs(found: DataFrame, terms: DataFrame, groups: DataFrame, per_group: DataFrame) -> DataFrame:
    p = share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p")
    levels = _beside(level_bitmaps(found), per_group, ["lang", "source"])
    levels = levels.select("lang", "block", "source", "n", "word", "bits", p, "own", "source_blocks")
    in_block = terms.groupBy("lang", "block").agg(F.count("*").alias("bits"))
    blocks = groups.where("n_sources > 1").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    blocks = blocks.join(in_block, ["lang", "block"], "left").na.fill(0, ["bits"]).withColumns({"n": F.lit(0), "word": F.lit(-1)})
    named = blocks.select("lang", "block", "source", F.col("n").cast("long").alias("n"), "word", "bits", p, "own", "source_blocks")
    partner = F.explode(F.sequence(F.lit(0), F.col("source_blocks").cast("int") - 1)).alias("partner")
    rows = levels.unionByName(named).select("*", partner).withColumns({"i": F.least("own", "partner"), "j": F.greatest("own", "partner")})
    halves = rows.drop("partner", "source_blocks").groupBy("lang", "block", "i", "j").applyInArrow(compare_blocks, HALVES)
    summed = halves.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    both = summed.select("lang", "value", ways.alias("way")).select("lang", "way.*", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _top_terms(found: DataFrame, per_group: DataFrame) -> DataFrame:
    p = share(F.col("n"), F.col("total"), F.col("n_terms")).alias("p")
    more = _beside(found, per_group, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), "q", p).where("p > q")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = more.withColumn("value", contribution(F.col("p"), F.col("q"))).withColumn("rank", rank).where(F.col("rank") <= TOP_TERMS)
    return ranked.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
