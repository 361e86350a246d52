"""Hard-negative mining by exact search in STR-packed R-trees.

All rows are dealt into parts by Sort-Tile-Recursive: by label, then by the two
coordinates that vary most. The borders of these tiles come from a hashed sample
of at most `SAMPLE_ROWS` rows, and only decide how close the rows of a part lie;
tiles of more than `PART_ROWS` rows are split by a hash of the row, so a crowd of
equal rows is no large part. Every row is in one part.

A task packs its part into an R-tree the same way, leaves of `LEAF_ROWS` rows
below nodes of `FANOUT` boxes. A box knows its labels and the interval of each
coordinate, which give an interval for the inner product with a query. Queries
are read from the shared folder block by block. Each block has a best-first
queue of boxes: a box comes out by the best score it can still give any query of
the block, queries whose window it misses, or whose kth score so far is above
its best, pass it by, and the search ends when no box can give anything better.

First anchors look for positives, then each positive's score window for
negatives; a task gives at most k rows per query, and these are ranked again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import run_folder, stored
from .token_files import file_system

POSITIVES, NEGATIVES = 5, 3
PART_ROWS, LEAF_ROWS, FANOUT, BLOCK_QUERIES = 8192, 32, 16, 512
#: The sample that tile borders come from, the tiles it can give, and the coordinates that are tiled besides the label.
SAMPLE_ROWS, MOST_TILES, COORDINATES = 8192, 512, 2
#: Scores are 64-bit numbers; larger ones count as the nearest of these.
MOST = 2**63 - 1
NOTHING = -MOST - 1
FOUND = "query LONG, score LONG, vec_id LONG, row LONG"


def usable(vector: str) -> Column:
    """The vector is there and all its components are finite numbers."""
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def mining_rows(df: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, with the label of every seventh id moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    there = usable("embedding") & F.col("vec_id").isNotNull() & F.col("label").isNotNull()
    return df.where(there).select(F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), "embedding")


# --- vectors and products -----------------------------------------------------
def matrix(column):
    """floor(256 x) of a column of vectors, as doubles; shorter vectors are filled up with 0."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets))
    values = np.floor(256.0 * np.asarray(column.flatten()).astype("float64"))
    if len(lengths) and (lengths == lengths[0]).all():
        return values.reshape(len(lengths), lengths[0])
    out = np.zeros((len(lengths), int(lengths.max(initial=0))))
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def products(a, b):
    """All inner products of the rows of two whole-numbered matrices, exactly; beyond 64 bits the nearest such number."""
    import numpy as np

    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape) for m in (a, b)]
    return np.clip(whole[0] @ whole[1].T, -MOST, MOST).astype(np.int64)


def tiled(index, keys: list, leaf: int):
    """Row numbers in Sort-Tile-Recursive order: slabs by the first key, tiled by the others."""
    import numpy as np

    index = index[np.argsort(keys[0][index], kind="stable")]
    if len(keys) == 1 or len(index) <= leaf:
        return index
    leaves = -(-len(index) // leaf)
    rows = -(-leaves // int(np.ceil(leaves ** (1 / len(keys))))) * leaf
    return np.concatenate([tiled(index[at : at + rows], keys[1:], leaf) for at in range(0, len(index), rows)])


def widest(vectors, n: int) -> list[int]:
    """The coordinates that vary most."""
    import numpy as np

    return np.argsort(-vectors.var(axis=0), kind="stable")[:n].tolist() if vectors.size else []


class Tree:
    """An R-tree over rows; a level's node `i` holds nodes (or rows) `i * size` to `(i + 1) * size` of the level below."""

    def __init__(self, vectors, labels, ids, rows):
        import numpy as np

        order = tiled(np.arange(len(ids)), [labels, *(vectors[:, c] for c in widest(vectors, COORDINATES + 1))], LEAF_ROWS)
        self.vectors, self.labels, self.ids, self.rows = vectors[order], labels[order], ids[order], rows[order]
        low, high, first, last = self.vectors, self.vectors, self.labels, self.labels
        self.levels = []
        size = LEAF_ROWS
        while not self.levels or len(low) > FANOUT:
            at = np.arange(0, len(low), size)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((low, high, first, last))
            size = FANOUT


class Queries:
    """A block of queries: vectors, labels, own ids, score windows, and the best k rows of each so far."""

    def __init__(self, keys, vectors, labels, ids, low, high, k: int, same_label: bool):
        import numpy as np

        self.keys, self.labels, self.ids, self.low, self.high, self.same_label = keys, labels, ids, low, high, same_label
        self.vectors, self.signed = vectors, np.concatenate([np.maximum(vectors, 0), np.minimum(vectors, 0)], axis=1)
        self.scores = np.full((len(keys), k), NOTHING, dtype=np.int64)
        self.found, self.rows = np.zeros_like(self.scores), np.zeros_like(self.scores)

    def reach(self, some, low, high, first, last):
        """The best score each box can give to some of the queries; `NOTHING` where labels or window rule it out."""
        import numpy as np

        width = min(self.vectors.shape[1], low.shape[1])
        signed = self.signed[some].reshape(len(some), 2, -1)[:, :, :width].reshape(len(some), -1)
        low, high = low[:, :width], high[:, :width]
        most, least = products(signed, np.concatenate([high, low], axis=1)), products(signed, np.concatenate([low, high], axis=1))
        label = self.labels[some][:, None]
        admits = (first <= label) & (label <= last) if self.same_label else (first != label) | (last != label)
        admits &= (most >= self.low[some][:, None]) & (least <= self.high[some][:, None])
        return np.where(admits, np.minimum(most, self.high[some][:, None]), NOTHING)

    def look(self, some, tree: Tree, own: slice) -> None:
        """Scores the rows of a leaf for some of the queries. Ties go to the smaller id."""
        import numpy as np

        scores = products(self.vectors[some], tree.vectors[own])
        same = tree.labels[own] == self.labels[some][:, None]
        fits = (same if self.same_label else ~same) & (tree.ids[own] != self.ids[some][:, None])
        fits &= (scores >= self.low[some][:, None]) & (scores <= self.high[some][:, None]) & (scores >= self.scores[some, -1:])
        hit = fits.any(axis=1)
        at, fits, k = some[hit], fits[hit], self.scores.shape[1]
        if not len(at):
            return
        shape = fits.shape
        scores = np.concatenate([self.scores[at], np.where(fits, scores[hit], NOTHING)], axis=1)
        found = np.concatenate([self.found[at], np.broadcast_to(tree.ids[own], shape)], axis=1)
        rows = np.concatenate([self.rows[at], np.broadcast_to(tree.rows[own], shape)], axis=1)
        best = np.lexsort((rows, found, ~scores), axis=1)[:, :k]
        self.scores[at], self.found[at], self.rows[at] = (np.take_along_axis(x, best, axis=1) for x in (scores, found, rows))


def best_first(tree: Tree, queries: Queries) -> None:
    """Fills in the best rows of a tree for a block of queries."""
    import numpy as np

    queue, number = [], count()

    def push(some, level: int, own: slice) -> None:
        reach = queries.reach(some, *(x[own] for x in tree.levels[level]))
        for box, best in enumerate(reach.max(axis=0), start=own.start):
            if best > NOTHING:
                able = reach[:, box - own.start] > NOTHING
                heapq.heappush(queue, (-int(best), next(number), level, box, some[able], reach[able, box - own.start]))

    push(np.arange(len(queries.keys)), len(tree.levels) - 1, slice(0, len(tree.levels[-1][0])))
    while queue:
        best, _, level, box, some, reach = heapq.heappop(queue)
        kth = queries.scores[:, -1]
        if -best < kth.min():
            return
        some = some[reach >= kth[some]]
        if len(some) and level:
            push(some, level - 1, slice(box * FANOUT, min((box + 1) * FANOUT, len(tree.levels[level - 1][0]))))
        elif len(some):
            queries.look(some, tree, slice(box * LEAF_ROWS, min((box + 1) * LEAF_ROWS, len(tree.ids))))


# --- parts ---------------------------------------------------------------------
def tile_borders(labels, vectors, tiles: int) -> tuple[list[int], list]:
    """(coordinates, nested borders): slabs by label, each cut by one coordinate, each of these by another."""
    import numpy as np

    chosen = widest(vectors, COORDINATES)
    slabs = max(1, round(min(tiles, MOST_TILES) ** (1 / (1 + len(chosen)))))

    def cut(index, keys: list):
        values = np.sort(keys[0][index])
        borders = np.unique(values[[len(values) * s // slabs for s in range(1, slabs)]]) if len(values) else values[:0]
        place = np.searchsorted(borders, keys[0][index], side="right")
        return borders, [cut(index[place == s], keys[1:]) for s in range(len(borders) + 1)] if len(keys) > 1 else []

    return chosen, cut(np.arange(len(labels)), [labels, *(vectors[:, c] for c in chosen)])


def tile_numbers(keys: list, borders, start: int = 0):
    """(tile of each row, number after the last tile) for nested borders."""
    import numpy as np

    place = np.searchsorted(borders[0], keys[0], side="right")
    if not borders[1]:
        return start + place, start + len(borders[0]) + 1
    out = np.zeros(len(place), dtype=np.int64)
    for slab, inner in enumerate(borders[1]):
        own = place == slab
        out[own], start = tile_numbers([k[own] for k in keys[1:]], inner, start)
    return out, start


def dealt_rows(rows: DataFrame) -> DataFrame:
    """Stored `rows` with `row`, a number of their own, and the `part` of the forest they belong to."""
    rows = stored(rows, "rows")
    tiles = -(-rows.count() // PART_ROWS)
    sample = rows.select("label", "embedding").orderBy(F.xxhash64("vec_id", "label"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    import numpy as np

    chosen, borders = tile_borders(np.asarray(sample.column("label")), matrix(sample.column("embedding")), tiles)
    schema = rows.schema

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        for batch in batches:
            vectors = matrix(batch.column("embedding"))
            columns = [vectors[:, c] if c < vectors.shape[1] else np.zeros(len(vectors)) for c in chosen]
            tile, _ = tile_numbers([np.asarray(batch.column("label")), *columns], borders)
            own = [pa.array(np.arange(first, first + batch.num_rows)), pa.array(tile)]
            first += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*schema.names, "row", "tile"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    numbered = stored(rows.mapInArrow(number, f"{fields}, row LONG, tile LONG"), "tiled")
    sizes = numbered.groupBy("tile").agg(F.ceil(F.count("*") / PART_ROWS).alias("splits"))  # one row per tile: MOST_TILES and a few
    split = F.pmod(F.xxhash64("row"), F.col("splits"))
    return numbered.join(F.broadcast(sizes), "tile").withColumn("part", F.struct("tile", split)).drop("tile", "splits")


def query_blocks(folder: str, labels: list[int] | None) -> Iterator[pa.RecordBatch]:
    """Stored queries in blocks, as executors read them; of one label each where `labels` says which are wanted."""
    from pyarrow import dataset

    files, path = file_system(folder)
    stored_queries = dataset.dataset(path, filesystem=files, format="parquet")
    for wanted in [None] if labels is None else labels:
        condition = None if wanted is None else dataset.field("label") == wanted
        for batch in stored_queries.to_batches(filter=condition, batch_size=BLOCK_QUERIES, batch_readahead=1, fragment_readahead=1, use_threads=False):
            for at in range(0, batch.num_rows, BLOCK_QUERIES):
                yield batch.slice(at, BLOCK_QUERIES)


def search(rows: DataFrame, queries: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(query, score, vec_id, row, rank): the best k rows of every query, out of all parts.

    `queries` has query, vec_id, label, embedding and the score window low to
    high. They are written to the shared folder, which every task reads.
    """
    folder = f"{run_folder(rows.sparkSession, 'queries')}/table"
    names = ["query", "vec_id", "label", "embedding", "low", "high"]
    queries.select(*names).sortWithinPartitions("label").write.option("compression", "zstd").parquet(folder)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = pa.Table.from_batches(list(batches))
        labels, ids, row = (np.asarray(table.column(c)) for c in ("label", "vec_id", "row"))
        tree = Tree(matrix(table.column("embedding")), labels, ids, row)
        for block in query_blocks(folder, np.unique(labels).tolist() if same_label else None):
            if not block.num_rows:
                continue
            plain = {c: np.asarray(block.column(c)) for c in names if c != "embedding"}
            wanted = Queries(plain["query"], matrix(block.column("embedding")), plain["label"], plain["vec_id"], plain["low"], plain["high"], k, same_label)
            best_first(tree, wanted)
            there = wanted.scores > NOTHING
            out = [np.repeat(wanted.keys, k).reshape(there.shape)[there], wanted.scores[there], wanted.found[there], wanted.rows[there]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=["query", "score", "vec_id", "row"])

    found = rows.select("part", "vec_id", "label", "embedding", "row").groupBy("part").applyInArrow(find, FOUND)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchor_every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose id is a multiple of `anchor_every`. An anchor's
    positives are the rows of its label with the highest scores; each positive
    gives the best rows of other labels whose score is 50 to 95 % of its own, so
    a positive with a negative score has none. Ties go to the smaller id.

    Rows without an id, a label or a vector of finite numbers take no part. Of
    vectors of different lengths the shorter one counts as filled up with 0.
    Repeated rows count one by one, but rows of one id are no match of each
    other. Other columns are not read. An empty table gives no row.
    """
    rows = stored(dealt_rows(mining_rows(df)), "forest")
    anchors = rows.where(F.col("vec_id") % anchor_every == 0)
    wide = {"low": F.lit(-MOST), "high": F.lit(MOST)}
    near = stored(search(rows, anchors.withColumn("query", F.col("row")).withColumns(wide), positives, True), "positives")

    score = F.col("positive_score")
    low, high = score - F.expr("positive_score div 2"), score - F.expr("positive_score div 20") - (score % 20 > 0).cast("long")
    named = near.select(F.col("query").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    number = F.monotonically_increasing_id().alias("query")
    own = anchors.select(F.col("row").alias("anchor"), "vec_id", "label", "embedding")
    windows = named.where("positive_score >= 0").join(own, "anchor").withColumns({"low": low, "high": high}).where("low <= high")
    windows = stored(windows.select(number, "vec_id", "label", "embedding", "low", "high", "positive_id", "positive_score"), "windows")
    hard = search(rows, windows, negatives, False).select("query", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    mined = windows.select("query", F.col("vec_id").alias("anchor_id"), "positive_id", "positive_score").join(hard, "query")
    return mined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
