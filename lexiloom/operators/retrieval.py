"""Chunks of a corpus and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.chunks import split_text
from lexiloom.sources.shared import batches_of, keep_for_tasks

# Queries compared at a time, and vectors they are compared with at a time: a block of distances takes 8 MB.
QUERY_BLOCK, BLOCK_VECTORS = 512, 2048
# Vectors a task holds while it goes through the queries (with 1536 dimensions some 100 MB), and queries whose lists it keeps until its end.
PART_VECTORS, HELD_QUERIES = 8192, 65_536
# Pairs whose distance is computed exactly at a time.
PAIRS = 65_536


# --- chunks ------------------------------------------------------------------
def chunk_corpus(
    docs: DataFrame, name: str = "file_name", text: str = "text", size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    """Documents -> chunks (name, chunk_idx, chunk_size, text), split by the separators from coarse to fine.

    Documents are independent, so this is a map over the scan's partitions: no
    shuffle, and the chunks of all files come out as one table.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chunks = [split_text(t or "", size, overlap) for t in batch[text]]
            counts = [len(c) for c in chunks]
            if not any(counts):
                continue
            yield pd.DataFrame(
                {
                    name: batch[name].repeat(counts).to_numpy(),
                    "chunk_idx": np.concatenate([np.arange(n, dtype="int32") for n in counts]),
                    "chunk_size": np.full(sum(counts), size, dtype="int32"),
                    "text": [chunk for of_doc in chunks for chunk in of_doc],
                }
            )

    kind = docs.schema[name].dataType.simpleString()
    return docs.select(name, text).mapInPandas(cut, f"{name} {kind}, chunk_idx int, chunk_size int, text string")


def chunk_windows(
    docs: DataFrame, name: str = "file_name", text: str = "text", size: int = fixed.CHUNK_SIZE, overlap: int = fixed.CHUNK_OVERLAP
) -> DataFrame:
    """Fixed windows of `size` characters, each starting `size - overlap` after the last; built-in functions only."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - F.lit(overlap) - 1, F.lit(0)), F.lit(step))
    return (
        docs.filter(F.length(text) > 0)
        .select(name, text, F.posexplode(starts).alias("chunk_idx", "_start"))
        .select(
            name,
            "chunk_idx",
            F.col("_start").alias("start"),
            F.substring(F.col(text), F.col("_start") + 1, F.lit(size)).alias("text"),
        )
    )


def union_chunks(parts: Sequence[DataFrame]) -> DataFrame:
    """Chunks of several roots as one table."""
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- nearest neighbours ------------------------------------------------------
def _matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    values = np.asarray(column.flatten(), dtype="float64")
    return values.reshape(len(column), -1)


def _candidates(queries: np.ndarray, vectors: np.ndarray, k: int, worst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs that hold all of each query's k nearest that are no farther than `worst`.

    Squared distances by one matrix product are fast, but near-equal ones blur
    in it. Pairs stay in if they can be among the nearest within that blur.
    """
    lengths = (queries**2).sum(axis=1)[:, None], (vectors**2).sum(axis=1)[None, :]
    blur = 8 * (queries.shape[1] + 4) * np.finfo("float64").eps * (lengths[0] + lengths[1])
    near = lengths[0] + lengths[1] - 2 * (queries @ vectors.T)
    bound = np.partition(near + blur, k - 1, axis=1)[:, k - 1] if k <= len(vectors) else np.full(len(queries), np.inf)
    # Distances that aren't finite can't be told apart here: all such pairs stay in.
    return np.nonzero(~(near - blur > np.minimum(bound, worst)[:, None]))


class _Nearest:
    """The k nearest vectors so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.distances, self.ids, self.held = np.full((n, k), np.inf), None, np.zeros((n, k), dtype=bool)

    def look(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        k = self.distances.shape[1]
        if self.ids is None:
            self.ids = np.full(self.distances.shape, ids[0], dtype=ids.dtype)
        elif ids.dtype.itemsize > self.ids.dtype.itemsize:
            self.ids = self.ids.astype(ids.dtype)
        worst = np.where(self.held[:, -1], self.distances[:, -1], np.inf)
        asking, at = _candidates(queries, vectors, k, worst)
        distances = np.concatenate(
            [np.zeros(0), *(((queries[asking[i : i + PAIRS]] - vectors[at[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(at), PAIRS))]
        )
        query, place = np.nonzero(self.held)
        query, place, found = (np.concatenate(x) for x in ((query, asking), (self.distances[query, place], distances), (self.ids[query, place], ids[at])))
        order = np.lexsort((found, place, query))
        query, place, found = query[order], place[order], found[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        best = rank < k
        query, rank = query[best], rank[best]
        self.held[:] = False
        self.held[query, rank], self.distances[query, rank], self.ids[query, rank] = True, place[best], found[best]

    def rows(self, asked: pa.RecordBatch, id_type: pa.DataType) -> pa.RecordBatch:
        """Rows for the block's queries, of which `asked` has the numbers and ids."""
        query, place = np.nonzero(self.held)
        ids = pa.array([] if self.ids is None else self.ids[query, place].tolist(), id_type)
        columns = [*(c.take(pa.array(query)) for c in asked.columns), ids, pa.array(self.distances[query, place], pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=["query", "asking", "found", "distance"])


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as numbers or as fixed-width texts, both of which sort."""
    ids = column.to_numpy(zero_copy_only=False)
    return ids.astype(str) if ids.dtype == object else ids


def _parts(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together to tables of at least `rows` rows, but for the last."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def retrieve_topk(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = 5,
    id_name: str = "vec_id",
    query_name: str = "query_id",
    vector: str = "embedding",
    block: int = QUERY_BLOCK,
    held_queries: int = HELD_QUERIES,
) -> DataFrame:
    """The k nearest corpus vectors of every query by squared Euclidean distance, with `rank` from 1.

    The corpus stays where it is, and one job answers all queries, however many
    there are: they are kept as a table in the shared folder, from which every
    task reads them in blocks, for one part of its vectors after the other.
    A task keeps its k best for up to `held_queries` queries until its end and
    hands on those of further queries part by part, so its memory is bounded by
    settings alone. Lists are merged by rank, first where they arise. NULL
    vectors are nobody's neighbour and find none; a repeated query is answered
    as often as it stands there.
    """
    present = F.col(vector).isNotNull()
    asked = queries.filter(present).select(
        F.monotonically_increasing_id().alias("query"), F.col(query_name).alias("asking"), F.col(vector).cast("array<double>").alias("asked")
    )
    folder = keep_for_tasks(asked, "questions")
    vectors = corpus.filter(present).select(F.col(id_name).alias("found"), F.col(vector).cast("array<double>").alias("vector"))
    id_type = corpus.schema[id_name].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[pa.RecordBatch, _Nearest]] = {}
        kind = pa.int64()
        for part in _parts(batches, PART_VECTORS):
            kind = part.schema.field("found").type
            ids, there = _ids(part.column("found").combine_chunks()), _matrix(part.column("vector").combine_chunks())
            for number, some in enumerate(batches_of(folder, block)):
                names, wanted = some.select(["query", "asking"]), _matrix(some.column("asked"))
                nearest = kept[number][1] if number in kept else _Nearest(len(wanted), k)
                for at in range(0, len(ids), BLOCK_VECTORS):
                    nearest.look(wanted, ids[at : at + BLOCK_VECTORS], there[at : at + BLOCK_VECTORS])
                if (number + 1) * block <= held_queries:
                    kept[number] = names, nearest
                else:
                    yield nearest.rows(names, kind)
        for names, nearest in kept.values():
            yield nearest.rows(names, kind)

    query_type = asked.schema["asking"].dataType.simpleString()
    found = vectors.mapInArrow(search, f"query long, asking {query_type}, found {id_type}, distance double")
    order = Window.partitionBy("query").orderBy("distance", "found")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("asking").alias(query_name), F.col("found").alias(id_name), "distance", "rank")


def split_by_grade(pairs: DataFrame, questions: DataFrame, question: str = "query_id") -> tuple[DataFrame, DataFrame]:
    """(relevant pairs, questions without any): the first go on to an answer, the second to the no-answer path."""
    relevant = pairs.filter(F.col("grade") == "yes")
    answered = relevant.select(question).distinct()
    return relevant, questions.join(answered, question, "left_anti")
