"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (one to four
characters, blended) present in both, divided by the root of the product of
their numbers. A bounded sample of labelled texts is mapped onto a set of
landmark texts (Nystroem), and one kernel ridge regression per language is
solved there. Landmarks and coefficients fold into one matrix with a column per
language, so scoring a batch is one matrix product of its presence matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows learnt from, per language on average, and landmarks among them, per language at most.
SAMPLE_PER_LANGUAGE = 600
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 1e-3
LONGEST_GRAM = 4
BUCKET_BITS = 15
#: How many texts and characters are scored at once; longer texts are gone through in parts.
BATCH_TEXTS, BATCH_CHARS = 64, 1 << 20
#: Texts are drawn by their hash modulo this number.
DRAWN_OF = 1 << 40
SHARPNESS = 4.0
UNKNOWN = "und"
MIX = 0x9E3779B97F4A7C15


def has_letter(text: str) -> bool:
    """Whether a text holds a letter. Fractions, circled numbers and the like are none; combining vowels come with letters."""
    return any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    """`weights` has a row per n-gram bucket and a column per language."""

    languages: tuple[str, ...]
    weights: object


def presence(texts: list[str]):
    """A row per text and a column per n-gram bucket: 1 where the text has an n-gram of that bucket."""
    import numpy as np

    gap = np.zeros(LONGEST_GRAM - 1, dtype=np.uint64)
    found = np.zeros((len(texts), 1 << BUCKET_BITS), dtype=np.float32)
    flat = found.reshape(-1)
    pieces, rows = [], []

    def flush() -> None:
        if not pieces:
            return
        codes = np.concatenate([*pieces, gap])
        row = np.repeat(np.array(rows, dtype=np.int64), [len(p) for p in pieces]) << BUCKET_BITS
        key = np.zeros(len(codes), dtype=np.uint64)
        for n in range(1, LONGEST_GRAM + 1):
            # the n-gram that starts at each place, as one number of n characters, then scattered over the buckets
            key = (key[:-1] << np.uint64(16)) + (codes[n - 1 :] & np.uint64(0xFFFF)) + (codes[n - 1 :] >> np.uint64(16)) * np.uint64(0x1F123BB5) if n > 1 else codes.copy()
            bucket = ((key + np.uint64(n)) * np.uint64(MIX)) >> np.uint64(64 - BUCKET_BITS)
            flat[row + bucket[: len(row)].astype(np.int64)] = 1.0
        pieces.clear()
        rows.clear()

    held = 0
    for number, text in enumerate(texts):
        lowered = text.lower()
        for at in range(0, max(1, len(lowered)), BATCH_CHARS):
            part = lowered[max(0, at - LONGEST_GRAM + 1) : at + BATCH_CHARS]
            codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
            pieces.append(np.concatenate([gap, codes]))
            rows.append(number)
            held += len(part)
            if held >= BATCH_CHARS:
                flush()
                held = 0
    flush()
    return found


def fit(rows: list[tuple[str, bytes]], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Learn from (language, packed presence bits) rows; the first `landmarks` of each language are its landmarks."""
    import numpy as np

    languages = tuple(sorted({language for language, _ in rows}))
    if not rows:
        return Model((), np.zeros((1 << BUCKET_BITS, 0), dtype=np.float32))

    def matrix(chosen: list[tuple[str, bytes]]):
        bits = np.stack([np.unpackbits(np.frombuffer(b, dtype=np.uint8)) for _, b in chosen]).astype(np.float32)
        return bits / np.sqrt(np.maximum(1.0, bits.sum(axis=1, keepdims=True)))

    by_language = {x: [r for r in rows if r[0] == x] for x in languages}
    marks = matrix([r for own in by_language.values() for r in own[:landmarks]])
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-8 * values[-1]
    mapping = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([(matrix(rows[at : at + 128]) @ marks.T).astype(np.float64) @ mapping for at in range(0, len(rows), 128)])
    targets = np.array([[1.0 if language == x else -1.0 for x in languages] for language, _ in rows])
    weight = np.array([len(rows) / len(by_language[language]) / len(languages) for language, _ in rows])[:, None]
    solved = np.linalg.solve(features.T @ (features * weight) + ridge * len(rows) * np.eye(features.shape[1]), features.T @ (targets * weight))
    return Model(languages, (marks.T @ (mapping @ solved).astype(np.float32)).astype(np.float32))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The best language and its share of the languages' softmax; `und` with score 0 for null and for texts without a letter."""
    import numpy as np

    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    known = [i for i, text in enumerate(texts) if text is not None and has_letter(text)] if model.languages else []
    for at in range(0, len(known), BATCH_TEXTS):
        own = known[at : at + BATCH_TEXTS]
        found = presence([texts[i] for i in own])
        margins = (found @ model.weights) / np.sqrt(np.maximum(1.0, found.sum(axis=1, keepdims=True)))
        share = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)).astype(np.float64))
        share /= share.sum(axis=1, keepdims=True)
        best = margins.argmax(axis=1)
        for i, k, p in zip(own, best.tolist(), share.max(axis=1).tolist(), strict=True):
            names[i], scores[i] = model.languages[k], min(1.0, p)
    return names, scores


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on a sample of `labelled` (text, lang) of about `per_language` different texts for each language.

    A hash of the text decides what is drawn, and in which order: the sample is
    as good as random, and the same whatever the partitions or the cluster.
    Rows with a null text or language, or a text without a letter, teach
    nothing, and a text that occurs several times in a language teaches once.
    One count per language and 4 KB per sampled row go to the driver, whatever
    the texts' length.
    """
    drawn = labelled.where("lang IS NOT NULL AND text IS NOT NULL").withColumn("drawn", F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in drawn.groupBy("lang").agg(F.approx_count_distinct("drawn").alias("n")).collect()}
    if not counts:
        return fit([])
    shares = F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, per_language / n))))

    def packed(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            kept = [x for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "drawn", "text")), strict=True) if has_letter(x[2])]
            for at in range(0, len(kept), BATCH_TEXTS):
                own = kept[at : at + BATCH_TEXTS]
                bits = np.packbits(presence([t for *_, t in own]).astype(bool), axis=1)
                yield pa.RecordBatch.from_pydict({"lang": [x for x, *_ in own], "drawn": [d for _, d, _ in own], "bits": [row.tobytes() for row in bits]})

    in_sample = F.pmod("drawn", F.lit(DRAWN_OF)) < F.element_at(shares, F.col("lang")) * DRAWN_OF
    rows = drawn.where(in_sample).select("lang", "drawn", "text").mapInArrow(packed, "lang STRING, drawn LONG, bits BINARY")
    sample = rows.groupBy("lang", "drawn").agg(F.min("bits").alias("bits")).collect()
    return fit([(r["lang"], bytes(r["bits"])) for r in sorted(sample, key=lambda r: (r["lang"], r["drawn"] * MIX % (1 << 64)))])


def held_out(docs: DataFrame):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, model: Model, added: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`docs` with the predicted language and its score, from the whole text alone, under the names `added`.

    Columns that have these names already are replaced.

    Null texts and texts without a letter get `und` and 0, and so does every
    row if nothing was learnt; all other columns stay as they are; equal rows
    get equal results; an empty table gives no row.
    """
    docs = docs.drop(*added)
    schema = T.StructType([*docs.schema.fields, T.StructField(added[0], T.StringType()), T.StructField(added[1], T.DoubleType())])

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 4 * BATCH_TEXTS):
                part = batch.slice(at, 4 * BATCH_TEXTS)
                names, scores = predict(model, part.column("text").to_pylist())
                columns = [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])

    return docs.mapInArrow(score, schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the rows of `docs` that are not held out and predict all: (doc_id, held_out, lang_pred, score)."""
    model = train(docs.where(~held_out(docs) & F.col("doc_id").isNotNull()).select("lang", "text"))
    return labelled(docs.select("doc_id", "text"), model).select("doc_id", held_out(docs).alias("held_out"), "lang_pred", "score")
