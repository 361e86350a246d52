import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside or add
        *(T.StructField(name, T.StringType()) for name in ("rep", "line", "bucket", "score", "kept", "n_lines", "own_hash", "found_id", "piece_id", "text_hash")),
    ]
)


@pytest.fixture
def documents(spark):
    """A table of documents from (doc_id, text) or (doc_id, text, lang), with extra columns of clashing names."""

    def build(rows, partitions=3):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, None, None, *["x"] * 10) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS).repartition(partitions) if full else spark.createDataFrame([], DOCUMENTS)

    return build
