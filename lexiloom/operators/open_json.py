"""JSON whose fields nobody announced: status messages with new fields, replies that aren't JSON at all.

A schema given beforehand drops what it doesn't name. Here each text becomes a
VARIANT, so every field keeps its value and its type, types may change from one
row to the next, and texts that can't be parsed stay as they are with a kind
that says so. Everything is built-in functions and mergeable aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of texts beside those of JSON values.
MISSING, BROKEN = "missing", "broken"


def json_kind(value: Column) -> Column:
    """object, array, string, number, boolean or null: what a VARIANT holds; NULL if there is none."""
    schema = F.schema_of_variant(value)
    return (
        F.when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "VOID", "null")
        .when(schema.isNotNull(), "number")
    )


def parse_open(df: DataFrame, text: str, into: str = "body", kind: str = "kind") -> DataFrame:
    """`df` with its JSON texts as a VARIANT and their kind, under the names `into` and `kind`.

    A NULL text is `missing`; one that is no JSON, is cut off, or names a field
    twice is `broken`. Both have a NULL body, and the text stays beside it.
    """
    body = F.try_parse_json(F.col(text))
    parsed = df.withColumn(into, body)
    return parsed.withColumn(kind, F.when(F.col(text).isNull(), MISSING).when(F.col(into).isNull(), BROKEN).otherwise(json_kind(F.col(into))))


def open_rejects(df: DataFrame, text: str, wanted: Sequence[str] = ("object",)) -> DataFrame:
    """Rows whose text isn't JSON of a `wanted` kind, with the text as it came and what it is instead."""
    return parse_open(df, text, "_body", "kind").where(~F.col("kind").isin(*wanted)).drop("_body")


def open_fields(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """(keys, field, kind, value, body): a row for every field of every text that is an object.

    `value` is a string's own text, the JSON text of anything else, and NULL for
    a JSON null; `body` is the field as a VARIANT. Texts of other kinds and
    objects without fields give no row.
    """
    spark = df.sparkSession
    objects = parse_open(df.select(*keys, text), text, "_body", "_kind").where("_kind = 'object'").drop(text, "_kind")
    fields = objects.lateralJoin(spark.tvf.variant_explode(F.col("_body").outer()))
    kind = json_kind(F.col("value"))
    plain = F.when(kind == "string", F.variant_get("value", "$", "string")).when(kind != "null", F.to_json("value"))
    return fields.select(*keys, F.col("key").alias("field"), kind.alias("kind"), plain.alias("value"), F.col("value").alias("body"))


def fold_open_fields(events: DataFrame, text: str, job: str = "job_id", seq: str = "seq") -> DataFrame:
    """(job, field, kind, value, seq, n_events): the newest value of every field a job's events ever had.

    A missing field keeps the older value and an explicit null overwrites it, as
    in `fold_job_status`, but no field has to be known. Of events with one
    sequence number the larger value counts. Partial results alone are shuffled,
    so a job with a third of the events is as light as any other.
    """
    fields = open_fields(events, text, job, seq)
    newest = F.max(F.struct(seq, "value", "kind"))
    folded = fields.groupBy(job, "field").agg(newest.alias("_newest"), F.count("*").alias("n_events"))
    return folded.select(job, "field", "_newest.kind", "_newest.value", f"_newest.{seq}", "n_events")


def profile_open_fields(df: DataFrame, text: str) -> DataFrame:
    """(field, n_rows, n_null, kinds, schema): which fields the texts have, how often, and of which types.

    `kinds` are the sorted kinds of a field; `schema` is the narrowest type that
    takes all its values (VARIANT where they have none in common).
    """
    profile = open_fields(df, text).groupBy("field").agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("kind") == "null").alias("n_null"),
        F.collect_set("kind").alias("kinds"),
        F.schema_of_variant_agg("body").alias("schema"),
    )
    return profile.withColumn("kinds", F.array_join(F.array_sort("kinds"), ","))
