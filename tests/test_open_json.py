"""Open JSON: what is kept of fields and replies nobody announced."""

from lexiloom.operators import open_json

TEXTS = [
    (1, 1, '{"status":"new","size":1,"by":{"name":"é \\"q\\"","n":[1,2.5]}}'),
    (1, 2, '{"status":"run","size":"2"}'),
    (1, 3, '{"status":null}'),
    (1, 4, '{"status":"cut off"'),
    (2, 1, "{}"),
    (2, 2, "[1,2]"),
    (2, 3, "3"),
    (2, 4, None),
    (2, 5, ""),
    (2, 6, '{"a":1,"a":2}'),
    (3, 1, '{"size":12345678901234567890123,"ok":true,"odd.name":"x"}'),
    (3, 1, '{"ok":false}'),
    (None, None, '{"ok":true}'),
]
SCHEMA = "job_id INT, seq INT, body STRING"


def events(spark, rows=TEXTS):
    return spark.createDataFrame(rows, SCHEMA)


def test_kinds(spark):
    got = {(r.job_id, r.seq): r.kind for r in open_json.parse_open(events(spark), "body", "v").drop("v").collect() if r.job_id == 2}
    assert got == {(2, 1): "object", (2, 2): "array", (2, 3): "number", (2, 4): "missing", (2, 5): "broken", (2, 6): "broken"}
    rejected = [(r.job_id, r.seq, r.body, r.kind) for r in open_json.open_rejects(events(spark), "body").collect()]
    assert sorted(rejected, key=lambda r: r[:2]) == [
        (1, 4, '{"status":"cut off"', "broken"), (2, 2, "[1,2]", "array"), (2, 3, "3", "number"), (2, 4, None, "missing"), (2, 5, "", "broken"), (2, 6, '{"a":1,"a":2}', "broken"),
    ]


def test_newest_value_of_unknown_fields(spark):
    got = {(r.job_id, r.field): (r.kind, r.value, r.seq, r.n_events) for r in open_json.fold_open_fields(events(spark), "body").collect()}
    assert got == {
        (1, "status"): ("null", None, 3, 3),
        (1, "size"): ("string", "2", 2, 2),
        (1, "by"): ("object", '{"n":[1,2.5],"name":"é \\"q\\""}', 1, 1),
        (3, "size"): ("number", "12345678901234567890123", 1, 1),
        (3, "ok"): ("boolean", "true", 1, 2),
        (3, "odd.name"): ("string", "x", 1, 1),
        (None, "ok"): ("boolean", "true", None, 1),
    }


def test_profile_tells_types(spark):
    got = {r.field: (r.n_rows, r.n_null, r.kinds, r.schema) for r in open_json.profile_open_fields(events(spark), "body").collect()}
    assert got["status"] == (3, 1, "null,string", "STRING")
    assert got["size"] == (3, 0, "number,string", "VARIANT")
    assert got["ok"] == (3, 0, "boolean", "BOOLEAN")
    assert got["by"][3].startswith("OBJECT<n: ARRAY<DECIMAL(") and got["by"][3].endswith(", name: STRING>")


def test_empty_table(spark):
    empty = events(spark, [])
    assert open_json.fold_open_fields(empty, "body").count() == 0
    assert open_json.profile_open_fields(empty, "body").count() == 0
    assert open_json.open_rejects(empty, "body").count() == 0
