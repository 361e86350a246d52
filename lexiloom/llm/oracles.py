"""SQL counterparts of the registered queries that SQL can express."""

from __future__ import annotations

from . import decontaminate, line_templates

ORACLES: dict[str, str] = {}


def _pii_kind(rank: int, pattern: str, words: str, score: int, valid: str) -> str:
    """Spans of one kind from the plain pattern: matches and the text between them give the places."""
    return f"""
    SELECT doc_id, {rank} AS rank, kind, start, start + length(m) AS finish, score
    FROM (
      SELECT *, CASE WHEN regexp_matches(lower(before), '(?:^|[^a-z])(?:{words})(?:[^a-z]|$)') THEN {score + 20} ELSE {score} END AS score
      FROM (
        SELECT doc_id, kind, m, right(gaps[i], 48) AS before, coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)
          + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (
          SELECT doc_id, kind, ms, gaps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i
          FROM (SELECT doc_id, '{["email", "ip", "card", "phone", "iban", "ssn"][rank]}' AS kind,
                  regexp_extract_all(t, '{pattern}', 0) AS ms, string_split_regex(t, '{pattern}') AS gaps FROM docs)
          WHERE len(ms) > 0)))
    WHERE {valid}"""


DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"""length({DIGITS}) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda p:
  CASE WHEN p % 2 = 1 THEN cast(substr(reverse({DIGITS}), p, 1) AS INT)
       WHEN cast(substr(reverse({DIGITS}), p, 1) AS INT) > 4 THEN 2 * cast(substr(reverse({DIGITS}), p, 1) AS INT) - 9
       ELSE 2 * cast(substr(reverse({DIGITS}), p, 1) AS INT) END)) % 10 = 0"""
TURNED = "(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4))"
MOD97 = f"""list_reduce(list_prepend(0, list_transform(range(1, length({TURNED}) + 1), lambda p: ascii(substr({TURNED}, p, 1)))),
  lambda a, c: CASE WHEN c < 58 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END) = 1"""

ORACLES["op1_pii"] = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS (
{_pii_kind(0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "mail|email|contact|write", 80, "true")}
UNION ALL {_pii_kind(1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "ip|address|server|host", 60, "list_bool_and(list_transform(string_split(m, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND cast('0' || right(ltrim(p, '0'), 3) AS INT) <= 255))")}
UNION ALL {_pii_kind(2, r"[0-9](?:[\x20-]?[0-9])+", "card|visa|credit|payment", 70, LUHN)}
UNION ALL {_pii_kind(3, r"\+[0-9][\x20().0-9-]+[0-9]", "phone|tel|call|mobile|fax", 60, f"length({DIGITS}) BETWEEN 10 AND 15")}
UNION ALL {_pii_kind(4, r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}", "iban|account|bank|konto|compte|cuenta", 70, f"score >= 60 AND NOT regexp_matches(before, '[0-9A-Za-z]$') AND {MOD97}")}
UNION ALL {_pii_kind(5, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn|social|security", 45, "score >= 60 AND NOT regexp_matches(before, '[0-9A-Za-z-]$') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')")}
),
joined AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(["email", "ip", "card", "phone", "iban", "ssn"]))},
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rank) FILTER (rank < 4) AS base,
    string_agg(kind || ':' || start || ':' || finish, ',' ORDER BY start, rank) AS spans,
    string_agg(cast(score AS VARCHAR), ',' ORDER BY start, rank) AS scores
  FROM spans GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ["email", "ip", "card", "phone", "iban", "ssn"])},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM docs LEFT JOIN joined USING (doc_id)
"""

L = line_templates
BLANKS_SQL = " || ".join(f"chr({ord(c)})" for c in L.BLANKS)
ORACLES["op7_line_dedup"] = f"""
WITH source AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
parts AS (
  SELECT rid, doc_id, md5(text) AS th, unnest(string_split(text, chr(10))) AS raw, unnest(range(0, len(string_split(text, chr(10))))) AS pos
  FROM source WHERE text IS NOT NULL),
every AS (
  SELECT rid, doc_id, th, pos, translate(raw, {BLANKS_SQL}, repeat(' ', {len(L.BLANKS)})) AS plain, len(string_split(plain, ' ')) AS n FROM parts),
masked AS (
  SELECT *, CASE WHEN n < {L.LEAST_WORDS} THEN regexp_replace(plain, '[0-9]+', '{L.VARIABLE}', 'g')
    ELSE array_to_string(list_transform(string_split(plain, ' '), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN '{L.VARIABLE}' ELSE w END), ' ') END AS line
  FROM every WHERE n >= {L.LEAST_WORDS} OR regexp_matches(plain, '\\p{{L}}')),
lines AS (SELECT *, array_to_string(string_split(line, ' ')[1:{L.LEAD}], ' ') AS lead FROM masked),
leaves AS (SELECT n, lead FROM lines GROUP BY n, lead HAVING count(*) >= {L.LEAST_DOCUMENTS}),
candidates AS (
  SELECT n, lead, line, th, min(doc_id) AS first FROM lines JOIN leaves USING (n, lead) GROUP BY n, lead, line, th),
places AS (
  SELECT n, lead, line, count(*) AS c, unnest(string_split(line, ' ')) AS word, unnest(range(0, n)) AS place
  FROM candidates GROUP BY n, lead, line),
constants AS (SELECT n, lead, place, word FROM places GROUP BY ALL HAVING sum(c) >= {L.LEAST_DOCUMENTS}),
templates AS (
  SELECT n, lead, line, list((place, word) ORDER BY place) AS template
  FROM places JOIN constants USING (n, lead, place, word) GROUP BY n, lead, line HAVING n < {L.LEAST_WORDS} OR count(*) FILTER (word <> '{L.VARIABLE}') * 100 >= n * {L.LEAST_CONSTANT}),
recurring AS (
  SELECT n, lead, template, min(first) AS keeper FROM candidates JOIN templates USING (n, lead, line)
  GROUP BY n, lead, template HAVING count(DISTINCT th) >= {L.LEAST_DOCUMENTS}),
dropped AS (
  SELECT rid, list(pos) AS gone FROM lines JOIN templates USING (n, lead, line) JOIN recurring USING (n, lead, template)
  WHERE doc_id IS DISTINCT FROM keeper GROUP BY rid)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0) AS n_lines, coalesce(len(gone), 0) AS n_dropped,
  CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text
FROM source LEFT JOIN dropped USING (rid)
"""

D = decontaminate


def _item_words(table: str, key: str) -> str:
    """Per text the canonical words and their plain forms, by place."""
    return f"""
    SELECT rid, {key}, list_filter(list_zip(c, p), lambda z: z[1] <> '') AS words FROM (
      SELECT rid, {key},
        list_transform(list_transform(w, lambda x, i: trim(regexp_replace(lower(regexp_replace(
          CASE WHEN i > 1 AND regexp_matches(w[i - 1], '[^.!?:]$') THEN regexp_replace(x, '^\\p{{Lu}}[\\p{{L}}''-]*', '{D.NAME}') ELSE x END,
          '[0-9]+(?:[.,:/][0-9]+)*', '{D.NUMBER}', 'g')), '[^\\p{{L}}\\p{{N}}<>]+', '', 'g'))), lambda x:
          CASE WHEN x IN ({", ".join(f"'{u}'" for u in D.UNITS)}) THEN '{D.UNIT}' ELSE x END) AS c,
        list_transform(w, lambda x: regexp_replace(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}<>.,:/-]+', '', 'g'), '^[.,:/-]+|[.,:/-]+$', '', 'g')) AS p
      FROM (SELECT row_number() OVER () AS rid, {key}, string_split_regex(text, '[\\x20\\x09-\\x0D]') AS w FROM {table} WHERE text IS NOT NULL))"""


def _item_windows(words: str, key: str) -> str:
    return f"""
    SELECT rid, {key}, i AS pos, n_windows, list_transform(words[i:i + {D.WINDOW - 1}], lambda z: z[1]) AS win
    FROM (SELECT *, len(words) - {D.WINDOW - 1} AS n_windows, unnest(range(1, len(words) - {D.WINDOW - 2})) AS i FROM {words} WHERE len(words) >= {D.WINDOW})"""


ORACLES["op8_decontamination"] = f"""
WITH doc_words AS ({_item_words("(SELECT DISTINCT doc_id, text FROM documents)", "doc_id")}),
item_words AS ({_item_words("benchmark", "item_id")}),
items AS (SELECT * FROM ({_item_windows("item_words", "item_id")}) WHERE len(list_filter(win, lambda x: NOT contains(x, '<'))) >= {D.LEAST_PLAIN}),
hits AS (SELECT d.rid, d.doc_id, i.rid AS item_rid, i.item_id, d.pos - i.pos AS shift, i.pos AS item_pos, i.n_windows
  FROM ({_item_windows("doc_words", "doc_id")}) d JOIN items i USING (win)),
aligned AS (
  SELECT rid, doc_id, item_rid, item_id, shift, min(item_pos) AS a, max(item_pos) AS b, count(DISTINCT item_pos) AS n_matched, max(n_windows) AS n_windows
  FROM hits GROUP BY ALL HAVING count(DISTINCT item_pos) >= least({D.LEAST_WINDOWS}, max(n_windows))),
slots AS (
  SELECT *, list_filter(list_transform(range(a, b + {D.WINDOW}), lambda p: (i.words[p], d.words[p + shift])),
      lambda s: s[1][1] = s[2][1] AND contains(s[1][1], '<')) AS s
  FROM aligned JOIN (SELECT rid AS item_rid, words FROM item_words) i USING (item_rid) JOIN (SELECT rid, words FROM doc_words) d USING (rid)),
checked AS (
  SELECT *, list_bool_and(list_transform(s, lambda x: x[1][2] = x[2][2])) AS own FROM slots
  WHERE len(list_distinct(list_transform(s, lambda x: x[1]))) = len(list_distinct(list_transform(s, lambda x: (x[1], x[2][2])))))
SELECT doc_id, item_id, max(n_matched) AS n_matched, cast(max(n_windows) AS BIGINT) AS n_windows, bool_or(coalesce(own, true)) AS verbatim
FROM checked GROUP BY rid, doc_id, item_id
"""

ORACLES["op2_near_duplicates"] = """
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) END AS s FROM words),
shingles AS (SELECT rid, doc_id, len(s) AS n, unnest(s) AS x FROM sets),
classes AS (SELECT min(doc_id) AS rep, s, max(len(s)) AS n FROM (SELECT doc_id, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s),
elements AS (SELECT rep, n, unnest(s) AS x FROM classes),
common AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM elements a JOIN elements b USING (x)
  WHERE a.rep < b.rep AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY a.rep, b.rep),
links AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reached AS (SELECT a AS node, a AS other FROM ways UNION SELECT r.node, w.b FROM reached r JOIN ways w ON r.other = w.a),
roots AS (SELECT node, min(other) AS root FROM reached GROUP BY node)
SELECT t.doc_id, cast(len(t.s) AS BIGINT) AS n_shingles, coalesce(root, rep, t.doc_id) AS component_id, t.doc_id = coalesce(root, rep, t.doc_id) AS kept
FROM sets t LEFT JOIN classes c ON list_sort(t.s) = c.s LEFT JOIN roots ON roots.node = c.rep
"""

ORACLES["op9_near_vectors"] = """
WITH RECURSIVE units AS (
  SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS u FROM (
    SELECT vec_id, label, cast(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM units a JOIN units b ON a.label = b.label AND len(a.u) = len(b.u) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.u, b.u) >= 0.98),
reached AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
roots AS (SELECT node, min(other) AS root FROM reached GROUP BY node),
counts AS (SELECT a AS node, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(vec_id = coalesce(root, vec_id), true) AS kept
FROM embeddings LEFT JOIN roots ON roots.node = vec_id LEFT JOIN counts ON counts.node = vec_id
"""

ORACLES["op5_repeats"] = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT rid, doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS k FROM (SELECT *, unnest(range(0, len(h) // 2 - 49)) AS i FROM docs) WHERE doc_id IS NOT NULL),
earliest AS (SELECT k, min(doc_id) AS d FROM strings GROUP BY k HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT rid, i FROM strings JOIN earliest USING (k) WHERE d < doc_id),
edges AS (SELECT rid, i, lag(i) OVER w AS p, lead(i) OVER w AS q FROM hit WINDOW w AS (PARTITION BY rid ORDER BY i)),
firsts AS (SELECT rid, i AS a, row_number() OVER (PARTITION BY rid ORDER BY i) AS n FROM edges WHERE p IS NULL OR i > p + 50),
lasts AS (SELECT rid, i + 50 AS b, row_number() OVER (PARTITION BY rid ORDER BY i) AS n FROM edges WHERE q IS NULL OR q > i + 50),
gaps AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY n) AS a, list(b ORDER BY n) AS b FROM firsts JOIN lasts USING (rid, n) GROUP BY rid)
SELECT doc_id, cast(len(h) // 2 AS BIGINT) AS n_bytes, cast(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN a IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(a) + 2), lambda j:
    substr(h, 2 * CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END + 1, 2 * (CASE WHEN j > len(a) THEN len(h) // 2 ELSE a[j] END - CASE WHEN j = 1 THEN 0 ELSE b[j - 1] END))), '') END)) AS kept_sha256
FROM docs LEFT JOIN gaps USING (rid)
"""

ORACLES["op12_hard_negatives"] = """
WITH valid AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * cast(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, cast(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM valid a JOIN valid b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (SELECT a, b, anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b) AS rank
  FROM positives p JOIN scored s USING (a) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, cast(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""

ORACLES["op13_source_divergence"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
terms AS (SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
groups AS (SELECT DISTINCT lang, source FROM docs),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000 * cast(coalesce(c.n, 0) + 2 AS HUGEINT)) // (coalesce(t.total, 0) + 2 * l.v) AS p,
    1 + (1000000000 * cast(k.n + 2 AS HUGEINT)) // (l.total + 2 * l.v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON l.lang = g.lang LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, cast(value AS BIGINT) AS value, cast(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
