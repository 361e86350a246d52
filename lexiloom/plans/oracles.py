"""The registered queries as plain SQL over the same given tables.

The SQL is written on its own terms: joins, windows and recursion, not a
translation of the DataFrame plans. Only the fixed patterns are shared.
"""

from __future__ import annotations

import re

from lexiloom.functions import fixed_values as fixed
from lexiloom.functions.languages import NAME_TO_OCR, TRANSLATOR_NAMES, iso_rows

SPACE = fixed.SPACE


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {_q(f'^[{SPACE}]+|[{SPACE}]+' + chr(92) + 'z')}, '', 'g')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {_q(pattern)})"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR NOT {has(x, f'[^{SPACE}]')})"


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {_q(n)})" for n in needles) + ")"


def iso(ts: str) -> str:
    return (
        f"CASE WHEN epoch_us({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


NUMBER = f"({has('s', fixed.NUMBER)} OR {has('s', fixed.LONG_DIGITS)})"
ROMAN = f"(s <> '' AND {has('lower(s)', fixed.ROMAN)})"

# --- logical tables --------------------------------------------------------------
CTES = {
    "users": """SELECT c_custkey AS user_id, c_name AS username, 'u' || c_custkey || '@example.com' AS email,
        TIMESTAMP '2024-01-01 00:00:00' AS created_at, c_custkey % 7 <> 0 AS is_active, 5000::BIGINT AS credits,
        (c_nationkey % 3)::VARCHAR AS account_type FROM customer WHERE c_acctbal >= 0""",
    "tx": """SELECT event_id AS id, user_id, value::DECIMAL(10,2) AS amount,
        CASE WHEN event_type = 'purchase' THEN 'purchase' ELSE 'usage' END AS transaction_type, ts AS created_at,
        CASE WHEN event_type = 'purchase' THEN 'bank' END AS payment_method FROM events""",
    "tx_out": f"""SELECT id, user_id, amount::DOUBLE AS amount, transaction_type, {iso("created_at")} AS created_at,
        payment_method, created_at AS made FROM tx""",
    "history": """SELECT doc_id AS id, doc_id % 150 AS user_id, text AS input_text, '> ' || text AS output_text,
        lang AS source_language, CASE doc_id % 3 WHEN 0 THEN 'vi' WHEN 1 THEN 'en' ELSE 'ja' END AS target_language,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at FROM documents""",
    "history_changes": """SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' ELSE event_type END AS action,
        user_id + 150 * (event_id % 8) + CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS history_id, user_id, ts
        FROM events""",
    "user_changes": """SELECT event_id AS seq, user_id,
        CASE event_type WHEN 'error' THEN 'role' WHEN 'signup' THEN 'active' WHEN 'click' THEN 'add'
            WHEN 'view' THEN 'subtract' ELSE 'delete' END AS action,
        (CASE event_type WHEN 'error' THEN event_id % 4 WHEN 'signup' THEN event_id % 3
            ELSE floor(value)::BIGINT - 5 END)::VARCHAR AS value FROM events""",
    "verdicts": """SELECT c.*, CASE WHEN u.user_id IS NULL THEN 'no_such_user'
            WHEN action = 'role' AND value NOT IN ('0', '1', '2') THEN 'bad_role'
            WHEN action = 'active' AND value NOT IN ('0', '1') THEN 'bad_status'
            WHEN action IN ('add', 'subtract') AND value::BIGINT <= 0 THEN 'bad_amount' ELSE 'ok' END AS outcome
        FROM user_changes c LEFT JOIN users u USING (user_id)""",
    "segments": """SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text,
        (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS para_idx FROM documents""",
    "paras": """SELECT doc_id, unnest(list_transform(range(0, (len(l) + 1) // 2),
            lambda p: array_to_string(l[p * 2 + 1 : p * 2 + 2], chr(10)))) AS para,
        (generate_subscripts(range(0, (len(l) + 1) // 2), 1) - 1)::INTEGER AS para_idx
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""",
    "runs": """SELECT doc_id::VARCHAR AS doc, doc_id, para_idx,
        CASE WHEN para_idx % 10 = 9 THEN 'footer1.xml' WHEN doc_id % 5 = 0 AND para_idx = 0 THEN 'header1.xml'
            ELSE 'document.xml' END AS part, run_idx, 0 AS text_idx, w || CASE WHEN run_idx < n - 1 THEN ' ' ELSE '' END AS text
        FROM (SELECT doc_id, para_idx, len(ws) AS n, unnest(ws) AS w, (generate_subscripts(ws, 1) - 1)::INTEGER AS run_idx
              FROM (SELECT doc_id, para_idx, string_split(para, ' ') AS ws FROM paras))""",
    "kinds": f"""SELECT *, CASE WHEN {NUMBER} THEN 'number' WHEN {ROMAN} THEN 'roman' ELSE 'text' END AS kind
        FROM (SELECT *, {strip("text")} AS s FROM runs) WHERE s <> ''""",
    "assembled": f"""SELECT doc, doc_id, part, para_idx, source, length({strip("source")}) > {fixed.SHORT_TEXT} AS translate
        FROM (SELECT doc, doc_id, part, para_idx,
            coalesce(string_agg(text, '' ORDER BY run_idx) FILTER (kind = 'text'), '') AS source
            FROM kinds GROUP BY ALL)""",
    "targets": """SELECT *, CASE WHEN NOT translate OR doc_id % 7 = 0 THEN NULL
            WHEN para_idx % 3 = 0 THEN replace(source, ' ', '_') WHEN para_idx % 3 = 1 THEN replace(source, chr(10), ' ')
            ELSE 'first' || chr(10) || source || chr(10) || 'last' END AS target FROM assembled""",
    "para_texts": """SELECT doc, part, para_idx, string_agg(text, '' ORDER BY run_idx) AS text FROM runs
        WHERE part = 'document.xml' GROUP BY ALL""",
    "page_texts": """SELECT page_id, 'see ' || url || ' or mail p' || page_id || '@example.org now ' || html AS text FROM pages""",
    "requests": """SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'TRANSLATE|' || lang || '|vi|General|' || text || '|tail'
        WHEN 1 THEN 'ANALYZE|' || text WHEN 2 THEN 'TRANSCRIBE|audio_' || doc_id || '.mp3|'
        WHEN 3 THEN 'TRANSLATE_DOCX|in_' || doc_id || '.docx|out.docx|ja|m1|0.5|8' WHEN 4 THEN 'TRANSLATE|' || lang
        ELSE 'UNKNOWN|' || text END AS q FROM documents""",
    "frags": """SELECT id, pos, name, code, text FROM (
        SELECT conv_id * 1000000 + turn AS id, role, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS t FROM conversations) r,
        LATERAL (SELECT 0 AS pos, role AS name, 'en' AS code, t AS text WHERE id % 7 <> 0
                 UNION ALL SELECT 1, 'Unknown', 'und', 'x' WHERE id % 7 <> 0
                 UNION ALL SELECT 0, 'Error', 'err', 'Failed to parse analysis result' WHERE id % 7 = 0) f""",
    "outputs": """SELECT doc_id * 10000000 + para_idx AS id, text AS source,
        CASE WHEN (doc_id * 10000000 + para_idx) % 13 = 0 THEN 'I''m sorry, ' || text
            WHEN (doc_id * 10000000 + para_idx) % 11 = 0 THEN 'EMPTY'
            WHEN (doc_id * 10000000 + para_idx) % 7 = 0 THEN 'Translation: ' || text
            WHEN (doc_id * 10000000 + para_idx) % 5 = 0 THEN 'There is no text to translate'
            ELSE '> ' || text END AS output FROM segments""",
    "memory": """SELECT md5(text) AS key, text AS source, 'vi:' || text AS target,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(max(doc_id)) AS last_used
        FROM segments WHERE lang = 'fr' GROUP BY text""",
    "keyed": f"""SELECT *, CASE WHEN NOT {is_blank("text")} THEN md5(text) END AS key FROM segments""",
    "images": """SELECT DISTINCT l_orderkey AS image_id, (300 + l_orderkey % 400)::INTEGER AS width,
        (200 + l_orderkey % 700)::INTEGER AS height FROM lineitem""",
    "boxes": """SELECT l_orderkey AS image_id,
        lpad(l_linenumber::VARCHAR, 2, '0') || lpad(l_partkey::VARCHAR, 14, '0') || lpad(l_suppkey::VARCHAR, 13, '0')
            || lpad(round(l_extendedprice * 100)::BIGINT::VARCHAR, 14, '0') AS idx,
        (l_partkey % 400 - 10)::INTEGER AS x_min, ((l_suppkey % 10) * 6 - 4)::INTEGER AS y_min,
        (l_partkey % 400 + 10 + l_quantity)::INTEGER AS x_max,
        ((l_suppkey % 10) * 6 + 6 + l_linenumber)::INTEGER AS y_max, 'w' || l_partkey AS text,
        (1 - l_discount)::DECIMAL(4,2)::DOUBLE AS confidence FROM lineitem""",
    "regions": """SELECT b.image_id, idx, row_number() OVER (PARTITION BY b.image_id ORDER BY idx)::INTEGER AS region,
        x_min AS x, y_min AS y, x_max - x_min + 1 AS w, y_max - y_min + 1 AS h, width, height, text, confidence
        FROM boxes b JOIN images USING (image_id)""",
    "crops": """SELECT image_id, region, region AS pos, x, y, w, h FROM regions
        UNION ALL SELECT image_id, region, region + 1000, x + 3, y, w, h FROM regions WHERE region % 4 = 0""",
    "placed": """SELECT r.image_id, r.region, true AS has_text, r.w + r.region % 2 AS out_w, r.h AS out_h, c.x, c.y, c.w, c.h,
        r.w + r.region % 2 <> c.w OR r.h <> c.h AS resize,
        c.x >= 0 AND c.y >= 0 AND c.x + c.w <= width AND c.y + c.h <= height AS inside
        FROM regions r JOIN (SELECT * FROM crops QUALIFY row_number() OVER (PARTITION BY image_id, region ORDER BY pos DESC) = 1) c
        USING (image_id, region) WHERE r.region % 5 <> 0""",
    "lines": "SELECT image_id, region - 1 AS pos, text, confidence, x, y, w, h FROM regions",
    "aligned": """SELECT *, CASE WHEN image_id % 6 = 0 THEN text ELSE upper(text) END AS text_corrected FROM lines""",
    "full_texts": "SELECT image_id, max(text) AS full_text FROM boxes GROUP BY image_id",
    "manifest": """SELECT l_orderkey AS image_id, l_linenumber || '|' || l_partkey || ',' || l_suppkey || ',' || (l_partkey + 40)
        || ',' || (l_suppkey + 12) || '|w' || l_partkey || CASE l_quantity WHEN 1 THEN '|n/a' WHEN 2 THEN ''
        ELSE '|' || (100 - l_linenumber) END AS line, l_quantity, l_linenumber, l_partkey, l_suppkey FROM lineitem""",
    "media": """SELECT 'media/' || p_partkey || '/crop_' || (p_partkey * 7 % 1000) || CASE p_size % 5 WHEN 0 THEN '.MP3'
        WHEN 1 THEN '.wav' WHEN 2 THEN '.txt' WHEN 3 THEN '.png' ELSE '.jpg' END AS path, p_partkey, p_size,
        CASE WHEN p_size = 1 THEN 0 ELSE p_size * 1048576 END AS length FROM part""",
    "status": """SELECT user_id AS job_id, event_id AS seq, ts, floor(value)::BIGINT AS rest, event_id AS current,
        event_id + floor(value)::BIGINT AS total, CASE WHEN event_id % 5 <> 0 THEN event_type END AS message,
        event_id % 3 <> 0 AS has_message, epoch(date_trunc('minute', ts))::DOUBLE AS started_at FROM events""",
    "queries_v": """SELECT label AS query_id, list(v ORDER BY i) AS q FROM (
        SELECT label, i, avg(v::DOUBLE) AS v FROM (
            SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL)
        GROUP BY label""",
    "nearest": """SELECT query_id, vec_id, label, d, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INTEGER AS rank
        FROM (SELECT query_id, vec_id, label,
            list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - embedding[i]::DOUBLE) ** 2)) AS d
            FROM queries_v, embeddings) QUALIFY rank <= 20""",
}


def sql(body: str) -> str:
    """The statement with the logical tables it needs in front."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need(CTES[name])
                if name not in needed:
                    needed.append(name)

    need(body)
    recursive = body.startswith("RECURSIVE ")
    own, _, rest = body.removeprefix("RECURSIVE ").partition(" MAIN ") if recursive else ("", "", body)
    parts = [f"{name} AS ({CTES[name]})" for name in needed] + ([own] if own else [])
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
    return head + rest


START, END = "TIMESTAMP '2024-01-05 00:00:00'", "TIMESTAMP '2024-01-20 12:00:00'"
TOTALS = """coalesce(sum(amount) FILTER (transaction_type = 'purchase'), 0)::DOUBLE AS total_purchase,
    coalesce(sum(amount) FILTER (transaction_type = 'usage'), 0)::DOUBLE AS total_usage"""
IN_TIME = f"created_at BETWEEN {START} AND {END}"
OUT = "id, user_id, amount, transaction_type, created_at, payment_method"


def _guard(kind: str) -> str:
    o = "output"
    if kind == "document":
        bad = any_of(o, fixed.REVERT_MARKERS)
        return f"CASE WHEN {bad} THEN source ELSE {o} END AS document_text, CASE WHEN {bad} THEN 'reverted' ELSE 'accepted' END AS document_outcome"
    if kind == "api":
        bad = any_of(o, fixed.NO_TEXT_MARKERS)
        return f"CASE WHEN {bad} THEN source ELSE {o} END AS api_text, CASE WHEN {bad} THEN 'reverted' ELSE 'accepted' END AS api_outcome"
    if kind == "cleanup":
        return f"c6 AS cleanup_text, CASE WHEN {any_of(o, fixed.REMOVED_PHRASES)} THEN 'cleaned' ELSE 'accepted' END AS cleanup_outcome"
    s = strip(o)
    bad = "(" + " OR ".join(
        [f"upper({s}) = 'EMPTY'", any_of(f"lower({s})", fixed.OCR_NO_TEXT)]
        + [f"starts_with({s}, {_q(p)})" for p in fixed.OCR_OPENINGS]
    ) + ")"
    return f"CASE WHEN {bad} THEN '' ELSE {s} END AS ocr_text, CASE WHEN {bad} THEN 'emptied' ELSE 'accepted' END AS ocr_outcome"


def _cleaned(table: str = "(SELECT *, output AS c0 FROM outputs)") -> str:
    for i, phrase in enumerate(fixed.REMOVED_PHRASES):
        x = f"c{i}"
        table = (
            f"(SELECT *, CASE WHEN contains({x}, {_q(phrase)}) THEN {strip(f'replace({x}, {_q(phrase)}, {_q(str())})')} "
            f"ELSE {x} END AS c{i + 1} FROM {table})"
        )
    return table


def _spaced(prefixes: bool, x: str = "text") -> str:
    symbol = rf"[^{fixed.WORD}{SPACE}]"
    steps = [("([a-z])([A-Z])", r"\1 \2"), (r"([a-zA-Z][a-zA-Z])(\p{Nd})", r"\1 \2"), (r"(\p{Nd})([a-zA-Z][a-zA-Z])", r"\1 \2"),
             (rf"([a-zA-Z])({symbol})", r"\1 \2"), (rf"({symbol})([a-zA-Z])", r"\1 \2")]
    if prefixes:
        steps += [(rf"(?i)({p})([a-z]{{2,}})", r"\1 \2") for p in fixed.SPACED_PREFIXES]
    steps.append((rf"[{SPACE}]+", " "))
    for pattern, by in steps:
        x = f"regexp_replace({x}, {_q(pattern)}, {_q(by)}, 'g')"
    return strip(x)


# This engine has no look-around; on the given texts a word border says the same.
RE2_DOMAIN = r"\b(?:www\.)?[a-zA-Z0-9][-a-zA-Z0-9]*(?:\.[a-zA-Z0-9][-a-zA-Z0-9]*)+\b"
RE2_FORMATS = [p.replace(rf"(?<![{fixed.WORD}])", r"\b").replace(rf"(?![{fixed.WORD}])", r"\b") for p in fixed.FORMAT_PATTERNS]


def _masked(steps, source: str = "page_texts", key: str = "page_id") -> str:
    """Nested selects: `text` as masked so far, `n` spans so far, `spans` with their originals."""
    table = f"(SELECT {key}, text AS t0, 0 AS n0, []::STRUCT(placeholder VARCHAR, original VARCHAR)[] AS s0 FROM {source})"
    for i, (before, after, pattern) in enumerate(steps):
        p = _q(pattern)
        table = (
            f"(SELECT {key}, array_to_string(list_transform(regexp_split_to_array(t{i}, {p}), "
            f"lambda x, j: CASE WHEN j = 1 THEN x ELSE {_q(before)} || (n{i} + j - 2) || {_q(after)} || x END), '') AS t{i + 1}, "
            f"n{i} + len(f) AS n{i + 1}, list_concat(s{i}, list_transform(f, "
            f"lambda x, j: {{'placeholder': {_q(before)} || (n{i} + j - 1) || {_q(after)}, 'original': x}})) AS s{i + 1} "
            f"FROM (SELECT *, regexp_extract_all(t{i}, {p}) AS f FROM {table}))"
        )
    return table


LINK_STEPS = [("___URL_", "___", fixed.URL), ("___EMAIL_", "___", fixed.EMAIL), ("___DOMAIN_", "___", RE2_DOMAIN)]
FORMAT_STEPS = [("__PROTECTED_", "__", p) for p in RE2_FORMATS]


def _cases(x: str, pairs, default: str) -> str:
    whens = " ".join(f"WHEN {_q(a)} THEN {_q(b)}" for a, b in pairs)
    return f"CASE {x} {whens} ELSE {default} END"


def _first_names() -> dict[str, str]:
    names: dict[str, str] = {}
    for name, code in NAME_TO_OCR.items():
        names.setdefault(code, name)
    return names


def _preserve() -> str:
    whens = [f"WHEN {is_blank('text')} THEN 'blank'"]
    whens += [f"WHEN {has('s', p)} THEN {_q(name)}" for name, p in fixed.PRESERVE.items()]
    whens.append(f"WHEN {has('s', fixed.PROPER_NAME_OPENS)} AND NOT {has('s', fixed.PROPER_NAME_BREAKS)} THEN 'proper_name'")
    whens.append(f"WHEN length(s) <= 2 AND NOT {has('s', chr(94) + chr(92) + 'p{L}+$')} THEN 'short_symbol'")
    return "CASE " + " ".join(whens) + " END AS preserve_reason"


KIND = (
    f"CASE WHEN {is_blank('text')} THEN 'blank' WHEN {NUMBER} THEN 'number' WHEN {ROMAN} THEN 'roman' "
    "WHEN length(s) <= 2 AND NOT contains(text, '.') THEN 'short' ELSE 'text' END AS kind"
)


def _merged(source: str, h: int, v: int) -> str:
    return f"""SELECT image_id, line, group_no, min(x_min) AS x_min, min(y_min) AS y_min, max(x_max) AS x_max, max(y_max) AS y_max,
        string_agg(text, ' ' ORDER BY x_min, y_min, idx) AS text,
        sum(confidence::DECIMAL(18,8))::DOUBLE / count(*) AS confidence, count(*) AS boxes
    FROM (SELECT *, sum(g)  OVER (PARTITION BY image_id, line ORDER BY x_min, y_min, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS group_no
      FROM (SELECT *, CASE WHEN x_min - lag(x_max) OVER (PARTITION BY image_id, line ORDER BY x_min, y_min, idx) > {h} THEN 1 ELSE 0 END AS g
        FROM (SELECT *, sum(b) OVER (PARTITION BY image_id ORDER BY y_min, idx ROWS UNBOUNDED PRECEDING)::BIGINT AS line
          FROM (SELECT *, CASE WHEN abs((y_min + y_max) / 2 - lag((y_min + y_max) / 2) OVER (PARTITION BY image_id ORDER BY y_min, idx)) > {v}
                THEN 1 ELSE 0 END AS b FROM {source}))))
    GROUP BY image_id, line, group_no"""


ELAPSED = "(epoch_us(ts) / 1000000 - s.started)"
CLOCK = "CASE WHEN {h} < 100 THEN lpad(({h})::VARCHAR, 2, '0') ELSE ({h})::VARCHAR END || ':' || lpad((({x}) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((({x}) % 60)::VARCHAR, 2, '0')"


def clock(x: str) -> str:
    whole = f"floor({x})::BIGINT"
    return CLOCK.format(h=f"{whole} // 3600", x=whole)


BODIES = {
    # --- ledger ---
    "ledger_page": f"""SELECT {OUT}, username, total, total_purchase, total_usage FROM (
        SELECT o.*, u.username FROM tx_out o LEFT JOIN users u USING (user_id)
        WHERE transaction_type = 'usage' AND made BETWEEN {START} AND {END} ORDER BY made DESC, id DESC LIMIT 100 OFFSET 20),
        (SELECT count(*) AS total FROM tx WHERE transaction_type = 'usage' AND {IN_TIME}), (SELECT {TOTALS} FROM tx)""",
    "ledger_page_ascending": f"""SELECT {OUT}, username, total, total_purchase, total_usage FROM (
        SELECT o.*, u.username FROM tx_out o JOIN users u USING (user_id) WHERE username ILIKE '%customer#00000000_%'
        ORDER BY made, id LIMIT 50),
        (SELECT count(*) AS total, {TOTALS} FROM tx JOIN users USING (user_id) WHERE username ILIKE '%customer#00000000_%')""",
    "revenue_page": f"""SELECT {OUT}, username, total, total_revenue FROM (
        SELECT o.*, coalesce(u.username, 'User ' || user_id) AS username FROM tx_out o LEFT JOIN users u USING (user_id)
        WHERE transaction_type = 'purchase' ORDER BY made DESC, id DESC LIMIT 200 OFFSET 10),
        (SELECT count(*) AS total, sum(amount)::DOUBLE AS total_revenue FROM tx WHERE transaction_type = 'purchase')""",
    "ledger_totals": f"""SELECT total, total_purchase, total_usage FROM
        (SELECT count(*) AS total FROM tx WHERE transaction_type = 'purchase' AND {IN_TIME}), (SELECT {TOTALS} FROM tx)""",
    "ledger_totals_filtered": f"SELECT count(*) AS total, {TOTALS} FROM tx WHERE {IN_TIME}",
    "ledger_by_username": f"SELECT {OUT}, username FROM tx_out JOIN users USING (user_id) WHERE username ILIKE '%CUSTOMER#%1_%'".replace("created_at,", "tx_out.created_at,"),
    "ledger_enriched": f"""SELECT {OUT}, username AS known_name, coalesce(username, 'User ' || user_id) AS username
        FROM tx_out LEFT JOIN (SELECT user_id, username FROM users) USING (user_id)""",
    "user_pages": f"""SELECT {OUT}, position, total FROM (SELECT *,
        row_number() OVER (PARTITION BY user_id ORDER BY made DESC, id DESC)::INTEGER AS position,
        count(*) OVER (PARTITION BY user_id) AS total FROM tx_out) WHERE position BETWEEN 6 AND 15""",
    "transactions_filtered": f"SELECT {OUT} FROM tx_out WHERE transaction_type = 'purchase' AND made BETWEEN {START} AND {END}",
    "transaction_types": """SELECT event_type, CASE WHEN lower(event_type) = 'purchase' THEN 'purchase' ELSE 'usage' END
        AS transaction_type, count(*) AS rows FROM events GROUP BY ALL""",
    "history_filtered": f"""SELECT id, user_id, source_language, target_language, {iso("created_at")} AS created_at, output_text
        FROM history WHERE created_at >= TIMESTAMP '2024-01-01 01:00:00' AND source_language = 'fr' AND target_language = 'vi'""",
    "history_page": f"""SELECT id, user_id, target_language, {iso("created_at")} AS created_at,
        length(input_text)::INTEGER AS character_count, greatest(1, length(input_text))::DOUBLE AS credits_used
        FROM (SELECT * FROM history WHERE source_language = 'en' ORDER BY history.created_at, id LIMIT 40 OFFSET 3)""",
    "history_billed": f"""SELECT id, length(input_text)::INTEGER AS character_count,
        greatest(1, length(input_text))::DOUBLE AS credits_used, {iso("(created_at + INTERVAL 7 HOUR)")} AS local_time FROM history""",
    "users_public": f"""SELECT user_id AS id, username, email, {iso("created_at")} AS created_at, is_active, credits, account_type
        FROM users""",
    "payment_outcomes": """SELECT CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'cancelled' END AS outcome,
        o_orderstatus = 'F' AS success, count(*) AS payments FROM orders GROUP BY ALL""",
    "orphans": f"SELECT {OUT} FROM tx_out WHERE user_id NOT IN (SELECT user_id FROM users)",
    "delete_effects": """SELECT user_id, coalesce(t.n, 0) AS transactions,
        CASE WHEN t.n > 0 THEN 'refused' ELSE 'deleted' END AS outcome,
        CASE WHEN t.n > 0 THEN 0 ELSE coalesce(h.n, 0) END AS cascaded
        FROM users LEFT JOIN (SELECT user_id, count(*) AS n FROM tx GROUP BY ALL) t USING (user_id)
        LEFT JOIN (SELECT user_id, count(*) AS n FROM history GROUP BY ALL) h USING (user_id)""",
    "changes_applied": """SELECT id, user_id, source_language FROM history h WHERE NOT EXISTS
        (SELECT 1 FROM history_changes c WHERE c.action = 'delete' AND c.history_id = h.id AND c.user_id = h.user_id)""",
    "history_cleared": """SELECT id, user_id FROM history
        WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "profiles_updated": """SELECT user_id, coalesce(n, username) AS username, coalesce(e, email) AS email FROM users
        LEFT JOIN (SELECT user_id, bool_or(event_type = 'error' AND value > 300) AS gone,
            'name' || max(event_id) FILTER (event_type = 'click') AS n,
            'e' || max(event_id) FILTER (event_type = 'view') || '@example.org' AS e FROM events GROUP BY user_id) USING (user_id)
        WHERE NOT coalesce(gone, false)""",
    "user_change_verdicts": "SELECT * FROM verdicts",
    "user_change_outcomes": "SELECT action, outcome, count(*) AS changes FROM verdicts GROUP BY ALL",
    "config_patched": """SELECT s_suppkey::BIGINT AS id, CASE WHEN s_suppkey % 2 = 0 THEN upper(s_name) WHEN known THEN s_name END AS name_web,
        CASE WHEN s_suppkey % 3 = 0 THEN 100::DOUBLE WHEN known THEN floor(s_acctbal) END::DOUBLE AS price,
        CASE WHEN known THEN 's' || s_suppkey || '@example.com' END AS email,
        CASE WHEN NOT filled THEN 'refused' WHEN known THEN 'updated' ELSE 'inserted' END AS outcome
        FROM (SELECT *, s_acctbal >= 1000 AS known, s_suppkey % 2 = 0 OR s_suppkey % 3 = 0 AS filled FROM supplier)
        WHERE known OR filled""",
    "signup_duplicates": """SELECT seq, username, email, 5000::BIGINT AS credits, 'standard' AS account_type, true AS is_active,
        CASE WHEN seq > min(seq) OVER (PARTITION BY username) OR username IN (SELECT users.username FROM users) THEN 'username'
             WHEN seq > min(seq) OVER (PARTITION BY email) OR email IN (SELECT users.email FROM users) THEN 'email' END AS duplicate
        FROM (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'Customer#' || printf('%09d', o_custkey)
                ELSE 'new' || (o_orderkey % 5000) END AS username,
              'u' || (o_custkey * 3 + o_orderkey % 3) || '@example.com' AS email FROM orders)""",
    "signups_in_turn": """SELECT seq, username, email, 5000::BIGINT AS credits, 'standard' AS account_type, true AS is_active,
        CASE WHEN username IN (SELECT users.username FROM users) OR seq > name_taken THEN 'username'
             WHEN email IN (SELECT users.email FROM users) OR seq > email_taken THEN 'email' END AS duplicate
        FROM (SELECT *, min(seq) FILTER (state = 1) OVER (PARTITION BY username) AS name_taken,
                min(seq) FILTER (state = 1) OVER (PARTITION BY email) AS email_taken FROM (
            WITH RECURSIVE asked AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 4 = 0 THEN 'Customer#' || printf('%09d', o_custkey)
                    ELSE 'new' || (o_orderkey % 5000) END AS username,
                  'u' || (o_custkey * 3 + o_orderkey % 3) || '@example.com' AS email FROM orders),
            steps AS (
              SELECT seq, username, email, 0 AS step, CASE WHEN username IN (SELECT users.username FROM users)
                OR email IN (SELECT users.email FROM users) THEN 2 ELSE 0 END AS state FROM asked
              UNION ALL
              SELECT seq, username, email, step + 1, CASE WHEN state <> 0 THEN state
                  WHEN coalesce(seq > by_name, false) OR coalesce(seq > by_email, false) THEN 2
                  WHEN seq = first_name AND seq = first_email THEN 1 ELSE 0 END
              FROM (SELECT *, min(seq) FILTER (state = 1) OVER (PARTITION BY username) AS by_name,
                      min(seq) FILTER (state = 1) OVER (PARTITION BY email) AS by_email,
                      min(seq) FILTER (state <> 2) OVER (PARTITION BY username) AS first_name,
                      min(seq) FILTER (state <> 2) OVER (PARTITION BY email) AS first_email,
                      count(*) FILTER (state = 0) OVER () AS undecided FROM steps)
              WHERE undecided > 0)
            SELECT * FROM steps QUALIFY step = max(step) OVER ()))""",
    # --- OCR ---
    "boxes_merged": _merged("boxes", 30, 10),
    "boxes_merged_twice": _merged(
        f"(SELECT image_id, (line << 32) + group_no AS idx, x_min, y_min, x_max, y_max, text, confidence FROM ({_merged('boxes', 60, 6)}))", 60, 6
    ),
    "regions_numbered": """SELECT image_id, idx, region, x, y, w, h, greatest(0, x) AS crop_x, greatest(0, y) AS crop_y,
        least(width - greatest(0, x), w) AS crop_w, least(height - greatest(0, y), h) AS crop_h,
        'crop_' || region || '.jpg' AS file_name, text, confidence FROM regions""",
    "detections_unified": """SELECT * EXCLUDE (iw, ih), x_max - x_min AS width, y_max - y_min AS height FROM (
        SELECT image_id, idx, CASE WHEN x_max % 2 = 0 THEN 'horizontal' ELSE 'free' END AS kind, text,
            greatest(0, x_min - 5) AS x_min, greatest(0, y_min - 5) AS y_min, least(width, x_max + 5) AS x_max,
            least(height, y_max + 5) AS y_max, width AS iw, height AS ih FROM boxes JOIN images USING (image_id))
        WHERE x_max > x_min AND y_max > y_min AND trim(text) <> ''""",
    "grid_cells": """SELECT image_id, row, col, (col * cw)::INTEGER AS x_min, (row * ch)::INTEGER AS y_min,
        ((col + 1) * cw)::INTEGER AS x_max, ((row + 1) * ch)::INTEGER AS y_max, 'Region_' || row || '_' || col AS text, 0.5::DOUBLE AS confidence
        FROM (SELECT *, width // c AS cw, height // r AS ch, unnest(range(0, c))::INTEGER AS col FROM (
            SELECT *, unnest(range(0, r))::INTEGER AS row FROM (
                SELECT *, CASE WHEN width > height THEN 2 WHEN height > width * 2 THEN 4 ELSE 3 END AS r,
                    CASE WHEN width > height * 2 THEN 4 WHEN width > height THEN 3 WHEN height > width * 2 THEN 2 ELSE 3 END AS c
                FROM images)))""",
    "placement": "SELECT * EXCLUDE (inside) FROM placed WHERE inside",
    "placement_rejected": "SELECT * EXCLUDE (inside) FROM placed WHERE NOT inside",
    "placement_grid": """SELECT image_id, idx, crop_path, has_text, region, x, y, w, h,
        x >= 0 AND y >= 0 AND x + w <= width AND y + h <= height AS inside FROM (
        SELECT image_id, idx, 'out/crop_' || ((x_max + y_max + 100) % 11) || '.jpg' AS crop_path, true AS has_text, ((x_max + y_max + 100) % 11)::INTEGER AS region,
            (((x_max + y_max + 100) % 11 + 2) % 3 * (width // 3))::INTEGER AS x, (floor(((x_max + y_max + 100) % 11 - 1) / 3) * (height // 3))::INTEGER AS y,
            width // 3 AS w, height // 3 AS h, width, height
        FROM boxes JOIN images USING (image_id) WHERE x_max % 5 <> 0)""",
    "corrections_retried": """SELECT image_id, region - 1 AS pos, text,
        CASE WHEN count(*) OVER (PARTITION BY image_id) % 4 = 0 THEN text ELSE upper(text) END AS text_corrected FROM regions""",
    "corrections_aligned": "SELECT image_id, pos, text, text_corrected FROM aligned",
    "correction_requests": """SELECT image_id, count(*) AS items, string_agg(region || '. ' || text, chr(10) ORDER BY region) AS numbered_text,
        full_text, 'normal' AS mode FROM regions JOIN full_texts USING (image_id) GROUP BY image_id, full_text""",
    "numbered_lines": f"""SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS pos,
        CASE WHEN {has("s", "^" + chr(92) + "p{Nd}")} AND contains(s[1:5], '.') THEN {strip("s[strpos(s, '.') + 1:]")} ELSE s END AS text
        FROM (SELECT doc_id, i, {strip("l")} AS s FROM (
            SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (
                SELECT doc_id, string_split((doc_id % 13) || '. ' || replace(text, chr(10), chr(10) || ' 2.  '), chr(10)) AS ls FROM documents)))
        WHERE s <> ''""",
    "language_mapped": f"""SELECT lang, {_cases("lang", iso_rows(), "'en'")} AS ocr_code, {_cases("lang", NAME_TO_OCR.items(), "NULL")} AS name_ocr_code,
        {_cases("lang", _first_names().items(), "lang")} AS display_name, {_cases("lang", TRANSLATOR_NAMES.items(), "lang")} AS target_name,
        count(*) AS rows FROM (SELECT lang FROM documents UNION ALL SELECT n_name FROM nation UNION ALL
            SELECT CASE lang WHEN 'fr' THEN 'French' WHEN 'de' THEN 'zh' ELSE 'rs_cyrillic' END FROM documents) GROUP BY ALL""",
    "manifest_rows": """SELECT image_id, l_linenumber AS index, l_partkey::DOUBLE AS x1, l_suppkey::DOUBLE AS y1,
        (l_partkey + 40)::DOUBLE AS x2, (l_suppkey + 12)::DOUBLE AS y2, 'w' || l_partkey AS text, (100 - l_linenumber)::DOUBLE AS confidence
        FROM manifest WHERE l_quantity > 2""",
    "manifest_rejects": """SELECT image_id, line, CASE l_quantity WHEN 1 THEN 'bad_number' ELSE 'too_few_fields' END AS reason
        FROM manifest WHERE l_quantity <= 2""",
    "ocr_results": """SELECT image_id, 'en' AS language, full_text, to_json(list({'bbox': {'x_min': x, 'y_min': y, 'x_max': x + w, 'y_max': y + h},
        'text_original': text, 'text_corrected': text_corrected, 'confidence': confidence} ORDER BY pos))::VARCHAR AS results
        FROM aligned JOIN full_texts USING (image_id) GROUP BY image_id, full_text""",
    "media_in_order": """SELECT path, (p_partkey * 7 % 1000)::INTEGER AS number,
        row_number() OVER (PARTITION BY p_partkey * 7 % 1000 ORDER BY path)::INTEGER AS place FROM media""",
    "media_listed": """SELECT path, (p_partkey * 7 % 1000)::INTEGER AS number,
        CASE WHEN p_size % 5 IN (3, 4) THEN 'accepted' ELSE 'bad_format' END AS image_verdict,
        CASE WHEN p_size % 5 NOT IN (0, 1) THEN 'bad_format' WHEN length = 0 THEN 'empty' WHEN length > 26214400 THEN 'too_large'
            ELSE 'accepted' END AS audio_verdict FROM media""",
    # --- documents ---
    "segments_classified": f"SELECT doc_id, lang, para_idx, text, {KIND}, {_preserve()} FROM (SELECT *, {strip('text')} AS s FROM segments)",
    "words_classified": f"""SELECT kind, preserve_reason, count(*) AS segments FROM (
        SELECT {KIND}, {_preserve()} FROM (SELECT *, {strip('text')} AS s FROM runs)) GROUP BY ALL""",
    "segments_assembled": "SELECT doc, part, para_idx, source, translate FROM assembled",
    "segments_redistributed": """SELECT doc, part, para_idx, run_idx, text_idx, text, kind,
        CASE WHEN kind <> 'text' OR target IS NULL THEN text WHEN n = 1 THEN target WHEN target = '' THEN text
            WHEN paired AND k < used THEN lines[k]
            WHEN paired AND k = used THEN CASE WHEN used >= len(lines) THEN lines[k]
                WHEN lines[k] = '' THEN array_to_string(lines[used + 1:], chr(10))
                ELSE array_to_string(lines[used:], chr(10)) END
            WHEN paired THEN text WHEN k = 1 THEN target ELSE '' END AS new_text
        FROM (SELECT *, least(n, len(lines), len(string_split(source, chr(10)))) AS used FROM (
            SELECT r.*, t.source, t.target, string_split(t.target, chr(10)) AS lines,
                contains(t.source, chr(10)) AND contains(t.target, chr(10)) AS paired,
                count(*) OVER (PARTITION BY r.doc, r.part, r.para_idx, r.kind) AS n,
                row_number() OVER (PARTITION BY r.doc, r.part, r.para_idx, r.kind ORDER BY run_idx) AS k
            FROM kinds r JOIN targets t USING (doc, part, para_idx)))""",
    "segments_fallback": f"""SELECT doc, part, para_idx, run_idx, text FROM runs r WHERE part = 'document.xml'
        AND length({strip("text")}) > 10 AND NOT EXISTS (SELECT 1 FROM targets t WHERE t.doc = r.doc AND t.part = r.part AND target IS NOT NULL)""",
    "translated_rollup": """SELECT doc, part, count(target) AS translated, count(*) AS segments FROM targets GROUP BY ROLLUP (doc, part)""",
    "doc_structure": f"""SELECT doc, count(*) AS num_paragraphs, sum(n)::BIGINT AS num_text_elements, sum(n)::BIGINT AS num_runs,
        sum(chars)::DOUBLE / greatest(1, sum(n)) AS avg_text_length, count(*) FILTER (n >= 3 AND singles >= 3) AS special_paragraphs,
        count(*) FILTER (n >= 3 AND singles >= 3) >= 3 OR sum(chars)::DOUBLE / greatest(1, sum(n)) < 5 AS needs_text_grouping
        FROM (SELECT doc, para_idx, count(*) AS n, sum(length(s)) AS chars, count(*) FILTER (length(s) = 1 AND run_idx < 5) AS singles
              FROM (SELECT *, {strip("text")} AS s FROM runs WHERE part = 'document.xml') GROUP BY ALL) GROUP BY doc""",
    "paragraph_preview": f"""SELECT doc, para_idx + 1 AS number, position, CASE WHEN length(text) > 100 THEN text[1:100] || '...' ELSE text END AS preview
        FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY para_idx)::INTEGER AS position FROM para_texts WHERE NOT {is_blank("text")})
        WHERE position BETWEEN 3 AND 12""",
    # --- text ---
    "links_masked": f"SELECT page_id, t3 AS masked, n3::INTEGER AS spans FROM {_masked(LINK_STEPS)}",
    "link_spans": f"""SELECT page_id, (i - 1)::INTEGER AS span, s.placeholder AS placeholder, s.original AS original FROM (
        SELECT page_id, unnest(s3) AS s, generate_subscripts(s3, 1) AS i FROM {_masked(LINK_STEPS)})""",
    "links_restored": "SELECT page_id, text AS restored FROM page_texts",
    "formats_masked": f"SELECT page_id, t8 AS masked, n8::INTEGER AS spans FROM {_masked(FORMAT_STEPS)}",
    "spacing_repaired": f"SELECT doc_id, para_idx, {_spaced(False)} AS repaired, {_spaced(True)} AS repaired_prefixes FROM segments",
    "responses_guarded": f"SELECT id, {_guard('document')}, {_guard('api')}, {_guard('cleanup')}, {_guard('ocr')} FROM {_cleaned()}",
    "guard_counts": f"""SELECT CASE WHEN {any_of("output", fixed.REVERT_MARKERS)} THEN 'reverted' ELSE 'accepted' END AS guard_outcome,
        count(*) AS answers FROM outputs GROUP BY ALL""",
    "requests_parsed": """SELECT id, verb, CASE WHEN verb = 'TRANSLATE' AND len(p) < 5 THEN 'too_few_fields'
            WHEN verb NOT IN ('TRANSLATE', 'ANALYZE', 'TRANSCRIBE', 'TRANSLATE_DOCX') THEN 'unknown_verb' END AS reject_reason,
        CASE WHEN t THEN p[2] END AS source_lang, CASE WHEN t THEN p[3] WHEN d THEN p[4] END AS target_lang,
        CASE WHEN t THEN p[4] WHEN d THEN coalesce(p[9], 'General') END AS style,
        CASE WHEN t THEN array_to_string(p[5:], '|') WHEN verb = 'ANALYZE' THEN array_to_string(p[2:], '|') END AS body,
        CASE WHEN d OR verb = 'TRANSCRIBE' THEN p[2] END AS input_path, CASE WHEN d THEN p[3] END AS output_path,
        CASE WHEN d THEN p[5] END AS model, CASE WHEN d THEN p[6]::DOUBLE END AS temperature,
        CASE WHEN d THEN p[7]::DOUBLE END AS workers, CASE WHEN d THEN p[8] END AS status_file,
        CASE WHEN verb = 'TRANSCRIBE' THEN nullif(p[3], '') END AS language
        FROM (SELECT *, p[1] AS verb, p[1] = 'TRANSLATE' AND len(p) >= 5 AS t, p[1] = 'TRANSLATE_DOCX' AS d
              FROM (SELECT id, string_split(q, '|') AS p FROM requests))""",
    "fragments": "SELECT id, pos, name, code, text FROM frags",
    "fragment_shares": "SELECT code, name, sum(length(text))::BIGINT AS chars, count(*) AS fragments FROM frags GROUP BY ALL",
    # --- memory and inference ---
    "tm_hits": """SELECT doc_id, para_idx, key, target, CASE WHEN key IS NOT NULL THEN target IS NOT NULL END AS hit
        FROM keyed LEFT JOIN (SELECT key, target FROM memory) USING (key)""",
    "tm_misses": "SELECT DISTINCT key, text AS source FROM keyed WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM memory)",
    "tm_stats": """SELECT job, total_requests - misses AS hits, misses, total_requests,
        (total_requests - misses) / total_requests::DOUBLE * 100 AS hit_rate, cache_size FROM (
        SELECT lang AS job, count(*) AS total_requests, count(DISTINCT key) FILTER (key NOT IN (SELECT key FROM memory)) AS misses,
            count(DISTINCT key) AS cache_size FROM keyed WHERE key IS NOT NULL GROUP BY lang)""",
    "bounded_cache": """SELECT job, hits, n - hits AS misses, n AS total_requests, hits / n::DOUBLE * 100 AS hit_rate, len(texts)::INTEGER AS cache_size
        FROM (WITH RECURSIVE uses AS MATERIALIZED (
            SELECT lang AS job, dense_rank() OVER (ORDER BY key) AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id, para_idx) AS n
            FROM keyed WHERE key IS NOT NULL),
          turns AS (
            SELECT DISTINCT job, 0::BIGINT AS n, []::BIGINT[] AS texts, 0::BIGINT AS hits FROM uses
            UNION ALL
            SELECT job, n, CASE WHEN hit THEN list_append(list_filter(texts, lambda x: x <> k), k)
                WHEN len(texts) >= 500 THEN list_append(texts[101:], k) ELSE list_append(texts, k) END, hits + hit::BIGINT
            FROM (SELECT turns.job, uses.n, texts, hits, k, list_contains(texts, k) AS hit
                  FROM turns JOIN uses ON uses.job = turns.job AND uses.n = turns.n + 1))
          SELECT * FROM turns QUALIFY n = max(n) OVER (PARTITION BY job))""",
    "tm_retained": f"""SELECT key, source, {iso("last_used")} AS last_used FROM
        (SELECT * FROM memory ORDER BY memory.last_used DESC, key LIMIT 2000)""",
    "tm_merged": """SELECT key, source, target, CASE WHEN fresh THEN '2024-06-01T00:00:00' ELSE strftime(last_used, '%Y-%m-%dT%H:%M:%S') END AS last_used
        FROM (SELECT key, text AS source, 'v2:' || text AS target, true AS fresh, NULL::TIMESTAMP AS last_used FROM (
                SELECT DISTINCT key, text FROM keyed WHERE key IS NOT NULL AND lang IN ('de', 'fr') AND text LIKE '%a%')
              UNION ALL SELECT key, source, target, false, last_used FROM memory WHERE key NOT IN (
                SELECT key FROM keyed WHERE key IS NOT NULL AND lang IN ('de', 'fr') AND text LIKE '%a%'))""",
    "translated_default_fn": f"""SELECT doc_id, para_idx, CASE WHEN k.key IS NULL OR (m.key IS NULL AND {any_of("k.text", fixed.REVERT_MARKERS)})
            THEN k.text ELSE 'vi:' || k.text END AS target,
        CASE WHEN k.key IS NULL THEN 'blank' WHEN m.key IS NOT NULL THEN 'remembered'
            WHEN {any_of("k.text", fixed.REVERT_MARKERS)} THEN 'reverted' ELSE 'translated' END AS outcome
        FROM keyed k LEFT JOIN memory m USING (key)""",
    # --- ordered state ---
    "ttl_replay": """RECURSIVE req AS (SELECT event_id AS id, user_id % 10 AS key, epoch_us(ts) AS t, value >= 5 AS storable FROM events),
        links AS MATERIALIZED (SELECT a.key, a.t, b.t AS nxt FROM req a ASOF LEFT JOIN (SELECT key, t FROM req WHERE storable) b
            ON a.key = b.key AND b.t >= a.t + 3600000000 WHERE a.storable),
        sets AS (SELECT key, min(t) AS t FROM req WHERE storable GROUP BY key UNION ALL
            SELECT l.key, l.nxt FROM sets s JOIN links l ON l.key = s.key AND l.t = s.t WHERE l.nxt IS NOT NULL)
        MAIN SELECT r.id, CASE WHEN r.key <> 9 THEN (r.key + 9007199254740992)::VARCHAR END AS key, r.storable, coalesce(s.t < r.t AND r.t < s.t + 3600000000, false) AS hit
        FROM req r ASOF LEFT JOIN sets s ON r.key = s.key AND r.t >= s.t""",
    "credit_replay": """RECURSIVE mv AS (SELECT event_id AS seq, user_id, CASE WHEN event_type = 'purchase' THEN 'add' ELSE 'subtract' END AS kind,
            CASE WHEN event_id % 13 <> 0 THEN (floor(value) * 20)::BIGINT END AS amount, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k,
            c_acctbal >= 0 AS known FROM events LEFT JOIN customer ON c_custkey = user_id),
        steps AS (SELECT user_id, 0::BIGINT AS k, 5000::BIGINT AS balance, '' AS verdict FROM mv WHERE known GROUP BY user_id UNION ALL
            SELECT m.user_id, m.k, CASE WHEN coalesce(amount, 0) <= 0 THEN balance WHEN kind = 'add' THEN balance + amount
                    WHEN balance < amount THEN balance ELSE balance - amount END,
                CASE WHEN coalesce(amount, 0) <= 0 THEN 'bad_amount' WHEN kind = 'add' OR balance >= amount THEN 'ok' ELSE 'insufficient' END
            FROM steps s JOIN mv m ON m.user_id = s.user_id AND m.k = s.k + 1)
        MAIN SELECT seq, user_id, kind, amount::DOUBLE AS amount, coalesce(verdict, 'no_such_user') AS verdict, balance::DOUBLE AS balance
        FROM mv LEFT JOIN steps USING (user_id, k)""",
    "status_folded": f"""SELECT job_id, CASE WHEN arg_max(rest, seq) = 0 THEN 'completed' ELSE 'processing' END AS status,
        max(seq) AS current, arg_max(total, seq) AS total,
        CASE WHEN max(seq) FILTER (has_message) % 5 <> 0 THEN arg_max(message, seq) FILTER (has_message) END AS message,
        arg_min(started_at, seq) AS started_at, {iso("max(ts)")} AS updated_at FROM status GROUP BY job_id""",
    "job_progress": f"""SELECT job_id, seq, percent, round(elapsed, 3) AS elapsed, round(eta, 3) AS eta, round(speed, 6) AS speed,
        {clock("elapsed")} AS elapsed_text, CASE WHEN eta IS NOT NULL AND eta <> 0 THEN {clock("eta")} ELSE '--:--' END AS eta_text
        FROM (SELECT *, CASE WHEN percent > 0 THEN elapsed / percent * (100 - percent) END AS eta,
              CASE WHEN percent > 0 AND elapsed > 0 THEN current / elapsed ELSE 0.0::DOUBLE END AS speed FROM (
            SELECT e.job_id, seq, current, {ELAPSED} AS elapsed,
                CASE WHEN total > 0 THEN least(99, floor(current / total * 100))::INTEGER ELSE 0 END AS percent
            FROM status e JOIN (SELECT job_id, arg_min(started_at, seq) AS started FROM status GROUP BY job_id) s USING (job_id)))""",
    "job_throughput": f"""SELECT user_id AS job_id, {iso("date_trunc('minute', ts)")} AS window_start, count(*) AS events,
        min(event_id) AS first_item, max(event_id) AS last_item FROM events GROUP BY user_id, date_trunc('minute', ts)""",
    # --- retrieval ---
    "chunk_windows": """SELECT doc_id, (generate_subscripts(starts, 1) - 1)::INTEGER AS chunk_idx, unnest(starts)::INTEGER AS start,
        text[unnest(starts) + 1 : unnest(starts) + 2000] AS text
        FROM (SELECT doc_id, text, range(0, greatest(length(text) - 400, 1), 1600) AS starts FROM documents WHERE length(text) > 0)""",
    "retrieve_topk": "SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM nearest",
    "neighbours_of_all": """SELECT query_id, vec_id, rank, round(d, 6) AS distance FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id)::INTEGER AS rank FROM (
            SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(range(1, len(a.embedding) + 1),
                lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))) AS d FROM embeddings a, embeddings b)) WHERE rank <= 4""",
    "chunks_united": """SELECT doc_id, (generate_subscripts(starts, 1) - 1)::INTEGER AS chunk_idx, unnest(starts)::INTEGER AS start,
        text[unnest(starts) + 1 : unnest(starts) + 2000] AS text
        FROM (SELECT doc_id, text, range(0, greatest(length(text) - 400, 1), 1600) AS starts FROM (
            SELECT doc_id, text FROM documents UNION ALL SELECT -1 - page_id, text FROM page_texts) WHERE length(text) > 0)""",
    "graded_split": "SELECT query_id, vec_id, rank, 'yes' AS grade FROM nearest WHERE label = query_id",
    "unanswered": "SELECT query_id FROM queries_v WHERE query_id NOT IN (SELECT query_id FROM nearest WHERE label = query_id)",
}
BODIES["change_outcomes"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, outcome, count(*) AS changes FROM (
        SELECT ts, CASE WHEN action <> 'delete' THEN 'other_action' WHEN owner IS NULL THEN 'not_found' WHEN seq > first THEN 'already_gone'
            WHEN owner = user_id THEN 'deleted' ELSE 'not_owner' END AS outcome FROM (
        SELECT c.*, h.user_id AS owner, min(CASE WHEN h.user_id = c.user_id AND action = 'delete' THEN seq END) OVER (PARTITION BY history_id) AS first
        FROM history_changes c LEFT JOIN history h ON c.history_id = h.id)) GROUP BY ALL"""



def _layout(name: str, fields: str, row: str, header: str, rejected_header: str | None) -> str:
    """Rows and rejects of one manifest layout; `rejected_header` is the reason if its header line is no header there."""
    made = {
        "index": "l_linenumber", "path": "'p/' || l_partkey || '.jpg'", "other": "'o/' || l_partkey || '.png'",
        "box": "l_partkey || ', 2, 30, 40'", "rect": "l_partkey || ',2,3,4'", "text": "' w' || l_partkey", "said": "'s' || l_partkey",
        "sure": "100 - l_linenumber",
    }
    columns = [f"({made[f]})" for f in fields.split()]
    whole, cut = " || '|' || ".join(["'n/a'", *columns[1:]]), " || '|' || ".join(columns[:-1])
    header_row = f" UNION ALL SELECT '{name}', l_orderkey, '{rejected_header}', '{header}' FROM lineitem WHERE l_quantity = 3" if rejected_header else ""
    return f"""SELECT '{name}' AS layout, l_orderkey AS image_id, l_linenumber::VARCHAR AS index, {row} AS row FROM lineitem WHERE l_quantity > 3
        UNION ALL SELECT '{name}', l_orderkey, 'bad_number', {whole} FROM lineitem WHERE l_quantity = 1
        UNION ALL SELECT '{name}', l_orderkey, 'too_few_fields', {cut} FROM lineitem WHERE l_quantity = 2{header_row}"""


_P, _O, _W, _S = "'p/' || l_partkey || '.jpg'", "'o/' || l_partkey || '.png'", "' w' || l_partkey", "'s' || l_partkey"
_NUMBERS = "l_partkey || '~3~' || (100 - l_linenumber)"
BODIES["manifest_layouts"] = " UNION ALL ".join(
    [
        _layout("cropped", "index path box rect text sure", f"{_P} || '~' || {_W} || '~' || {_NUMBERS}", "x", "too_few_fields"),
        _layout("processed", "index path other box rect text sure", f"{_P} || '~' || {_O} || '~' || {_W} || '~' || {_NUMBERS}", "x", "too_few_fields"),
        _layout("extracted", "index path text said", f"{_P} || '~' || {_W} || '~' || {_S}", "", None),
        _layout("translated_texts", "index other path said text", f"{_P} || '~' || {_W} || '~' || {_S}", "", None),
        _layout("translated", "index path other text said", f"{_P} || '~' || {_O} || '~' || {_W} || '~' || {_S} || '~' || (l_quantity <> 4)", "", None),
    ]
)

# Distinct missing texts: masked, spaced, marked, cleaned, and put back from the last span to the first.
_ANSWERS = _cleaned(
    f"(SELECT key, s8, 'vi:' || {_spaced(False, 't8')} AS c0 FROM {_masked(FORMAT_STEPS, '(SELECT DISTINCT key, text FROM keyed WHERE key IS NOT NULL)', 'key')})"
)
_BACK = (
    "list_reduce(list_prepend({'placeholder': '', 'original': c6}, list_reverse(s8)), "
    "lambda a, b: {'placeholder': '', 'original': replace(a.original, b.placeholder, b.original)}).original"
)
BODIES["translated_protected"] = f"""SELECT doc_id, para_idx,
        CASE WHEN k.key IS NULL THEN k.text WHEN m.key IS NOT NULL THEN m.target WHEN {any_of("back", fixed.REVERT_MARKERS)} THEN k.text
            ELSE back END AS target,
        CASE WHEN k.key IS NULL THEN 'blank' WHEN m.key IS NOT NULL THEN 'remembered'
            WHEN {any_of("back", fixed.REVERT_MARKERS)} THEN 'reverted' ELSE 'translated' END AS outcome
        FROM keyed k LEFT JOIN memory m USING (key) LEFT JOIN (SELECT key, {_BACK} AS back FROM {_ANSWERS}) a USING (key)"""
BODIES["stream_ttl_replay"] = BODIES["ttl_replay"]
BODIES["stream_job_progress"] = BODIES["job_progress"]
BODIES["stream_status_folded"] = BODIES["status_folded"]
BODIES["word_runs_read"] = """SELECT doc, part, regexp_replace(part, '1?[.]xml$', '') AS part_kind,
    (dense_rank() OVER (PARTITION BY doc, part ORDER BY para_idx) - 1)::INTEGER AS para_idx, run_idx, text_idx, text, NULL::VARCHAR AS error FROM runs"""
BODIES["word_runs_followed"] = BODIES["word_runs_read"]
BODIES["texts_read"] = "SELECT doc_id, coalesce(text, '') || chr(10) AS text FROM documents"
BODIES["texts_followed"] = f"SELECT doc_id, para_idx, text FROM segments WHERE NOT {is_blank('text')}"
BODIES["status_files_read"] = f"""SELECT job_id::VARCHAR AS id, status, current::INTEGER AS progress, started_at, message,
    NULL::VARCHAR AS error, NULL::VARCHAR AS _bad FROM ({BODIES["status_folded"]})"""
BODIES["chunk_store_read"] = BODIES["chunk_windows"]
BODIES["stream_translate_once"] = "SELECT DISTINCT key, text FROM keyed WHERE key IS NOT NULL"
BODIES["stream_credit_replay"] = BODIES["credit_replay"]
BODIES["stream_throughput_rows"] = BODIES["job_throughput"]

_OPEN = """(SELECT conv_id AS job_id, turn AS seq, CASE WHEN turn % 13 = 12 THEN '[' || turn || ']'
    WHEN conv_id % 11 = 3 AND turn % 4 = 1 THEN left(whole, -1) ELSE whole END AS body
  FROM (SELECT *, '{"status":' || coalesce(to_json(role)::VARCHAR, 'null')
    || ',"length":' || CASE WHEN turn % 4 = 3 THEN '"' || length(text) || '"' ELSE length(text)::VARCHAR END
    || CASE WHEN turn % 3 = 0 THEN ',"note":null' WHEN turn % 2 = 0 THEN ',"note":' || coalesce(to_json(text)::VARCHAR, 'null') ELSE '' END
    || CASE WHEN turn % 5 = 1 THEN ',"extra_' || (conv_id % 7) || '":{"done":' || (turn % 2 = 0) || ',"marks":[' || turn || ',"x"]}' ELSE '' END
    || '}' AS whole FROM conversations))"""
_KIND = """CASE json_type(v) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean'
    WHEN 'NULL' THEN 'null' ELSE 'number' END"""
_FIELDS = f"""(SELECT *, {_KIND} AS kind, json_extract_string(v, '$') AS value FROM (
    SELECT job_id, seq, field, json_extract(j, '$."' || field || '"') AS v FROM (
      SELECT job_id, seq, j, unnest(json_keys(j)) AS field FROM (
        SELECT job_id, seq, body::JSON AS j FROM {_OPEN} WHERE json_valid(body)) WHERE json_type(j) = 'OBJECT')))"""
BODIES["open_fields_folded"] = f"""SELECT job_id, field, arg_max(kind, seq) AS kind, arg_max_null(value, seq) AS value, max(seq) AS seq, count(*) AS n_events
    FROM {_FIELDS} GROUP BY job_id, field"""
BODIES["open_fields_profiled"] = f"""SELECT field, count(*) AS n_rows, count(*) FILTER (kind = 'null') AS n_null,
    array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds FROM {_FIELDS} GROUP BY field"""
BODIES["open_messages_rejected"] = f"""SELECT job_id, seq, body, kind FROM (
    SELECT *, CASE WHEN body IS NULL THEN 'missing' WHEN NOT json_valid(body) THEN 'broken' ELSE
      (SELECT {_KIND} FROM (SELECT CASE WHEN json_valid(body) THEN body END AS v)) END AS kind FROM {_OPEN}) WHERE kind <> 'object'"""

ORACLES = {name: sql(body) for name, body in BODIES.items()}
