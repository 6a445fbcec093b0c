"""The same results in DuckDB SQL, written independently of the Spark operators.

Only the input projection (``tickets``) and the fixed values are shared.
"""

from __future__ import annotations

from fractions import Fraction

from ..functions import fixed
from . import tickets as data
from .queries import BATCH_ID, LOOKUP_ID, SEARCH, SEED

ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(v) for v in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in columns.items())


_FROM = "FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
_RAW = f"raw AS (SELECT {_columns({**data.RAW_COLUMNS, 'customer_name': 'c_name'})} {_FROM})"
_GAPPY = f"gappy AS (SELECT {_columns({**data.RAW_COLUMNS, **data.GAPPY_COLUMNS})} {_FROM})"
_RECORDS = ("records AS (SELECT "
            f"{_columns({**data.RAW_COLUMNS, 'customer_name': 'c_name', **data.METADATA_COLUMNS})} {_FROM})")
_DECISIONS = (f"decisions AS (SELECT {_columns(data.DECISION_COLUMNS)} FROM lineitem "
              f"WHERE {data.DECISION_FILTER})")
_PAIRS = f"pairs AS (SELECT {_columns(data.PAIR_COLUMNS)} FROM lineitem)"
_LINES = f"lines AS (SELECT id + 1 AS line_no, {data.RECORD_LINE} AS line, * FROM raw)"


def _clean(source: str = "raw") -> str:
    return (f"clean AS (SELECT * REPLACE (trim(review) AS review) FROM {source} "
            "WHERE trim(coalesce(review, '')) <> '' AND lower(trim(review)) <> 'nan')")


def _hits(words) -> str:
    return f"len(list_filter({_list(words)}, lambda w: contains(lower(review), w)))"


def _first(rules, fallback, prefix) -> str:
    whens = " ".join(f"WHEN {prefix}{i} > 0 THEN {_q(label)}" for i, (label, _) in enumerate(rules))
    return f"CASE {whens} ELSE {_q(fallback)} END"


def _first_count(rules, prefix) -> str:
    whens = " ".join(f"WHEN {prefix}{i} > 0 THEN {prefix}{i}" for i in range(len(rules)))
    return f"CASE {whens} ELSE 0 END"


def _map_case(column, mapping, fallback="NULL") -> str:
    whens = " ".join(f"WHEN {_q(k)} THEN {v}" for k, v in mapping.items())
    return f"CASE {column} {whens} ELSE {fallback} END"


def _num(value: float) -> str:
    return f"{value!r}e0"


def _matches(pattern: str, flags: str = "is") -> str:
    return f"regexp_matches(review, {_q(f'(?{flags})' + pattern)})"


_COUNTS = ", ".join(
    [f"{_hits(words)} AS cat{i}" for i, (_, words) in enumerate(fixed.CATEGORY_RULES)]
    + [f"{_hits(words)} AS pri{i}" for i, (_, words) in enumerate(fixed.PRIORITY_RULES)])

_SIGNALS = " + ".join(f"{_matches(p, 'i')}::INT" for p in fixed.SIGNAL_PATTERNS)
_T = fixed.LENGTH_TERMS
_HALF = "(('0x' || substr(md5(review), {}, 16))::UBIGINT % 10000)::BIGINT"

_LABELLED = f"""counted AS (SELECT *, {_COUNTS} FROM clean),
labelled AS (SELECT *, {_first(fixed.CATEGORY_RULES, fixed.CATEGORY_ELSE, 'cat')} AS predicted_category,
  {_first(fixed.PRIORITY_RULES, fixed.PRIORITY_ELSE, 'pri')} AS predicted_priority,
  {_first_count(fixed.CATEGORY_RULES, 'cat')} + {_first_count(fixed.PRIORITY_RULES, 'pri')} AS matched_keywords,
  list_filter(regexp_split_to_array(lower(review), '\\s+'), lambda w: w <> '') AS words FROM counted),
departed AS (SELECT *, {_map_case('predicted_category', {k: _q(v) for k, v in fixed.DEFAULT_DEPARTMENT.items()})} AS predicted_department FROM labelled)"""

_TERMS = f"""terms AS (SELECT *,
  {_map_case('predicted_priority', {k: _num(v) for k, v in fixed.PRIORITY_BASE.items()})} AS term_base,
  least(matched_keywords * {_num(fixed.PER_HIT)}, {_num(fixed.HIT_LIMIT)}) AS term_hits,
  CASE WHEN length(review) < 15 THEN {_num(_T['very_short'])} WHEN length(review) < 35 THEN {_num(_T['short'])}
    WHEN length(review) > 700 THEN {_num(_T['long'])}
    WHEN length(review) BETWEEN 70 AND 350 THEN {_num(_T['ideal'])} ELSE 0e0 END AS term_length,
  least(({_SIGNALS}) * {_num(fixed.PER_SIGNAL)}, {_num(fixed.SIGNAL_LIMIT)}) AS term_signals,
  CASE WHEN len(words) >= 5 THEN (len(list_distinct(words)) / len(words) - 0.5e0) * 0.04e0 ELSE 0e0 END AS term_vocabulary,
  (({_HALF.format(1)} * 1616 + {_HALF.format(17)}) % 10000 / 10000e0 - 0.5e0) * 0.12e0 AS term_jitter
  FROM departed),
scored AS (SELECT *, floor(greatest(0.62e0, least(0.95e0, term_base + term_hits + term_length + term_signals
  + term_vocabulary + term_jitter)) * 10000e0 + 0.5e0) / 10000e0 AS confidence FROM terms)"""

_REASON = "CASE " + " ".join(
    f"WHEN {_matches(p)} THEN {_q(reason)}" for p, reason in fixed.CRITICAL_RULES) + " END"
_HIGH = " OR ".join(_matches(p) for p in fixed.HIGH_RULES)


def _corrected(category: str, department: str) -> str:
    whens = " ".join(f"WHEN {category} = {_q(c)} AND {department} IN {_in(wrong)} THEN {_q(right)}"
                     for c, wrong, right in fixed.DEPARTMENT_FIXES)
    return f"CASE {whens} ELSE {department} END"


def _safety(threshold: float) -> str:
    return f"""judged AS (SELECT *, {_REASON} AS escalation_reason, ({_HIGH}) AS high FROM scored),
finals AS (SELECT *, escalation_reason IS NOT NULL AS escalated, predicted_category AS final_category,
  CASE WHEN escalation_reason IS NOT NULL THEN 'Critical'
    WHEN high AND predicted_priority IN ('Low', 'Medium') THEN 'High' ELSE predicted_priority END AS final_priority,
  {_corrected('predicted_category', 'predicted_department')} AS final_department,
  confidence >= {_num(threshold)} AS confidence_passed FROM judged),
triaged AS (SELECT *, CASE WHEN escalated OR NOT confidence_passed
  OR (final_priority = 'Critical' AND confidence < 0.90e0) THEN 'HUMAN_REVIEW' ELSE 'AUTO_ROUTED' END AS routing_status,
  '{{"category": "' || predicted_category || '", "priority": "' || predicted_priority || '", "department": "'
    || predicted_department || '"}}' AS raw_output,
  true AS is_valid_json, {_q(fixed.MODEL_VERSION)} AS model_version FROM finals)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_TO_LABELS = _with(_RAW, _clean(), _LABELLED)
_TO_SCORES = _with(_RAW, _clean(), _LABELLED, _TERMS)
_TO_TRIAGED = _with(_RAW, _clean(), _LABELLED, _TERMS, _safety(fixed.CONFIDENCE_THRESHOLD))


def _iso(column: str) -> str:
    return (f"CASE WHEN strftime({column}, '%f') = '000000' THEN strftime({column}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({column}, '%Y-%m-%dT%H:%M:%S.%f') END")


def _current(condition: str = "true") -> str:
    note = (f"CASE WHEN kind = 'override' AND coalesce(notes, '') = '' THEN {_q(fixed.OVERRIDE_NOTE)} ELSE notes END")
    return _with(
        _RAW, _clean(), _LABELLED, _TERMS, _safety(fixed.CONFIDENCE_THRESHOLD), _DECISIONS,
        f"""noted AS (SELECT * REPLACE ({note} AS notes) FROM decisions WHERE {condition}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY decided_at DESC, kind DESC, decided_category DESC,
  decided_priority DESC, decided_department DESC, notes DESC NULLS LAST) AS rn FROM noted),
cur AS (SELECT t.id, t.ticket_id, t.customer_name, t.review, t.confidence, t.escalated, t.created_at,
  coalesce(r.decided_category, t.final_category) AS final_category,
  coalesce(r.decided_priority, t.final_priority) AS final_priority,
  coalesce(r.decided_department, t.final_department) AS final_department,
  CASE WHEN r.id IS NULL THEN t.routing_status ELSE 'RESOLVED' END AS routing_status,
  r.id IS NOT NULL AS is_reviewed, r.notes AS reviewer_notes, r.decided_at AS reviewed_at,
  coalesce(r.decided_at, t.created_at) AS updated_at
  FROM triaged t LEFT JOIN ranked r ON r.id = t.id AND r.rn = 1)""")


_CURRENT = _current()
_STATE = "id, final_category, final_priority, final_department, routing_status, is_reviewed, reviewer_notes"
_PENDING = "routing_status = 'HUMAN_REVIEW' AND NOT is_reviewed"


def _percent(part: str, whole: str, digits: int = 1) -> str:
    scale = 10 ** digits
    return (f"CASE WHEN {whole} = 0 THEN 0e0 ELSE ((({part}) * {200 * scale} + ({whole})) // (2 * ({whole}))) "
            f"/ {scale}e0 END")


def _change(source: str, extra: str = "") -> str:
    size = _percent("abs(current - previous)", "previous")
    return f"""SELECT {extra}name, current, previous, change AS percentage_change,
  CASE WHEN change > 0 THEN 'UP' WHEN change < 0 THEN 'DOWN' ELSE 'FLAT' END AS direction FROM (
  SELECT *, CASE WHEN previous = 0 THEN CASE WHEN current = 0 THEN 0e0 ELSE 100e0 END
    WHEN current < previous THEN 0e0 - ({size}) ELSE {size} END AS change FROM ({source}))"""


# --- A ---

_MISSING = f"CASE WHEN {{0}} IN {_in(fixed.MISSING_TEXTS)} THEN NULL ELSE {{0}} END AS {{0}}"
ORACLE["a1_csv_source"] = _with(_RAW) + "SELECT " + ", ".join(
    _MISSING.format(c) for c in ("review", "customer_name", "contact_number", "timestamp")) + " FROM raw"
ORACLE["a1_csv_row_numbers"] = ("SELECT count(*) AS rows, 1::BIGINT AS first_row, count(*) AS last_row, "
                                "count(*) AS distinct_rows FROM orders")
ORACLE["a2_upload_preview"] = _with(_RAW) + """SELECT customer_name AS " Customer ", contact_number AS "PHONE",
  nullif(review, '') AS "Complaint", timestamp AS "Date", id::VARCHAR AS "Number" FROM raw ORDER BY id LIMIT 5"""
ORACLE["a3_jsonl_source"] = (_with(_RECORDS) + f"SELECT {', '.join(fixed.FIELDS)}, NULL::VARCHAR AS _corrupt FROM records")
ORACLE["a4_jsonl_sink"] = _with(_RECORDS) + "SELECT ticket_id, key_index::VARCHAR AS key_index FROM records"
ORACLE["a5_csv_sink"] = (_with(_RECORDS) + "SELECT " + ", ".join(
    "nullif(review, '') AS review" if f == "review" else f for f in fixed.FIELDS) + " FROM records")
ORACLE["a6_master_flatten"] = (_with(_RECORDS) + f"SELECT {', '.join(fixed.FIELDS + fixed.METADATA)} FROM records")
ORACLE["a7_ticket_append"] = _TO_TRIAGED + f"SELECT id, routing_status, {_iso('created_at')} AS created_at FROM triaged"
ORACLE["a8_upload_projection"] = (_with(_RAW) + "SELECT customer_name AS name, contact_number, review, timestamp FROM raw")

# --- B ---

ORACLE["b1_clean_reviews"] = _with(_RAW, _clean()) + "SELECT id, review FROM clean"
_FILLED = """coalesce(trim(customer_name), 'Customer #' || (id + 1)) AS customer_name,
  coalesce(trim(contact_number), '+91-XXXXXXXXXX') AS contact_number,
  coalesce(trim(timestamp), '2001-08-01T00:00:00') AS timestamp"""
ORACLE["b2_defaults"] = _with(_GAPPY) + f"SELECT id, {_FILLED} FROM gappy"
ORACLE["b3_batch_ticket_ids"] = _with(
    _RAW, "numbered AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM raw)", _clean("numbered")
) + (f"SELECT id, 'TCK-CSV-{BATCH_ID}-' || CASE WHEN rn < 1000 THEN lpad(rn::VARCHAR, 4, '0') ELSE rn::VARCHAR END "
     "AS ticket_id FROM clean")
ORACLE["b4_batch_summary"] = _TO_TRIAGED + f"""SELECT total_processed, auto_routed_count,
  total_processed - auto_routed_count AS human_review_count,
  {_percent('auto_routed_count', 'total_processed')} AS auto_routing_rate, '{BATCH_ID}' AS batch_id
  FROM (SELECT count(*) AS total_processed, count(*) FILTER (routing_status = 'AUTO_ROUTED') AS auto_routed_count FROM triaged)"""
ORACLE["b4_sample_results"] = _with(
    _GAPPY, _clean("gappy"), _LABELLED, _TERMS, _safety(fixed.CONFIDENCE_THRESHOLD)
) + f"""SELECT 'TCK-CSV-{BATCH_ID}-' || lpad((id + 1)::VARCHAR, 4, '0') AS ticket_id,
  coalesce(trim(customer_name), 'Customer #' || (id + 1)) AS customer_name, confidence, routing_status
  FROM triaged ORDER BY id LIMIT 5"""
ORACLE["b5_single_requests"] = _with(
    _GAPPY, "clean AS (SELECT * REPLACE (trim(review) AS review) FROM gappy WHERE length(review) >= 3 AND trim(review) <> '')",
    _LABELLED, _TERMS, _safety(fixed.CONFIDENCE_THRESHOLD)
) + """SELECT 'TCK-20010801-' || upper(md5(id::VARCHAR)) AS ticket_id,
  coalesce(nullif(customer_name, ''), 'Anonymous Customer') AS customer_name,
  coalesce(nullif(contact_number, ''), '+91-XXXXXXXXXX') AS contact_number,
  coalesce(nullif(timestamp, ''), '2001-08-01T00:00:00') AS timestamp, confidence, routing_status FROM triaged"""
ORACLE["b6_triage_stream"] = _TO_TRIAGED + "SELECT id, confidence, final_priority, routing_status FROM triaged"

# --- C ---

ORACLE["c1_category_rule"] = _TO_LABELS + "SELECT id, predicted_category, predicted_department FROM departed"
ORACLE["c2_priority_rule"] = _TO_LABELS + "SELECT id, predicted_priority FROM departed"
ORACLE["c3_matched_keywords"] = _TO_LABELS + "SELECT id, matched_keywords::BIGINT AS matched_keywords FROM departed"
for _letter, _name in zip("abcdef", ("base", "hits", "length", "signals", "vocabulary", "jitter")):
    ORACLE[f"c4{_letter}_{_name}_term"] = _TO_SCORES + f"SELECT id, term_{_name} FROM terms"
ORACLE["c4_confidence"] = _TO_SCORES + "SELECT id, confidence FROM scored"
ORACLE["c5_token_confidence"] = """WITH tokens AS (SELECT l_orderkey AS id, 1e0 - l_discount AS p FROM lineitem),
stats AS (SELECT id, sum(p::VARCHAR::DECIMAL(38,18))::DOUBLE / count(*) AS mean, min(p) AS low FROM tokens GROUP BY id)
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 0e0 ELSE
  floor(greatest(0e0, least(1e0, 0.75e0 * coalesce(mean, 1e0) + 0.25e0 * coalesce(low, 1e0))) * 10000e0 + 0.5e0) / 10000e0
  END AS confidence FROM orders LEFT JOIN stats ON id = o_orderkey"""


def _extracted(source: str, keep: str) -> str:
    def label(key, default):
        return f"CASE WHEN valid THEN coalesce(trim(json_extract_string(obj, '$.{key}')), '{default}') ELSE '{default}' END"

    return f"""outputs AS (SELECT *, {data.MODEL_OUTPUT} AS model_text FROM {source}),
objects AS (SELECT *, regexp_extract(model_text, '\\{{[^{{}}]*\\}}') AS obj FROM outputs),
checked AS (SELECT *, obj <> '' AND json_valid(obj) AS valid FROM objects),
extracted AS (SELECT {keep}, {label('category', 'General')} AS x_category, {label('priority', 'Medium')} AS x_priority,
  {label('department', 'General Support')} AS x_department, valid AS raw_valid FROM checked)"""


ORACLE["c6_label_extraction"] = _with(_RAW, _extracted("raw", "id")) + (
    "SELECT id, x_category AS category, x_priority AS priority, x_department AS department, raw_valid FROM extracted")
ORACLE["c7_critical_escalation"] = _with(_RAW, _clean()) + (
    f"SELECT id, r AS escalation_reason, r IS NOT NULL AS escalated FROM (SELECT id, {_REASON} AS r FROM clean)")
ORACLE["c8_high_boost"] = _TO_TRIAGED + "SELECT id, predicted_priority, final_priority FROM triaged"
ORACLE["c9_department_correction"] = _with(_PAIRS) + (
    f"SELECT category, department, {_corrected('category', 'department')} AS corrected, count(*) AS n FROM pairs GROUP BY ALL")
ORACLE["c10_routing"] = _with(_RAW, _clean(), _LABELLED, _TERMS, _safety(0.85)) + (
    "SELECT id, routing_status, confidence_passed FROM triaged")
ORACLE["c11_triage"] = _TO_TRIAGED + """SELECT id, predicted_category, predicted_priority, predicted_department, confidence,
  final_category, final_priority, final_department, routing_status, escalated, escalation_reason, raw_output,
  is_valid_json, model_version FROM triaged"""
ORACLE["c13_phone_masking"] = f"""SELECT c_custkey, CASE WHEN p IS NULL OR length(p) < 6 THEN '****'
  WHEN length(d) >= 10 THEN '+91-' || left(d, 2) || '****' || right(d, 4)
  ELSE left(p, 2) || '****' || right(p, 2) END AS masked
  FROM (SELECT c_custkey, p, regexp_replace(p, '[^0-9]', '', 'g') AS d FROM (SELECT c_custkey, {data.PHONE} AS p FROM customer))"""


def _cards(column: str) -> str:
    return f"regexp_replace({column}, {_q(fixed.CARD_PATTERN)}, '{fixed.CARD_MASK}', 'g')"


def _sanitized(column: str) -> str:
    codes = f"regexp_replace({_cards(column)}, {_q(fixed.CODE_PATTERN)}, '\\1 {fixed.CODE_MASK}', 'g')"
    return f"regexp_replace({codes}, '^\\s+|\\s+$', '', 'g')"


ORACLE["c14_card_masking"] = f"SELECT doc_id, {_cards('text')} AS masked FROM documents"
ORACLE["c15_code_masking"] = _with(_RAW, _clean()) + f"SELECT id, {_sanitized('review')} AS masked FROM clean"
ORACLE["c15_sanitized_documents"] = f"SELECT doc_id, {_sanitized('text')} AS masked FROM documents"
ORACLE["c16_rescore"] = _CURRENT + f"SELECT id, confidence, routing_status, '2001-08-01T00:00:00' AS updated_at FROM cur"

# --- D ---

ORACLE["d1_by_id"] = _CURRENT + f"SELECT {_STATE} FROM cur WHERE id = {LOOKUP_ID}"
ORACLE["d1_by_business_id"] = _CURRENT + f"SELECT {_STATE} FROM cur WHERE ticket_id = 'TCK-{LOOKUP_ID}'"
ORACLE["d2_faceted_filter"] = _CURRENT + (
    f"SELECT {_STATE} FROM cur WHERE final_category = 'Billing' AND final_priority = 'High' AND routing_status = 'AUTO_ROUTED'")
_FIND = "SELECT id, customer_name FROM cur WHERE review ILIKE '%{0}%' OR customer_name ILIKE '%{0}%' OR ticket_id ILIKE '%{0}%'"
ORACLE["d3_keyword_search"] = _CURRENT + _FIND.format(SEARCH)
ORACLE["d3_name_search"] = _CURRENT + _FIND.format("customer%7")
ORACLE["d4_page"] = _CURRENT + (f"SELECT id, {_iso('created_at')} AS created_at FROM (SELECT id, created_at FROM cur "
                                "ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40)")
ORACLE["d4_page_totals"] = _CURRENT + """SELECT count(*) AS total, 3::BIGINT AS page, 20::BIGINT AS page_size,
  greatest((count(*) + 19) // 20, 1)::BIGINT AS total_pages FROM cur WHERE final_category = 'Refund'"""
ORACLE["d5_review_queue"] = _CURRENT + f"""SELECT id, escalated, {_iso('created_at')} AS created_at FROM (
  SELECT * FROM cur WHERE {_PENDING} ORDER BY escalated DESC, created_at DESC, id DESC LIMIT 50)"""
for _name, _kind in (("d6_resolve", "resolve"), ("d7_override", "override")):
    ORACLE[_name] = _current(f"kind = '{_kind}'") + (
        f"SELECT {_STATE}, {_iso('reviewed_at')} AS reviewed_at, {_iso('updated_at')} AS updated_at FROM cur")
ORACLE["d8_pass_all"] = _CURRENT + f"""SELECT id, final_category, final_priority, final_department,
  CASE WHEN {_PENDING} THEN 'RESOLVED' ELSE routing_status END AS routing_status,
  is_reviewed OR ({_PENDING}) AS is_reviewed,
  CASE WHEN {_PENDING} THEN {_q(fixed.PASS_ALL_NOTE)} ELSE reviewer_notes END AS reviewer_notes,
  CASE WHEN {_PENDING} THEN '2001-08-01T00:00:00' ELSE {_iso('reviewed_at')} END AS reviewed_at FROM cur"""
ORACLE["d8_pass_all_count"] = _CURRENT + f"SELECT count(*) AS resolved_count FROM cur WHERE {_PENDING}"
ORACLE["d9_delete_pending"] = _CURRENT + f"SELECT {_STATE} FROM cur WHERE NOT ({_PENDING})"
ORACLE["d9_deleted_count"] = _CURRENT + f"SELECT count(*) AS deleted_count FROM cur WHERE {_PENDING}"
ORACLE["d10_delete_all"] = _with(_RAW, _clean()) + "SELECT count(*) AS deleted_count FROM clean"
ORACLE["d11_response"] = _CURRENT + f"""SELECT ticket_id, customer_name, review, confidence, {_iso('created_at')} AS created_at,
  {_iso('updated_at')} AS updated_at, {_iso('reviewed_at')} AS reviewed_at FROM cur"""

_AS_STATE = "sid AS id, ticket_id, final_category, final_priority, final_department"
ORACLE["d12_ticket_table"] = _current("kind = 'resolve'") + f""",
a AS (SELECT *, row_number() OVER (ORDER BY id) AS sid FROM cur WHERE id % 2 = 0),
b AS (SELECT *, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY id) AS sid FROM triaged WHERE id % 2 = 1)
SELECT {_AS_STATE}, CASE WHEN {_PENDING} THEN 'RESOLVED' ELSE routing_status END AS routing_status,
  is_reviewed OR ({_PENDING}) AS is_reviewed, CASE WHEN {_PENDING} THEN {_q(fixed.PASS_ALL_NOTE)} ELSE reviewer_notes END AS reviewer_notes FROM a
UNION ALL SELECT {_AS_STATE}, routing_status, false, NULL FROM b WHERE routing_status <> 'HUMAN_REVIEW'"""
ORACLE["d12_compacted_table"] = ORACLE["d12_ticket_table"]
ORACLE["d1_snapshot_lookup"] = ORACLE["d1_by_business_id"]
ORACLE["d2_snapshot_filter"] = ORACLE["d2_faceted_filter"]
ORACLE["d3_indexed_search"] = ORACLE["d3_keyword_search"]
ORACLE["d3_indexed_name_search"] = ORACLE["d3_name_search"]
ORACLE["d5_snapshot_queue"] = ORACLE["d5_review_queue"]
ORACLE["b6_stream_into_table"] = _TO_TRIAGED + f"""SELECT row_number() OVER (ORDER BY id) AS id, ticket_id,
  {_q(fixed.UNKNOWN_CUSTOMER)} AS customer_name, confidence, final_priority, routing_status FROM triaged WHERE length(review) >= 3"""
ORACLE["b6_stream_without_ids"] = _TO_TRIAGED + """SELECT review, routing_status, count(*) AS tickets, count(*) AS ids
FROM triaged WHERE length(review) >= 3 GROUP BY review, routing_status"""
ORACLE["b6_stream_refused"] = _TO_TRIAGED + """, named AS (SELECT triaged.*, 'C-' || o_custkey AS customer FROM triaged JOIN orders ON id = o_orderkey
  WHERE length(review) >= 3)
SELECT customer AS ticket_id, 1::BIGINT AS tickets, count(*) - 1 AS refused FROM named GROUP BY customer"""
ORACLE["a7_unique_append"] = _TO_TRIAGED + """SELECT ticket_id, routing_status, CASE WHEN id % 4 IN (1, 2) THEN 1 ELSE 0 END::BIGINT AS refused
FROM triaged"""

# --- E ---

_KPI = f"""count(*) AS total_tickets, count(*) FILTER (routing_status = 'AUTO_ROUTED') AS auto_routed_count,
  count(*) FILTER ({_PENDING}) AS human_review_count,
  count(*) FILTER (routing_status = 'RESOLVED' OR is_reviewed) AS resolved_review_count"""
_AVG = ("CASE WHEN n = 0 THEN 0e0 ELSE ((s * 2 + n * 10) // (n * 20)) / 1000e0 END")
_CONF = "count(*) AS n, sum(round(confidence * 10000)::BIGINT)::BIGINT AS s"
ORACLE["e1_kpi_counts"] = _CURRENT + f"SELECT {_KPI} FROM cur"
ORACLE["e2_routing_rate"] = _CURRENT + (
    f"SELECT {_percent('auto_routed_count', 'total_tickets')} AS auto_routing_rate FROM (SELECT {_KPI} FROM cur)")
ORACLE["e3_average_confidence"] = _CURRENT + f"SELECT {_AVG} AS avg_confidence FROM (SELECT {_CONF} FROM cur)"
_GROUPS = {"category": fixed.CATEGORIES, "priority": fixed.PRIORITIES, "department": fixed.DEPARTMENTS}
for _number, (_group, _labels) in zip((4, 5, 6), _GROUPS.items()):
    _values = ", ".join(f"({_q(v)})" for v in _labels)
    ORACLE[f"e{_number}_{_group}_breakdown"] = _CURRENT + (
        f"SELECT name, count(id) AS tickets FROM (VALUES {_values}) v(name) "
        f"LEFT JOIN cur ON final_{_group} = name GROUP BY name")
_COUNTED = ", ".join(
    [f"count(*) FILTER (final_priority = '{p}') AS {p.lower()}_count" for p in fixed.PRIORITIES]
    + [f"count(*) FILTER (final_{g} = '{v}') AS {g}_{v.lower().replace(' ', '_')}"
       for g in ("category", "department") for v in _GROUPS[g]])
ORACLE["e6_summary"] = _CURRENT + f"""SELECT * EXCLUDE (n, s), {_percent('auto_routed_count', 'total_tickets')} AS auto_routing_rate,
  {_AVG} AS avg_confidence FROM (SELECT {_KPI}, {_CONF}, {_COUNTED} FROM cur)"""
ORACLE["e6_snapshot_summary"] = ORACLE["e6_summary"]
ORACLE["e7_percentage_change"] = _change("""SELECT o_custkey AS name,
  count(*) FILTER (o_orderdate >= TIMESTAMP '2000-01-01') AS current,
  count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS previous FROM orders GROUP BY o_custkey"""
                                         ).replace("SELECT name,", "SELECT name AS customer,", 1)


def _trend(source: str, moment: str, as_of: str, days: int, items: list[tuple[str, str]], extra: str = "") -> str:
    now = f"TIMESTAMP '{as_of}'"
    current = f"{moment} >= {now} - INTERVAL {days} DAY AND {moment} <= {now}"
    previous = f"{moment} >= {now} - INTERVAL {2 * days} DAY AND {moment} < {now} - INTERVAL {days} DAY"
    return " UNION ALL ".join(
        f"SELECT {extra}{_q(name)} AS name, count(*) FILTER ({current} AND ({condition})) AS current, "
        f"count(*) FILTER ({previous} AND ({condition})) AS previous FROM {source}" for name, condition in items)


_SUMMARY_ITEMS = [("Total Volume", "true"), ("Auto-Routed", "routing_status = 'AUTO_ROUTED'"),
                  ("Review Queue", "routing_status = 'HUMAN_REVIEW'")]


def _label_items(column: str, labels) -> list[tuple[str, str]]:
    return [(label, f"{column} = {_q(label)}") for label in labels]


ORACLE["e8_summary_trends"] = _CURRENT + _change(_trend("cur", "created_at", data.AS_OF, 7, _SUMMARY_ITEMS))
for _number, _group in ((9, "category"), (10, "priority"), (11, "department")):
    ORACLE[f"e{_number}_{_group}_trends"] = _CURRENT + _change(
        _trend("cur", "created_at", data.AS_OF, 30, _label_items(f"final_{_group}", _GROUPS[_group])))
ORACLE["e9_event_trends"] = _change(_trend(
    "events", "ts", data.EVENTS_AS_OF, 7, _label_items("event_type", ["click", "view", "purchase", "error", "signup"])))
ORACLE["e11_all_trends"] = _CURRENT + _change(" UNION ALL ".join(
    [_trend("cur", "created_at", data.AS_OF, 30, _SUMMARY_ITEMS, "'summary' AS grp, ")]
    + [_trend("cur", "created_at", data.AS_OF, 30, _label_items(f"final_{g}", v), f"'{g}' AS grp, ")
       for g, v in _GROUPS.items()]), 'grp AS "group", ')
ORACLE["e11_trends_from_cube"] = ORACLE["e11_all_trends"]
ORACLE["e12_live_kpis"] = _TO_TRIAGED + """SELECT routing_status, final_category, final_priority, final_department,
  count(*) AS tickets FROM triaged GROUP BY ALL"""
ORACLE["e12_live_review_kpis"] = _CURRENT + f"SELECT {_KPI} FROM cur WHERE id % 13 <> 0"

# --- F ---


def _sets(source: str, key: str, extra: str = "") -> str:
    return f"""worded AS (SELECT {key}, {extra} list_filter(regexp_split_to_array(
  regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS words FROM {source}),
sets AS (SELECT *, list_distinct(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
  ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS s FROM worded)"""


ORACLE["f1_normalised_words"] = _with(_sets("documents", "doc_id")) + (
    "SELECT doc_id, array_to_string(words, ' ') AS words, len(words) AS n_words FROM sets")
ORACLE["f2_shingles"] = _with(_sets("documents", "doc_id")) + (
    "SELECT doc_id, len(s) AS n_shingles, md5(array_to_string(list_sort(s), '|')) AS digest FROM sets")
ORACLE["f3_jaccard"] = _with(_sets("conversations", "conv_id, turn")) + """SELECT a.conv_id, a.turn,
  len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) AS jaccard
  FROM sets a JOIN sets b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1"""

# Greedy scan over the rows that have an earlier similar row, in order. Every other row is kept.
_GREEDY = "WITH RECURSIVE " + _sets("documents", "doc_id", "lang,") + """,
each AS (SELECT doc_id, lang, len(s) AS n, unnest(s) AS sh FROM sets),
common AS (SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS ni, any_value(b.n) AS nj, count(*) AS c
  FROM each a JOIN each b ON a.sh = b.sh AND a.lang = b.lang AND a.doc_id < b.doc_id GROUP BY 1, 2),
edges AS (SELECT i, j, c / (ni + nj - c) AS jaccard FROM common WHERE 100 * c >= 85 * (ni + nj - c)),
late AS (SELECT j, list(i) AS earlier, row_number() OVER (ORDER BY j) AS k FROM edges GROUP BY j),
scan(k, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
  SELECT l.k, CASE WHEN len(list_filter(l.earlier, lambda x: NOT list_contains(scan.gone, x))) > 0
    THEN list_append(scan.gone, l.j) ELSE scan.gone END FROM scan JOIN late l ON l.k = scan.k + 1),
gone AS (SELECT unnest(gone) AS doc_id FROM (SELECT gone FROM scan ORDER BY k DESC LIMIT 1))
"""
ORACLE["f4_near_duplicate_matches"] = _GREEDY + """SELECT j AS dropped_id, min(i) AS kept_id, arg_min(jaccard, i) AS jaccard
  FROM edges WHERE j IN (SELECT doc_id FROM gone) AND i NOT IN (SELECT doc_id FROM gone) GROUP BY j"""
ORACLE["f5_near_dedup"] = _GREEDY + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM gone)"


def _field(name: str) -> str:
    return f"CASE WHEN json_type(line, '$.fields.{name}') = 'VARCHAR' THEN json_extract_string(line, '$.fields.{name}') END"


def _checked_sql() -> str:
    parsed = ", ".join(f"CASE WHEN ok THEN {_field(f)} END AS p_{f}" for f in fixed.FIELDS)
    reasons = ["CASE WHEN NOT ok THEN 'not json' END"]
    reasons += [f"CASE WHEN ok AND p_{f} IS NULL THEN '{f}: string required' END" for f in fixed.FIELDS]
    reasons += [f"CASE WHEN p_{g} NOT IN {_in(v)} THEN '{g}: unknown value' END" for g, v in _GROUPS.items()]
    reasons += ["CASE WHEN length(p_review) < 5 THEN 'review: too short' END",
                f"CASE WHEN length(p_review) >= 5 AND lower(trim(p_review)) IN {_in(fixed.PLACEHOLDERS)} THEN 'review: placeholder' END"]
    allowed = " OR ".join(
        f"(p_category = {_q(c)} AND p_department IN {_in([d] + fixed.CROSS_DEPARTMENTS.get(c, []))})"
        for c, d in fixed.DEFAULT_DEPARTMENT.items())
    return f"""parsed_ok AS (SELECT line_no, line, json_valid(line) AS ok FROM lines),
parsed AS (SELECT line_no, ok, {parsed}, CASE WHEN ok THEN json_extract_string(line, '$.metadata.difficulty') END AS p_difficulty FROM parsed_ok),
ruled AS (SELECT *, list_filter([{', '.join(reasons)}], lambda r: r IS NOT NULL) AS why, ({allowed}) AS usual FROM parsed),
checked AS (SELECT *, len(why) = 0 AS valid, NOT coalesce(usual, false) AS suspicious FROM ruled)"""


_CHECKED = _with(_RAW, _LINES, _checked_sql())
ORACLE["f6_validation"] = _CHECKED + "SELECT line_no, valid, array_to_string(why, '; ') AS reasons FROM checked"
_USUAL = " OR ".join(f"(category = {_q(c)} AND department IN {_in([d] + fixed.CROSS_DEPARTMENTS.get(c, []))})"
                     for c, d in fixed.DEFAULT_DEPARTMENT.items())
ORACLE["f7_department_legitimacy"] = _with(_PAIRS) + (
    f"SELECT category, department, NOT ({_USUAL}) AS suspicious, count(*) AS n FROM pairs GROUP BY ALL")
ORACLE["f8_distribution"] = _CHECKED + f"""SELECT attribute, value, tickets, {_percent('tickets', 'total')} AS percent FROM (
  SELECT *, sum(tickets) OVER (PARTITION BY attribute)::BIGINT AS total FROM (
  """ + " UNION ALL ".join(f"SELECT '{a}' AS attribute, p_{a} AS value, count(*) AS tickets FROM checked WHERE valid GROUP BY p_{a}"
                           for a in ("category", "priority", "department", "difficulty")) + "))"
ORACLE["f8_totals"] = _CHECKED + """SELECT count(*) AS loaded, count(*) FILTER (valid) AS valid,
  count(*) FILTER (NOT valid) AS malformed, count(*) FILTER (valid AND suspicious) AS suspicious FROM checked"""
ORACLE["f9_exception_samples"] = _CHECKED + """(SELECT 'suspicious' AS kind, line_no,
  p_ticket_id || ': ' || p_category || ' -> ' || p_department AS detail FROM checked WHERE valid AND suspicious ORDER BY line_no LIMIT 20)
  UNION ALL (SELECT 'malformed', line_no, substr(array_to_string(why, '; '), 1, 150) FROM checked WHERE NOT valid ORDER BY line_no LIMIT 20)"""
_COMBOS = "combos AS (SELECT category, priority, department, count(*) AS tickets FROM raw GROUP BY ALL)"
ORACLE["f10_combinations"] = _with(_RAW, _COMBOS) + "SELECT * FROM combos"
ORACLE["f11_imbalance"] = _with(_RAW, _COMBOS) + """SELECT count(*) AS combinations, min(tickets) AS smallest, max(tickets) AS largest,
  max(tickets) / min(tickets) AS ratio, max(tickets) / min(tickets) > 10 AS severe FROM combos"""
ORACLE["f12_duplicate_ids"] = "SELECT conv_id, count(*) AS occurrences FROM conversations GROUP BY conv_id HAVING count(*) > 1"
ORACLE["f12_id_totals"] = """SELECT sum(n)::BIGINT AS total_rows, count(*) AS unique_ids, count(*) FILTER (n > 1) AS duplicate_ids
  FROM (SELECT count(*) AS n FROM conversations GROUP BY conv_id)"""
ORACLE["f13_sequence_gaps"] = """SELECT min(g) AS first_missing, max(g) AS last_missing FROM (
  SELECT g, g - row_number() OVER (ORDER BY g) AS run FROM range(1, (SELECT max(l_orderkey) + 1 FROM lineitem)) r(g)
  WHERE g NOT IN (SELECT l_orderkey FROM lineitem)) GROUP BY run"""
ORACLE["f13_sequence_totals"] = """SELECT min(l_orderkey) AS min_number, max(l_orderkey) AS max_number,
  max(l_orderkey) - count(DISTINCT l_orderkey) FILTER (l_orderkey > 0) AS missing_count FROM lineitem"""
ORACLE["f13_unreadable_numbers"] = "SELECT 'TCK-' || lpad(l_orderkey::VARCHAR, 39, '9') AS ticket_id FROM lineitem WHERE l_partkey % 7 = 0"
ORACLE["f14_keep_first"] = """SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn
  FROM conversations) WHERE rn = 1"""
ORACLE["f15_progress"] = _with(_RECORDS) + """SELECT max(id) AS next_index, count(*) AS accepted, 0::BIGINT AS rejected,
  arg_max(generation_batch, id) AS batch_id FROM records"""
_LACKING = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN coalesce({f}, '') = '' THEN '{f}' END" for f in fixed.FIELDS) + "], lambda x: x IS NOT NULL), ',')"
ORACLE["f16_completeness"] = _with(_GAPPY) + f"SELECT id, {_LACKING} AS missing FROM gappy"
ORACLE["f16_complete_rows"] = _with(_GAPPY) + f"SELECT id FROM gappy WHERE {_LACKING} = ''"

# --- G ---

_FUTURE, _TEST = Fraction(fixed.FUTURE_SHARE), Fraction(fixed.TEST_SHARE)


def _quota(source: str, key: str, stratum: str, top: int, bottom: int) -> str:
    return f"""strata AS (SELECT {stratum} AS stratum, count(*) AS n FROM {source} GROUP BY 1),
shares AS (SELECT *, n * {top} // {bottom} AS base, n * {top} % {bottom} AS rest,
  (sum(n) OVER () * {top} + {bottom - 1}) // {bottom} AS wanted FROM strata),
quotas AS (SELECT stratum, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, stratum) <= wanted - sum(base) OVER ()
  THEN 1 ELSE 0 END AS quota FROM shares),
placed AS (SELECT {key}, {stratum} AS stratum, row_number() OVER (PARTITION BY {stratum}
  ORDER BY md5({key}::VARCHAR || ':{SEED}:'), {key}) AS rn FROM {source})
SELECT {key} FROM placed JOIN quotas USING (stratum) WHERE rn <= quota"""


ORACLE["g1_stratified_split"] = "WITH " + _quota("documents", "doc_id", "lang || '|' || source", 3, 10)
ORACLE["g1_ticket_split"] = "WITH " + ", ".join((_RAW, _clean())) + ", " + _quota(
    "clean", "id", "category || '|' || priority || '|' || department", 1, 10)
ORACLE["g2_stratum_fallback"] = "WITH " + _quota("documents", "doc_id", "lang", 3, 10)
ORACLE["g3_leakage_removal"] = _with(_sets("documents", "doc_id"), """each AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh,
  doc_id IN (SELECT doc_id FROM labels) AS in_base FROM sets),
near AS (SELECT b.doc_id FROM each a JOIN each b ON a.sh = b.sh AND a.in_base AND NOT b.in_base
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*)))""") + """SELECT doc_id FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT doc_id FROM near)"""
ORACLE["g5_rows_with_ids"] = _with(_RECORDS) + """SELECT ticket_id, review, difficulty, scenario_type FROM records
  WHERE id IN (SELECT l_orderkey FROM lineitem)"""
ORACLE["g6_edge_cases"] = _with(_RAW) + "SELECT ticket_id, difficulty FROM raw WHERE difficulty IN ('hard', 'ambiguous')"
ORACLE["g4_split_invariants"] = f"""SELECT (count(*) * {_FUTURE.numerator} + {_FUTURE.denominator - 1}) // {_FUTURE.denominator} AS future_rows,
  0::BIGINT AS repeated_rows, 0::BIGINT AS foreign_rows, 0::BIGINT AS near_future, 0::BIGINT AS near_train FROM documents"""
ORACLE["g7_priority_stress"] = _with(_RAW) + f"""SELECT ticket_id, priority FROM (SELECT *,
  row_number() OVER (PARTITION BY priority ORDER BY md5(ticket_id || ':{SEED}:'), ticket_id) AS rn,
  count(*) FILTER (priority = 'Critical') OVER () AS critical FROM raw)
  WHERE priority = 'Critical' OR (priority = 'High' AND rn <= greatest(10, critical))"""
ORACLE["g8_review_simulation"] = _with(_RAW) + (
    f"SELECT ticket_id FROM raw ORDER BY md5(ticket_id || ':{SEED}:review'), ticket_id LIMIT 50")
ORACLE["g9_demo_set"] = _with(_RAW) + (
    f"SELECT ticket_id, difficulty FROM raw WHERE difficulty = 'easy' ORDER BY md5(ticket_id || ':{SEED}:demo'), ticket_id LIMIT 15")
ORACLE["g10_chat_examples"] = _with(_RAW, _clean()) + f"""SELECT ticket_id, 'system,user,assistant' AS roles,
  {_q(fixed.SYSTEM_PROMPT)} || chr(10) || review || chr(10) || '{{"category": "' || category || '", "priority": "' || priority
  || '", "department": "' || department || '"}}' AS contents, 2::BIGINT AS prompt_length FROM clean"""

ORACLE["c12_classifier_check"] = _with(_RAW, _clean()) + f"""SELECT (count(*) * {_TEST.numerator} + {_TEST.denominator - 1}) // {_TEST.denominator} AS scored,
  0::BIGINT AS unknown_labels, 0::BIGINT AS odd_confidences, true AS beats_commonest FROM clean"""

# --- H ---

_PREDICTIONS = _with(_RAW, _clean(), _LABELLED, _TERMS, _extracted("scored", "id, category, priority, department, confidence"),
                     """preds AS (SELECT id, category AS true_category, priority AS true_priority, department AS true_department,
  x_category AS pred_category, x_priority AS pred_priority, x_department AS pred_department, confidence, raw_valid FROM extracted)""")


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0e0 ELSE {part} / {whole} END"


ORACLE["h1_accuracy"] = _PREDICTIONS + " UNION ALL ".join(
    f"SELECT '{g}' AS task, count(*) FILTER (true_{g} = pred_{g}) / count(*) AS accuracy FROM preds" for g in _GROUPS)
_PER_LABEL = " UNION ALL ".join(
    f"SELECT '{g}' AS task, {_q(v)} AS label, count(*) FILTER (true_{g} = {_q(v)} AND pred_{g} = {_q(v)}) AS hit, "
    f"count(*) FILTER (pred_{g} = {_q(v)}) AS np, count(*) FILTER (true_{g} = {_q(v)}) AS nt FROM preds"
    for g, labels in _GROUPS.items() for v in labels)
_REPORT = f"""SELECT task, label, {_ratio('hit', 'np')} AS precision, {_ratio('hit', 'nt')} AS recall,
  {_ratio('2 * hit', '(np + nt)')} AS f1, nt AS support FROM ({_PER_LABEL})"""
ORACLE["h3_class_report"] = _PREDICTIONS + _REPORT


def _macro(column: str) -> str:
    return f"floor((sum({column}) / count(*)) * 1e8 + 0.5e0) / 1e8"


ORACLE["h2_macro_scores"] = _PREDICTIONS + f"""SELECT task, {_macro('precision')} AS macro_precision,
  {_macro('recall')} AS macro_recall, {_macro('f1')} AS macro_f1 FROM ({_REPORT}) GROUP BY task"""
for _group, _labels in _GROUPS.items():
    _cells = ", ".join(f"count(*) FILTER (pred_{_group} = {_q(v)}) AS pred_{v.lower().replace(' ', '_')}" for v in _labels)
    ORACLE[f"h4_confusion_{_group}"] = _PREDICTIONS + (
        f"SELECT v.l AS true_label, {_cells} FROM (VALUES " + ", ".join(f"({_q(v)})" for v in _labels)
        + f") v(l) LEFT JOIN preds ON true_{_group} = v.l GROUP BY v.l")
ORACLE["h5_critical_failures"] = _PREDICTIONS + """SELECT count(*) AS critical_total,
  count(*) FILTER (pred_priority IN ('Low', 'Medium')) AS underestimated,
  CASE WHEN count(*) = 0 THEN 0e0 ELSE count(*) FILTER (pred_priority = 'Critical') / count(*) END AS critical_recall
  FROM preds WHERE true_priority = 'Critical'"""
ORACLE["h6_validity_summary"] = _PREDICTIONS + f"""SELECT n AS tickets, valid, {_percent('valid', 'n')} AS valid_rate,
  {_AVG} AS avg_confidence FROM (SELECT {_CONF}, count(*) FILTER (raw_valid) AS valid FROM preds)"""


def _share(condition: str) -> str:
    return f"CASE WHEN na = 0 THEN 0e0 ELSE {condition} / na END * 100"


_SWEEP = f"""SELECT t AS threshold, na AS auto_routed_count, n - na AS review_count, na / n * 100 AS auto_routing_rate,
  (n - na) / n * 100 AS review_rate, {_share('nc')} AS auto_category_acc, {_share('np')} AS auto_priority_acc,
  {_share('nd')} AS auto_dept_acc, {_share('nf')} AS auto_full_match_acc, ne AS critical_errors_auto_routed FROM (
  SELECT t, count(*) AS n, count(*) FILTER (a) AS na, count(*) FILTER (a AND c) AS nc, count(*) FILTER (a AND p) AS np,
    count(*) FILTER (a AND d) AS nd, count(*) FILTER (a AND c AND p AND d) AS nf,
    count(*) FILTER (a AND true_priority = 'Critical' AND pred_priority <> 'Critical') AS ne FROM (
    SELECT t, confidence >= t AND raw_valid AS a, true_category = pred_category AS c, true_priority = pred_priority AS p,
      true_department = pred_department AS d, true_priority, pred_priority
    FROM preds, (VALUES {', '.join(f'({_num(t)})' for t in fixed.SWEEP_THRESHOLDS)}) v(t)) GROUP BY t)"""
ORACLE["h7_threshold_sweep"] = _PREDICTIONS + _SWEEP
ORACLE["h8_recommended_threshold"] = _PREDICTIONS + f"""SELECT * FROM ({_SWEEP}) ORDER BY critical_errors_auto_routed = 0 DESC,
  CASE WHEN critical_errors_auto_routed = 0 THEN auto_routing_rate END DESC,
  CASE WHEN critical_errors_auto_routed = 0 THEN threshold ELSE 0e0 - threshold END LIMIT 1"""
_ESCAPE = "priority = 'Critical' AND final_priority IN ('Low', 'Medium') AND routing_status = 'AUTO_ROUTED'"
ORACLE["h9_final_label_evaluation"] = _TO_TRIAGED + f"""SELECT n AS total, {_percent('c', 'n', 2)} AS cat_acc, {_percent('p', 'n', 2)} AS pri_acc,
  {_percent('d', 'n', 2)} AS dept_acc, {_percent('a', 'n', 2)} AS auto_rate, n - a AS human_review_count, e AS critical_escapes FROM (
  SELECT count(*) AS n, count(*) FILTER (final_category = category) AS c, count(*) FILTER (final_priority = priority) AS p,
    count(*) FILTER (final_department = department) AS d, count(*) FILTER (routing_status = 'AUTO_ROUTED') AS a,
    count(*) FILTER ({_ESCAPE}) AS e FROM triaged)"""
ORACLE["h10_critical_escapes"] = _TO_TRIAGED + f"SELECT id, final_priority FROM triaged WHERE {_ESCAPE}"
ORACLE["h11_latency_profile"] = """SELECT n AS samples, m AS mean_ms, p50 AS p50_ms, p95 AS p95_ms, p99 AS p99_ms,
  CASE WHEN m > 0 THEN floor(1000e0 / m * 10e0 + 0.5e0) / 10e0 ELSE 0e0 END AS throughput FROM (
  SELECT count(value) AS n, printf('%.11e', fsum(value) / count(value))::DOUBLE AS m, quantile_cont(value, 0.50) AS p50,
    quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events)"""

# --- I ---


def _draw(column: str, slot: int) -> str:
    return f"('0x' || substr({column}, {8 * slot + 1}, 8))::UBIGINT::HUGEINT"


def _weighted(number: str, weights: dict[str, int]) -> str:
    upper, whens, items = 0, "", [(k, w) for k, w in weights.items() if w > 0]
    for label, weight in items:
        upper += weight
        whens += f" WHEN {number} * 100 < {upper} * 4294967296::HUGEINT THEN {_q(label)}"
    return f"CASE{whens} END"


def _pick(number: str, values) -> str:
    return f"{_list(values)}[({number} * {len(values)} // 4294967296)::INT + 1]"


_CATEGORY_DRAW = _weighted(_draw("da", 0), fixed.CATEGORY_WEIGHTS)
_PLAN = f"""digests AS (SELECT o_orderkey AS plan_id, md5(o_orderkey::VARCHAR || ':{SEED}:a') AS da,
  md5(o_orderkey::VARCHAR || ':{SEED}:b') AS db FROM orders),
drawn AS (SELECT *, {_CATEGORY_DRAW} AS category FROM digests),
plan AS (SELECT plan_id, category,
  {_map_case('category', {c: _weighted(_draw('da', 1), w) for c, w in fixed.PRIORITY_WEIGHTS.items()})} AS priority,
  CASE WHEN {_draw('db', 0)} * 100 < {fixed.CROSS_DEPARTMENT_PERCENT} * 4294967296::HUGEINT AND category IN {_in(fixed.CROSS_DEPARTMENTS)}
    THEN {_map_case('category', {c: _pick(_draw('db', 1), v) for c, v in fixed.CROSS_DEPARTMENTS.items()})}
    ELSE {_map_case('category', {c: _q(v) for c, v in fixed.DEFAULT_DEPARTMENT.items()})} END AS department,
  {_map_case('category', {c: _pick(_draw('da', 2), v) for c, v in fixed.SCENARIOS.items()})} AS scenario,
  {_weighted(_draw('da', 3), fixed.DIFFICULTY_WEIGHTS)} AS difficulty, substr(db, 17, 16) AS shuffle_key FROM drawn)"""
ORACLE["i1_scenario_plan"] = _with(_PLAN) + "SELECT * FROM plan"
ORACLE["i2_plan_summary"] = _with(_PLAN) + " UNION ALL ".join(
    ["SELECT 'total' AS attribute, 'all' AS value, count(*) AS tickets FROM plan"]
    + [f"SELECT '{a}', {a}, count(*) FROM plan GROUP BY {a}" for a in ("category", "priority", "department", "difficulty")])
ORACLE["i3_synthetic_customers"] = f"""WITH digests AS (SELECT o_orderkey AS plan_id, md5(o_orderkey::VARCHAR || ':{SEED}:c') AS dc,
  md5(o_orderkey::VARCHAR || ':{SEED}:d') AS dd FROM orders)
SELECT plan_id, {_pick(_draw('dc', 0), fixed.FIRST_NAMES)} || ' ' || {_pick(_draw('dc', 1), fixed.LAST_NAMES)} AS customer_name,
  '+91' || {_pick(_draw('dc', 2), fixed.PHONE_PREFIXES)} || lpad(({_draw('dc', 3)} * 100000000 // 4294967296)::VARCHAR, 8, '0') AS contact_number,
  strftime(TIMESTAMP '{data.AS_OF}' - to_days(({_draw('dd', 0)} * 181 // 4294967296)::INT)
    - to_hours(({_draw('dd', 1)} * 24 // 4294967296)::INT), '%Y-%m-%dT%H:%M:%S') AS timestamp FROM digests"""
_TOPUP = _with(_RAW, _COMBOS, f"""targets AS (SELECT category, priority, department,
  (SELECT ceil(sum(tickets) / count(*)) FROM combos)::BIGINT - tickets AS n FROM combos),
items AS (SELECT category, priority, department, unnest(range(1, n + 1)) AS item FROM targets WHERE n > 0),
drawn AS (SELECT *, md5(category || '|' || priority || '|' || department || '|' || item::VARCHAR || ':{SEED}:topup') AS d FROM items),
topup AS (SELECT category, priority, department, item,
  {_map_case('category', {c: _pick(_draw('d', 0), v) for c, v in fixed.SCENARIOS.items()})} AS scenario,
  {_weighted(_draw('d', 1), fixed.DIFFICULTY_WEIGHTS)} AS difficulty FROM drawn)""")
ORACLE["i4_topup_plan"] = _TOPUP + "SELECT * FROM topup"
_INSTRUCTION = _map_case("difficulty", {k: _q(v) for k, v in fixed.DIFFICULTY_INSTRUCTIONS.items()})
_USER = _q(fixed.GENERATION_USER_PROMPT)
for _column in ("scenario", "category", "priority", "department", "difficulty"):
    _USER = f"replace({_USER}, '{{{_column}}}', {_column})"
_USER = f"replace({_USER}, '{{instruction}}', {_INSTRUCTION})"
ORACLE["i5_prompts"] = _with(_PLAN) + (
    f"SELECT plan_id, {_q(fixed.GENERATION_SYSTEM_PROMPT)} AS system_prompt, {_USER} AS user_prompt FROM plan")
_TOPUP_USER = _USER.replace("Target department: {department}", "Target department: {department}" + fixed.TOPUP_DEPARTMENT_NOTE)
ORACLE["i5_topup_prompts"] = _TOPUP + f"SELECT category, priority, department, item, {_TOPUP_USER} AS user_prompt FROM topup"
ORACLE["i6_manifest"] = _CHECKED + f"""SELECT 'v1.0' AS dataset_version, '{BATCH_ID}' AS batch_id, {SEED}::BIGINT AS seed,
  count(*) AS target_size, count(*) FILTER (valid) AS accepted, count(*) FILTER (NOT valid) AS rejected FROM checked"""
