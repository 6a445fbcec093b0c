"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import filter_audit, line_dedup, quality_rules, url_rules

SPACES = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE: dict[str, str] = {}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _url_sql() -> str:
    rules = ", ".join(f"({_text(r.name)}, {_text(r.host)}, {_text(r.path)}, {_text(r.verdict)})" for r in url_rules.HOST_RULES)
    patterns = ", ".join(f"({_text(p.text)}, {_text('(^|[^a-z0-9])' + p.text.replace('*', '.*') + '([^a-z0-9]|$)')}, {rank})"
                         for rank, p in enumerate(url_rules.PATTERNS, 1))
    return f"""
    WITH rules(rule, rhost, rpath, rverdict) AS (VALUES {rules}),
    patterns(pattern, regex, place) AS (VALUES {patterns}),
    rest AS (SELECT page_id, row_number() OVER () AS r,
                    coalesce(regexp_extract(url, '(?s)^.*?://([^#?]*)', 1), '') AS rest FROM pages),
    address AS (SELECT page_id, r, translate(split_part(rest, '/', 1), '{UPPER}', '{LOWER}') AS host,
                       substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM rest),
    fit AS (SELECT r, arg_max(rule, (length(rule), length(rhost))) AS rule,
                   arg_max(rverdict, (length(rule), length(rhost))) AS rverdict
            FROM address JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
            GROUP BY r),
    bad AS (SELECT r, arg_max(pattern, place) AS pattern FROM address JOIN patterns
            ON regexp_matches(translate(host || path, '{UPPER}', '{LOWER}'), regex) GROUP BY r)
    SELECT page_id, host, path, rule,
           coalesce(rverdict, CASE WHEN pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, pattern
    FROM address LEFT JOIN fit USING (r) LEFT JOIN bad USING (r)
    """


def _quality_sql() -> str:
    stop = ", ".join(_text(w) for word in quality_rules.STOP_WORDS for w in (word, word.capitalize()))
    tests = []
    for t in quality_rules.THRESHOLDS:
        if t.low is not None:
            tests.append(f"{t.numerator} >= {t.low}::DOUBLE * {t.denominator}")
        if t.high is not None:
            tests.append(f"{t.numerator} <= {t.high}::DOUBLE * {t.denominator}")
    symbols = "[" + quality_rules.SYMBOLS.replace("$", r"\$") + "]"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    split AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                     list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
    windows AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS gram
                FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM split)),
    twice AS (SELECT r, gram FROM windows GROUP BY r, gram HAVING count(*) > 1),
    covered AS (SELECT r, count(DISTINCT i + k) AS n FROM windows JOIN twice USING (r, gram),
                       (SELECT unnest(range(0, 8)) AS k) GROUP BY r),
    counted AS (SELECT doc_id, len(words)::BIGINT AS n_words,
                       coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
                       len(regexp_extract_all(text, '{symbols}'))::BIGINT AS n_symbols,
                       (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
                       coalesce(n, 0)::BIGINT AS n_repeat_words,
                       len(list_filter(words, lambda w: w IN ({stop}))) AS n_stop_words, len(lines) AS n_lines
                FROM split LEFT JOIN covered USING (r)),
    base AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {" AND ".join(tests)} AS kept FROM base
    """


def line_dedup_sql(documents: str) -> str:
    """(doc_id, r, n_lines, n_dropped, kept): r numbers the rows of ``documents``."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM {documents}),
    lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line,
                     generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
    keyed AS (SELECT *, translate(regexp_replace(line, '^{SPACES}+|{SPACES}+$', '', 'g'), '{UPPER}', '{LOWER}') AS k
              FROM lines),
    repeated AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= {line_dedup.MIN_CHARS}
                 GROUP BY k HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCUMENTS})
    SELECT r, any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines,
           count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper)::BIGINT AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '') AS kept
    FROM keyed LEFT JOIN repeated USING (k) GROUP BY r
    """


def filter_audit_sql(documents: str, labels: str) -> str:
    """Every order of the filters is applied to the documents, counted by part and set of failed filters."""
    symbols = "[" + filter_audit.SYMBOLS.decode().replace("$", r"\$").replace("|", r"\|") + "]"
    letters = list(filter_audit.FILTERS)
    others = " ".join(f"CROSS JOIN (SELECT unnest({letters}) AS l{i}) AS t{i}" for i in range(1, 5))
    differ = " AND ".join(f"l{i} <> l{k}" for i in range(5) for k in range(i))
    joined = " || ".join(f"l{i}" for i in range(5))
    return f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM {documents}),
    measured AS (SELECT doc_id, part, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words,
                        min(doc_id) OVER (PARTITION BY text) AS first FROM d),
    flags AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic
              FROM {labels} WHERE doc_id IS NOT NULL GROUP BY doc_id),
    failing AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                       CASE WHEN len(words) < {filter_audit.LEAST_WORDS} THEN 'A' ELSE '' END
                       || CASE WHEN 100 * len(list_distinct(words)) < {filter_audit.DISTINCT_PERCENT} * len(words) THEN 'B' ELSE '' END
                       || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {filter_audit.CAPITAL_PERCENT} * length(text) THEN 'C' ELSE '' END
                       || CASE WHEN regexp_matches(text, '{symbols}') THEN 'D' ELSE '' END
                       || CASE WHEN first < doc_id THEN 'E' ELSE '' END AS failed
                FROM measured LEFT JOIN flags USING (doc_id)),
    counted AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
                FROM failing GROUP BY part, failed),
    orders AS (SELECT {joined} AS filter_order FROM (SELECT unnest({letters}) AS l0) AS t0 {others} WHERE {differ}),
    steps AS (SELECT filter_order, step, filter_order[step] AS letter, filter_order[1:step - 1] AS before
              FROM orders CROSS JOIN (SELECT unnest(range(1, 6))::INTEGER AS step) AS s),
    judged AS (SELECT part, filter_order, step, letter, n, good, toxic, failed,
                      contains(failed, letter) AS fails, regexp_matches(failed, '[' || before || 'x]') AS gone
               FROM counted CROSS JOIN steps),
    added AS (SELECT part, filter_order, step, letter,
                     sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed,
                     sum(n) FILTER (gone AND fails) AS redundant, sum(n) FILTER (failed = letter) AS unique_fails,
                     sum(good) FILTER (NOT gone AND fails) AS good_lost, sum(toxic) FILTER (NOT gone AND fails) AS toxic_lost
              FROM judged GROUP BY ALL)
    SELECT part, filter_order, step,
           {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
           sum(coalesce(removed, 0)) OVER (PARTITION BY part, letter)::BIGINT AS shapley
    FROM added
    """


ORACLE["op4_url_filters"] = _url_sql()
ORACLE["op8_quality_rules"] = _quality_sql()
ORACLE["op10_line_dedup"] = f"SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM ({line_dedup_sql('documents')})"
ORACLE["op13_filter_interaction_audit"] = filter_audit_sql("documents", "labels")
