"""Keywords and rules are searched in batches of texts, with the same results as text by text."""

import random
import re

import pyarrow as pa
import pytest

from reference_rules import confidence, labels, reason
from test_rules import SENTENCES
from ticketloom.functions import batches, fixed
from ticketloom.functions.text import any_of
from ticketloom.operators import triage

TEXTS = ["", None, "rs.", "RS ", "İssue", "refunds, refund", "slow é", "2 days", "ſim swap", "a.b", "rsx", "sim\nswap"]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_first_list_hits_against_every_word():
    random.seed(3)
    words = sorted({w for _, ws in fixed.CATEGORY_RULES + fixed.PRIORITY_RULES for w in ws})
    texts = [t and t.lower() for t in TEXTS] + [" ".join(random.choices(words, k=random.randint(0, 3))) for _ in range(300)]
    for rules in (fixed.CATEGORY_RULES, fixed.PRIORITY_RULES):
        lists = [ws for _, ws in rules]
        hits, which = batches.first_list_hits(pa.array(texts, pa.string()), lists)
        for text, n, at in zip(texts, hits.tolist(), which.tolist()):
            counts = [sum(w in (text or "") for w in ws) for ws in lists]
            first = next((i for i, c in enumerate(counts) if c), len(lists) - 1)
            assert (n, at) == (counts[first], first), text


def test_keywords_are_not_searched_one_by_one_in_every_text(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id int, review string")
    scored = triage.with_keyword_labels(rows)
    for column in ("predicted_category", "predicted_priority", "matched_keywords"):
        assert "lambda" not in plan_of(scored.select("id", column))
    for r in scored.collect():
        expected = labels(r.review) if r.review else ("General", "Low", 0)
        assert (r.predicted_category, r.predicted_priority, r.matched_keywords) == expected, r.review


def test_rules_in_batches_against_text_by_text():
    critical = [p for p, _ in fixed.CRITICAL_RULES]
    texts = [t.lower() for t in SENTENCES if t.isascii()] + ["tower\x0bdown", "life\nsupport", "tower\x1cdown", "life\rthreatening", ""]
    found = batches.signs(fixed.SIGNAL_PATTERNS, critical, any_of(critical), any_of(fixed.HIGH_RULES))(pa.array([*texts, None], pa.string()))
    assert found[-1].as_py() == {"signals": 0, "rule": 0, "high": False}

    def has(pattern, text):
        return re.search(pattern.replace(r"\s", r"[\t-\r ]"), text, re.S | re.A) is not None
    for text, got in zip(texts, found.to_pylist()):
        assert got["signals"] == sum(has(p, text) for p in fixed.SIGNAL_PATTERNS), text
        assert got["rule"] == next((i for i, p in enumerate(critical, 1) if has(p, text)), 0), text
        assert got["high"] == any(has(p, text) for p in fixed.HIGH_RULES), text


def test_ascii_texts_need_no_search_for_each_rule(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(SENTENCES)], "id int, review string")
    plan = plan_of(triage.triage(rows).select("id", "confidence", "final_priority"))
    assert "(?s)" not in plan  # only other scripts are searched rule by rule
    for r in triage.triage(rows).collect():
        assert (r.escalation_reason, r.confidence) == (reason(r.review), pytest.approx(confidence(r.review), abs=5.1e-5)), r.review


def test_words_of_every_white_space():
    texts = ["a b\x1ca", "a b", "", "  ", None]
    assert batches.vocabulary(pa.array(texts)).to_pylist() == [
        {"total": n, "distinct": d} for n, d in ((3, 2), (2, 2), (0, 0), (0, 0), (0, 0))]
