import random

import pytest
from pyspark.sql import functions as F

from reference_rules import confidence, high, labels, reason
from ticketloom.functions import fixed, scoring
from ticketloom.functions import text as tx
from ticketloom.operators import extract, triage

SENTENCES = [
    "medical emergency at home", "need a doctor now", "life\nthreatening issue", "someone is using my sim",
    "OTP going to another device", "account taken over", "I never authorized this payment", "didn't make any transfer",
    "entire colony is without network", "whole building lost internet", "broadband totally not responding",
    "going to sue", "file a police complaint", "TRAI complaint", "service has been cut off",
    "number has been blocked", "prepaid service suspended", "extra amount deducted twice", "for the past 3 days",
    "two days ago", "dead since last night", "no outgoing calls", "can't receive calls", "cannot call",
    "refund after 12 weeks", "yet haven't got refund", "waiting for a refund", "unknown charge",
    "someone else logged into my account", "password reset without my permission", "losing customers",
    "office is disrupted", "can't do my job", "us$50 was taken", "ref -- x", "ref #-", "Rs.499", "12/5 or may",
    "emergencyx", "xhospital", "hospital_", "über hospital", "hospitalé", "éhospital", "ſos", "Kyc", "İssue", "sıx days ago",
    "३ days", "for 3 days", "mailto 98123456701", "call 9812345670!", "POLICE", "fraud’s", "simple support port",
]
LENGTHS = [14, 15, 34, 35, 69, 70, 350, 351, 700, 701]


def texts():
    random.seed(7)
    vocabulary = sorted({w for p in fixed.HIGH_WORDS + fixed.CRITICAL_WORDS + fixed.BILLING_WORDS for w in p.split()}
                        | set("my the is for past 3 days rs. 499 ticket #ab-1 since não ça".split()))
    made = [random.choice([" ", "  ", "\n", ", "]).join(random.choices(vocabulary, k=random.randint(1, 14)))
            for _ in range(1500)]
    return SENTENCES + ["x" * n for n in LENGTHS] + ["slow " * 150] + made


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, t) for i, t in enumerate(t.strip() for t in texts()) if t]
    df = spark.createDataFrame(rows, "id int, review string").repartition(8)
    return triage.triage(df).collect()


def test_labels_and_hits(spark):
    rows = [(t.strip(),) for t in texts()]
    got = triage.with_keyword_labels(spark.createDataFrame(rows, "review string")).collect()
    for r in got:
        assert (r.predicted_category, r.predicted_priority, r.matched_keywords) == labels(r.review), r.review


def test_confidence(scored):
    for r in scored:
        assert r.confidence == pytest.approx(confidence(r.review), abs=5.1e-5), r.review


def test_safety_rules(scored):
    for r in scored:
        assert r.escalation_reason == reason(r.review), r.review
        assert r.escalated == (r.escalation_reason is not None)
        expected = "Critical" if r.escalated else (
            "High" if r.predicted_priority in ("Low", "Medium") and high(r.review) else r.predicted_priority)
        assert r.final_priority == expected, r.review


def test_routing(scored):
    for r in scored:
        review = r.escalated or r.confidence < 0.70 or (r.final_priority == "Critical" and r.confidence < 0.90)
        assert r.routing_status == ("HUMAN_REVIEW" if review else "AUTO_ROUTED")


def test_every_rule_is_exercised(scored):
    assert {r.escalation_reason for r in scored} >= {text for _, text in fixed.CRITICAL_RULES}


def test_triage_ignores_partitioning(spark, scored):
    df = spark.createDataFrame([(r.id, r.review) for r in scored], "id int, review string").coalesce(1)
    assert sorted(triage.triage(df).collect()) == sorted(scored)


def test_department_fixes(spark):
    pairs = spark.createDataFrame([(c, d) for c in fixed.CATEGORIES for d in fixed.DEPARTMENTS], "c string, d string")
    got = {(r.c, r.d): r.x for r in pairs.withColumn("x", triage.corrected_department(F.col("c"), F.col("d"))).collect()}
    changed = {k: v for k, v in got.items() if k[1] != v}
    assert changed == {(c, w): right for c, wrong, right in fixed.DEPARTMENT_FIXES for w in wrong}


def test_token_confidence(spark):
    df = spark.createDataFrame([([0.9, 0.5], True), ([], True), ([0.9], False)], "p array<double>, v boolean")
    got = [r[0] for r in df.select(scoring.token_confidence(F.col("p"), F.col("v"))).collect()]
    assert got == [0.65, 1.0, 0.0]


@pytest.mark.parametrize("raw, expected", [
    ('{"category": "Billing", "priority": "High", "department": "Finance"}', ("Billing", "High", "Finance", True)),
    ('```json\n{"category": " Refund "}\n```', ("Refund", "Medium", "General Support", True)),
    ('Sure: {"category": "Account", "priority": "Low"} and {"x": 1}', ("Account", "Low", "General Support", True)),
    ('{oops} {"category": "Billing"}', ("General", "Medium", "General Support", False)),
    ("{broken {\"category\": \"Technical\"}", ("Technical", "Medium", "General Support", True)),
    ("{'category': 'Billing'}", ("General", "Medium", "General Support", False)),
    ("{}", ("General", "Medium", "General Support", True)),
    ('{"category": null}', ("None", "Medium", "General Support", True)),
    ('{"category": "Billing", "priority": ', ("General", "Medium", "General Support", False)),
    ("no json", ("General", "Medium", "General Support", False)),
    (None, ("General", "Medium", "General Support", False)),
])
def test_extract(spark, raw, expected):
    row = extract.extract_labels(spark.createDataFrame([(raw,)], "raw_output string")).first()
    assert (row.category, row.priority, row.department, row.raw_valid) == expected


@pytest.mark.parametrize("phone, masked", [
    (None, "****"), ("12345", "****"), ("+91-9876543210", "+91-91****3210"),
    ("9876543210", "+91-98****3210"), ("ext 123", "ex****23")])
def test_mask_phone(spark, phone, masked):
    assert spark.createDataFrame([(phone,)], "p string").select(tx.mask_phone(F.col("p"))).first()[0] == masked


@pytest.mark.parametrize("text, clean", [
    ("card 4111 1111-1111 1111.", "card [CARD-MASKED]."), ("OTP: 482913 ok ", "OTP [MASKED] ok"),
    ("Otp 482913", "Otp 482913"), ("pin=12345 PIN 123", "pin [MASKED] PIN 123")])
def test_sanitize(spark, text, clean):
    assert spark.createDataFrame([(text,)], "t string").select(tx.sanitize(F.col("t"))).first()[0] == clean
