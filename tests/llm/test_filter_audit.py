"""The filter audit against filters applied one after the other."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import filter_audit

LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [None, "", LONG, LONG, LONG + " #", "A " * 150, LONG.upper(), "x y " * 130, "é" * 9 + "A", "é" * 8 + "AB", LONG + " %", "a\tb\x0bc\x1cd", "|" + LONG]


def failures(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    tests = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
             bool(re.search("[#$%&*|]", text)))
    return {f for f, failed in zip("ABCD", tests) if failed}


def by_hand(documents, labels):
    docs = []
    for key, text, part in documents:
        failed = failures(text or "")
        if key is not None and any(k is not None and k < key and (t or "") == (text or "") for k, t, _ in documents):
            failed.add("E")
        mine = [row for row in labels if key is not None and row[0] == key]
        docs.append((part or "", failed, any(row[1] == 1 for row in mine), any(row[2] == 1 for row in mine)))
    rows, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                failing = [d for d in docs if d[0] == part and letter in d[1]]
                shapley[part, letter] = shapley.get((part, letter), 0) + len(gone)
                rows[part, order, step] = [len(left), len(gone), len(failing) - len(gone), sum(d[1] == {letter} for d in failing),
                                           sum(d[2] for d in gone), sum(d[3] for d in gone)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items()}


@pytest.mark.parametrize("hot", [1, 1000])
def test_by_hand(spark, monkeypatch, hot):
    monkeypatch.setattr(filter_audit, "HOT", hot)
    documents = [(i, text, ("en", "de", None, "")[i % 4]) for i, text in enumerate(TEXTS)]
    documents += [(50 + i, LONG, "en") for i in range(40)] + [(None, LONG, "de"), (None, None, None), (2, LONG, "de"), (3, LONG, "en"), (-5, TEXTS[5], "en")]
    labels = [(0, 1, 1), (2, 1, 0), (3, 0, 1), (3, None, None), (5, 1, None), (None, 1, 1), (60, 1, 1), (60, 1, 1), (999, 1, 1)]
    docs = spark.createDataFrame(documents, "doc_id long, text string, lang string").repartition(4).withColumns(
        {c: F.lit(1) for c in ("part", "id", "failed", "d1", "good", "_id", "_text")})
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("part", F.lit(1))
    found = filter_audit.audit(docs, "doc_id", "text", "lang", given).collect()
    want = by_hand(documents, labels)
    assert len(found) == len(want)
    assert {(r[0], r[1], r[2]): tuple(r)[3:] for r in found} == want


@pytest.mark.parametrize("size", [0, 1, 2, 15, 16, 17, 33, 1000])
def test_positional_popcount(size):
    words = np.random.default_rng(size).integers(0, 1 << 32, size, dtype=np.uint64).astype(np.uint32)
    assert filter_audit.positional_popcount(words).tolist() == [int(((words >> np.uint32(s)) & np.uint32(1)).sum()) for s in range(32)]


def test_survival_words():
    for failed, word in enumerate(filter_audit.survival_words(np.arange(32)).tolist()):
        assert [word >> s & 1 for s in range(32)] == [int(s & failed == 0) for s in range(32)]


def test_many_parts(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "_PARTS_HELD", 5)
    docs = spark.createDataFrame([(i, "a", f"p{i % 30}") for i in range(90)], "doc_id long, text string, lang string")
    found = filter_audit.audit(docs, "doc_id", "text", "lang", spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert found.filter("filter_order = 'ABCDE' AND step = 1 AND removed = 3").count() == 30 and found.count() == 30 * 600


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert filter_audit.audit(docs, "doc_id", "text", "lang", spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect() == []
