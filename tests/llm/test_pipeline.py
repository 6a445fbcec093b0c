"""The pipeline against plain Python, stage by stage, and the registration of this package's queries."""

import itertools
import re
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry_points
import corpus_pipeline
from ticketloom.llm.queries import QUERIES, tokenizer_path
from tools.check import compare, connect

from test_native import line_dedup_by_hand
from test_pairs import closure, shingles

SF_DIR = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_near_dedup", "secret_scan", "best_fit_packing"]
    extra = spark.createDataFrame([(10 ** 6, None, None, None, None), (10 ** 6 + 1, "12 34 !", "en", "x", 7), (10 ** 6 + 2, "", "en", "x", 0)],
                                  docs.schema)
    docs = docs.unionByName(extra)
    stages = dict(corpus_pipeline.STAGES)

    accepted = stages["language_id"](spark, docs, SF_DIR).cache()
    assert accepted.columns == columns
    gone = docs.join(accepted, "doc_id", "left_anti").collect()
    assert {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2} <= {r.doc_id for r in gone} and len(gone) <= 4

    shorter = stages["line_dedup"](spark, accepted, SF_DIR).cache()
    assert shorter.columns == columns
    by_hand = line_dedup_by_hand([(r.doc_id, r.text) for r in accepted.collect()])
    assert sorted(((r.doc_id is not None, r.doc_id), r.text) for r in shorter.collect()) == sorted((doc, text) for doc, *_, text in by_hand)
    assert shorter.filter(F.char_length("text") != F.col("n_chars")).isEmpty()

    single = stages["minhash_near_dedup"](spark, shorter, SF_DIR).cache()
    sets = {r.doc_id: shingles(r.text, 5) for r in shorter.collect()}
    pairs = [(i, j) for i, j in itertools.combinations(sets, 2) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = closure(sets, pairs)
    assert single.columns == columns and sorted(r.doc_id for r in single.collect()) == sorted(i for i in groups if groups[i] == i)

    masked = stages["secret_scan"](spark, single, SF_DIR).cache()
    hide = lambda text: re.sub(r'(?i)(token = ")[0-9a-f]{40}', r"\1[SECRET]", text)
    assert masked.columns == columns
    assert {r.doc_id: r.text for r in masked.collect()} == {r.doc_id: hide(r.text) for r in single.collect()}

    packed = stages["best_fit_packing"](spark, masked, SF_DIR).collect()
    library = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in masked.collect()}
    got = {}
    for r in packed:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want


def test_queries_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert "pipeline" not in entry_points.oracle_sql()


def test_entry_points_without_this_package():
    code = ("import sys, importlib.machinery as m\n"
            "find = m.PathFinder.find_spec\n"
            "hide = lambda name, *a: None if name.startswith(('ticketloom.llm', 'corpus_pipeline')) else find(name, *a)\n"
            "m.PathFinder.find_spec = staticmethod(hide)\n"
            "import __spark_entry__ as e\n"
            "assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline'] and e.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in entry_points.oracle_sql()])
def test_queries_beside_their_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), entry_points.oracle_sql()[name]).startswith("ok")
