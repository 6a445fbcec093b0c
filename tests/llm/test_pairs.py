"""Near-duplicate operators and components against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import embedding_dedup, graph, minhash_forest


def closure(nodes, pairs):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(300, 301 + i) for i in range(40)]
    edges = spark.createDataFrame([*pairs, (7, 7), (None, 3)], "a long, b long")
    got = dict(map(tuple, graph.components(edges).select("node", "component").collect()))
    linked = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == {n: c for n, c in closure({n for p in pairs for n in p}, pairs).items() if n in linked}


def test_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        centres = rng.normal(size=(6, 16))
        for c in centres:
            for _ in range(int(rng.integers(1, 25))):
                rows.append((label, (c + rng.normal(scale=rng.choice([0.05, 0.12, 0.4]), size=16)).astype(np.float32)))
        rows += [(label, centres[0].astype(np.float32))] * 4
    return [(i, v.tolist(), label) for i, (label, v) in enumerate(rows)]


def expected_links(rows, threshold=0.98):
    links = {i: 0 for i, *_ in rows}
    pairs = []
    unit = {i: np.array(v, dtype=float) / np.linalg.norm(v) for i, v, _ in rows}
    for (i, a, la), (j, b, lb) in itertools.combinations(rows, 2):
        if la == lb and len(a) == len(b) and unit[i] @ unit[j] >= threshold:
            links[i] += 1
            links[j] += 1
            pairs.append((i, j))
    return links, closure(links, pairs)


@pytest.mark.parametrize("rows_per_pivot, cut", [(512, 2048), (8, 2048), (8, 16)])
def test_vectors_by_brute_force(spark, monkeypatch, rows_per_pivot, cut):
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_PIVOT", rows_per_pivot)
    monkeypatch.setattr(embedding_dedup, "SLICE", cut)
    rows = vectors()
    rows += [(1000 + i, v[:8], label) for i, v, label in rows[:5]] + [(2000, [1e-30] * 16, 0), (2001, [2e30] * 16, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns(
        {"id": F.lit(1), "label2": F.lit(1), "h1": F.lit(2), "component": F.lit(3)})
    found = embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label").collect()
    links, groups = expected_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found} == {i: (links[i], groups[i], groups[i] == i) for i in links}
    assert max(links.values()) > 4


def test_vectors_that_link_with_nothing(spark):
    one = [1.0, 0.0]
    rows = [(1, one, 0), (2, None, 0), (3, [], 0), (4, [0.0, 0.0], 0), (5, [1.0, None], 0), (6, [1.0, float("nan")], 0),
            (7, [1.0, float("inf")], 0), (8, one, None), (None, one, 0), (9, one, 1), (10, one, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, "vec_id", "embedding", "label").collect()}
    assert found == {**{i: (0, i, True) for i in range(2, 10)}, 1: (1, 1, True), 10: (1, 1, False), None: (0, None, True)}
    assert embedding_dedup.near_duplicates(df.limit(0), "vec_id", "embedding", "label").collect() == []


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    size = min(width, len(words))
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def texts(seed):
    """Groups that drift from a start, so that neighbours are similar and ends are not."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    result = []
    for _ in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))]
        for _ in range(rng.randint(1, 14)):
            result.append(" ".join(words))
            words = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
    rng.shuffle(result)
    return result


@pytest.mark.parametrize("seed, width, cut", [(1, 2, 1024), (2, 5, 1024), (3, 2, 4)])
def test_texts_by_brute_force(spark, monkeypatch, seed, width, cut):
    monkeypatch.setattr(minhash_forest, "SLICE", cut)
    rows = list(enumerate(texts(seed)))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "Alone"), (904, "alone "), (905, "alone twice"), (906, "É"), (907, "é"),
             (908, "a b " * 20_000), (909, "B a " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit(1), "n": F.lit(2), "keys": F.lit(3), "component": F.lit(4)})
    found = minhash_forest.near_duplicates(df, "doc_id", "text", width=width).collect()
    sets = {i: shingles(t, width) for i, t in rows}
    pairs = [(i, j) for i, j in itertools.combinations(sets, 2)
             if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = closure(sets, pairs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == {i: (len(sets[i]), groups[i], groups[i] == i) for i in sets}


def test_repeated_and_null_ids(spark):
    """Every text of an id links; rows without an id link by their text, and one of a group without ids is kept."""
    many = [f"w{i}" for i in range(101)]
    rows = [(7, " ".join(many)), (7, "eleven other words " * 3), (9, " ".join(many[:100])), (12, "eleven other words " * 3 + "ELEVEN"),
            (1, "one two three"), (1, "one two three"), (None, "one two three"), (2, "One two three"),
            (None, None), (None, "no id here"), (None, "No id here"), (20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in minhash_forest.near_duplicates(df, "doc_id", "text", 2).collect()),
                   key=lambda r: (r[0], r[1], r[3]))
    assert found == [(0, 0, None, True), (0, 2, 1, False), (0, 2, None, False), (0, 2, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False),
                     (7, 3, 7, True), (7, 100, 7, True), (9, 99, 7, False), (12, 3, 7, False), (20, 0, 20, True)]
    assert minhash_forest.near_duplicates(df.limit(0), "doc_id", "text").collect() == []


def test_a_hot_group_of_near_copies(spark):
    """One group with distinct sets, larger than a slice, among unlike texts."""
    rng = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(1500):
        words = list(base)
        words[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(5000 + i, " ".join(f"u{rng.randrange(10 ** 6)}" for _ in range(60))) for i in range(200)]
    found = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5)
    kept = [r.doc_id for r in found.filter("kept").collect()]
    assert sorted(kept) == [0, *range(5000, 5200)]
