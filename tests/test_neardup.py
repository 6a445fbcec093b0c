import random

import pytest

from reference_rules import greedy_drops, shingle_set, similar, words
from pyspark.sql import functions as F
from ticketloom.functions import text as tx
from ticketloom.operators import neardup


def corpus():
    """Exact copies, a large group of near copies, chains, shared boilerplate and odd texts."""
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(400)]
    template = random.choices(vocabulary, k=60)
    chain = random.choices(vocabulary, k=50)
    boiler = random.choices(vocabulary, k=30)
    texts = ["", "one", "One!", "two words", "", "Été à Paris", "été, à paris", "Σοφός ΣΑΣ", "a\x1cb c d"]
    texts += [" ".join(template)] * 25
    for i in range(60):
        near = list(template)
        near[random.randrange(60)] = f"n{i}"
        texts.append(" ".join(near))
    for i in range(12):
        chain = list(chain)
        chain[-1 - i] = f"c{i}"
        texts.append(" ".join(chain))
    for i in range(40):
        texts.append(" ".join(boiler + [f"own{i}{j}" for j in range(random.randint(0, 6))]))
    texts += [" ".join(random.choices(vocabulary, k=random.randint(1, 40))) for _ in range(60)]
    random.shuffle(texts)
    return [(i, t, "ab"[i % 7 == 0]) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("leaders", [1, 16])
def test_matches_greedy_scan(spark, rows, monkeypatch, leaders):
    monkeypatch.setattr(neardup, "LEADERS", leaders)
    monkeypatch.setattr(neardup, "MORE_LEADERS", 2)
    df = spark.createDataFrame(rows, "id bigint, text string, bucket string").repartition(5)
    expected = greedy_drops(rows)
    assert {r.id for r in neardup.near_duplicates(df, "id", "text", "bucket").collect()} == set(expected)
    got = neardup.near_duplicate_matches(df, "id", "text", "bucket").collect()
    assert {r.dropped_id: r.kept_id for r in got} == expected
    assert len(got) == len(expected)


def test_hot_shingles_by_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(neardup, "_hot_limit", lambda total: 5)
    df = spark.createDataFrame(rows, "id bigint, text string, bucket string")
    kept = {r.id for r in neardup.keep_first_similar(df, "id", "text", "bucket").collect()}
    assert kept == {r[0] for r in rows} - set(greedy_drops(rows))


@pytest.mark.parametrize("leaders", [1, 16])
def test_leakage_against_all_pairs(spark, rows, monkeypatch, leaders):
    monkeypatch.setattr(neardup, "LEADERS", leaders)
    monkeypatch.setattr(neardup, "MORE_LEADERS", 2)
    df = spark.createDataFrame(rows, "id bigint, text string, bucket string")
    base, other = df.filter("id < 90"), df.filter("id >= 90")
    base_sets = [shingle_set(t) for i, t, _ in rows if i < 90]
    expected = {i for i, t, _ in rows if i >= 90 and not any(similar(shingle_set(t), b) for b in base_sets)}
    assert {r.id for r in neardup.without_near_rows(base, other, "id", "text").collect()} == expected


def test_words_and_shingles(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, text string, bucket string")
    df = df.withColumn("w", tx.normalized_words(F.col("text"))).withColumn("s", tx.shingles(F.col("w")))
    for r in df.collect():
        assert r.w == words(r.text)
        assert len(r.s) == len(set(r.s)) and set(r.s) == shingle_set(r.text)


def test_rows_without_a_bucket_are_a_bucket(spark):
    rows = [(1, "one two three four", None), (2, "one two three four", None), (3, "one two three four", "x")]
    df = spark.createDataFrame(rows, "id long, text string, b string")
    assert [r.id for r in neardup.near_duplicates(df, "id", "text", "b").collect()] == [2]


def test_rounds_do_not_grow_with_a_common_shingle(spark, monkeypatch):
    """Unlike texts that all hold one shingle, a rare one for each of them: few rounds, and no pair moves its sets."""
    rounds, compared, leaders, verified = [], [], neardup._leaders, neardup._verified

    def counted(postings, count):
        rounds.append(count)
        return leaders(postings, count)

    def watched(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(neardup, "_leaders", counted)
    monkeypatch.setattr(neardup, "_verified", watched)
    texts = spark.range(6000).select("id", F.concat(
        F.lit("alpha beta gamma "), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(
            F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(40)).cast("string"))), " ")).alias("text"))
    assert neardup.near_duplicates(texts, "id", "text").isEmpty()
    assert rounds == [16, 256, 4096, 65536][:len(rounds)] and sum(compared) < 6000


def test_parities_never_lose_a_pair(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):
        a = {rng.getrandbits(63) for _ in range(rng.choice([1, 5, 60, 400]))}
        b = {x for x in a if rng.random() > rng.choice([0, 0.05, 0.1])} | {rng.getrandbits(63) for _ in range(rng.choice([0, 1, 5]))}
        rows.append((sorted(a), sorted(b or a)))
    pairs = spark.createDataFrame(rows, "a array<long>, b array<long>").withColumns({"pa": neardup._parities("a"), "pb": neardup._parities("b")})
    similar = F.size(F.array_intersect("a", "b")) * 100 >= F.size(F.array_union("a", "b")) * 85
    allowed = neardup._bits_allow(F.col("pa"), F.col("pb"), F.size("a") + F.size("b"), 85)
    assert pairs.filter(similar).count() > 50 and pairs.filter(similar & ~allowed).isEmpty()


def test_unlike_texts_of_common_shingles_share_hardly_a_part(spark, monkeypatch):
    """Each shingle is in many of the texts; parts of several are not, so the lists stay nearly empty."""
    listed, leaders = [], neardup._leaders

    def counted(postings, count):
        listed.append(postings.count())
        return leaders(postings, count)

    monkeypatch.setattr(neardup, "_leaders", counted)
    texts = spark.range(2000).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda i: F.concat(
        F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(12)).cast("string"))), " ").alias("text"))
    assert neardup.near_duplicates(texts, "id", "text").isEmpty()
    assert sum(listed) < 1000


def test_links_at_the_limit_of_every_size(spark):
    """Texts of many sizes with copies that lack the last words, about as many as the limit lets them, over class borders too."""
    rows = []
    for size in [*range(1, 60), 61, 62, 63, 92, 93, 139, 140, 141, 200, 400]:
        text = [f"s{size}x{i}" for i in range(size)]
        rows += [" ".join(text), *(" ".join(text[:size - cut]) for cut in {1, size * 14 // 100, size * 15 // 100, size * 16 // 100} if 0 < cut < size)]
    random.Random(4).shuffle(rows)
    rows = [(i, text, "a") for i, text in enumerate(rows)]
    df = spark.createDataFrame(rows, "id bigint, text string, bucket string")
    assert {r.id for r in neardup.near_duplicates(df, "id", "text", "bucket").collect()} == set(greedy_drops(rows))


ODD = ["", " ", None, "İstanbul ve İzmir", "i̇stanbul ve izmir", "ΣΑΣ Σας σας", "straße STRASSE ẞ", "١٢٣ ४५६ x²", "áb c­ad", "日本語 テキスト",
       "😀 smile 😀", "K elvin Å ngstrom", "ǅ ǆ Ǆ", "one-two_three.four", "a" * 5000 + " b", "﻿one two", "x\x00y\x1cz"]


def test_words_cut_in_batches_are_those_of_the_columns(spark):
    """Every character in a text of its own and beside letters, and texts of odd scripts: as many shingles, and equal sets where
    the columns have equal ones."""
    single = [chr(c) for c in range(0x3400) if not 0xD800 <= c <= 0xDFFF] + [chr(c) for c in range(0x1F100, 0x1F200)]
    rows = [(i, t) for i, t in enumerate([*ODD, *single, *(f"a{c}b {c} d e" for c in single)])]
    df = spark.createDataFrame(rows, "id bigint, text string")
    cut = {r.id: (r.n, bytes(r.digest)) for r in neardup.shingle_rows(df, "id", "text", F.lit(""), 85).select("id", "n", "digest").collect()}
    sets = df.withColumn("w", F.coalesce(tx.normalized_words(F.col("text")), F.array().cast("array<string>"))).select("id", tx.shingles(F.col("w")).alias("s"))
    want = {r.id: frozenset(r.s) for r in sets.collect()}
    assert all(cut[i][0] == len(s) for i, s in want.items())
    assert len({(s, cut[i][1]) for i, s in want.items()}) == len(set(want.values())) == len({d for _, d in cut.values()})


@pytest.mark.parametrize("what", ["_SLICE_BYTES", "_MOST_BITS", "FEW"])
def test_bounds_change_no_result(spark, rows, monkeypatch, what):
    """Slices of a text or a few words, a bitmap that lets everything pass, keys that are not broadcast."""
    monkeypatch.setattr(neardup.sieve if what == "FEW" else neardup, what, {"_SLICE_BYTES": 7, "_MOST_BITS": 1, "FEW": 2}[what])
    df = spark.createDataFrame(rows, "id bigint, text string, bucket string")
    expected = greedy_drops(rows)
    got = neardup.near_duplicate_matches(df, "id", "text", "bucket").collect()
    assert {r.dropped_id: r.kept_id for r in got} == expected and len(got) == len(expected)
