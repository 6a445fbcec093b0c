"""Search by trigrams beside the search of every ticket."""

import random

import pytest
from pyspark.sql import functions as F

from test_ticket_table import as_of
from ticketloom.operators import ingest, tickets as operators, triage
from ticketloom.sources import search_index, ticket_table

ALPHABET = "abAB1 -_%\\ßΣσςİiı😀é\n"


def texts(rng, n):
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))) or None for _ in range(n)]


def batch(spark, first, n, seed):
    rng = random.Random(seed)
    reviews, names = texts(rng, n), texts(rng, n)
    rows = spark.createDataFrame([(f"T-{first + i}", reviews[i] or "blank", names[i], None, None) for i in range(n)],
                                 "ticket_id string, review string, customer_name string, contact_number string, timestamp string")
    return ingest.as_stored(triage.triage(rows), as_of())


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    made = ticket_table.TicketTable(spark, str(tmp_path_factory.mktemp("search") / "table"))
    made.append_batch(batch(spark, 0, 300, 1), "a")
    made.append_batch(batch(spark, 300, 200, 2), "b")
    index = search_index.SearchIndex(made)
    assert (index.extend(), index.extend()) == (2, 0)
    made._delete(made.state().filter("id % 7 = 0").select("id"), as_of())
    made.compact(buckets=3)
    made.append_batch(batch(spark, 500, 100, 3), "c")
    return made


def ids(rows):
    return sorted(r.id for r in rows.select("id").collect())


def patterns(state):
    """Pieces of stored texts with wildcards and changed case, and drawn ones."""
    rng = random.Random(4)
    known = [v for r in state.select(*search_index.FIELDS).collect() for v in r if v and len(v) > 4]
    for k in range(16):
        text = rng.choice(known)
        start = rng.randrange(len(text) - 3)
        piece = list(text[start:start + rng.randint(3, 9)])
        if k % 3 == 0:
            piece[rng.randrange(len(piece))] = rng.choice("%_")
        yield "".join(piece).upper() if k % 4 == 0 else "".join(piece)
    yield from texts(rng, 6)


def test_equals_the_search_of_every_ticket(spark, table, monkeypatch):
    index, state = search_index.SearchIndex(table), table.state().cache()
    hits = 0
    for k, term in enumerate([*patterns(state), None, "", "%", "__", "ab", "T-5", "t-_1%", "no such words", "ΑΣ", "😀é"]):
        monkeypatch.setattr(search_index, "LISTED", 1000 if k % 2 else 0)
        want = ids(operators.search(state, term))
        assert ids(index.search(term)) == want, term
        hits += bool(want)
    state.unpersist()
    assert hits > 15


def test_columns_and_rows_are_those_of_the_state(table, monkeypatch):
    for listed in (1000, 0):
        monkeypatch.setattr(search_index, "LISTED", listed)
        found = search_index.SearchIndex(table).search("T-12")
        want = operators.search(table.state(), "T-12")
        assert found.columns == want.columns and found.orderBy("id").collect() == want.orderBy("id").collect() != []


def test_every_match_is_a_candidate_and_grams_are_whole(spark, table):
    index = search_index.SearchIndex(table)
    assert index.pattern_grams("aB%x_Cde") == ["cde"] and index.pattern_grams("a_b%cd") == []
    assert index.pattern_grams("\\abcd") == sorted(["\\ab", "abc", "bcd"])
    found = {r.id for r in index.candidates(index.pattern_grams("T-49")).collect()}
    # Only tickets of indexed batches that hold the three characters t-4 and -49.
    assert found == {r.id for r in table.tickets(batches=["a", "b"]).filter(F.col("ticket_id").like("T-49%")).collect()}
    assert index.candidates(["zzz", "t-4"]).isEmpty()


def test_few_candidates_prune_the_scan(table):
    plan = search_index.SearchIndex(table).search("T-123")._jdf.queryExecution().toString()
    assert "SelectedBucketsCount" in plan or "In(id" in plan or "EqualTo(id" in plan


def test_an_index_that_broke_off_is_written_again(spark, tmp_path, monkeypatch):
    table = ticket_table.TicketTable(spark, str(tmp_path / "table"))
    index = search_index.SearchIndex(table)
    assert index.extend() == 0 and index.search("blank").isEmpty()
    table.append_batch(batch(spark, 0, 20, 1), "a")
    # Half an index that is not listed: readers do not see it.
    search_index._inverted(table.tickets().limit(3)).write.parquet(f"{table.root}/grams/batch=a")
    assert ids(index.search("T-1")) == ids(operators.search(table.state(), "T-1")) != []
    assert index.extend() == 1
    assert ids(index.search("T-1")) == ids(operators.search(table.state(), "T-1"))


def test_a_common_gram_has_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK", 16)
    rows = spark.range(1, 101).select("id", F.lit("Same text").alias("review"), F.lit(None).cast("string").alias("customer_name"),
                                      F.col("id").cast("string").alias("ticket_id"))
    lists = search_index._inverted(rows).filter("gram = 'sam'").orderBy("block").collect()
    assert [len(r.places) for r in lists] == [15, 16, 16, 16, 16, 16, 5] and lists[0].places == list(range(1, 16))


def lowered(spark, n):
    rng = random.Random(9)
    rows = [(i * 7 % 1000, *(t and t.lower() for t in (rng.choice(texts(rng, 3)), None if i % 5 == 0 else rng.choice(texts(rng, 3)), f"T-{i}"))) for i in range(n)]
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 11_000)))
    return spark.createDataFrame([*rows, (1500, wide, "ab", "😀é"), (1501, wide[::-1] + "abc", None, None)], "id bigint, review string, customer_name string, ticket_id string")


@pytest.mark.parametrize("slice_bytes", [1 << 21, 50])
def test_lists_are_those_of_single_grams(spark, monkeypatch, slice_bytes):
    """Grams that are cut batch by batch, over alphabets of any size, are those of the columns, each ticket once in a list."""
    monkeypatch.setattr(search_index, "BLOCK", 64)
    monkeypatch.setattr(search_index, "_SLICE_BYTES", slice_bytes)
    rows = lowered(spark, 300)
    single = F.array_distinct(F.concat(*[search_index.grams(F.lower(f)) for f in search_index.FIELDS]))
    want = rows.select("id", F.explode(single).alias("gram")).groupBy("gram", F.floor(F.col("id") / 64).alias("block")).agg(
        F.array_sort(F.collect_list((F.col("id") % 64).cast("int"))).alias("places"))
    got = search_index._inverted(rows)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert dict(got.dtypes) == {"gram": "string", "block": "bigint", "places": "array<int>"}


def test_no_row_for_each_gram_of_a_ticket(spark, monkeypatch):
    """What is stored has a row for each gram and slice, cut in as many tasks as there are blocks."""
    lists, tasks = [], []

    def watched(df, label):
        plan = df._jdf.queryExecution().executedPlan().toString()
        tasks.append("Generate" not in plan and "MapInArrow" in plan)
        table = stored(df, label)
        lists.append(table.count())
        return table

    stored = search_index.stored
    monkeypatch.setattr(search_index, "stored", watched)
    rows = spark.range(500).select("id", F.lit("the same words in every ticket").alias("review"), F.lit(None).cast("string").alias("customer_name"),
                                   F.lit("T-1").alias("ticket_id"))
    found = search_index._inverted(rows).collect()
    assert tasks == [True] and lists == [len(found)] and all(r.places == list(range(500)) for r in found)
    assert search_index._inverted(rows.limit(0)).isEmpty()
