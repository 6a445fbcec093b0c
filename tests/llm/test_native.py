"""URL filters, quality rules and line dedup: planted cases, brute force and hostile tables."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from ticketloom.llm import line_dedup, quality_rules, url_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def documents(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({"_text": F.lit(1), "h": F.lit(2), "words": F.lit(3), "row": F.lit(4)}) if extra else df


def quality_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_counts_by_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "a", "é", "Ünd", "x#", "naïve", "\x1ctab", "|", "end."])
    rows = [(i, rng.choice(["", " "]) + "".join(word() + rng.choice([" ", "  ", "\n", "\t", "\r\n", "\x0b", "\u00a0"])
                                                for _ in range(rng.randint(0, 90)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "one two three four five six seven eight " * 400), (None, "the of " * 30),
             (104, "x" * 300_000), (105, "\n" * 5_000), (0, rows[0][1])]
    found = quality_rules.judge(documents(spark, rows, extra=True), "doc_id", "text").collect()
    got = sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found)
    assert got == sorted(quality_counts(text) for _, text in rows)


def test_quality_verdicts(spark):
    plain = "The house of the mayor was near a river and it had to be sold in that year by the council for money."
    rows = [(1, plain), (2, "too short"), (3, " ".join(w + "###" for w in plain.split())), (4, plain.upper()),
            (5, " | ".join("abcdefg" for _ in range(30))), (6, "word " * 50)]
    kept = {r.doc_id: (r.base_failed, r.kept) for r in quality_rules.judge(documents(spark, rows), "doc_id", "text").collect()}
    assert kept == {1: (False, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (True, False), 6: (True, False)}


def test_quality_has_no_shuffle_or_python(spark):
    plan = quality_rules.judge(documents(spark, [(1, "a")]), "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def line_dedup_by_hand(rows):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    order = lambda doc: (doc is not None, doc)
    last = {k: max(docs, key=order) for k, docs in holders.items() if len(docs) >= 3}
    result = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if key(line) not in last or last[key(line)] == doc]
        result.append((order(doc), len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(result)


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_by_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = ["All rights reserved by the owner.", "ALL rights reserved by the owner.\t", "  short line ", "x" * 20, "y" * 19,
            "Élan vital de la maison verte", "élan vital de la maison verte", "\u212aelvin scale of the long line",
            "kelvin scale of the long line", "", "a line that only few texts hold"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.7 else f"own line number {i} of this text" for _ in range(rng.randint(0, 90))))
            for i in range(25)]
    rows += [(90, None), (91, ""), (92, "All rights reserved by the owner.\n" * 70), (None, "x" * 20 + "\nz"), (0, rows[0][1]), (3, "x" * 20)]
    found = line_dedup.deduplicate(documents(spark, rows, extra=True), "doc_id", "text")
    assert {"h", "words", "row", "_text"} <= set(found.columns)
    got = sorted(((r.doc_id is not None, r.doc_id), r.n_lines, r.n_dropped, r.kept_text or "") for r in found.collect())
    assert got == line_dedup_by_hand(rows)


def test_line_dedup_passes_columns_of_its_own_names_through(spark):
    rows = [(i, "a line that is long enough to count\nown") for i in range(4)] + [(9, None)]
    plain = line_dedup.deduplicate(documents(spark, rows), "doc_id", "text").collect()
    own = {n: F.concat(F.lit(f"{n} "), F.col("doc_id")) for n in ("_words", "_gone", "_DOC", "_row", "_lines", "_row_hash", "__words", "doc", "h2")}
    marked = documents(spark, rows).withColumns({**own, "n_lines": F.lit("old")})
    found = line_dedup.deduplicate(marked, "doc_id", "text")
    assert found.columns == ["doc_id", "text", *own, "kept_text", "n_lines", "n_dropped"]
    kept = found.collect()
    assert all(r[n] == f"{n} {r.doc_id}" for r in kept for n in own)
    brief = lambda rows: sorted((r.doc_id, r.kept_text or "", r.n_lines, r.n_dropped) for r in rows)
    assert brief(kept) == brief(plain) and sum(r.n_dropped for r in kept) == 3
    renamed = documents(spark, rows).withColumnsRenamed({"doc_id": "_doc", "text": "_lines"})
    again = line_dedup.deduplicate(renamed, "_doc", "_lines").withColumnRenamed("_doc", "doc_id")
    assert brief(again.collect()) == brief(plain)


def test_bitmaps_are_sparse_words(spark):
    rows = [(i, "\n".join(["own"] * 130 + ["a line that is long enough to count"])) for i in range(4)]
    found = {r.doc: [(w["index"], w.bits) for w in r.words] for r in line_dedup.keep_bitmaps(documents(spark, rows), "doc_id", "text").collect()}
    assert found == {i: [(2, ~(1 << 2))] for i in range(3)}


def test_empty_tables(spark):
    empty = documents(spark, [])
    assert quality_rules.judge(empty, "doc_id", "text").collect() == []
    assert line_dedup.deduplicate(empty, "doc_id", "text").collect() == []
    assert url_rules.judge(empty, "doc_id", "text").collect() == []


def judged(spark, urls, **rules):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit(0), "rule": F.lit(1), "word": F.lit(2)})
    return [tuple(r[1:]) for r in sorted(url_rules.judge(df, "page_id", "url", **rules).collect())]


def test_urls(spark):
    assert judged(spark, [None, "no scheme.com/en/", "http://WWW.Example.com/en/1?x=/fr/", "https://m.example.com/en/2#top",
                          "http://example.com", "http://a.net/es/", "http://a.net/esx/", "http://net/fr/", "ftp://spam-farm.example.org/x",
                          "http://notspam.example.org/", "http://a.org/x://b.com/", "http://x.org/FREE-summer/coupons", ""]) == [
        ("", "", None, "allow", None), ("", "", None, "allow", None),
        ("www.example.com", "/en/1", "www.example.com/en/", "allow", None), ("m.example.com", "/en/2", "example.com/en/", "block", None),
        ("example.com", "", None, "allow", None), ("a.net", "/es/", "net/es/", "block", None), ("a.net", "/esx/", None, "allow", None),
        ("net", "/fr/", "net/fr/", "block", None), ("spam-farm.example.org", "/x", None, "block", "spam-farm"),
        ("notspam.example.org", "/", None, "allow", None), ("a.org", "/x://b.com/", None, "allow", None),
        ("x.org", "/FREE-summer/coupons", None, "block", "free*coupons"), ("", "", None, "allow", None)]


def test_urls_without_rules_and_by_shuffle(spark, monkeypatch):
    assert judged(spark, ["http://a.com/"], host_rules=(), patterns=()) == [("a.com", "/", None, "allow", None)]
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 0)
    assert judged(spark, ["http://a.com/", "http://a.net/fr/"])[1] == ("a.net", "/fr/", "net/fr/", "block", None)


def test_rules_are_filed_under_their_rarest_word(spark):
    urls = spark.createDataFrame([(f"http://a{i % 3}.net/{'es' if i == 0 else 'x'}/",) for i in range(9)], "url string")
    index = url_rules.rule_index(url_rules.with_address(urls, "url"), list(url_rules.HOST_RULES))
    assert {r.rule: r.word for r in index.collect()}["net/es/"] == "es"


def test_digest_of_kept_text(spark):
    row = line_dedup.deduplicate(documents(spark, [(1, "é\nb")]), "doc_id", "text").select(F.sha2("kept_text", 256).alias("s")).first()
    assert row.s == hashlib.sha256("é\nb".encode()).hexdigest()
