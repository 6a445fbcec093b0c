"""CSV records by split against Spark's own reader, which reads a file with line breaks in one task."""

import random

import pytest
from pyspark.sql import functions as F

from ticketloom.sources import csv_records, csv_tickets

FIELDS = ["", '""', '"a\nb, c\n\n""q"" d"', 'pipe 5" wide', '"x,y"', ' "lead', '"""start"', '"line\r\nbreak"', '"closed"junk', "w" * 8,
          '"one\n"', '"\nlast ""\n"""', "é", '"' + "long " * 400 + '\n"']


@pytest.fixture(params=["700", "20000", "128m"])
def split_bytes(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def test_records_equal_the_readers(spark, tmp_path, split_bytes):
    rng, rows = random.Random(2), 400
    for n in range(3):
        with open(tmp_path / f"f{n}.csv", "w", newline="", encoding="utf-8") as file:
            file.write(("﻿" if n == 1 else "") + 'review,"customer\n_name",contact\n')
            for i in range(rows):
                file.write(",".join([f"r{n}-{i}", rng.choice(FIELDS), rng.choice(FIELDS)]) + rng.choice(["\n", "\n", "\n\n"]))
    (tmp_path / "f3.csv").write_text("\n\n")
    want = spark.read.csv(str(tmp_path / "f[012].csv"), header=True, **csv_tickets._OPTIONS).collect()
    found = csv_tickets._read_parallel(spark, str(tmp_path)).collect()
    assert sorted(map(str, (tuple(r)[:3] for r in found))) == sorted(str(tuple(r)) for r in want)
    assert {r.review: r.row_number for r in found} == {f"r{n}-{i}": n * rows + i + 1 for n in range(3) for i in range(rows)}
    if split_bytes == "700":
        assert csv_records._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20


def test_line_ends_of_other_systems(spark, tmp_path, split_bytes):
    (tmp_path / "a.csv").write_bytes(b'review,name\r\n"x\r\ny",1\r\nz,\r\n\r\nlast,"3"')
    rows = csv_tickets.read_tickets_csv(spark, str(tmp_path)).orderBy("row_number").collect()
    assert [(r.row_number, r.review, r.customer_name) for r in rows] == [(1, "x\r\ny", "1"), (2, "z", None), (3, "last", "3")]


def test_an_open_quote_takes_the_rest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('review\none\n"two\nthree\nfour\n')
    rows = csv_tickets.read_tickets_csv(spark, str(tmp_path)).collect()
    assert sorted(r.row_number for r in rows) == [1, 2]


def test_headers_that_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("review,name\none,x\n")
    (tmp_path / "b.csv").write_text("review,phone\ntwo,y\n")
    with pytest.raises(Exception, match="differ in their headers"):
        csv_tickets.read_tickets_csv(spark, str(tmp_path)).collect()


def test_long_quoted_text(spark, tmp_path):
    text = 'said ""so"" ' * 50_000
    (tmp_path / "a.csv").write_text(f'review,name\n"{text}\nend",x\n"{text}",y\n')
    rows = csv_tickets.read_tickets_csv(spark, str(tmp_path)).agg(F.sum(F.length("review")).alias("n")).first()
    assert rows.n == 2 * len(text.replace('""', '"')) + 4
