"""BPE and packing against the tokenizers library, by round trip and by recounting."""

import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketloom.llm import bpe, packing
from ticketloom.llm.common import table
from ticketloom.llm.queries import tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n a\t b\r\n", "It's the dog's, isn't it?!", "<|endoftext|>", "<|ENDOFTEXT|>", "a<|startoftext|>b,", "Ünïcode, é.",
       "é, ö.", "ΟΔΟΣ. İstanbul, Kelvin", "　wide space\x1cunit", "日本語。", "x.,", "...", "A.b.c,", "5, 6.7,",
       "don't, won't.", "😀, 👍🏽.", "the " * 30_000, "\x85next line"]


@pytest.fixture(scope="module")
def library():
    loaded = Tokenizer.from_file(tokenizer_path())
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def odd_documents(spark):
    rows = [*enumerate(ODD), (None, "null key."), (4, ODD[4]), (4, "same id, other text")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit(1), "_row": F.lit(2), "word": F.lit(3), "row": F.lit(4)})


@pytest.mark.parametrize("most", [3, bpe.FREQUENT])
def test_round_trip(spark, library, most):
    documents = odd_documents(spark).select("doc_id", "text").unionByName(table(spark, SF_DIR, "documents").select("doc_id", "text").limit(60))
    encoded = bpe.encode(documents.withColumn("ids", F.lit(1)), "doc_id", "text", tokenizer_path(), most)
    decoded = bpe.decode(encoded, "doc_id", "ids", tokenizer_path(), keep=("ids",)).collect()
    want = [library.encode(t or "", add_special_tokens=False).ids for t in (r.text for r in documents.collect())]
    assert sorted(list(r.ids) for r in decoded) == sorted(want)
    assert all(r.decoded == library.decode(list(r.ids), skip_special_tokens=False) for r in decoded)


def test_numbers_round_trip():
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 2 ** 21, 2 ** 40]
    data = b"".join(map(bpe.number_bytes, numbers))
    assert bpe.numbers_of(np.frombuffer(data, np.uint8)).tolist() == numbers
    assert bpe.numbers_of(np.zeros(0, np.uint8)).tolist() == []


def frequent_of(words):
    words = [*bpe.MARKS, *words]
    return bpe.FrequentWords(words, bpe.encode_words(tokenizer_path(), words))


@pytest.mark.parametrize("at_once", [1, 40, 1 << 20])
def test_coded_runs_give_the_ids_of_the_library(library, monkeypatch, at_once):
    monkeypatch.setattr(bpe, "_BYTES_AT_ONCE", at_once)
    monkeypatch.setattr(bpe, "_IDS_AT_ONCE", at_once)
    texts = [*ODD, "zz Yy. yy, ZZ x zz. <|endoftext|>, Zz", *(" ".join(f"w{i % 7}{j}." for j in range(i)) for i in range(200))]
    frequent = frequent_of(["the", "a", "zz", *(f"w{i}" for i in range(300))])
    codes, found = [], []
    for run in bpe.text_runs(pa.RecordBatch.from_arrays([pa.array(texts)], names=["_text"])):
        coder = bpe.Coder(frequent, run.column("_text"))
        codes.append(coder.code())
        own = [[] for _ in range(run.num_rows)]
        for text, place, word in zip(*map(list, coder.others())):
            own[text].insert(0, {"place": place, "word_ids": bpe.encode_words(tokenizer_path(), [word.as_py()])[0]})
        found += [words or None for words in own]
    found = pa.array(found, pa.list_(pa.struct([("place", pa.int32()), ("word_ids", pa.binary())])))
    united = [ids for _, run in bpe._look_up(pa.concat_arrays(codes), found, frequent) for ids in run.to_pylist()]
    assert united == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def calls_of(work):
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        work()
    finally:
        sys.setprofile(None)
    return len(calls)


def test_python_does_not_handle_word_by_word():
    # Calls made from Python for 40 texts; with ten times the words, half of them frequent, there are as many.
    def calls(words):
        texts = [" ".join(f"W{i % (2 * words)}{mark}" for i in range(k, k + words) for mark in ("", ".")) for k in range(40)]
        frequent, column = frequent_of([f"w{i}" for i in range(words)]), pa.array(texts)
        bpe.Coder(frequent, column).code()  # what is set up once
        return calls_of(lambda: (bpe.Coder(frequent, column).code(), bpe.Coder(frequent, column).others()))

    assert calls(1000) <= calls(100) + 20


def test_encoder_forgets_and_stays_right(library, monkeypatch):
    monkeypatch.setattr(bpe, "_WORDS_KEPT", 4)
    texts = [t for t in ODD if t and len(t) < 100]
    encoder = bpe.Encoder(tokenizer_path())
    for text in texts * 2:
        assert np.frombuffer(encoder.ids([text])[0], "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([(1, [5, -1, 10 ** 6, None]), (2, None), (3, [])], "k long, ids array<int>")
    found = {r.k: r.decoded for r in bpe.decode(df, "k", "ids", tokenizer_path()).collect()}
    assert found == {1: bpe.piece_table(tokenizer_path())[5], 2: "", 3: ""}


def test_empty_tables(spark):
    empty = odd_documents(spark).limit(0)
    assert bpe.encode(empty, "doc_id", "text", tokenizer_path()).collect() == []
    assert packing.pack_documents(empty, "doc_id", "text", tokenizer_path()).collect() == []


def check_places(rows, capacity):
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(used <= capacity for used in filled.values())
    return len(filled)


def test_packed_documents(spark, library):
    documents = odd_documents(spark).select("doc_id", "text").withColumn("piece", F.lit(1)).unionByName(
        table(spark, SF_DIR, "documents").select("doc_id", "text").withColumn("piece", F.lit(1)))
    rows = packing.pack_documents(documents, "doc_id", "text", tokenizer_path()).collect()
    want = []
    for r in documents.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, packing.CLOSING_ID]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start:start + 4096], "<u4").tobytes()
            want.append((r.doc_id or -1, piece, start, len(part) // 4, zlib.crc32(part)))
    assert sorted((r.doc_id or -1, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = check_places(rows, 4096)
    assert sequences <= -(-sum(w[3] for w in want) // 4096) + 1


@pytest.mark.parametrize("open_sequences", [1, 3, 1000])
def test_bounded_best_fit(spark, open_sequences):
    rng = random.Random(open_sequences)
    lengths = [rng.randint(1, 100) for _ in range(400)] + [100, 100, 1]
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    rows = packing.pack(pieces, "length", 100, open_sequences, tokens_per_task=5000).collect()
    assert sorted(r.length for r in rows) == sorted(lengths)
    assert len({r.sequence_id >> 40 for r in rows}) == -(-sum(lengths) // 5000)
    assert check_places(rows, 100) <= (1.7 if open_sequences < 10 else 1.1) * sum(lengths) / 100 + 5


def test_a_place_does_not_depend_on_later_pieces(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, packing.CAPACITY)) for i in range(3000)]
    place = lambda n: {r.doc_id: (r.sequence_id, r.offset) for r in packing.pack(
        spark.createDataFrame(rows[:n], "doc_id long, length long").repartition(5), "length", tokens_per_task=1 << 30).collect()}
    early, whole = place(1500), place(3000)
    assert all(whole[i] == place for i, place in early.items())


def test_the_bound_binds_at_the_size_of_a_task():
    rng = random.Random(6)
    places, closed, total = packing.OpenSequences(packing.CAPACITY, packing.OPEN_SEQUENCES), 0, 0
    while total < packing.TOKENS_PER_TASK:
        # A third of short pieces and two thirds over half a sequence, which open one each.
        length = rng.randint(1, 1000) if rng.random() < 0.33 else rng.randint(2100, packing.CAPACITY)
        closed += not places.bits >> length and places.open == packing.OPEN_SEQUENCES
        places.place(length)
        assert places.open <= packing.OPEN_SEQUENCES
        total += length
    assert closed > 100


def test_best_fit_takes_the_fullest_that_fits():
    places = packing.OpenSequences(10, 3)
    assert [places.place(n) for n in (6, 8, 3, 2, 5, 1, 10, 5)] == [(0, 0), (1, 0), (0, 6), (1, 8), (2, 0), (0, 9), (3, 0), (2, 5)]
    places = packing.OpenSequences(10, 1)
    assert [places.place(n) for n in (6, 7, 3)] == [(0, 0), (1, 0), (1, 7)]
