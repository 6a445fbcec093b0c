"""Token counts against the tokenizers library."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketloom.llm import token_counts
from ticketloom.llm.common import table
from ticketloom.llm.queries import QUERIES, tokenizer_path

SF_DIR = "/root/testdata/sf0.001"
PATH = tokenizer_path("byte_bpe_50k.json")
# Unassigned and lately assigned characters, white space of all kinds, special tokens, long runs.
ODD = [None, "", " ", "\n\n a\t b\r\n  ", "It's the dog's, isn't it?!  'S 'LL", "<|endoftext|>", "a<|endoftext|><|endoftext|> b<|endo", "Ünïcode, é.",
       "日本語。 　wide\x1cunit\x85next​", "a՘b࢏ ꟎1 \U00010940x", "x1y22 333", "... !!! ?", "😀, 👍🏽.", "ab" * 40_000,
       "the cat  sat \n\n on " * 9_000, " " * 5_000 + "x", "é é  a  b"]


@pytest.fixture(scope="module")
def library():
    loaded = Tokenizer.from_file(PATH)
    return lambda text: (len((text or "").encode()), len(loaded.encode(text or "", add_special_tokens=False).ids))


@pytest.mark.parametrize("characters", [1, 5_000, token_counts.BLOCK])
def test_odd_texts(spark, library, monkeypatch, characters):
    rows = [*enumerate(ODD), (None, "null key"), (4, ODD[4]), (4, "same id, other text")]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clashing = documents.withColumns({c: F.lit(1) for c in ("block", "words", "places", "_text", "_key", "n_tokens", "sizes")})
    found = token_counts.token_counts(clashing, "doc_id", "text", PATH, characters).collect()
    want = [(key, *library(text)) for key, text in rows]
    order = lambda row: (row[0] is not None, row)
    assert sorted(map(tuple, found), key=order) == sorted(want, key=order)


def test_parts_of_long_texts(library):
    cutter = token_counts.pre_tokenizer(PATH)
    for text in ODD:
        for size in (1, 2, 7):
            if text and len(text) < 200:
                parts = list(token_counts.in_parts(text, size))
                assert "".join(parts) == text
                assert [w for p in parts for w in cutter.cut(p)] == cutter.cut(text)


def test_packed_numbers():
    for numbers in ([], [0], [5, 5, 1, 2 ** 31 - 1, 0], list(range(1000))):
        assert token_counts.unpack(token_counts.pack(np.array(numbers, dtype=np.int32))).tolist() == numbers


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_counts.PreTokenizer(tokenizer_path())


def test_empty_table(spark):
    empty = spark.createDataFrame([], "k string, text string")
    assert token_counts.token_counts(empty, "k", "text", PATH).collect() == []


def test_query_against_the_library(spark, library):
    texts = {r.doc_id: r.text for r in table(spark, SF_DIR, "documents").collect()}
    for r in QUERIES["op11_token_counts"](spark, SF_DIR).collect():
        assert (r.n_bytes, r.n_tokens) == library(texts.pop(r.doc_id)) and r.over_limit == (r.n_tokens > 1024)
    assert not texts
