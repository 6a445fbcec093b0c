"""Token counts (operator 11): pieces are counted once per distinct pre-token, no ids are made.

A byte-level BPE tokenizer cuts a text into pre-tokens and splits each of them into pieces on its own,
so a text's token count is the sum over its distinct pre-tokens of how often it has one times the
pieces of that one.

1. *Frequencies.* A scan cuts every text into pre-tokens and counts them per document. Documents that
   are read together make a block of about ``BLOCK`` characters: the block's distinct pre-tokens are
   listed once, and each document keeps (place in that list, frequency) pairs, packed. The blocks are
   stored, so a lost executor costs a task.
2. *Pieces.* (pre-token, block, place) rows are dealt by pre-token, a row per block that has it, and each
   distinct pre-token is split once where its rows meet. A pre-token that every document holds has
   as many rows as there are blocks, which is thousands of times fewer than documents.
3. *Sum.* (place, pieces) pairs return to their block, and a document's count is the inner product of its
   frequencies with them.

Pre-tokens are cut by the tokenizer's own pattern. Texts with characters that are not assigned in the
Unicode version of this Python, where the pattern's library may know more, are cut by the tokenizers
library instead. Texts are cut in parts of about ``PART`` characters, before a space behind another
character, where no pre-token goes across. Special tokens inside a text count as one token each.

Defined cases: a null or empty text has 0 bytes and 0 tokens; a text of any length is counted whole;
equal rows count alike and each keeps its row; a null key is a row like any other; an empty table gives
an empty result. Only the two named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored

# Fixed value: the published pattern of byte-level BPE pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK = 1 << 24
PART = 1 << 20
FLUSH = 1 << 20
_PRETOKENS = regex.compile(PATTERN)
_CUT = regex.compile(r"(?<=\S) ")


class PreTokenizer:
    """The pre-tokens of a byte-level tokenizer file, and the pieces of a pre-token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        layout = json.loads(self.library.to_str())
        before, added = layout["pre_tokenizer"] or {}, layout["added_tokens"]
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or layout["normalizer"]:
            raise ValueError(f"{path} is not a byte-level BPE tokenizer with the usual pattern")
        if any(a[flag] for a in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take in what is around them")
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, names))) if names else None
        self.unassigned: dict[str, bool] = {}

    def _by_library(self, text: str) -> bool:
        if text.isascii():
            return False
        known = self.unassigned
        for c in set(text):
            if c not in known:
                known[c] = unicodedata.category(c) == "Cn"
        return any(known[c] for c in set(text))

    def cut(self, text: str) -> list[str]:
        if self._by_library(text):
            return [text[start:end] for _, (start, end) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return _PRETOKENS.findall(text)

    def counts(self, text: str) -> tuple[Counter, int]:
        """Frequency by pre-token, and the number of special tokens."""
        parts = self.special.split(text) if self.special and "<" in text else [text]
        counted: Counter = Counter()
        for part in parts:
            for piece in in_parts(part):
                counted.update(self.cut(piece))
        return counted, len(parts) - 1

    def pieces(self, words: list[str]) -> np.ndarray:
        """The number of pieces of each pre-token."""
        encoded = self.library.encode_batch_fast(words, add_special_tokens=False)
        return np.fromiter((len(e) for e in encoded), dtype=np.int32, count=len(words))


@lru_cache(maxsize=2)
def pre_tokenizer(path: str) -> PreTokenizer:
    """One per Python process."""
    return PreTokenizer(path)


def in_parts(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts that no pre-token goes across."""
    size, start = size or PART, 0
    while len(text) - start > size:
        cut = _CUT.search(text, start + size)
        if cut is None:
            break
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers as differences, byte by byte, compressed."""
    steps = np.diff(numbers.astype("<i4"), prepend=np.int32(0)).astype("<i4")
    return zstandard.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i4").ravel(), dtype=np.int32)


def _one_list(values, kind: pa.DataType) -> pa.Array:
    return pa.array([values], pa.list_(kind))


class _Block:
    def __init__(self):
        self.place: dict[str, int] = {}
        self.keys, self.n_bytes, self.special, self.sizes, self.places, self.frequencies = [], [], [], [], [], []
        self.characters = 0

    def add(self, text: str, counts: Counter, special: int) -> None:
        at, place = np.empty(len(counts), dtype=np.int32), self.place
        for i, word in enumerate(counts):
            at[i] = place.setdefault(word, len(place))
        often = np.fromiter(counts.values(), dtype=np.int32, count=len(counts))
        order = np.argsort(at)
        self.places.append(at[order])
        self.frequencies.append(often[order])
        self.sizes.append(len(at))
        self.special.append(special)
        self.n_bytes.append(len(text) if text.isascii() else len(text.encode()))
        self.characters += len(text)

    def batch(self, number: int, key_type: pa.DataType) -> pa.RecordBatch:
        none = [np.zeros(0, dtype=np.int32)]
        keys = pa.concat_arrays([k.cast(key_type) for k in self.keys])
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
             _one_list(self.n_bytes, pa.int64()), _one_list(self.special, pa.int64()), _one_list(self.sizes, pa.int32()),
             pa.array([pack(np.concatenate(self.places or none))], pa.binary()),
             pa.array([pack(np.concatenate(self.frequencies or none))], pa.binary()), _one_list(list(self.place), pa.string())],
            names=["block", "keys", "n_bytes", "special", "sizes", "places", "frequencies", "words"])


def frequencies(df: DataFrame, key: str, text: str, path: str, characters: int = BLOCK) -> DataFrame:
    """A row per block: its documents, their packed frequencies, and the block's distinct pre-tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, block, number = pre_tokenizer(path), _Block(), TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, start = batch.column("_key"), 0
            for i, value in enumerate(batch.column("_text")):
                words = value.as_py() or ""
                block.add(words, *cutter.counts(words))
                if block.characters >= characters:
                    block.keys.append(keys.slice(start, i + 1 - start))
                    yield block.batch(number, keys.type)
                    block, number, start = _Block(), number + 1, i + 1
            if start < len(keys):
                block.keys.append(keys.slice(start))
        if block.keys:
            yield block.batch(number, block.keys[0].type)

    many = lambda kind: T.ArrayType(kind)
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", many(df.schema[key].dataType)), T.StructField("n_bytes", many(T.LongType())),
        T.StructField("special", many(T.LongType())), T.StructField("sizes", many(T.IntegerType())), T.StructField("places", T.BinaryType()),
        T.StructField("frequencies", T.BinaryType()), T.StructField("words", many(T.StringType()))])
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(scan, schema)


def pieces_by_block(blocks: DataFrame, path: str, flush: int = FLUSH) -> DataFrame:
    """(block, places, pieces), packed; a block has a row for each task that met some of its pre-tokens."""

    def packed(held: list[tuple]) -> pa.RecordBatch:
        block, place, pieces = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((place, block))
        block, place, pieces = block[order], place[order], pieces[order]
        starts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        ends = [*starts[1:].tolist(), len(block)]
        return pa.RecordBatch.from_arrays(
            [pa.array(block[starts]), pa.array([pack(place[s:e]) for s, e in zip(starts, ends)], pa.binary()),
             pa.array([pack(pieces[s:e]) for s, e in zip(starts, ends)], pa.binary())], names=["block", "places", "pieces"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, held, size, last, last_pieces = pre_tokenizer(path), [], 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word")
            begins = np.concatenate(([words[0].as_py() != last], pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)))
            fresh = np.concatenate(([last_pieces], cutter.pieces(words.filter(pa.array(begins)).to_pylist()))).astype(np.int32)
            pieces = fresh[np.cumsum(begins)]
            last, last_pieces = words[-1].as_py(), int(pieces[-1])
            held.append((batch.column("block").to_numpy(), batch.column("place").to_numpy(), pieces))
            size += batch.num_rows
            if size >= flush:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    listed = blocks.select("block", F.posexplode("words").alias("place", "word"))
    met = listed.repartition("word").sortWithinPartitions("word")
    return met.mapInArrow(count, "block long, places binary, pieces binary")


def token_counts(df: DataFrame, key: str, text: str, path: str, characters: int = BLOCK) -> DataFrame:
    """key, ``n_bytes`` (UTF-8) and ``n_tokens``, a row per row of ``df``."""
    key_type = df.schema[key].dataType
    blocks = stored(frequencies(df, key, text, path, characters), "frequencies")
    returned = pieces_by_block(blocks, path).groupBy("block").agg(F.collect_list(F.struct("places", "pieces")).alias("_pieces"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one = {name: batch.column(name)[row] for name in batch.schema.names}
                places, often = unpack(one["places"].as_py()), unpack(one["frequencies"].as_py())
                by_place = np.zeros(int(places.max(initial=-1)) + 1, dtype=np.int64)
                for part in one["_pieces"].as_py() or ():
                    by_place[unpack(part["places"])] = unpack(part["pieces"])
                upto = np.concatenate(([0], np.cumsum(often * by_place[places])))
                ends = np.cumsum(one["sizes"].values.to_numpy(), dtype=np.int64)
                tokens = np.diff(upto[ends], prepend=0) + one["special"].values.to_numpy()
                yield pa.RecordBatch.from_arrays([one["keys"].values, one["n_bytes"].values, pa.array(tokens, pa.int64())],
                                                 names=[key, "n_bytes", "n_tokens"])

    joined = blocks.drop("words").join(returned.hint("shuffle_hash"), "block", "left")
    return joined.mapInArrow(add_up, T.StructType([T.StructField(key, key_type), T.StructField("n_bytes", T.LongType()),
                                                   T.StructField("n_tokens", T.LongType())]))
