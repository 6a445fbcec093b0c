"""BPE encoding and decoding (operator 5): a table of distinct words.

The tokenizer drops white space and never joins characters across it, so a text is the sequence of
its words (cut at space and line feed), and its ids are the ids of its words in order.

1. *Frequent words.* The words of a bounded sample of texts are counted, and the ``FREQUENT`` most
   frequent ones are encoded, each once. This table has a fixed bound and is broadcast; it only decides
   which way a word takes, not whether it is encoded. ASCII words count in lower case, as the
   tokenizer reads them, and a full stop or comma after a letter counts as a word.
2. *Other words.* Every text lists its other words, each once, with their place in sorted order.
   They are dealt by word, so each distinct word meets in one place and is encoded once there.
3. *Join by position.* Their ids go back to the text they came from, in order of place, and the
   text's ids are put together. A text moves through the shuffle once, as the numbers of its words.

Decoding joins ids with the table of pieces, which the vocabulary bounds, in order.

Defined cases: a null text is empty and has no ids; a text of any length is encoded whole; equal rows
give equal results, and rows that share a key keep apart by their text; a null key is a row like any
other; ids outside the vocabulary decode to nothing; an empty table gives an empty result. Only the
named columns are read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FREQUENT = 600_000
SAMPLE_TEXTS = 32_000
LONGEST_FREQUENT = 64
_WORDS_KEPT = 1_000_000
_BYTES_AT_ONCE = 1 << 22
_IDS_AT_ONCE = 1 << 19
MARKS = (".", ",")
_MARKED = "[" + "".join(c for c in map(chr, range(65, 256)) if c.isalpha()) + "][.,]\\z"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def words_of(text: str | None) -> list[str]:
    return (text or "").replace("\n", " ").split(" ")


def split_words(texts: pa.Array) -> pa.ListArray:
    """As ``words_of``, for a column."""
    return pc.split_pattern(pc.replace_substring(texts.cast(pa.string()).fill_null(""), "\n", " "), " ")


def strings(words: pa.Array) -> list[str]:
    """As ``to_pylist``, several times faster."""
    return words.to_numpy(zero_copy_only=False).tolist()


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary column in a row, and where each begins and the last ends."""
    values = values.cast(pa.binary())
    upto = np.frombuffer(values.buffers()[1] or b"\0" * 4, dtype=np.int32)[values.offset:values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2] or b"", dtype=np.uint8)[upto[0]:upto[-1]], upto - upto[0]


def encode_words(path: str, words: list[str]) -> list[bytes]:
    """The ids of each word, little-endian and unsigned, 32 bits each."""
    encoded = tokenizer(path).encode_batch_fast(words, add_special_tokens=False)
    return [np.array(e.ids, dtype="<u4").tobytes() for e in encoded]


class Encoder:
    """Whole texts to ids inside one Python process. It remembers words up to a bound; the words it met
    first, which are mostly the frequent ones, stay when the others go."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, bytes] = {"": b""}

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """As ``encode_words`` writes them, for each text."""
        split = [words_of(text) for text in texts]
        met = set(chain.from_iterable(split))
        new = list(met.difference(self.known))
        if len(self.known) + len(new) > _WORDS_KEPT:
            self.known = dict(islice(self.known.items(), _WORDS_KEPT // 2))
            new = list(met.difference(self.known))
        self.known.update(zip(new, encode_words(self.path, new)))
        find = self.known.__getitem__
        return [b"".join(map(find, words)) for words in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per Python process, kept from task to task."""
    return Encoder(path)


def parts(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """For each word, one that has the same ids up to its last mark, and that mark: 1 and 2 as in ``MARKS``, or 0."""
    plain = pc.invert(pc.match_substring(words, "<|"))  # else it may be a special token, which case tells from plain text
    marked = pc.and_(plain, pc.match_substring_regex(words, _MARKED))
    base = pc.if_else(marked, pc.utf8_slice_codeunits(words, 0, -1), words)
    base = pc.if_else(pc.and_(plain, pc.string_is_ascii(base)), pc.ascii_lower(base), base)
    comma = pc.ends_with(words, MARKS[1]).to_numpy(zero_copy_only=False)
    return base, np.where(marked.to_numpy(zero_copy_only=False), 1 + comma, 0)


def number_bytes(number: int) -> bytes:
    """A whole number in bytes of seven bits, low ones first; all but the last have the eighth bit."""
    if number < 1 << 7:
        return bytes((number,))
    if number < 1 << 14:
        return bytes((number & 127 | 128, number >> 7))
    if number < 1 << 21:
        return bytes((number & 127 | 128, number >> 7 & 127 | 128, number >> 14))
    data = bytearray()
    while number > 127:
        data.append(number & 127 | 128)
        number >>= 7
    data.append(number)
    return bytes(data)


def numbers_of(data: np.ndarray) -> np.ndarray:
    """The numbers that ``number_bytes`` wrote, from an array of bytes."""
    ends = np.flatnonzero(data < 128)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    numbers, sizes = (data[starts] & 127).astype(np.int64), ends - starts
    for k in range(1, sizes.max(initial=0) + 1):
        longer = np.flatnonzero(sizes >= k)
        numbers[longer] |= (data[starts[longer] + k] & 127).astype(np.int64) << (7 * k)
    return numbers


def coded_numbers(numbers: np.ndarray, marks: np.ndarray, mark_bytes: list[bytes]) -> pa.Array:
    """For each number ``number_bytes`` of it, and the bytes of its mark behind them."""
    sizes = np.ones(len(numbers), dtype=np.int64)
    for k in range(1, int(numbers.max(initial=0)).bit_length() // 7 + 1):
        sizes += numbers >= 1 << (7 * k)
    ends = np.cumsum(sizes + np.array([len(x) for x in mark_bytes])[marks])
    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
    data = np.empty(ends[-1] if len(ends) else 0, dtype=np.uint8)
    for k in range(sizes.max(initial=0)):
        longer = np.flatnonzero(sizes > k)
        data[starts[longer] + k] = (numbers[longer] >> (7 * k) & 127) | np.where(sizes[longer] > k + 1, 128, 0)
    for mark, written in enumerate(mark_bytes):
        at = np.flatnonzero(marks == mark)
        for k, byte in enumerate(written):
            data[starts[at] + sizes[at] + k] = byte
    return pa.BinaryArray.from_buffers(pa.binary(), len(numbers), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)),
                                                                   pa.py_buffer(data)])


class FrequentWords:
    """Frequent words by rank, with their ids: a few arrays, small enough to send to every executor."""

    def __init__(self, words: list[str], ids: list[bytes]):
        self.words = pa.array(words, pa.string())
        self.table = np.frombuffer(b"".join(ids), dtype="<i4")
        self.starts = np.cumsum([0, *(len(x) // 4 for x in ids)])
        hashes = self._hashes(words)
        self.order = np.argsort(hashes, kind="stable")
        self.sorted = hashes[self.order]
        self.marks = [b"", *(number_bytes(words.index(mark)) for mark in MARKS)]

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))

    def ranks(self, words: pa.Array) -> np.ndarray:
        """The rank of each word, -1 for others. Words that share a hash are told apart by the words."""
        hashes = self._hashes(strings(words))
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        found = np.where(self.sorted[at] == hashes, self.order[at], 0)
        same = pc.equal(self.words.take(pa.array(found)), words).to_numpy(zero_copy_only=False)
        return np.where(same, found, -1)


class Coder:
    """Texts as numbers of words: their rank among the frequent ones, and behind those the place of a
    word among the text's other words, in sorted order. The texts of a run are read together: each of their
    distinct words is looked up once, and what is done for every word is done in columns."""

    def __init__(self, frequent: FrequentWords, texts: pa.Array):
        split = split_words(texts)
        words = split.flatten().dictionary_encode()
        base, marks = parts(words.dictionary)
        ranks = frequent.ranks(base)
        empty = pc.equal(words.dictionary, "").to_numpy(zero_copy_only=False)
        self.bounds = split.offsets.to_numpy()
        self.number = words.indices.to_numpy()
        #: Where the other words stand, and the distinct ones among them in sorted order.
        beyond = np.flatnonzero((ranks < 0) & ~empty)
        bases = base.take(pa.array(beyond)).dictionary_encode()
        order = pc.array_sort_indices(bases.dictionary)
        self.base = bases.dictionary.take(order)
        place = np.empty(len(order), dtype=np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        in_order = np.full(len(base), -1, dtype=np.int64)
        in_order[beyond] = place[bases.indices.to_numpy()]
        word = in_order[self.number]
        self.at = np.flatnonzero(word >= 0)
        #: A pair for each text and other word in it, in order of both, and its place in its text.
        text = np.searchsorted(self.bounds, self.at, side="right") - 1
        pairs, self.pair = np.unique(text * max(len(self.base), 1) + word[self.at], return_inverse=True)
        self.text, self.word = np.divmod(pairs, max(len(self.base), 1))
        self.place = np.arange(len(pairs)) - np.searchsorted(self.text, self.text)
        self.frequent, self.ranks, self.marks, self.empty = frequent, ranks, marks, empty

    def others(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The words that are not frequent, each once for each text it is in: number of the text, place, word."""
        return self.text, self.place, self.base.take(pa.array(self.word))

    def code(self) -> pa.Array:
        mark_bytes = self.frequent.marks
        codes = coded_numbers(np.maximum(self.ranks, 0), self.marks, mark_bytes)
        codes = pc.if_else(pa.array(self.empty), pa.scalar(b"", pa.binary()), codes)
        others = coded_numbers(len(self.frequent.words) + self.place[self.pair], self.marks[self.number[self.at]], mark_bytes)
        of_word = self.number.astype(np.int64)
        of_word[self.at] = len(codes) + np.arange(len(self.at))
        written = pa.concat_arrays([codes, others]).take(pa.array(of_word))
        data, upto = bytes_of(written)
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.bounds) - 1, [None, pa.py_buffer(upto[self.bounds]), pa.py_buffer(data)])


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Start and length of runs of rows whose sizes sum up to ``most``, or that are one larger row."""
    upto, start = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(upto, upto[start] + most, side="right")) - 1)
        yield start, end - start
        start = end


def text_runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts whose texts are of bounded size together."""
    for start, rows in runs(pc.binary_length(batch.column("_text")).fill_null(0).to_numpy(), _BYTES_AT_ONCE):
        yield batch.slice(start, rows)


def in_slices(texts: pa.Array, characters: int = 1 << 20) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in runs of bounded size, with the place of the first one."""
    start, size, run = 0, 0, []
    for i, text in enumerate(texts):
        value = text.as_py()
        run.append(value)
        size += len(value or "")
        if size >= characters:
            yield start, run
            start, size, run = i + 1, 0, []
    if run:
        yield start, run


def frequent_words(df: DataFrame, text: str, path: str, most: int = FREQUENT, texts: int = SAMPLE_TEXTS) -> FrequentWords:
    """The most frequent words of a sample, of at most ``LONGEST_FREQUENT`` characters, with their ids:
    at most ``most`` words, from about ``texts`` texts chosen by a hash of their text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in text_runs(batch):
                forms = pc.value_counts(split_words(run.column("_text")).flatten())
                bases = pa.table({"word": parts(forms.field("values"))[0], "n": forms.field("counts")})
                length = pc.utf8_length(bases.column("word"))
                kept = bases.filter(pc.and_(pc.greater(length, 0), pc.less_equal(length, LONGEST_FREQUENT)))
                yield from kept.group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"]).to_batches()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = pa.array(encode_words(path, strings(batch.column("word"))), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), ids], names=["word", "n", "ids"])

    share = min(1.0, texts / max(df.count(), 1))
    drawn = df.filter(F.pmod(F.xxhash64(F.col(text)), F.lit(1 << 32)) < int(share * (1 << 32))).select(F.col(text).alias("_text"))
    counts = drawn.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = counts.mapInArrow(encoded, "word string, n long, ids binary").orderBy(F.desc("n"), "word").limit(most).toArrow()
    words = {mark: encode_words(path, [mark])[0] for mark in MARKS}
    words |= zip(found.column("word").to_pylist(), found.column("ids").to_pylist())
    return FrequentWords(list(words), list(words.values()))


def _look_up(codes: pa.Array, found: pa.Array, frequent: FrequentWords) -> Iterator[tuple[int, pa.ListArray]]:
    """The ids of coded texts, in runs of bounded size with the place of the first one. ``found`` has places
    and ids of each text's other words."""
    data, codes_upto = bytes_of(codes)
    numbers = numbers_of(data)
    words_upto = np.concatenate(([0], np.cumsum(data < 128)))[codes_upto]
    # The texts' other words follow the table, text after text.
    others, flat = pc.list_value_length(found).fill_null(0).to_numpy(), found.flatten()
    ordered = np.lexsort((flat.field("place").to_numpy(), np.repeat(np.arange(len(others)), others)))
    own, own_upto = bytes_of(flat.field("word_ids").take(pa.array(ordered)))
    table = np.concatenate((frequent.table, own.view("<i4")))
    bounds = np.concatenate((frequent.starts, frequent.starts[-1] + own_upto[1:] // 4))
    first = np.cumsum([0, *others])[:-1]
    words = np.where(numbers < len(frequent.words), numbers, numbers + np.repeat(first, np.diff(words_upto)))
    lengths = bounds[words + 1] - bounds[words]
    ids_upto = np.concatenate(([0], np.cumsum(lengths)))
    for start, some in runs(np.diff(ids_upto[words_upto]), _IDS_AT_ONCE):
        part = slice(words_upto[start], words_upto[start + some])
        upto = ids_upto[part.start:part.stop + 1] - ids_upto[part.start]
        ids = table[np.repeat(bounds[words[part]] - upto[:-1], lengths[part]) + np.arange(upto[-1])]
        of_text = upto[words_upto[start:start + some + 1] - part.start]
        yield start, pa.ListArray.from_arrays(pa.array(of_text, pa.int32()), pa.array(ids, pa.int32()))


def encode(df: DataFrame, key: str, text: str, path: str, most: int = FREQUENT) -> DataFrame:
    """key and ``ids`` (array of int), a row per row of ``df``."""
    spark: SparkSession = df.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_words(df.select(F.col(text).alias("_text")), "_text", path, most))
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"),
                     F.xxhash64(F.col(key), F.coalesce(F.col(text), F.lit(""))).alias("_row"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in text_runs(batch):
                of, place, words = Coder(frequent.value, run.column("_text")).others()
                yield pa.RecordBatch.from_arrays([run.column("_row").take(pa.array(of)), pa.array(place, pa.int32()), words],
                                                 names=["row", "place", "word"])

    def each_word_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_ids = None, b""
        for batch in batches:
            words = batch.column("word").dictionary_encode()
            distinct = strings(words.dictionary)
            known = [last_ids] if distinct[:1] == [last] else []  # words are sorted, so only the first can be known
            ids = known + encode_words(path, distinct[len(known):])
            if distinct:
                last, last_ids = distinct[-1], ids[-1]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("place"), pa.array(ids, pa.binary()).take(words.indices)],
                                             names=["row", "place", "word_ids"])

    listed = rows.select("_row", "_text").mapInArrow(others, "row bigint, place int, word string")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded = listed.repartition(partitions, "word").sortWithinPartitions("word").mapInArrow(
        each_word_once, "row bigint, place int, word_ids binary")
    by_row = encoded.repartition(partitions, "row").dropDuplicates(["row", "place"]).groupBy("row").agg(
        F.collect_list(F.struct("place", "word_ids")).alias("_found"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in text_runs(batch):
                yield pa.RecordBatch.from_arrays([run.column("_key"), run.column("_row"), Coder(frequent.value, run.column("_text")).code()],
                                                 names=["_key", "_row", "_code"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in runs(pc.binary_length(batch.column("_code")).to_numpy(), _IDS_AT_ONCE):
                run = batch.slice(first, rows)
                for start, united in _look_up(run.column("_code"), run.column("_found"), frequent.value):
                    yield pa.RecordBatch.from_arrays([run.column("_key").slice(start, len(united)), united], names=[key, "ids"])

    key_type = df.schema[key].dataType
    coded = rows.mapInArrow(code, T.StructType([T.StructField("_key", key_type), T.StructField("_row", T.LongType()),
                                                T.StructField("_code", T.BinaryType())]))
    joined = coded.join(by_row.hint("shuffle_hash"), F.col("_row") == F.col("row"), "left").select("_key", "_code", "_found")
    return joined.mapInArrow(unite, T.StructType([T.StructField(key, key_type), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


@lru_cache(maxsize=2)
def piece_table(path: str) -> list[str | None]:
    """Pieces by id, as the vocabulary file bounds them; ids without a piece have none."""
    vocabulary = tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [None] * (max(vocabulary.values()) + 1)
    for piece, number in vocabulary.items():
        pieces[number] = piece
    return pieces


def decode(df: DataFrame, key: str, ids: str, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the columns of ``keep``, and ``decoded``: the pieces of the ids in order, joined by a space.
    The tokenizer has no decoder of its own, so this is what its decode returns."""

    def join_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = piece_table(path)
        pieces = pa.array([piece or None for piece in known], pa.string())
        has_piece = pieces.is_valid().to_numpy(zero_copy_only=False)
        for batch in batches:
            sizes = pc.list_value_length(batch.column(ids)).fill_null(0).to_numpy()
            for start, some in runs(sizes, _IDS_AT_ONCE):
                run = batch.slice(start, some)
                numbers = run.column(ids).flatten().fill_null(-1).to_numpy()
                inside = (numbers >= 0) & (numbers < len(pieces))
                inside[inside] = has_piece[numbers[inside]]
                upto = np.concatenate(([0], np.cumsum(inside)))[np.concatenate(([0], np.cumsum(sizes[start:start + some])))]
                texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pieces.take(pa.array(numbers[inside]))), " ")
                yield pa.RecordBatch.from_arrays([run.column(c) for c in (key, *keep)] + [texts], names=[key, *keep, "decoded"])

    fields = [df.schema[c] for c in (key, *keep)]
    return df.select(key, *[c for c in keep if c != ids], ids).mapInArrow(
        join_pieces, T.StructType([*fields, T.StructField("decoded", T.StringType())]))
