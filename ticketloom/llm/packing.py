"""Best-fit packing (operator 2): tokenized documents into sequences of at most ``CAPACITY`` tokens.

Documents are tokenized where they are read; only a small row per piece moves on. Pieces are dealt to
bins by best fit with bounded space: a task keeps at most a fixed number of open sequences, filed by free
space, with one bit per amount of free space in a bitset. A piece takes the lowest set bit at or above
its length, which is the fullest sequence it fits. Where none fits, a new sequence opens, and if all
places are taken the fullest one closes first.

A packing task needs enough pieces to fill sequences well, and no more: tasks are made for about
``TOKENS_PER_TASK`` tokens each, so their number follows the input. Inside a task pieces arrive in order
of their key, not of their length: packing is online, and a piece is placed before the next one is seen.
About 1,000 sequences come of such a task and at most ``OPEN_SEQUENCES`` are open at a time, so the bound binds.

Defined cases: a null text is empty and is its closing id alone; only documents longer than the
capacity are cut; rows that repeat a document are packed each on their own; a null key is a row like
any other; an empty table gives an empty result. Only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import stored
from . import bpe

CAPACITY = 4096
CLOSING_ID = 1
OPEN_SEQUENCES = 256
TOKENS_PER_TASK = 4_000_000


def token_pieces(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY,
                 closing_id: int = CLOSING_ID, with_ids: bool = False) -> DataFrame:
    """key, piece, start, length, ids_crc32, and ``ids`` (little-endian unsigned) if asked for."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, closing = bpe.encoder(path), closing_id.to_bytes(4, "little")
        for batch in batches:
            keys = batch.column("_key")
            for first, texts in bpe.in_slices(batch.column("_text")):
                at, pieces, starts, lengths, sums, data = [], [], [], [], [], []
                for offset, ids in enumerate(encoder.ids(texts)):
                    ids += closing
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start:4 * (start + capacity)]
                        at.append(first + offset)
                        pieces.append(piece)
                        starts.append(start)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        data.append(part)
                columns = [keys.take(pa.array(at, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()),
                           pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(data, pa.binary())] if with_ids else []), names=names)

    names = [key, "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    long = T.LongType()
    kinds = [df.schema[key].dataType, T.IntegerType(), long, long, long] + ([T.BinaryType()] if with_ids else [])
    schema = T.StructType([T.StructField(n, kind) for n, kind in zip(names, kinds)])
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(cut, schema)


class OpenSequences:
    """A fixed number of open sequences by free space. ``bits`` has bit f set if one has f free."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.open, self.bits, self.closed = capacity, most, 0, 0, 0
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The sequence a piece goes to and its offset there."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            number = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.closed
            self.closed += 1
        if free > length:
            self.by_space[free - length].append(number)
            self.bits |= 1 << (free - length)
            self.open += 1
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.by_space[free].pop()
        if not self.by_space[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return number


def pack(pieces: DataFrame, length: str, capacity: int = CAPACITY, open_sequences: int = OPEN_SEQUENCES,
         tokens_per_task: int = TOKENS_PER_TASK) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; every length is from 1 to ``capacity``."""
    spark = pieces.sparkSession
    total = pieces.agg(F.sum(length)).first()[0] or 0
    tasks = max(1, -(-total // tokens_per_task))
    # Pieces go to tasks by a hash of all they are, so a hot key spreads. They arrive in order of all columns, so
    # a lost task repeats.
    columns = pieces.columns
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in columns]), F.lit(tasks)).cast("int")
    dealt = pieces.withColumn("_task", spread).repartition(int(tasks), "_task").sortWithinPartitions(
        "_task", *[F.col(f"`{c}`") for c in columns])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, opened = None, None
        for batch in batches:
            numbers, offsets = [], []
            for task, size in zip(batch.column("_task").to_pylist(), batch.column(length).to_pylist()):
                if task != now:
                    now, opened = task, OpenSequences(capacity, open_sequences)
                number, offset = opened.place(size)
                numbers.append((task << 40) + number)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + [pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                                             names=[*columns, "sequence_id", "offset"])

    return dealt.mapInArrow(fill, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                                                T.StructField("offset", T.LongType())]))


def pack_documents(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY) -> DataFrame:
    pieces = stored(token_pieces(df, key, text, path, capacity), "pieces")
    return pack(pieces, "length", capacity)
