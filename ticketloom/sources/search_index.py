"""An inverted table of trigrams beside a ticket table: substring search that reads only tickets that may match.

Every three neighbouring characters of a ticket's lower-cased searched fields are a gram. The index has a row per gram and
block of ``BLOCK`` ticket ids with the places of the tickets in the block, so a row has at most ``BLOCK`` places
however common its gram is. Below the ticket table's root:

* ``grams/batch=<id>/``: the index of a batch, in ranges of grams and sorted in each file, so a look-up skips the
  row groups of other grams.
* ``indexed/``: a row per batch whose index is complete. One that broke off is not listed and is written again.

A pattern is cut at its wildcards into runs, and a ticket that matches holds all grams of every run. Of the rarest grams the
places are intersected block by block; ``tickets.search`` then decides on the tickets that remain, so the result is
that of the search without an index. Batches without an index, and patterns without a run of three characters,
are searched whole.

Null fields have no grams. Fields of a ticket share its grams: a ticket that holds them in different fields
is read and then refused. Deleted tickets stay in the index and are gone from the state that is searched.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import tickets as operators
from ..scratch import stored
from .ticket_table import TicketTable

BLOCK = 1 << 15
WIDTH = 3
FIELDS = ("review", "customer_name", "ticket_id")

# Bytes of text, unless one ticket has more, whose grams are listed at once.
_SLICE_BYTES = 1 << 21

# As many of a pattern's grams are intersected, the rarest ones; others would only refuse a few tickets earlier.
PROBES = 4

# Up to so many ids go to the scan as a list, which prunes buckets and row groups; more are joined.
LISTED = 1000

_GRAMS = "gram string, block bigint, places array<int>, batch string"
_INDEXED = "batch string"


def grams(text: Column) -> Column:
    """The distinct grams of a text that is lower-cased already; none for null."""
    def cut(letters: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(letters) - WIDTH)
        return F.transform(starts, lambda i: F.concat(*[F.get(letters, i + k) for k in range(WIDTH)]))

    # As the one element of an array the letters are split once; inside a lambda they would be for each gram.
    runs = F.transform(F.array(F.split(text, "")), cut)[0]
    return F.when(F.char_length(text) >= WIDTH, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _lister() -> Callable:
    """Turns batches of tickets (``id``, lower-cased fields) into (gram, block, places) with the distinct grams of a slice of them, as
    ``grams`` cuts them. A gram is a number, its characters' places in the alphabet of the slice, and is sorted together with its ticket's.

    Workers get it by value, whether or not they can import this package."""
    size, width, fields, slice_bytes = BLOCK, WIDTH, FIELDS, _SLICE_BYTES

    def slices(batch: pa.RecordBatch):
        lengths = [pc.fill_null(pc.binary_length(batch.column(f)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields]
        upto, start = np.cumsum(sum(lengths)), 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + slice_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop

    def listed(tickets: pa.RecordBatch) -> pa.RecordBatch:
        ids = tickets.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, rank = ids[order], np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        texts = [(t or b"").decode("utf-8", "replace") for f in fields for t in tickets.column(f).cast(pa.binary()).to_pylist()]
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        seen = np.zeros(0x110000, dtype=bool)
        seen[chars] = True
        alphabet = np.flatnonzero(seen)
        place = np.zeros(0x110000, dtype=np.int64)
        place[alphabet] = np.arange(len(alphabet))
        letters = place[chars]
        counts = np.maximum(lengths - width + 1, 0)
        # Grams begin at each character of a text but the last ones.
        starts = np.repeat(np.cumsum(lengths) - lengths - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        code = letters[starts]
        for k in range(1, width):
            code = code * len(alphabet) + letters[starts + k]
        known = None
        if len(alphabet) ** width > 1 << 40:
            # Of a large alphabet, such as that of Chinese, the grams that there are get numbers.
            known, code = np.unique(code, return_inverse=True)
        shift = len(ids).bit_length()
        pairs = np.sort((code << shift) | np.repeat(np.tile(rank, len(fields)), counts))
        pairs = pairs[np.concatenate([np.ones(min(len(pairs), 1), dtype=bool), pairs[1:] != pairs[:-1]])]
        code, owner = pairs >> shift, ids[pairs & ((1 << shift) - 1)]
        block = owner // size
        new = np.ones(len(pairs), dtype=bool)
        new[1:] = (code[1:] != code[:-1]) | (block[1:] != block[:-1])
        first = np.flatnonzero(new)
        code = code[first] if known is None else known[code[first]]
        points = [alphabet[code // len(alphabet) ** k % len(alphabet)] for k in reversed(range(width))] if len(first) else []
        whole = np.stack(points, axis=1).astype("<u4").tobytes().decode("utf-32-le") if points else ""
        names = [whole[i:i + width] for i in range(0, len(whole), width)]
        places = pa.ListArray.from_arrays(pa.array(np.append(first, len(pairs)), pa.int32()), pa.array(owner % size, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(block[first], pa.int64()), places], names=["gram", "block", "places"])

    def add(batches):
        for batch in batches:
            for some in slices(batch):
                yield listed(some)

    return add


def _inverted(tickets: DataFrame) -> DataFrame:
    """(gram, block, places) of the tickets, in ranges of (gram, block).

    Tickets are dealt by block, so a list is made where its block lies and only lists move on, not (gram, place) rows.
    They are stored before, since ranges read their rows twice. A block's lists of several slices meet in its range.
    """
    spark = tickets.sparkSession
    # Cutting is the work here, and texts are few bytes: not so few tasks as these would fill.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    dealt = tickets.select("id", *[F.lower(field).alias(field) for field in FIELDS]).repartition(tasks, F.floor(F.col("id") / BLOCK))
    lists = stored(dealt.mapInArrow(_lister(), "gram string, block bigint, places array<int>"), "grams")
    whole = lists.repartitionByRange("gram", "block").groupBy("gram", "block").agg(F.sort_array(F.flatten(F.collect_list("places"))).alias("places"))
    return whole.sortWithinPartitions("gram", "block")


class SearchIndex:
    def __init__(self, table: TicketTable):
        self.table, self.spark = table, table.spark

    def _indexed(self) -> DataFrame:
        return self.table._log("indexed", _INDEXED).distinct()

    def extend(self) -> int:
        """Index the batches that have no index yet and return their number. Readers see no difference."""
        missing = [r.batch for r in self.table.batches().select("batch").distinct().join(self._indexed(), "batch", "left_anti").collect()]
        for batch in missing:
            _inverted(self.table.tickets(batches=[batch])).write.mode("overwrite").parquet(f"{self.table.root}/grams/batch={batch}")
            self.spark.createDataFrame([(batch,)], _INDEXED).coalesce(1).write.mode("append").parquet(f"{self.table.root}/indexed")
        return len(missing)

    def pattern_grams(self, term: str) -> list[str]:
        """The grams that every ticket matching ``term`` holds."""
        # The whole pattern is lower-cased, as the search does it: a letter's lower case can depend on its neighbours.
        runs = F.explode(F.split(F.lower(F.lit(f"%{term}%")), "[%_]")).alias("_run")
        cut = self.spark.range(1).select(runs).select(F.explode(grams(F.col("_run"))).alias("gram"))
        return sorted({r.gram for r in cut.collect()})

    def candidates(self, wanted: list[str]) -> DataFrame:
        """Ids of indexed tickets that hold the rarest of the ``wanted`` grams."""
        rows = self.table._log("grams", _GRAMS).join(self._indexed(), "batch", "left_semi").filter(F.col("gram").isin(wanted))
        # A gram without a row has no ticket and is as rare as can be.
        counts = {r.gram: r.n for r in rows.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).collect()}
        rarest = sorted(wanted, key=lambda gram: (counts.get(gram, 0), gram))[:PROBES]
        lists = rows.filter(F.col("gram").isin(rarest)).groupBy("batch", "block").agg(F.collect_list("places").alias("_lists"))
        shared = F.aggregate(F.slice("_lists", 2, PROBES), F.get("_lists", F.lit(0)), F.array_intersect)
        places = lists.filter(F.size("_lists") == len(rarest)).select("block", F.explode(shared).alias("_place"))
        return places.select((F.col("block") * BLOCK + F.col("_place")).alias("id"))

    def search(self, term: str | None) -> DataFrame:
        """``tickets.search`` of the present state."""
        wanted = self.pattern_grams(term) if term else []
        state = self.table.state()
        if not wanted:
            return operators.search(state, term)
        found = stored(self.candidates(wanted), "candidates")
        some = [r.id for r in found.limit(LISTED + 1).collect()]
        late = self._late()
        if len(some) <= LISTED:
            return operators.search(state.filter(F.col("id").isin(some) | late), term)
        early = state.filter(~late).join(found, "id", "left_semi").select(*state.columns)
        return operators.search(early.unionByName(state.filter(late)), term)

    def _late(self) -> Column:
        """Whether an id is of a batch without an index. Ids of batches follow each other, so neighbours share a range."""
        late = self.table.batches().distinct().join(self._indexed(), "batch", "left_anti").filter("tickets > 0")
        ranges: list[list[int]] = []
        for r in late.select("first_id", "tickets").orderBy("first_id").collect():
            if ranges and ranges[-1][1] == r.first_id:
                ranges[-1][1] += r.tickets
            else:
                ranges.append([r.first_id, r.first_id + r.tickets])
        within = F.lit(False)
        for first, end in ranges:
            within = within | F.col("id").between(first, end - 1)
        return within
