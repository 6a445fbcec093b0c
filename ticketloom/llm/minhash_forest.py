"""MinHash near-dedup (operator 9): an LSH forest whose candidates are confirmed on full sets.

1. A scan turns each text into the digest of its shingle set, the set's size and ``TREES`` prefixes of
   its signature. Tree t orders signatures from place ``DEPTH * t`` on: the first ``DEPTH`` values are
   the key of a region, the next ones say how close two members are. Equal sets become one row.
2. Each tree's rows are dealt by range and sorted, so in a region the members with the longest common
   prefix are neighbours, whatever depth that takes there. A row is a candidate with its neighbour and
   with the first row of its region. A hot region spreads over many ranges, and the ranges' first
   rows are linked by a small table.
3. Candidates are confirmed on whole shingle sets in two rounds: the best partner of each row, then
   what still joins two components.
4. Regions that end in more than one component are settled exactly: their members outside the region's
   largest component meet all its members on full sets, slice by slice, by an inverted index. So a link whose ends share a region of any tree is not lost, however large the
   region; two sets of similarity s share none with probability (1 - s ** DEPTH) ** TREES, which is
   3e-6 for 0.8.

Words: A-Z lower-cased, split at ASCII white space. A text with fewer words than a shingle has is one
shingle. Words and shingles are compared by 64-bit hashes, sets by a 128-bit digest.

The nodes of all this are distinct sets, named by the number of the first row that has one, not by ids.
Components go back to ids at the end.

Defined cases: null and empty texts, and those without words, have an empty set, link with nothing and stay in a component
of their own id; texts of any length are read whole; rows that share an id are one document, with the links of all its
texts; a row with a null id links by its text like any other, its component is the smallest id of its group (null if the
group has none), and it is kept only as the first row of a group without ids; an empty table gives an empty result. Only
the two named columns are read; ids are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import stored
from .graph import components

WIDTH = 5
PERCENT = 80
TREES = 32
DEPTH = 5
DEEPER = 3
SLICE = 1024
_VALUES = TREES * DEPTH
_BLOCK = 4096
_random = np.random.default_rng(20)
_FACTORS = (_random.integers(0, 1 << 32, _VALUES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_OFFSETS = _random.integers(0, 1 << 32, _VALUES, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_set(text: str | bytes | None, width: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text or b""
    words = data.lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    if not len(hashes):
        return hashes
    size = min(width, len(hashes))
    mixed = np.full(len(hashes) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        mixed = (mixed ^ hashes[k:len(hashes) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each of ``TREES * DEPTH`` hash functions over the set."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    least = np.full(_VALUES, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(folded), _BLOCK):
        values = folded[None, start:start + _BLOCK] * _FACTORS
        values += _OFFSETS
        values ^= values >> np.uint32(15)
        values *= np.uint32(0x2C1B3C6D)
        values ^= values >> np.uint32(13)
        np.minimum(least, values.min(axis=1), out=least)
    return least


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * 100 >= percent * (len(a) + len(b) - both)


def _tree_keys(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Region key and the order inside the region, for each signature (row) and tree (column)."""
    places = (DEPTH * np.arange(TREES)[:, None] + np.arange(DEPTH + DEEPER)) % _VALUES
    turned = least[:, places].astype(np.uint64)
    keys = np.tile(np.arange(TREES, dtype=np.uint64) + np.uint64(1), (len(least), 1))
    for k in range(DEPTH):
        keys = (keys ^ turned[:, :, k]) * np.uint64(0xFF51AFD7ED558CCD)
        keys ^= keys >> np.uint64(32)
    order = np.zeros(keys.shape, dtype=np.uint64)
    for k in range(DEEPER):
        order = (order << np.uint64(10)) | (turned[:, :, DEPTH + k] >> np.uint64(22))
    return keys.view(np.int64), order.astype(np.int32)


def signatures(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """row (a number of its own), id, n (set size), packed (the text), d1 and d2 (digest), ``keys`` and ``orders`` by
    tree; all but the first three are null for an empty set. Rows get other numbers if this runs again: store it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, row = zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 33
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            sizes, digests, signed, packed = [], [], [], []
            for value in batch.column("_text"):
                data = (value.as_py() or "").encode("utf-8", "surrogatepass")
                shingles = shingle_set(data, width)
                sizes.append(len(shingles))
                packed.append(packer.compress(data) if len(shingles) else None)
                if len(shingles):
                    digests.append(np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype=np.int64).tolist())
                    signed.append(signature(shingles))
            full = np.array(sizes, dtype=np.int64) > 0
            least = np.array(signed, dtype=np.uint32).reshape(-1, _VALUES)
            keys, orders = _tree_keys(least)
            place = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)
            per_set = [pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                       pa.array(list(keys), pa.list_(pa.int64())), pa.array(list(orders), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(row, row + len(sizes))), batch.column("id"), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()),
                 *(column.take(place) for column in per_set)], names=["row", "id", "n", "packed", "d1", "d2", "keys", "orders"])
            row += len(sizes)

    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("_text")).mapInArrow(
        scan, "row long, id long, n long, packed binary, d1 long, d2 long, keys array<long>, orders array<int>")


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by region and order. Kind 0: the pairs of neighbours in a region, and the third
    pair of a region of three. Kind 2: (region, member) of regions with more rows than that, and of the
    first and last region of a range, which may go on in another one."""

    def rows(kind: int, left: list, right: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(left), kind), pa.int32()), pa.array(left, pa.int64()),
                                           pa.array(right, pa.int64())], names=["kind", "x", "y"])

    region, count, held, last, at_edge = None, 0, [], None, True
    for batch in batches:
        keys, ids = batch.column("region").to_numpy(), batch.column("id").to_numpy()
        if not len(keys):
            continue
        same = keys[1:] == keys[:-1]
        shared = np.concatenate(([True], same)) | np.concatenate((same, [True]))
        left, right, regions, members = [], [], [], []
        for key, one in zip(keys[shared].tolist(), ids[shared].tolist()):
            if count and key == region:
                left.append(last)
                right.append(one)
                if count == 2:
                    left.append(held[0])
                    right.append(one)
                count += 1
                held.append(one)
            else:
                if count and at_edge:
                    regions += [region] * len(held)
                    members += held
                    at_edge = False
                region, count, held = key, 1, [one]
            if count > 3:
                regions += [region] * len(held)
                members += held
                held = []
            last = one
        yield rows(0, left, right)
        yield rows(2, regions, members)
    yield rows(2, [region] * len(held), held)


def candidates(forest: DataFrame) -> DataFrame:
    """The rows of ``_neighbours`` over all trees."""
    partitions = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trees = forest.select("id", F.explode(F.arrays_zip("keys", "orders")).alias("_t")).select(
        F.col("_t.keys").alias("region"), F.col("_t.orders").alias("order"), "id")
    dealt = trees.repartitionByRange(partitions, "region", "order", "id").sortWithinPartitions("region", "order", "id")
    return stored(dealt.select("region", "id").mapInArrow(_neighbours, "kind int, x long, y long"), "neighbours")


def _confirm(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker, last, last_set = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            passed = []
            for a, one, other in zip(batch.column("a").to_pylist(), batch.column("packed_a"), batch.column("packed_b")):
                if a != last:
                    last, last_set = a, shingle_set(unpacker.decompress(one.as_py()), width)
                passed.append(similar(last_set, shingle_set(unpacker.decompress(other.as_py()), width), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(passed)), batch.column("b").filter(pa.array(passed))],
                                             names=["a", "b"])

    with_b = pairs.select("a", "b").join(sets.select(F.col("id").alias("b"), F.col("packed").alias("packed_b")), "b")
    with_a = with_b.join(sets.select(F.col("id").alias("a"), F.col("packed").alias("packed_a")), "a")
    return with_a.select("a", "b", "packed_a", "packed_b").mapInArrow(compare, "a long, b long")


def _sizes_allow(percent: int):
    return F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent


def _crossing(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component yet."""
    joined = pairs
    for end in ("a", "b"):
        joined = joined.join(found.select(F.col("node").alias(end), F.col("component").alias(f"_c{end}")), end, "left")
    return joined.filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).drop("_ca", "_cb")


def _overlaps(asking: list[np.ndarray], asked: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each asking set the sizes of its intersections with all asked sets, by an inverted index."""
    owners = np.repeat(np.arange(len(asked)), [len(x) for x in asked])
    hashes = np.concatenate(asked)
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    for one in asking:
        start, end = np.searchsorted(hashes, one, "left"), np.searchsorted(hashes, one, "right")
        found = end - start
        places = np.repeat(start - np.cumsum(found) + found, found) + np.arange(found.sum())
        yield np.bincount(owners[places], minlength=len(asked))


def _settle(members: DataFrame, found: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The links (a, b) inside regions that join two components.

    One end of such a link is outside the region's largest component. These rows are few once the
    first rounds are done; they meet all members of the region, in slices of bounded size, on full sets.
    """
    placed = (members.select(F.col("x").alias("region"), F.col("y").alias("id")).distinct()
              .join(found, F.col("id") == F.col("node"), "left").select("region", "id", F.coalesce("component", "id").alias("c")))
    placed = stored(placed, "regions")
    counts = placed.groupBy("region", "c").agg(F.count(F.lit(1)).alias("_n"))
    largest = counts.groupBy("region").agg(F.max(F.struct("_n", "c")).alias("_m"), F.count(F.lit(1)).alias("_parts"),
                                           F.sum("_n").alias("_rows")).filter("_parts > 1")
    open_regions = largest.select("region", F.col("_m.c").alias("_main"), F.ceil(F.col("_rows") / SLICE).cast("int").alias("_slices"))
    known = placed.join(open_regions, "region").join(sets, "id")
    own = F.pmod(F.xxhash64("id"), F.col("_slices")).cast("int")
    slices = F.sequence(F.lit(0), F.col("_slices") - 1)
    asking = known.filter(F.col("c") != F.col("_main")).withColumn("i", own)
    blocks = asking.select(F.col("region").alias("_r"), "i").distinct()
    asked = known.join(blocks, F.col("region") == F.col("_r")).withColumn("j", own)
    columns = ["region", "i", "j", "id", "c", "packed"]
    both = asking.withColumn("j", F.explode(slices)).select(*columns, F.lit(True).alias("asks")).unionByName(
        asked.select(*columns, F.lit(False).alias("asks")))

    def links(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Of one group: a slice of asking rows against a slice of the region."""
        unpacker = zstandard.ZstdDecompressor()
        ids, c, asks = (group.column(x).to_numpy(zero_copy_only=False) for x in ("id", "c", "asks"))
        all_sets = [shingle_set(unpacker.decompress(p.as_py()), width) for p in group.column("packed")]
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(left) or not len(right):
            return ids[:0], ids[:0]
        sizes, a, b = np.array([len(x) for x in all_sets]), [], []
        for i, both in zip(left, _overlaps([all_sets[k] for k in left], [all_sets[k] for k in right])):
            j = right[(both * 100 >= percent * (sizes[right] + sizes[i] - both)) & (c[right] != c[i])]
            a.append(np.minimum(ids[j], ids[i]))
            b.append(np.maximum(ids[j], ids[i]))
        return np.concatenate(a), np.concatenate(b)

    def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Over rows sorted by group; the rows of the last group wait for the next batch."""
        waiting = None
        for batch in _then_none(batches):
            if batch is not None:
                waiting = batch if waiting is None else pa.concat_batches([waiting, batch])
            if waiting is None or not waiting.num_rows:
                continue
            new = np.zeros(waiting.num_rows - 1, dtype=bool)
            for name in ("region", "i", "j"):
                new |= np.diff(waiting.column(name).to_numpy()) != 0
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), waiting.num_rows]
            done = len(cuts) - 1 if batch is None else len(cuts) - 2
            pairs = [links(waiting.slice(s, e - s)) for s, e in zip(cuts[:done], cuts[1:done + 1])]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*pairs)], names=["a", "b"])
            waiting = waiting.slice(cuts[done])

    partitions = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = both.repartition(partitions, "region", "i", "j").sortWithinPartitions("region", "i", "j")
    return grouped.mapInArrow(by_group, "a long, b long").distinct()


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def near_duplicates(df: DataFrame, key: str, text: str, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """key, ``n_shingles``, ``component_id`` and ``kept``, a row per row of ``df``."""
    scanned = stored(signatures(df, key, text, width), "signatures")
    usable = scanned.filter("n > 0")
    firsts = stored(usable.groupBy("d1", "d2").agg(F.min("row").alias("first")), "firsts")
    forest = usable.join(firsts, F.col("row") == F.col("first"), "left_semi").select(F.col("row").alias("id"), "n", "keys", "orders")
    found = candidates(forest)

    heads = found.filter("kind = 2").groupBy("x").agg(F.min("y").alias("_head"))
    across = found.filter("kind = 2").join(heads, "x").select(F.col("_head").alias("x"), "y")
    pairs = (found.filter("kind = 0").select("x", "y").unionByName(across).filter("x <> y")
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
             .groupBy("a", "b").agg(F.count(F.lit(1)).alias("hits")))
    n = forest.select("id", "n")
    pairs = pairs.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b").filter(_sizes_allow(percent)).select("a", "b", "hits")
    pairs = stored(pairs, "pairs")

    needed = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(
        found.filter("kind = 2").select(F.col("y").alias("id"))).distinct()
    sets = stored(usable.select(F.col("row").alias("id"), "packed").join(needed, "id", "left_semi"), "texts")

    best = pairs.groupBy("b").agg(F.max(F.struct("hits", -F.col("a"))).alias("_m")).select((-F.col("_m.col2")).alias("a"), "b")
    links = stored(_confirm(best, sets, width, percent), "links")
    graph = stored(components(links), "components")
    rest = _crossing(pairs.join(best, ["a", "b"], "left_anti"), graph)
    links = links.unionByName(stored(_confirm(rest, sets, width, percent), "links"))
    graph = stored(components(links), "components")
    last = stored(_settle(found.filter("kind = 2"), graph, sets, width, percent), "links")
    members = stored(usable.select("row", "id", "d1", "d2").join(firsts, ["d1", "d2"]).select("row", "id", "first"), "members")
    one_id = _same_id(members)
    if not last.isEmpty() or not one_id.isEmpty():
        graph = stored(components(links.unionByName(last).unionByName(one_id)), "components")

    placed = members.join(graph, F.col("first") == F.col("node"), "left").select("row", "id", F.coalesce("component", "first").alias("_group"))
    groups = placed.groupBy("_group").agg(F.min("id").alias("_smallest"), F.min("row").alias("_head"))
    known = placed.select(F.col("row").alias("_row"), "_group").join(groups, "_group")
    result = scanned.select("row", F.col("id").alias("_own"), "n").join(known, F.col("row") == F.col("_row"), "left")
    component = F.when(F.col("_row").isNull(), F.col("_own")).otherwise(F.col("_smallest"))
    kept = F.when(F.col("_own").isNotNull(), F.col("_own") == component).otherwise(
        F.col("_row").isNull() | (F.col("_smallest").isNull() & (F.col("row") == F.col("_head"))))
    return result.select(F.col("_own").cast(df.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"),
                         component.cast(df.schema[key].dataType).alias("component_id"), kept.alias("kept"))


def _same_id(members: DataFrame) -> DataFrame:
    """Links between the sets of rows that share an id; stored, and mostly empty."""
    lowest = members.filter("id IS NOT NULL").groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("_b")).filter("a < _b")
    return stored(members.join(lowest, "id").filter("a < first").select("a", F.col("first").alias("b")).distinct(), "links")
