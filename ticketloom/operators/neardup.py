"""Exact near-duplicate removal by word-shingle Jaccard similarity.

A set is cut into parts by a hash of its shingles (Arasu 2006), and a part is known by the hash of all its
shingles. Two sets that are similar enough differ in few shingles, hence in few parts. Prefix filtering
(Bayardo 2007, Xiao 2008) goes over the parts: in one global order, the two share one among their first few.
No true pair is missed, unlike with sampled signatures. Unlike texts share single shingles the more often the
more texts there are, but hardly ever a part of several; rare parts come first, so most lists are short.

Groups of copies may be huge, so pairs inside a group are never all formed:

* equal shingle sets are collapsed to their first row before anything is joined;
* each round compares only the first open rows of all lists with the rest of them. Kept rows drop
  their near copies at once, so a group of N near copies costs about N comparisons. Rounds take
  ``MORE_LEADERS`` times as many rows each, so their number grows with the logarithm of a list;
* a bitmap of a set's parities (Sandes 2020) travels with its rows. The bits in which two differ are no more than
  the elements that only one set has, so most unlike pairs end inside the join and no set moves for them.

Texts are cut twice: all of them into parts, and those with a candidate into their sets. Sets are about as long as the
text, and most have no candidate, so neither they nor the texts are stored or moved for that. Of the parts only those that a bitmap of
the shared ones lets through move on.

Tables that several jobs read are written to the checkpoint folder, see ``scratch.stored``, and deleted when the result is.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.text import kept_characters
from ..scratch import passing, stored
from ..sources.store import balanced
from . import sieve

# Leaders per list in the first round, and how many times more each later round takes. Up to 1,000 Spark
# cuts the ranked groups before the shuffle.
LEADERS, MORE_LEADERS = 16, 16

# Parity bits of a set, in 64-bit words.
_WORDS = 4

# Sizes of sets up to this are known to ``_classes``.
_LARGEST = 1 << 32
# Rows, and bytes of text unless one text has more, whose shingles are cut into parts at once.
_SLICE, _SLICE_BYTES = 500, 1 << 20

# A bitmap of shared parts has about so many bits for each, and so many in all at most.
_PART_BITS, _MOST_BITS = 32, 1 << 27

# A part in more than this share of all parts is joined by broadcast, see _shared_parts.
_HOT_ROWS = 10_000


def _similar(common: Column, union: Column, percent: int) -> Column:
    """Whole-number form of common / union >= percent / 100."""
    return common * 100 >= union * percent


def _sizes_allow(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _differ(sizes, percent: int):
    """How many elements only one of two similar sets can have, given both sizes together."""
    return sizes * (100 - percent) // (100 + percent)


def _classes(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest set of each class of sizes, and into how many parts the class cuts a set. A set is similar to sets of its own
    class, the one below and the one above only. One part more than can differ would do; half as many again leave
    room to put frequent parts last."""
    starts = [1]
    while starts[-1] <= _LARGEST:
        starts.append(max(starts[-1] * 3 // 2, starts[-1] * 100 // percent) + 1)
    last = np.array(starts[1:]) - 1
    return np.array(starts), (_differ(2 * last, percent) + 1) * 3 // 2 + 1


def _cutter(spark: SparkSession, percent: int, whole: bool) -> Callable:
    """Turns batches with texts and their hashed bucket (``_b``) into rows without text. These hold the hashes of the parts of a text's set of
    hashed shingles in its own class of sizes (``own``) and in the one above (``next``), how many of the rarest parts must be looked
    at, and a digest that equal sets share. A class without a similar unequal set is left out. With ``whole`` rows hold the sets, sorted.

    Workers get it by value, whether or not they can import this package."""
    (starts, parts), slice_rows, slice_bytes, width = _classes(percent), _SLICE, _SLICE_BYTES, fixed.SHINGLE_WORDS
    points, codes = kept_characters(spark)
    # Runs of points whose codes follow each other: a few thousand.
    breaks = np.flatnonzero(np.concatenate([[True], (np.diff(points) != 1) | (np.diff(codes) != 1)]))
    runs = [points[breaks], codes[breaks], np.diff(np.concatenate([breaks, [len(points)]]))]

    def mixed(x: np.ndarray) -> np.ndarray:
        """Spread 64-bit values evenly (the finalizer of splitmix64)."""
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def inside(counts: np.ndarray) -> np.ndarray:
        """0, 1, 2 ... for each count."""
        return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)

    def letters() -> tuple[np.ndarray, np.ndarray]:
        """Of each code point whether words hold it, and the hash of what it becomes in them."""
        first, code, length = runs
        at, step = np.repeat(first, length), inside(length)
        kept, hashes = np.zeros(0x110000, dtype=bool), np.zeros(0x110000, dtype=np.uint64)
        kept[at + step] = True
        hashes[at + step] = mixed((np.repeat(code, length) + step + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return kept, hashes

    def words(texts: pa.Array, kept: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many words each text has, and the hashes of all words. A character's hash counts by its place in the word."""
        plain = [(t or b"").decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()]
        offsets = np.cumsum([0, *map(len, plain)])
        chars = np.frombuffer("".join(plain).encode("utf-32-le"), dtype=np.uint32)
        inner = kept[chars]
        edge = np.zeros(len(chars) + 1, dtype=bool)
        edge[offsets] = True
        begins, ends = inner.copy(), inner.copy()
        begins[1:] &= ~inner[:-1] | edge[1:-1]
        ends[:-1] &= ~inner[1:] | edge[1:-1]
        begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        sizes = ends - begins
        hashes, upto, start = [np.zeros(0, dtype=np.uint64)], np.cumsum(sizes), 0
        places = mixed(np.arange(1, sizes.max(initial=0) + 1).astype(np.uint64)) | np.uint64(1)
        while start < len(sizes):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + slice_bytes)))
            some = sizes[start:stop]
            place = inside(some)
            values = letter[chars[np.repeat(begins[start:stop], some) + place]] * places[place]
            hashes.append(np.add.reduceat(values, np.cumsum(some) - some))
            start = stop
        return np.diff(np.searchsorted(begins, offsets)), np.concatenate(hashes)

    def chained(hashes: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
        """One hash of the ``count`` words from each start on, in their order."""
        chain = np.full(len(starts), count, dtype=np.uint64)
        for k in range(count):
            chain = mixed(chain * np.uint64(0x9E3779B97F4A7C15) + hashes[starts + k])
        return chain

    def shingles(lengths: np.ndarray, hashes: np.ndarray):
        """Sizes and elements of the sets; a text of fewer words than a shingle has is one shingle."""
        firsts = np.cumsum(lengths) - lengths
        owners, found = [], []
        for count in range(width):
            short = np.flatnonzero(lengths == count)
            owners.append(short)
            found.append(chained(hashes, firsts[short], count))
        runs = np.maximum(lengths - width + 1, 0)
        owner = np.repeat(np.arange(len(lengths)), runs)
        owners.append(owner)
        found.append(chained(hashes, np.arange(len(owner)) - (np.cumsum(runs) - runs)[owner] + firsts[owner], width))
        owner, values = np.concatenate(owners), np.concatenate(found).view(np.int64)
        order = np.lexsort((values, owner))
        owner, values = owner[order], values[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (values[1:] != values[:-1])
        return np.bincount(owner[new], minlength=len(lengths)), values[new]

    def lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, pa.int64()))

    def cut(sizes: np.ndarray, hashes: np.ndarray, buckets: np.ndarray, step: int):
        level = np.searchsorted(starts, sizes, side="right") - 1 + step
        partner = np.minimum(sizes * 100 // percent, starts[level + 1] - 1)
        differ = (sizes + partner) * (100 - percent) // (100 + percent)
        wanted = (differ > 0) & (partner >= starts[level])
        count = np.where(wanted, parts[level], 0)
        first = np.cumsum(count) - count
        inside = np.repeat(wanted, sizes)
        owner, element = np.repeat(np.arange(len(sizes)), sizes)[inside], hashes[inside]
        part = ((element >> np.uint64(32)) * count[owner].astype(np.uint64)) >> np.uint64(32)
        sums = np.zeros(count.sum(), dtype=np.uint64)
        np.add.at(sums, first[owner] + part.astype(np.int64), mixed(element))
        holder = np.repeat(np.arange(len(sizes)), count)
        place = (np.arange(len(sums)) - first[holder] + (level[holder] << 32)).astype(np.uint64)
        tokens = mixed(sums ^ mixed(buckets[holder] ^ mixed(place)))
        return [pa.array(differ + 1, pa.int32()), lists(count, tokens.view(np.int64))]

    def digests(sizes: np.ndarray, hashes: np.ndarray) -> pa.Array:
        """Two sums over the set, which has an element at least."""
        firsts = np.cumsum(sizes) - sizes
        sums = [np.add.reduceat(x, firsts) for x in (hashes, mixed(hashes ^ np.uint64(0xD6E8FEB86659FD93)))]
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(np.stack(sums, axis=1).tobytes())]).cast(pa.binary())

    def slices(batch: pa.RecordBatch):
        upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            stop = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + slice_bytes, side="right"))
            stop = min(max(stop, start + 1), start + slice_rows)
            yield batch.slice(start, stop - start)
            start = stop

    def add(batches):
        kept, letter = letters()
        for batch in batches:
            for some in slices(batch):
                sizes, values = shingles(*words(some.column("text"), kept, letter))
                if whole:
                    yield pa.RecordBatch.from_arrays([some.column("id"), some.column("bucket"), lists(sizes, values)], names=["id", "bucket", "sh"])
                    continue
                buckets, hashes = some.column("_b").to_numpy().view(np.uint64), mixed(values.view(np.uint64))
                own, above = cut(sizes, hashes, buckets, 0), cut(sizes, hashes, buckets, 1)
                count = pc.add(pc.list_value_length(own[1]), pc.list_value_length(above[1]))
                yield pa.RecordBatch.from_arrays(
                    [some.column("id"), some.column("bucket"), pa.array(sizes, pa.int32()), count, *own, *above, digests(sizes, hashes)],
                    names=["id", "bucket", "n", "parts", "own_need", "own", "next_need", "next", "digest"])

    return add


def _texts(df: DataFrame, key: str, text: str, bucket: Column) -> DataFrame:
    # Rows without a bucket are a bucket too.
    named = F.coalesce(F.concat(F.lit("="), bucket.cast("string")), F.lit("none"))
    return df.select(F.col(key).alias("id"), named.alias("bucket"), F.col(text).alias("text"))


def shingle_rows(df: DataFrame, key: str, text: str, bucket: Column, percent: int) -> DataFrame:
    """id, bucket, set size, the parts of the set of shingles (64-bit hashes) and their number, and a 128-bit digest that
    equal sets share. Two different shingles of a pair of rows share a hash once in some 10^13 pairs."""
    source = balanced(_texts(df, key, text, bucket)).withColumn("_b", F.xxhash64("bucket"))
    of_id = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(_cutter(df.sparkSession, percent, whole=False), f"id {of_id}, bucket string, n int, parts int, own_need int, "
                             "own array<bigint>, next_need int, next array<bigint>, digest binary")


def _first_of_equal_sets(rows: DataFrame) -> DataFrame:
    """digest -> smallest id. Partial minima come before the shuffle, so copies are cheap."""
    return rows.groupBy("bucket", "digest").agg(F.min("id").alias("id"))


def _parts(rows: DataFrame, firsts: DataFrame) -> DataFrame:
    """The parts of the first row of each set. Parts stay where they are stored, so the other rows are looked for by id alone."""
    copies = stored(rows.filter("id is not null").select("id").join(firsts.select("id"), "id", "left_anti"), "copies")
    return sieve.without(rows.filter("id is not null").select("id", "n", "parts", "own_need", "own", "next_need", "next"), copies, "id")


def _sets(texts: DataFrame, postings: DataFrame) -> DataFrame:
    """The sets of rows that have a candidate, stored, since every later step reads them."""
    spark = texts.sparkSession
    chosen = sieve.only(texts, stored(postings.select("id").distinct(), "candidates"), "id")
    dealt = chosen.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    of_id = texts.schema["id"].dataType.simpleString()
    sets = dealt.mapInArrow(_cutter(spark, 100, whole=True), f"id {of_id}, bucket string, sh array<bigint>")
    return stored(sets.withColumn("bits", _parities("sh")), "sets")


def _with_bits(postings: DataFrame, sets: DataFrame) -> DataFrame:
    return postings.join(sets.select("id", "bucket", "bits"), "id")


def _parities(hashes: str) -> Column:
    """For each of 64 * ``_WORDS`` classes of hashes whether a set has an odd number of them."""
    def word(k: int) -> Column:
        return F.aggregate(F.filter(hashes, lambda h: F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(_WORDS - 1)) == k), F.lit(0).cast("bigint"),
                           lambda bits, h: bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))))

    return F.array(*[word(k) for k in range(_WORDS)])


def _bits_allow(a: Column, b: Column, sizes: Column, percent: int) -> Column:
    """Whether the parities of two sets leave room for the similarity. With d elements in only one of them and
    s in both sizes together, it is (s - d) / (s + d)."""
    differ = sum((F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(_WORDS)), F.lit(0))
    return differ * (100 + percent) <= sizes * (100 - percent)


def _shared_rows(parts: DataFrame, frequencies: DataFrame) -> DataFrame:
    """One row per part of a set that is in ``frequencies``, and few others: parts are looked up in a bitmap where they lie.
    ``h`` is a part's hash, ``m`` the number of parts in its class.

    The bitmap has a bound, and beyond it more parts pass that are not shared."""
    bits, wanted = 1 << 15, frequencies.count() * _PART_BITS
    while bits < min(wanted, _MOST_BITS):
        bits *= 2
    power = bits.bit_length() - 1
    places = F.array(*[F.pmod(F.shiftrightunsigned("h", k * power), F.lit(bits)) + 1 for k in range(2)])
    rows = frequencies.select(F.explode(places).alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("bitmap")).collect()
    bitmap = np.zeros((bits >> 15, 1 << 12), dtype=np.uint8)
    for row in rows:
        bitmap[row.bucket - 1] = np.frombuffer(row.bitmap, dtype=np.uint8)
    bitmap = bitmap.reshape(-1)

    def known(hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), dtype=bool)
        for k in range(2):
            at = (hashes >> np.uint64(k * power)) & np.uint64(bits - 1)
            found &= (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return found

    def sift(batches):
        for batch in batches:
            for step, name in enumerate(("own", "next")):
                of_row = batch.column(name)
                offsets = of_row.offsets.to_numpy() - of_row.offsets[0].as_py()
                hashes = of_row.flatten().to_numpy()
                pass_on = known(hashes.view(np.uint64))
                upto = np.concatenate([[0], np.cumsum(pass_on)])[offsets]
                some = np.flatnonzero(np.diff(upto))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto[some + 1]]), pa.int32()), pa.array(hashes[pass_on], pa.int64()))
                taken = [batch.column(c).take(pa.array(some)) for c in ("id", "n", f"{name}_need")]
                yield pa.RecordBatch.from_arrays(
                    [*taken[:2], pa.array(np.full(len(some), step), pa.int32()), taken[2], pa.array(np.diff(offsets)[some], pa.int32()), lists],
                    names=["id", "n", "step", "need", "m", "parts"])

    ints = [T.StructField(c, T.IntegerType()) for c in ("n", "step", "need", "m")]
    schema = T.StructType([parts.schema["id"], *ints, T.StructField("parts", T.ArrayType(T.LongType()))])
    sifted = parts.select("id", "n", "own_need", "own", "next_need", "next").mapInArrow(sift, schema)
    return sifted.select("id", "n", "step", "need", "m", F.explode("parts").alias("h"))


def _hot_limit(total: int) -> int:
    return max(1000, total // _HOT_ROWS)


def _shared_parts(parts: DataFrame, side: str | None) -> DataFrame:
    """Parts that more than one row has, or rows of both sides, with their frequency.

    Any other part cannot lead to a pair and is dropped early. Very frequent parts would
    send many rows to one task of the join, so they are joined by broadcast: at most
    ``_HOT_ROWS`` parts can exceed their share of the total.
    """
    total = parts.agg(F.sum("parts")).first()[0] or 0
    limit = _hot_limit(total)
    each = parts.select(*([F.col(side).alias("_side")] if side else []), F.explode(F.concat("own", "next")).alias("h"))
    found = each.groupBy("h").agg(F.count(F.lit(1)).alias("f"), *([F.sum("_side").alias("_second")] if side else []))
    frequencies = stored(found.filter("_second between 1 and f - 1" if side else "f > 1").select("h", "f"), "shared")
    rows = _shared_rows(parts, frequencies)
    hot = frequencies.filter(F.col("f") > limit)
    if hot.isEmpty():
        return rows.join(frequencies, "h")
    hot, cold = F.broadcast(hot), frequencies.filter(F.col("f") <= limit)
    return rows.join(hot, "h", "left_anti").join(cold, "h").unionByName(rows.join(hot, "h"))


def _postings(parts: DataFrame, side: str | None = None) -> DataFrame:
    """(part, id, size) for the prefix of each row, in each of its two classes; parts of one row (or side) are left out.

    Of two similar sets all but ``need - 1`` parts are equal, so the ``need`` rarest of each hold a common one.
    Parts of one row come first in that order, so only their number matters.
    """
    per_row = _shared_parts(parts, side).groupBy("id", "step").agg(
        F.first("n").alias("n"), F.first("need").alias("need"), F.first("m").alias("m"), F.array_sort(F.collect_list(F.struct("f", "h"))).alias("shared"))
    from_shared = F.col("need") - (F.col("m") - F.size("shared"))
    prefix = F.slice("shared", F.lit(1), F.greatest(from_shared, F.lit(0)).cast("int"))
    listed = stored(per_row.select("id", "n", F.explode(prefix).alias("e")).select(F.col("e.h").alias("h"), "id", "n"), "prefixes")
    ends = [F.col(side) if side else F.col("id")]
    useful = listed.groupBy("h").agg(F.min(*ends).alias("_from"), F.max(*ends).alias("_to")).filter("_from != _to")
    return stored(listed.join(useful.select("h"), "h", "left_semi"), "prefixes")


def _leaders(postings: DataFrame, count: int) -> DataFrame:
    """The first ``count`` rows of each list. Spark cuts each list before the shuffle too."""
    place = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("id"))
    return postings.withColumn("_place", place).filter(F.col("_place") <= count).drop("_place")


def _verified(pairs: DataFrame, left: DataFrame, right: DataFrame, percent: int) -> DataFrame:
    """Pairs (lead, id) whose full shingle sets are similar, with their Jaccard similarity."""
    # Little data but much work per pair: keep all partitions instead of letting AQE merge them.
    partitions = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    led = pairs.join(left.select(F.col("id").alias("lead"), F.col("sh").alias("_sa")), "lead")
    both = led.repartition(partitions, "id").join(right.select("id", F.col("sh").alias("_sb")), "id")
    both = both.withColumn("_common", F.size(F.array_intersect("_sa", "_sb")))
    both = both.withColumn("_union", F.size("_sa") + F.size("_sb") - F.col("_common"))
    return both.filter(_similar(F.col("_common"), F.col("_union"), percent)).select(
        "lead", "id", (F.col("_common") / F.col("_union")).alias("jaccard"))


def _candidates(leaders: DataFrame, postings: DataFrame, percent: int, earlier: bool) -> DataFrame:
    lead = leaders.select("bucket", "h", F.col("id").alias("lead"), F.col("n").alias("_ln"), F.col("bits").alias("_lbits"))
    pairs = lead.join(postings, ["bucket", "h"]).filter(
        _sizes_allow(F.col("_ln"), F.col("n"), percent) & _bits_allow(F.col("_lbits"), F.col("bits"), F.col("_ln") + F.col("n"), percent))
    if earlier:
        pairs = pairs.filter(F.col("lead") < F.col("id"))
    return pairs.select("lead", "id").distinct()


def _settle(edges: DataFrame, sure: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decide what the edges of one round allow.

    ``sure`` holds rows whose earlier similar rows are all in ``edges`` and whose later ones are
    too. Such a row is kept once none of its earlier similar rows is open; a kept row drops all
    its later similar rows.
    """
    spark = edges.sparkSession
    kept: list[DataFrame] = []
    dropped: list[DataFrame] = []
    open_edges, open_sure = edges.select("lead", "id"), sure
    while True:
        free = stored(open_sure.join(open_edges.select("id"), "id", "left_anti"), "kept")
        if free.isEmpty():
            break
        hit = stored(open_edges.join(free.withColumnRenamed("id", "lead"), "lead", "left_semi")
                     .select("id").distinct(), "dropped")
        kept.append(free)
        dropped.append(hit)
        if hit.isEmpty():
            break
        gone = free.unionByName(hit)
        open_sure = stored(open_sure.join(gone, "id", "left_anti"), "sure")
        open_edges = stored(
            open_edges.join(gone, "id", "left_anti")
            .join(gone.withColumnRenamed("id", "lead"), "lead", "left_anti"), "edges")
    nothing = spark.createDataFrame([], sure.schema)
    return (reduce(DataFrame.unionByName, kept, nothing),
            reduce(DataFrame.unionByName, dropped, nothing))


def _greedy(postings: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Dropped ids among rows with distinct shingle sets."""
    active, count, dropped = postings, LEADERS, []
    while not active.isEmpty():
        leaders = stored(_leaders(active, count), "leaders")
        pairs = _candidates(leaders, active, percent, earlier=True)
        edges = stored(_verified(pairs, reps, reps, percent), "edges")
        lists = active.groupBy("id").agg(F.count(F.lit(1)).alias("_lists"))
        led = leaders.groupBy("id").agg(F.count(F.lit(1)).alias("_led"))
        sure = stored(lists.join(led, "id").filter("_lists = _led").select("id"), "sure")
        kept, hit = _settle(edges, sure)
        dropped.append(hit)
        active = stored(active.join(kept.unionByName(hit), "id", "left_anti"), "postings")
        count *= MORE_LEADERS
    nothing = reps.select("id").limit(0)
    return reduce(DataFrame.unionByName, dropped, nothing)


def near_duplicates(df: DataFrame, key: str, text: str, bucket: str | None = None,
                    percent: int = fixed.SIMILARITY_PERCENT) -> DataFrame:
    """Ids of rows that greedy de-duplication drops.

    In order of ``key``, a row is dropped when an earlier kept row of its bucket is similar;
    dropped rows drop nothing. ``key`` must be unique.
    """
    with passing(df.sparkSession) as keep:
        rows, firsts, _, dropped, _ = _drop_plan(df, key, text, bucket, percent)
        copies = _copies(rows, firsts)
        return keep(stored(dropped.select("id").unionByName(copies.select("id")).select(F.col("id").alias(key)), "near"))


def _drop_plan(df: DataFrame, key: str, text: str, bucket: str | None, percent: int):
    group = F.col(bucket) if bucket else F.lit("")
    rows = stored(shingle_rows(df, key, text, group, percent), "rows")
    firsts = stored(_first_of_equal_sets(rows), "firsts")
    listed = _postings(_parts(rows, firsts))
    sets = _sets(_texts(df, key, text, group), listed)
    postings = stored(_with_bits(listed, sets), "postings")
    return rows, firsts, sets, _greedy(postings, sets, percent), postings


def _copies(rows: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows that repeat the shingle set of an earlier row, with that row's id.

    Rows carry no text here. The sets of a hot group meet in one key; AQE splits such a join.
    """
    first = reps.select("bucket", "digest", F.col("id").alias("first_id"))
    return rows.select("id", "bucket", "digest").join(first, ["bucket", "digest"]).filter(
        F.col("id") != F.col("first_id")).select("id", "first_id")


def keep_first_similar(df: DataFrame, key: str, text: str, bucket: str | None = None,
                       percent: int = fixed.SIMILARITY_PERCENT) -> DataFrame:
    """Rows that greedy de-duplication keeps."""
    return sieve.without(df, near_duplicates(df, key, text, bucket, percent), key)


def near_duplicate_matches(df: DataFrame, key: str, text: str, bucket: str | None = None,
                           percent: int = fixed.SIMILARITY_PERCENT) -> DataFrame:
    """Each dropped row with the first kept row it repeats and their similarity.

    These are the pairs the greedy scan finds: one per dropped row, not every pair of a group.
    """
    with passing(df.sparkSession) as keep:
        rows, firsts, sets, dropped, postings = _drop_plan(df, key, text, bucket, percent)
        dropped = stored(dropped.distinct(), "dropped")
        late = postings.join(dropped, "id", "left_semi")
        early = postings.join(dropped, "id", "left_anti")
        pairs = _candidates(early, late, percent, earlier=True)
        found = _verified(pairs, sets, sets, percent)
        first = stored(found.groupBy("id").agg(F.min(F.struct("lead", "jaccard")).alias("m"))
                       .select("id", F.col("m.lead").alias("kept_id"), F.col("m.jaccard").alias("jaccard")),
                       "matches")
        copies = _copies(rows, firsts).join(first.withColumnRenamed("id", "first_id"), "first_id", "left")
        of_copies = copies.select("id", F.coalesce("kept_id", "first_id").alias("kept_id"),
                                  F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))
        return keep(stored(first.unionByName(of_copies).select(
            F.col("id").alias("dropped_id"), "kept_id", "jaccard"), "matches"))


def near_rows(base: DataFrame, other: DataFrame, key: str, text: str,
              percent: int = fixed.SIMILARITY_PERCENT) -> DataFrame:
    """Ids of rows of ``other`` that are similar to any row of ``base``."""
    with passing(base.sparkSession) as keep:
        group = F.lit("")
        b = stored(shingle_rows(base, key, text, group, percent), "base")
        o = stored(shingle_rows(other, key, text, group, percent), "other")
        base_firsts, firsts = stored(_first_of_equal_sets(b), "firsts"), stored(_first_of_equal_sets(o), "firsts")
        equal = stored(firsts.join(base_firsts.select("bucket", "digest"), ["bucket", "digest"], "left_semi"), "equal")
        unequal = firsts.join(equal, "id", "left_anti")

        # One order of parts for both sides; ids of the two sides may coincide, so mark them.
        marked = [_parts(*side).withColumn("id", F.struct(F.lit(i).alias("side"), F.col("id").alias("id")))
                  for i, side in enumerate(((b, base_firsts), (o, unequal)))]
        listed = _postings(marked[0].unionByName(marked[1]), "id.side")
        unused, waiting = [listed.filter(F.col("id.side") == i).withColumn("id", F.col("id.id")) for i in (0, 1)]
        base_sets, other_sets = [_sets(_texts(side, key, text, group), ids) for side, ids in ((base, unused), (other, waiting))]
        unused, waiting = stored(_with_bits(unused, base_sets), "unused"), stored(_with_bits(waiting, other_sets), "waiting")
        found, count = [equal.select("id")], LEADERS
        while True:
            lists = waiting.select("bucket", "h").distinct()
            unused = stored(unused.join(lists, ["bucket", "h"], "left_semi"), "unused")
            if unused.isEmpty():
                break
            leaders = stored(_leaders(unused, count), "leaders")
            pairs = _candidates(leaders, waiting, percent, earlier=False)
            hit = stored(_verified(pairs, base_sets, other_sets, percent).select("id").distinct(), "near")
            found.append(hit)
            waiting = stored(waiting.join(hit, "id", "left_anti"), "waiting")
            unused = unused.join(leaders.select("bucket", "h", "id"), ["bucket", "h", "id"], "left_anti")
            count *= MORE_LEADERS
        near = reduce(DataFrame.unionByName, found)
        whole = o.join(near, "id", "left_semi").select("bucket", "digest")
        near_digests = whole.distinct()
        return keep(stored(o.join(near_digests, ["bucket", "digest"], "left_semi").select(F.col("id").alias(key)), "near"))


def without_near_rows(base: DataFrame, other: DataFrame, key: str, text: str,
                      percent: int = fixed.SIMILARITY_PERCENT) -> DataFrame:
    """Leakage removal: rows of ``other`` that resemble no row of ``base``, in any category."""
    return sieve.without(other, near_rows(base, other, key, text, percent), key)
