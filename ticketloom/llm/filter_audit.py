"""Filter interaction audit (operator 13): truth-table survival words.

Five filters are judged on every document. Bit S of a document's 32-bit word says whether it survives
the subset S of the filters, that is, fails none of them; so the word is the document's row of a truth
table over all subsets. Adding up the words bit by bit gives the survivors of every subset at once, and
any order of the filters, its steps and the Shapley values follow from these 32 counts.

1. A scan judges what a text alone decides (length, distinct words, capitals, symbols) and takes a 128-bit
   digest of the text. Whether it repeats a smaller id's text comes from the smallest id of each digest,
   formed before the shuffle. Digests with more than a ``HOT``-th of all rows, of which there are fewer than
   ``HOT``, are broadcast and their rows go on by id; the others meet their first id in a join.
2. Words are added up by carry-save adders: sixteen words go in, bits of equal weight are added without
   carrying along, and only every sixteenth word of the highest weight is taken apart into 32 counters.
   A task sends one row of 32 counts per part and label.
3. Counts are summed by part and label, and 120 orders of five steps are read off them.

Labels: a document counts as good (toxic) if any of its rows of the label table says 1.

Defined cases: a null text is empty and equal to any other empty text; a null part is the empty string; a
null id repeats no other row and no row repeats it, and it has no labels; rows that share both text and id repeat
nothing by each other; texts of any length are read whole; an empty table gives an empty result. Only the
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import stored

FILTERS = "ABCDE"
LEAST_WORDS = 100
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
KINDS = ("all", "good", "toxic")
HOT = 1000
_SUBSETS = 1 << len(FILTERS)
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS_HELD = 1000


def failures(data: bytes) -> int:
    """Bits 0 to 3: whether a text, in UTF-8, fails A to D."""
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    points = len(data) if data.isascii() else len(data.decode("utf-8", "surrogatepass"))
    symbols = len(data.translate(None, SYMBOLS)) < len(data)
    return ((len(words) < LEAST_WORDS) | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * capitals > CAPITAL_PERCENT * points) << 2 | symbols << 3)


def survival_words(failed: np.ndarray) -> np.ndarray:
    """The truth table row of each set of failed filters: bit S is set if no member of S failed."""
    subsets = np.arange(_SUBSETS)
    table = ((subsets[:, None] & subsets[None, :]) == 0) @ (np.uint64(1) << np.arange(_SUBSETS, dtype=np.uint64))
    return table.astype(np.uint32)[failed]


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save: the bits of weight one and of weight two of a + b + c."""
    either = a ^ b
    return either ^ c, (a & b) | (either & c)


def _bit_counts(words: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(words.astype("<u4")).view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set."""
    lanes = -(-len(words) // 16)
    if not lanes:
        return np.zeros(_SUBSETS, dtype=np.int64)
    rows = np.zeros(lanes * 16, dtype=np.uint32)
    rows[:len(words)] = words
    level, weight, counts = list(rows.reshape(16, lanes)), 1, np.zeros(_SUBSETS, dtype=np.int64)
    # At each weight three rows become one of that weight and one of twice the weight, until one is left.
    while level:
        carried = []
        while len(level) > 2:
            kept, carry = _add(level.pop(), level.pop(), level.pop())
            level.insert(0, kept)
            carried.append(carry)
        if len(level) == 2:
            a, b = level
            level = [a ^ b]
            carried.append(a & b)
        counts += weight * _bit_counts(level[0])
        level, weight = carried, weight * 2
    return counts


def judged(df: DataFrame, key: str, text: str, part: str) -> DataFrame:
    """id, part, failed (bits of A to D), d1 and d2 (digest of the text), a row per row of ``df``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed, digests = np.empty(batch.num_rows, dtype=np.int32), bytearray()
            for i, data in enumerate(batch.column("_text")):
                data = data.as_py() or b""
                failed[i] = failures(data)
                digests += xxhash.xxh3_128_digest(data)
            halves = np.frombuffer(bytes(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(failed), pa.array(halves[:, 0].copy()),
                                              pa.array(halves[:, 1].copy())], names=["id", "part", "failed", "d1", "d2"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
                     F.col(text).cast("binary").alias("_text"))
    return rows.mapInArrow(scan, "id long, part string, failed int, d1 long, d2 long")


def with_repeats(rows: DataFrame) -> DataFrame:
    """The rows with bit 4 of ``failed`` set where a smaller id has the same text."""
    firsts = rows.groupBy("d1", "d2").agg(F.min("id").alias("_first"), F.max("id").alias("_last"), F.count(F.lit(1)).alias("_n"))
    several = stored(firsts.filter("_first < _last").select("d1", "d2", "_first", "_n"), "repeats")
    # At most HOT digests have that share of all rows. Their rows are settled here and then spread by id.
    hot = several.filter(F.col("_n") * HOT > rows.count()).select(F.col("d1").alias("_h1"), F.col("d2").alias("_h2"), F.col("_first").alias("_hot"))
    met = rows.join(F.broadcast(hot), (F.col("d1") == F.col("_h1")) & (F.col("d2") == F.col("_h2")), "left")
    spread = F.col("_hot").isNotNull()
    keyed = met.select("id", "part", "failed", "_hot", F.when(spread, F.xxhash64("id")).otherwise(F.col("d1")).alias("d1"),
                       F.when(spread, F.lit(None)).otherwise(F.col("d2")).alias("d2"))
    joined = keyed.join(several.select("d1", "d2", "_first"), ["d1", "d2"], "left")
    repeats = F.coalesce(F.coalesce("_hot", "_first") < F.col("id"), F.lit(False))
    return joined.select("id", "part", (F.col("failed") + F.when(repeats, 16).otherwise(0)).alias("failed"))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, kind, subset, n): survivors of each subset of filters, of all, good and toxic documents.
    ``rows`` has part, failed, good and toxic."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            words = survival_words(batch.column("failed").to_numpy())
            named = batch.column("part").dictionary_encode()
            codes, names = named.indices.to_numpy(), named.dictionary.to_pylist()
            order = np.argsort(codes, kind="stable")
            cuts = np.searchsorted(codes[order], np.arange(len(names) + 1))
            masks = [None, *(batch.column(kind).to_numpy(zero_copy_only=False) for kind in KINDS[1:])]
            for name, start, end in zip(names, cuts, cuts[1:]):
                at = order[start:end]
                for kind, mask in enumerate(masks):
                    counted = positional_popcount(words[at if mask is None else at[mask[at]]])
                    held[name, kind] = held.get((name, kind), 0) + counted
            if len(held) > _PARTS_HELD:
                yield sent(held)
                held = {}
        yield sent(held)

    def sent(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([name for name, _ in held], pa.string()), pa.array([KINDS[k] for _, k in held], pa.string()),
                                           pa.array([c.tolist() for c in held.values()], pa.list_(pa.int64()))], names=["part", "kind", "counts"])

    counts = rows.select("part", "failed", *KINDS[1:]).mapInArrow(add_up, "part string, kind string, counts array<long>")
    return counts.groupBy("part", "kind").agg(F.array(*[F.sum(F.get("counts", F.lit(s))) for s in range(_SUBSETS)]).alias("n"))


def _bits(letters: Column) -> Column:
    """The subset of the filters named by a string of letters."""
    return sum((F.when(F.contains(letters, F.lit(f)), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(FILTERS)), F.lit(0))


def _shapley(n: Column, bit: Column) -> Column:
    """What a filter removes, summed over all orders: a set of s others comes first in s! (4 - s)! of them."""
    before = F.lit(0).cast("bigint")
    for subset in range(_SUBSETS):
        size = bin(subset).count("1")
        if size < len(FILTERS):
            ways = factorial(size) * factorial(len(FILTERS) - 1 - size)
            lost = F.get(n, F.lit(subset)) - F.get(n, F.lit(subset).bitwiseOR(bit))
            before = before + F.when(F.lit(subset).bitwiseAND(bit) == 0, lost * ways).otherwise(F.lit(0))
    return before


def audit(df: DataFrame, key: str, text: str, part: str, labels: DataFrame, good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """A row per part, order of the filters and step, with the counts of the step."""
    flags = labels.groupBy(F.col(key).cast("bigint").alias("_id")).agg(
        F.max(F.coalesce(F.col(good) == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col(toxic) == 1, F.lit(False))).alias("toxic"))
    rows = with_repeats(stored(judged(df, key, text, part), "judged"))
    labelled = rows.join(flags.filter("good OR toxic"), F.col("id") == F.col("_id"), "left").select(
        "part", "failed", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # A row per part: the counts of all 32 subsets by kind.
    counts = survivors(labelled).groupBy("part").agg(
        *[F.first(F.when(F.col("kind") == kind, F.col("n")), ignorenulls=True).alias(f"_{kind}") for kind in KINDS])
    orders = ",".join("".join(order) for order in itertools.permutations(FILTERS))
    steps = counts.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn(
        "step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    placed = steps.withColumns({
        "_before": _bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)),
        "_bit": _bits(F.substring("filter_order", F.col("step"), F.lit(1)))}).withColumn("_after", F.col("_before") + F.col("_bit"))
    n = {kind: (lambda subset, kind=kind: F.get(F.col(f"_{kind}"), subset)) for kind in KINDS}
    full = F.lit(_SUBSETS - 1)
    removed = n["all"](F.col("_before")) - n["all"](F.col("_after"))
    failing = n["all"](F.lit(0)) - n["all"](F.col("_bit"))
    return placed.select(
        "part", "filter_order", "step", n["all"](F.col("_after")).alias("kept"), removed.alias("removed"),
        (failing - removed).alias("redundant"), (n["all"](full - F.col("_bit")) - n["all"](full)).alias("unique_fails"),
        *[(n[k](F.col("_before")) - n[k](F.col("_after"))).alias(f"{k}_lost") for k in KINDS[1:]],
        _shapley(F.col("_all"), F.col("_bit")).alias("shapley"))
