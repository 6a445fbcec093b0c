"""Bloom filters of ticket ids as bitmaps in a table: which stored batches may hold an id.

A filter has ``BITS`` bits an id, rounded up to a power of two, and ``HASHES`` bits are set for each id. Its bits
lie in buckets of 32,768, one row each, built by a partial aggregate; buckets without a bit have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24
HASHES = 6
_BUCKET = 1 << 15
SCHEMA = "bits bigint, bucket bigint, bitmap binary"


def size_for(ids: int) -> int:
    """Bits of a filter of so many ids."""
    bits = _BUCKET
    while bits < ids * BITS:
        bits *= 2
    return bits


def _places(bits) -> F.Column:
    """The places (from 1) of an id's bits."""
    return F.array(*[F.pmod(F.xxhash64("ticket_id", F.lit(k)), bits) + 1 for k in range(HASHES)])


def build(ids: DataFrame, bits: int) -> DataFrame:
    """The filter of ``ids`` (ticket_id). A null id sets the bits of a value of its own."""
    placed = ids.select(F.explode(_places(F.lit(bits))).alias("_place"))
    return placed.groupBy(F.bitmap_bucket_number("_place").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("bitmap")).select(
        F.lit(bits).cast("bigint").alias("bits"), "bucket", "bitmap")


def answers(ids: DataFrame, filters: DataFrame) -> DataFrame:
    """(ticket_id, batch) of the filters that may hold an id; ``filters`` has a column ``batch`` besides.

    An id is looked up once for each size of filter, of which there are as many as powers of two.
    """
    sizes = [row.bits for row in filters.select("bits").distinct().collect()]
    looked = ids.select("ticket_id").distinct().withColumn("bits", F.explode(F.lit(sizes).cast("array<bigint>")))
    probes = (looked.withColumn("_place", F.explode(_places(F.col("bits"))))
              .select("ticket_id", "bits", F.bitmap_bucket_number("_place").alias("bucket"), F.bitmap_bit_position("_place").alias("_at")))
    byte = F.conv(F.hex(F.substring("bitmap", (F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1
    hits = probes.join(filters, ["bits", "bucket"]).filter(is_set)
    return hits.groupBy("ticket_id", "batch").agg(F.count(F.lit(1)).alias("_set")).filter(F.col("_set") == HASHES).select("ticket_id", "batch")
