"""Rows whose key is in a table of keys, or is not, without moving the other rows.

A semi-join of two large tables shuffles both of them whole, long texts included. Here a row is looked up in a bitmap of
the keys first, where it lies, and only rows whose bit is set are joined. The bitmap has ``BITS`` bits however many
keys there are, so it can be broadcast; with more keys it only rules out fewer rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Up to so many keys are broadcast themselves.
FEW = 100_000
BITS = 1 << 27


def _few(keys: DataFrame) -> bool:
    return keys.limit(FEW + 1).count() <= FEW


def _looked_up(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_may``: whether the key's bit is set. A bitmap's rows hold 32,768 bits each."""
    bit = F.pmod(F.xxhash64(key), F.lit(BITS)) + 1
    bitmap = keys.select(bit.alias("_bit")).groupBy(F.bitmap_bucket_number("_bit").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_bit")).alias("_bitmap"))
    at = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring("_bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn("_bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(bitmap), "_bucket", "left")
    return found.withColumn("_may", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)))


def only(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The left semi-join of ``rows`` with a stored table ``keys`` that has the one column ``key``."""
    if _few(keys):
        return rows.join(F.broadcast(keys), key, "left_semi")
    return _looked_up(rows, keys, key).filter("_may").select(*rows.columns).join(keys, key, "left_semi")


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The left anti-join of ``rows`` with a stored table ``keys`` that has the one column ``key``."""
    if _few(keys):
        return rows.join(F.broadcast(keys), key, "left_anti")
    found = _looked_up(rows, keys, key)
    joined = found.filter("_may").select(*rows.columns).join(keys, key, "left_anti")
    return joined.unionByName(found.filter("not _may").select(*rows.columns))
