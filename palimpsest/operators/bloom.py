"""A Bloom filter of keys as a table of bitmaps, to skip a cold tier."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hashes(bits_per_key: float) -> int:
    """Number of hash functions: 0.69 times the bits a key, at least 1 and at most 30."""
    return min(30, max(1, round(0.69 * bits_per_key)))


def false_positive_rate(bits: int, keys: int, functions: int) -> float:
    """Expected share of absent keys that pass."""
    return (1 - math.exp(-functions * keys / bits)) ** functions if bits else 1.0


def _places(key: Column, bits: int, functions: int) -> Column:
    """The key's bit positions by double hashing, from 1 on as Spark's bitmaps count."""
    a, b = F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(key, F.lit(1)), F.lit(bits - 1)) + 1
    return F.transform(F.sequence(F.lit(0), F.lit(functions - 1)), lambda i: F.pmod(a + i * b, F.lit(bits)) + 1)


def build(keys: DataFrame, bits: int, functions: int) -> DataFrame:
    """(bucket, bitmap): the filter of ``keys`` (key), one row of 4 KB for 32,768 bits; bits are united before the shuffle."""
    place = F.explode(_places(F.col("key"), bits, functions)).alias("place")
    rows = keys.where(F.col("key").isNotNull()).select(place)
    return rows.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap"))


def might_contain(keys: DataFrame, filter_: DataFrame, bits: int, functions: int) -> DataFrame:
    """Distinct keys of ``keys`` with ``maybe``: false only where the filter's key set lacks the key; nulls take no part.

    Keys meet the filter's rows by a join on the bucket number, and a key passes if all
    its bits are set, so the filter need not fit any task.
    """
    rows = keys.select("key").where(F.col("key").isNotNull()).distinct().select("key", F.explode(_places(F.col("key"), bits, functions)).alias("place"))
    rows = rows.select("key", F.bitmap_bucket_number("place").alias("bucket"), F.bitmap_bit_position("place").alias("at"))
    octet = F.conv(F.hex(F.expr("substring(bitmap, cast(at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    is_set = F.coalesce(F.expr("shiftright({0}, cast(at % 8 as int)) & 1 = 1".format("_octet")), F.lit(False))
    return rows.join(filter_, "bucket", "left").withColumn("_octet", octet).groupBy("key").agg(F.bool_and(is_set).alias("maybe"))
