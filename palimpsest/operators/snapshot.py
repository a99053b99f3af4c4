"""Keyed state derived from a mutation log: the latest valid record of a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ABORTED, OK


def raw_latest(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(key, seq, value, tombstone): newest record of every key, tombstones too.

    ``max_by`` is summed before the shuffle, so a hot key sends one row a task.
    """
    keys = keys or ["key"]
    newest = F.max_by(F.struct("seq", "value", "tombstone"), "seq").alias("r")
    return log.where(~F.col("invalid")).groupBy(*keys).agg(newest).select(*keys, "r.seq", "r.value", "r.tombstone")


def latest(log: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(key, seq, value) of live keys."""
    return raw_latest(log, keys).where(~F.col("tombstone")).drop("tombstone")


def as_of(log: DataFrame, cut: int) -> DataFrame:
    """Live keys of the log's prefix below ``cut``."""
    return latest(log.where(F.col("seq") < cut))


def point_read(log: DataFrame, key: Column | int | str) -> DataFrame:
    """(key, value) of one key; no row if it is absent.  The key's filter reaches the scan."""
    return latest(log.where(F.col("key") == key)).select("key", "value")


def multi_read(log: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of each row of ``keys``; an absent key has a null value.  Other keys are dropped before the aggregate."""
    wanted = log.join(keys.select("key").distinct(), "key", "left_semi")
    return keys.join(latest(wanted).select("key", "value"), "key", "left")


def conditional_insert(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` (key, value, and seq where rows of one key have an order) that insert: those whose key is absent or deleted in ``log``.

    Of rows that repeat a key the first by seq inserts and the others abort; without a
    seq the first is the one of least value, nulls first.
    """
    order = "seq" if "seq" in batch.columns else "value"
    rest = [c for c in batch.columns if c != "key"]
    first = F.min_by(F.struct(*rest), F.struct(F.col(order).isNotNull(), F.col(order))).alias("r")
    return batch.groupBy("key").agg(first).select("key", *[F.col(f"r.{c}").alias(c) for c in rest]).join(latest(log).select("key"), "key", "left_anti").select(*batch.columns)


def conditional_insert_status(log: DataFrame, batch: DataFrame) -> DataFrame:
    """``batch`` (key, seq, ...) with ``status``: Ok for the first row of a key that is absent or deleted in ``log``, Aborted for all others."""
    first = conditional_insert(log, batch.select("key", "seq")).select(F.col("key").alias("_key"), F.col("seq").alias("_seq"))
    joined = batch.join(first, (F.col("key") == F.col("_key")) & (F.col("seq") == F.col("_seq")), "left")
    return joined.withColumn("status", F.when(F.col("_key").isNotNull(), OK).otherwise(ABORTED)).drop("_key", "_seq")


def version_chain(log: DataFrame) -> DataFrame:
    """Each valid record with ``previous_seq``, the record of its key before it, and its ``depth`` in the chain."""
    w = Window.partitionBy("key").orderBy("seq")
    return log.where(~F.col("invalid")).select("seq", "key", F.lag("seq").over(w).alias("previous_seq"), F.row_number().over(w).alias("depth"))


def size(log: DataFrame) -> DataFrame:
    """(all_keys, live_keys): keys with any record, and keys with a value."""
    return raw_latest(log).agg(F.count("*").alias("all_keys"), F.count_if(~F.col("tombstone")).alias("live_keys"))
