"""Statistics of operations and of the key distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ABORTED, NOT_FOUND, OK, OPS


def op_stats(audit: DataFrame) -> DataFrame:
    """One row: operations by kind, by status, and the reads that found a value; audit: (op, status, value)."""
    kinds = [F.count_if(F.col("op") == o).alias(f"n_{o}") for o in OPS]
    states = [F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in (OK, NOT_FOUND, ABORTED)]
    hits = F.count_if((F.col("op") == "read") & F.col("value").isNotNull()).alias("read_hits")
    return audit.agg(F.count("*").alias("total_ops"), *kinds, *states, hits)


def hit_rate(audit: DataFrame) -> DataFrame:
    """(reads, hits, hit_rate)."""
    reads, hits = F.count_if(F.col("op") == "read"), F.count_if((F.col("op") == "read") & F.col("value").isNotNull())
    return audit.agg(reads.alias("reads"), hits.alias("hits"), F.round(F.when(reads > 0, hits / reads).otherwise(0.0), 6).alias("hit_rate"))


def bucket(key: Column, table_size: int) -> Column:
    """Bucket of a numeric key under the identity hash; the table's size is a power of two."""
    if table_size & (table_size - 1) or table_size <= 0:
        raise ValueError("the table's size must be a power of two")
    return key.bitwiseAND(F.lit(table_size - 1))


def index_distribution(keys: DataFrame, table_size: int, entries: int = 7) -> DataFrame:
    """(table_size, used_entries, used_buckets, overflow_buckets, max_in_bucket, load_factor) of distinct keys."""
    per = keys.select("key").distinct().groupBy(bucket(F.col("key"), table_size).alias("bucket")).agg(F.count("*").alias("n"))
    return per.agg(
        F.lit(table_size).cast("long").alias("table_size"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("used_entries"),
        F.count("*").alias("used_buckets"),
        F.count_if(F.col("n") > entries).alias("overflow_buckets"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_in_bucket"),
        F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.lit(table_size * entries), 6).alias("load_factor"),
    )


def rebucket(keys: DataFrame, old: int, new: int) -> DataFrame:
    """(old_bucket, new_bucket, n): where the keys of each bucket go when the table grows."""
    rows = keys.select("key").distinct()
    return rows.groupBy(bucket(F.col("key"), old).alias("old_bucket"), bucket(F.col("key"), new).alias("new_bucket")).agg(F.count("*").alias("n"))


def grow_result(keys: DataFrame, old: int, new: int, entries: int = 7) -> DataFrame:
    """(old_size, new_size, entries_migrated, entries_moved, overflow_buckets, growth_ratio) of growing the table: all distinct keys migrate, some to another bucket."""
    rows = keys.select("key").distinct().select(bucket(F.col("key"), old).alias("a"), bucket(F.col("key"), new).alias("b"))
    per = rows.groupBy("b").agg(F.count("*").alias("n"), F.count_if(F.col("a") != F.col("b")).alias("moved"))
    return per.agg(
        F.lit(old).cast("long").alias("old_size"),
        F.lit(new).cast("long").alias("new_size"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("entries_migrated"),
        F.coalesce(F.sum("moved"), F.lit(0)).alias("entries_moved"),
        F.count_if(F.col("n") > entries).alias("overflow_buckets"),
        F.lit(new / old).alias("growth_ratio"),
    )


def log_stats(log: DataFrame, begin: int, hot_from: int, record_bytes: int = 24) -> DataFrame:
    """One row on the log's allocator: records and bytes in all, in memory (from ``hot_from`` on), on disk, reclaimable (below ``begin``), tombstones and invalid records."""
    size = lambda n: (n * record_bytes)
    hot, gone = F.col("seq") >= hot_from, F.col("seq") < begin
    return log.agg(
        F.count("*").alias("records_allocated"),
        size(F.count("*")).alias("bytes_allocated"),
        size(F.count_if(hot)).alias("bytes_in_memory"),
        size(F.count_if(~hot & ~gone)).alias("bytes_on_disk"),
        size(F.count_if(gone)).alias("bytes_reclaimable"),
        F.count_if(F.col("tombstone")).alias("tombstones"),
        F.count_if(F.col("invalid")).alias("invalid_records"),
    )


def session_stats(audit: DataFrame) -> DataFrame:
    """(session, operations, completed, failed, first_seq, last_seq, reads, read_hits) of each session; audit: (seq, op, status, value, session)."""
    read = F.col("op") == "read"
    return audit.groupBy("session").agg(
        F.count("*").alias("operations"),
        F.count_if(F.col("status") == OK).alias("completed"),
        F.count_if(F.col("status") != OK).alias("failed"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.count_if(read).alias("reads"),
        F.count_if(read & F.col("value").isNotNull()).alias("read_hits"),
    )


def report(stats: DataFrame, form: str = "json", prefix: str = "palimpsest") -> DataFrame:
    """(report): each row of ``stats`` as json, csv, text, one compact line, or Prometheus lines."""
    cols = stats.columns
    if form == "json":
        return stats.select(F.to_json(F.struct(*cols)).alias("report"))
    if form == "csv":
        return stats.select(F.to_csv(F.struct(*cols)).alias("report"))
    if form == "compact":
        return stats.select(F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in cols]).alias("report"))
    if form == "text":
        return stats.select(F.concat_ws("\n", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in cols]).alias("report"))
    if form == "prometheus":
        return stats.select(F.concat_ws("\n", *[F.concat(F.lit(f"# TYPE {prefix}_{c} gauge\n{prefix}_{c} "), F.coalesce(F.col(c).cast("string"), F.lit("NaN"))) for c in cols]).alias("report"))
    raise ValueError(f"unknown form {form}")
