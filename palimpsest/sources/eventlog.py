"""Operation streams and logs read from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types as operations.
EVENT_OPS = {"purchase": "upsert", "click": "rmw", "signup": "conditional_insert", "error": "delete", "view": "read"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op_stream(events: DataFrame, op: Column | None = None) -> DataFrame:
    """(seq, key, op, val, session) of an events table; ``op`` replaces the mapping of event types."""
    mapped = F.coalesce(*[F.when(F.col("event_type") == t, F.lit(o)) for t, o in EVENT_OPS.items()])
    return events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("key"),
        (mapped if op is None else op).alias("op"),
        F.round(F.col("value") * 100).cast("long").alias("val"),
        F.pmod("event_id", F.lit(4)).alias("session"),
    )


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical operation stream of a data folder."""
    return op_stream(read_table(spark, sf_dir, "events"))


def append(log: DataFrame, batch: DataFrame) -> DataFrame:
    """Log and batch as one log; the batch's seqs go on after the log's."""
    return log.unionByName(batch, allowMissingColumns=True)
