"""The mutation log's columns, and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("read", "upsert", "delete", "rmw", "conditional_insert")
MUTATIONS = OPS[1:]
#: Status names of operations.
OK, NOT_FOUND, ABORTED = "Ok", "NotFound", "Aborted"
#: Bounds: sessions of a checkpoint, pages and offsets of a log address.
MAX_SESSIONS, PAGE_BITS, OFFSET_BITS = 96, 23, 25


def log_schema(key: T.DataType = T.LongType(), value: T.DataType = T.LongType()) -> T.StructType:
    """Columns of a mutation log; seq is the total order, and the latest seq of a key wins."""
    return T.StructType(
        [
            T.StructField("seq", T.LongType(), False),
            T.StructField("key", key, False),
            T.StructField("op", T.StringType(), False),
            T.StructField("value", value, True),
            T.StructField("tombstone", T.BooleanType(), False),
            T.StructField("invalid", T.BooleanType(), False),
            T.StructField("version", T.IntegerType(), False),
            T.StructField("session", T.LongType(), True),
        ]
    )


def check_log(log: DataFrame) -> dict[str, int]:
    """Counts of what a log must not hold: null keys or seqs, repeated seqs, unknown ops, tombstones with a value."""
    row = log.agg(
        F.count_if(F.col("seq").isNull()).alias("null_seq"),
        F.count_if(F.col("key").isNull()).alias("null_key"),
        F.count_if(~F.col("op").isin(*OPS)).alias("unknown_op"),
        F.count_if(F.col("tombstone") & F.col("value").isNotNull()).alias("tombstone_value"),
    ).first()
    repeated = log.groupBy("seq").count().where("count > 1").count()
    return row.asDict() | {"repeated_seq": repeated}
