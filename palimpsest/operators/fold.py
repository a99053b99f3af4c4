"""Operations folded into statuses and values, in log order by key.

Whether a key exists after an operation depends on the kinds alone, so windows
over (key, seq) tell it without a Python fold, and values are running aggregates
within a generation: the rows from one overwrite of a key to the next.  All
windows share one exchange on the key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ABORTED, NOT_FOUND, OK


def op_status(stream: DataFrame, begin: int = 0) -> DataFrame:
    """``stream`` (seq, key, op, ...) from ``begin`` on, with ``existed`` (before the row) and ``status``.

    Reads and upserts are Ok; a conditional insert aborts on a live key; a
    read-modify-write of an absent key and the delete of a key that nothing has
    touched are NotFound.  A failed read-modify-write touches its key.
    """
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    after = F.when(F.col("op").isin("upsert", "conditional_insert"), True).when(F.col("op") == "delete", False)
    out = stream.where(F.col("seq") >= begin).withColumn("_after", after)
    out = out.withColumn("existed", F.coalesce(F.last("_after", ignorenulls=True).over(before), F.lit(False)))
    touched = F.coalesce(F.max(F.col("op").isin("upsert", "conditional_insert", "rmw")).over(before), F.lit(False))
    status = (
        F.when(F.col("op") == "conditional_insert", F.when(F.col("existed"), ABORTED).otherwise(OK))
        .when(F.col("op") == "rmw", F.when(F.col("existed"), OK).otherwise(NOT_FOUND))
        .when(F.col("op") == "delete", F.when(touched, OK).otherwise(NOT_FOUND))
        .otherwise(OK)
    )
    return out.withColumn("status", status).drop("_after")


def fold(stream: DataFrame, modify: Callable[[str], Column] = F.sum, begin: int = 0) -> DataFrame:
    """:func:`op_status` with ``value`` after the row (null where the key is absent).

    ``modify`` is the associative aggregate that read-modify-write applies to the
    generation's values: sum adds, max raises.
    """
    out = op_status(stream, begin)
    by = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    inserted = (F.col("op") == "conditional_insert") & ~F.col("existed")
    base = F.col("op").isin("upsert", "delete") | inserted
    put = F.when(F.col("op") == "upsert", F.col("val")).when(inserted, F.col("val")).when((F.col("op") == "rmw") & F.col("existed"), F.col("val"))
    out = out.withColumn("_gen", F.sum(base.cast("long")).over(by)).withColumn("_put", put)
    within = Window.partitionBy("key", "_gen").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("value", modify("_put").over(within)).drop("_gen", "_put")


def fold_init(stream: DataFrame, initial: int = 0) -> DataFrame:
    """Values where a read-modify-write of an absent key starts from ``initial``; deletes end a generation."""
    by = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    base = F.col("op").isin("upsert", "delete")
    put = F.when(F.col("op").isin("upsert", "rmw"), F.col("val"))
    out = stream.where(F.col("op").isin("upsert", "delete", "rmw")).withColumn("_gen", F.sum(base.cast("long")).over(by)).withColumn("_put", put)
    within = Window.partitionBy("key", "_gen").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("_put").over(within)
    fresh = F.first("op").over(within)
    return out.withColumn("value", F.when(fresh == "upsert", total).otherwise(total + F.lit(initial))).drop("_gen", "_put")


def fold_ordered(stream: DataFrame, merge: Callable[[Column, Column], Column], initial: Column) -> DataFrame:
    """(key, value) where ``merge`` need not be associative: a higher-order fold over each key's rows in order.

    All rows of one key meet in one array, so this is for keys of bounded history.
    """
    rows = F.array_sort(F.collect_list(F.struct("seq", "op", "val")))
    return stream.groupBy("key").agg(F.aggregate(rows, initial, merge).alias("value"))


def fold_closure(stream: DataFrame, modify: Callable[[int, int], int | None]) -> DataFrame:
    """(seq, key, op, status, value) where a read-modify-write sets ``modify(value, val)``, and aborts where that is None.

    For closures that no running aggregate gives.  Rows are sorted by key and seq within partitions
    and applied one by one with one key's state in hand, so a key of any length needs
    sorted (spilling) rows and no more memory; its rows are still one task's, as their order demands.
    Null ops and keys are rows like others; a null ``val`` of a read-modify-write aborts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, present, touched = object(), None, False, False
        for b in batches:
            states, values = [], []
            for key, op, val in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key != at:
                    at, value, present, touched = key, None, False, False
                status = OK
                if op == "upsert" or op == "conditional_insert" and not present:
                    value, present, touched = val, True, True
                elif op == "conditional_insert":
                    status = ABORTED
                elif op == "rmw":
                    new = modify(value, val) if present and value is not None and val is not None else None
                    status = NOT_FOUND if not present else ABORTED if new is None else OK
                    value, touched = value if new is None else new, True
                elif op == "delete":
                    status = OK if touched else NOT_FOUND
                    value, present = None, False
                states.append(status)
                values.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(states, pa.string()), pa.array(values, pa.int64())], names=["seq", "key", "op", "status", "value"])

    rows = stream.select("seq", "key", "op", F.col("val").cast("long").alias("val"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, f"seq {kinds['seq']}, key {kinds['key']}, op string, status string, value long")


def serials(stream: DataFrame, stride: int = 65536) -> DataFrame:
    """:func:`op_status` with ``serial``: successful mutations of the session so far; reads do not count.

    Sums of stretches of ``stride`` seqs run on by session, and a window adds the rest within
    a stretch, so a session that holds most operations is not one task's.
    """
    done = ((F.col("op") != "read") & (F.col("status") == OK)).cast("long")
    out = op_status(stream).withColumn("_done", done).withColumn("_stretch", F.floor(F.col("seq") / stride))
    sums = out.groupBy("session", "_stretch").agg(F.sum("_done").alias("_sum"))
    before = Window.partitionBy("session").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    starts = sums.select("session", "_stretch", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("session", "_stretch").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("o.session").eqNullSafe(F.col("s.session")) & (F.col("o._stretch") == F.col("s._stretch"))
    rows = out.withColumn("_in", F.sum("_done").over(within)).alias("o").join(starts.alias("s"), same)
    names = [c for c in out.columns if c not in ("_done", "_stretch")]
    return rows.select(*[F.col(f"o.{c}") for c in names], (F.col("s._start") + F.col("o._in")).alias("serial"))


def to_log(folded: DataFrame) -> DataFrame:
    """Records that the mutations append: (seq, key, value, tombstone, invalid, session); failed operations append none."""
    kept = folded.where((F.col("op") != "read") & (F.col("status") == OK))
    return kept.select("seq", "key", "value", (F.col("op") == "delete").alias("tombstone"), F.lit(False).alias("invalid"), "session")
