"""Log scans by position."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F


def scan_range(log: DataFrame, begin: int, end: int) -> DataFrame:
    """Valid records with begin <= seq < end; the range is pushed to the files' statistics."""
    return log.where((F.col("seq") >= begin) & (F.col("seq") < end) & ~F.col("invalid"))


def scan_until(log: DataFrame, count: int) -> DataFrame:
    """The first ``count`` valid records, as a callback that stops the scan would see them."""
    return log.where(~F.col("invalid")).orderBy("seq").limit(count)


def scan_each(log: DataFrame, visit: Callable[[Row], bool | None]) -> int:
    """Call ``visit`` on the executors for each valid record, and return how many it was called for; False ends that partition's scan.

    Partitions are visited side by side, in no order.  A task that is tried again visits its
    records again, so ``visit`` must allow that; each record counts once.
    """
    fields = log.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, go = 0, True
        for b in batches:
            for r in b.to_pylist() if go else ():
                n += 1
                if visit(Row(**{f: r[f] for f in fields})) is False:
                    go = False
                    break
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return log.where(~F.col("invalid")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def shift_begin(log: DataFrame, until: int, before: Sequence[Callable[[int], None]] = (), after: Sequence[Callable[[int], None]] = ()) -> DataFrame:
    """:func:`truncate_until` between callbacks that get the new begin; one that raises before it leaves the log as it was."""
    for call in before:
        call(until)
    out = truncate_until(log, until)
    for call in after:
        call(until)
    return out


def with_pages(log: DataFrame, records: int) -> DataFrame:
    """Each record's (page, offset) where a page holds ``records`` positions."""
    return log.withColumn("page", F.floor(F.col("seq") / records).cast("long")).withColumn("offset", F.pmod("seq", F.lit(records)))


def page_counts(log: DataFrame, records: int) -> DataFrame:
    """(page, n_records, n_valid, n_tombstones) of every page that has records."""
    return with_pages(log, records).groupBy("page").agg(F.count("*").alias("n_records"), F.count_if(~F.col("invalid")).alias("n_valid"), F.count_if(F.col("tombstone")).alias("n_tombstones"))


def truncate_until(log: DataFrame, until: int) -> DataFrame:
    """The log without what lies below ``until``; keys that were written only there are gone."""
    return log.where(F.col("seq") >= until)


def bounds(log: DataFrame) -> DataFrame:
    """(begin, tail, n_records)."""
    return log.agg(F.min("seq").alias("begin"), (F.max("seq") + 1).alias("tail"), F.count("*").alias("n_records"))


def with_addresses(rows: DataFrame, order: list[str], payload: str, header: int = 16, align: int = 8, base: int = 0, stride: int = 65536) -> DataFrame:
    """``rows`` with ``addr``, ``len`` and ``next_addr``: where each payload starts in a byte log that appends in ``order``.

    The first column of ``order`` is a number.  Lengths are summed by stretches of
    ``stride`` of it, the stretches' sums run on, and within a stretch a window
    adds the rest: only the table of stretches passes through one task.
    """
    length = F.octet_length(payload)
    sized = rows.withColumn("len", length.cast("long")).withColumn("_padded", (F.lit(header) + F.ceil(length / align) * align).cast("long"))
    sized = sized.withColumn("_stretch", F.floor(F.col(order[0]) / stride))
    sums = sized.groupBy("_stretch").agg(F.sum("_padded").alias("_sum"))
    so_far = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_stretch", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = sized.join(starts, "_stretch").withColumn("addr", F.lit(base) + F.col("_start") + F.coalesce(F.sum("_padded").over(within), F.lit(0)))
    return out.withColumn("next_addr", F.col("addr") + F.col("_padded")).drop("_padded", "_stretch", "_start")
