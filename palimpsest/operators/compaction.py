"""Log compaction: the records that live on, and what that saves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .snapshot import raw_latest

RECORD_BYTES = 24


def with_newest(log: DataFrame) -> DataFrame:
    """Valid records with ``is_newest``; the newest seqs by key are few and join back, so a hot key is split by the join, not gathered."""
    newest = raw_latest(log).select(F.col("key").alias("_key"), F.col("seq").alias("_seq"))
    valid = log.where(~F.col("invalid"))
    return valid.join(newest, (valid["key"] == F.col("_key")) & (valid["seq"] == F.col("_seq")), "left").withColumn("is_newest", F.col("_seq").isNotNull()).drop("_key", "_seq")


def compact(log: DataFrame, until: int) -> DataFrame:
    """The log after compaction of what lies below ``until``: records above it, and below it the newest live one of each key."""
    below = raw_latest(log).where((F.col("seq") < until) & ~F.col("tombstone")).select("seq", "key", "value", "tombstone")
    above = log.where((F.col("seq") >= until) & ~F.col("invalid")).select("seq", "key", "value", "tombstone")
    return below.unionByName(above).withColumn("invalid", F.lit(False))


def copy_to_tail(log: DataFrame, until: int, tail: int) -> DataFrame:
    """:func:`compact` with the records below ``until`` given new positions from ``tail`` on, in their order.

    A record keeps its distance from ``until`` in the new positions, which so
    need no sort over the whole log.  Records of keys that were written
    above are not among them, so order by key stays.
    """
    out = compact(log, until)
    return out.withColumn("seq", F.when(F.col("seq") < until, F.col("seq") + F.lit(tail)).otherwise(F.col("seq")))


def compaction_stats(log: DataFrame, begin: int, until: int) -> DataFrame:
    """One row over [begin, until): scanned, compacted, skipped, tombstones and bytes, with their ratios."""
    at = (F.col("seq") >= begin) & (F.col("seq") < until)
    live = F.col("is_newest") & ~F.col("tombstone")
    out = with_newest(log).where(at).agg(
        F.count("*").alias("records_scanned"),
        F.count_if(live).alias("records_compacted"),
        F.count_if(~F.col("is_newest")).alias("records_skipped"),
        F.count_if(F.col("is_newest") & F.col("tombstone")).alias("tombstones_found"),
    )
    out = out.withColumn("bytes_scanned", F.col("records_scanned") * RECORD_BYTES).withColumn("bytes_compacted", F.col("records_compacted") * RECORD_BYTES)
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 6)
    return out.withColumn("bytes_reclaimed", F.col("bytes_scanned") - F.col("bytes_compacted")).withColumn("live_ratio", ratio("records_compacted", "records_scanned")).withColumn("compaction_ratio", F.round(1.0 - F.col("live_ratio"), 6))


def utilization(log: DataFrame) -> DataFrame:
    """(total_bytes, live_bytes, utilization): exact share of live records."""
    live = F.count_if(F.col("is_newest") & ~F.col("tombstone"))
    return with_newest(log).agg((F.count("*") * RECORD_BYTES).alias("total_bytes"), (live * RECORD_BYTES).alias("live_bytes"), F.round(F.when(F.count("*") > 0, live / F.count("*")).otherwise(1.0), 6).alias("utilization"))


def estimated_utilization(memory: Column, disk: Column, disk_share: float = 0.7) -> Column:
    """The heuristic that takes memory as all live and ``disk_share`` of the disk."""
    total = memory + disk
    return F.when(total > 0, (memory + disk * disk_share) / total).otherwise(1.0)


@dataclass
class CompactionPolicy:
    """When and how far to compact."""

    target_utilization: float = 0.5
    min_bytes: int = 1 << 20
    max_bytes: int = 1 << 30

    def range(self, begin: int, head: int) -> tuple[int, int] | None:
        """[begin, until) to compact, never past ``head``; None where there is too little."""
        until = min(begin + self.max_bytes, head)
        return None if until - begin < self.min_bytes else (begin, until)

    def due(self, log: DataFrame) -> bool:
        row = utilization(log).first()
        return row.total_bytes >= self.min_bytes and row.utilization < self.target_utilization


class AutoCompactor:
    """Compacts when the policy says so, at most ``per_hour`` times; a scheduler calls :meth:`tick`."""

    def __init__(self, policy: CompactionPolicy, per_hour: int = 12, quiet: float = 5.0):
        self.policy, self.per_hour, self.quiet = policy, per_hour, quiet
        self.paused, self.runs = False, []

    def pause(self) -> None:
        self.paused = True

    def resume(self) -> None:
        self.paused = False

    def tick(self, log: DataFrame, until: int, now: float) -> DataFrame | None:
        """The compacted log, or None if this is not the time."""
        self.runs = [t for t in self.runs if t > now - 3600]
        if self.paused or len(self.runs) >= self.per_hour or (self.runs and now - self.runs[-1] < self.quiet) or not self.policy.due(log):
            return None
        self.runs.append(now)
        return compact(log, until)
