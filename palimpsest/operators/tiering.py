"""A hot and a cold log as one store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .checkpoint import CheckpointStore
from .compaction import RECORD_BYTES
from .snapshot import latest, raw_latest


def tier_newest(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """(key, seq, value, tombstone, tier): hot records win over cold ones whatever their seq; tombstones mask."""
    both = hot.select("seq", "key", "value", "tombstone", "invalid").withColumn("tier", F.lit("hot")).unionByName(cold.select("seq", "key", "value", "tombstone", "invalid").withColumn("tier", F.lit("cold")))
    newest = F.max_by(F.struct("seq", "value", "tombstone", "tier"), F.struct((F.col("tier") == "hot").cast("int"), F.col("seq"))).alias("r")
    return both.where(~F.col("invalid")).groupBy("key").agg(newest).select("key", "r.seq", "r.value", "r.tombstone", "r.tier")


def tier_read(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """(key, value, tier) of live keys."""
    return tier_newest(hot, cold).where(~F.col("tombstone")).select("key", "value", "tier")


def split(log: DataFrame, move: Column) -> tuple[DataFrame, DataFrame]:
    """(stays hot, goes cold): newest records by key that ``move`` chooses go; tombstones among them always do."""
    newest = raw_latest(log)
    return newest.where(~(move | F.col("tombstone"))), newest.where(move | F.col("tombstone"))


def migrate_by_age(log: DataFrame, until: int) -> DataFrame:
    """(key, seq, value, tombstone, goes_cold): newest records below ``until`` go."""
    return raw_latest(log).withColumn("goes_cold", F.col("seq") < until)


def access_counts(stream: DataFrame) -> DataFrame:
    """(key, accesses): exact reads and read-modify-writes by key."""
    return stream.where(F.col("op").isin("read", "rmw")).groupBy("key").agg(F.count("*").alias("accesses"))


def access_sketch(stream: DataFrame, eps: float = 0.001, confidence: float = 0.99, seed: int = 1) -> DataFrame:
    """One Count-Min sketch of the keys' accesses, of fixed size, for keys too many to count."""
    return stream.where(F.col("op").isin("read", "rmw")).agg(F.count_min_sketch("key", F.lit(eps), F.lit(confidence), F.lit(seed)).alias("sketch"))


def migrate_by_frequency(log: DataFrame, stream: DataFrame, until: int, at_least: int, decay: int = 0) -> DataFrame:
    """As :func:`migrate_by_age`, but keys with ``at_least`` accesses, halved ``decay`` times, stay; tombstones go."""
    counts = access_counts(stream).withColumn("accesses", F.shiftright("accesses", decay))
    out = raw_latest(log).join(counts, "key", "left").withColumn("accesses", F.coalesce("accesses", F.lit(0)))
    return out.withColumn("goes_cold", (F.col("seq") < until) & (F.col("tombstone") | (F.col("accesses") < at_least)))


def compact_cold(cold: DataFrame, until: int) -> DataFrame:
    """Live cold rows; what is newest by key stays even below ``until``."""
    return latest(cold).withColumn("kept_below", F.col("seq") < until)


def should_compact(size: int, budget: int, trigger: float = 0.9) -> bool:
    return size >= budget * trigger


def compact_until(begin: int, tail: int, share: float = 0.2, most: int = 256 << 20) -> int:
    """Where a compaction of a tier ends: a share of it, at most ``most``."""
    return begin + min(int((tail - begin) * share), most)


def gated_read(hot: DataFrame, cold: DataFrame, keys: DataFrame, bits: int, functions: int) -> DataFrame:
    """(key, value, tier) of the live ones of ``keys``: the hot tier answers first, and the cold one is read only for other keys that its Bloom filter lets pass."""
    wanted = keys.select("key").distinct()
    here = raw_latest(hot.join(wanted, "key", "left_semi"))
    rest = wanted.join(here.select("key"), "key", "left_anti")
    passed = bloom.might_contain(rest, bloom.build(cold.select("key"), bits, functions), bits, functions).where("maybe")
    there = latest(cold.join(passed.select("key"), "key", "left_semi"))
    return here.where(~F.col("tombstone")).select("key", "value", F.lit("hot").alias("tier")).unionByName(there.select("key", "value", F.lit("cold").alias("tier")))


def keep_hot(log: DataFrame, stream: DataFrame, until: int, tail: int, at_least: int, decay: int = 0) -> tuple[DataFrame, DataFrame]:
    """(hot log, cold rows) after a migration by frequency: often used keys below ``until`` are appended again from ``tail`` on.

    Live records keep their distance from ``until`` in the new positions; tombstones
    below it go to the cold tier, where they mask older rows.
    """
    moved = migrate_by_frequency(log, stream, until, at_least, decay)
    columns = ["seq", "key", "value", "tombstone"]
    again = moved.where((F.col("seq") < until) & ~F.col("goes_cold")).withColumn("seq", F.col("seq") + F.lit(tail)).select(*columns)
    above = log.where((F.col("seq") >= until) & ~F.col("invalid")).select(*columns)
    false = F.lit(False)
    return above.unionByName(again).withColumn("invalid", false), moved.where("goes_cold").select(*columns).withColumn("invalid", false)


def tier_stats(hot: DataFrame, cold: DataFrame) -> DataFrame:
    """(tier, records, size_bytes, begin, tail, live_keys) of each tier that has valid records; a key is live in a tier by that tier alone."""
    both = hot.withColumn("tier", F.lit("hot")).unionByName(cold.withColumn("tier", F.lit("cold"))).where(~F.col("invalid"))
    sizes = both.groupBy("tier").agg(F.count("*").alias("records"), (F.count("*") * RECORD_BYTES).alias("size_bytes"), F.min("seq").alias("begin"), (F.max("seq") + 1).alias("tail"))
    live = latest(both, ["tier", "key"]).groupBy("tier").agg(F.count("*").alias("live_keys"))
    return sizes.join(live, "tier", "left").withColumn("live_keys", F.coalesce("live_keys", F.lit(0)))


class TierWorker:
    """Keeps two tiers within their budgets of bytes; a scheduler calls :meth:`tick`."""

    def __init__(self, hot_budget: int, cold_budget: int, trigger: float = 0.9, share: float = 0.2, checkpoints: CheckpointStore | None = None):
        self.hot_budget, self.cold_budget, self.trigger, self.share, self.checkpoints = hot_budget, cold_budget, trigger, share, checkpoints
        self.requested = False

    def request_checkpoint(self) -> None:
        """Have the next tick make one checkpoint of both tiers."""
        if self.checkpoints is None:
            raise ValueError("the worker has no checkpoint store")
        self.requested = True

    def tick(self, hot: DataFrame, cold: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """(hot, cold, what was done): a requested checkpoint first, then the hot tier, then the cold one.

        A hot tier at its trigger moves the newest records of its first ``share`` to the cold one;
        a cold tier at its trigger keeps live rows only, as nothing lies below it that a tombstone could mask.
        Reads of both tiers give the same before and after, as a key's hot records have higher seqs than its cold ones.
        """
        columns, done = ["seq", "key", "value", "tombstone", "invalid"], []
        at = hot.agg(F.count("*").alias("n"), F.min("seq").alias("begin"), F.max("seq").alias("last")).first()
        n_cold = cold.count()
        if self.requested:
            last = cold.agg(F.max("seq")).first()[0]
            done.append("checkpoint " + self.checkpoints.tiers(hot, cold, 1 + max(x if x is not None else -1 for x in (at.last, last))))
            self.requested = False
        if at.n and should_compact(at.n * RECORD_BYTES, self.hot_budget, self.trigger):
            until = compact_until(at.begin, at.last + 1, self.share, most=at.last + 1 - at.begin)
            below = raw_latest(hot.where(F.col("seq") < until)).withColumn("invalid", F.lit(False))
            hot, cold = hot.where(F.col("seq") >= until), cold.select(*columns).unionByName(below.select(*columns))
            done.append(f"hot until {until}")
        if n_cold and should_compact(n_cold * RECORD_BYTES, self.cold_budget, self.trigger):
            live = latest(cold).withColumn("tombstone", F.lit(False)).withColumn("invalid", F.lit(False))
            cold = live.select(*columns)
            done.append("cold")
        return hot, cold, done
