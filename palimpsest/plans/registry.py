"""Registered queries over the driver's tables, and their DuckDB oracles."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import bytelog, checkpoint, compaction, fold, scan, snapshot, stats, tiering
from ..sources.eventlog import op_stream, ops, read_table
from ..store import Store
from ..streaming import store

QUERIES = {}
ORACLES = {}

#: The operation stream, what existed before each row, its status and its value, by correlated subqueries.
E = """e AS (SELECT event_id AS seq, user_id AS key, CASE event_type WHEN 'purchase' THEN 'upsert' WHEN 'click' THEN 'rmw' WHEN 'signup' THEN 'conditional_insert' WHEN 'error' THEN 'delete' ELSE 'read' END AS op,
  CAST(round(value * 100) AS BIGINT) AS val, event_id % 4 AS session FROM events)"""
X = """x AS (SELECT e.*, coalesce((SELECT arg_max(p.op, p.seq) FROM e p WHERE p.key = e.key AND p.seq < e.seq AND p.op IN ('upsert', 'conditional_insert', 'delete')) <> 'delete', false) AS existed,
  EXISTS (SELECT 1 FROM e p WHERE p.key = e.key AND p.seq < e.seq AND p.op IN ('upsert', 'conditional_insert', 'rmw')) AS touched FROM e)"""
S = """s AS (SELECT x.*, CASE op WHEN 'conditional_insert' THEN CASE WHEN existed THEN 'Aborted' ELSE 'Ok' END WHEN 'rmw' THEN CASE WHEN existed THEN 'Ok' ELSE 'NotFound' END
  WHEN 'delete' THEN CASE WHEN touched THEN 'Ok' ELSE 'NotFound' END ELSE 'Ok' END AS status,
  (SELECT max(b.seq) FROM x b WHERE b.key = x.key AND b.seq <= x.seq AND (b.op IN ('upsert', 'delete') OR (b.op = 'conditional_insert' AND NOT b.existed))) AS base FROM x)"""
V = """v AS (SELECT s.seq, s.key, s.op, s.val, s.session, s.status, s.existed, (SELECT CAST(SUM(r.val) AS BIGINT) FROM s r WHERE r.key = s.key AND r.seq BETWEEN s.base AND s.seq
  AND (r.op = 'upsert' OR (r.op IN ('rmw', 'conditional_insert') AND r.status = 'Ok' AND (r.op = 'rmw' OR NOT r.existed)))) AS value FROM s)"""
L = "l AS (SELECT seq, key, value, op = 'delete' AS tombstone, session FROM v WHERE op <> 'read' AND status = 'Ok')"
N = "n AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM l) WHERE rn = 1)"
FOLD = f"WITH {E}, {X}, {S}, {V}"
LOG = f"{FOLD}, {L}"
NEWEST = f"{LOG}, {N}"
CUT = "(SELECT CAST(floor((max(event_id) + 1) * {share}) AS BIGINT) FROM events)"
HALF, QUARTER, THREE = (CUT.format(share=s) for s in (0.5, 0.25, 0.75))


def register(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def cut(spark: SparkSession, d: str, share: float) -> int:
    """A position by share of the log: one number from the files' statistics."""
    return int((read_table(spark, d, "events").agg(F.max("event_id")).first()[0] + 1) * share)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one the cluster shares; a temporary one only where the session names none and all runs on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="palimpsest-")
    return f"{top}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = work_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def log_of(spark: SparkSession, d: str) -> DataFrame:
    return fold.to_log(fold.fold(ops(spark, d)))


def log_once(spark: SparkSession, d: str) -> DataFrame:
    """The log as a table, for queries that take several slices of it.

    Slices of a log that is not written fold it again each, and as all folds are dealt by key,
    a union of them has one task hold the sorted rows of every fold at once.
    """
    return written(spark, log_of(spark, d), "log")


@register(f"{NEWEST} SELECT key, seq, value FROM n WHERE NOT tombstone")
def kv_snapshot_latest(spark, d):
    return snapshot.latest(log_of(spark, d))


@register(f"{NEWEST} SELECT key, seq, value, tombstone FROM n")
def kv_raw_latest(spark, d):
    return snapshot.raw_latest(log_of(spark, d))


@register(f"{NEWEST} SELECT key, value FROM n WHERE NOT tombstone AND key = 7")
def kv_point_read(spark, d):
    return snapshot.point_read(log_of(spark, d), 7)


@register(f"{NEWEST} SELECT c_custkey AS key, (SELECT value FROM n WHERE n.key = c_custkey AND NOT tombstone) AS value FROM customer")
def kv_multi_read(spark, d):
    return snapshot.multi_read(log_of(spark, d), read_table(spark, d, "customer").select(F.col("c_custkey").alias("key")))


ORDERS = "o AS (SELECT o_orderkey AS key, CAST(round(o_totalprice * 100) AS BIGINT) AS value FROM orders)"


@register(f"WITH {ORDERS} SELECT key, CASE WHEN key % 3 = 0 THEN value + 1 ELSE value END AS value FROM o")
def kv_upsert_batch(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.round(F.col("o_totalprice") * 100).cast("long").alias("value"))
    first = o.select(F.lit(0).cast("long").alias("seq"), "key", "value", F.lit(False).alias("tombstone"), F.lit(False).alias("invalid"))
    second = first.where("key % 3 = 0").withColumn("seq", F.lit(1).cast("long")).withColumn("value", F.col("value") + 1)
    return snapshot.latest(first.unionByName(second)).select("key", "value")


@register(f"{LOG} SELECT DISTINCT key FROM l a WHERE tombstone AND NOT EXISTS (SELECT 1 FROM l b WHERE b.key = a.key AND b.seq > a.seq)")
def kv_delete_tombstone(spark, d):
    return snapshot.raw_latest(log_of(spark, d)).where("tombstone").select("key")


@register(f"{NEWEST} SELECT c_custkey AS key, CAST(round(c_acctbal * 100) AS BIGINT) AS value FROM customer WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.key = c_custkey AND NOT tombstone)")
def kv_conditional_insert(spark, d):
    batch = read_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.round(F.col("c_acctbal") * 100).cast("long").alias("value"))
    return snapshot.conditional_insert(log_of(spark, d), batch)


@register(f"{FOLD} SELECT seq, key, status, value FROM v WHERE op = 'rmw'")
def kv_rmw_counter(spark, d):
    return fold.fold(ops(spark, d)).where("op = 'rmw'").select("seq", "key", "status", "value")


@register(
    f"""WITH {E}, m AS (SELECT * FROM e WHERE op IN ('upsert', 'delete', 'rmw')),
    b AS (SELECT m.*, (SELECT max(p.seq) FROM m p WHERE p.key = m.key AND p.seq <= m.seq AND p.op <> 'rmw') AS base FROM m)
    SELECT seq, key, (SELECT CAST(sum(r.val) AS BIGINT) FROM m r WHERE r.key = b.key AND r.seq >= coalesce(b.base, -1) AND r.seq <= b.seq AND r.op <> 'delete')
    + CASE WHEN (SELECT op FROM m q WHERE q.seq = b.base) = 'upsert' THEN 0 ELSE 1000 END AS value FROM b"""
)
def kv_rmw_init_default(spark, d):
    return fold.fold_init(ops(spark, d), 1000).select("seq", "key", "value")


@register(f"{FOLD}, m AS (SELECT s.seq, s.key, (SELECT max(r.val) FROM s r WHERE r.key = s.key AND r.seq BETWEEN s.base AND s.seq AND (r.op = 'upsert' OR (r.op = 'rmw' AND r.existed) OR (r.op = 'conditional_insert' AND NOT r.existed))) AS value FROM s) SELECT * FROM m")
def kv_rmw_max(spark, d):
    return fold.fold(ops(spark, d), F.max).select("seq", "key", "value")


@register(f"{FOLD} SELECT seq, key, op, existed, status, value FROM v")
def kv_op_status_audit(spark, d):
    return fold.fold(ops(spark, d)).select("seq", "key", "op", "existed", "status", "value")


@register(
    f"""{FOLD} SELECT count(*) AS total_ops, count(*) FILTER (op = 'read') AS n_read, count(*) FILTER (op = 'upsert') AS n_upsert, count(*) FILTER (op = 'delete') AS n_delete, count(*) FILTER (op = 'rmw') AS n_rmw,
    count(*) FILTER (op = 'conditional_insert') AS n_conditional_insert, count(*) FILTER (status = 'Ok') AS n_ok, count(*) FILTER (status = 'NotFound') AS n_notfound, count(*) FILTER (status = 'Aborted') AS n_aborted,
    count(*) FILTER (op = 'read' AND value IS NOT NULL) AS read_hits FROM v"""
)
def kv_op_stats(spark, d):
    return stats.op_stats(fold.fold(ops(spark, d)))


@register(f"{FOLD} SELECT count(*) AS reads, count(value) AS hits, round(count(value)::DOUBLE / count(*), 6) AS hit_rate FROM v WHERE op = 'read'")
def kv_hit_rate(spark, d):
    return stats.hit_rate(fold.fold(ops(spark, d)))


@register(f"{NEWEST} SELECT count(*) AS all_keys, count(*) FILTER (NOT tombstone) AS live_keys FROM n")
def kv_size(spark, d):
    return snapshot.size(log_of(spark, d))


#: A log where every 97th record is invalid.
MARKED = f"WITH {E}, m AS (SELECT seq, key, val, seq % 97 = 0 AS invalid FROM e)"


def marked(spark, d):
    return ops(spark, d).select("seq", "key", F.col("val").alias("value"), (F.col("op") == "delete").alias("tombstone"), (F.col("seq") % 97 == 0).alias("invalid"))


@register(f"{MARKED} SELECT seq, key, val AS value FROM m WHERE seq >= {QUARTER} AND seq < {HALF} AND NOT invalid")
def log_scan_range(spark, d):
    return scan.scan_range(marked(spark, d), cut(spark, d, 0.25), cut(spark, d, 0.5)).select("seq", "key", "value")


@register(f"{MARKED} SELECT seq, key, val AS value FROM m WHERE NOT invalid ORDER BY seq LIMIT 100")
def log_scan_early_stop(spark, d):
    return scan.scan_until(marked(spark, d), 100).select("seq", "key", "value")


@register(f"{MARKED} SELECT seq, key, (SELECT max(p.seq) FROM m p WHERE p.key = m.key AND p.seq < m.seq AND NOT p.invalid) AS previous_seq, (SELECT count(*) FROM m p WHERE p.key = m.key AND p.seq <= m.seq AND NOT p.invalid)::INT AS depth FROM m WHERE NOT invalid")
def log_version_chain(spark, d):
    return snapshot.version_chain(marked(spark, d))


@register(f"{MARKED} SELECT seq, seq // 256 AS page, seq % 256 AS offset FROM m")
def log_page_layout(spark, d):
    return scan.with_pages(marked(spark, d), 256).select("seq", "page", F.col("offset").cast("long").alias("offset"))


@register(f"WITH {E} SELECT seq // 256 AS page, count(*) AS n_records, count(*) FILTER (seq % 97 <> 0) AS n_valid, count(*) FILTER (op = 'delete') AS n_tombstones FROM e GROUP BY 1")
def log_parallel_page_counts(spark, d):
    return scan.page_counts(marked(spark, d), 256)


@register(f"{NEWEST} SELECT seq, key, value FROM n WHERE NOT tombstone AND seq < {HALF} UNION ALL SELECT seq, key, value FROM l WHERE seq >= {HALF}")
def compaction_live_set(spark, d):
    return compaction.compact(log_once(spark, d), cut(spark, d, 0.5)).select("seq", "key", "value")


@register(
    f"""{NEWEST}, c AS (SELECT l.*, l.seq = n.seq AS newest FROM l JOIN n USING (key) WHERE l.seq < {HALF}),
    t AS (SELECT count(*) AS records_scanned, count(*) FILTER (newest AND NOT c.tombstone) AS records_compacted, count(*) FILTER (NOT newest) AS records_skipped, count(*) FILTER (newest AND c.tombstone) AS tombstones_found FROM c)
    SELECT t.*, records_scanned * 24 AS bytes_scanned, records_compacted * 24 AS bytes_compacted, (records_scanned - records_compacted) * 24 AS bytes_reclaimed,
    round(records_compacted::DOUBLE / records_scanned, 6) AS live_ratio, round(1 - round(records_compacted::DOUBLE / records_scanned, 6), 6) AS compaction_ratio FROM t"""
)
def compaction_stats(spark, d):
    return compaction.compaction_stats(log_of(spark, d), 0, cut(spark, d, 0.5))


@register("SELECT 0::BIGINT AS mismatches")
def compaction_preserves(spark, d):
    log = log_once(spark, d)
    a, b = snapshot.latest(log), snapshot.latest(compaction.compact(log, cut(spark, d, 0.5))).toDF("key", "seq2", "value2")
    both = a.join(b, "key", "full_outer")
    return both.agg(F.count_if(~(F.col("seq").eqNullSafe(F.col("seq2")) & F.col("value").eqNullSafe(F.col("value2")))).alias("mismatches"))


@register(f"{NEWEST} SELECT (SELECT count(*) * 24 FROM l) AS total_bytes, count(*) FILTER (NOT tombstone) * 24 AS live_bytes, round(count(*) FILTER (NOT tombstone)::DOUBLE / (SELECT count(*) FROM l), 6) AS utilization FROM n")
def log_utilization_exact(spark, d):
    return compaction.utilization(log_of(spark, d))


@register(f"SELECT round((24 * count(*) FILTER (event_id >= {HALF}) + 0.7::DOUBLE * 24 * count(*) FILTER (event_id < {HALF})) / (24 * count(*)), 6) AS utilization FROM events")
def log_utilization_estimate(spark, d):
    half = cut(spark, d, 0.5)
    sums = read_table(spark, d, "events").agg((F.count_if(F.col("event_id") >= half) * 24).alias("memory"), (F.count_if(F.col("event_id") < half) * 24).alias("disk"))
    return sums.select(F.round(compaction.estimated_utilization(F.col("memory"), F.col("disk")), 6).alias("utilization"))


@register(f"{LOG} SELECT seq, key, value FROM l WHERE seq >= {QUARTER}")
def truncate_until(spark, d):
    return scan.truncate_until(log_of(spark, d), cut(spark, d, 0.25)).select("seq", "key", "value")


@register("WITH b AS (SELECT o_orderkey % 4096 AS bucket, count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM orders) GROUP BY 1) SELECT 4096::BIGINT AS table_size, sum(n)::BIGINT AS used_entries, count(*) AS used_buckets, count(*) FILTER (n > 7) AS overflow_buckets, max(n) AS max_in_bucket, round(sum(n)::DOUBLE / 28672, 6) AS load_factor FROM b")
def index_distribution(spark, d):
    return stats.index_distribution(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), 4096)


@register("SELECT o_orderkey % 64 AS old_bucket, o_orderkey % 128 AS new_bucket, count(*) AS n FROM (SELECT DISTINCT o_orderkey FROM orders) GROUP BY 1, 2")
def index_rebucket(spark, d):
    return stats.rebucket(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), 64, 128)


#: The older half of the log is cold; the hot half has its own records only.
TIERS = f"{LOG}, c AS (SELECT arg_max(value, seq) AS value, arg_max(tombstone, seq) AS tombstone, max(seq) AS seq, key FROM l WHERE seq < {HALF} GROUP BY key), h AS (SELECT l.* FROM l WHERE seq = (SELECT max(m.seq) FROM l m WHERE m.key = l.key) AND seq >= {HALF})"


def tiers(spark, d):
    log, half = log_once(spark, d), cut(spark, d, 0.5)
    return log.where(F.col("seq") >= half), log.where(F.col("seq") < half)


@register(f"{NEWEST} SELECT key, value, CASE WHEN seq >= {HALF} THEN 'hot' ELSE 'cold' END AS tier FROM n WHERE NOT tombstone")
def tier_read(spark, d):
    return tiering.tier_read(*tiers(spark, d))


@register(f"{NEWEST} SELECT key, seq, value, tombstone, seq < {HALF} AS goes_cold FROM n")
def tier_migrate_aging(spark, d):
    return tiering.migrate_by_age(log_of(spark, d), cut(spark, d, 0.5))


@register(f"{NEWEST}, a AS (SELECT key, count(*) AS accesses FROM e WHERE op IN ('read', 'rmw') GROUP BY key) SELECT n.key, seq, value, tombstone, coalesce(accesses, 0) AS accesses, seq < {THREE} AND (tombstone OR coalesce(accesses, 0) < 27) AS goes_cold FROM n LEFT JOIN a USING (key)")
def tier_migrate_frequency(spark, d):
    return tiering.migrate_by_frequency(log_of(spark, d), ops(spark, d), cut(spark, d, 0.75), 27)


@register(f"{TIERS} SELECT c.key FROM c JOIN h ON c.key = h.key WHERE h.tombstone AND NOT c.tombstone")
def tier_delete_masks_cold(spark, d):
    hot, cold = tiers(spark, d)
    return tiering.tier_newest(hot, cold).where("tombstone and tier = 'hot'").join(snapshot.latest(cold), "key", "left_semi").select("key")


@register(f"{TIERS} SELECT key, seq, value, seq < {QUARTER} AS kept_below FROM c WHERE NOT tombstone")
def tier_compact_cold(spark, d):
    return tiering.compact_cold(tiers(spark, d)[1], cut(spark, d, 0.25)).select("key", "seq", "value", "kept_below")


@register(f"WITH {E} SELECT key, count(*) AS accesses FROM e WHERE op IN ('read', 'rmw') GROUP BY key")
def key_access_counts(spark, d):
    return tiering.access_counts(ops(spark, d))


@register(f"{LOG} SELECT key, max(seq) AS seq, arg_max(coalesce(value, -1), seq) AS value FROM l WHERE seq < {HALF} GROUP BY key HAVING NOT arg_max(tombstone, seq)")
def ckpt_prefix_recover(spark, d):
    return snapshot.as_of(log_of(spark, d), cut(spark, d, 0.5))


SERIAL = f"{FOLD}, q AS (SELECT v.*, (SELECT count(*) FROM v p WHERE p.session = v.session AND p.seq <= v.seq AND p.op <> 'read' AND p.status = 'Ok') AS serial FROM v)"


@register(f"{FOLD} SELECT session, count(*) FILTER (op <> 'read' AND status = 'Ok') AS serial FROM v WHERE seq < {HALF} GROUP BY session")
def ckpt_session_serials(spark, d):
    return checkpoint.session_states(fold.serials(ops(spark, d)), cut(spark, d, 0.5))


@register(f"{LOG} SELECT seq, key, value, tombstone FROM l WHERE seq >= {QUARTER} AND seq < {HALF}")
def ckpt_incremental_delta(spark, d):
    return checkpoint.delta(log_of(spark, d), cut(spark, d, 0.25), cut(spark, d, 0.5)).select("seq", "key", "value", "tombstone")


@register(f"{LOG} SELECT key, max(seq) AS seq, arg_max(coalesce(value, -1), seq) AS value FROM l WHERE seq < {THREE} GROUP BY key HAVING NOT arg_max(tombstone, seq)")
def ckpt_chain_apply(spark, d):
    log = log_once(spark, d)
    a, b, c = (cut(spark, d, s) for s in (0.25, 0.5, 0.75))
    base = snapshot.raw_latest(log.where(F.col("seq") < a)).withColumn("invalid", F.lit(False))
    slices = [checkpoint.delta(log, x, y).select(*base.columns) for x, y in ((a, b), (b, c))]
    return checkpoint.apply_chain(base, *slices)


@register(f"{LOG} SELECT key, max(seq) AS seq, arg_max(coalesce(value, -1), seq) AS value FROM l WHERE seq < {THREE} GROUP BY key HAVING NOT arg_max(tombstone, seq)")
def ckpt_store_recover(spark, d):
    log = log_once(spark, d)
    kept = checkpoint.CheckpointStore(spark, work_folder(spark, "checkpoints"))
    for share in (0.25, 0.5, 0.75):
        kept.incremental(log, cut(spark, d, share))
    return kept.recover()[0].select("key", "seq", "value")


def manifests(spark, d):
    """Six checkpoints over the log; the fifth leaves a gap."""
    n = cut(spark, d, 1.0)
    return spark.range(1, 7).select(F.col("id").cast("int").alias("version"), F.concat(F.lit("t"), "id").alias("token"), ((F.col("id") - 1) * n / 8 + F.when(F.col("id") == 5, 1).otherwise(0)).cast("long").alias("begin_seq"), (F.col("id") * n / 8).cast("long").alias("final_seq"))


MANIFESTS = "m AS (SELECT i::INT AS version, 't' || i AS token, floor((i - 1) * n / 8.0)::BIGINT + CASE WHEN i = 5 THEN 1 ELSE 0 END AS begin_seq, floor(i * n / 8.0)::BIGINT AS final_seq FROM range(1, 7) r(i), (SELECT max(event_id) + 1 AS n FROM events))"


@register(f"WITH {MANIFESTS} SELECT m.*, coalesce((SELECT p.final_seq = m.begin_seq FROM m p WHERE p.version = m.version - 1), true) AS continues FROM m")
def ckpt_chain_validate(spark, d):
    return checkpoint.check_chain(manifests(spark, d))


@register(f"WITH {MANIFESTS} SELECT * FROM m WHERE version = (SELECT max(version) FROM m)")
def ckpt_latest(spark, d):
    return checkpoint.newest(manifests(spark, d))


@register(f"{SERIAL} SELECT seq, key, op, session, serial FROM q WHERE serial > (SELECT count(*) FROM v p WHERE p.session = q.session AND p.op <> 'read' AND p.status = 'Ok' AND p.seq < {HALF})")
def session_resume(spark, d):
    rows = fold.serials(ops(spark, d))
    return checkpoint.resume(rows, checkpoint.session_states(rows, cut(spark, d, 0.5))).select("seq", "key", "op", "session", "serial")


BYTES = "b AS (SELECT conv_id, turn, text, strlen(text) AS len, sum(16 + (strlen(text) + 7) // 8 * 8) OVER (ORDER BY conv_id, turn) - (16 + (strlen(text) + 7) // 8 * 8) AS addr FROM conversations WHERE strlen(text) > 0)"
END = "(SELECT max(addr) FROM b)"


def entries(spark, d):
    return bytelog.entries(read_table(spark, d, "conversations"), ["conv_id", "turn"], "text")


def last_addr(log):
    return log.agg(F.max("addr")).first()[0]


@register(f"WITH {BYTES} SELECT conv_id, turn, addr::BIGINT AS addr, len::BIGINT AS len FROM b WHERE addr < {END} // 2")
def bytelog_scan_committed(spark, d):
    log = entries(spark, d)
    return bytelog.scan(log, 0, last_addr(log) // 2).select("conv_id", "turn", "addr", "len")


@register(f"WITH {BYTES} SELECT conv_id, turn, addr::BIGINT AS addr FROM b WHERE addr >= {END} // 4 AND addr < {END} // 2")
def bytelog_truncate(spark, d):
    log = entries(spark, d)
    end = last_addr(log)
    return bytelog.scan(log, bytelog.truncate_before(0, end // 2, end // 4), end // 2).select("conv_id", "turn", "addr")


@register(f"WITH {BYTES} SELECT (({END} // 4096 - {END} // 4 // 4096) * 4096)::BIGINT AS reclaimable")
def bytelog_reclaimable(spark, d):
    end = F.max("addr")
    pages = lambda x: F.floor(x / 4096)
    return entries(spark, d).agg(((pages(end) - pages(F.floor(end / 4))) * 4096).cast("long").alias("reclaimable"))


@register(f"WITH {BYTES} SELECT conv_id, turn, addr::BIGINT AS addr FROM b WHERE addr < coalesce((SELECT min(addr) FROM b WHERE conv_id % 50 = 49), 9223372036854775807)")
def bytelog_recover_prefix(spark, d):
    log = entries(spark, d).withColumn("valid", F.col("conv_id") % 50 != 49)
    return bytelog.recover(log).select("conv_id", "turn", "addr")


@register(f"WITH {BYTES} SELECT count(*) AS entries, 0::BIGINT AS bad, NULL::BIGINT AS first_bad_addr FROM b")
def bytelog_self_check(spark, d):
    return bytelog.self_check(entries(spark, d), "text")


def mix_query(name: str, threshold: int, write: str) -> None:
    """A mix of reads and writes: op by event_id % 1000, as a batch fold."""
    sql = f"""WITH e AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_id * 7919 % 1000 < {threshold} THEN '{write}' ELSE 'read' END AS op, CAST(round(value * 100) AS BIGINT) AS val, event_id % 4 AS session FROM events UNION ALL
    SELECT -1 - user_id, user_id, 'upsert', 0, 0 FROM (SELECT DISTINCT user_id FROM events)),
    b AS (SELECT e.*, (SELECT max(p.seq) FROM e p WHERE p.key = e.key AND p.seq <= e.seq AND p.op = 'upsert') AS base FROM e)
    SELECT seq, key, op, (SELECT CAST(sum(r.val) AS BIGINT) FROM e r WHERE r.key = b.key AND r.seq BETWEEN b.base AND b.seq AND r.op <> 'read') AS value FROM b WHERE seq >= 0"""

    def run(spark, d):
        events = read_table(spark, d, "events")
        stream = op_stream(events, F.when(F.col("event_id") * 7919 % 1000 < threshold, F.lit(write)).otherwise("read"))
        load = events.select(F.col("user_id").alias("key")).distinct().select((-1 - F.col("key")).alias("seq"), "key", F.lit("upsert").alias("op"), F.lit(0).cast("long").alias("val"), F.lit(0).cast("long").alias("session"))
        return fold.fold(stream.unionByName(load.withColumn("session", F.col("session").cast(stream.schema["session"].dataType))), begin=-(1 << 62)).where("seq >= 0").select("seq", "key", "op", "value")

    run.__name__ = name
    register(sql)(run)


mix_query("ycsb_a", 500, "upsert")
mix_query("ycsb_b", 50, "upsert")
mix_query("ycsb_c", 0, "upsert")
mix_query("ycsb_f", 500, "rmw")


@register("SELECT l_orderkey AS orderkey, l_linenumber AS line, CAST(max(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2")
def struct_key_snapshot(spark, d):
    rows = read_table(spark, d, "lineitem").select(F.struct(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line")).alias("key"), F.col("l_quantity").cast("long").alias("value"))
    log = rows.withColumn("seq", F.col("value")).withColumn("tombstone", F.lit(False)).withColumn("invalid", F.lit(False))
    return snapshot.latest(log).select("key.orderkey", "key.line", F.col("value").alias("quantity"))


@register("SELECT doc_id AS key, strlen(text)::BIGINT AS payload_bytes, length(text)::BIGINT AS chars FROM documents")
def varlen_payload(spark, d):
    docs = read_table(spark, d, "documents").select(F.col("doc_id").alias("key"), scalars.span(F.col("text")).alias("value"))
    return docs.select("key", scalars.span_length(F.col("value")).cast("long").alias("payload_bytes"), F.length(scalars.span_text(F.col("value"))).cast("long").alias("chars"))


def _hash_sql(key: str) -> str:
    """The compatible hash of a non-negative number, in 128-bit integers, as an unsigned one."""
    h = "8::HUGEINT"
    for shift in (0, 16, 32, 48):
        h = f"(({h} * 40343 + (({key} >> {shift}) & 65535)) % 18446744073709551616::HUGEINT)"
    h = f"({h} * 40343 % 18446744073709551616::HUGEINT)"
    return f"(({h} // 8796093022208) + ({h} % 8796093022208) * 2097152)"


@register(f"WITH h AS (SELECT key, {_hash_sql('key')} AS h FROM (SELECT DISTINCT user_id AS key FROM events)) SELECT key, (CASE WHEN h >= 9223372036854775808::HUGEINT THEN h - 18446744073709551616::HUGEINT ELSE h END)::BIGINT AS hash, (h % 1024)::BIGINT AS bucket, (h // 281474976710656 % 16384)::BIGINT AS tag FROM h")
def compat_hash(spark, d):
    keys = read_table(spark, d, "events").select(F.col("user_id").alias("key")).distinct().withColumn("hash", scalars.compat_hash_long(F.col("key")))
    return keys.select("key", "hash", scalars.key_bucket(F.col("hash"), 1024).alias("bucket"), scalars.key_tag(F.col("hash")).alias("tag"))


@register(f"{NEWEST} SELECT key, seq, value FROM n WHERE NOT tombstone")
def streaming_snapshot(spark, d):
    """The log of a stream of micro-batches, folded in batch."""
    folder = work_folder(spark, "stream")
    log = store.ingest(spark, f"{d}/events.parquet", op_stream, f"{folder}/log", f"{folder}/checkpoint")
    return snapshot.latest(fold.to_log(fold.fold(log)))


@register(f"{FOLD} SELECT session, count(*) AS n_ops, count(*) FILTER (status = 'Ok') AS n_ok FROM v GROUP BY session")
def session_registry(spark, d):
    return fold.op_status(ops(spark, d)).groupBy("session").agg(F.count("*").alias("n_ops"), F.count_if(F.col("status") == "Ok").alias("n_ok"))


@register(f"{NEWEST} SELECT key, n.seq + CASE WHEN n.seq < {HALF} THEN (SELECT max(event_id) + 1 FROM events) ELSE 0 END AS seq, value FROM n WHERE NOT tombstone")
def compaction_copy_to_tail(spark, d):
    out = compaction.copy_to_tail(log_once(spark, d), cut(spark, d, 0.5), cut(spark, d, 1.0))
    return snapshot.latest(out)


@register(f"{LOG} SELECT min(seq) AS begin, max(seq) + 1 AS tail, count(*) AS n_records FROM l")
def log_bounds(spark, d):
    return scan.bounds(log_of(spark, d))


@register(f"{NEWEST} SELECT o_orderkey AS seq, o_custkey AS key, CASE WHEN o_orderkey = min(o_orderkey) OVER (PARTITION BY o_custkey) AND NOT EXISTS (SELECT 1 FROM n WHERE n.key = o_custkey AND NOT tombstone) THEN 'Ok' ELSE 'Aborted' END AS status FROM orders")
def kv_conditional_insert_status(spark, d):
    """Each customer's orders as conditional inserts of the customer's key: the first may insert, the others abort."""
    batch = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("key"))
    return snapshot.conditional_insert_status(log_of(spark, d), batch).select("seq", "key", "status")


def damaged(spark, d):
    """A byte log whose payloads of every 50th conversation were changed after their checksums were taken."""
    log = entries(spark, d)
    return bytelog.with_recomputed(log.withColumn("text", F.when(F.col("conv_id") % 50 == 49, F.concat(F.lit("?"), F.expr("substring(text, 2)"))).otherwise(F.col("text"))), "text")


CHANGED = "conv_id % 50 = 49 AND text NOT LIKE '?%'"


@register(f"WITH {BYTES} SELECT count(*) AS entries, count(*) FILTER ({CHANGED}) AS bad, (min(addr) FILTER ({CHANGED}))::BIGINT AS first_bad_addr FROM b")
def bytelog_self_check_damaged(spark, d):
    return bytelog.self_check(damaged(spark, d), "text")


@register(f"WITH {BYTES} SELECT conv_id, turn, addr::BIGINT AS addr FROM b WHERE addr < coalesce((SELECT min(addr) FROM b WHERE {CHANGED}), 9223372036854775807)")
def bytelog_recover_checksums(spark, d):
    return bytelog.recover(damaged(spark, d)).select("conv_id", "turn", "addr")


@register(f"{LOG} SELECT seq, key, value, tombstone FROM l WHERE seq >= {QUARTER} AND seq < {HALF}")
def ckpt_log_only_recover(spark, d):
    kept = checkpoint.CheckpointStore(spark, work_folder(spark, "checkpoints"))
    kept.log_only(log_of(spark, d), cut(spark, d, 0.25), cut(spark, d, 0.5))
    return kept.recover_log_only()[0].select("seq", "key", "value", "tombstone")


@register(f"{NEWEST} SELECT key, seq, value FROM n WHERE NOT tombstone")
def ckpt_index_only_recover(spark, d):
    """The index of the first half, and the rest of the log replayed over it."""
    log = log_once(spark, d)
    kept = checkpoint.CheckpointStore(spark, work_folder(spark, "checkpoints"))
    kept.index_only(log, cut(spark, d, 0.5))
    return kept.recover_index_only(log)[0].select("key", "seq", "value")


@register(f"{NEWEST} SELECT key, value, CASE WHEN seq >= {HALF} THEN 'hot' ELSE 'cold' END AS tier FROM n WHERE NOT tombstone")
def ckpt_tiers_recover(spark, d):
    log = log_once(spark, d)
    half, end = cut(spark, d, 0.5), cut(spark, d, 1.0)
    kept = checkpoint.CheckpointStore(spark, work_folder(spark, "checkpoints"))
    kept.tiers(log.where(F.col("seq") >= half), log.where(F.col("seq") < half), end)
    hot, cold, _ = kept.recover_tiers()
    return tiering.tier_read(hot, cold)


def store_of(spark, d, batches: int = 3):
    """A store that took the operations in batches, each under a session's name, and their results."""
    kept = Store(spark, work_folder(spark, "store"))
    stream, end, out = ops(spark, d).select("seq", "key", "op", "val"), cut(spark, d, 1.0), None
    for i in range(batches):
        a, b = end * i // batches, end * (i + 1) // batches
        with kept.session().guid(f"s{i}").build() as session:
            done = session.apply(stream.where((F.col("seq") >= a) & (F.col("seq") < b)))
        out = done if out is None else out.unionByName(done)
    return kept, out


@register(f"{FOLD} SELECT seq, key, op, status, value FROM v")
def store_batches(spark, d):
    return store_of(spark, d)[1]


@register(f"{FOLD}, b AS (SELECT v.*, (SELECT max(event_id) + 1 FROM events) AS n FROM v) SELECT 's' || CASE WHEN seq < n // 3 THEN 0 WHEN seq < n * 2 // 3 THEN 1 ELSE 2 END AS session, count(*) AS operations, count(*) FILTER (status = 'Ok') AS completed, count(*) FILTER (status <> 'Ok') AS failed, min(seq) AS first_seq, max(seq) AS last_seq, count(*) FILTER (op = 'read') AS reads, count(*) FILTER (op = 'read' AND value IS NOT NULL) AS read_hits FROM b GROUP BY 1")
def store_session_stats(spark, d):
    return store_of(spark, d)[0].stats("sessions")


@register(f"{NEWEST} SELECT key, seq, value FROM n WHERE NOT tombstone")
def store_compacted_snapshot(spark, d):
    kept, _ = store_of(spark, d)
    kept.compact(cut(spark, d, 0.5))
    return kept.snapshot().select("key", "seq", "value")


@register(f"{LOG}, b AS (SELECT l.* FROM l WHERE seq < (SELECT (max(event_id) + 1) * 2 // 3 FROM events)) SELECT key, max(seq) AS seq, arg_max(coalesce(value, -1), seq) AS value FROM b GROUP BY key HAVING NOT arg_max(tombstone, seq)")
def store_fold_over_recover(spark, d):
    """Back to a fold-over checkpoint after a later batch and a compaction."""
    kept, stream, end = Store(spark, work_folder(spark, "store")), ops(spark, d).select("seq", "key", "op", "val"), cut(spark, d, 1.0)
    kept.apply(stream.where(F.col("seq") < end * 2 // 3))
    token = kept.checkpoint("foldover")
    kept.apply(stream.where(F.col("seq") >= end * 2 // 3))
    kept.compact()
    kept.recover(token)
    return kept.snapshot().select("key", "seq", "value")


@register("WITH RECURSIVE o AS (SELECT user_id AS key, event_id AS seq, event_type AS op, CAST(round(value * 100) AS BIGINT) AS val, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events WHERE event_type IN ('purchase', 'click', 'error')), "
    "r AS (SELECT 0::BIGINT AS i, key, NULL::BIGINT AS seq, NULL::VARCHAR AS op, NULL::VARCHAR AS status, NULL::BIGINT AS value, false AS touched FROM (SELECT DISTINCT key FROM o) UNION ALL SELECT o.i, o.key, o.seq, o.op, "
    "CASE o.op WHEN 'purchase' THEN 'Ok' WHEN 'error' THEN CASE WHEN r.touched THEN 'Ok' ELSE 'NotFound' END ELSE CASE WHEN r.value IS NULL THEN 'NotFound' WHEN r.value + o.val <= 20000 THEN 'Ok' ELSE 'Aborted' END END, "
    "CASE o.op WHEN 'purchase' THEN o.val WHEN 'error' THEN NULL ELSE CASE WHEN r.value + o.val <= 20000 THEN r.value + o.val ELSE r.value END END, r.touched OR o.op <> 'error' FROM r JOIN o ON o.key = r.key AND o.i = r.i + 1) "
    "SELECT seq, key, CASE op WHEN 'purchase' THEN 'upsert' WHEN 'click' THEN 'rmw' ELSE 'delete' END AS op, status, value FROM r WHERE i > 0"
)
def kv_rmw_abort(spark, d):
    """Read-modify-writes that abort where their sum would pass a limit."""
    stream = ops(spark, d).where(F.col("op").isin("upsert", "rmw", "delete"))
    return fold.fold_closure(stream, lambda value, val: value + val if value + val <= 20000 else None)


@register(f"{TIERS}, w AS (SELECT c_custkey AS key FROM customer) SELECT w.key, CASE WHEN h.key IS NOT NULL THEN h.value ELSE c.value END AS value, CASE WHEN h.key IS NOT NULL THEN 'hot' ELSE 'cold' END AS tier FROM w LEFT JOIN h ON h.key = w.key LEFT JOIN c ON c.key = w.key WHERE CASE WHEN h.key IS NOT NULL THEN NOT h.tombstone ELSE NOT c.tombstone END")
def tier_gated_read(spark, d):
    """Customers' keys, where the cold tier is read only for what its Bloom filter lets pass."""
    return tiering.gated_read(*tiers(spark, d), read_table(spark, d, "customer").select(F.col("c_custkey").alias("key")), 1 << 16, 7)


@register(f"{LOG}, t AS (SELECT l.*, CASE WHEN seq >= {HALF} THEN 'hot' ELSE 'cold' END AS tier FROM l), k AS (SELECT tier, key, NOT arg_max(tombstone, seq) AS live FROM t GROUP BY 1, 2) SELECT tier, count(*) AS records, count(*) * 24 AS size_bytes, min(seq) AS begin, max(seq) + 1 AS tail, (SELECT count(*) FILTER (live) FROM k WHERE k.tier = t.tier) AS live_keys FROM t GROUP BY tier")
def tier_sizes(spark, d):
    return tiering.tier_stats(*tiers(spark, d))


@register(f"{NEWEST}, a AS (SELECT key, count(*) AS accesses FROM e WHERE op IN ('read', 'rmw') GROUP BY key), g AS (SELECT n.*, NOT tombstone AND coalesce(accesses, 0) >= 27 AS stays FROM n LEFT JOIN a USING (key) WHERE seq < {THREE}) SELECT seq, key, value, tombstone FROM l WHERE seq >= {THREE} UNION ALL SELECT seq + (SELECT max(event_id) + 1 FROM events), key, value, tombstone FROM g WHERE stays")
def tier_keep_hot(spark, d):
    return tiering.keep_hot(log_once(spark, d), ops(spark, d), cut(spark, d, 0.75), cut(spark, d, 1.0), 27)[0].select("seq", "key", "value", "tombstone")


@register("WITH k AS (SELECT DISTINCT o_orderkey AS key FROM orders), b AS (SELECT key % 128 AS b, count(*) AS n, count(*) FILTER (key % 64 <> key % 128) AS moved FROM k GROUP BY 1) SELECT 64::BIGINT AS old_size, 128::BIGINT AS new_size, sum(n)::BIGINT AS entries_migrated, sum(moved)::BIGINT AS entries_moved, count(*) FILTER (n > 7) AS overflow_buckets, 2.0::DOUBLE AS growth_ratio FROM b")
def index_grow(spark, d):
    return stats.grow_result(read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key")), 64, 128)


@register(f"{MARKED}, s AS (SELECT m.*, e.op FROM m JOIN e USING (seq)) SELECT count(*) AS records_allocated, count(*) * 24 AS bytes_allocated, count(*) FILTER (seq >= {HALF}) * 24 AS bytes_in_memory, count(*) FILTER (seq < {HALF} AND seq >= {QUARTER}) * 24 AS bytes_on_disk, count(*) FILTER (seq < {QUARTER}) * 24 AS bytes_reclaimable, count(*) FILTER (op = 'delete') AS tombstones, count(*) FILTER (invalid) AS invalid_records FROM s")
def log_stats(spark, d):
    return stats.log_stats(marked(spark, d), cut(spark, d, 0.25), cut(spark, d, 0.5))


@register("SELECT doc_id AS key, strlen(text)::BIGINT + 8 AS payload_bytes, strlen(text)::BIGINT + 12 AS stored_bytes, doc_id AS metadata, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def span_round_trip(spark, d):
    """Texts with their ids as metadata, written as spans and read back."""
    docs = read_table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("key"), scalars.span_bytes(scalars.span(F.col("text"), F.col("doc_id"))).alias("stored"))
    back = docs.withColumn("value", scalars.span_of_bytes(F.col("stored")))
    return back.select("key", scalars.span_length(F.col("value")).cast("long").alias("payload_bytes"), F.octet_length("stored").cast("long").alias("stored_bytes"), F.col("value.metadata").alias("metadata"), F.md5("value.payload").alias("digest"))


@register(f"{FOLD} SELECT seq, key, op, status, value FROM v")
def streaming_store(spark, d):
    """The operations as a stream through the stateful store, each with its status and value."""
    folder, stream = work_folder(spark, "stream"), op_stream(store.read_stream(spark, f"{d}/events.parquet"))
    store.append_log(store.run_store(stream.select("seq", "key", "op", "val")), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("seq", "key", "op", "status", "value")
