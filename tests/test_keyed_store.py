"""The store object: batches, sessions, cache, compaction, checkpoints, configuration."""

import math

import pytest
from pyspark.sql import functions as F

from palimpsest import config
from palimpsest.functions import scalars
from palimpsest.operators import bloom, bytelog, checkpoint, compaction, fold, scan, stats, tiering
from palimpsest.store import SessionState, Store

from .test_store import model, random_ops

COLUMNS = "seq long, key long, op string, val long"


@pytest.fixture(scope="module")
def rows():
    return random_ops(600, 25, 8)


def frame(spark, rows):
    return spark.createDataFrame([r[:4] for r in rows], COLUMNS).repartition(3)


def live(store):
    return {r.key: r.value for r in store.snapshot().collect()}


def test_batches_are_one_stream(spark, tmp_path, rows):
    """Statuses and values of batches, with a reopened store between them, are those of the whole stream."""
    want, last = model(rows)
    got = []
    for a in range(0, 600, 150):
        with Store(spark, f"{tmp_path}/s").session().guid("a").build() as session:
            got += [(r.seq, r.status, r.value) for r in session.apply(frame(spark, rows[a : a + 150])).collect()]
    store = Store(spark, f"{tmp_path}/s")
    assert sorted(got) == want
    assert live(store) == {k: v for k, v in last.items() if v is not None}
    done = sum(s == "Ok" and r[2] != "read" for r, (_, s, _) in zip(rows, want, strict=True))
    assert store.sessions == {"a": done} and store.tail == 600
    assert store.stats().first().total_ops == 600
    assert store.stats("sessions").first().completed == sum(s == "Ok" for _, s, _ in want)
    assert store.stats("index").first().used_entries == len({r.key for r in store.log().collect()})


def test_refuses_odd_batches(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    for bad in ([(1, None, "upsert", 1)], [(1, 1, "upsert", 1), (1, 2, "upsert", 1)], [(1, 1, "swap", 1)], [(1, 1, None, 1)], [(None, 1, "upsert", 1)]):
        with pytest.raises(ValueError):
            store.apply(spark.createDataFrame(bad, COLUMNS))
    assert store.apply(spark.createDataFrame([], COLUMNS)).count() == 0
    assert store.tail == 0 and live(store) == {}


def test_sessions(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    session = store.session().guid("x").thread_id(3).build()
    with pytest.raises(RuntimeError):
        session.apply(spark.createDataFrame([(0, 1, "upsert", 5)], COLUMNS))
    session.start().apply(spark.createDataFrame([(0, 1, "upsert", 5), (1, 1, "read", None), (2, 2, "rmw", 1)], COLUMNS))
    state = session.end()
    assert state == SessionState("x", 1, 3) and not session.active
    again = store.session().from_state(state).build().start()
    again.apply(spark.createDataFrame([(0, 2, "delete", None)], COLUMNS))  # touched by the failed rmw
    assert again.state().serial == 2 == store.sessions["x"]
    with pytest.raises(ValueError):
        store.session().from_state(SessionState("y", -1))


def test_compaction_truncation_and_other_store(spark, tmp_path, rows):
    store = Store(spark, f"{tmp_path}/s")
    store.apply(frame(spark, rows))
    before = live(store)
    other = Store(spark, f"{tmp_path}/o")
    assert store.compact_to(other) == len(before) and live(other) == before
    n = store.log().count()
    found = store.compact(300)
    assert found["records_scanned"] > 0 and store.log().count() < n and live(store) == before
    store.compact()
    assert store.log().count() == len(before) and live(store) == before
    called = []
    low = min(r.seq for r in store.log().collect())
    store.truncate(low + 1, [lambda b: called.append(("before", b))], [lambda b: called.append(("after", b))])
    assert called == [("before", low + 1), ("after", low + 1)] and len(live(store)) == len(before) - 1
    with pytest.raises(ZeroDivisionError):
        store.truncate(store.tail, [lambda b: 1 / 0])
    assert store.begin == low + 1


@pytest.mark.parametrize("kind", ["full", "incremental", "foldover", "index", "log"])
def test_checkpoints(spark, tmp_path, rows, kind):
    store = Store(spark, f"{tmp_path}/s")
    with store.session().guid("a").build() as session:
        session.apply(frame(spark, rows[:200]))
        if kind == "incremental":
            store.checkpoint("full")
        session.apply(frame(spark, rows[200:400]))
        want, serial = live(store), store.sessions["a"]
        token = store.checkpoint(kind)
        assert store.checkpoints.info(token)["kind"] == kind and store.checkpoints.problems(token) == []
        session.apply(frame(spark, rows[400:]))
    assert live(store) != want
    store.compact()  # parts that a checkpoint names stay
    store.recover(token)
    assert live(Store(spark, f"{tmp_path}/s")) == want and store.sessions["a"] == serial and store.tail == 400
    store.apply(frame(spark, rows[400:]))
    now = live(store)
    later = store.checkpoint("incremental")
    store.apply(spark.createDataFrame([(0, 1, "upsert", -7)], COLUMNS))
    store.recover(later)
    assert live(store) == now
    assert store.stats("events").first().recovery_completed == 2
    assert store.checkpoints.self_check(data=True) == {"partial": [], "broken": []}


def test_incremental_after_compaction_is_full(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.apply(spark.createDataFrame([(0, 1, "upsert", 5), (1, 2, "upsert", 6)], COLUMNS))
    store.checkpoint("full")
    store.apply(spark.createDataFrame([(0, 1, "delete", None)], COLUMNS))
    store.compact()  # the tombstone goes
    token = store.checkpoint("incremental")
    store.recover(token)
    assert store.checkpoints.info(token)["kind"] == "full" and live(store) == {2: 6}


def test_damaged_checkpoint_files(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s")
    store.apply(spark.createDataFrame([(0, 1, "upsert", 5)], COLUMNS))
    token = store.checkpoint()
    file = next((tmp_path / "s/_checkpoints" / token / "data").glob("part-*.parquet"))
    file.write_bytes(file.read_bytes() + b"x")
    assert len(store.checkpoints.problems(token)) == 1
    file.unlink()
    assert "is missing" in store.checkpoints.problems(token)[0]
    assert store.checkpoints.self_check()["broken"] == [token]


def test_read_cache(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/s", config.load(env={"PALIMPSEST__CACHE__ENABLED": "true", "PALIMPSEST__cache__mem_size": str(3 * compaction.RECORD_BYTES)}))
    store.apply(spark.createDataFrame([(i, i, "upsert", 10 * i) for i in range(6)], COLUMNS))
    ask = lambda *keys: sorted(tuple(r) for r in store.read(spark.createDataFrame([(k,) for k in keys], "key long")).collect())
    assert ask(0, 1, 9) == [(0, 0), (1, 10)]
    assert ask(1, 2) == [(1, 10), (2, 20)]
    assert store.cache.stats() == {"calls": 5, "hits": 1, "misses": 4, "inserts": 3, "evictions": 0, "invalidations": 0, "hit_rate": 0.2, "records": 3}
    store.apply(spark.createDataFrame([(0, 1, "upsert", 77)], COLUMNS))
    assert ask(1) == [(1, 77)] and store.cache.counts["invalidations"] == 1
    assert ask(3, 4, None) == [(3, 30), (4, 40)] and store.cache.counts["evictions"] > 0
    store.cache.clear()
    assert store.cache.stats()["records"] == 0


def test_config(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text('[store]\ntable_size = 2048\npage_size_bits = 12\n[checkpoint]\nbackend = "foldover"\n')
    c = config.load(str(path), {"PALIMPSEST__store__table_size": "4096", "OTHER": "1"})
    assert (c.store.table_size, c.store.page_size_bits, c.checkpoint.backend) == (4096, 12, "foldover")
    for env in ({"store__table_size": "1000"}, {"store__page_size_bits": "9"}, {"store__mutable_fraction": "nan"}, {"store__log_memory_size": "1024"}, {"store__nothing": "1"}, {"no__table_size": "1"}, {"cache__enabled": "maybe"}, {"store__table_size": "x"}, {"checkpoint__backend": "tape"}):
        with pytest.raises(ValueError):
            config.load(env={f"PALIMPSEST__{k}": v for k, v in env.items()})
    path.write_text("[store]\ntable_size = 2.5\n")
    with pytest.raises(ValueError):
        config.load(str(path), {})


def test_closure_may_abort(spark):
    rows = [(i, k, op, v, 0) for i, (k, op, v) in enumerate([(1, "rmw", 1), (1, "upsert", 5), (1, "rmw", 4), (1, "rmw", 9), (1, "rmw", None), (1, "delete", None), (1, "rmw", 1), (2, "delete", 0), (2, "conditional_insert", 3), (2, "conditional_insert", 4), (None, "upsert", 2), (2, "read", None)])]
    stream = spark.createDataFrame(rows, "seq long, key long, op string, val long, session long").repartition(4)
    out = fold.fold_closure(stream, lambda value, val: value + val if value + val <= 10 else None)
    assert [(r.status, r.value) for r in sorted(out.collect(), key=lambda r: r.seq)] == [
        ("NotFound", None), ("Ok", 5), ("Ok", 9), ("Aborted", 9), ("Aborted", 9), ("Ok", None), ("NotFound", None), ("NotFound", None), ("Ok", 3), ("Aborted", 3), ("Ok", 2), ("Ok", 3),
    ]
    whole = spark.createDataFrame(random_ops(), "seq long, key long, op string, val long, session long").repartition(5)
    got = sorted((r.seq, r.status, r.value) for r in fold.fold_closure(whole, lambda value, val: value + val).collect())
    assert got == model(random_ops())[0]


def test_bloom(spark):
    functions, bits = bloom.hashes(10), 10 * 2000
    keys = spark.range(0, 4000, 2).withColumnRenamed("id", "key")
    out = {r.key: r.maybe for r in bloom.might_contain(spark.range(4000).withColumnRenamed("id", "key"), bloom.build(keys, bits, functions), bits, functions).collect()}
    assert functions == 7 and all(out[k] for k in range(0, 4000, 2))
    wrong = sum(out[k] for k in range(1, 4000, 2)) / 2000
    assert abs(wrong - bloom.false_positive_rate(bits, 2000, functions)) < 0.02
    empty = bloom.build(keys.where("false"), bits, functions)
    assert not any(r.maybe for r in bloom.might_contain(keys.unionByName(spark.createDataFrame([(None,)], "key long")), empty, bits, functions).collect())


def test_tiers(spark, tmp_path):
    columns = "seq long, key long, value long, tombstone boolean, invalid boolean"
    cold = spark.createDataFrame([(0, 1, 10, False, False), (1, 2, 20, False, False), (2, 3, 30, False, False), (3, 3, None, True, False)], columns)
    hot = spark.createDataFrame([(4, 1, None, True, False), (5, 4, 40, False, False)], columns)
    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 4, 5, 2)], "key long")
    assert sorted(map(tuple, tiering.gated_read(hot, cold, keys, 1024, 7).collect())) == [(2, 20, "cold"), (4, 40, "hot")]
    assert sorted(map(tuple, tiering.tier_stats(hot, cold).collect())) == [("cold", 4, 96, 0, 4, 2), ("hot", 2, 48, 4, 6, 1)]
    stream = spark.createDataFrame([(0, 2, "read")] * 3 + [(0, 4, "read")], "seq long, key long, op string")
    stay, go = tiering.keep_hot(cold.unionByName(hot), stream, 5, 100, 2)
    assert sorted((r.seq, r.key) for r in stay.collect()) == [(5, 4), (101, 2)]
    assert sorted((r.key, r.tombstone) for r in go.collect()) == [(1, True), (3, True)]


def test_scan_each(spark):
    log = spark.range(100).select(F.col("id").alias("seq"), (F.col("id") % 10 == 0).alias("invalid")).repartition(4)
    assert scan.scan_each(log, lambda r: None) == 90
    assert scan.scan_each(log.coalesce(1), lambda r: False) == 1
    assert scan.scan_each(log.where("false"), lambda r: None) == 0


def test_spans_and_hashes(spark):
    rows = [(b"", None), (b"abc", 5), (b"\x00\xff", -1), (None, None), (b"x" * 100, 1 << 62)]
    df = spark.createDataFrame(rows, "p binary, m long").select("p", "m", scalars.span(F.col("p"), F.col("m")).alias("s"))
    for r in df.select("p", "m", scalars.span_of_bytes(scalars.span_bytes(F.col("s"))).alias("t"), scalars.span_bytes(F.col("s")).alias("b")).collect():
        if r.p is None:
            assert r.b is None and r.t is None
        else:
            assert (r.t.payload, r.t.metadata) == (r.p, r.m)
            size = len(r.p) + 8 * (r.m is not None)
            assert r.b[:4] == (size | (1 << 30) * (r.m is not None)).to_bytes(4, "little")
    short = spark.createDataFrame([(b"\x05\x00\x00\x00abc",), (b"\x05",), (b"",)], "b binary")
    assert all(r.t is None for r in short.select(scalars.span_of_bytes(F.col("b")).alias("t")).collect())
    cut = df.where("p = X'616263'").select(scalars.span_with_length(F.col("s"), 2).alias("a"), scalars.span_with_length(F.col("s"), 5).alias("b"), scalars.span_with_metadata(F.col("s"), None).alias("c")).first()
    assert (cut.a.payload, cut.b.payload, cut.c.metadata) == (b"ab", b"abc\x00\x00", None)
    both = df.where("p is null or m = 5").select(scalars.span_equals(F.col("s"), F.col("s")).alias("same"), scalars.span_hash(F.col("s"), "xxh64").alias("h")).collect()
    assert all(r.same for r in both) and len({r.h for r in both}) == 2
    text = spark.createDataFrame([("",), (None,)], "t string").select(*[scalars.hash64(F.col("t"), n).alias(n) for n in ("XXH3", "xxhash64", "compat")]).collect()
    # Published values for no bytes.
    assert (text[0][0] % 2**64, text[0][1] % 2**64) == (0x2D06800538D394C2, 0xEF46DB3751D8E999)
    assert text[1][0] is None and text[1][1] is None
    with pytest.raises(ValueError):
        scalars.hash_name("md5")


def test_growth_log_stats_and_compact_report(spark):
    keys = spark.range(100).withColumnRenamed("id", "key")
    row = stats.grow_result(keys.union(keys), 16, 32).first()
    assert (row.entries_migrated, row.entries_moved, row.overflow_buckets, row.growth_ratio) == (100, 48, 0, 2.0)
    log = spark.range(10).select(F.col("id").alias("seq"), F.lit(False).alias("invalid"), (F.col("id") == 3).alias("tombstone"))
    assert tuple(stats.log_stats(log, 2, 6).first()) == (10, 240, 96, 96, 48, 1, 0)
    assert stats.report(stats.log_stats(log, 2, 6).select("tombstones", F.lit(None).alias("x")), "compact").first()[0] == "tombstones=1 x=-"


def test_inspect(spark, tmp_path):
    path = f"{tmp_path}/log"
    assert bytelog.inspect(spark, path) == {"valid": False}
    log = bytelog.ByteLog(spark, path)
    log.append(spark.createDataFrame([(i, "abc") for i in range(5)], "i long, t string"), ["i"], "t")
    log.commit()
    found = bytelog.inspect(spark, path)
    assert found["valid"] and found["check"]["entries"] == 5 and found["stats"]["committed"] == 5 * 24


def test_store_config_is_checked(spark, tmp_path):
    with pytest.raises(ValueError):
        Store(spark, f"{tmp_path}/s", config.Config(store=config.StoreSection(mutable_fraction=math.nan)))
    store = Store(spark, f"{tmp_path}/s", config.Config(store=config.StoreSection(table_size=16)))
    store.apply(spark.createDataFrame([(i, i, "upsert", 1) for i in range(40)], COLUMNS))
    assert store.grow(64).first().entries_migrated == 40 and store.config.store.table_size == 64
    assert store.info()["over_memory"] is False and store.tick(0.0) is None
    with pytest.raises(ValueError):
        store.grow(32)


def test_tier_worker(spark, tmp_path, rows):
    log = fold.to_log(fold.fold(spark.createDataFrame(rows, "seq long, key long, op string, val long, session long"))).cache()
    hot, cold = log.where("seq >= 300"), log.where("seq < 300")
    read = lambda h, c: sorted(map(repr, tiering.tier_read(h, c).select("key", "value").collect()))
    want = read(hot, cold)
    store = checkpoint.CheckpointStore(spark, f"{tmp_path}/c")
    worker = tiering.TierWorker(1000, 1000, checkpoints=store)
    worker.request_checkpoint()
    hot2, cold2, done = worker.tick(hot, cold)
    begin, last = log.where("seq >= 300").agg(F.min("seq"), F.max("seq")).first()
    assert [d.split()[0] for d in done] == ["checkpoint", "hot", "cold"] and done[1] == f"hot until {begin + int((last + 1 - begin) * 0.2)}"
    assert read(hot2, cold2) == want and hot2.count() < hot.count() and cold2.count() <= 25
    kept_hot, kept_cold, _ = store.recover_tiers()
    assert read(kept_hot, kept_cold) == want
    assert tiering.TierWorker(1 << 30, 1 << 30).tick(hot, cold)[2] == []
    assert tiering.TierWorker(1, 1).tick(hot.where("false"), cold.where("false"))[2] == []
    with pytest.raises(ValueError):
        tiering.TierWorker(1, 1).request_checkpoint()
