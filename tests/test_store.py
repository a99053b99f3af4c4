"""The store's operators against a plain dictionary, and what must hold between them."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest import schema
from palimpsest.functions import scalars
from palimpsest.operators import bytelog, checkpoint, compaction, fold, scan, snapshot, stats, tiering
from palimpsest.streaming import store

#: Shares of the random operations, in percent.
MIX = {"read": 25, "upsert": 35, "delete": 15, "rmw": 15, "conditional_insert": 10}


def random_ops(n=3000, keys=40, seed=5):
    rng = random.Random(seed)
    return [(i, rng.randrange(keys), rng.choices(list(MIX), MIX.values())[0], rng.randrange(1000), rng.randrange(4)) for i in range(n)]


def model(rows):
    """(seq, status, value) of each operation, applied one by one."""
    live, touched, out = {}, set(), []
    for seq, key, op, val, _ in rows:
        status = "Ok"
        if op == "upsert":
            live[key] = val
        elif op == "conditional_insert":
            if key in live:
                status = "Aborted"
            else:
                live[key] = val
        elif op == "rmw":
            if key in live:
                live[key] += val
            else:
                status = "NotFound"
        elif op == "delete":
            status = "Ok" if key in touched else "NotFound"
            live.pop(key, None)
        if op in ("upsert", "conditional_insert", "rmw"):
            touched.add(key)
        out.append((seq, status, live.get(key)))
    return out, live


@pytest.fixture(scope="module")
def rows():
    return random_ops()


@pytest.fixture(scope="module")
def stream(spark, rows):
    return spark.createDataFrame(rows, "seq long, key long, op string, val long, session long").repartition(5)


@pytest.fixture(scope="module")
def log(stream):
    return fold.to_log(fold.fold(stream)).cache()


def live(df):
    return {r.key: r.value for r in df.select("key", "value").collect()}


def test_fold_is_the_model(stream, rows):
    out, _ = model(rows)
    assert [tuple(r) for r in fold.fold(stream).orderBy("seq").select("seq", "status", "value").collect()] == out
    assert "Exchange" in fold.fold(stream)._jdf.queryExecution().executedPlan().toString()


def test_snapshot_cut_and_chain(spark, log, rows, tmp_path):
    _, want = model(rows)
    assert live(snapshot.latest(log)) == want
    for cut in (0, 700, 1500, 3000):
        assert live(snapshot.as_of(log, cut)) == model(rows[:cut])[1]
    kept = checkpoint.CheckpointStore(spark, str(tmp_path / "ckpt"))
    seen = []
    kept.on_complete(lambda m: seen.append(m["kind"]))
    tokens = [kept.incremental(log, c, {"0": c}) for c in (700, 1500, 3000)]
    assert seen == ["full", "incremental", "incremental"]
    for token, c in zip(tokens, (700, 1500, 3000), strict=True):
        state, manifest = kept.recover(token)
        assert live(state) == model(rows[:c])[1] and manifest["sessions"] == {"0": c}
    assert checkpoint.newest(kept.table()).first().token == tokens[-1] and all(r.continues for r in checkpoint.check_chain(kept.table()).collect())
    kept.index_only(log, 1500)
    kept.log_only(log, 100, 200)
    assert kept.self_check() == {"partial": [], "broken": []}
    (tmp_path / "ckpt" / tokens[1] / "manifest.json").unlink()
    assert kept.self_check()["partial"] == [tokens[1]] and kept.self_check()["broken"] == [tokens[2]]
    with pytest.raises(ValueError):
        kept.recover(tokens[2])
    kept.self_check(repair=True)
    assert live(kept.recover()[0]) == model(rows[:700])[1]


def test_compaction_keeps_the_state(log, rows):
    _, want = model(rows)
    for until in (0, 1000, 3000, 5000):
        out = compaction.compact(log, until)
        assert live(snapshot.latest(out)) == want
        assert live(snapshot.latest(compaction.copy_to_tail(log, until, 3000))) == want
    full = compaction.compact(log, 5000)
    assert full.count() == len(want)
    row = compaction.compaction_stats(log, 0, 5000).first()
    assert row.records_scanned == row.records_compacted + row.records_skipped + row.tombstones_found and row.records_compacted == len(want)
    policy = compaction.CompactionPolicy(0.5, 100, 1000)
    assert policy.range(0, 50) is None and policy.range(10, 5000) == (10, 1010) and policy.due(log)
    auto = compaction.AutoCompactor(policy, per_hour=1)
    assert auto.tick(log, 10, 0.0) is not None and auto.tick(log, 10, 60.0) is None and auto.tick(log, 10, 4000.0) is not None
    auto.pause()
    assert auto.tick(log, 10, 9999.0) is None


def test_tiers_are_one_store(log, rows):
    _, want = model(rows)
    hot, cold = log.where("seq >= 1500"), log.where("seq < 1500")
    assert live(tiering.tier_read(hot, cold)) == want
    aged = {r.key: r for r in tiering.migrate_by_age(log, 1500).collect()}
    assert all(r.goes_cold == (r.seq < 1500) for r in aged.values())
    assert {k: v for k, v in live(tiering.compact_cold(cold, 0)).items()} == model(rows[:1500])[1]
    assert tiering.should_compact(95, 100) and not tiering.should_compact(80, 100) and tiering.compact_until(0, 100) == 20


def test_marked_records_and_scans(spark):
    data = [(0, 1, 10, False, False), (1, 1, 11, False, True), (2, 2, None, True, False), (3, 3, None, False, False)]
    log = spark.createDataFrame(data, "seq long, key long, value long, tombstone boolean, invalid boolean")
    assert live(snapshot.latest(log)) == {1: 10, 3: None}  # null is a value, a tombstone is none
    assert {r.key for r in snapshot.raw_latest(log).collect()} == {1, 2, 3}
    assert scan.scan_range(log, 3, 1).count() == 0 and scan.scan_range(log, 0, 2).count() == 1
    assert [r.seq for r in scan.scan_until(log, 2).collect()] == [0, 2]
    assert tuple(snapshot.size(log).first()) == (3, 2)
    keys = spark.createDataFrame([(1,), (2,), (9,)], "key long")
    assert live(snapshot.multi_read(log, keys)) == {1: 10, 2: None, 9: None}
    assert live(snapshot.point_read(log, 1)) == {1: 10} and live(snapshot.point_read(log, 2)) == {}
    assert schema.check_log(log.withColumn("op", F.lit("upsert"))) == {"null_seq": 0, "null_key": 0, "unknown_op": 0, "tombstone_value": 0, "repeated_seq": 0}
    empty = log.where("false")
    assert live(snapshot.latest(empty)) == {} and compaction.compact(empty, 5).count() == 0 and compaction.utilization(empty).first().utilization == 1.0


def test_ordered_fold(spark, stream):
    last = fold.fold_ordered(stream, lambda a, x: F.when(x.op == "upsert", x.val).otherwise(a), F.lit(None).cast("long"))
    want = {}
    for _, key, op, val, _ in random_ops():
        if op == "upsert":
            want[key] = val
    assert {k: v for k, v in live(last).items() if v is not None} == want


def test_sessions(spark, stream):
    states = checkpoint.session_states(fold.serials(stream), 1500)
    assert checkpoint.check_sessions(states, 4) == [] and checkpoint.check_sessions(states, 5)
    twice = states.union(states)
    assert "a session is listed twice" in checkpoint.check_sessions(twice)
    rest = checkpoint.resume(fold.serials(stream), states)
    assert rest.where("status = 'Ok' and op != 'read'").agg(F.min("seq")).first()[0] >= 1500


def test_byte_log(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(300)], "n long, body string")
    log = bytelog.ByteLog(spark, str(tmp_path / "log"))
    log.append(rows, ["n"], "body")
    assert log.scan_all().count() == 0  # not committed
    end = log.commit()
    assert log.scan_all().count() == 294 and end == sum(16 + -(-(i % 50) // 8) * 8 for i in range(300) if i % 50)
    again = bytelog.ByteLog(spark, str(tmp_path / "log"))
    again.append(rows, ["n"], "body")
    again.commit()
    assert again.scan_all().select("addr").distinct().count() == 588
    assert tuple(bytelog.self_check(again.scan_all(), "payload").first()) == (588, 0, None)
    again.truncate(end)
    assert again.scan_all().agg(F.min("addr")).first()[0] == end
    with pytest.raises(ValueError):
        again.truncate(10 * end)
    again.close()
    with pytest.raises(RuntimeError):
        again.append(rows, ["n"], "body")
    assert bytelog.reclaimable(100, 9000, 4096) == 8192


def compat(data):
    state = len(data)
    for b in data:
        state = (state * 40343 + b) % 2**64
    state = state * 40343 % 2**64
    state = (state >> 6) | (state << 58) % 2**64
    return state - 2**64 if state >= 2**63 else state


def test_functions(spark):
    words = ["", "a", "hello", "0123456789abcdef", "é中"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = [tuple(r) for r in df.select(scalars.compat_hash_bytes(F.col("w")), scalars.xor_checksum(F.col("w"))).collect()]
    for w, (h, x) in zip(words, got, strict=True):
        data = w.encode()
        padded = data + bytes(-len(data) % 8)
        want = 0
        for i in range(0, len(padded), 8):
            want ^= int.from_bytes(padded[i : i + 8], "little", signed=True)
        assert (h, x) == (compat(data), want)
    span = df.select(scalars.span(F.col("w"), F.lit(7)).alias("s"))
    assert [r[0] for r in span.select(scalars.span_length(F.col("s"))).collect()] == [len(w.encode()) + 8 for w in words]
    assert span.select(scalars.span_header(F.col("s"))).first()[0] == (1 << 30) + 8
    assert [r[0] for r in span.select(scalars.span_text(F.col("s"))).collect()] == words


def test_reports(spark, stream):
    one = stats.op_stats(fold.fold(stream))
    for form in ("json", "csv", "text", "prometheus"):
        assert str(one.first().total_ops) in stats.report(one, form).first().report
    with pytest.raises(ValueError):
        stats.report(one, "xml")
    with pytest.raises(ValueError):
        stats.bucket(F.col("key"), 100)


def test_stateful_stream(spark, rows, stream, tmp_path):
    source = str(tmp_path / "in")
    for i in range(3):
        stream.where(F.col("seq").between(i * 1000, i * 1000 + 999)).coalesce(1).write.mode("append").parquet(source)
    read = spark.readStream.schema(stream.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = store.run_store(read).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").select("seq", "status", "value").collect()]
    assert got == model(rows)[0]


def test_conditional_insert_repeated_keys(spark):
    log = spark.createDataFrame([(1, 1, 10, False, False), (2, 2, 20, False, False), (3, 2, None, True, False)], "seq long, key long, value long, tombstone boolean, invalid boolean")
    batch = spark.createDataFrame([(5, 1, 1), (5, 2, 2), (1, 3, 3), (2, 4, 4), (2, 5, 5)], "key long, value long, seq long")
    assert sorted(map(tuple, snapshot.conditional_insert(log, batch).collect())) == [(2, 4, 4), (5, 1, 1)]
    status = {r.seq: r.status for r in snapshot.conditional_insert_status(log, batch).collect()}
    assert status == {1: "Ok", 2: "Aborted", 3: "Aborted", 4: "Ok", 5: "Aborted"}
    assert sorted(map(tuple, snapshot.conditional_insert(log, batch.select("key", "value")).collect())) == [(2, 4), (5, 1)]


def test_bytelog_crash_between_manifests(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda a, z: spark.range(a, z).selectExpr("id", "cast(concat('p', id) as string) payload")
    log = bytelog.ByteLog(spark, path)
    log.append(rows(0, 5), ["id"], "payload")
    log.commit()
    (tmp_path / "log" / "manifest-000000000002.json").write_bytes(b'{"format_ver')  # a commit that broke off
    again = bytelog.ByteLog(spark, path)
    assert again.scan_all().count() == 5 and again.stats()["committed"] == log.state["committed"]
    again.append(rows(5, 7), ["id"], "payload")  # never committed
    last = bytelog.ByteLog(spark, path)
    assert last.scan_all().count() == 5


def test_bytelog_damage_is_found_and_cut(spark, tmp_path):
    import pyspark.sql.functions as F

    path = str(tmp_path / "log")
    log = bytelog.ByteLog(spark, path)
    log.append(spark.range(20).selectExpr("id", "concat('payload ', id) payload"), ["id"], "payload")
    log.commit()
    part = f"{path}/{log.state['parts'][0]['name']}"
    bad = spark.read.parquet(part).withColumn("payload", F.when(F.col("addr") == 320, F.lit(b"other")).otherwise(F.col("payload")))
    bad.write.parquet(f"{path}/copy")
    import shutil

    shutil.rmtree(part)
    shutil.move(f"{path}/copy", part)
    with pytest.raises(ValueError, match="damaged"):
        bytelog.ByteLog(spark, path, check=True)
    mended = bytelog.ByteLog(spark, path, repair=True)
    assert mended.stats()["tail"] == 320 and mended.scan_all().agg(F.max("addr")).first()[0] < 320
    mended.append(spark.range(3).selectExpr("id", "concat('new ', id) payload"), ["id"], "payload")
    mended.commit()
    assert {bytes(r.payload) for r in mended.scan_all().where("addr >= 320").collect()} == {b"new 0", b"new 1", b"new 2"}
    mended.truncate_until(10**9)
    assert mended.scan_all().count() == 0


def test_checkpoint_kinds_recover(spark, tmp_path):
    log = spark.createDataFrame([(1, 1, 10, False, False), (2, 2, 20, False, False), (3, 1, 11, False, False), (4, 2, None, True, False), (5, 3, 30, False, False)], "seq long, key long, value long, tombstone boolean, invalid boolean")
    store = checkpoint.CheckpointStore(spark, str(tmp_path / "c"))
    with pytest.raises(LookupError):
        store.recover()
    part, index, full = store.log_only(log, 2, 5), store.index_only(log, 4), store.full(log, 6)
    assert [m["version"] for m in store.manifests()] == [1, 2, 3]
    records, m = store.recover_log_only()
    assert sorted(r.seq for r in records.collect()) == [2, 3, 4] and m["token"] == part
    live, m = store.recover_index_only(log)
    assert sorted((r.key, r.value) for r in live.collect()) == [(1, 11), (3, 30)] and m["token"] == index
    assert sorted((r.key, r.value) for r in store.recover()[0].collect()) == [(1, 11), (3, 30)]
    with pytest.raises(ValueError, match="of kind"):
        store.recover_log_only(full)
    assert store.verify(full) and store.self_check(data=True) == {"partial": [], "broken": []}
    store.data(full).limit(1).coalesce(1).write.mode("append").parquet(f"{store.path}/{full}/data")
    assert store.self_check(data=True)["broken"] == [full]


def test_serials_over_stretches(spark):
    stream = spark.range(3000).selectExpr("id seq", "id % 7 key", "case when id % 5 = 0 then 'read' else 'upsert' end op", "id val", "cast(0 as long) session")
    got = {r.seq: r.serial for r in fold.serials(stream, stride=100).collect()}
    n, want = 0, {}
    for i in range(3000):
        n += i % 5 != 0
        want[i] = n
    assert got == want
