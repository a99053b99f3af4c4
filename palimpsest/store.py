"""A keyed store over a folder: batches of operations by session, reads, compaction, checkpoints, statistics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .operators import compaction, fold, scan, snapshot, stats
from .operators.checkpoint import CheckpointStore
from .schema import MAX_SESSIONS, OK
from .sources.manifest import Manifests

FORMAT = 1
RECORD = "seq long, key {key}, op string, val long, session string, status string, value long, tombstone boolean, invalid boolean"


@dataclass(frozen=True)
class SessionState:
    """What a session needs to go on elsewhere."""

    guid: str
    serial: int = 0
    thread_id: int | None = None


class Session:
    """A named sequence of batches; its serial counts the mutations that succeeded."""

    def __init__(self, store: Store, state: SessionState):
        self.store, self.guid, self.thread_id, self.serial = store, state.guid, state.thread_id, state.serial
        self.active = False

    def start(self) -> Session:
        """Register with the store; an error beyond the number of sessions that a checkpoint holds."""
        if self.guid not in self.store.sessions and len(self.store.sessions) >= MAX_SESSIONS:
            raise RuntimeError(f"{MAX_SESSIONS} sessions exist")
        self.serial = max(self.serial, self.store.sessions.get(self.guid, 0))
        self.store.sessions[self.guid] = self.serial
        self.active = True
        return self

    def end(self) -> SessionState:
        self.active = False
        return self.state()

    def state(self) -> SessionState:
        return SessionState(self.guid, self.serial, self.thread_id)

    @property
    def version(self) -> int:
        """The store's version that this session sees."""
        return self.store.version

    def apply(self, batch: DataFrame) -> DataFrame:
        """:meth:`Store.apply` under this session's name; an error unless it is started."""
        if not self.active:
            raise RuntimeError("the session is not started")
        out, done = self.store._apply(batch, self.guid)
        self.serial += done
        return out

    def __enter__(self) -> Session:
        return self.start()

    def __exit__(self, *_) -> None:
        self.end()


class SessionBuilder:
    """Sessions with a chosen name, thread or state."""

    def __init__(self, store: Store):
        self._store, self._state = store, SessionState(uuid.uuid4().hex)

    def guid(self, guid: str) -> SessionBuilder:
        self._state = SessionState(guid, self._state.serial, self._state.thread_id)
        return self

    def thread_id(self, thread_id: int) -> SessionBuilder:
        self._state = SessionState(self._state.guid, self._state.serial, thread_id)
        return self

    def from_state(self, state: SessionState) -> SessionBuilder:
        """Go on where ``state`` ended; ValueError for a negative serial."""
        if state.serial < 0:
            raise ValueError("the serial is negative")
        self._state = state
        return self

    def build(self) -> Session:
        return Session(self._store, self._state)


class ReadCache:
    """Records read from the log, kept by Spark in regions of one lookup each; the oldest region goes first.

    A region is a persisted table, so it is spread over the executors and a lost one is read again.
    Plans stay short: there are at most ``REGIONS``, and one that was cut by ``CUTS`` writes goes.
    """

    REGIONS, CUTS = 16, 8

    def __init__(self, store: Store, max_bytes: int):
        self.store, self.max_bytes, self.regions = store, max_bytes, []
        self.counts = dict.fromkeys(("calls", "hits", "misses", "inserts", "evictions", "invalidations"), 0)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the live ones of ``keys``; what the cache lacks is read from the log and kept."""
        wanted = keys.select("key").where(F.col("key").isNotNull()).distinct().persist()
        cached = self._all()
        hit = wanted.join(cached, "key") if cached is not None else None
        missing = wanted if cached is None else wanted.join(cached, "key", "left_anti")
        region = snapshot.latest(self.store.log().join(missing, "key", "left_semi")).select("key", "value").persist()
        calls, inserts, hits = wanted.count(), region.count(), hit.count() if hit is not None else 0
        self._add(calls=calls, hits=hits, misses=calls - hits, inserts=inserts)
        out = region if hit is None else hit.unionByName(region)
        wanted.unpersist()
        if inserts:
            self.regions.append((region, inserts, 0))
        while len(self.regions) > self.REGIONS or self._records() * compaction.RECORD_BYTES > self.max_bytes:
            old, n, _ = self.regions.pop(0)
            self._add(evictions=n)
            old.unpersist()
        return out

    def invalidate(self, keys: DataFrame) -> None:
        """Forget ``keys``, as a write must."""
        kept, gone = [], keys.select("key").distinct()
        for region, n, cuts in self.regions:
            hit = region.join(gone, "key", "left_semi").count()
            if not hit:
                kept.append((region, n, cuts))
                continue
            left = region.join(gone, "key", "left_anti").persist()
            self._add(invalidations=hit)
            if left.count() and cuts < self.CUTS:
                kept.append((left, n - hit, cuts + 1))
            else:
                self._add(evictions=n - hit)
                left.unpersist()
            region.unpersist()
        self.regions = kept

    def clear(self) -> None:
        for region, _, _ in self.regions:
            region.unpersist()
        self.regions = []

    def stats(self) -> dict:
        """Counts, the hit rate, and the records held."""
        calls = self.counts["calls"]
        return self.counts | {"hit_rate": self.counts["hits"] / calls if calls else 0.0, "records": self._records()}

    def _records(self) -> int:
        return sum(n for _, n, _ in self.regions)

    def _all(self) -> DataFrame | None:
        out = None
        for region, _, _ in self.regions:
            out = region if out is None else out.unionByName(region)
        return out

    def _add(self, **more: int) -> None:
        for k, n in more.items():
            self.counts[k] += n


class Store:
    """Operations in Parquet parts below ``path``, each with its status and value, and a numbered manifest that says which parts count.

    A batch is folded over the newest records of its own keys only.  Reads stand in the parts
    too, for statistics; the log is the rest.  A failed read-modify-write is
    an invalid record: it writes nothing but touches its key.  One writer at a
    time: a second one's manifest is refused.
    """

    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, key: str = "long"):
        self.spark, self.path, self.config = spark, path.rstrip("/"), (config or Config()).check()
        self.schema = RECORD.format(key=key)
        self._kept = Manifests(spark, self.path)
        self._kept.make_folder()
        new = {"format_version": FORMAT, "number": 0, "begin": 0, "tail": 0, "parts": [], "sessions": {}, "base": None}
        self.state = self._kept.read() or new
        if self.state["format_version"] != FORMAT:
            raise ValueError(f"format {self.state['format_version']} is not {FORMAT}")
        self.state["number"] = max(self.state["number"], self._kept.last_number())
        self.checkpoints = CheckpointStore(spark, f"{self.path}/_checkpoints")
        self.cache = ReadCache(self, self.config.cache.mem_size) if self.config.cache.enabled else None
        self.compactor = compaction.AutoCompactor(self.config.policy(), self.config.compaction.per_hour, self.config.compaction.quiet_seconds)
        self.collecting, self.events = True, dict.fromkeys((f"{what}_{how}" for what in ("checkpoint", "compaction", "recovery") for how in ("started", "completed", "failed")), 0)

    # -- state -----------------------------------------------------------------

    begin = property(lambda self: self.state["begin"])
    tail = property(lambda self: self.state["tail"])
    version = property(lambda self: self.state["number"])
    sessions = property(lambda self: self.state["sessions"])

    @property
    def head(self) -> int:
        """Where the hot part of the log begins: the last records that fit into the log's memory."""
        return max(self.begin, self.tail - self.config.store.log_memory_size // compaction.RECORD_BYTES)

    def over_memory(self) -> bool:
        """Whether the log has outgrown its memory."""
        return self.head > self.begin

    def info(self) -> dict:
        """Addresses, version and settings."""
        k = self.config.checkpoint
        return {"path": self.path, "begin": self.begin, "head": self.head, "tail": self.tail, "version": self.version, "parts": len(self.state["parts"]), "sessions": len(self.sessions), "backend": k.backend, "durability": k.durability, "over_memory": self.over_memory()}

    def _write(self) -> None:
        self.state["number"] += 1
        self._kept.write(self.state, self.state["number"])

    def _read(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{n}" for n in names])

    def operations(self) -> DataFrame:
        """All operations from begin on, with statuses and values."""
        return self._read(self.state["parts"]).where(F.col("seq") >= self.begin)

    def log(self) -> DataFrame:
        """Records from begin on: (seq, key, value, tombstone, invalid, session)."""
        return self._records(self.operations())

    @staticmethod
    def _records(operations: DataFrame) -> DataFrame:
        return operations.where((F.col("op") != "read") & ((F.col("status") == OK) | F.col("invalid"))).select("seq", "key", "value", "tombstone", "invalid", "session")

    # -- operations ------------------------------------------------------------

    def session(self) -> SessionBuilder:
        return SessionBuilder(self)

    def apply(self, batch: DataFrame) -> DataFrame:
        """Apply ``batch`` (seq, key, op, val), in the order of seq, outside any session: (seq, key, op, status, value) of its rows.

        A row's seq is distinct within the batch; in the log it counts from the tail on.  The result is read
        from the batch's part, so it stands until a compaction or recovery.  Rows without
        a key, seq or op, and unknown ops, are refused with an error before anything is written.
        """
        return self._apply(batch, None)[0]

    def _apply(self, batch: DataFrame, guid: str | None) -> tuple[DataFrame, int]:
        known = F.coalesce(F.col("op").isin("read", "upsert", "delete", "rmw", "conditional_insert"), F.lit(False))
        row = batch.agg(F.count("*").alias("n"), F.count_distinct("seq").alias("d"), F.min("seq").alias("low"), F.max("seq").alias("high"), F.count_if(F.col("key").isNull() | ~known).alias("odd")).first()
        if row.odd or row.d != row.n:
            raise ValueError("null keys, null or repeated seqs, or unknown operations")
        name = f"part-{len(self.state['parts']):06d}-{uuid.uuid4().hex}"
        if row.n:
            self._fold(batch, row.low).withColumn("session", F.lit(guid).cast("string")).select(*self._read([]).columns).write.parquet(f"{self.path}/{name}")
            self.state["parts"].append(name)
            self.state["tail"] += row.high - row.low + 1
        part = self._read([name] if row.n else [])
        done = part.where((F.col("op") != "read") & (F.col("status") == OK)).count()
        if guid is not None:
            self.sessions[guid] = self.sessions.get(guid, 0) + done
        if row.n:
            self._write()
            if self.cache:
                self.cache.invalidate(part.where("op != 'read'"))
        return part.select((F.col("seq") - self.tail + (row.high or 0) + 1).alias("seq"), "key", "op", "status", "value"), done

    def _fold(self, batch: DataFrame, low: int) -> DataFrame:
        """The batch's rows as records, folded after what its keys held before."""
        rows = batch.select((F.col("seq") - low + self.tail).alias("seq"), "key", "op", F.col("val").cast("long").alias("val"))
        old = self.log().join(rows.select("key").distinct(), "key", "left_semi")
        newest = old.groupBy("key").agg(F.max_by(F.struct("value", "tombstone"), F.when(~F.col("invalid"), F.col("seq"))).alias("r"))
        live = F.col("r").isNotNull() & ~F.coalesce(F.col("r.tombstone"), F.lit(True))
        # What a key held is one upsert before the batch; a key that is gone but touched is an upsert and a delete.
        first = newest.select(F.lit(-2).cast("long").alias("seq"), "key", F.lit("upsert").alias("op"), F.when(live, F.col("r.value")).alias("val"))
        then = newest.where(~live).select(F.lit(-1).cast("long").alias("seq"), "key", F.lit("delete").alias("op"), F.lit(None).cast("long").alias("val"))
        folded = fold.fold(first.unionByName(then).unionByName(rows), begin=-2).where("seq >= 0")
        return folded.withColumn("tombstone", F.col("op") == "delete").withColumn("invalid", (F.col("op") == "rmw") & (F.col("status") != OK))

    def read(self, keys: DataFrame) -> DataFrame:
        """(key, value) of the live ones of ``keys``, through the read cache if there is one."""
        if self.cache:
            return self.cache.lookup(keys)
        return snapshot.latest(self.log().join(keys.select("key").distinct(), "key", "left_semi")).select("key", "value")

    def snapshot(self) -> DataFrame:
        """(key, seq, value) of live keys."""
        return snapshot.latest(self.log())

    # -- space -----------------------------------------------------------------

    def compact(self, until: int | None = None) -> dict:
        """Rewrite the records below ``until``, the tail by default, as one part of live ones; the old parts go after the new manifest.

        Live keys keep their records and seqs; operations below ``until`` that are not live
        records are forgotten, the touch of a failed read-modify-write among them.
        """
        until = self.tail if until is None else min(until, self.tail)
        found = compaction.compaction_stats(self.log(), self.begin, until).first().asDict()
        name, old = f"part-{len(self.state['parts']):06d}-{uuid.uuid4().hex}", list(self.state["parts"])
        self._event("compaction", lambda: self._rewrite(name, until))
        self._swap(old, parts=[name], base=None)
        return found

    def _swap(self, old: list[str], **state) -> None:
        """Commit ``state``, then delete those parts of ``old`` that it and the checkpoints do not name."""
        self.state |= state
        self._write()
        if self.cache:
            self.cache.clear()
        named = set(self.state["parts"]).union(*[m.get("parts", []) for m in self.checkpoints.manifests()])
        for part in set(old) - named:
            self._kept.delete(part)

    def _rewrite(self, name: str, until: int) -> None:
        operations = self.operations()
        newest = compaction.with_newest(self.log()).where("is_newest and not tombstone").select("seq")
        below = operations.where(F.col("seq") < until).join(newest, "seq", "left_semi")
        operations.where(F.col("seq") >= until).unionByName(below).write.parquet(f"{self.path}/{name}")

    def compact_bytes(self, n: int) -> dict:
        """Compact the first ``n`` bytes of the log."""
        return self.compact(self.begin + n // compaction.RECORD_BYTES)

    def compact_to(self, other: Store, until: int | None = None) -> int:
        """Append the live records below ``until`` to another store, and return how many they are; this store stays as it is."""
        until = self.tail if until is None else min(until, self.tail)
        live = self.snapshot().where(F.col("seq") < until).select("seq", "key", F.lit("upsert").alias("op"), F.col("value").alias("val"))
        return other._apply(live, None)[1]

    def tick(self, now: float) -> dict | None:
        """Compact if the policy says so; a scheduler calls this."""
        if self.compactor.tick(self.log(), self.tail, now) is None:
            return None
        return self.compact()

    def truncate(self, until: int, before=(), after=()) -> None:
        """Forget all below ``until``, between callbacks that get the new begin."""
        until = max(self.begin, min(until, self.tail))
        scan.shift_begin(self.log(), until, before, [lambda b: self._begin_at(b), *after])

    def _begin_at(self, begin: int) -> None:
        self.state |= {"begin": begin, "base": None}
        self._write()
        if self.cache:
            self.cache.clear()

    # -- checkpoints -----------------------------------------------------------

    def checkpoint(self, kind: str | None = None) -> str:
        """A checkpoint of the whole log; its kind follows the configured backend unless named.

        An incremental one goes on from the last full or incremental one, and is full where there is
        none since the last compaction or truncation, which drop tombstones that a chain needs.
        Index and fold-over checkpoints point into the parts of the log, which then stay.
        """
        kind = kind or {"snapshot": "full", "foldover": "foldover"}[self.config.checkpoint.backend]
        return self._event("checkpoint", lambda: self._checkpoint(kind))

    def _checkpoint(self, kind: str) -> str:
        if kind == "incremental" and self.state["base"] is None:
            kind = "full"
        token = self.checkpoints.save(kind, self.log(), self.tail, self.begin, dict(self.sessions), self.state["base"], list(self.state["parts"]))
        if kind in ("full", "incremental"):
            self.state["base"] = token
            self._write()
        if self.config.checkpoint.durability == "fsync" and kind != "foldover" and not self.checkpoints.verify(token):
            raise RuntimeError(f"checkpoint {token} does not read back as written")
        return token

    def recover(self, token: str) -> dict:
        """Put the store back to a checkpoint: its live keys, its sessions and its tail; later operations are forgotten."""
        m = self.checkpoints.info(token)
        rows = self._event("recovery", lambda: self._recovered(m))
        name, old = f"part-{len(self.state['parts']):06d}-{uuid.uuid4().hex}", list(self.state["parts"])
        records = rows.select("seq", "key", F.lit("upsert").alias("op"), F.col("value").alias("val"), F.lit(None).cast("string").alias("session"), F.lit(OK).alias("status"), "value", F.lit(False).alias("tombstone"), F.lit(False).alias("invalid"))
        records.write.parquet(f"{self.path}/{name}")
        chained = m["kind"] in ("full", "incremental")
        self._swap(old, parts=[name], begin=0, tail=m["final_seq"], sessions=dict(m["sessions"]), base=token if chained else None)
        return m

    def _recovered(self, m: dict) -> DataFrame:
        if m["kind"] in ("foldover", "index"):
            log = self._records(self._read(m["parts"])).where(F.col("seq") < m["final_seq"])
            return (self.checkpoints.recover_fold_over if m["kind"] == "foldover" else self.checkpoints.recover_index_only)(log, m["token"])[0]
        if m["kind"] == "log":
            return snapshot.latest(self.checkpoints.recover_log_only(m["token"])[0])
        return self.checkpoints.recover(m["token"])[0]

    # -- statistics ------------------------------------------------------------

    def _event(self, what: str, run):
        self._count(f"{what}_started")
        try:
            out = run()
        except Exception:
            self._count(f"{what}_failed")
            raise
        self._count(f"{what}_completed")
        return out

    def _count(self, name: str) -> None:
        if self.collecting:
            self.events[name] += 1

    def stats(self, group: str = "operations") -> DataFrame:
        """One group of statistics: operations, sessions, index, log, or events (checkpoints, compactions, recoveries of this object)."""
        if group == "operations":
            return stats.op_stats(self.operations())
        if group == "sessions":
            return stats.session_stats(self.operations())
        if group == "index":
            return stats.index_distribution(self.log(), self.config.store.table_size)
        if group == "log":
            return stats.log_stats(self.log(), self.begin, self.head)
        if group == "events":
            return self.spark.createDataFrame([tuple(self.events.values())], ", ".join(f"{k} long" for k in self.events))
        raise ValueError(f"unknown group {group}")

    def grow(self, size: int) -> DataFrame:
        """Enlarge the key index to ``size`` buckets: the result of the growth."""
        old = self.config.store.table_size
        if size < old:
            raise ValueError("an index does not shrink")
        self.config = replace(self.config, store=replace(self.config.store, table_size=size)).check()
        return stats.grow_result(self.log(), old, size)
