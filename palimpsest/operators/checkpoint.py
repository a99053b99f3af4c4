"""Checkpoints of a log: prefixes, increments, chains, and their manifests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import MAX_SESSIONS
from .snapshot import raw_latest

FORMAT = 2
MANIFEST = "token string, version int, kind string, base_token string, begin_seq long, final_seq long, sessions map<string,long>"


def session_states(with_serials: DataFrame, cut: int) -> DataFrame:
    """(session, serial): the last serial of every session below the cut."""
    return with_serials.where(F.col("seq") < cut).groupBy("session").agg(F.max("serial").alias("serial"))


def resume(with_serials: DataFrame, states: DataFrame) -> DataFrame:
    """Operations of sessions that come after their recovered serial."""
    last = states.select("session", F.col("serial").alias("_last"))
    return with_serials.join(last, "session", "left").where(F.col("serial") > F.coalesce("_last", F.lit(0))).drop("_last")


def delta(log: DataFrame, base_final: int, final: int) -> DataFrame:
    """Records of [base_final, final)."""
    return log.where((F.col("seq") >= base_final) & (F.col("seq") < final))


def apply_chain(*slices: DataFrame) -> DataFrame:
    """Live keys of a base snapshot and its deltas."""
    out = slices[0]
    for s in slices[1:]:
        out = out.unionByName(s)
    return raw_latest(out).where(~F.col("tombstone")).drop("tombstone")


def check_chain(manifests: DataFrame) -> DataFrame:
    """Manifests with ``continues``: each starts where the one before it ends."""
    w = Window.orderBy("version")  # one row a checkpoint
    return manifests.withColumn("continues", F.coalesce(F.lag("final_seq").over(w) == F.col("begin_seq"), F.lit(True)))


def newest(manifests: DataFrame) -> DataFrame:
    """The checkpoint of the highest version."""
    return manifests.orderBy(F.desc("version"), F.desc("token")).limit(1)


def check_sessions(states: DataFrame, expected: int | None = None) -> list[str]:
    """What is wrong with session states (session, serial)."""
    row = states.agg(F.count("*").alias("n"), F.count_distinct("session").alias("d"), F.count_if(F.col("session").isNull() | F.col("serial").isNull() | (F.col("serial") < 0)).alias("odd")).first()
    return [
        text
        for wrong, text in (
            (row.n > MAX_SESSIONS, f"more than {MAX_SESSIONS} sessions"),
            (row.n != row.d, "a session is listed twice"),
            (row.odd > 0, "a session or serial is null or negative"),
            (expected is not None and row.n != expected, "the number of sessions differs"),
        )
        if wrong
    ]


def checksum(rows: DataFrame) -> tuple[int, int]:
    """(rows, XOR of their hashes): equal for equal rows in any order."""
    row = rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*sorted(rows.columns))), F.lit(0)).alias("x")).first()
    return row.n, row.x


class CheckpointStore:
    """Checkpoints below a folder: data first, under a temporary name, then the rename, the manifest last.

    Kinds: full (snapshot of the latest records), log (the records themselves),
    index (key to seq), incremental (records since the base), tiers (two logs),
    foldover (a range of the log, no rows).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._file = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._file(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._file(self.path))
        self.callbacks = []

    def on_complete(self, callback) -> None:
        """Call ``callback(manifest)`` after each checkpoint."""
        self.callbacks.append(callback)

    def _claim(self) -> int:
        """The next version; a file that only one writer can create claims it."""
        folder = self._file(f"{self.path}/_versions")
        self._fs.mkdirs(folder)
        version = 1 + max([int(s.getPath().getName()) for s in self._fs.listStatus(folder)] + [m["version"] for m in self.manifests()], default=0)
        while not self._fs.createNewFile(self._file(folder, f"{version:012d}")):
            version += 1
        return version

    def _files(self, token: str) -> dict[str, int]:
        """Length of each file of a checkpoint's data."""
        folder = self._file(f"{self.path}/{token}/data")
        if not self._fs.exists(folder):
            return {}
        found = {s.getPath().getName(): s.getLen() for s in self._fs.listStatus(folder)}
        return {n: size for n, size in found.items() if not n.startswith(("_", "."))}

    def _save(self, kind: str, data: DataFrame | None, begin: int, final: int, sessions: dict[str, int], base: str = "", parts: list[str] | None = None) -> str:
        """Rows, their checksum, the files' lengths; without ``data`` the manifest alone."""
        token = uuid.uuid4().hex
        folder = f"{self.path}/{token}"
        if data is None:
            self._fs.mkdirs(self._file(f"{folder}.tmp"))
        else:
            data.write.parquet(f"{folder}.tmp/data")
        self._fs.rename(self._file(f"{folder}.tmp"), self._file(folder))
        rows, check = (0, 0) if data is None else checksum(self.data(token))
        version = self._claim()
        manifest = {"format_version": FORMAT, "rows": rows, "checksum": check, "files": self._files(token), "token": token, "version": version, "kind": kind, "base_token": base, "begin_seq": begin, "final_seq": final, "sessions": {str(k): v for k, v in sessions.items()}} | ({"parts": parts} if parts is not None else {})
        out = self._fs.create(self._file(f"{folder}/manifest.json"), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        for c in self.callbacks:
            c(manifest)
        return token

    def full(self, log: DataFrame, final: int, sessions: dict[str, int] | None = None) -> str:
        return self._save("full", raw_latest(log.where(F.col("seq") < final)).withColumn("invalid", F.lit(False)), 0, final, sessions or {})

    def log_only(self, log: DataFrame, begin: int, final: int, sessions: dict[str, int] | None = None) -> str:
        return self._save("log", delta(log, begin, final), begin, final, sessions or {})

    def tiers(self, hot: DataFrame, cold: DataFrame, final: int, sessions: dict[str, int] | None = None) -> str:
        """The newest records of a hot and a cold log under one token."""
        parts = [raw_latest(t.where(F.col("seq") < final)).withColumn("invalid", F.lit(False)).withColumn("tier", F.lit(name)) for t, name in ((hot, "hot"), (cold, "cold"))]
        return self._save("tiers", parts[0].unionByName(parts[1]), 0, final, sessions or {})

    def recover_tiers(self, token: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
        """(hot, cold, manifest) of a checkpoint of both tiers, the newest by default."""
        m = self._one(token or self._newest(("tiers",)), "tiers")
        rows = self.data(m["token"])
        return rows.where("tier = 'hot'").drop("tier"), rows.where("tier = 'cold'").drop("tier"), m

    def index_only(self, log: DataFrame, final: int, sessions: dict[str, int] | None = None, parts: list[str] | None = None) -> str:
        return self._save("index", raw_latest(log.where(F.col("seq") < final)).select("key", "seq"), 0, final, sessions or {}, parts=parts)

    def incremental(self, log: DataFrame, final: int, sessions: dict[str, int] | None = None, base: str | None = None) -> str:
        """Records since the checkpoint ``base``, by default the newest full or incremental one; a full one if there is none."""
        bases = [m for m in self.manifests() if m["kind"] in ("full", "incremental") and base in (None, m["token"])]
        if not bases:
            return self.full(log, final, sessions)
        base = max(bases, key=lambda m: m["version"])
        rows = delta(log, base["final_seq"], final).select("key", "seq", "value", "tombstone", "invalid")
        return self._save("incremental", rows, base["final_seq"], final, sessions or {}, base["token"])

    def fold_over(self, final: int, begin: int = 0, sessions: dict[str, int] | None = None, parts: list[str] | None = None) -> str:
        """A checkpoint that copies no rows: it names the log's range [begin, final), and ``parts`` that hold it, which must stay while it counts."""
        return self._save("foldover", None, begin, final, sessions or {}, parts=parts)

    def recover_fold_over(self, log: DataFrame, token: str | None = None) -> tuple[DataFrame, dict]:
        """(live keys, manifest) of a fold-over checkpoint, the newest by default, from the log it points into."""
        m = self._one(token or self._newest(("foldover",)), "foldover")
        return apply_chain(delta(log, m["begin_seq"], m["final_seq"])), m

    def save(self, kind: str, log: DataFrame, final: int, begin: int = 0, sessions: dict[str, int] | None = None, base: str | None = None, parts: list[str] | None = None) -> str:
        """A checkpoint of ``log`` by the name of its kind: full, incremental (on ``base``), log, index or foldover (into ``parts``)."""
        make = {
            "full": lambda: self.full(log, final, sessions),
            "incremental": lambda: self.incremental(log, final, sessions, base),
            "log": lambda: self.log_only(log, begin, final, sessions),
            "index": lambda: self.index_only(log, final, sessions, parts),
            "foldover": lambda: self.fold_over(final, begin, sessions, parts),
        }
        if kind not in make:
            raise ValueError(f"unknown kind {kind}")
        return make[kind]()

    def info(self, token: str) -> dict:
        """A checkpoint's manifest."""
        for m in self.manifests():
            if m["token"] == token:
                return m
        raise ValueError(f"checkpoint {token} is missing")

    def problems(self, token: str) -> list[str]:
        """What is wrong with a checkpoint, from its manifest and the lengths of its files alone."""
        m = self.info(token)
        have, listed = self._files(token), m.get("files", {})
        wrong = [f"{n} is missing" for n in sorted(set(listed) - set(have))]
        wrong += [f"{n} is not in the manifest" for n in sorted(set(have) - set(listed))]
        wrong += [f"{n} has {have[n]} bytes, not {listed[n]}" for n in sorted(set(have) & set(listed)) if have[n] != listed[n]]
        if m["format_version"] != FORMAT:
            wrong.append(f"format {m['format_version']} is not {FORMAT}")
        if m["begin_seq"] > m["final_seq"]:
            wrong.append("it ends before it begins")
        if len(m["sessions"]) > MAX_SESSIONS:
            wrong.append(f"more than {MAX_SESSIONS} sessions")
        return wrong

    def _json(self, path) -> dict | None:
        stream = self._fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        except ValueError:  # not written whole
            return None
        finally:
            stream.close()

    def manifests(self) -> list[dict]:
        """All complete checkpoints; folders without a whole manifest do not count."""
        out = []
        for s in self._fs.listStatus(self._file(self.path)):
            p = self._file(s.getPath(), "manifest.json")
            if s.isDirectory() and self._fs.exists(p) and (m := self._json(p)):
                out.append(m)
        return sorted(out, key=lambda m: (m["version"], m["token"]))

    def table(self) -> DataFrame:
        """The manifests as a table."""
        rows = [(m["token"], m["version"], m["kind"], m["base_token"], m["begin_seq"], m["final_seq"], m["sessions"]) for m in self.manifests()]
        return self.spark.createDataFrame(rows, MANIFEST)

    def chain(self, token: str) -> list[dict]:
        """The full checkpoint below ``token`` and the increments up to it."""
        known, out = {m["token"]: m for m in self.manifests()}, []
        while token:
            if token not in known:
                raise ValueError(f"checkpoint {token} is missing")
            out.append(known[token])
            token = known[token]["base_token"]
        out.reverse()
        if out[0]["kind"] != "full" or any(a["final_seq"] != b["begin_seq"] for a, b in zip(out, out[1:], strict=False)):
            raise ValueError("the chain has no full base, or a gap")
        return out

    def _newest(self, kinds: tuple[str, ...]) -> str:
        found = [m["token"] for m in self.manifests() if m["kind"] in kinds]
        if not found:
            raise LookupError(f"no checkpoint of kind {' or '.join(kinds)} below {self.path}")
        return found[-1]

    def _one(self, token: str, kind: str) -> dict:
        for m in self.manifests():
            if m["token"] == token:
                if m["kind"] != kind:
                    raise ValueError(f"checkpoint {token} is of kind {m['kind']}, not {kind}")
                return m
        raise ValueError(f"checkpoint {token} is missing")

    def data(self, token: str) -> DataFrame:
        """A checkpoint's own rows."""
        return self.spark.read.parquet(f"{self.path}/{token}/data")

    def recover(self, token: str | None = None) -> tuple[DataFrame, dict]:
        """(live keys, manifest) of a full or incremental checkpoint, the newest by default."""
        chain = self.chain(token or self._newest(("full", "incremental")))
        return apply_chain(*[self.data(m["token"]) for m in chain]), chain[-1]

    def recover_log_only(self, token: str | None = None) -> tuple[DataFrame, dict]:
        """(records, manifest) of a log checkpoint, the newest by default: the records of [begin_seq, final_seq)."""
        m = self._one(token or self._newest(("log",)), "log")
        return self.data(m["token"]), m

    def recover_index_only(self, log: DataFrame, token: str | None = None) -> tuple[DataFrame, dict]:
        """(live keys, manifest) from an index checkpoint, the newest by default, and the log it points into.

        The index says which record of the log is each key's newest; records after its
        final_seq are replayed over it.
        """
        m = self._one(token or self._newest(("index",)), "index")
        index = self.data(m["token"])
        pointed = log.where(F.col("seq") < m["final_seq"]).join(index.select("key", "seq"), ["key", "seq"], "left_semi")
        after = log.where(F.col("seq") >= m["final_seq"])
        return apply_chain(pointed, after), m

    def verify(self, token: str) -> bool:
        """Whether a checkpoint's rows still have the checksum of its manifest."""
        (m,) = [x for x in self.manifests() if x["token"] == token]
        return checksum(self.data(token)) == (m["rows"], m["checksum"])

    def self_check(self, repair: bool = False, data: bool = False) -> dict[str, list[str]]:
        """Folders without a manifest, and checkpoints whose chain or files are broken or, if ``data``, whose rows fail their checksum; ``repair`` deletes them."""
        partial, broken = [], []
        for s in self._fs.listStatus(self._file(self.path)):
            if s.isDirectory() and s.getPath().getName() != "_versions" and not self._fs.exists(self._file(s.getPath(), "manifest.json")):
                partial.append(s.getPath().getName())
        for m in self.manifests():
            try:
                if m["kind"] in ("full", "incremental"):
                    self.chain(m["token"])
                if wrong := self.problems(m["token"]):
                    raise ValueError("; ".join(wrong))
                if data and m["kind"] != "foldover" and not self.verify(m["token"]):
                    raise ValueError("the rows have changed")
            except ValueError:
                broken.append(m["token"])
        if repair:
            for name in partial + broken:
                self._fs.delete(self._file(f"{self.path}/{name}"), True)
        return {"partial": partial, "broken": broken}
