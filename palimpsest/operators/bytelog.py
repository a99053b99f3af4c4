"""An append-only log of byte entries: commit, scan, truncate, recover."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.manifest import Manifests
from .scan import with_addresses

FORMAT = 2


def entries(rows: DataFrame, order: list[str], payload: str, base: int = 0) -> DataFrame:
    """Log entries of ``rows`` with (addr, len, next_addr) and the payload's CRC-32; empty payloads are refused, so they are left out."""
    kept = rows.where(F.octet_length(payload) > 0)
    return with_addresses(kept, order, payload, base=base).withColumn("crc", F.crc32(F.col(payload).cast("binary")))


def scan(log: DataFrame, begin: int, end: int) -> DataFrame:
    """Entries with begin <= addr < end."""
    return log.where((F.col("addr") >= begin) & (F.col("addr") < end))


def read_entry(log: DataFrame, addr: int, begin: int, tail: int) -> DataFrame:
    """The entry at ``addr``; none outside [begin, tail)."""
    return scan(log, begin, tail).where(F.col("addr") == addr)


def truncate_before(begin: int, committed: int, addr: int) -> int:
    """New begin; an error past what is committed, no change below begin."""
    if addr > committed:
        raise ValueError(f"{addr} lies past the committed {committed}")
    return max(begin, addr)


def reclaimable(begin: int, committed: int, page: int) -> int:
    """Bytes of whole pages between begin and committed."""
    return max(0, committed // page - begin // page) * page


def recover(log: DataFrame, valid: str = "valid") -> DataFrame:
    """Entries before the first that fails its check."""
    first = log.where(~F.col(valid)).agg(F.min("addr").alias("bad"))
    return log.join(F.broadcast(first), F.col("bad").isNull() | (F.col("addr") < F.col("bad"))).drop("bad")  # one row


def self_check(log: DataFrame, payload: str) -> DataFrame:
    """(entries, bad, first_bad_addr) from the stored checksums."""
    ok = F.crc32(F.col(payload).cast("binary")) == F.col("crc")
    return log.agg(F.count("*").alias("entries"), F.count_if(~ok).alias("bad"), F.min(F.when(~ok, F.col("addr"))).alias("first_bad_addr"))


def with_recomputed(log: DataFrame, payload: str = "payload") -> DataFrame:
    """``log`` with ``valid``: whether an entry's payload has its stored length and CRC-32."""
    data = F.col(payload).cast("binary")
    return log.withColumn("valid", F.coalesce((F.crc32(data) == F.col("crc")) & (F.octet_length(data) == F.col("len")), F.lit(False)))


class ByteLog:
    """A byte log in a folder: Parquet parts and manifests (begin, committed, tail).

    Each commit writes a numbered manifest, so a crash at any point leaves the log as
    it was or as it is now.  A part's name is never used twice, so parts
    that no manifest names are never overwritten by, or read as, committed ones.
    """

    def __init__(self, spark: SparkSession, path: str, check: bool = False, repair: bool = False):
        """``check`` recomputes the checksums of committed entries and refuses a damaged log; ``repair`` cuts it before the first damaged one."""
        self.spark, self.path = spark, path.rstrip("/")
        self._kept = Manifests(spark, self.path)
        self._kept.make_folder()
        self.state = self._kept.read() or {"format_version": FORMAT, "number": 0, "begin": 0, "committed": 0, "tail": 0, "parts": [], "closed": False}
        if self.state["format_version"] != FORMAT:
            raise ValueError(f"format {self.state['format_version']} is not {FORMAT}")
        self.state["number"] = max(self.state["number"], self._kept.last_number())  # one may be broken
        self.last_error: str | None = None
        if check or repair:
            self.check_on_open(repair)

    def _write(self) -> None:
        self.state["number"] += 1
        self._kept.write(self.state, self.state["number"])

    def check_on_open(self, repair: bool = False) -> dict:
        """Committed entries, how many are damaged, and the first damaged address; ``repair`` cuts the tail there."""
        found = with_recomputed(self.scan_all()).agg(F.count("*").alias("entries"), F.count_if(~F.col("valid")).alias("bad"), F.min(F.when(~F.col("valid"), F.col("addr"))).alias("first_bad_addr")).first().asDict()
        if found["bad"]:
            if not repair:
                raise ValueError(f"{found['bad']} damaged entries from {found['first_bad_addr']} on")
            self.state["committed"] = self.state["tail"] = found["first_bad_addr"]
            self._write()
        return found

    def append(self, rows: DataFrame, order: list[str], payload: str) -> None:
        """Append a batch; it is visible to scans after :meth:`commit`."""
        if self.state["closed"]:
            self.last_error = "the log is closed"
            raise RuntimeError(self.last_error)
        part = f"part-{len(self.state['parts']):06d}-{uuid.uuid4().hex}"
        entries(rows, order, payload, self.state["tail"]).select("addr", "len", "next_addr", "crc", F.col(payload).cast("binary").alias("payload")).write.parquet(f"{self.path}/{part}")
        end = self.spark.read.parquet(f"{self.path}/{part}").agg(F.max("next_addr")).first()[0]
        self.state["parts"].append({"name": part, "begin": self.state["tail"], "end": end or self.state["tail"]})
        self.state["tail"] = end or self.state["tail"]

    def commit(self) -> int:
        self.state["committed"] = self.state["tail"]
        self._write()
        return self.state["committed"]

    def scan_all(self) -> DataFrame:
        """Committed entries from begin.

        A part holds the addresses it was written for, so what a repair has cut from
        an older part stays cut when later ones reuse its addresses.
        """
        out = self.spark.createDataFrame([], "addr long, len long, next_addr long, crc long, payload binary")
        ends = [p["begin"] for p in self.state["parts"][1:]] + [self.state["committed"]]
        for p, end in zip(self.state["parts"], ends, strict=True):
            a, z = max(p["begin"], self.state["begin"]), min(p["end"], end, self.state["committed"])
            if a < z:
                out = out.unionByName(scan(self.spark.read.schema(out.schema).parquet(f"{self.path}/{p['name']}"), a, z))
        return out

    def truncate(self, addr: int) -> None:
        """Entries below ``addr`` go; an error past what is committed."""
        self.state["begin"] = truncate_before(self.state["begin"], self.state["committed"], addr)
        self._write()

    def truncate_until(self, addr: int) -> None:
        """The unguarded form: begin is ``addr``, or what is committed if that is less."""
        self.state["begin"] = max(self.state["begin"], min(addr, self.state["committed"]))
        self._write()

    def stats(self) -> dict:
        """Addresses, sizes and state of the log."""
        s = self.state
        return {"begin": s["begin"], "committed": s["committed"], "tail": s["tail"], "uncommitted": s["tail"] - s["committed"], "parts": len(s["parts"]), "closed": s["closed"], "last_error": self.last_error}

    def close(self) -> None:
        self.state["closed"] = True
        self._write()


def inspect(spark: SparkSession, path: str) -> dict:
    """What a folder's log is, without opening it to write: valid, metadata, stats, and the checksums of its committed entries.

    A missing folder, one without a readable manifest, or one of another format is not valid
    and has no more fields.
    """
    kept = Manifests(spark, path)
    state = kept.read() if kept.exists() else None
    if state is None or state.get("format_version") != FORMAT:
        return {"valid": False}
    log = ByteLog(spark, path)
    found = self_check(log.scan_all(), "payload").first().asDict()
    return {"valid": found["bad"] == 0, "metadata": {k: state[k] for k in ("format_version", "number", "closed")}, "stats": log.stats(), "check": found}
