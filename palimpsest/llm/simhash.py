"""SimHash near-duplicate groups, linked by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, sliced, worker_cache
from .components import connected_components

SEED = 42


def hashes(text: bytes | None, width: int = 3) -> np.ndarray:
    """64-bit hashes of a text's word shingles, repeats included; a shorter text is one shingle, one without words none."""
    words = (text or b"").lower().split()  # bytes: only A-Z, only ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    spans = [words[i:] for i in range(width)] if len(words) >= width else [[b" ".join(words)]]
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*spans, strict=False))) if len(words) >= width else (xxhash.xxh64_intdigest(spans[0][0], SEED),), np.uint64, len(spans[-1]))


def fingerprint(h: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 without any."""
    n = len(h)
    if n > 256:
        table = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
        octets = h.view(np.uint8).reshape(-1, 8)
        ones = np.concatenate([np.bincount(octets[:, j], minlength=256) @ table for j in range(8)])
    else:
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def simhash(text: bytes | None, width: int = 3) -> int:
    """64-bit SimHash of word shingles; 0 for a text without words."""
    return fingerprint(hashes(text, width))


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, text); tie is the text's hash, which tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"), text.alias("text"))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, tie, fp long) for each row of documents; fp holds the 64 bits as a signed long, tie is the text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("simhash")
        for b in sliced(batches):
            fp = [simhash(t, width) for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(fp, np.uint64).view(np.int64))], names=["doc_id", "tie", "fp"])

    return narrow(docs).mapInArrow(run, "doc_id long, tie long, fp long")


def _bits(fp: str, shift: int) -> str:
    """One of the four 16-bit segments."""
    return f"(shiftrightunsigned({fp}, {shift}) & 65535)"


#: A table is keyed by two or three segments, 48 bits of the fingerprint: a
#: 32-bit half and one segment of the other half.  (half shift, segment shift).
TABLES = ((32, 16), (32, 0), (0, 48), (0, 32))


def _key(table: int, fp: str = "fp") -> str:
    half, segment = TABLES[table]
    return f"named_struct('slot', {table}, 'key', (shiftrightunsigned({fp}, {half}) & 4294967295L) << 16 | {_bits(fp, segment)})"


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): every pair of distinct fingerprints that differ in one or two bits.

    Multi-index hashing on two levels.  The halves of a pair within two bits
    differ by (0, up to 2), (1, up to 1) or (2, 0).  Where the high half
    agrees, the low half is searched with radius 2 over its two segments (a
    ball of radius 1 in one, 0 in the other); where the high half is off by one
    bit, with radius 1 (radius 0 in either segment); where the low half agrees,
    the high one is searched with radius 2.  So a bucket is one value of 48 bits
    and never a mere half that a family of near copies may share.  Of two
    fingerprints that differ in a flipped bit, the one with the zero probes.
    """
    table = distinct.select("fp", F.explode(F.array(*[F.expr(_key(t)) for t in range(4)])).alias("k")).select("k.slot", "k.key", F.col("fp").alias("t"))
    flips = [(0, 16), (0, 32), (1, 32), (2, 48)]  # (table, first bit of the ball); the high half has 32 bits
    balls = []
    for t, low in flips:
        n = 16 if low in (16, 48) else 32
        balls.append(f"transform(filter(sequence({low}, {low + n - 1}), i -> (shiftrightunsigned(fp, i) & 1) = 0), i -> {_key(t, '(fp | shiftleft(1L, i))')})")
    own = "array(" + ", ".join(_key(t) for t in range(4)) + ")"
    probes = distinct.select("fp", F.explode(F.expr(f"concat({own}, {', '.join(balls)})")).alias("k")).select("k.slot", "k.key", F.col("fp").alias("p"))
    near = probes.join(table, ["slot", "key"]).where("p != t and bit_count(p ^ t) <= 2")
    return near.select(F.least("p", "t").alias("u"), F.greatest("p", "t").alias("v")).distinct()


def near_duplicate_groups(docs: DataFrame, width: int = 3) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, fp) of every row, and (fp, component_id, root) of every distinct fingerprint.

    component_id is the least doc_id of the group and root its least
    fingerprint.  Rows with a null or empty text have fingerprint zero and are
    linked like others; repeated rows share their group; a group whose doc_ids
    are all null has a null component_id; an empty table gives empty tables.
    Only the columns doc_id and text are read.
    """
    fps = materialize(fingerprints(docs, width), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    comps = materialize(connected_components(links(distinct.select("fp"))), "simhash")
    rooted = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps, materialize(rooted.join(lows, "root").select("fp", "component_id", "root"), "simhash")


def simhash_dedup(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``; see :func:`near_duplicate_groups`."""
    fps, groups = near_duplicate_groups(docs, width)
    return fps.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_least(docs: DataFrame, fps: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of least doc_id of each group, all columns; fps has (doc_id, tie, fp) of the rows of ``docs``.

    Rows are chosen by narrow columns, so texts are moved once, to meet the chosen.
    """
    named = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, named, strict=True))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")).alias("one")
    stay = materialize(fps.groupBy("fp").agg(least).join(groups, "fp").groupBy("root").agg(F.min("one").alias("one")).select("one.none", "one.id", "one.tie"), "simhash")
    plain = docs.toDF(*named)
    doc_id, text = F.col(at["doc_id"]).cast("long"), F.col(at["text"]).cast("string")
    marked = plain.select(*named, doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"))
    kept = marked.join(stay, ["none", "id", "tie"], "left_semi").dropDuplicates(["none", "id", "tie"])  # of equal rows one
    return kept.select(*[F.col(n).alias(c) for c, n in at.items()])


def keep_one(docs: DataFrame, width: int = 3) -> DataFrame:
    """All columns of ``docs``, one row of each near-duplicate group: that of the least doc_id.

    Of rows that repeat that doc_id with other texts of the group, the one of least text
    hash stays, of equal rows any one; a group without any doc_id keeps one row.
    """
    return keep_least(docs, *near_duplicate_groups(docs.select("doc_id", "text"), width))
