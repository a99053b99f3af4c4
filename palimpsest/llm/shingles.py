"""Near copies by the Jaccard similarity of word shingles: SimHash and MinHash bands find them, whole shingle sets confirm them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, sliced, worker_cache
from .components import connected_components
from .simhash import fingerprint, hashes, keep_least, links, narrow

#: Words of a shingle, and the least similarity of near copies as a fraction.
WIDTH, LEAST = 5, (4, 5)
#: A pair of similarity s meets in one of the bands with probability 1 - (1 - s**ROWS)**BANDS: at 0.8 all but one in a
#: million do, while texts that share a third of their shingles meet in one bucket of 90.
BANDS, ROWS = 75, 8
#: A sketch holds PLANES bits of each MinHash value, a plane in LONGS longs.  At 0.8 a pair differs in 105 of 600 values
#: on average (7 of 8 unlike values show it), and in more than this many, five deviations off, about once in a million.
PLANES, LONGS, DIFFERENT = 3, 10, 151
SEED = 42
_RNG = np.random.default_rng(SEED)
TIMES, PLUS = (_RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) | np.uint64(o) for o in (1, 0))
MIX = _RNG.integers(0, 2**64, (BANDS, ROWS + 1), np.uint64) | np.uint64(1)


def node(g: np.ndarray) -> int:
    """One signed long for a shingle set: texts of equal sets are copies."""
    return int(np.uint64(xxhash.xxh64_intdigest(g.tobytes(), SEED)).view(np.int64))


def bands(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band keys and the longs of sketch bits of a shingle set; no keys for sets so small that near copies are equal."""
    if len(g) < LEAST[0]:
        return np.empty(0, np.int64), np.zeros(PLANES * LONGS, np.int64)
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(g), 256):
        np.minimum(low, (g[a : a + 256] * TIMES + PLUS).min(axis=1), out=low)
    mixed = (low ^ low >> np.uint64(31)) * MIX[:, :ROWS].ravel()
    bits = np.zeros((PLANES, 64 * LONGS), bool)
    for i in range(PLANES):
        bits[i, : len(mixed)] = mixed >> np.uint64(63 - i) & np.uint64(1)
    sketch = np.packbits(bits.ravel(), bitorder="little").view(np.int64)
    key = mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) ^ MIX[:, ROWS]
    return (key ^ key >> np.uint64(29)).view(np.int64), sketch


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two shingle sets reach the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= LEAST[0] * (len(a) + len(b) - both)


def _each(docs: DataFrame, fields: str, make) -> DataFrame:
    """doc_id, tie and what ``make`` gives for the shingle hashes of a batch's texts, repeats included."""
    names = ["doc_id", "tie", *(f.split()[0] for f in fields.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("shingles")
        for b in sliced(batches, 500):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *make([hashes(t, WIDTH) for t in b.column(2).cast(pa.binary()).to_pylist()])], names=names)

    return narrow(docs).mapInArrow(run, f"doc_id long, tie long, {fields}")


def _signed(texts: list[np.ndarray]) -> list[pa.Array]:
    prints = np.array([fingerprint(h) for h in texts], np.uint64).view(np.int64)
    sets = [np.unique(h) for h in texts]
    keys, sketches = zip(*map(bands, sets), strict=True) if sets else ([], [])
    ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
    low = [pa.array([x[i] for x in sketches], pa.int64()) for i in range(PLANES * LONGS)]
    return [pa.array([node(g) for g in sets], pa.int64()), pa.array([len(g) for g in sets], pa.int32()), pa.array(prints), *low, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if sets else [], pa.int64()))]


def _whole(texts: list[np.ndarray]) -> list[pa.Array]:
    sets = [np.unique(h) for h in texts]
    return [pa.array([node(g) for g in sets], pa.int64()), pa.array([g.tobytes() for g in sets], pa.binary())]


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (u, v) of ``pairs`` whose whole shingle sets are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("shingles")
        for b in sliced(batches, 200):
            ok = [near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("grams").alias("gu")), "u").join(sets.select(F.col("node").alias("v"), F.col("grams").alias("gv")), "v")
    return both.select("u", "v", "gu", "gv").mapInArrow(run, "u long, v long")


def _ordered(df: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct (u, v) of rows whose set sizes allow the least similarity."""
    sized = df.where(f"{a}.node != {b}.node and {LEAST[1]} * least({a}.n, {b}.n) >= {LEAST[0]} * greatest({a}.n, {b}.n)")
    return sized.select(F.least(f"{a}.node", f"{b}.node").alias("u"), F.greatest(f"{a}.node", f"{b}.node").alias("v")).distinct()


def fingerprint_pairs(prints: DataFrame) -> DataFrame:
    """(u, v): shingle sets that SimHash puts together, where their sizes allow the least similarity.

    prints has (node, n, print): of each set the fingerprints of its texts.  Sets of one fingerprint meet
    its least set, and the least sets of fingerprints within two bits, which
    multi-index hashing finds, meet each other; so a pair costs no more than a row of either.
    """
    least = materialize(prints.groupBy("print").agg(F.min(F.struct("node", "n")).alias("least"), F.count("*").alias("members")), "shingles")
    same = prints.join(least.where("members > 1").select("print", F.col("least").alias("b")), "print").select(F.struct("node", "n").alias("a"), "b")
    ends = [least.select(F.col("print").alias(k), F.col("least").alias(s)) for k, s in (("u", "a"), ("v", "b"))]
    near = links(least.select(F.col("print").alias("fp"))).join(ends[0], "u").join(ends[1], "v").select("a", "b")
    found = materialize(_ordered(same.union(near), "a", "b"), "shingles")
    release(least)
    return found


def near_duplicate_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, fp) of every row, and (fp, component_id, root) of every distinct shingle set.

    Groups are the components of all found pairs of similarity 0.8 or more; fp
    stands for a shingle set.  Sets whose SimHash fingerprints are within two bits
    are candidates, as in op1 but of five words; fingerprints reach few edited copies, so sets that meet in a band are candidates too.
    First pairs of fingerprints are compared, and each set with one hub, the set of its buckets that meets most others, so a large group
    of near copies costs one comparison a member, and with the hubs of those buckets that
    this did not join; then, where a bucket still holds
    several groups, all its pairs that could join two of them are compared.
    Rows with a null or empty text are copies of each other.
    """
    rows = materialize(_each(docs, f"fp long, n int, print long, {', '.join(f's{i} long' for i in range(PLANES * LONGS))}, keys array<long>", _signed), "shingles")
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("low"))
    sketch = [f"s{i}" for i in range(PLANES * LONGS)]
    one = materialize(rows.dropDuplicates(["fp"]).select(F.col("fp").alias("node"), "n", *sketch, "keys"), "shingles")
    printed = fingerprint_pairs(rows.select(F.col("fp").alias("node"), "n", "print").distinct())
    entries = one.select("node", "n", F.explode("keys").alias("key"))
    many = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    many = materialize(many, "shingles")
    met = materialize(entries.join(many, "key"), "shingles")  # buckets of several sets
    # The hub of a bucket is the set that meets most others in all its buckets: the text that copies were made from, rather than one of them.
    weights = met.groupBy("node").agg(F.sum("members").alias("weight"))
    met2 = materialize(met.drop("members").join(weights, "node"), "shingles")
    hubs = met2.groupBy("key").agg(F.max(F.struct("weight", "node", "n")).alias("hub"))
    shared = materialize(met2.join(hubs, "key"), "shingles")
    for done in (many, met, met2):
        release(done)
    # Written, so that its size is known: a small table is broadcast and no other texts move or are read as shingles again.
    paired = shared.select("node").union(printed.select("u")).union(printed.select("v")).distinct()
    wanted = materialize(paired.join(distinct, F.col("node") == F.col("fp")).select("fp", "low"), "shingles")
    some = docs.join(wanted.select("low").distinct(), docs.doc_id.cast("long").eqNullSafe(F.col("low")), "left_semi")
    whole = _each(some, "fp long, grams binary", _whole).alias("d").join(wanted.alias("w"), F.expr("d.fp = w.fp and d.doc_id <=> w.low"), "left_semi")
    sets = materialize(whole.dropDuplicates(["fp"]).select(F.col("fp").alias("node"), "grams"), "shingles")

    # First pairs of fingerprints meet, and each set meets one hub, the heaviest of its buckets; then, where that did not join them, the hubs of the others.
    itself = F.struct("node", "n")
    first = shared.groupBy("node", "n").agg(F.max("hub").alias("b")).select(itself.alias("a"), "b")
    edges = materialize(_confirmed(printed.union(_ordered(first, "a", "b")).distinct(), sets), "shingles")
    comps = materialize(connected_components(edges), "shingles")
    of_hub = comps.select(F.col("node").alias("hub_node"), F.col("root").alias("hub_root"))
    apart = shared.join(comps, "node", "left").withColumn("hub_node", F.col("hub.node")).join(of_hub, "hub_node", "left")
    apart = apart.where(F.coalesce("root", "node") != F.coalesce("hub_root", "hub_node")).select(itself.alias("a"), F.col("hub").alias("b"))
    edges = materialize(edges.union(_confirmed(_ordered(apart, "a", "b"), sets)), "shingles")
    comps = materialize(connected_components(edges), "shingles")
    rooted = shared.join(comps, "node", "left").select("key", "node", "n", F.col("hub.node").alias("hub"), F.coalesce("root", "node").alias("root"))
    sizes = rooted.groupBy("key", "root").agg(F.count("*").alias("members"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("members", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("key", "most")
    open_ = materialize(rooted.join(mixed, "key").join(one.drop("n", "keys"), "node"), "shingles")
    # A pair that meets in several open buckets is made in the least of them alone; a set has at most BANDS keys.
    open_ = open_.join(open_.groupBy("node").agg(F.collect_list("key").alias("keys")), "node")
    # The largest group's own pairs join nothing; a pair with the hub has been compared; unlike sketches make no pair.
    alike = " + ".join("bit_count(" + " | ".join(f"(a.s{j} ^ b.s{j})" for j in range(i, PLANES * LONGS, LONGS)) + ")" for i in range(LONGS))
    pairs = open_.where("root != most and node != hub").alias("a").join(open_.where("node != hub").alias("b"), F.expr(f"a.key = b.key and a.root != b.root and {alike} <= {DIFFERENT} and (b.root = b.most or a.node < b.node) and a.key = array_min(array_intersect(a.keys, b.keys))"))
    more = materialize(_confirmed(_ordered(pairs, "a", "b"), sets), "shingles")
    for done in (printed, shared, wanted, sets, open_, one):
        release(done)
    if not more.isEmpty():
        comps = materialize(connected_components(comps.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more)), "shingles")
    joined = distinct.join(comps, distinct.fp == comps.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = joined.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "tie", "fp"), materialize(joined.join(lows, "root").select("fp", "component_id", "root"), "shingles")


def keep_one(docs: DataFrame) -> DataFrame:
    """All columns of ``docs``, one row of each group of near copies: that of the least doc_id.

    Of rows that repeat that doc_id with other texts of the group, the one of least text
    hash stays, of equal rows any one; a group without any doc_id keeps one row.
    """
    return keep_least(docs, *near_duplicate_groups(docs.select("doc_id", "text")))
