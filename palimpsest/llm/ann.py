"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking."""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, release
from .topk import best, clean, floats

TREES, LEAF, SAMPLE, SHARE, BLOCK, SEED = 10, 64, 8192, 1.2, 8192, 7
#: The search goes on behind splits nearer than this many times the distance to the k-th nearest of the sample, as a split sees it (over the root of the dimensions).
BOUND = 0.5


@dataclass
class Tree:
    """Splits in arrays; a child below zero is the leaf ``-1 - child``. Leaves know their share of the sample."""

    normal: np.ndarray
    offset: np.ndarray
    child: np.ndarray
    share: np.ndarray

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """The leaf of every row."""
        out, todo = np.zeros(len(v), np.int64), [(0 if len(self.child) else -1, np.arange(len(v)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                low = v[rows] @ self.normal[node] <= self.offset[node]
                todo += [(self.child[node, 0], rows[low]), (self.child[node, 1], rows[~low])]
        return out


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length one; very large and very small rows are scaled first."""
    v = v / np.maximum(np.abs(v).max(axis=1, initial=0.0), 1e-300)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each pair of rows in double precision, summed in the same order for every pair."""
    with np.errstate(over="ignore", under="ignore", divide="ignore", invalid="ignore"):
        out = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
    odd = ~np.isfinite(out) | (np.abs(out) > 1.0000001)
    if odd.any():
        out[odd] = (unit(a[odd]) * unit(b[odd])).sum(axis=1)
    return out


def grow(sample: np.ndarray, leaf: int, rng: np.random.Generator) -> Tree:
    """A tree over unit vectors: each split looks along the line between two random rows and cuts at the median."""
    normals, offsets, children, shares = [], [], [], []

    def node(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            a, b = rng.choice(rows, 2, replace=False)
            w = sample[a] - sample[b]
            if not w.any():
                w = rng.normal(size=sample.shape[1])
            x = sample[rows] @ w
            t = float(np.median(x))
            low = x <= t
            if low.any() and not low.all():
                i = len(normals)
                normals.append(w / np.linalg.norm(w))
                offsets.append(t / np.linalg.norm(w))
                children.append([0, 0])
                children[i] = [node(rows[low]), node(rows[~low])]
                return i
        shares.append(len(rows) / len(sample))
        return -len(shares)

    node(np.arange(len(sample)))
    return Tree(np.array(normals).reshape(-1, sample.shape[1]), np.array(offsets), np.array(children, np.int64).reshape(-1, 2), np.array(shares))


def search(forest: list[Tree], q: np.ndarray, share: float, far_enough: float = np.inf) -> list[int]:
    """Leaves to visit, as leaf * trees + tree: one queue for all trees, least distance from a passed split first.

    All rows behind a split are at least as far as the split.  The search ends when
    that distance reaches ``far_enough``, when the leaves' shares sum to ``share`` of
    the rows, or at the last leaf.
    """
    queue = [(0.0, t, 0 if len(tree.child) else -1) for t, tree in enumerate(forest)]
    margins = [tree.normal @ q - tree.offset for tree in forest]
    found, seen = [], 0.0
    while queue and seen < share:
        far, t, node = heapq.heappop(queue)
        if far > 0 and far >= far_enough:
            break
        tree, margin = forest[t], margins[t]
        while node >= 0:
            m = margin[node]
            near, other = tree.child[node] if m <= 0 else tree.child[node][::-1]
            heapq.heappush(queue, (max(far, abs(m)), t, int(other)))
            node = int(near)
        found.append((-1 - node) * len(forest) + t)
        seen += tree.share[-1 - node]
    return found


def reach(q: np.ndarray, ids: np.ndarray, points: np.ndarray, point_ids: np.ndarray, k: int) -> np.ndarray:
    """Distance of each query's k-th nearest other row of the sample, which its k-th nearest of all rows never passes; infinite where the sample has fewer."""
    if len(points) <= k:
        return np.full(len(q), np.inf)
    s = q @ points.T
    s[ids[:, None] == point_ids[None, :]] = -np.inf
    kth = np.partition(s, len(points) - k, axis=1)[:, len(points) - k]
    return np.sqrt(np.maximum(0.0, 2 - 2 * kth))


def nearest(vectors: DataFrame, k: int = 5, divisor: int = 50, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, share: float = SHARE, bound: float = BOUND, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest rows found, by cosine.

    The forest is fitted on the ``sample`` rows of least hash, a fixed bound,
    and broadcast.  Every row is indexed: each partition sorts its rows into the
    leaves of all trees and joins them with the queries that visit these leaves.
    A query (vec_id divisible by ``divisor``) picks its leaves from all trees
    through one priority queue, until what is left lies behind splits at ``bound``
    times the distance of its k-th nearest of the sample, of which a split sees one
    part in the root of the dimensions, or the leaves hold
    ``share`` of the rows, counted over the trees.  So vectors in clusters need few leaves,
    and those without any structure many.  All rows of a visited leaf are compared exactly;
    cosines are those of the original vectors.  Queries are
    broadcast in blocks of about ``block`` rows, each block's entries are written and its
    broadcast destroyed before the next; the index is never shuffled
    and only k rows a query leave a batch.

    Null vectors, zero vectors and those with null or non-finite components take
    no part, nor do rows without vec_id; of rows that repeat a vec_id the least
    vector counts; unlike lengths are filled with zeros.  With too few rows
    to fill k, all that the visited leaves hold is returned.
    """
    spark = vectors.sparkSession
    rows = materialize(clean(vectors).where("exists(v, x -> x != 0)"), "ann")
    schema = "query_id long, vec_id long, score double"
    out = "query_id long, rank int, vec_id long, score double"
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    is_query = F.col("vec_id") % divisor == 0
    n_queries, dim = rows.agg(F.count_if(is_query), F.max(F.size("v"))).first()
    if not n_queries:
        return spark.createDataFrame([], out)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow()
    rng = np.random.default_rng(seed)
    points = unit(floats(picked["v"].combine_chunks(), dim))
    forest = spark.sparkContext.broadcast([grow(points, leaf, rng) for _ in range(trees)])
    sampled = spark.sparkContext.broadcast((points, picked["vec_id"].to_numpy()))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                q = unit(floats(b.column(1), dim))
                far = bound / np.sqrt(dim) * reach(q, b.column(0).to_numpy(), *sampled.value, k)
                found = [search(forest.value, x, share, d) for x, d in zip(q, far.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int32()))], names=["vec_id", "v", "leaves"])

    kind = rows.schema["v"].dataType.simpleString()
    visits = materialize(rows.where(is_query).mapInArrow(visit, f"vec_id long, v {kind}, leaves array<int>"), "ann")
    sampled.destroy()
    n_blocks, folder = -(-n_queries // block), fresh_path(spark, "ann-entries")
    for at in range(n_blocks):
        mine = visits.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == at).toArrow()
        if not len(mine):
            continue
        by_leaf: dict[int, list[int]] = defaultdict(list)
        for i, found in enumerate(mine["leaves"].to_pylist()):
            for x in found:
                by_leaf[x].append(i)
        sent = spark.sparkContext.broadcast((mine["vec_id"].to_numpy(), floats(mine["v"].combine_chunks(), dim), {x: np.array(i, np.int32) for x, i in by_leaf.items()}))

        def rerank(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, queries, by_leaf = sent.value
            for b in batches:
                q, r, s = compare(forest.value, ids, queries, by_leaf, b.column(0).to_numpy(), floats(b.column(1), dim), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(b.column(0).to_numpy()[r]), pa.array(s)], names=["query_id", "vec_id", "score"])

        top = rows.mapInArrow(rerank, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        sent.destroy()
    forest.destroy()
    release(rows)
    release(visits)
    return spark.read.schema(out).parquet(folder)


def compare(forest: list[Tree], ids: np.ndarray, queries: np.ndarray, by_leaf: dict[int, np.ndarray], vec: np.ndarray, v: np.ndarray, k: int, read: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, row place, cosine) of the k best rows a query among those in the leaves it visits; read: gets the number of pairs compared."""
    q_unit, v_unit, trees = unit(queries), unit(v), len(forest)
    floor, found = np.full(len(ids), -2.0), []

    def exact(q: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = cosines(queries[q], v[r])
        keep = best(q, s, vec[r], k)
        return q[keep], r[keep], s[keep]

    for t, tree in enumerate(forest):
        at = tree.leaves(v_unit)
        o = np.argsort(at, kind="stable")
        for group in np.split(o, np.flatnonzero(np.diff(at[o])) + 1):
            who = by_leaf.get(int(at[group[0]]) * trees + t) if len(group) else None
            if who is None:
                continue
            if read is not None:
                read.append(len(who) * len(group))
            for i in range(0, len(who), 1024):
                for j in range(0, len(group), 4096):
                    w, g = who[i : i + 1024], group[j : j + 4096]
                    s = q_unit[w] @ v_unit[g].T
                    s[ids[w][:, None] == vec[g][None, :]] = -9.0  # not its own row
                    low = floor[w]
                    if len(g) >= k:
                        low = np.maximum(low, np.partition(s, len(g) - k, axis=1)[:, len(g) - k])
                        floor[w] = low
                    a, c = np.nonzero(s >= np.maximum(low, -2.0)[:, None] - 1e-9)
                    found.append((w[a], g[c]) if len(a) < 50_000 else exact(w[a], g[c])[:2])
    if not found:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0)
    q, r = (np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))
    one = np.unique(q * len(vec) + r)  # a row may share leaves of several trees
    return exact(one // len(vec), one % len(vec))
