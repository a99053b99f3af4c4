"""Exact top-k inner products by a three-phase uniform threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh_path, materialize, release

SCALE, LISTS, BLOCK = 1024, 2, 8192
#: Rows scored at once, as numbers in one matrix of scores.
CELLS = 4_000_000
MAX, MIN = np.iinfo(np.int64).max, np.iinfo(np.int64).min + 1  # so that -MIN is a long too


def clean(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id long, v array) of the rows that take part, one row a vec_id.

    Null vectors, vectors with null or non-finite components and rows without a
    vec_id take no part.  Of rows that repeat a vec_id the least vector counts.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).alias("v"))
    ok = rows.where("vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(cast(x as double)) != double('inf'))")
    return ok.groupBy("vec_id").agg(F.min("v").alias("v"))


def floats(column: pa.ListArray, dim: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter vectors are filled with zeros, longer ones end at ``dim``."""
    if column.offset == 0 and len(column) and len(column.values) == dim * len(column):
        lengths = np.diff(column.offsets.to_numpy())
        if (lengths == dim).all():
            return column.values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)
    out = np.zeros((len(column), dim))
    for i, x in enumerate(column.to_pylist()):
        out[i, : min(dim, len(x))] = x[:dim]
    return out


def quantise(v: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): exact doubles, or Python integers where sums could pass 2**53."""
    with np.errstate(over="ignore"):
        q = np.floor(v * scale)
    big = float(np.abs(q).max(initial=0.0))
    if big * big * max(1, q.shape[1]) < 2.0**53:
        return q
    return np.frompyfunc(lambda x: math.floor(Fraction(x) * scale), 1, 1)(v)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products a @ b.T; longs, cut off at the ends of their range."""
    if a.dtype != object and b.dtype != object:
        top = float(np.abs(a).max(initial=0.0)) * float(np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
        if top < 2.0**53:
            return (a @ b.T).astype(np.int64)
    a, b = (x if x.dtype == object else np.frompyfunc(int, 1, 1)(x) for x in (a, b))
    return np.clip(a.dot(b.T), MIN, MAX).astype(np.int64) if a.size and b.size else np.zeros((len(a), len(b)), np.int64)


def best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k highest scores, ties to the smaller vec_id, in that order."""
    o = np.lexsort((vec, -score, query))
    q = query[o]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else np.zeros(0, int)
    return o[np.arange(len(q)) - start < k]


def columns_best(score: np.ndarray, vec: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query place, row place) of each query's k best rows of a score matrix (query, row)."""
    n = score.shape[1]
    if n > k:
        floor = np.partition(score, n - k, axis=1)[:, n - k]
        q, r = np.nonzero(score >= floor[:, None])
    else:
        q, r = (x.ravel() for x in np.indices(score.shape))
    keep = best(q, score[q, r], vec[r], k)
    return q[keep], r[keep]


def total(parts: list[np.ndarray]) -> np.ndarray:
    """Sums of partial scores; longs, cut off at the ends of their range."""
    if all(np.abs(p).max(initial=0) < 2**61 for p in parts):
        return sum(parts)
    return np.clip(sum(p.astype(object) for p in parts), MIN, MAX).astype(np.int64)


def pair_scores(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray, cuts: list[int]) -> np.ndarray:
    """Whole scores of given pairs alone, list by list."""
    out = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        x, y = queries[q, a:z], rows[r, a:z]
        if x.dtype == object or y.dtype == object or float(np.abs(x).max(initial=0.0)) * float(np.abs(y).max(initial=0.0)) * max(1, z - a) >= 2.0**53:
            x, y = (v if v.dtype == object else np.frompyfunc(int, 1, 1)(v) for v in (x, y))
            out.append(np.clip((x * y).sum(axis=1), MIN, MAX).astype(np.int64) if x.size else np.zeros(len(q), np.int64))
        else:
            out.append(np.einsum("ij,ij->i", x, y).astype(np.int64))
    return total(out)


def list_tops(ids: np.ndarray, queries: np.ndarray, vec: np.ndarray, rows: np.ndarray, cuts: list[int], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phase 1: (query place, row place, whole score) of the k highest entries a query in the first list of these rows.

    Only the first list's partial scores are computed for all rows; the others of its tops alone.
    """
    own = ids[:, None] == vec[None, :]
    part = product(queries[:, cuts[0] : cuts[1]], rows[:, cuts[0] : cuts[1]])
    part[own] = MIN
    q, r = columns_best(part, vec, k)
    keep = ~own[q, r]
    q, r = q[keep], r[keep]
    return q, r, pair_scores(queries, rows, q, r, cuts)


def sufficient(ids: np.ndarray, queries: np.ndarray, vec: np.ndarray, rows: np.ndarray, cuts: list[int], cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3: (query place, row place, whole score) of the entries of at least cutoff / lists in some list.

    What an entry's other lists hold of it is added to it alone.
    """
    lists = len(cuts) - 1
    least = -(-cutoff // lists)[:, None]
    parts = [product(queries[:, a:z], rows[:, a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]
    enough = parts[0] >= least
    for p in parts[1:]:
        enough |= p >= least
    enough &= ids[:, None] != vec[None, :]
    q, r = np.nonzero(enough)
    return q, r, total([p[q, r] for p in parts])


def exact_top_k(vectors: DataFrame, k: int = 10, divisor: int = 100, lists: int = LISTS, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest integer inner products.

    The components are dealt into ``lists`` score lists; a score is the sum of
    its lists' partial scores.  Phase 1: each partition of the candidates gathers
    the local tops of the first list, and the whole scores of these few entries; the k-th best of them
    over all partitions is the query's safe cutoff.  Phase 2: the cutoff goes
    to all partitions, and each takes the entries with a partial score
    of at least cutoff / lists in some list: a candidate with less in all lists
    stays below the cutoff.  Phase 3: what these entries lack is added, so their
    scores are exact, and those that reach the cutoff are merged.

    Queries (vec_id divisible by ``divisor``) are broadcast in blocks of about
    ``block`` rows, a fixed bound; a block's entries are written and its
    broadcasts destroyed before the next, and candidates never leave their
    partition but as entries.  See :func:`clean` for the rows that
    take part; vectors of unlike lengths are filled with zeros.  A query with
    fewer than k candidates returns all; an empty table no rows.  Scores outside
    the range of long end at its ends.
    """
    spark = vectors.sparkSession
    rows = materialize(clean(vectors), "topk")
    schema = "query_id long, vec_id long, score long"
    is_query = F.col("vec_id") % divisor == 0
    facts = rows.agg(F.count_if(is_query), F.max(F.size("v"))).first()
    n_blocks, dim = max(1, -(-facts[0] // block)), facts[1] or 0
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    cuts = [round(dim * i / lists) for i in range(lists + 1)]
    folder = fresh_path(spark, "topk-entries")
    for at in range(n_blocks if facts[0] else 0):
        mine = rows.where(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == at)).toArrow()
        if not len(mine):
            continue
        ids = mine["vec_id"].to_numpy()
        sent = spark.sparkContext.broadcast((ids, quantise(floats(mine["v"].combine_chunks(), dim), scale)))

        def entries(batches: Iterator[pa.RecordBatch], of, sent=sent) -> Iterator[pa.RecordBatch]:
            """The k best a query and batch of what ``of`` finds in each chunk of rows."""
            ids = sent.value[0]
            for b in batches:
                vec, v = b.column(0).to_numpy(), quantise(floats(b.column(1), dim), scale)
                step, found = max(1, CELLS // max(1, len(ids))), []
                for s in range(0, len(vec), step):
                    q, r, score = of(vec[s : s + step], v[s : s + step])
                    found.append((ids[q], vec[s : s + step][r], score))
                if found:
                    q, r, score = (np.concatenate(x) for x in zip(*found, strict=True))
                    keep = best(q, score, r, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(r[keep]), pa.array(score[keep])], names=["query_id", "vec_id", "score"])

        def gather(batches: Iterator[pa.RecordBatch], sent=sent, entries=entries) -> Iterator[pa.RecordBatch]:
            return entries(batches, lambda vec, v: list_tops(*sent.value, vec, v, cuts, k))

        ranked = rows.mapInArrow(gather, schema).withColumn("rank", F.row_number().over(order))
        cutoff = {r.query_id: r.score for r in ranked.where(F.col("rank") <= k).where(F.col("rank") == k).collect()}
        told = spark.sparkContext.broadcast(np.array([cutoff.get(i, MIN) for i in ids.tolist()], np.int64))

        def collect(batches: Iterator[pa.RecordBatch], sent=sent, told=told, entries=entries) -> Iterator[pa.RecordBatch]:
            def reach(vec: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                q, r, score = sufficient(*sent.value, vec, v, cuts, told.value)
                keep = score >= told.value[q]
                return q[keep], r[keep], score[keep]

            return entries(batches, reach)

        # At most k entries a query leave each batch of a partition.
        top = rows.mapInArrow(collect, schema).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(folder)
        sent.destroy()
        told.destroy()
    release(rows)
    out = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(out).parquet(folder) if facts[0] else spark.createDataFrame([], out)


ORACLE = """
WITH v AS (
  SELECT vec_id, min([floor(1024 * x::DOUBLE) for x in embedding]) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""
