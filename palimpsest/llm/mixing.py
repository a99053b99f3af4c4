"""Mixing sources to target weights by nested hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release, word_count

#: A document's hash has 60 bits, read 12 at a time: 4096 buckets a level.
BITS, LEVELS = 12, 5
WEIGHTS, SHARE, LIMIT = (3, 1, 2), 1.5, 2


def doc_hash(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """60 bits of the MD5 of doc_id as text, a space and the text, as long; nulls count as empty."""
    doc_id, text = (F.col(c) if isinstance(c, str) else c for c in (doc_id, text))
    whole = F.concat(F.coalesce(doc_id.cast("long").cast("string"), F.lit("")), F.lit(" "), F.coalesce(text.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def copy_hash() -> Column:
    """60 bits that tell equal rows apart, by their place; for a table that is written with it."""
    return F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << BITS * LEVELS) - 1))


def running(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` in ``order``, with ``place`` (from 0) and each column of ``sums`` summed over the rows before, as before_*.

    Rows are sorted by ranges; the sums of ranges run on, one row a partition,
    and within a range a window adds the rest.
    """
    placed = materialize(rows.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).withColumn("_one", F.lit(1).cast("long")), "mixing").withColumn("_part", F.shiftright("_id", 33))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    each = [*sums, "_one"]
    totals = placed.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{c}") for c in each])
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_sum_{c}").over(before.orderBy("_part")), F.lit(0)).alias(f"_start_{c}") for c in each])
    at = lambda c: F.col(f"_start_{c}") + F.coalesce(F.sum(c).over(before.partitionBy("_part").orderBy("_id")), F.lit(0))
    out = placed.join(starts, "_part").select(*rows.columns, at("_one").alias("place"), *[at(c).alias(f"before_{c}") for c in sums])
    return out


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(source, source_size, target) from (source, size), one row a source.

    Sources in code-point order, null last, take ``weights`` in turn and divide
    ``share`` of all sizes.  A target stops at ``limit`` times its source's size
    and the excess goes to the others by weight.  Sources stop in the order of
    size by weight, so the first that needs no stop, in that order, tells the
    level for all after it: running sums give it without iteration, by ranges,
    so sources may be as many as rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = running(per, [F.col("source").asc_nulls_last()], [])
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    stops = named.select("source", "source_size", w.alias("w"), (F.lit(limit) * F.col("source_size")).cast("long").alias("cap"))
    ranked = running(stops, [F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()], ["w", "cap"])
    whole = ranked.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    level = (F.lit(share) * F.col("all_size") - F.col("before_cap")) / (F.col("all_w") - F.col("before_w"))
    levels = materialize(ranked.crossJoin(F.broadcast(whole)).withColumn("level", level), "mixing")  # one row on the right
    free = levels.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min_by("level", F.struct(F.col("source_size") / F.col("w"), "place")).alias("free"))
    target = F.when(F.col("free") * F.col("w") < F.col("cap"), F.col("free") * F.col("w")).otherwise(F.col("cap").cast("double"))
    return levels.crossJoin(F.broadcast(free)).select("source", "source_size", target.alias("target"))


def thresholds(docs: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, source_size, target, whole, cut, tie): each document is taken ``whole`` times, and once more where (h, copy) is below (cut, tie).

    docs: (source, size, h, copy), a table.  Each level sums sizes by source and hash
    bucket within the bucket that holds the budget's end, so the first level
    reads all documents and each further one a 4096th of them.  It ends when the
    boundary bucket holds one row.  Where it holds rows of one hash, which are equal
    in doc_id and text, levels over ``copy`` go on within it.  The last bucket is taken if that
    comes nearer the budget.
    """
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    now = goal.withColumn("whole", F.floor(rate).cast("long")).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    now = materialize(now.withColumn("cut", F.lit(0).cast("long")).withColumn("tie", F.lit(0).cast("long")).withColumn("open", F.lit(1)), "mixing")  # open: 1 by h, 2 by copy, 0 done
    for key, at in (("h", "cut"), ("copy", "tie")):
        phase = 1 if key == "h" else 2
        for level in range(LEVELS):
            if not now.where(F.col("open") == phase).limit(1).count():
                break
            width = BITS * (LEVELS - 1 - level)
            part = F.shiftright(key, width).alias("bucket")
            same = F.col("d.source").eqNullSafe(F.col("n.source")) & (F.shiftright(F.col(f"d.{key}"), width + BITS) == F.shiftright(F.col(f"n.{at}"), width + BITS))
            if phase == 2:
                same &= F.col("d.h") == F.col("n.cut")
            within = docs.alias("d").join(now.where(F.col("open") == phase).alias("n"), same)
            bars = within.groupBy(F.col("d.source").alias("source"), part).agg(F.sum("size").alias("tokens"), F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows"))
            upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))  # at most 4096 rows a source
            bars = bars.withColumn("before", upto - F.col("tokens")).alias("b").join(now.alias("n"), F.col("b.source").eqNullSafe(F.col("n.source")))
            edge = bars.where("before <= left and left < before + tokens").groupBy(F.col("n.source").alias("source")).agg(*[F.min_by(c, "bucket").alias(c) for c in ("bucket", "before", "tokens", "low", "high", "rows")])
            deepest = F.lit(level == LEVELS - 1) | (F.col("low") == F.col("high"))
            copies = deepest & (F.col("rows") > 1) & F.lit(phase == 1)
            last = deepest & ~copies
            take = F.col("left") - F.col("before") > F.col("before") + F.col("tokens") - F.col("left")
            joined = now.alias("n").join(edge.alias("e"), F.col("n.source").eqNullSafe(F.col("e.source")), "left")
            mine = F.col("open") == phase
            found = mine & F.col("bucket").isNotNull()
            # The budget's end lies in no bucket: it takes all (or none, where the budget is nil).
            passed = F.when(F.col("left") > 0, F.shiftleft(F.shiftright(at, width + BITS) + 1, width + BITS)).otherwise(F.col(at))
            new = F.when(~mine, F.col(at)).when(~found, passed).when(copies, F.col("low")).when(last, F.when(take, F.col("high") + 1).otherwise(F.col("low"))).otherwise(F.shiftleft("bucket", width))
            state = F.when(~mine, F.col("open")).when(~found | last, 0).when(copies, 2).otherwise(F.lit(phase))
            kept = F.when(found & ~last, F.col("left") - F.col("before")).otherwise(F.col("left"))
            was = now
            now = materialize(joined.select("n.source", "source_size", "target", "whole", kept.alias("left"), *[(new if c == at else F.col(c)).alias(c) for c in ("cut", "tie")], state.alias("open")), "mixing")
            release(was)
    return now


def _taken() -> Column:
    """How often a row is taken, from its hashes and its source's thresholds."""
    once = (F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (F.col("copy") < F.col("tie")))
    return F.col("whole") + once.cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of ``docs``.

    A document is taken whole, as often as its source's rate says (0, 1 or 2
    times), so ``taken`` is a multiple of ``size`` and at most ``limit`` times
    it, and a source's sum misses its target by at most half a document.  Texts
    that are null or have no words have size 0; a null source is a source;
    rows that repeat a doc_id, or have none, differ by their text; of rows equal in
    both, any are taken, always as many; no rows or no words at all: targets 0.  Only
    doc_id, source and text are read.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), doc_hash().alias("h"), copy_hash().alias("copy")), "mixing")
    cuts = thresholds(rows, materialize(targets(rows, weights, share, limit), "mixing"))
    out = rows.alias("d").join(cuts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return out.select("d.doc_id", "size", "source_size", "target", (F.col("size") * _taken()).alias("taken"))


def apply_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    The rows are written once with their hashes, so that thresholds and rows
    agree; texts are not shuffled while the sources' table is small.
    """
    named = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: F.col(n) for c, n in zip(docs.columns, named, strict=True)}
    rows = docs.toDF(*named)
    whole = materialize(rows.select(*named, at["source"].cast("string").alias("source"), word_count(at["text"].cast("string")).alias("size"), doc_hash(at["doc_id"], at["text"]).alias("h"), copy_hash().alias("copy")), "mixing")
    narrow = whole.select("source", "size", "h", "copy")
    cuts = thresholds(narrow, materialize(targets(narrow, weights, share, limit), "mixing"))
    out = whole.alias("d").join(cuts.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return out.withColumn("again", F.explode(F.array_repeat(F.lit(0), _taken().cast("int")))).select(*[c.alias(name) for name, c in at.items()])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM d GROUP BY source),
l AS (
  SELECT a.source, a.source_size, a.w,
         (1.5 * (SELECT sum(source_size) FROM s)::DOUBLE - coalesce((SELECT sum(2 * b.source_size) FROM s b WHERE b.source_size::DOUBLE / b.w < a.source_size::DOUBLE / a.w), 0)::DOUBLE)
         / (SELECT sum(b.w) FROM s b WHERE b.source_size::DOUBLE / b.w >= a.source_size::DOUBLE / a.w)::DOUBLE AS level
  FROM s a),
f AS (SELECT arg_min(level, source_size::DOUBLE / w) AS free FROM l WHERE level * w <= 2 * source_size),
g AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, free::DOUBLE * w) AS target FROM l, f),
r AS (
  SELECT d.*, g.source_size, g.target, floor(g.target / nullif(g.source_size, 0))::BIGINT AS whole,
         sum(size) OVER (PARTITION BY d.source ORDER BY h)::BIGINT AS upto,
         sum(size) OVER (PARTITION BY d.source, h)::BIGINT AS own
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (coalesce(whole, 0) + CASE WHEN target - whole * source_size > 0
            AND (upto <= target - whole * source_size OR (target - whole * source_size) - (upto - own) > upto - (target - whole * source_size))
            THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
