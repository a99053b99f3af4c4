"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u long, v long); root is its component's least node.

    Each round hangs every node's neighbours on the least node in sight, with
    the least node found by a partially aggregated ``min``; the number of edges
    never grows and rounds follow the logarithm of the longest path.  Every
    round is a table in the shared folder, so a lost executor costs one round.
    Loops and repeated edges are ignored; nulls take no part; no edges, no rows.
    """
    e = edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi != lo").distinct()
    e, before = materialize(e, "components"), None
    while True:
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0))).first()
        if now == before or now[0] == 0:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select("lo", "lo")).distinct()
        before = now
        both = e.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(e.select("lo", "hi"))
        least = both.groupBy("n").agg(F.least(F.min("m"), F.first("n")).alias("low"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("hi"), F.col("low").alias("lo")).where("hi != lo").distinct()
        large = materialize(large, "components")
        low = large.groupBy("hi").agg(F.min("lo").alias("low"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("low").alias("lo")).where("hi != lo").union(low).distinct()
        small = materialize(small, "components")
        release(e)
        release(large)
        e = small
