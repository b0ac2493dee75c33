"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.store import staged


def _star(pairs: DataFrame, smaller: bool) -> DataFrame:
    """Points the neighbours of every node at the smallest of them; `smaller` for those below the node, else those above."""
    both = pairs if smaller else pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    keep = joined.where("v > u" if not smaller else "v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if smaller:
        keep = keep.union(least.select("u", F.col("m").alias("v")))
    return keep.where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """Links (a long, b long) to rows (node, component): the smallest node reachable, for every node that has a link.

    Null ends and self-links are dropped; repeated links count once; no links give no rows. Each round is written to
    the shared folder. A hot node costs one row a neighbour and its minimum is combined before the shuffle.
    """
    ends = links.where("a is not null and b is not null and a <> b")
    pairs = staged(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    mark = None
    while True:
        now = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == mark or not now[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", F.col("v").alias("c")).distinct())
        mark = now
        pairs = staged(_star(_star(pairs, False), True), "stars")
