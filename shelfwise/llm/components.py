"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.session import ensure_checkpoint_dir


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b of one type); root is the least node reachable.

    A round lets each node send its neighbours to the least node it sees, first
    those above it, then those below; the links end as stars around the roots
    after about log(n) rounds. Rounds are cut by ``checkpoint``. Links may be
    given twice, in either direction, or from a node to itself; null ends are
    ignored.
    """
    ensure_checkpoint_dir(links.sparkSession)
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct().checkpoint()
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = _cut(pairs)
    while before[0]:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs, after = _cut(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        if after == before:
            break
        before = after
    return nodes.join(pairs, nodes["node"] == pairs["u"], "left").select("node", F.coalesce("v", "node").alias("root"))


def _cut(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    pairs = pairs.checkpoint()
    row = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return pairs, tuple(row)
