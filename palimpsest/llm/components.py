"""Connected components by alternating large-star and small-star steps, each a few narrow shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a long, b long) links to (node, root): each node that has a link, with the smallest node reachable.

    The links are written before the first round. Rounds end when they no longer change; each one is written to the shared folder, so that lost
    executors cost a round at most. The minimum of a node's neighbours is combined before it is shuffled,
    and the joins are plain ones that adaptive execution can split, so a star's hot centre is no one task's. Written links are far smaller than in memory, so
    their join is a merge, whatever Spark makes of their size.
    """
    spark = edges.sparkSession
    links = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    path = scratch.write(links, "links")  # a round reads its links several times; edges are computed once
    state, before = None, scratch.load(spark, path, links)
    for _ in range(most_rounds):
        both = before.select("u", "v").unionByName(before.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = small.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(after, "links")
        after = scratch.load(spark, new, after)
        now = after.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        scratch.drop(spark, path)
        path, before = new, after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links still changed after {most_rounds} rounds")
    roots = before.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return before.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
