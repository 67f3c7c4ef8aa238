"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changetide.llm.scratch import stored


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang neighbours of each node (the larger ones, or the smaller ones and the node) on their smallest."""
    if larger:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        hung = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        hung = hung.unionAll(least.select("u", F.col("m").alias("v"))).distinct()
    return hung.where("u > v")


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node that isn't its own root; root is the smallest node reachable.

    edges: two columns of numbers, in any direction, repeats and loops allowed; rows with a null
    take no part. Every round is stored, so a lost executor costs one round at most.
    """
    a, b = edges.columns
    pairs = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v")))
        .distinct()
    )
    before = _state(pairs)
    for _ in range(rounds):
        if before[0] == 0:
            break
        pairs = stored(_star(_star(pairs, True), False))
        now = _state(pairs)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
