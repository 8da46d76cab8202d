"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.session import cut


def _stars(pairs: DataFrame, keep_larger: bool) -> DataFrame:
    """One star step: each node ``u`` hands the least node of its neighbourhood to its neighbours.

    The least node is an aggregate that is joined back, so the neighbours of a hub are never gathered in one row.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    if keep_larger:
        out = pairs.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.filter("u <> v").distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Components of the undirected graph of ``edges``: columns ``node`` and ``component``, its least node.

    Large-star and small-star steps alternate until the edges no longer change; every round is checkpointed to the shared
    folder, so a lost executor costs one round. Rows with a null end and loops are ignored, repeated edges count once, an
    empty table gives an empty result. Nodes without any edge to another node do not appear.
    """
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
    e = cut(e.filter(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, True)
        e = cut(_stars(large, False))
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            leaves = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(leaves.select(F.col("component").alias("node"), "component").distinct())
        before = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
