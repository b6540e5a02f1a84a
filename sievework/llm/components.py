"""Connected components of a graph given as edges, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import stored


def connected_components(edges: DataFrame, *, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of `edges` (a long, b long): root is the smallest node reachable.

    Alternating star operations: the large star hangs every larger neighbour of a node on the node's smallest
    neighbour, the small star does so with the smaller ones. The edges end as one star for each component, after about
    log(size) rounds. Each round is written to the shared folder, so lineage stays short and a lost executor repeats
    one round at most. A hub's edges meet in a join that adaptive execution splits, and in aggregates that combine
    before they shuffle. Nodes without edges are not in the result; loops and repeated edges do no harm.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _signature(now)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = now.union(now.select("v", "u"))
        # Stored, so that the join has an exchange of its own on either side and a hub's edges can be split.
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "minima")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        now = stored(small, "edges")
        after = _signature(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
