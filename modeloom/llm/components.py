"""Connected components of a graph that no machine holds, by large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modeloom.llm.frames import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Each node links its neighbours (all larger ones, or all smaller ones and itself) to the least of all of them."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    linked = both.join(least, "a")
    if small:
        moved = linked.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(least.select("a", F.col("low").alias("b")))
    else:
        moved = linked.filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.filter("a > b").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of the edges (a, b), which are longs; root is the component's least node."""
    state = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    mark = None
    for _ in range(rounds):
        state = cut(_star(_star(state, small=False), small=True))
        now = tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components not found in {rounds} rounds")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
