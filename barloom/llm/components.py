"""Connected components of a graph given by edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, low)``: the smallest node reachable.

    Alternates large and small stars (Kiveris et al., 2014): in each round a
    node hands its smallest neighbour on to the others, so the graph shrinks
    to stars in about log(n) rounds.  All counts are minima, which Spark
    pre-aggregates, and the joins are plain equi-joins that it may split where
    a node has very many edges.  Loops and repeated edges are allowed; null
    ends are dropped.  Nodes without an edge to another node aren't returned.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "edges")
    print_of = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())
    mark = print_of(now)
    for _ in range(rounds):
        if not mark[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lows = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(lows, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        lows = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(lows, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        new = written(small.unionByName(lows.select("u", F.col("low").alias("v"))).where("u <> v").distinct(), "edges")
        new_mark = print_of(new)
        now, done, mark = new, new_mark == mark, new_mark
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("low"))
    return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("low")).distinct())
