"""Connected components of an edge table, in rounds of star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.io import materialise
from tidemark.llm.spread import salts_of, spread_join


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node reachable from it.

    Each round hangs the larger neighbours of a node on the smallest (large star), then all smaller ones (small star);
    the rounds grow with the logarithm of a component's size. Every round is written to the shared folder. Aggregates
    that combine before a shuffle, and joins under salted keys, stand in for grouping a node's neighbours, so that a node
    with very many of them never meets one task. Self-links, repeated and reversed edges count once; nulls are dropped;
    an empty table gives no rows.
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(most_rounds):
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark or not new[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
        mark = new
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), salts_of("v").alias("_salts"))
        large = spread_join(both.where("v > u"), low, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), salts_of("v").alias("_salts"))
        small = spread_join(large, least, ["u"], "v").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        now = materialise(small, "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
