"""Exact quantiles per key, also where one key holds most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import checkpointed

#: Rows of a key from which on its values are spread over tasks; ranges of such a key; keys so treated at most.
LIGHT_ROWS, RANGES, MOST_HEAVY = 1_000_000, 256, 4096


def key_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of the largest key and of all."""
    most, total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows"), F.sum("_rows")).first()
    return most or 0, total or 0


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float], light: int = LIGHT_ROWS, sizes: tuple[int, int] | None = None, more: tuple = ()) -> DataFrame:
    """keys, q, the linearly interpolated quantiles of the non-null values as an array, and more, aggregates of the rows that have
    one. Keys without one are absent.

    df is read twice or more, so it should be cheap to read; sizes are its `key_sizes`, worked out if not given. A key of up to
    `light` rows is one aggregate, which holds the counts of its distinct values. Of larger keys there are at most MOST_HEAVY
    (the bound rises with the rows to keep it so); their distinct values are counted, dealt to ranges by approximate cuts, and the
    values at the wanted places are found from the ranges' prefix counts. Both ways are exact.
    """
    there = df.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("double"))
    most, total = sizes or key_sizes(df, keys)
    at_least = max(light, total // MOST_HEAVY)
    plain = lambda t: t.groupBy(*keys).agg(F.percentile("_v", F.array(*[F.lit(p) for p in probs])).alias("q"), *more)
    if most <= at_least:
        return plain(there)
    rows = there.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = checkpointed(rows.where(F.col("_rows") > at_least))
    large = checkpointed(there.join(F.broadcast(heavy), keys).groupBy(*keys, "_v", "_rows").agg(F.count(F.lit(1)).alias("_n")))
    cuts = large.groupBy(*keys).agg(F.percentile_approx("_v", [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    dealt = large.join(F.broadcast(cuts), keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    totals = dealt.groupBy(*keys, "_b").agg(F.sum("_n").alias("_t"))
    before = totals.select(*keys, "_b", (F.sum("_t").over(Window.partitionBy(*keys).orderBy("_b")) - F.col("_t")).alias("_before"))  # a row per range
    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.join(F.broadcast(before), [*keys, "_b"]).withColumn("_upto", F.sum("_n").over(inside) + F.col("_before"))

    def value_at(place):
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col("_v")))

    parts = []
    for p in probs:
        spot = F.lit(p) * (F.col("_rows") - 1)
        low, high = value_at(F.floor(spot)), value_at(F.ceil(spot))
        share = F.max(spot - F.floor(spot))
        parts.append(low + (high - low) * share)
    spread = ranked.groupBy(*keys).agg(F.array(*parts).alias("q"))
    if more:
        spread = spread.join(there.join(F.broadcast(heavy.select(*keys)), keys).groupBy(*keys).agg(*more), keys)
    return plain(there.join(F.broadcast(heavy.select(*keys)), keys, "left_anti")).unionByName(spread)
