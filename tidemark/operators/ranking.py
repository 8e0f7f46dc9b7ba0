"""Order-dependent totals over whole tables without a window that gathers every row in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import checkpointed


#: Rows that a bucket of a running total holds, and buckets at least and at most.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 500_000, 32, 8192


def bucket_of(value: Column, cuts: list[float]) -> Column:
    """How many cuts lie below value, by halving; 0 for null."""

    def half(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(value > cuts[m], half(m + 1, b)).otherwise(half(a, m))

    return F.when(value.isNotNull(), half(0, len(cuts))).otherwise(0)


def range_cuts(df: DataFrame, value: Column, buckets: int | None = None) -> list[float]:
    """Cuts of value into about equal shares of the rows; their number follows the rows, so that buckets stay of one size."""
    k = buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, df.count() // BUCKET_ROWS))
    return sorted(set(df.agg(F.percentile_approx(value, [i / k for i in range(1, k)], max(1000, 10 * k))).first()[0] or []))


def running_sum(df: DataFrame, value: str, key: str, descending: bool = True, out: str = "running", buckets: int | None = None) -> DataFrame:
    """Adds the running sum of value in the order (value, key), including the row itself, and `out`_total.

    Rows go to range buckets of value by approximate quantiles; any cuts give the same sums. Inside a bucket a window
    adds up; a bucket that one value fills is split by ranges of key, so that its parts hold about BUCKET_ROWS rows as well.
    The totals of earlier buckets, one row each, are broadcast; their number is at most about MOST_BUCKETS. Nulls count as 0 and
    come last.
    """
    df = checkpointed(df)
    v = F.coalesce(F.col(value), F.lit(0).cast(df.schema[value].dataType))
    cuts = range_cuts(df, v.cast("double"), buckets)
    bucket = bucket_of(v.cast("double"), cuts)
    keyed = df.withColumn("_b", -bucket if descending else bucket).withColumn("_v", v)
    full = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where((F.col("_lo") == F.col("_hi")) & (F.col("_n") > BUCKET_ROWS))
    most = full.agg(F.max("_n")).first()[0]
    if most is None:
        keyed = keyed.withColumn("_s", F.lit(0))
    else:  # a value that fills buckets splits by its keys
        k = min(MOST_BUCKETS, -(-most // BUCKET_ROWS))
        parts = keyed.join(F.broadcast(full.select("_b")), "_b").groupBy("_b").agg(F.percentile_approx(key, [i / k for i in range(1, k)] or [0.5], max(1000, 10 * k)).alias("_k"))
        keyed = keyed.join(F.broadcast(parts), "_b", "left").withColumn("_s", F.when(F.col("_k").isNull(), 0).otherwise(F.size(F.filter("_k", lambda c: c < F.col(key))))).drop("_k")
    totals = keyed.groupBy("_b", "_s").agg(F.sum("_v").alias("_t"))
    before = totals.select("_b", "_s", (F.sum("_t").over(Window.orderBy("_b", "_s")) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy()).alias(f"{out}_total"))
    order = [F.col("_v").desc() if descending else F.col("_v").asc(), F.col(key).asc()]
    inside = Window.partitionBy("_b", "_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(F.broadcast(before), ["_b", "_s"]).withColumn(out, F.sum("_v").over(inside) + F.col("_before")).drop("_b", "_s", "_v", "_before")


def _share(part: Column) -> Column:
    """part of the running total as doubles: sums are decimals of 38 digits, whose quotient Spark would round to six places."""
    return part.cast("double") / F.col("running_total").cast("double")


def abc_inclusive(df: DataFrame, value: str, key: str, a: float = 0.80, b: float = 0.95) -> DataFrame:
    """Class by the cumulative share including the item; `unknown` for all when the total is not positive."""
    share = _share(F.col("running"))
    label = F.when(F.col("running_total") <= 0, "unknown").when(share <= a, "A").when(share <= b, "B").otherwise("C")
    return running_sum(df, value, key).withColumn("abc", label).drop("running", "running_total")


def abc_exclusive(df: DataFrame, value: str, key: str, a: float = 0.80, b: float = 0.95) -> DataFrame:
    """Class by the cumulative share before the item; items without positive value are C."""
    positive = F.when(F.col(value) > 0, F.col(value)).otherwise(F.lit(0).cast(df.schema[value].dataType))
    share = _share(F.col("running") - F.col("_pos"))
    label = F.when((F.col("running_total") <= 0) | (F.col("_pos") <= 0), "C").when(share < a, "A").when(share < b, "B").otherwise("C")
    return running_sum(df.withColumn("_pos", positive), "_pos", key).withColumn("abc", label).drop("running", "running_total", "_pos")


def average_rank(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the rank of value with ties sharing their mean rank, from a running count over distinct values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_n"))
    # one row per distinct value; the running count orders by the value itself
    ranked = _running_count(counts, value)
    return df.join(ranked.select(value, (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out)), value)


def _running_count(counts: DataFrame, value: str, buckets: int | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """Adds _upto, the running sum of _n in the order of value, and those of other columns, more as {column: name}."""
    counts, named = checkpointed(counts), {"_n": "_upto"} | (more or {})
    cuts = range_cuts(counts, F.col(value).cast("double"), buckets)
    keyed = counts.withColumn("_b", bucket_of(F.col(value).cast("double"), cuts))
    totals = keyed.groupBy("_b").agg(*[F.sum(x).alias(f"_t{x}") for x in named])
    before = totals.select("_b", *[(F.sum(f"_t{x}").over(Window.orderBy("_b")) - F.col(f"_t{x}")).alias(f"_before{x}") for x in named])
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    df = keyed.join(F.broadcast(before), "_b")
    return df.withColumns({out: F.sum(x).over(inside) + F.col(f"_before{x}") for x, out in named.items()}).drop("_b", *[f"_before{x}" for x in named])


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given full order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
