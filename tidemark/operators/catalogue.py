"""Product links, substitutes, price tiers and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import first_per
from tidemark.sources.sinks import checkpointed

#: Part numbers that mean none.
JUNK_NUMBERS = ("", "-", "0", "n/a")
#: Products of a number that meet in one key, and links that one task makes.
BLOCK, LINKS_A_TASK = 10_000, 20_000_000


def curated(pairs: DataFrame) -> DataFrame:
    """(product_id, other_id, curated) of the curated links in both directions."""
    both = pairs.select("product_id", "other_id").union(pairs.select(F.col("other_id"), F.col("product_id"))).distinct()
    return both.where("product_id <> other_id").withColumn("curated", F.lit(1))


def numbered(products: DataFrame, least_length: int = 4) -> DataFrame:
    """(product_id, k): products with a cleaned number that means one."""
    clean = products.select("product_id", F.lower(F.trim("number")).alias("k"))
    return clean.where((F.length("k") >= least_length) & ~F.col("k").isin(*JUNK_NUMBERS))


def links(pairs: DataFrame, products: DataFrame, least_length: int = 4) -> DataFrame:
    """(product_id, other_id, curated): curated links in both directions, and products of the same cleaned number; curated wins.

    Links of a number are as many as the square of its products, so they are not shuffled: the others of a number come to each product
    as an array, beside its curated links, which are left out there. A number's products are dealt to blocks of about BLOCK, and each
    two blocks are a key of their own. Two products with several numbers in common are linked by the first.
    """
    known = curated(pairs)
    before = Window.partitionBy("product_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    clean = checkpointed(numbered(products, least_length).distinct().withColumn("_less", F.collect_list("k").over(before)))
    sizes = checkpointed(clean.groupBy("k").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    tasks = 1 + (sizes.agg(F.sum(F.col("_n") * F.col("_n"))).first()[0] or 0) // LINKS_A_TASK
    dealt = clean.join(sizes, "k").withColumn("_n", F.ceil(F.col("_n") / BLOCK)).withColumn("_own", F.pmod(F.xxhash64("product_id"), F.col("_n")))
    every, keys = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)), ["k", "_a", "_b"]
    asking = dealt.join(known.groupBy("product_id").agg(F.collect_set("other_id").alias("_known")), "product_id", "left").select("product_id", "_known", "_less", "k", F.col("_own").alias("_a"), every.alias("_b"))
    others = dealt.select("k", every.alias("_a"), F.col("_own").alias("_b"), F.struct(F.col("product_id").alias("other_id"), F.col("_less").alias("_also")).alias("_x"))
    others = others.groupBy(*keys).agg(F.collect_list("_x").alias("_met"))
    met = asking.repartition(tasks, *keys).join(others.repartition(tasks, *keys), keys).select("product_id", "_known", "_less", F.inline("_met"))
    new = ~F.coalesce(F.array_contains("_known", F.col("other_id")), F.lit(False)) & ~F.arrays_overlap("_less", "_also")
    same = met.where((F.col("product_id") != F.col("other_id")) & new).select("product_id", "other_id", F.lit(0).alias("curated"))
    return known.unionByName(same)


def best_substitutes(pairs: DataFrame, products: DataFrame, health: DataFrame, most: int = 5, least_length: int = 4) -> DataFrame:
    """`substitutes` of `links` without all links of a number: of its products the first most + 1 suffice for each, since at most
    one of them is the product itself, and being curated as well only moves another one forward."""
    clean = numbered(products, least_length)
    others = clean.select(F.col("product_id").alias("other_id"), "k").join(health.select(F.col("product_id").alias("other_id"), "qty_on_hand", "health"), "other_id")
    first = first_per(others, ["k"], preferred(), most + 1).select("k", "other_id")
    same = clean.join(first, "k").where("product_id <> other_id").select("product_id", "other_id", F.lit(0).alias("curated"))
    link = curated(pairs).unionByName(same).groupBy("product_id", "other_id").agg(F.max("curated").alias("curated"))
    return substitutes(link, health, most)


def preferred(*before_id: Column) -> list[Column]:
    return [F.desc(F.col("qty_on_hand") > 0), F.desc("health"), F.desc("qty_on_hand"), *before_id, F.col("other_id")]


def substitutes(link: DataFrame, health: DataFrame, most: int = 5) -> DataFrame:
    """The best substitutes per product: in stock, health, quantity, link source, id."""
    df = link.join(health.select(F.col("product_id").alias("other_id"), "qty_on_hand", "health"), "other_id")
    return first_per(df, ["product_id"], preferred(F.desc("curated")), most)


def tier_roots(tiers: DataFrame) -> DataFrame:
    """(pricing_id, root_id, extra): the top of each tier's chain and the tier's own extra charge. The table of price tiers is
    small; chains of any depth are followed to their end, and one that never ends is an error."""
    most = tiers.count()
    now = tiers.select("pricing_id", F.col("pricing_id").alias("root_id"), F.col("parent_id").alias("up"), "extra")
    step = tiers.select(F.col("pricing_id").alias("up"), F.col("parent_id").alias("up2"))
    for _ in range(most + 1):
        if now.where("up is not null").isEmpty():
            return now.select("pricing_id", "root_id", "extra")
        now = checkpointed(now.join(step, "up", "left").select("pricing_id", F.coalesce("up", "root_id").alias("root_id"), F.col("up2").alias("up"), "extra"))
    raise RuntimeError("a price tier is its own ancestor")


def tier_prices(prices: DataFrame, tiers: DataFrame, overrides: DataFrame, groups: DataFrame) -> DataFrame:
    """(product_id, pricing_id, root_id, extra, price): the price at the tier's root, marked up by the tier's own charge, or by
    the charge set for (tier, product group). prices has product_id, root_id and base; groups has product_id and group_id."""
    df = prices.join(groups, "product_id").join(tier_roots(tiers), "root_id").join(overrides.withColumnRenamed("extra", "own"), ["pricing_id", "group_id"], "left")
    extra = F.coalesce("own", "extra", F.lit(0.0))
    return df.select("product_id", "pricing_id", "root_id", extra.alias("extra"), (F.col("base") * (1 + extra / 100)).alias("price"))
