"""Peer bands, floors, recommended prices and discounts for all products at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import grouped_quantiles, key_sizes
from tidemark.sources.sinks import checkpointed

MAD_K, MAD_SCALE, MAD_ROWS = 3.5, 1.4826, 4


def mad_kept(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df without outliers: rows further than k scaled MADs from the group's median; thin or flat groups keep all.

    The rows are written once with their group's median and read for the rest. Both medians are exact, also of a group with most of the rows.
    """
    df = checkpointed(df)
    sizes = key_sizes(df, keys)
    med = grouped_quantiles(df, keys, value, [0.5], sizes=sizes, more=(F.count(F.lit(1)).alias("_rows"),)).withColumn("_med", F.col("q")[0]).drop("q")
    far = checkpointed(df.join(med, keys).withColumn("_far", F.abs(F.col(value) - F.col("_med"))).drop("_med"))
    mad = grouped_quantiles(far.where(F.col("_rows") >= MAD_ROWS), keys, "_far", [0.5], sizes=sizes).select(*keys, F.col("q")[0].alias("_mad"))
    keep = F.col("_mad").isNull() | (F.col("_mad") <= 0) | (F.col("_far") <= MAD_K * MAD_SCALE * F.col("_mad"))
    return far.join(mad, keys, "left").where(keep).drop("_rows", "_far", "_mad")


def peer_band(sales: DataFrame) -> DataFrame:
    """P25, P50, P75 of trimmed line prices and the number of distinct buyers per product."""
    kept = checkpointed(mad_kept(sales.where("price > 0").select("product_id", "agreement_id", "price"), ["product_id"], "price"))
    q = grouped_quantiles(kept, ["product_id"], "price", [0.25, 0.5, 0.75], more=(F.countDistinct("agreement_id").alias("n"),))
    return q.select("product_id", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "n")


def unit_cost(lots: DataFrame) -> DataFrame:
    """Median cost of lots with stock, else the newest lot's; lot count and where the cost comes from."""
    clean = F.when((F.col("unit_cost") > 0) & (F.col("qty") > 0), F.col("unit_cost"))
    lots = checkpointed(lots.select("product_id", "lot_id", "unit_cost", clean.alias("clean")))
    last = lots.groupBy("product_id").agg(F.max_by("unit_cost", "lot_id").alias("last_cost"), F.count("clean").alias("lot_count"))
    agg = last.join(grouped_quantiles(lots, ["product_id"], "clean", [0.5]).select("product_id", F.col("q")[0].alias("median_cost")), "product_id", "left")
    source = F.when(F.col("median_cost").isNotNull(), "median_lots").when(F.col("last_cost").isNotNull(), "latest_lot").otherwise("none")
    return agg.select("product_id", F.coalesce("median_cost", "last_cost").alias("unit_cost_eur"), "lot_count", source.alias("cost_source"))


def recommended(floor: Column, p50: Column, baseline: Column) -> tuple[Column, Column]:
    """(price, rationale): the larger of floor and peer median, never above the baseline; a floor above it is a loss flag."""
    target = F.greatest(floor, p50)  # greatest skips nulls
    bound = F.least(target, baseline)
    price = (
        F.when(baseline <= 0, F.lit(None).cast("double"))
        .when(floor > baseline, floor)
        .when(target.isNull(), baseline)
        .otherwise(bound)
    )
    why = (
        F.when(baseline <= 0, "no-baseline")
        .when(floor > baseline, "below-margin-loss-flag")
        .when(target.isNull() & baseline.isNotNull(), "at-baseline")
        .when(target.isNull(), "no-anchor")
        .when(bound <= floor, "margin-floor")
        .when(bound >= baseline, "at-baseline")
        .otherwise("peer-median")
    )
    return price, why


def discount(price: Column, list_price: Column) -> Column:
    return F.when(list_price > 0, (1 - price / list_price) * 100)


def capped(raw: Column, p75: Column, p90: Column) -> tuple[Column, Column]:
    cap = F.least(p75, p90)
    floored = F.greatest(raw, F.lit(0.0))
    return F.when(raw.isNull(), None).when(floored > cap, cap).otherwise(floored), F.coalesce(floored > cap, F.lit(False))


def confidence(lots: Column, peers: Column, cost: Column, baseline: Column) -> Column:
    low = baseline.isNull() | (baseline <= 0) | cost.isNull() | (peers < 3)
    return F.when(low, "low").when((lots >= 3) & (peers >= 10), "high").otherwise("medium")


def recommend(pairs: DataFrame, peers: DataFrame, costs: DataFrame, segments: DataFrame, margin_pct: float = 15.0) -> DataFrame:
    """pairs (product_id, agreement_id, group_id, baseline, list_price) with price, discount, band, confidence, rationale."""
    df = pairs.join(peers, "product_id", "left").join(costs, "product_id", "left").join(segments, "group_id", "left")
    df = df.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("lot_count", F.coalesce("lot_count", F.lit(0)))
    floor = F.col("unit_cost_eur") * (1 + margin_pct / 100)
    price, why = recommended(floor, F.col("p50"), F.col("baseline"))
    df = df.withColumns({"price_floor": floor, "recommended_price": price, "_why": why})
    cut, was = capped(discount(F.col("recommended_price"), F.col("list_price")), F.col("seg_p75"), F.col("seg_p90"))
    low = F.greatest(F.coalesce(discount(F.col("price_floor"), F.col("list_price")), F.lit(0.0)), F.lit(0.0))
    high = F.coalesce("seg_p90", "seg_p75", F.lit(0.0))
    df = df.withColumns({"suggested_discount_pct": cut, "_was": was, "_a": F.least(low, high), "_b": F.greatest(low, high)})
    target = F.least(F.greatest(F.coalesce("suggested_discount_pct", F.lit(0.0)), F.col("_a")), F.col("_b"))
    rationale = F.when(F.col("_was") & (F.col("_why") == "peer-median"), "discount-cap").otherwise(F.col("_why"))
    margin = F.when(F.col("recommended_price") > 0, (F.col("recommended_price") - F.col("unit_cost_eur")) / F.col("recommended_price") * 100)
    return df.select("product_id", "agreement_id", "recommended_price", "price_floor", "suggested_discount_pct", F.col("_a").alias("band_min"), target.alias("band_target"), F.col("_b").alias("band_max"), confidence(F.col("lot_count"), F.col("n"), F.col("unit_cost_eur"), F.col("baseline")).alias("confidence"), margin.alias("margin_pct"), rationale.alias("rationale"))


def elastic_price(e: Column, cost: Column) -> Column:
    """Cost times e / (e - 1) for a sane e above 1."""
    return F.when((e > 1.0) & (e <= 5.0), cost * e / (e - 1))


def pooled_slope(df: DataFrame, key: str, effects: list[str], settled: float = 1e-8, most: int = 200) -> DataFrame:
    """(key, slope, n) of y on x after the means of each effect inside a key are swept out by turns, until no slope moves by
    more than `settled`; with `most` sweeps done and slopes still moving it is an error. A sweep is an aggregate and a join
    per effect, so that a large group never lands in one task."""
    df, before = checkpointed(df), None
    for i in range(1, most + 1):
        for e in effects:
            means = df.groupBy(key, e).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
            df = df.join(means, [key, e]).withColumns({"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my")}).drop("_mx", "_my")
        if i % 4:
            continue
        df = checkpointed(df)
        now = checkpointed(df.groupBy(key).agg(F.regr_slope("y", "x").alias("slope"), F.count(F.lit(1)).alias("n")))
        if before is not None:
            moved = now.join(before.select(key, F.col("slope").alias("old")), key).agg(F.max(F.abs(F.col("slope") - F.col("old")))).first()[0]
            if moved is None or moved <= settled:
                return now
        before = now
    raise RuntimeError(f"slopes still move after {most} sweeps")
