"""Product health: cover bands, lifecycle, scores and actions for every product at once."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp
from tidemark.operators import ranking, timeseries as ts
from tidemark.sources.sinks import checkpointed

#: Score tables by label.
BAND = {"healthy": 1.0, "understock": 0.6, "overstock": 0.4, "slow": 0.3, "dead": 0.0}
TO_ORDER = {"growing": 0.75, "new": 0.65, "mature": 0.55, "declining": 0.25, "dead": 0.0}
LIFECYCLE = {"growing": 1.0, "mature": 0.8, "new": 0.7, "declining": 0.3, "dead": 0.0}
STABILITY = {"X": 1.0, "Y": 0.6, "Z": 0.3}
ABC = {"A": 1.0, "B": 0.6, "C": 0.2}
HEALTH_WEIGHTS = {"stock": 0.25, "trend": 0.18, "margin": 0.20, "stability": 0.12, "returns": 0.03, "abc": 0.22}
DEMAND_WEIGHTS = {"abc": 0.40, "stability": 0.25, "trend": 0.20, "stock": 0.15}
MARGIN_WEIGHTS = {"margin": 0.70, "returns": 0.20, "abc": 0.10}
MARGIN_TARGET, RETURN_CAP, HIGH_RETURNS = 0.30, 0.20, 0.05


def _look_up(label: Column, table: dict[str, float], default: float = 0.5) -> Column:
    out = F.lit(default)
    for name, value in table.items():
        out = F.when(label == name, value).otherwise(out)
    return out


def cover_band(qty: Column, daily: Column, sold: Column, over: float = 180.0, under: float = 7.0, slow: float = 5.0) -> Column:
    """Days-of-cover band; nothing on hand is normal for ordering to demand."""
    return (
        F.when(qty <= 0, "order_to_demand")
        .when(~sold, "dead")
        .when(daily * 365.0 <= slow, "slow")
        .when(qty / daily > over, "overstock")
        .when(qty / daily < under, "understock")
        .otherwise("healthy")
    )


def components() -> dict[str, Column]:
    band, life, margin, rate = F.col("band"), F.col("lifecycle"), F.col("margin_pct"), F.col("return_rate")
    return {
        "stock": F.when(band == "order_to_demand", _look_up(life, TO_ORDER)).otherwise(_look_up(band, BAND)),
        "trend": _look_up(life, LIFECYCLE),
        "margin": F.when(margin.isNull(), 0.5).otherwise(clamp(margin / MARGIN_TARGET, 0.0, 1.0)),
        "stability": _look_up(F.col("xyz"), STABILITY),
        "returns": clamp(1.0 - rate / RETURN_CAP, 0.0, 1.0),
        "abc": _look_up(F.col("abc"), ABC),
    }


def weighted(weights: dict[str, float]) -> Column:
    """Weighted mean of the components on a scale of 100, one decimal."""
    parts = components()
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + parts[name] * F.lit(w)
    return F.round(100.0 * total / sum(weights.values()) + 1e-9, 1)


def actions() -> list[tuple[Column, str, Column]]:
    """The ordered rules: test, action and reasons; the first that holds counts."""
    band, margin = F.col("band"), F.col("margin_pct")
    strong, abc = F.col("demand_score") >= 70, _look_up(F.col("abc"), ABC)
    why = lambda *names: F.array(*[F.lit(n) for n in names])
    unsure = F.when(margin.isNull(), why("strong_to_order_demand", "unknown_margin")).otherwise(why("strong_to_order_demand"))
    return [
        (margin < 0, "fix_margin", why("negative_margin")),
        (F.col("return_rate") >= HIGH_RETURNS, "quality_review", why("high_returns")),
        (band == "dead", "dead_stock_review", why("dead_stock")),
        (band == "overstock", "discount_or_redistribute", why("overstock")),
        (band == "understock", "reorder_check", why("understock")),
        (band == "slow", "slow_mover_review", why("slow_mover")),
        ((band == "order_to_demand") & strong, "to_order_candidate", unsure),
        (strong & margin.isNull() & (abc >= 0.6), "margin_review", why("strong_demand", "unknown_margin")),
        (strong & margin.isNotNull() & (F.col("margin_score") >= 60) & (abc >= 0.6), "keep_push", why("strong_demand", "healthy_margin")),
        ((F.col("lifecycle") == "declining") & (F.col("demand_score") < 50), "monitor_decline", why("declining_demand")),
        (F.lit(True), "monitor", why("no_immediate_action")),
    ]


def first_rule(rules: list[tuple[Column, Column]]) -> Column:
    out = F.lit(None)
    for test, value in reversed(rules):
        out = F.when(test, value).otherwise(out)
    return out


def portfolio(sales_year: DataFrame, sales_half: DataFrame, stock: DataFrame, returns: DataFrame, as_of: str) -> DataFrame:
    """The table of all products with stock or sales: stock, demand, margin, classes, scores and action."""
    last = (date.fromisoformat(as_of) - timedelta(days=1)).isoformat()
    units = ts.densify(sales_year, "product_id", "qty", last, 12, until=as_of)
    money = sales_year.groupBy("product_id").agg(F.sum("amount").cast("double").alias("amount"), F.sum("qty").cast("double").alias("sold"))
    half = sales_half.groupBy("product_id").agg(F.sum("qty").cast("double").alias("half_qty"))
    df = stock.join(units, "product_id", "full_outer").join(money, "product_id", "left").join(half, "product_id", "left").join(returns.select("product_id", "returned_qty"), "product_id", "left")
    df = df.withColumns({"series": F.coalesce("series", F.array_repeat(F.lit(0.0), 12)), "qty_on_hand": F.coalesce("qty_on_hand", F.lit(0.0)), "eur_value": F.coalesce("eur_value", F.lit(0.0))})
    df = df.withColumns({"annual_units": F.aggregate("series", F.lit(0.0), lambda a, x: a + x), "daily": F.coalesce("half_qty", F.lit(0.0)) / 180, "sold_recently": F.coalesce(F.col("sold") > 0, F.lit(False))})
    df = df.withColumns({"avg_price": F.col("amount") / F.col("sold"), "unit_cost": F.col("eur_value") / F.nullif("qty_on_hand", F.lit(0.0))})
    df = df.withColumns({
        "band": cover_band(F.col("qty_on_hand"), F.col("daily"), F.col("sold_recently")),
        "xyz": ts.xyz(ts.interval_cv(F.col("series")), 0.3, 0.6),
        "lifecycle": ts.lifecycle(F.col("series"), F.col("sold_recently")),
        "margin_pct": F.when(F.col("avg_price") > 0, (F.col("avg_price") - F.col("unit_cost")) / F.col("avg_price")),
        "revenue_eur": F.round(F.coalesce("amount", F.lit(0.0)), 2),
        "return_rate": F.when(F.col("annual_units") > 0, F.coalesce("returned_qty", F.lit(0.0)) / F.col("annual_units")).otherwise(0.0),
    })
    df = ranking.abc_inclusive(df.withColumn("revenue_exact", F.col("revenue_eur").cast("decimal(18,2)")), "revenue_exact", "product_id")
    df = df.withColumns({"health": weighted(HEALTH_WEIGHTS), "demand_score": weighted(DEMAND_WEIGHTS), "margin_score": weighted(MARGIN_WEIGHTS)})
    rules = actions()
    df = df.withColumns({"action_label": first_rule([(t, F.lit(n)) for t, n, _ in rules]), "reasons": first_rule([(t, w) for t, _, w in rules])})
    return df.select("product_id", "qty_on_hand", "eur_value", "annual_units", "revenue_eur", "margin_pct", "return_rate", "band", "xyz", "lifecycle", "abc", "health", "demand_score", "margin_score", "action_label", "reasons", "unit_cost", "avg_price")


def overview(table: DataFrame) -> DataFrame:
    """Tallies by band, lifecycle, action, ABC and XYZ in one pass, and the grand total. Values have four decimals and scores one, so
    they sum as decimals: exactly, in whatever order."""
    keys = ["band", "lifecycle", "action_label", "abc", "xyz"]
    sets = table.groupingSets([[k] for k in keys] + [[]], *keys)
    out = sets.agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), F.sum(F.col("eur_value").cast("decimal(28,4)")).cast("double").alias("eur_value"), (F.sum(F.col("health").cast("decimal(18,1)")).cast("double") / F.count("health")).alias("avg_health"))
    return out.select(F.concat_ws(":", *[F.when(F.col(k).isNotNull(), F.concat(F.lit(k + "="), F.col(k))) for k in keys]).alias("slice"), "n", F.round("eur_value", 4).alias("eur_value"), F.round(F.col("avg_health") + 1e-9, 1).alias("avg_health"))


def stock_bands(table: DataFrame) -> DataFrame:
    """Count, value and quantity per band; every band has a row."""
    domain = table.sparkSession.createDataFrame([(b,) for b in ["order_to_demand", *BAND]], "band string")
    got = table.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("eur_value").alias("eur_value"), F.sum("qty_on_hand").alias("qty"))
    return F.broadcast(domain).join(got, "band", "left").fillna(0, ["n"]).fillna(0.0, ["eur_value", "qty"])


def deciles(table: DataFrame, value: str, k: int = 10) -> DataFrame:
    """Adds the bucket b = 1..k whose rows are floor((b-1) n / k) .. floor(b n / k) - 1 of the order (value, product_id)."""
    ones = table.withColumn("_one", F.lit(1).cast("long"))
    ranked = positions(ones, value)
    i, n = F.col("_pos") - 1, F.col("_n")
    return ranked.withColumn("bucket", F.floor(((i + 1) * k - 1) / n + 1).cast("int")).drop("_one", "_pos", "_n")


def positions(df: DataFrame, value: str) -> DataFrame:
    """Adds _pos (1..n in the order value, product_id) and _n, through range buckets."""
    df = checkpointed(df)
    cuts = ranking.range_cuts(df, F.col(value).cast("double"))
    keyed = df.withColumn("_b", ranking.bucket_of(F.col(value), cuts))
    totals = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_t"))
    before = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"), F.sum("_t").over(Window.partitionBy()).alias("_n"))
    inside = Window.partitionBy("_b").orderBy(value, "product_id")
    return keyed.join(F.broadcast(before), "_b").withColumn("_pos", F.row_number().over(inside) + F.col("_before")).drop("_b", "_before")


def spearman(table: DataFrame, x: str, y: str) -> DataFrame:
    ranked = ranking.average_rank(ranking.average_rank(table.select("product_id", x, y), x, "rx"), y, "ry")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("rho"))


def future_outcomes(snapshot: DataFrame, sales: DataFrame, returns: DataFrame) -> DataFrame:
    """snapshot with future_units, future_revenue_eur, future_returned_units, future_returned_value_eur and future_margin_eur of
    the sales and returns (each (return, line) once) of the window after it. The margin is null without a unit cost."""
    sold = sales.groupBy("product_id").agg(F.sum("qty").cast("double").alias("future_units"), F.sum("amount").cast("double").alias("_revenue"))
    once = returns.groupBy("return_id", "line_no", "product_id").agg(F.max("qty").alias("qty"), F.max("amount").alias("amount"))
    back = once.groupBy("product_id").agg(F.sum("qty").cast("double").alias("future_returned_units"), F.sum("amount").cast("double").alias("_returned"))
    df = snapshot.join(sold, "product_id", "left").join(back, "product_id", "left").fillna(0.0, ["future_units", "_revenue", "future_returned_units", "_returned"])
    net = F.greatest(F.lit(0.0), F.col("_revenue") - F.col("_returned"))
    margin = net - F.greatest(F.lit(0.0), F.col("future_units") - F.col("future_returned_units")) * F.col("unit_cost")
    out = {"future_revenue_eur": F.col("_revenue"), "future_returned_value_eur": F.col("_returned"), "future_margin_eur": margin}
    return df.withColumns({k: F.round(v + 1e-9, 2) for k, v in out.items()}).drop("_revenue", "_returned")


def lift(table: DataFrame, value: str, outcomes: list[str], tail: float = 0.2) -> DataFrame:
    """(outcome, lift): mean outcome of the upper tail over that of the lower one, in the order (value, product_id)."""
    ranked = positions(table, value)
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * tail))
    marked = ranked.select(*outcomes, F.when(F.col("_pos") <= k, "low").when(F.col("_pos") > F.col("_n") - k, "high").alias("side"))
    mean = lambda side, c: F.avg(F.when(F.col("side") == side, F.coalesce(F.col(c), F.lit(0.0))))
    one = marked.agg(*[(mean("high", c) / F.nullif(mean("low", c), F.lit(0.0))).alias(c) for c in outcomes])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("outcome"), F.col(c).alias("lift")) for c in outcomes])).alias("x")).select("x.outcome", "x.lift")


def attach_meta(rows: DataFrame, catalogue: DataFrame, key: str = "product_id") -> DataFrame:
    """rows with the catalogue's columns; products it lacks keep nulls. A left join: Spark broadcasts by measured size only."""
    return rows.join(catalogue, key, "left")
