"""Pricing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import elasticity as el, pricing as pr, sales
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.plans.base import Plans
from tidemark.plans.sales import END, valid, year
from tidemark.sources import canonical as c
from tidemark.sources.sinks import checkpointed

P = Plans()
BAND = {
    "priced": "SELECT product_id, agreement_id, price FROM year_sales WHERE price > 0",
    "med": "SELECT *, quantile_cont(price, 0.5) OVER (PARTITION BY product_id) AS m, count(*) OVER (PARTITION BY product_id) AS k FROM priced",
    "mad": "SELECT *, quantile_cont(abs(price - m), 0.5) OVER (PARTITION BY product_id) AS d FROM med",
    "kept": "SELECT * FROM mad WHERE k < 4 OR d <= 0 OR abs(price - m) <= 3.5::DOUBLE * 1.4826::DOUBLE * d",
    "peers": "SELECT product_id, quantile_cont(price, 0.25) AS p25, quantile_cont(price, 0.5) AS p50, quantile_cont(price, 0.75) AS p75, count(DISTINCT agreement_id) AS n FROM kept GROUP BY 1",
    "costs": "SELECT product_id, coalesce(quantile_cont(unit_cost, 0.5) FILTER (unit_cost > 0 AND qty > 0), max_by(unit_cost, lot_id)) AS unit_cost_eur, count(*) FILTER (unit_cost > 0 AND qty > 0) AS lot_count FROM stock_lots GROUP BY 1",
    "segs": "SELECT group_id, quantile_cont(discount * 100, 0.75) AS seg_p75, quantile_cont(discount * 100, 0.90) AS seg_p90 FROM year_sales GROUP BY 1",
    "pairs": "SELECT DISTINCT s.product_id, s.agreement_id, s.group_id, p_retailprice * 30 AS list_price, p_retailprice * 30 * (1 - (s.agreement_id % 4) * 0.05::DOUBLE) AS baseline FROM year_sales s JOIN part ON p_partkey = s.product_id",
}


def costs(spark, d):
    return pr.unit_cost(c.stock_lots(spark, d))


def segments(spark, d):
    lines = checkpointed(year(spark, d).select("group_id", (F.col("discount") * 100).alias("pct")))
    return grouped_quantiles(lines, ["group_id"], "pct", [0.75, 0.90]).select("group_id", F.col("q")[0].alias("seg_p75"), F.col("q")[1].alias("seg_p90"))


def pairs(spark, d, lines=None):
    """Distinct (product, agreement) pairs of the year with list price and the agreement's tier price as baseline."""
    parts = c.read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), (F.col("p_retailprice") * 30).alias("list_price"))
    base = (year(spark, d) if lines is None else lines).select("product_id", "agreement_id", "group_id").distinct().join(parts, "product_id")
    return base.withColumn("baseline", F.col("list_price") * (1 - (F.col("agreement_id") % 4) * F.lit(0.05)))


@P.add("r1_peer_band", "SELECT product_id, round(p25 + 0.0000001::DOUBLE, 2) AS p25, round(p50 + 0.0000001::DOUBLE, 2) AS p50, round(p75 + 0.0000001::DOUBLE, 2) AS p75, n FROM peers", **BAND)
def r1(spark, d):
    return pr.peer_band(year(spark, d)).select("product_id", *[F.round(F.col(q) + 1e-7, 2).alias(q) for q in ("p25", "p50", "p75")], "n")


@P.add("a15_unit_cost", "SELECT product_id, round(unit_cost_eur + 0.0000001::DOUBLE, 2) AS unit_cost_eur, lot_count FROM costs", **BAND)
def a15(spark, d):
    return costs(spark, d).select("product_id", F.round(F.col("unit_cost_eur") + 1e-7, 2).alias("unit_cost_eur"), "lot_count")


@P.add("a17_median_sale_price", "SELECT product_id, round(quantile_cont(price, 0.5) + 0.0000001::DOUBLE, 2) AS p FROM year_sales GROUP BY 1")
def a17(spark, d):
    lines = checkpointed(year(spark, d).select("product_id", "price"))
    return grouped_quantiles(lines, ["product_id"], "price", [0.5]).select("product_id", F.round(F.col("q")[0] + 1e-7, 2).alias("p"))


@P.add("a22_segment_discounts", "SELECT group_id, round(seg_p75, 4) AS seg_p75, round(seg_p90, 4) AS seg_p90 FROM segs", **BAND)
def a22(spark, d):
    return segments(spark, d).select("group_id", F.round("seg_p75", 4).alias("seg_p75"), F.round("seg_p90", 4).alias("seg_p90"))


def recommendations(spark, d):
    """The year's lines are put together once; pairs, peer bands and segments read that."""
    lines = checkpointed(year(spark, d).select("product_id", "agreement_id", "group_id", "price", "discount"))
    segs = grouped_quantiles(lines.select("group_id", (F.col("discount") * 100).alias("pct")), ["group_id"], "pct", [0.75, 0.90]).select("group_id", F.col("q")[0].alias("seg_p75"), F.col("q")[1].alias("seg_p90"))
    return pr.recommend(pairs(spark, d, lines), pr.peer_band(lines), costs(spark, d), segs)


@P.add(
    "r8_price_recommendations",
    """SELECT product_id, agreement_id, round(price + 0.0000001::DOUBLE, 2) AS recommended_price, round(fl + 0.0000001::DOUBLE, 2) AS price_floor,
    CASE WHEN baseline <= 0 OR unit_cost_eur IS NULL OR coalesce(n, 0) < 3 THEN 'low' WHEN coalesce(lot_count, 0) >= 3 AND n >= 10 THEN 'high' ELSE 'medium' END AS confidence,
    CASE WHEN why = 'peer-median' AND raw > least(seg_p75, seg_p90) THEN 'discount-cap' ELSE why END AS rationale FROM
    (SELECT *, (1 - price / list_price) * 100 AS raw FROM (SELECT *, CASE WHEN fl > baseline THEN fl WHEN target IS NULL THEN baseline ELSE least(target, baseline) END AS price,
      CASE WHEN fl > baseline THEN 'below-margin-loss-flag' WHEN target IS NULL THEN 'at-baseline' WHEN least(target, baseline) <= fl THEN 'margin-floor' WHEN least(target, baseline) >= baseline THEN 'at-baseline' ELSE 'peer-median' END AS why FROM
      (SELECT p.*, unit_cost_eur * (1 + 15.0::DOUBLE / 100) AS fl, greatest(unit_cost_eur * (1 + 15.0::DOUBLE / 100), p50) AS target, n, lot_count, unit_cost_eur, seg_p75, seg_p90
        FROM pairs p LEFT JOIN peers e ON e.product_id = p.product_id LEFT JOIN costs c ON c.product_id = p.product_id LEFT JOIN segs g ON g.group_id = p.group_id)))""",
    **BAND,
)
def r8(spark, d):
    got = recommendations(spark, d)
    return got.select("product_id", "agreement_id", F.round(F.col("recommended_price") + 1e-7, 2).alias("recommended_price"), F.round(F.col("price_floor") + 1e-7, 2).alias("price_floor"), "confidence", "rationale")


@P.add(
    "r4_r5_discount_bands",
    """SELECT product_id, agreement_id, round(cut + 0.0000001::DOUBLE, 2) AS suggested_discount_pct, round(a + 0.0000001::DOUBLE, 2) AS band_min, round(least(greatest(coalesce(cut, 0), a), b) + 0.0000001::DOUBLE, 2) AS band_target, round(b + 0.0000001::DOUBLE, 2) AS band_max, round(CASE WHEN price > 0 THEN (price - unit_cost_eur) / price * 100 END + 0.0000001::DOUBLE, 2) AS margin_pct FROM
    (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN greatest(raw, 0) > least(seg_p75, seg_p90) THEN least(seg_p75, seg_p90) ELSE greatest(raw, 0) END AS cut, least(low, high) AS a, greatest(low, high) AS b FROM
      (SELECT *, CASE WHEN list_price > 0 THEN (1 - price / list_price) * 100 END AS raw, greatest(coalesce((1 - fl / list_price) * 100, 0), 0) AS low, coalesce(seg_p90, seg_p75, 0) AS high FROM
        (SELECT *, CASE WHEN baseline <= 0 THEN NULL WHEN fl > baseline THEN fl WHEN target IS NULL THEN baseline ELSE least(target, baseline) END AS price FROM
          (SELECT p.*, unit_cost_eur * 1.15::DOUBLE AS fl, greatest(unit_cost_eur * 1.15::DOUBLE, p50) AS target, unit_cost_eur, seg_p75, seg_p90 FROM pairs p LEFT JOIN peers e ON e.product_id = p.product_id LEFT JOIN costs c ON c.product_id = p.product_id LEFT JOIN segs g ON g.group_id = p.group_id))))""",
    **BAND,
)
def r5(spark, d):
    got = recommendations(spark, d)
    return got.select("product_id", "agreement_id", *[F.round(F.col(x) + 1e-7, 2).alias(x) for x in ("suggested_discount_pct", "band_min", "band_target", "band_max", "margin_pct")])


def group_cells(spark, d, lines=None):
    """Cells of groups, with regions as agreements: panels dense enough to fit."""
    lines = valid(spark, d) if lines is None else lines
    return sales.panel_cells(lines.withColumn("product_id", F.col("group_id")).withColumn("agreement_id", F.col("region_id"))).withColumnRenamed("product_id", "group_id")


@P.add("r9_elasticity_by_product")
def r9_product(spark, d):
    """Every product's own fit on its agreements and months; most products here have too few cells, which the note says."""
    fits = el.elasticity(sales.panel_cells(valid(spark, d)))
    return fits.select("product_id", F.round("elasticity", 6).alias("elasticity"), F.round("r_squared", 6).alias("r_squared"), "n_cells", "n_kept", "note")


@P.add("r9_elasticity_by_group")
def r9(spark, d):
    """The same fit for groups over regions."""
    fits = el.elasticity(group_cells(spark, d), "group_id")
    return fits.select("group_id", F.round("elasticity", 6).alias("elasticity"), F.round("r_squared", 6).alias("r_squared"), "n_cells", "n_kept", "note")


@P.add("r11_elastic_price_by_product")
def r11_product(spark, d):
    """Cost times e / (e - 1) of each product with a cost, where its own fit is sane, and the source of the price."""
    fits = el.elasticity(sales.panel_cells(valid(spark, d))).select("product_id", "elasticity")
    price = F.round(pr.elastic_price(F.col("elasticity"), F.col("unit_cost_eur")), 2)
    return costs(spark, d).join(fits, "product_id", "left").select("product_id", price.alias("elastic_price"), F.when(price.isNotNull(), "elasticity").otherwise("none").alias("source"))


@P.add("r11_elastic_price")
def r11(spark, d):
    """Cost times e / (e - 1) where the fit is sane, and the source of the price: `elasticity` or `none`."""
    cost = year(spark, d).groupBy("group_id").agg(F.avg(F.col("price") * 0.7).alias("cost"))
    price = F.round(pr.elastic_price(F.col("elasticity"), F.col("cost")), 2)
    return r9(spark, d).join(cost, "group_id").select("group_id", price.alias("elastic_price"), F.when(price.isNotNull(), "elasticity").otherwise("none").alias("source"))


def levels(lines, key, a, b):
    q = F.sum("qty").cast("double")
    return sales.window(lines, a, b).groupBy(key).agg(q.alias("qty"), (F.sum("amount").cast("double") / q).alias("price"))


@P.add("r12_elasticity_direction")
def r12(spark, d):
    """Fits of products and of groups before a day against what price and quantity did after it: a row each."""
    lines = valid(spark, d)
    out = None
    for level, key in (("product", "product_id"), ("group", "group_id")):
        past_ = sales.window(lines, "1995-01-01", "1999-01-01")
        fits = el.elasticity(sales.panel_cells(past_) if key == "product_id" else group_cells(spark, d, past_), key)
        row = el.backtest(fits, levels(lines, key, "1998-01-01", "1999-01-01"), levels(lines, key, "1999-01-01", END), key)
        row = row.select(F.lit(level).alias("level"), "*")
        out = row if out is None else out.unionByName(row)
    return out
