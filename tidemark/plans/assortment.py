"""Product health queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import assortment as h, sales
from tidemark.plans.base import Plans
from tidemark.plans.sales import END, valid, year
from tidemark.sources import canonical as c
from tidemark.sources.sinks import checkpointed

P = Plans()
MONTHS = [f"1999-{m:02d}" for m in range(1, 13)]
TABLES = {
    "once": "SELECT return_id, line_no, product_id, max(qty) AS qty FROM return_lines WHERE return_date >= DATE '1999-01-01' AND return_date < DATE '2000-01-01' GROUP BY 1, 2, 3",
    "rets": "SELECT product_id, CAST(sum(qty) AS DOUBLE) AS returned_qty FROM once GROUP BY 1",
    "stock": "SELECT product_id, CAST(sum(qty) AS DOUBLE) AS qty_on_hand, CAST(sum(value) AS DOUBLE) AS eur_value FROM stock_lots GROUP BY 1",
    "money": "SELECT product_id, CAST(sum(amount) AS DOUBLE) AS amount, CAST(sum(qty) AS DOUBLE) AS sold FROM year_sales GROUP BY 1",
    "half": "SELECT product_id, CAST(sum(qty) AS DOUBLE) AS half_qty FROM year_sales WHERE created >= DATE '1999-07-05' GROUP BY 1",
    "months": f"SELECT unnest({MONTHS!r}) AS ym, unnest(range(1, 13)) AS i",
    "monthly": "SELECT product_id, i, CAST(sum(qty) AS DOUBLE) AS u FROM year_sales JOIN months ON strftime(created, '%Y-%m') = ym GROUP BY 1, 2",
    "shape": """SELECT product_id, min(i) AS f, max(i) AS l, sum(u) AS annual_units, coalesce(sum(u) FILTER (i > 6), 0) AS recent, coalesce(sum(u) FILTER (i <= 6), 0) AS prior,
      count(gap) AS k, CAST(sum(gap) AS DOUBLE) AS g1, CAST(sum(gap * gap) AS DOUBLE) AS g2 FROM (SELECT *, i - lag(i) OVER (PARTITION BY product_id ORDER BY i) AS gap FROM monthly) GROUP BY 1""",
    "base": """SELECT u.product_id, coalesce(qty_on_hand, 0.0::DOUBLE) AS qty_on_hand, coalesce(eur_value, 0.0::DOUBLE) AS eur_value, coalesce(annual_units, 0.0::DOUBLE) AS annual_units,
      coalesce(half_qty, 0.0::DOUBLE) / 180 AS daily, coalesce(sold > 0, false) AS sold_recently, amount / sold AS avg_price, eur_value / nullif(qty_on_hand, 0) AS unit_cost, amount, returned_qty,
      f, l, recent, prior, k, g1, g2 FROM (SELECT product_id FROM stock UNION SELECT product_id FROM money) u LEFT JOIN stock s ON s.product_id = u.product_id LEFT JOIN money m ON m.product_id = u.product_id
      LEFT JOIN half h ON h.product_id = u.product_id LEFT JOIN shape p ON p.product_id = u.product_id LEFT JOIN rets r ON r.product_id = u.product_id""",
    "labelled": """SELECT *, CASE WHEN qty_on_hand <= 0 THEN 'order_to_demand' WHEN NOT sold_recently THEN 'dead' WHEN daily * 365.0::DOUBLE <= 5 THEN 'slow' WHEN qty_on_hand / daily > 180 THEN 'overstock' WHEN qty_on_hand / daily < 7 THEN 'understock' ELSE 'healthy' END AS band,
      CASE WHEN coalesce(k, 0) < 1 THEN 'Z' WHEN sqrt(greatest(g2 / k - (g1 / k) * (g1 / k), 0.0::DOUBLE)) / (g1 / k) < 0.3::DOUBLE THEN 'X' WHEN sqrt(greatest(g2 / k - (g1 / k) * (g1 / k), 0.0::DOUBLE)) / (g1 / k) < 0.6::DOUBLE THEN 'Y' ELSE 'Z' END AS xyz,
      CASE WHEN NOT sold_recently THEN 'dead' WHEN (12 - f) * 30 + 15 <= 90 THEN 'new' WHEN recent <= 0 AND 12 - l >= 9 THEN 'declining' WHEN recent <= 0 THEN 'mature' WHEN prior <= 0 OR recent >= prior * 1.2::DOUBLE THEN 'growing' WHEN recent <= prior * 0.5::DOUBLE THEN 'declining' ELSE 'mature' END AS lifecycle,
      CASE WHEN avg_price > 0 THEN (avg_price - unit_cost) / avg_price END AS margin_pct, round(coalesce(amount, 0.0::DOUBLE), 2) AS revenue_eur,
      CASE WHEN annual_units > 0 THEN coalesce(returned_qty, 0.0::DOUBLE) / annual_units ELSE 0.0::DOUBLE END AS return_rate FROM base""",
    "classed": """SELECT *, CASE WHEN upto / total <= 0.80 THEN 'A' WHEN upto / total <= 0.95 THEN 'B' ELSE 'C' END AS abc FROM
      (SELECT *, CAST(sum(CAST(revenue_eur AS DECIMAL(18,2))) OVER (ORDER BY revenue_eur DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto, CAST(sum(CAST(revenue_eur AS DECIMAL(18,2))) OVER () AS DOUBLE) AS total FROM labelled)""",
    "parts": """SELECT *, CASE WHEN band = 'order_to_demand' THEN CASE lifecycle WHEN 'growing' THEN 0.75 WHEN 'new' THEN 0.65 WHEN 'mature' THEN 0.55 WHEN 'declining' THEN 0.25 ELSE 0.0 END ELSE CASE band WHEN 'healthy' THEN 1.0 WHEN 'understock' THEN 0.6 WHEN 'overstock' THEN 0.4 WHEN 'slow' THEN 0.3 ELSE 0.0 END END::DOUBLE AS c_stock,
      CASE lifecycle WHEN 'growing' THEN 1.0 WHEN 'mature' THEN 0.8 WHEN 'new' THEN 0.7 WHEN 'declining' THEN 0.3 ELSE 0.0 END::DOUBLE AS c_trend, CASE WHEN margin_pct IS NULL THEN 0.5::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, margin_pct / 0.30::DOUBLE)) END AS c_margin,
      CASE xyz WHEN 'X' THEN 1.0 WHEN 'Y' THEN 0.6 ELSE 0.3 END::DOUBLE AS c_stability, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - return_rate / 0.20::DOUBLE)) AS c_returns, CASE abc WHEN 'A' THEN 1.0 WHEN 'B' THEN 0.6 ELSE 0.2 END::DOUBLE AS c_abc FROM classed""",
    "scored": """SELECT *, round(100.0::DOUBLE * (c_stock * 0.25::DOUBLE + c_trend * 0.18::DOUBLE + c_margin * 0.20::DOUBLE + c_stability * 0.12::DOUBLE + c_returns * 0.03::DOUBLE + c_abc * 0.22::DOUBLE) + 0.000000001::DOUBLE, 1) AS health,
      round(100.0::DOUBLE * (c_abc * 0.40::DOUBLE + c_stability * 0.25::DOUBLE + c_trend * 0.20::DOUBLE + c_stock * 0.15::DOUBLE) + 0.000000001::DOUBLE, 1) AS demand_score,
      round(100.0::DOUBLE * (c_margin * 0.70::DOUBLE + c_returns * 0.20::DOUBLE + c_abc * 0.10::DOUBLE) + 0.000000001::DOUBLE, 1) AS margin_score FROM parts""",
    "portfolio": """SELECT *, CASE WHEN margin_pct < 0 THEN 'fix_margin' WHEN return_rate >= 0.05::DOUBLE THEN 'quality_review' WHEN band = 'dead' THEN 'dead_stock_review' WHEN band = 'overstock' THEN 'discount_or_redistribute' WHEN band = 'understock' THEN 'reorder_check' WHEN band = 'slow' THEN 'slow_mover_review'
      WHEN band = 'order_to_demand' AND demand_score >= 70 THEN 'to_order_candidate' WHEN demand_score >= 70 AND margin_pct IS NULL AND c_abc >= 0.6::DOUBLE THEN 'margin_review' WHEN demand_score >= 70 AND margin_score >= 60 AND c_abc >= 0.6::DOUBLE THEN 'keep_push' WHEN lifecycle = 'declining' AND demand_score < 50 THEN 'monitor_decline' ELSE 'monitor' END AS action_label FROM scored""",
}


def table(spark, d):
    lines = year(spark, d)
    half = lines.where(F.col("created") >= F.lit("1999-07-05").cast("date"))
    rets = c.return_lines(spark, d).where((F.col("return_date") >= F.lit("1999-01-01").cast("date")) & (F.col("return_date") < F.lit(END).cast("date")))
    return h.portfolio(lines, half, sales.stock_by_product(c.stock_lots(spark, d)), sales.returns_by_product(rets), END)


@P.add("h1_cover_bands", "SELECT product_id, band FROM labelled", **TABLES)
def h1(spark, d):
    return table(spark, d).select("product_id", "band")


@P.add("h2_health_score", "SELECT product_id, health FROM portfolio", **TABLES)
def h2(spark, d):
    return table(spark, d).select("product_id", "health")


@P.add("h3_h4_demand_and_margin_scores", "SELECT product_id, demand_score, margin_score FROM portfolio", **TABLES)
def h3(spark, d):
    return table(spark, d).select("product_id", "demand_score", "margin_score")


@P.add(
    "h5_action_labels",
    """SELECT product_id, action_label, CASE action_label WHEN 'fix_margin' THEN 'negative_margin' WHEN 'quality_review' THEN 'high_returns' WHEN 'dead_stock_review' THEN 'dead_stock' WHEN 'discount_or_redistribute' THEN 'overstock' WHEN 'reorder_check' THEN 'understock' WHEN 'slow_mover_review' THEN 'slow_mover'
    WHEN 'to_order_candidate' THEN 'strong_to_order_demand' || CASE WHEN margin_pct IS NULL THEN ',unknown_margin' ELSE '' END WHEN 'margin_review' THEN 'strong_demand,unknown_margin' WHEN 'keep_push' THEN 'strong_demand,healthy_margin' WHEN 'monitor_decline' THEN 'declining_demand' ELSE 'no_immediate_action' END AS reasons FROM portfolio""",
    **TABLES,
)
def h5(spark, d):
    return table(spark, d).select("product_id", "action_label", F.array_join("reasons", ",").alias("reasons"))


@P.add("h6_portfolio", "SELECT product_id, qty_on_hand, annual_units, revenue_eur, round(margin_pct, 4) AS margin_pct, band, xyz, lifecycle, abc, health, action_label FROM portfolio", **TABLES)
def h6(spark, d):
    return table(spark, d).select("product_id", "qty_on_hand", "annual_units", "revenue_eur", F.round("margin_pct", 4).alias("margin_pct"), "band", "xyz", "lifecycle", "abc", "health", "action_label")


@P.add(
    "h7_regional_card",
    "SELECT p.product_id, region_id, health, CAST(sum(qty) AS DOUBLE) AS units FROM portfolio p JOIN year_sales s ON p.product_id = s.product_id GROUP BY 1, 2, 3",
    **TABLES,
)
def h7(spark, d):
    return table(spark, d).select("product_id", "health").join(sales.regional_demand(year(spark, d)), "product_id").select("product_id", "region_id", "health", "units")


@P.add(
    "a36_overview",
    """SELECT concat_ws(':', 'band=' || band, 'lifecycle=' || lifecycle, 'action_label=' || action_label, 'abc=' || abc, 'xyz=' || xyz) AS slice, count(*) AS n, round(sum(eur_value), 4) AS eur_value, round(avg(health) + 0.000000001::DOUBLE, 1) AS avg_health
    FROM portfolio GROUP BY GROUPING SETS ((band), (lifecycle), (action_label), (abc), (xyz), ())""",
    **TABLES,
)
def a36(spark, d):
    return h.overview(table(spark, d))


@P.add(
    "a37_margin_summary",
    "SELECT count(*) AS n, round(sum(margin_pct * revenue_eur) / sum(CASE WHEN margin_pct IS NOT NULL THEN revenue_eur END), 4) AS margin_weighted, round(coalesce(sum(CASE WHEN margin_pct < 0 THEN revenue_eur END), 0.0::DOUBLE), 2) AS eur_below_cost, round(sum(return_rate * annual_units) / sum(annual_units), 4) AS return_rate FROM portfolio",
    **TABLES,
)
def a37(spark, d):
    t = table(spark, d)
    known = F.when(F.col("margin_pct").isNotNull(), F.col("revenue_eur"))
    return t.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.sum(F.col("margin_pct") * F.col("revenue_eur")) / F.sum(known), 4).alias("margin_weighted"),
        F.round(F.coalesce(F.sum(F.when(F.col("margin_pct") < 0, F.col("revenue_eur"))), F.lit(0.0)), 2).alias("eur_below_cost"),
        F.round(F.sum(F.col("return_rate") * F.col("annual_units")) / F.sum("annual_units"), 4).alias("return_rate"),
    )


@P.add(
    "a38_stock_bands",
    "SELECT b.band, count(p.product_id) AS n, round(coalesce(sum(eur_value), 0.0::DOUBLE), 4) AS eur_value, coalesce(sum(qty_on_hand), 0.0::DOUBLE) AS qty FROM (SELECT unnest(['order_to_demand', 'healthy', 'understock', 'overstock', 'slow', 'dead']) AS band) b LEFT JOIN portfolio p ON p.band = b.band GROUP BY 1",
    **TABLES,
)
def a38(spark, d):
    return h.stock_bands(table(spark, d)).withColumn("eur_value", F.round("eur_value", 4))


@P.add(
    "w6_margin_lists",
    """SELECT 'leaders' AS list, CAST(row_number() OVER (ORDER BY eur DESC, product_id) AS INTEGER) AS rank, product_id, value FROM (SELECT product_id, margin_pct * revenue_eur AS eur, round(margin_pct * revenue_eur + 0.000000001::DOUBLE, 2) AS value FROM portfolio WHERE margin_pct IS NOT NULL ORDER BY eur DESC, product_id LIMIT 20)
    UNION ALL SELECT 'laggards', CAST(row_number() OVER (ORDER BY margin_pct, product_id) AS INTEGER), product_id, round(margin_pct, 4) FROM (SELECT * FROM portfolio WHERE margin_pct IS NOT NULL ORDER BY margin_pct, product_id LIMIT 20)
    UNION ALL SELECT 'below_cost', CAST(row_number() OVER (ORDER BY margin_pct, product_id) AS INTEGER), product_id, round(margin_pct, 4) FROM portfolio WHERE margin_pct < 0
    UNION ALL SELECT 'high_returns', CAST(row_number() OVER (ORDER BY return_rate DESC, product_id) AS INTEGER), product_id, round(return_rate, 4) FROM (SELECT * FROM portfolio WHERE annual_units > 0 AND return_rate >= 0.05::DOUBLE ORDER BY return_rate DESC, product_id LIMIT 20)""",
    **TABLES,
)
def w6(spark, d):
    """Four lists: most margin in EUR, least margin share, all sold below cost, highest return rates."""
    t = checkpointed(table(spark, d)).withColumn("eur", F.col("margin_pct") * F.col("revenue_eur"))
    known = t.where("margin_pct is not null")
    lists = {
        "leaders": (known.orderBy(F.desc("eur"), "product_id").limit(20), [F.desc("eur"), F.col("product_id")], F.round(F.col("eur") + 1e-9, 2)),
        "laggards": (known.orderBy("margin_pct", "product_id").limit(20), [F.col("margin_pct"), F.col("product_id")], F.round("margin_pct", 4)),
        "high_returns": (t.where("annual_units > 0 and return_rate >= 0.05").orderBy(F.desc("return_rate"), "product_id").limit(20), [F.desc("return_rate"), F.col("product_id")], F.round("return_rate", 4)),
    }
    parts = [df.select(F.lit(name).alias("list"), F.row_number().over(Window.partitionBy().orderBy(*order)).alias("rank"), "product_id", value.alias("value")) for name, (df, order, value) in lists.items()]
    flagged = known.where("margin_pct < 0").withColumn("share", F.col("margin_pct"))
    below = h.positions(flagged, "share").select(F.lit("below_cost").alias("list"), F.col("_pos").cast("int").alias("rank"), "product_id", F.round("margin_pct", 4).alias("value"))
    out = below
    for part in parts:
        out = out.unionByName(part)
    return out


#: The page's sorts: column and whether it falls.
SORTS = {"health": True, "revenue_eur": True, "margin_pct": True, "annual_units": True, "qty_on_hand": True, "eur_value": True, "return_rate": True}


@P.add(
    "w7_assortment_pages",
    " UNION ALL ".join(f"SELECT '{k}' AS sort, CAST(r AS INTEGER) AS rank, product_id, total FROM (SELECT product_id, row_number() OVER (ORDER BY {k} DESC NULLS LAST, product_id) AS r, count(*) OVER () AS total FROM shown) WHERE r BETWEEN 51 AND 100" for k in SORTS),
    shown="SELECT * FROM portfolio WHERE band IN ('healthy', 'understock', 'slow') AND lifecycle <> 'dead'",
    **TABLES,
)
def w7(spark, d):
    """The second page of fifty under each sort, after filters, with the number of products in all pages."""
    t = checkpointed(table(spark, d).where("band in ('healthy', 'understock', 'slow') and lifecycle <> 'dead'"))
    total = t.agg(F.count(F.lit(1)).alias("total"))
    pages = []
    for k in SORTS:
        order = [F.desc_nulls_last(k), F.col("product_id")]
        page = t.orderBy(*order).limit(100).withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(*order))).where("rank > 50")  # a page, not the table
        pages.append(page.select(F.lit(k).alias("sort"), "rank", "product_id"))
    out = pages[0]
    for page in pages[1:]:
        out = out.unionByName(page)
    return out.join(F.broadcast(total))


@P.add("p7_catalogue_meta", "SELECT p.product_id, health, p_name AS name, p_type AS vendor_code, p_size > 25 AS is_for_sale FROM portfolio p LEFT JOIN part ON p_partkey = p.product_id", **TABLES)
def p7(spark, d):
    parts = c.read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_type").alias("vendor_code"), (F.col("p_size") > 25).alias("is_for_sale"))
    return h.attach_meta(table(spark, d).select("product_id", "health"), parts)


@P.add(
    "w6_margin_leaders",
    "SELECT product_id, round(margin_pct, 4) AS margin_pct FROM portfolio WHERE margin_pct IS NOT NULL ORDER BY margin_pct DESC, product_id LIMIT 25",
    **TABLES,
)
def w6_leaders(spark, d):
    """The highest margin shares, whatever the revenue."""
    return table(spark, d).where("margin_pct is not null").orderBy(F.desc("margin_pct"), "product_id").limit(25).select("product_id", F.round("margin_pct", 4).alias("margin_pct"))


@P.add(
    "w7_assortment_page",
    "SELECT product_id, health, revenue_eur FROM portfolio WHERE band IN ('healthy', 'understock', 'slow') AND lifecycle <> 'dead' ORDER BY health DESC, product_id LIMIT 50 OFFSET 50",
    **TABLES,
)
def w7_page(spark, d):
    """One page with its values."""
    return table(spark, d).where("band in ('healthy', 'understock', 'slow') and lifecycle <> 'dead'").orderBy(F.desc("health"), "product_id").offset(50).limit(50).select("product_id", "health", "revenue_eur")


@P.add(
    "w12_health_deciles",
    "SELECT product_id, CAST(floor(((row_number() OVER (ORDER BY health, product_id)) * 10 - 1) / count(*) OVER () + 1) AS INTEGER) AS bucket FROM portfolio",
    **TABLES,
)
def w12(spark, d):
    return h.deciles(table(spark, d), "health").select("product_id", "bucket")


FUTURE = {
    "fback": "SELECT product_id, CAST(sum(qty) AS DOUBLE) AS q, CAST(sum(amount) AS DOUBLE) AS v FROM (SELECT return_id, line_no, product_id, max(qty) AS qty, max(amount) AS amount FROM return_lines WHERE return_date >= DATE '2000-01-01' AND return_date < DATE '2000-07-01' GROUP BY 1, 2, 3) GROUP BY 1",
    "future": """SELECT *, round(greatest(0, raw - coalesce(v, 0)) - greatest(0, future_units - future_returned_units) * unit_cost + 0.000000001::DOUBLE, 2) AS future_margin_eur FROM (SELECT p.*, coalesce(f.u, 0) AS future_units, coalesce(f.r, 0) AS raw, round(coalesce(f.r, 0) + 0.000000001::DOUBLE, 2) AS future_revenue_eur, coalesce(b.q, 0) AS future_returned_units, v, round(coalesce(b.v, 0) + 0.000000001::DOUBLE, 2) AS future_returned_value_eur
      FROM portfolio p LEFT JOIN (SELECT product_id, CAST(sum(qty) AS DOUBLE) AS u, CAST(sum(amount) AS DOUBLE) AS r FROM valid_sales WHERE created >= DATE '2000-01-01' AND created < DATE '2000-07-01' GROUP BY 1) f ON f.product_id = p.product_id LEFT JOIN fback b ON b.product_id = p.product_id)""",
}
OUTCOMES = ["future_revenue_eur", "future_units", "future_margin_eur"]


def with_future(spark, d):
    rets = c.return_lines(spark, d).where((F.col("return_date") >= F.lit(END).cast("date")) & (F.col("return_date") < F.lit("2000-07-01").cast("date")))
    return h.future_outcomes(table(spark, d), sales.window(valid(spark, d), END, "2000-07-01"), rets)


@P.add("h9_future_outcomes", "SELECT product_id, future_units, future_revenue_eur, future_returned_units, future_returned_value_eur, future_margin_eur FROM future", **FUTURE, **TABLES)
def h9(spark, d):
    return with_future(spark, d).select("product_id", "future_units", "future_revenue_eur", "future_returned_units", "future_returned_value_eur", "future_margin_eur")


@P.add(
    "w13_average_ranks",
    "SELECT product_id, (rank() OVER (ORDER BY health) + (count(*) OVER (PARTITION BY health) - 1) / 2)::DOUBLE AS r FROM portfolio",
    **TABLES,
)
def w13(spark, d):
    from tidemark.operators.ranking import average_rank

    return average_rank(table(spark, d).select("product_id", "health"), "health", "r").select("product_id", F.col("r").cast("double").alias("r"))


#: The correlations of the report: score and outcome.
PAIRS = [("health", "future_revenue_eur"), ("health", "future_units"), ("health", "future_margin_eur"), ("demand_score", "future_revenue_eur"), ("demand_score", "future_units"), ("margin_score", "future_margin_eur")]
SPEARMAN = " UNION ALL ".join(
    f"SELECT '{x}' AS score, '{y}' AS outcome, count(*) AS n, round(corr(rx, ry), 4) AS rho FROM (SELECT rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 AS rx, rank() OVER (ORDER BY {y}) + (count(*) OVER (PARTITION BY {y}) - 1) / 2 AS ry FROM future WHERE {y} IS NOT NULL)" for x, y in PAIRS
)


def correlations(t):
    parts = [h.spearman(t.where(F.col(y).isNotNull()), x, y).select(F.lit(x).alias("score"), F.lit(y).alias("outcome"), "n", F.round("rho", 4).alias("rho")) for x, y in PAIRS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@P.add("h10_spearman", SPEARMAN, **FUTURE, **TABLES)
def h10(spark, d):
    return correlations(checkpointed(with_future(spark, d)))


@P.add("h10_health_spearman", "SELECT n, rho FROM (" + SPEARMAN + ") WHERE score = 'health' AND outcome = 'future_revenue_eur'", **FUTURE, **TABLES)
def h10_health(spark, d):
    return h.spearman(with_future(spark, d), "health", "future_revenue_eur").withColumn("rho", F.round("rho", 4))


SUMMARY = """count(*) AS n, round(avg(health) + 0.000000001::DOUBLE, 4) AS avg_health, round(avg(future_revenue_eur) + 0.000000001::DOUBLE, 2) AS avg_revenue, round(avg(future_units) + 0.000000001::DOUBLE, 2) AS avg_units, round(avg(future_margin_eur) + 0.000000001::DOUBLE, 2) AS avg_margin,
  round(avg(CASE WHEN future_revenue_eur = 0 THEN 1.0 ELSE 0.0 END::DOUBLE) + 0.000000001::DOUBLE, 4) AS zero_share, round(CASE WHEN sum(future_units) > 0 THEN sum(future_returned_units) / sum(future_units) END + 0.000000001::DOUBLE, 4) AS return_rate"""


def summary(t, key):
    r = lambda x, n: F.round(x + 1e-9, n)
    return t.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("health"), 4).alias("avg_health"), r(F.avg("future_revenue_eur"), 2).alias("avg_revenue"), r(F.avg("future_units"), 2).alias("avg_units"), r(F.avg("future_margin_eur"), 2).alias("avg_margin"),
        r(F.avg((F.col("future_revenue_eur") == 0).cast("double")), 4).alias("zero_share"), r(F.when(F.sum("future_units") > 0, F.sum("future_returned_units") / F.sum("future_units")), 4).alias("return_rate"),
    )


@P.add("h10_deciles", f"SELECT bucket, {SUMMARY} FROM (SELECT *, CAST(floor(((row_number() OVER (ORDER BY health, product_id)) * 10 - 1) / count(*) OVER () + 1) AS INTEGER) AS bucket FROM future) GROUP BY 1", **FUTURE, **TABLES)
def h10_deciles(spark, d):
    return summary(h.deciles(with_future(spark, d), "health"), "bucket")


@P.add("h10_by_action", f"SELECT action_label, {SUMMARY} FROM future GROUP BY 1", **FUTURE, **TABLES)
def h10b(spark, d):
    return summary(with_future(spark, d), "action_label")


@P.add(
    "h10_lift",
    " UNION ALL ".join(f"SELECT '{o}' AS outcome, round(avg(coalesce({o}, 0)) FILTER (r > n - tk) / avg(coalesce({o}, 0)) FILTER (r <= tk), 4) AS lift FROM tails" for o in OUTCOMES),
    tails="SELECT *, greatest(1, floor(n * 0.2::DOUBLE)) AS tk FROM (SELECT health, future_revenue_eur, future_units, future_margin_eur, row_number() OVER (ORDER BY health, product_id) AS r, count(*) OVER () AS n FROM future)",
    **FUTURE,
    **TABLES,
)
def h10_lift(spark, d):
    return h.lift(with_future(spark, d), "health", OUTCOMES).withColumn("lift", F.round("lift", 4))


#: The stored report: correlations that the new ones may fall short of by the tolerance.
STORED, TOLERANCE = {("health", "future_revenue_eur"): 0.10, ("health", "future_units"): 0.05, ("demand_score", "future_revenue_eur"): 0.10}, 0.02


@P.add("h11_regression_gate", "SELECT score, outcome, rho, stored, rho >= stored - 0.02::DOUBLE AS holds FROM measured JOIN (VALUES " + ", ".join(f"('{x}', '{y}', {v}::DOUBLE)" for (x, y), v in STORED.items()) + ") t(score, outcome, stored) USING (score, outcome)", measured=SPEARMAN, **FUTURE, **TABLES)
def h11(spark, d):
    """Which correlations hold against a stored report; a missing one is a row without a value that does not hold."""
    stored = spark.createDataFrame([(x, y, v) for (x, y), v in STORED.items()], "score string, outcome string, stored double")
    rows = stored.join(correlations(checkpointed(with_future(spark, d))), ["score", "outcome"], "left")
    return rows.select("score", "outcome", "rho", "stored", F.coalesce(F.col("rho") >= F.col("stored") - TOLERANCE, F.lit(False)).alias("holds"))
