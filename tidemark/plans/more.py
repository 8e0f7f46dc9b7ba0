"""Queries over keys, roles, catalogue links, evaluation tables and boards."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import actions as ac, catalogue, pricing as pr, ranking, reco, risk as rk, sales, supply as g, timeseries as ts
from tidemark.operators.asof import first_at, shifted, totals_at
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.plans import actions, assortment, risk, supply
from tidemark.plans.base import Plans
from tidemark.plans.sales import END, past, valid, year
from tidemark.sources import canonical as c
from tidemark.sources.sinks import checkpointed

P = Plans()


@P.add("p2_key_resolve", "SELECT c_name AS natural_key, c_custkey AS client_id, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def p2(spark, d):
    keys = c.read(spark, d, "customer").select(F.col("c_name").alias("natural_key"), F.col("c_custkey").alias("client_id"))
    return c.read(spark, d, "orders").select(F.col("o_custkey").alias("client_id")).join(keys, "client_id").groupBy("natural_key", "client_id").agg(F.count(F.lit(1)).alias("n_orders"))


@P.add("p5_buyer_role_gate", "SELECT c_custkey AS client_id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def p5(spark, d):
    return c.read(spark, d, "customer").select(F.col("c_custkey").alias("client_id")).join(c.read(spark, d, "orders").select(F.col("o_custkey").alias("client_id")), "client_id", "left_semi")


@P.add("p6_promotional_flag", "SELECT order_id, product_id, line_no, (discount >= 0.09::DOUBLE OR p_size >= 45 OR p_type = 'PROMO' OR (agreement_id % 4) = 3) AS promo FROM year_sales JOIN part ON p_partkey = product_id")
def p6(spark, d):
    parts = c.read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), "p_size", "p_type")
    promo = (F.col("discount") >= 0.09) | (F.col("p_size") >= 45) | (F.col("p_type") == "PROMO") | (F.col("agreement_id") % 4 == 3)
    return year(spark, d).join(parts, "product_id").select("order_id", "product_id", "line_no", promo.alias("promo"))


@P.add("a33_turnover_against_exposure", "SELECT client_id, ym, eur, round(exposure, 4) AS exposure FROM (SELECT client_id, strftime(created, '%Y-%m') AS ym, CAST(sum(amount) AS DOUBLE) AS eur FROM year_sales GROUP BY 1, 2) JOIN (SELECT client_id, sum(eur) AS exposure FROM debt_eur GROUP BY 1) USING (client_id)")
def a33(spark, d):
    exposure = risk.debt(spark, d).groupBy("client_id").agg(F.round(F.sum("eur"), 4).alias("exposure"))
    return sales.monthly(year(spark, d), ["client_id"], "amount", "eur").join(exposure, "client_id")


@P.add("a35_limit_utilisation", "SELECT a.client_id, round(max(CASE WHEN control_amount AND amount_limit > 0 THEN exposure / CAST(amount_limit AS DOUBLE) END), 4) AS utilisation FROM agreements a JOIN (SELECT client_id, sum(eur) AS exposure FROM debt_eur GROUP BY 1) e ON e.client_id = a.client_id GROUP BY 1")
def a35(spark, d):
    exposure = risk.debt(spark, d).groupBy("client_id").agg(F.sum("eur").alias("exposure"))
    use = F.when(F.col("control_amount") & (F.col("amount_limit") > 0), F.col("exposure") / F.col("amount_limit").cast("double"))
    return c.agreements(spark, d).join(exposure, "client_id").groupBy("client_id").agg(F.round(F.max(use), 4).alias("utilisation"))


SIGNALS = {"debt_total": ("debt_lines", "debt_id", "CAST(total AS DOUBLE)"), "paid": ("payments", "client_id", "CAST(amount AS DOUBLE)")}


@P.add(
    "a47_signal_census",
    " UNION ALL ".join(
        f"""SELECT manager_id, '{name}' AS signal, max(n) AS n, max(v) FILTER (r = 1) AS least, max(v) FILTER (r = round(0.25::DOUBLE * (n - 1)) + 1) AS p25, median(v) AS p50, max(v) FILTER (r = round(0.75::DOUBLE * (n - 1)) + 1) AS p75, max(v) FILTER (r = round(0.9::DOUBLE * (n - 1)) + 1) AS p90, max(v) FILTER (r = n) AS most FROM
        (SELECT manager_id, {v} AS v, count(*) OVER (PARTITION BY manager_id) AS n, row_number() OVER (PARTITION BY manager_id ORDER BY {v}) AS r FROM {t}) GROUP BY 1"""
        for name, (t, _, v) in SIGNALS.items()
    ),
)
def a47(spark, d):
    """Count, least, quartiles, 90 % and most of each signal by manager, at positions of the order; by distinct values first,
    so that a window holds a manager's distinct values and not its rows."""
    both = c.debt_lines(spark, d).select("manager_id", F.lit("debt_total").alias("signal"), F.col("total").cast("double").alias("v")).union(c.payments(spark, d).select("manager_id", F.lit("paid"), F.col("amount").cast("double")))
    counts = both.groupBy("manager_id", "signal", "v").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("manager_id", "signal").orderBy("v")
    ranked = counts.withColumns({"upto": F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(Window.partitionBy("manager_id", "signal"))})
    at = lambda i: F.max(F.when((F.col("upto") >= i) & (F.col("upto") - F.col("k") < i), F.col("v")))
    spot = lambda p: at(F.round(p * (F.col("n") - 1)) + 1)
    middle = (at(F.floor((F.col("n") + 1) / 2)) + at(F.floor((F.col("n") + 2) / 2))) / 2
    return ranked.groupBy("manager_id", "signal").agg(F.max("n").alias("n"), F.min("v").alias("least"), spot(0.25).alias("p25"), middle.alias("p50"), spot(0.75).alias("p75"), spot(0.9).alias("p90"), F.max("v").alias("most"))


@P.add("a50_current_discount", "SELECT agreement_id, group_id, max((order_id * 100 + line_no, discount))[2] AS discount FROM past_sales WHERE discount > 0 GROUP BY 1, 2")
def a50(spark, d):
    return past(spark, d).where("discount > 0").groupBy("agreement_id", "group_id").agg(F.max(F.struct((F.col("order_id") * 100 + F.col("line_no")).alias("i"), "discount"))["discount"].alias("discount"))


STATUS = {"status_map": "SELECT * FROM (VALUES ('F', false, 'paid'), ('O', false, 'notpaid'), ('P', false, 'partial'), ('F', true, 'paid'), ('O', true, 'notpaid'), ('P', true, 'notpaid')) t(status, retail, meaning)"}


@P.add(
    "a52_payment_status_counts",
    "SELECT o_custkey AS client_id, CAST(count(*) FILTER (meaning = 'paid') AS BIGINT) AS paid, CAST(count(*) FILTER (meaning = 'partial') AS BIGINT) AS partial, CAST(count(*) FILTER (meaning = 'notpaid') AS BIGINT) AS notpaid FROM orders JOIN status_map ON status = o_orderstatus AND retail = (o_orderpriority = '5-LOW') GROUP BY 1",
    **STATUS,
)
def a52(spark, d):
    meaning = spark.createDataFrame([("F", False, "paid"), ("O", False, "notpaid"), ("P", False, "partial"), ("F", True, "paid"), ("O", True, "notpaid"), ("P", True, "notpaid")], "status string, retail boolean, meaning string")
    rows = c.read(spark, d, "orders").select(F.col("o_custkey").alias("client_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderpriority") == "5-LOW").alias("retail"))
    return rows.join(F.broadcast(meaning), ["status", "retail"]).groupBy("client_id").agg(*[F.sum((F.col("meaning") == m).cast("long")).alias(m) for m in ("paid", "partial", "notpaid")])


@P.add("a53_open_unpaid", "SELECT o_custkey AS client_id, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS open_unpaid, count(*) AS total FROM orders GROUP BY 1")
def a53(spark, d):
    return c.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("client_id")).agg(F.sum((F.col("o_orderstatus") == "O").cast("long")).alias("open_unpaid"), F.count(F.lit(1)).alias("total"))


@P.add(
    "a56_synthetic_line_check",
    "SELECT product_id, eur, round(eur / med, 4) AS ratio FROM (SELECT *, quantile_cont(eur, 0.5) OVER () AS med FROM (SELECT product_id, CAST(sum(amount) AS DOUBLE) AS eur FROM year_sales GROUP BY 1)) WHERE eur / med > 3",
)
def a56(spark, d):
    per = checkpointed(year(spark, d).groupBy("product_id").agg(F.sum("amount").cast("double").alias("eur"), F.lit(0).alias("all")))
    med = grouped_quantiles(per, ["all"], "eur", [0.5]).select(F.col("q")[0].alias("med"))
    return per.join(F.broadcast(med)).withColumn("r", F.col("eur") / F.col("med")).where("r > 3").select("product_id", "eur", F.round("r", 4).alias("ratio"))


@P.add("u6_padded_union", "SELECT product_id, 'sale' AS origin, CAST(sum(qty) AS DOUBLE) AS units, 0.0::DOUBLE AS value FROM year_sales GROUP BY 1 UNION ALL SELECT product_id, 'stock', 0.0::DOUBLE, CAST(sum(value) AS DOUBLE) FROM stock_lots GROUP BY 1")
def u6(spark, d):
    a = year(spark, d).groupBy("product_id").agg(F.sum("qty").cast("double").alias("units")).withColumn("origin", F.lit("sale"))
    b = c.stock_lots(spark, d).groupBy("product_id").agg(F.sum("value").cast("double").alias("value")).withColumn("origin", F.lit("stock"))
    return a.unionByName(b, allowMissingColumns=True).fillna(0.0, ["units", "value"]).select("product_id", "origin", "units", "value")


LINKS = {
    "clean": "SELECT p_partkey AS product_id, lower(trim(p_name || '-' || p_size)) AS k FROM part",
    "link": """SELECT product_id, other_id, max(curated) AS curated FROM (SELECT a.product_id, b.product_id AS other_id, 0 AS curated FROM clean a JOIN clean b ON a.k = b.k AND a.product_id <> b.product_id
      UNION ALL SELECT p_partkey, p_partkey + 1, 1 FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey + 1, p_partkey, 1 FROM part WHERE p_partkey % 10 = 0) GROUP BY 1, 2""",
}


def link_sources(spark, d):
    """Curated pairs, and products with their numbers."""
    parts = c.read(spark, d, "part")
    products = parts.select(F.col("p_partkey").alias("product_id"), F.concat_ws("-", "p_name", "p_size").alias("number"))
    return parts.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("product_id"), (F.col("p_partkey") + 1).alias("other_id")), products


def linked(spark, d):
    return catalogue.links(*link_sources(spark, d))


@P.add("j11_u2_product_links", "SELECT product_id, other_id, CAST(curated AS INTEGER) AS curated FROM link", **LINKS)
def j11(spark, d):
    return linked(spark, d)


@P.add(
    "h8_w11_substitutes",
    "SELECT product_id, other_id, CAST(r AS INTEGER) AS rank FROM (SELECT l.product_id, l.other_id, row_number() OVER (PARTITION BY l.product_id ORDER BY (qty_on_hand > 0) DESC, health DESC, qty_on_hand DESC, curated DESC, l.other_id) AS r FROM link l JOIN portfolio p ON p.product_id = l.other_id) WHERE r <= 5",
    **LINKS,
    **assortment.TABLES,
)
def h8(spark, d):
    table = checkpointed(assortment.table(spark, d).select("product_id", "qty_on_hand", "health"))  # read twice
    return catalogue.best_substitutes(*link_sources(spark, d), table).select("product_id", "other_id", "rank")


TIERS = [(0, None, 0.0), (1, 0, 5.0), (2, 1, 3.0), (3, 0, -2.0), (4, 2, 8.0), (5, None, 0.0), (6, 5, 12.0)]


@P.add(
    "r7_tier_prices",
    """SELECT p_partkey AS product_id, r.pricing_id, root_id, coalesce(o.extra, r.extra) AS extra, round(p_retailprice * (30 + root_id) * (1 + coalesce(o.extra, r.extra) / 100) + 0.000000001::DOUBLE, 2) AS price FROM part CROSS JOIN roots r LEFT JOIN (SELECT pricing_id, p_brand, 7.5::DOUBLE AS extra FROM tiers, (SELECT DISTINCT p_brand FROM part WHERE p_brand LIKE '%1') WHERE pricing_id % 2 = 0) o ON o.pricing_id = r.pricing_id AND o.p_brand = part.p_brand""",
    tiers="SELECT * FROM (VALUES " + ", ".join(f"({i}, {'NULL' if u is None else u}::INTEGER, {x}::DOUBLE)" for i, u, x in TIERS) + ") t(pricing_id, parent_id, extra)",
    roots="SELECT * FROM (WITH RECURSIVE up AS (SELECT pricing_id, pricing_id AS root_id, parent_id, extra FROM tiers UNION ALL SELECT u.pricing_id, t.pricing_id, t.parent_id, u.extra FROM up u JOIN tiers t ON t.pricing_id = u.parent_id) SELECT pricing_id, root_id, extra FROM up WHERE parent_id IS NULL)",
)
def r7(spark, d):
    """Price of each (product, tier): list price at the tier's root, its own or the group's markup. Root 5 has dearer lists."""
    tiers = spark.createDataFrame(TIERS, "pricing_id int, parent_id int, extra double")
    parts = c.read(spark, d, "part")
    prices = parts.select(F.col("p_partkey").alias("product_id"), "p_retailprice", F.explode(F.array(*[F.lit(i) for i, u, _ in TIERS if u is None])).alias("root_id")).select("product_id", "root_id", (F.col("p_retailprice") * (30 + F.col("root_id"))).alias("base"))
    groups = parts.select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("group_id"))
    own = groups.select("group_id").distinct().where("group_id like '%1'").withColumn("pricing_id", F.explode(F.array(*[F.lit(i) for i, _, _ in TIERS if i % 2 == 0]))).withColumn("extra", F.lit(7.5))
    return catalogue.tier_prices(prices, tiers, own, groups).withColumn("price", F.round(F.col("price") + 1e-9, 2))


@P.add(
    "t8_daily_croston",
    """SELECT product_id, round(CASE WHEN n < 2 THEN total / 120 ELSE z / p * 0.95::DOUBLE END + 0.000000001::DOUBLE, 6) AS rate FROM (SELECT product_id, max(n) AS n, sum(u) AS total, sum(u * w) AS z, sum(gap * w) AS p FROM
    (SELECT *, CASE WHEN k = 1 THEN power(0.9::DOUBLE, n - 1) ELSE 0.1::DOUBLE * power(0.9::DOUBLE, n - k) END AS w, greatest(CASE WHEN k = 1 THEN least(greatest(120 - date_diff('day', a, b), 0), 120) ELSE date_diff('day', prev, created) END, 1) AS gap FROM
      (SELECT product_id, created, u, row_number() OVER w AS k, count(*) OVER (PARTITION BY product_id) AS n, lag(created) OVER w AS prev, min(created) OVER (PARTITION BY product_id) AS a, max(created) OVER (PARTITION BY product_id) AS b FROM daily WINDOW w AS (PARTITION BY product_id ORDER BY created))) GROUP BY 1)""",
    daily=supply.PLAN["daily"],
)
def t8(spark, d):
    daily = sales.window(valid(spark, d), "1999-09-03", END).groupBy("product_id", "created").agg(F.sum("qty").cast("double").alias("u"))
    return ts.daily_croston(daily, 120).select("product_id", F.round(F.col("rate") + 1e-9, 6).alias("rate"))


@P.add(
    "t21_demand_chart",
    """SELECT product_id, strftime(created, '%Y-%m') AS ym, sum(u) AS units, false AS is_forecast FROM daily GROUP BY 1, 2 UNION ALL SELECT product_id, '2000-02', round(mean_daily * 30 + 0.000000001::DOUBLE, 2), true FROM demand""",
    daily=supply.PLAN["daily"],
    demand=supply.PLAN["demand"],
)
def t21(spark, d):
    """Monthly units of the policy's 120 days and one flagged point: the daily mean over the horizon, in the month after."""
    daily = sales.window(valid(spark, d), "1999-09-03", END)
    ahead = daily.groupBy("product_id").agg((F.sum("qty").cast("double") / 120 * 30).alias("units"))
    ahead = ahead.select("product_id", F.lit("2000-02").alias("ym"), F.round(F.col("units") + 1e-9, 2).alias("units"), F.lit(True).alias("is_forecast"))
    return sales.monthly(daily, ["product_id"], "qty", "units").withColumn("is_forecast", F.lit(False)).unionByName(ahead)


@P.add(
    "t22_turnover_by_month_end",
    "SELECT client_id, CAST(m AS VARCHAR) AS month_end, CAST(sum(amount) AS DOUBLE) AS turnover FROM valid_sales JOIN (SELECT last_day(DATE '1999-06-01' + to_months(CAST(i AS INTEGER))) AS m FROM range(0, 7) t(i)) ON created <= m AND created > m - INTERVAL 12 MONTH GROUP BY 1, 2",
)
def t22(spark, d):
    """A line enters the total at the first month end from its day on, and leaves it a year later."""
    ends = [str(day) for day in pd.date_range("1999-06-30", periods=7, freq="ME").date]
    lines, at = valid(spark, d).where(F.col("created") <= F.lit(ends[-1]).cast("date")), lambda back: first_at(F.col("created"), shifted(ends, back))
    totals = totals_at(lines, ["client_id"], len(ends), {"come": (F.col("amount"), at(0)), "gone": (F.col("amount"), at(12)), "n0": (F.lit(1), at(0)), "n1": (F.lit(1), at(12))}).fillna(0, ["come", "gone", "n0", "n1"])
    names = F.array(*[F.lit(e) for e in ends])
    return totals.where("n0 > n1").select("client_id", F.get(names, F.col("date_index")).alias("month_end"), (F.col("come") - F.col("gone")).cast("double").alias("turnover"))


#: The first day after each month of the window.
MONTH_ENDS = [f"{1999 + k // 12}-{k % 12 + 1:02d}-01" for k in range(1, 13)]
SPARK_SQL = {}
for _i, _t in enumerate(MONTH_ENDS):
    SPARK_SQL |= risk.matrix_sql(f"at{_i}", _t, "3000") | risk.card_sql(f"at{_i}")
AT_FEATURES = [*risk.FEATURES, "prior_3m", "already_default"]


@P.add("t22_score_sparkline", " UNION ALL ".join(f"SELECT client_id, '{t}' AS as_of, CAST(round({risk.SCORE} + 0.000000001::DOUBLE) AS INTEGER) AS score FROM at{i}_card" for i, t in enumerate(MONTH_ENDS)), **SPARK_SQL)
def t22_score(spark, d):
    """The card's score of every buyer at the end of each month of the year, each from the features of its own day."""
    scored = rk.apply_scorecard(risk.matrix_at(spark, d, MONTH_ENDS), risk.CARD)
    return scored.select("client_id", F.col("as_of").cast("string").alias("as_of"), F.round(F.col("score") + 1e-9).cast("int").alias("score"))


@P.add("t22_features_by_month_end", " UNION ALL ".join(f"SELECT client_id, '{t}' AS as_of, " + ", ".join(f"round(CAST({f} AS DOUBLE) + 0.0000001::DOUBLE, 3) AS {f}" for f in AT_FEATURES) + f" FROM at{i}" for i, t in enumerate(MONTH_ENDS)), **SPARK_SQL)
def t22_features(spark, d):
    """All features of every buyer at each month end, from one pass over each table."""
    return risk.matrix_at(spark, d, MONTH_ENDS).select("client_id", F.col("as_of").cast("string").alias("as_of"), *[F.round(F.col(f).cast("double") + 1e-7, 3).alias(f) for f in AT_FEATURES])


@P.add("c9_negatives_excluded", "SELECT p.client_id, p.group_id FROM (SELECT DISTINCT client_id, group_id FROM past_sales) p WHERE NOT EXISTS (SELECT 1 FROM return_lines r JOIN part ON p_partkey = r.product_id WHERE r.client_id = p.client_id AND p_brand = p.group_id AND r.return_date >= DATE '1999-10-03' AND r.return_date < DATE '2000-01-01')")
def c9(spark, d):
    groups = c.read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("group_id"))
    fresh = c.return_lines(spark, d).where((F.col("return_date") >= F.lit("1999-10-03").cast("date")) & (F.col("return_date") < F.lit(END).cast("date"))).join(groups, "product_id")
    return reco.owned(past(spark, d), "group_id").join(fresh, ["client_id", "group_id"], "left_anti")


@P.add(
    "c13_weight_sweep",
    """SELECT wf, count(DISTINCT t.client_id) AS hits, round(count(DISTINCT t.client_id) / CAST((SELECT count(DISTINCT client_id) FROM truth) AS DOUBLE), 6) AS hit_rate FROM (SELECT *, row_number() OVER (PARTITION BY wf, client_id ORDER BY round(wf * f + (1 - wf) * r, 9) DESC, group_id) AS k FROM
    (SELECT client_id, group_id, f / max(f) OVER (PARTITION BY client_id) AS f, r / max(r) OVER (PARTITION BY client_id) AS r FROM (SELECT client_id, group_id, CAST(count(DISTINCT order_id) AS DOUBLE) AS f, exp(-date_diff('day', max(created), DATE '2000-01-01') / 21.0::DOUBLE) AS r FROM past_sales GROUP BY 1, 2)),
    (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE), (1.0::DOUBLE)) w(wf)) s JOIN truth t ON t.client_id = s.client_id AND t.group_id = s.group_id WHERE k <= 5 GROUP BY 1""",
    truth="SELECT DISTINCT client_id, group_id FROM valid_sales WHERE created >= DATE '2000-01-01' AND created < DATE '2000-04-01'",
)
def c13(spark, d):
    """Hit rates of repurchase ranking under several frequency weights, over one set of cases in one job."""
    lines = past(spark, d)
    w = Window.partitionBy("client_id")
    per = lines.groupBy("client_id", "group_id").agg(F.countDistinct("order_id").cast("double").alias("f"), F.exp(-F.datediff(F.lit(END).cast("date"), F.max("created")) / 21.0).alias("r"))
    per = per.select("client_id", "group_id", (F.col("f") / F.max("f").over(w)).alias("f"), (F.col("r") / F.max("r").over(w)).alias("r"))
    grid = spark.createDataFrame([(x,) for x in (0.0, 0.25, 0.5, 0.75, 1.0)], "wf double")
    scored = per.crossJoin(F.broadcast(grid)).withColumn("score", F.round(F.col("wf") * F.col("f") + (1 - F.col("wf")) * F.col("r"), 9))
    top = ranking.first_per(scored, ["wf", "client_id"], [F.desc("score"), F.col("group_id")], 5)
    truth = reco.owned(sales.window(valid(spark, d), END, "2000-04-01"), "group_id")
    n = truth.select("client_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    hits = top.join(truth, ["client_id", "group_id"]).groupBy("wf").agg(F.countDistinct("client_id").alias("hits"))
    return hits.join(F.broadcast(n)).select("wf", "hits", F.round(F.col("hits") / F.col("n"), 6).alias("hit_rate"))


BANDED = f"SELECT *, CASE WHEN pd < 0.02 THEN 'A' WHEN pd < 0.05 THEN 'B' WHEN pd < 0.15 THEN 'C' ELSE 'D' END AS band, round({risk.SCORE}, 2) AS score FROM mat_card"


@P.add(
    "e19_band_rates",
    "SELECT band, count(*) AS n, round(avg(CAST(label AS DOUBLE)), 6) AS rate, round(avg(score) + 0.000000001::DOUBLE, 4) AS mean_score, min(score) AS min_score, max(score) AS max_score FROM banded GROUP BY 1",
    **risk.FIVE,
    banded=BANDED,
)
def e19(spark, d):
    """Realised rates of the bands of a card's probability, half a year later."""
    rates = rk.band_rates(rk.apply_scorecard(risk.labelled(spark, d), risk.CARD))
    return rates.select("band", "n", F.round("rate", 6).alias("rate"), F.round(F.col("mean_score") + 1e-9, 4).alias("mean_score"), "min_score", "max_score")


@P.add("e19_bands_of_the_fitted_card")
def e19_fitted(spark, d):
    """The same table for the card that the buyers' own features and labels give."""
    m, card = risk.fitted(spark, d)
    rates = rk.band_rates(rk.apply_scorecard(m, card))
    return rates.select("band", "n", F.round("rate", 6).alias("rate"), F.round("mean_score", 2).alias("mean_score"), "min_score", "max_score")


@P.add(
    "e20_feature_report",
    """SELECT feature, round(CAST(count(*) FILTER (v <> 0) AS DOUBLE) / count(*), 6) AS coverage, round(greatest(any_value(auc), 1 - any_value(auc)), 6) AS auc, round(avg(label), 6) AS base_rate FROM
    (SELECT *, (sum(CASE WHEN label = 1 THEN r END) OVER w - CAST(sum(label) OVER w AS DOUBLE) * (sum(label) OVER w + 1) / 2) / (CAST(sum(label) OVER w AS DOUBLE) * (count(*) OVER w - sum(label) OVER w)) AS auc FROM
      (SELECT feature, v, label, rank() OVER (PARTITION BY feature ORDER BY v) + (count(*) OVER (PARTITION BY feature, v) - 1) / 2 AS r FROM longed) WINDOW w AS (PARTITION BY feature)) GROUP BY 1""",
    **risk.MATRIX,
    longed="SELECT label, feature, v FROM (SELECT label, {c} FROM mat) UNPIVOT (v FOR feature IN ({n}))".format(n=", ".join(risk.FEATURES), c=", ".join(f"CAST(round({f}, 6) AS DOUBLE) AS {f}" for f in risk.FEATURES)),
)
def e20(spark, d):
    """Coverage and directed AUC of all features against the label, in one long table, and the label's balance."""
    m = checkpointed(risk.labelled(spark, d))
    long = m.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.round(F.col(n).cast("double"), 6).alias("v")) for n in risk.FEATURES])).alias("x")).select("label", "x.feature", "x.v")
    counts = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    return rk.feature_auc(counts).select("feature", F.round("coverage", 6).alias("coverage"), F.round("auc", 6).alias("auc"), F.round("base_rate", 6).alias("base_rate"))


@P.add(
    "e21_promotion_gate",
    """SELECT incumbent, challenger, challenger > incumbent AS better, monotone, challenger > incumbent AND monotone = 1 AS promote FROM (SELECT max(auc) FILTER (model = 'five_factor') AS incumbent, max(auc) FILTER (model = 'scorecard') AS challenger FROM two),
    (SELECT min(CAST(coalesce(before, 0) <= rate AS INTEGER)) AS monotone FROM (SELECT rate, lag(rate) OVER (ORDER BY band) AS before FROM (SELECT band, round(avg(CAST(label AS DOUBLE)), 6) AS rate FROM banded GROUP BY 1)))""",
    **risk.FIVE,
    banded=BANDED,
    two=f"SELECT 'five_factor' AS model, {risk.AUC_SQL} AS auc FROM (SELECT label, rank() OVER (ORDER BY -score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM mat_five) UNION ALL SELECT 'scorecard', {risk.AUC_SQL} FROM (SELECT label, rank() OVER (ORDER BY pd) + (count(*) OVER (PARTITION BY pd) - 1) / 2 AS r FROM mat_card)",
)
def e21(spark, d):
    """A challenger is promoted when its AUC is above the incumbent's and the band rates rise from A to D (four rows)."""
    auc = risk.e18(spark, d).agg(F.max(F.when(F.col("model") == "five_factor", F.col("auc"))).alias("incumbent"), F.max(F.when(F.col("model") == "scorecard", F.col("auc"))).alias("challenger"))
    order = F.sort_array(F.collect_list(F.struct("band", "rate")))
    rates = e19(spark, d).agg(order.alias("r")).select(F.forall(F.zip_with("r", F.slice("r", 2, 3), lambda a, b: b["rate"].isNull() | (a["rate"] <= b["rate"])), lambda x: x).cast("int").alias("monotone"))
    better = F.col("challenger") > F.col("incumbent")
    return auc.join(F.broadcast(rates)).select("incumbent", "challenger", better.alias("better"), "monotone", (better & (F.col("monotone") == 1)).alias("promote"))


@P.add(
    "n7_outcome_labels",
    "SELECT r.client_id, r.group_id, CAST(EXISTS (SELECT 1 FROM valid_sales v WHERE v.client_id = r.client_id AND v.group_id = r.group_id AND v.created > DATE '2000-01-01' AND v.created <= DATE '2000-03-01') AS INTEGER) AS label FROM reorders r",
    **actions.T,
)
def n7(spark, d):
    t = F.lit(END).cast("date")
    bought = valid(spark, d).where((F.col("created") > t) & (F.col("created") <= F.date_add(t, 60))).select("client_id", "group_id").distinct().withColumn("label", F.lit(1))
    return actions.reorders(spark, d).join(bought, ["client_id", "group_id"], "left").select("client_id", "group_id", F.coalesce("label", F.lit(0)).alias("label"))


@P.add("n10_vintages", "SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS vintage, count(DISTINCT client_id) AS n_clients FROM past_sales JOIN (SELECT DATE '1999-05-01' + to_months(CAST(i AS INTEGER)) AS m FROM range(0, 6) t(i)) ON created < m AND created >= m - INTERVAL 12 MONTH GROUP BY 1")
def n10(spark, d):
    dates = spark.range(6).select(F.add_months(F.lit("1999-05-01").cast("date"), F.col("id").cast("int")).alias("m"))
    lines = past(spark, d).join(F.broadcast(dates), (F.col("created") < F.col("m")) & (F.col("created") >= F.add_months("m", -12)))
    return lines.groupBy(F.col("m").cast("string").alias("vintage")).agg(F.countDistinct("client_id").alias("n_clients"))


@P.add("n20_muted_tasks", """SELECT task_key, CAST(CAST(max("at") AS DATE) + 30 AS VARCHAR) AS muted_until FROM task_events WHERE kind = 'dismissed' GROUP BY 1""")
def n20(spark, d):
    last = c.task_events(spark, d).where("kind = 'dismissed'").groupBy("task_key").agg(F.max("at").alias("at"))
    return last.select("task_key", F.date_add(F.to_date("at"), 30).cast("string").alias("muted_until"))


@P.add(
    "w9_board_page",
    """SELECT task_key, status, due, total, in_state FROM (SELECT task_key, status, due, row_number() OVER (ORDER BY status = 'in_progress' DESC, due NULLS LAST, task_key) AS r, count(*) OVER () AS total, count(*) OVER (PARTITION BY status) AS in_state FROM
    (SELECT task_key, max_by(kind, event_id) AS status, strftime(max("at") FILTER (kind IN ('open', 'in_progress')), '%Y-%m-%d %H:%M:%S') AS due FROM task_events GROUP BY 1)) WHERE r BETWEEN 101 AND 150""",
)
def w9(spark, d):
    """The third page of fifty: tasks in progress first, then by due time with unset ones last; the total and the count of
    each state come with the page."""
    due = F.max(F.when(F.col("kind").isin("open", "in_progress"), F.col("at")))
    last = c.task_events(spark, d).groupBy("task_key").agg(F.max_by("kind", "event_id").alias("status"), F.date_format(due, "yyyy-MM-dd HH:mm:ss").alias("due"))
    states = last.groupBy("status").agg(F.count(F.lit(1)).alias("in_state"))
    total = states.agg(F.sum("in_state").alias("total"))
    page = last.orderBy(F.desc(F.col("status") == "in_progress"), F.asc_nulls_last("due"), "task_key").offset(100).limit(50)
    return page.join(F.broadcast(states), "status").join(F.broadcast(total)).select("task_key", "status", "due", "total", "in_state")
