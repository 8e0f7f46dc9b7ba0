"""Demand classes, forecasts and backtests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import columns as col
from tidemark.operators import sales, timeseries as ts
from tidemark.plans.base import Plans
from tidemark.plans.sales import END, past, valid, year
from tidemark.sources import canonical as c

P = Plans()
MONTHS = 24
#: The day of the forecasts: history is what was sold before it, its month is the last of the grid.
TODAY = "1999-12-31"
SERIES = f"""SELECT k.{{key}}, list(coalesce(v.x, 0.0::DOUBLE) ORDER BY g.ym) AS series FROM (SELECT DISTINCT {{key}} FROM lines) k CROSS JOIN grid g
  LEFT JOIN (SELECT {{key}}, strftime(created, '%Y-%m') AS ym, CAST(sum({{measure}}) AS DOUBLE) AS x FROM lines GROUP BY 1, 2) v ON v.{{key}} = k.{{key}} AND v.ym = g.ym GROUP BY 1"""
TABLES = {
    "grid": "SELECT strftime(DATE '1998-01-01' + to_months(CAST(i AS INTEGER)), '%Y-%m') AS ym FROM range(0, 24) t(i)",
    "lines": "SELECT * FROM valid_sales WHERE created >= DATE '1998-01-01' AND created < DATE '1999-12-31'",
    "product_series": SERIES.format(key="product_id", measure="amount"),
    "client_series": SERIES.format(key="client_id", measure="amount"),
    "unit_series": SERIES.format(key="product_id", measure="qty"),
    "classed": """SELECT product_id, series, n, CASE WHEN n > 0 THEN span / n END AS adi, CASE WHEN n < 2 THEN 0.0::DOUBLE ELSE greatest(sq / n - (s / n) * (s / n), 0.0::DOUBLE) / ((s / n) * (s / n)) END AS cv2 FROM
      (SELECT product_id, series, CAST(len(list_filter(series, lambda x: x > 0)) AS INTEGER) AS n, list_sum(series) AS s, list_sum(list_transform(series, lambda x: x * x)) AS sq,
        len(series) - list_position(list_transform(series, lambda x: x > 0), true) + 1 AS span FROM product_series)""",
    "segmented": """SELECT *, CASE WHEN n = 0 THEN 'no_demand' WHEN adi < 1.32 AND cv2 < 0.49 THEN 'smooth' WHEN adi < 1.32 THEN 'erratic' WHEN cv2 < 0.49 THEN 'intermittent' ELSE 'lumpy' END AS segment FROM classed""",
}
EWMA = "list_reduce(series, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a)"


def by_product(spark, d):
    return ts.densify(valid(spark, d), "product_id", "amount", TODAY, MONTHS)


def by_client(spark, d):
    return ts.densify(valid(spark, d), "client_id", "amount", TODAY, MONTHS)


@P.add("t1_densify", "SELECT product_id, CAST(i AS INTEGER) AS i, series[i] AS eur FROM product_series, range(1, 25) t(i)", **TABLES)
def t1(spark, d):
    return by_product(spark, d).select("product_id", F.posexplode("series").alias("i", "eur")).withColumn("i", F.col("i") + 1)


@P.add("t2_future_months", "SELECT client_id, strftime(DATE '2000-01-01' + to_months(CAST(i AS INTEGER)), '%Y-%m') AS ym FROM (SELECT DISTINCT client_id FROM year_sales), range(0, 6) t(i)")
def t2(spark, d):
    ahead = F.array(*[F.lit(m) for m in ts.future_months(TODAY, 6)])
    return year(spark, d).select("client_id").distinct().select("client_id", F.explode(ahead).alias("ym"))


@P.add("t3_adi_cv2", "SELECT product_id, n AS n_events, round(adi, 6) AS adi, round(cv2, 4) AS cv2 FROM classed", **TABLES)
def t3(spark, d):
    return ts.with_demand_class(by_product(spark, d)).select("product_id", "n_events", F.round("adi", 6).alias("adi"), F.round("cv2", 4).alias("cv2"))


@P.add("t4_demand_quadrant", "SELECT product_id, segment FROM segmented", **TABLES)
def t4(spark, d):
    return ts.with_demand_class(by_product(spark, d)).select("product_id", "segment")


@P.add("t5_moving_average", "SELECT client_id, round(list_sum(series) / 24 + 0.0000001::DOUBLE, 2) AS rate FROM client_series", **TABLES)
def t5(spark, d):
    return by_client(spark, d).select("client_id", F.round(col.mean_of(F.col("series")) + 1e-7, 2).alias("rate"))


@P.add("t6_ewma", f"SELECT client_id, round(greatest(0.0::DOUBLE, {EWMA}), 2) AS rate FROM client_series", **TABLES)
def t6(spark, d):
    return by_client(spark, d).select("client_id", F.round(col.ewma(F.col("series"), 0.3), 2).alias("rate"))


@P.add("t6_ewma_daily", "SELECT product_id, round(list_reduce(xs, lambda a, x: 0.35::DOUBLE * x + 0.65::DOUBLE * a) / 30, 6) AS rate FROM (SELECT product_id, list_filter(series, lambda x: x > 0) AS xs FROM unit_series)", **TABLES)
def t6_daily(spark, d):
    """The daily-rate variant: months with demand only, alpha 0.35, over 30 days."""
    units = ts.densify(valid(spark, d), "product_id", "qty", TODAY, MONTHS)
    some = F.filter("series", lambda x: x > 0)
    return units.select("product_id", some.alias("some")).select("product_id", F.round(col.ewma(F.col("some"), 0.35) / 30, 6).alias("rate"))


CROSTON = {
    "events": "SELECT product_id, i, x, i - coalesce(lag(i) OVER w, -1) AS gap, row_number() OVER w AS k, count(*) OVER (PARTITION BY product_id) AS n FROM (SELECT product_id, i - 1 AS i, series[i] AS x FROM product_series, range(1, 25) t(i)) WHERE x > 0 WINDOW w AS (PARTITION BY product_id ORDER BY i)",
    "smooth": "SELECT product_id, n, sum(x * CASE WHEN k = 1 THEN power(0.9::DOUBLE, n - 1) ELSE 0.1::DOUBLE * power(0.9::DOUBLE, n - k) END) AS z, sum(gap * CASE WHEN k = 1 THEN power(0.9::DOUBLE, n - 1) ELSE 0.1::DOUBLE * power(0.9::DOUBLE, n - k) END) AS p FROM events GROUP BY 1, 2",
    "rates": "SELECT s.product_id, CASE WHEN n >= 2 THEN z / p ELSE list_sum(series) / 24 END AS croston, CASE WHEN n >= 2 THEN z / p * 0.95::DOUBLE ELSE list_sum(series) / 24 END AS sba FROM product_series s JOIN smooth m ON s.product_id = m.product_id",
}


@P.add("t7_croston", "SELECT product_id, round(croston, 2) AS croston, round(sba, 2) AS sba FROM rates", **TABLES, **CROSTON)
def t7(spark, d):
    s = F.col("series")
    return by_product(spark, d).select("product_id", F.round(col.croston(s, 0.1, False), 2).alias("croston"), F.round(col.croston(s, 0.1, True), 2).alias("sba"))


def holt_sql(series: str) -> str:
    """{l, b} after a damped-trend fold with alpha 0.4, beta 0.2, phi 0.85: level = .4x + .6(l + .85b), trend = .2(level - l) + .8 * .85b."""
    level = "(0.4::DOUBLE * x.x + 0.6::DOUBLE * (a.l + 0.85::DOUBLE * a.b))"
    start = f"{{'x': 0.0::DOUBLE, 'l': {series}[1], 'b': coalesce({series}[2] - {series}[1], 0.0::DOUBLE)}}"
    return f"list_reduce(list_prepend({start}, list_transform({series}[2:], lambda v: {{'x': v, 'l': 0.0::DOUBLE, 'b': 0.0::DOUBLE}})), lambda a, x: {{'x': x.x, 'l': {level}, 'b': 0.2::DOUBLE * ({level} - a.l) + 0.8::DOUBLE * 0.85::DOUBLE * a.b}})"


#: phi + phi^2 + .. of step h.
DAMP = "(0.85::DOUBLE * (1 - power(0.85::DOUBLE, h)) / 0.15::DOUBLE)"


@P.add("t9_damped_trend", f"SELECT client_id, CAST(h AS INTEGER) AS step, round(greatest(0.0::DOUBLE, f.l + {DAMP} * f.b) + 0.0000001::DOUBLE, 2) AS amount FROM (SELECT client_id, {holt_sql('series')} AS f FROM client_series), range(1, 7) t(h)", **TABLES)
def t9(spark, d):
    paths = by_client(spark, d).select("client_id", F.posexplode(col.holt_path(F.col("series"), 6)).alias("step", "amount"))
    return paths.select("client_id", (F.col("step") + 1).alias("step"), F.round(F.col("amount") + 1e-7, 2).alias("amount"))


@P.add(
    "t11_product_forecast",
    """SELECT s.product_id, segment, CASE WHEN segment = 'smooth' THEN 'ewma' WHEN segment IN ('intermittent', 'lumpy') THEN 'sba' ELSE 'moving_avg' END AS method, CAST(i AS INTEGER) AS step,
    round(CASE WHEN segment = 'smooth' THEN greatest(0.0::DOUBLE, """ + EWMA + """) WHEN segment IN ('intermittent', 'lumpy') THEN r.sba ELSE list_sum(series) / 24 END + 0.0000001::DOUBLE, 2) AS amount
    FROM segmented s JOIN rates r ON s.product_id = r.product_id, range(1, 7) t(i) WHERE n >= 3""",
    **TABLES,
    **CROSTON,
)
def t11(spark, d):
    return ts.forecast(by_product(spark, d), "product_id", 6).withColumn("amount", F.round(F.col("amount") + 1e-7, 2))


def tested(spark, d, methods=ts.METHODS):
    return ts.backtest(by_product(spark, d), "product_id", methods=methods)


#: Croston by origin: size and interval smoothed by 0.1 over the months with demand of the training list.
EVENT = "{'z': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'prev': -1, 'n': 0, 'i': CAST(i - 1 AS INTEGER), 'x': v}"
FOLD = """CASE WHEN x.x <= 0 THEN {'z': a.z, 'p': a.p, 'prev': a.prev, 'n': a.n, 'i': x.i, 'x': x.x}
  WHEN a.n = 0 THEN {'z': x.x, 'p': CAST(x.i - a.prev AS DOUBLE), 'prev': x.i, 'n': 1, 'i': x.i, 'x': x.x}
  ELSE {'z': a.z + 0.1::DOUBLE * (x.x - a.z), 'p': a.p + 0.1::DOUBLE * (x.i - a.prev - a.p), 'prev': x.i, 'n': a.n + 1, 'i': x.i, 'x': x.x} END"""
TESTED = {
    "trained": "SELECT product_id, segment, CAST(o AS INTEGER) AS origin, series, series[1:o + 1] AS train FROM segmented, range(17, 23) t(o)",
    "fitted": f"""SELECT *, list_sum(train) / len(train) AS mean, greatest(0.0::DOUBLE, list_reduce(train, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a)) AS level, {holt_sql('train')} AS trend,
      list_reduce(list_prepend({{'z': 0.0::DOUBLE, 'p': 0.0::DOUBLE, 'prev': -1, 'n': 0, 'i': -1, 'x': 0.0::DOUBLE}}, list_transform(train, lambda v, i: {EVENT})), lambda a, x: {FOLD}) AS c FROM trained""",
    "tested": f"""SELECT product_id, segment, origin, method, CAST(h AS INTEGER) AS step, series[origin + 1 + h] AS actual, CASE method WHEN 'moving_avg' THEN mean WHEN 'ewma' THEN level WHEN 'damped_trend' THEN greatest(0.0::DOUBLE, trend.l + {DAMP} * trend.b)
      WHEN 'croston' THEN CASE WHEN c.n >= 2 THEN c.z / c.p ELSE mean END ELSE CASE WHEN c.n >= 2 THEN c.z / c.p * 0.95::DOUBLE ELSE mean END END AS forecast
      FROM fitted, (VALUES ('moving_avg'), ('croston'), ('sba'), ('ewma'), ('damped_trend')) m(method), range(1, 4) b(h) WHERE origin + 1 + h <= 24""",
    "scored": """SELECT method, segment, count(*) AS n, avg(abs(forecast - actual)) AS mae, avg(CASE WHEN abs(forecast) + abs(actual) = 0 THEN 0.0::DOUBLE ELSE abs(forecast - actual) / ((abs(forecast) + abs(actual)) / 2) END) AS smape, avg(forecast - actual) AS bias FROM tested GROUP BY 1, 2""",
}


@P.add(
    "t12_backtest_moving_average",
    """SELECT product_id, CAST(o AS INTEGER) AS origin, CAST(h AS INTEGER) AS step, round(list_sum(series[1:o + 1]) / (o + 1) + 0.0000001::DOUBLE, 2) AS forecast, series[o + 1 + h] AS actual
    FROM product_series, range(17, 23) a(o), range(1, 4) b(h) WHERE o + 1 + h <= 24""",
    **TABLES,
)
def t12(spark, d):
    return tested(spark, d, ("moving_avg",)).select("product_id", "origin", "step", F.round(F.col("forecast") + 1e-7, 2).alias("forecast"), "actual")


@P.add("t12_backtest", "SELECT product_id, segment, origin, method, step, round(forecast + 0.0000001::DOUBLE, 2) AS forecast, actual FROM tested", **TABLES, **TESTED)
def t12_all(spark, d):
    return tested(spark, d).withColumn("forecast", F.round(F.col("forecast") + 1e-7, 2))


def rounded_scores(df):
    return df.withColumns({k: F.round(F.col(k) + 1e-7, 3) for k in ("mae", "smape", "bias")})


ROUNDED = ", ".join(f"round({k} + 0.0000001::DOUBLE, 3) AS {k}" for k in ("mae", "smape", "bias"))


@P.add("t13_accuracy_by_segment", f"SELECT method, segment, n, {ROUNDED} FROM scored", **TABLES, **TESTED)
def t13(spark, d):
    return rounded_scores(ts.accuracy(tested(spark, d), ["method", "segment"]))


@P.add("t13_best_method", "SELECT segment, min_by(method, (mae, method)) AS method FROM scored GROUP BY 1", **TABLES, **TESTED)
def t13b(spark, d):
    return ts.best_method(ts.accuracy(tested(spark, d), ["method", "segment"]))


@P.add(
    "t14_selection_report",
    """SELECT round(auto + 0.0000001::DOUBLE, 3) AS auto_mae, round(best + 0.0000001::DOUBLE, 3) AS best_fixed_mae, round(legacy + 0.0000001::DOUBLE, 3) AS legacy_mae, round(1 - auto / legacy, 6) AS reduction_vs_legacy FROM
    (SELECT avg(abs(forecast - actual)) FILTER (method = CASE WHEN segment = 'smooth' THEN 'ewma' WHEN segment IN ('intermittent', 'lumpy') THEN 'sba' ELSE 'moving_avg' END) AS auto FROM tested),
    (SELECT min(m) AS best, max(m) FILTER (method = 'moving_avg') AS legacy FROM (SELECT method, avg(abs(forecast - actual)) AS m FROM tested GROUP BY 1))""",
    **TABLES,
    **TESTED,
)
def t14(spark, d):
    rows = tested(spark, d).withColumn("auto", ts.method_for(F.col("segment")) == F.col("method"))
    miss = F.abs(F.col("forecast") - F.col("actual"))
    by_method = rows.groupBy("method").agg(F.avg(miss).alias("mae"), F.sum(F.when(F.col("auto"), miss)).alias("s"), F.sum(F.col("auto").cast("long")).alias("k"))
    one = by_method.agg((F.sum("s") / F.sum("k")).alias("auto_mae"), F.min("mae").alias("best_fixed_mae"), F.max(F.when(F.col("method") == "moving_avg", F.col("mae"))).alias("legacy_mae"))
    return one.select(*[F.round(F.col(k) + 1e-7, 3).alias(k) for k in one.columns], F.round(1 - F.col("auto_mae") / F.col("legacy_mae"), 6).alias("reduction_vs_legacy"))


@P.add(
    "t15_daily_std",
    "SELECT product_id, round(sqrt(greatest(sum(u * u) / 120 - (sum(u) / 120) * (sum(u) / 120), 0.0::DOUBLE)), 4) AS std_daily FROM (SELECT product_id, created, CAST(sum(qty) AS DOUBLE) AS u FROM valid_sales WHERE created >= DATE '1999-09-03' AND created < DATE '2000-01-01' GROUP BY 1, 2) GROUP BY 1",
)
def t15(spark, d):
    daily = sales.window(valid(spark, d), "1999-09-03", END).groupBy("product_id", "created").agg(F.sum("qty").cast("double").alias("u"))
    mean = F.sum("u") / 120
    return daily.groupBy("product_id").agg(F.round(F.sqrt(F.greatest(F.sum(F.col("u") * F.col("u")) / 120 - mean * mean, F.lit(0.0))), 4).alias("std_daily"))


@P.add(
    "t16_seasonal_index",
    """SELECT group_id, round(CASE WHEN n < 12 OR obs = 0 THEN 1.0::DOUBLE ELSE greatest(0.6::DOUBLE, least(1.6::DOUBLE, (obs * (mm / mean) + 4) / (obs + 4))) END, 4) AS season FROM
    (SELECT group_id, count(*) AS n, avg(u) AS mean, count(*) FILTER (month(m) = 1) AS obs, avg(u) FILTER (month(m) = 1) AS mm FROM (SELECT group_id, date_trunc('month', created) AS m, CAST(sum(qty) AS DOUBLE) AS u FROM past_sales GROUP BY 1, 2) GROUP BY 1)""",
)
def t16(spark, d):
    return ts.seasonal_index(past(spark, d), "group_id", 1).withColumn("season", F.round("season", 4))


@P.add(
    "t17_xyz_by_size",
    """SELECT group_id, CASE WHEN cv <= 0.5 THEN 'X' WHEN cv <= 1.0 THEN 'Y' ELSE 'Z' END AS xyz, round(cv, 4) AS cv FROM (SELECT group_id, stddev_pop(x) / avg(x) AS cv FROM
    (SELECT g.group_id, m.ym, coalesce(v.x, 0.0::DOUBLE) AS x FROM (SELECT DISTINCT group_id FROM lines) g CROSS JOIN grid m LEFT JOIN (SELECT group_id, strftime(created, '%Y-%m') AS ym, CAST(sum(qty) AS DOUBLE) AS x FROM lines GROUP BY 1, 2) v ON v.group_id = g.group_id AND v.ym = m.ym) GROUP BY 1)""",
    **TABLES,
)
def t17(spark, d):
    s = ts.densify(valid(spark, d), "group_id", "qty", TODAY, MONTHS).select("group_id", F.explode("series").alias("x"))
    cv = s.groupBy("group_id").agg((F.stddev_pop("x") / F.avg("x")).alias("cv"))
    return cv.select("group_id", F.when(F.col("cv") <= 0.5, "X").when(F.col("cv") <= 1.0, "Y").otherwise("Z").alias("xyz"), F.round("cv", 4).alias("cv"))


@P.add(
    "t18_xyz_by_interval",
    """SELECT product_id, CASE WHEN cv < 0.3 THEN 'X' WHEN cv < 0.6 THEN 'Y' ELSE 'Z' END AS xyz, round(cv, 4) AS cv FROM (SELECT s.product_id, g.cv FROM product_series s LEFT JOIN
    (SELECT product_id, sqrt(greatest(CAST(sum(gap * gap) AS DOUBLE) / count(*) - (CAST(sum(gap) AS DOUBLE) / count(*)) * (CAST(sum(gap) AS DOUBLE) / count(*)), 0.0::DOUBLE)) / (CAST(sum(gap) AS DOUBLE) / count(*)) AS cv FROM (SELECT product_id, i - lag(i) OVER (PARTITION BY product_id ORDER BY i) AS gap FROM (SELECT product_id, i, series[i] AS x FROM product_series, range(1, 25) t(i)) WHERE x > 0) WHERE gap IS NOT NULL GROUP BY 1) g ON s.product_id = g.product_id)""",
    **TABLES,
)
def t18(spark, d):
    df = by_product(spark, d).withColumn("cv", ts.interval_cv(F.col("series")))
    return df.select("product_id", ts.xyz(F.col("cv"), 0.3, 0.6).alias("xyz"), F.round("cv", 4).alias("cv"))


@P.add(
    "t19_lifecycle",
    """SELECT product_id, CASE WHEN NOT dead THEN 'dead' WHEN (12 - f) * 30 + 15 <= 90 THEN 'new' WHEN recent <= 0 AND 12 - l >= 9 THEN 'declining' WHEN recent <= 0 THEN 'mature'
    WHEN prior <= 0 OR recent >= prior * 1.2::DOUBLE THEN 'growing' WHEN recent <= prior * 0.5::DOUBLE THEN 'declining' ELSE 'mature' END AS lifecycle FROM
    (SELECT product_id, list_sum(y) > 0 AS dead, list_sum(y[7:12]) AS recent, list_sum(y[1:6]) AS prior, list_position(list_transform(y, lambda v: v > 0), true) AS f, 13 - list_position(list_transform(list_reverse(y), lambda v: v > 0), true) AS l FROM (SELECT product_id, series[13:24] AS y FROM unit_series))""",
    **TABLES,
)
def t19(spark, d):
    year_units = ts.densify(valid(spark, d), "product_id", "qty", TODAY, MONTHS).select("product_id", F.slice("series", 13, 12).alias("series"))
    sold = F.exists("series", lambda x: x > 0)
    return year_units.select("product_id", ts.lifecycle(F.col("series"), sold).alias("lifecycle"))


def pace_sql(monthly: str, mtd: str) -> str:
    """Working days of January 2000 without Sundays: 26, of which 13 up to the 15th."""
    return f"""SELECT manager_id, round(target, 2) AS target, round(mtd, 2) AS mtd, round(target / 26 * 13, 2) AS expected, round(target / 26 * 13 - mtd, 2) AS gap, round(greatest(target - mtd, 0) / 13, 2) AS today_needed, round(CASE WHEN target > 0 THEN 100 * mtd / target ELSE 0 END, 1) AS attainment,
    CASE WHEN target <= 0 THEN 'no_target' WHEN mtd / (target / 26 * 13) >= 1.05 THEN 'ahead' WHEN mtd / (target / 26 * 13) < 0.95 THEN 'behind' ELSE 'on' END AS status FROM
    (SELECT manager_id, target, coalesce(mtd, 0.0::DOUBLE) AS mtd FROM (SELECT manager_id, sum(x) / count(*) AS target FROM (SELECT manager_id, x, row_number() OVER (PARTITION BY manager_id ORDER BY ym DESC) AS r FROM ({monthly})) WHERE r <= 3 GROUP BY 1) LEFT JOIN ({mtd}) USING (manager_id))"""


PACE = {
    "pace_shipped": pace_sql("SELECT manager_id, strftime(created, '%Y-%m') AS ym, CAST(sum(amount) AS DOUBLE) AS x FROM past_sales GROUP BY 1, 2", "SELECT manager_id, CAST(sum(amount) AS DOUBLE) AS mtd FROM valid_sales WHERE created >= DATE '2000-01-01' AND created <= DATE '2000-01-15' GROUP BY 1"),
    "eur_paid": "SELECT p.*, CAST(amount AS DOUBLE) * coalesce(f.rate, 1.0::DOUBLE) AS eur FROM payments p ASOF LEFT JOIN fx_rates f ON p.currency_id = f.currency_id AND p.from_date >= f.valid_from",
    "pace_paid": pace_sql("SELECT manager_id, strftime(from_date, '%Y-%m') AS ym, round(sum(eur), 4) AS x FROM eur_paid WHERE from_date < DATE '2000-01-01' GROUP BY 1, 2", "SELECT manager_id, round(sum(eur), 4) AS mtd FROM eur_paid WHERE from_date >= DATE '2000-01-01' AND from_date <= DATE '2000-01-15' GROUP BY 1"),
}


def targets(spark, d):
    """Shipped and paid targets of every manager in the middle of January."""
    from tidemark.operators.risk import to_eur

    today, first = F.lit("2000-01-15").cast("date"), F.lit("2000-01-01").cast("date")
    whole, elapsed = col.working_days(first, F.last_day(first)), col.working_days(first, today)
    until = lambda day: (day >= first) & (day <= today)
    mtd = valid(spark, d).where(until(F.col("created"))).groupBy("manager_id").agg(F.sum("amount").cast("double").alias("mtd"))
    shipped = ts.pace(sales.monthly(past(spark, d), ["manager_id"], "amount", "eur"), "manager_id", "eur", mtd, "2000-01", elapsed, whole)
    paid = to_eur(c.payments(spark, d), c.fx_rates(spark), "amount", "from_date", "eur")
    by_month = paid.where(F.col("from_date") < first).groupBy("manager_id", F.date_format("from_date", "yyyy-MM").alias("ym")).agg(F.round(F.sum("eur"), 4).alias("eur"))
    got = paid.where(until(F.col("from_date"))).groupBy("manager_id").agg(F.round(F.sum("eur"), 4).alias("mtd"))
    return shipped, ts.pace(by_month, "manager_id", "eur", got, "2000-01", elapsed, whole)


@P.add("t20_run_rate_targets", "SELECT 'shipped' AS metric, * FROM pace_shipped UNION ALL SELECT 'paid', * FROM pace_paid", **PACE)
def t20(spark, d):
    shipped, paid = targets(spark, d)
    return shipped.select(F.lit("shipped").alias("metric"), "*").unionByName(paid.select(F.lit("paid").alias("metric"), "*"))
