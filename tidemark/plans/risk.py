"""Credit risk queries."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from tidemark.operators import risk as rk, sales, scorecard as sc
from tidemark.operators.asof import first_at, shifted, totals_at
from tidemark.plans.base import Plans
from tidemark.plans.sales import END, past, valid, year
from tidemark.sources import canonical as c
from tidemark.sources.published import publish, read_published
from tidemark.sources.sinks import checkpointed, shared_dir

P = Plans()
T = {
    "aged": "SELECT d.*, date_diff('day', created, DATE '2000-01-01') - grace_days AS od FROM debt_eur d JOIN agreements a ON a.client_id = d.client_id",
    "aging": """SELECT client_id, sum(CASE WHEN od > 180 THEN eur ELSE 0 END) AS o180, sum(CASE WHEN od BETWEEN 91 AND 180 THEN eur ELSE 0 END) AS o91, sum(CASE WHEN od BETWEEN 61 AND 90 THEN eur ELSE 0 END) AS o61,
      sum(CASE WHEN od BETWEEN 31 AND 60 THEN eur ELSE 0 END) AS o31, sum(CASE WHEN od BETWEEN 1 AND 30 THEN eur ELSE 0 END) AS o1, sum(CASE WHEN od <= 0 THEN eur ELSE 0 END) AS o0, sum(eur) AS total, greatest(max(od), 0) AS worst, count(*) AS n FROM aged GROUP BY 1""",
    "label": "SELECT client_id, CAST(sum(CASE WHEN od >= 180 THEN eur ELSE 0 END) >= 100 AS INTEGER) AS label FROM aged GROUP BY 1",
}


def debt(spark, d, as_of=END):
    lines = c.debt_lines(spark, d).where(F.col("created") <= F.lit(as_of).cast("date"))
    return rk.to_eur(lines, c.fx_rates(spark), "total", None, "eur", as_of)


def aged(spark, d):
    return rk.aged(debt(spark, d), c.agreements(spark, d), END)


@P.add("j7_fx_as_of_payment", "SELECT manager_id, strftime(from_date, '%Y-%m') AS ym, round(sum(CAST(amount AS DOUBLE) * coalesce(rate, 1.0::DOUBLE)), 4) AS eur FROM (SELECT p.*, f.rate FROM payments p ASOF LEFT JOIN fx_rates f ON p.currency_id = f.currency_id AND p.from_date >= f.valid_from) GROUP BY 1, 2")
def j7(spark, d):
    paid = rk.to_eur(c.payments(spark, d), c.fx_rates(spark), "amount", "from_date", "eur")
    return paid.groupBy("manager_id", F.date_format("from_date", "yyyy-MM").alias("ym")).agg(F.round(F.sum("eur"), 4).alias("eur"))


@P.add("a26_debt_aging", "SELECT client_id, round(o180, 4) AS o180, round(o91, 4) AS o91, round(o61, 4) AS o61, round(o31, 4) AS o31, round(o1, 4) AS o1, round(o0, 4) AS o0, round(total, 4) AS total, n, round(o180 / total, 4) AS pct FROM aging", **T)
def a26(spark, d):
    a = rk.debt_aging(aged(spark, d))
    names = {"o180": "overdue_180plus", "o91": "overdue_91_180", "o61": "overdue_61_90", "o31": "overdue_31_60", "o1": "overdue_1_30", "o0": "current_debt", "total": "total_debt"}
    return a.select("client_id", *[F.round(v, 4).alias(k) for k, v in names.items()], F.col("n_lines").alias("n"), F.round("pct_180plus", 4).alias("pct"))


@P.add(
    "a27_debt_trajectory",
    "SELECT client_id, round(a, 2) AS new_3m, round(b, 2) AS prior_3m, m AS months_12, round(CASE WHEN b > 0 THEN least(a / b, 10.0::DOUBLE) WHEN a > 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END, 4) AS growth FROM (SELECT client_id, sum(CASE WHEN created > DATE '1999-10-01' THEN eur ELSE 0 END) AS a, sum(CASE WHEN created > DATE '1999-07-01' AND created <= DATE '1999-10-01' THEN eur ELSE 0 END) AS b, count(DISTINCT CASE WHEN created > DATE '1999-01-01' THEN strftime(created, '%Y-%m') END) AS m FROM debt_eur GROUP BY 1)",
)
def a27(spark, d):
    return rk.debt_trajectory(debt(spark, d), END).select("client_id", F.round("new_3m", 2).alias("new_3m"), F.round("prior_3m", 2).alias("prior_3m"), "months_12", F.round("growth", 4).alias("growth"))


@P.add(
    "a28_credit_terms",
    "SELECT a.client_id, CAST(CASE WHEN control_amount THEN amount_limit ELSE 0 END AS DOUBLE) AS credit_limit, CAST(grace_days AS INTEGER) AS grace_days, CAST(control_amount OR control_days AS INTEGER) AS has_control, round(CASE WHEN control_amount AND amount_limit > 0 THEN least(greatest(coalesce(exposure, 0) / CAST(amount_limit AS DOUBLE), 0), 2) ELSE 0 END::DOUBLE, 4) AS utilization FROM agreements a LEFT JOIN (SELECT client_id, sum(eur) AS exposure FROM debt_eur GROUP BY 1) e ON e.client_id = a.client_id",
)
def a28(spark, d):
    """Limit, longest grace, any control, and the use of the limit between 0 and 2."""
    owed = debt(spark, d).groupBy("client_id").agg(F.sum("eur").alias("exposure"))
    terms = c.agreements(spark, d).groupBy("client_id").agg(F.sum(F.when(F.col("control_amount"), F.col("amount_limit")).otherwise(0)).cast("double").alias("credit_limit"), F.max("grace_days").alias("grace_days"), F.max((F.col("control_amount") | F.col("control_days")).cast("int")).alias("has_control"))
    use = F.when(F.col("credit_limit") > 0, F.least(F.greatest(F.coalesce("exposure", F.lit(0.0)) / F.col("credit_limit"), F.lit(0.0)), F.lit(2.0))).otherwise(0.0)
    return terms.join(owed, "client_id", "left").select("client_id", "credit_limit", "grace_days", "has_control", F.round(use, 4).alias("utilization"))


@P.add(
    "a29_j6_rfm",
    "SELECT coalesce(y.client_id, h.client_id) AS client_id, coalesce(turnover, 0.0::DOUBLE) AS turnover, coalesce(orders, 0) AS orders, recency, tenure FROM (SELECT client_id, CAST(sum(amount) AS DOUBLE) AS turnover, count(DISTINCT order_id) AS orders FROM year_sales GROUP BY 1) y FULL JOIN (SELECT client_id, CAST(date_diff('day', max(created), DATE '2000-01-01') AS INTEGER) AS recency, CAST(date_diff('month', min(created), DATE '2000-01-01') AS INTEGER) AS tenure FROM past_sales GROUP BY 1) h ON y.client_id = h.client_id",
)
def a29(spark, d):
    t = F.lit(END).cast("date")
    win = year(spark, d).groupBy("client_id").agg(F.sum("amount").cast("double").alias("turnover"), F.countDistinct("order_id").alias("orders"))
    first = F.min("created")
    hist = past(spark, d).groupBy("client_id").agg(F.datediff(t, F.max("created")).alias("recency"), ((F.year(t) - F.year(first)) * 12 + F.month(t) - F.month(first)).alias("tenure"))
    return win.join(hist, "client_id", "full_outer").fillna(0.0, ["turnover"]).fillna(0, ["orders"])


@P.add(
    "a30_return_rate",
    "SELECT s.client_id, round(coalesce(r.q, 0.0::DOUBLE) / s.q, 6) AS return_rate FROM (SELECT client_id, CAST(sum(qty) AS DOUBLE) AS q FROM year_sales GROUP BY 1) s LEFT JOIN (SELECT client_id, CAST(sum(q) AS DOUBLE) AS q FROM (SELECT client_id, return_id, line_no, max(qty) AS q FROM return_lines WHERE return_date >= DATE '1999-01-01' AND return_date < DATE '2000-01-01' GROUP BY 1, 2, 3) GROUP BY 1) r ON r.client_id = s.client_id",
)
def a30(spark, d):
    rets = c.return_lines(spark, d).where((F.col("return_date") >= F.lit("1999-01-01").cast("date")) & (F.col("return_date") < F.lit(END).cast("date")))
    back = rets.groupBy("client_id", "return_id", "line_no").agg(F.max("qty").alias("q")).groupBy("client_id").agg(F.sum("q").cast("double").alias("r"))
    sold = year(spark, d).groupBy("client_id").agg(F.sum("qty").cast("double").alias("q"))
    return sold.join(back, "client_id", "left").select("client_id", F.round(F.coalesce("r", F.lit(0.0)) / F.col("q"), 6).alias("return_rate"))


@P.add("a32_turnover_by_currency", "SELECT region_id, cur AS currency_id, CAST(sum(amount) AS DOUBLE) AS eur FROM (SELECT *, product_id % 3 AS cur FROM year_sales) GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY region_id) > 1")
def a32(spark, d):
    from pyspark.sql import Window

    per = year(spark, d).groupBy("region_id", (F.col("product_id") % 3).alias("currency_id")).agg(F.sum("amount").cast("double").alias("eur"))
    return per.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("region_id"))).where("k > 1").drop("k")


@P.add("a34_exposure_buckets", "SELECT CASE WHEN od <= 0 THEN 'current' WHEN od <= 30 THEN '0-30' WHEN od <= 60 THEN '31-60' WHEN od <= 90 THEN '61-90' ELSE '91+' END AS bucket, count(*) AS n, round(sum(eur), 4) AS eur FROM aged GROUP BY 1", **T)
def a34(spark, d):
    od = F.col("od")
    bucket = F.when(od <= 0, "current").when(od <= 30, "0-30").when(od <= 60, "31-60").when(od <= 90, "61-90").otherwise("91+")
    return aged(spark, d).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("eur"), 4).alias("eur"))


@P.add("a54_manager_debt", "SELECT manager_id, round(sum(eur), 4) AS eur, round(sum(CASE WHEN od > 180 THEN eur ELSE 0 END), 4) AS eur_180, count(*) AS n FROM aged GROUP BY 1", **T)
def a54(spark, d):
    return aged(spark, d).groupBy("manager_id").agg(F.round(F.sum("eur"), 4).alias("eur"), F.round(F.sum(F.when(F.col("od") > 180, F.col("eur")).otherwise(0.0)), 4).alias("eur_180"), F.count(F.lit(1)).alias("n"))


@P.add("e1_severe_label", "SELECT client_id, label FROM label", **T)
def e1(spark, d):
    return rk.severe_label(aged(spark, d))


def buyers(spark, d):
    """Clients in the buyer's role: those with an order of any day."""
    return c.read(spark, d, "orders").select(F.col("o_custkey").alias("client_id")).distinct()


#: The label's day: the features' day and half a year.
LABEL_DAY = "2000-07-01"


def matrix(spark, d, as_of=END, sentinel=None, label_day=None):
    """Features of all buyers as of a day, whether they are in severe arrears that day (already_default), and the severe label of label_day, that day's own if none is given.

    A buyer without sales has the worst recency plus one, or `sentinel` where one is given (the serving variant). Debt lines are
    read once, with what they are on both days.
    """
    t, later = F.lit(as_of).cast("date"), label_day or as_of
    recent = F.col("created") >= F.add_months(t, -12)
    lines = valid(spark, d).where(F.col("created") < t)
    first = F.min("created")
    sold = lines.groupBy("client_id").agg(
        F.coalesce(F.sum(F.when(recent, F.col("amount"))), F.lit(0)).cast("double").alias("turnover"), F.countDistinct(F.when(recent, F.col("order_id"))).alias("orders"), F.datediff(t, F.max("created")).alias("recency"),
        ((F.year(t) - F.year(first)) * 12 + F.month(t) - F.month(first)).alias("tenure"), F.sum(F.when(recent, F.col("qty"))).cast("double").alias("_q"),
    )
    rets = c.return_lines(spark, d).where((F.col("return_date") >= F.add_months(t, -12)) & (F.col("return_date") < t))
    back = rets.groupBy("client_id", "return_id", "line_no").agg(F.max("qty").alias("q")).groupBy("client_id").agg(F.sum("q").cast("double").alias("_r"))
    terms = c.agreements(spark, d)
    both = c.debt_lines(spark, d).where(F.col("created") <= F.greatest(t, F.lit(later).cast("date"))).select("client_id", "currency_id", "total", "created")
    both = rk.to_eur(rk.to_eur(both, c.fx_rates(spark), "total", None, "eur", as_of), c.fx_rates(spark), "total", None, "eur_later", later)
    owed = checkpointed(rk.aged(both, terms, as_of).drop("total", "currency_id"))
    then = rk.aged(owed.where(F.col("created") <= F.lit(later).cast("date")).select("client_id", "created", F.col("eur_later").alias("eur")), terms, later)
    now = owed.where(F.col("created") <= t)
    parts = [rk.debt_aging(now), rk.debt_trajectory(now, as_of), rk.severe_label(now).withColumnRenamed("label", "already_default"), rk.severe_label(then)]
    df = terms.join(buyers(spark, d), "client_id", "left_semi").groupBy("client_id").agg(F.sum(F.when(F.col("control_amount"), F.col("amount_limit")).otherwise(0)).cast("double").alias("credit_limit"), F.max("grace_days").alias("grace_days"), F.max((F.col("control_amount") | F.col("control_days")).cast("int")).alias("has_control"))
    if sentinel is None:
        sold = checkpointed(sold)
    for part in (sold, back, *parts):
        df = df.join(part, "client_id", "left")
    if sentinel is None:
        worst = sold.agg((F.max("recency") + 1).alias("_worst"))
        df = df.join(F.broadcast(worst)).withColumn("recency", F.coalesce("recency", "_worst")).drop("_worst")
    df = df.withColumn("recency", F.coalesce("recency", F.lit(sentinel or 0))).withColumn("return_rate", F.when(F.col("_q") > 0, F.coalesce("_r", F.lit(0.0)) / F.col("_q")).otherwise(0.0)).drop("_q", "_r").fillna(0).fillna(0.0)
    use = F.when(F.col("credit_limit") > 0, F.least(F.greatest(F.col("total_debt") / F.col("credit_limit"), F.lit(0.0)), F.lit(2.0))).otherwise(0.0)
    return df.withColumn("utilization", use)


def labelled(spark, d):
    """The modelling table: features at END, the label half a year later."""
    return matrix(spark, d, label_day=LABEL_DAY)


def growth(new, prior):
    return F.when(prior > 0, F.least(new / prior, F.lit(10.0))).when(new > 0, 10.0).otherwise(0.0)


def matrix_at(spark, d, dates, sentinel=3000):
    """The serving features of all buyers at each of the ascending dates, as (client_id, as_of, features): each fact table is read once for all dates.

    Debt is totalled in its own currency and converted at each date's rate.
    """
    n, back3, back6, back12 = len(dates), shifted(dates, 3), shifted(dates, 6), shifted(dates, 12)
    last, one = F.lit(dates[-1]).cast("date"), F.lit(1).cast("long")
    created = F.col("created")
    enters, leaves = first_at(F.date_add(created, 1), dates), first_at(F.date_add(created, 1), back12)

    orders = valid(spark, d).where(created < last).groupBy("client_id", "order_id", "created").agg(F.sum("amount").alias("amount"), F.sum("qty").alias("qty"))
    sold = totals_at(
        orders, ["client_id"], n,
        {"a0": (F.col("amount"), enters), "a1": (F.col("amount"), leaves), "q0": (F.col("qty"), enters), "q1": (F.col("qty"), leaves), "o0": (one, enters), "o1": (one, leaves)},
        {"first": (created, enters)}, {"last": (created, enters)},
    )
    lines = c.return_lines(spark, d).where(F.col("return_date") < last).groupBy("client_id", "return_id", "line_no", F.col("return_date").alias("created")).agg(F.max("qty").alias("qty"))
    # Of a return line's rows the largest in the window counts: each while no larger one is in it. Windows are of one length, so an
    # earlier row leaves first.
    spans = lines.groupBy("client_id", "return_id", "line_no").agg(F.collect_list(F.struct("qty", "created", enters.alias("a"), leaves.alias("b"))).alias("rows"))
    larger = lambda e, f: (f["qty"] > e["qty"]) | ((f["qty"] == e["qty"]) & (f["created"] > e["created"]))
    starts = lambda e: F.aggregate(F.filter("rows", lambda f: larger(e, f) & (f["created"] < e["created"])), e["a"], lambda x, f: F.greatest(x, f["b"]))
    stops = lambda e: F.aggregate(F.filter("rows", lambda f: larger(e, f) & (f["created"] > e["created"])), e["b"], lambda x, f: F.least(x, f["a"]))
    spans = spans.select("client_id", F.explode(F.transform("rows", lambda e: F.struct(e["qty"].alias("qty"), starts(e).alias("a"), stops(e).alias("b")))).alias("e")).where("e.a < e.b")
    back = totals_at(spans, ["client_id"], n, {"r0": (F.col("e.qty"), F.col("e.a")), "r1": (F.col("e.qty"), F.col("e.b"))})

    terms = c.agreements(spark, d).join(buyers(spark, d), "client_id", "left_semi")
    grace = terms.groupBy("client_id").agg(F.max("grace_days").alias("grace_days"), F.sum(F.when(F.col("control_amount"), F.col("amount_limit")).otherwise(0)).cast("double").alias("credit_limit"), F.max((F.col("control_amount") | F.col("control_days")).cast("int")).alias("has_control"))
    owed = checkpointed(c.debt_lines(spark, d).where(created <= last).select("client_id", "currency_id", "total", "created").join(grace.select("client_id", "grace_days"), "client_id"))
    past = lambda days: first_at(F.date_add(created, F.col("grace_days") + days), dates)
    ages = {f"p{days}": (F.col("total"), past(days)) for days in (1, 31, 61, 91, 180, 181)}
    debt = totals_at(owed, ["client_id", "currency_id"], n, {"p0": (F.col("total"), first_at(created, dates)), **ages, "l3": (F.col("total"), first_at(created, back3)), "l6": (F.col("total"), first_at(created, back6)), "lines": (one, first_at(created, dates))}, {"due": (F.date_add(created, F.col("grace_days")), first_at(created, dates))})
    grid = spark.createDataFrame(list(enumerate(dates)), "date_index int, as_of string").withColumn("as_of", F.to_date("as_of"))
    rated = rk.to_eur(debt.join(F.broadcast(grid), "date_index").withColumn("total", F.lit(1)), c.fx_rates(spark), "total", "as_of", "rate_eur")
    eur = lambda plus, less, name: F.sum((F.col(plus) - (F.coalesce(less, F.lit(0)) if less else 0)).cast("double") * F.col("rate_eur")).alias(name)
    rated = rated.fillna(0, [*ages, "l3", "l6"])
    debt = rated.groupBy("client_id", "date_index").agg(
        eur("p181", None, "overdue_180plus"), eur("p91", "p181", "overdue_91_180"), eur("p61", "p91", "overdue_61_90"), eur("p31", "p61", "overdue_31_60"), eur("p1", "p31", "overdue_1_30"), eur("p0", "p1", "current_debt"), eur("p0", None, "total_debt"),
        eur("p0", "l3", "new_3m"), eur("l3", "l6", "prior_3m"), eur("p180", None, "_severe"), F.sum("lines").alias("n_lines"), F.min("due").alias("_due"),
    )
    months = owed.groupBy("client_id", F.date_format("created", "yyyy-MM").alias("ym")).agg(F.min("created").alias("a"), F.max("created").alias("b"))
    months = totals_at(months, ["client_id"], n, {"m0": (one, first_at(F.col("a"), dates)), "m1": (one, first_at(F.col("b"), back12))})

    df = grace.join(F.broadcast(grid))
    for part in (sold, back, debt, months):
        df = df.join(part, ["client_id", "date_index"], "left")
    df = df.fillna(0, ["a0", "a1", "q0", "q1", "o0", "o1", "r0", "r1", "m0", "m1", "n_lines"]).fillna(0.0, ["overdue_180plus", "overdue_91_180", "overdue_61_90", "overdue_31_60", "overdue_1_30", "current_debt", "total_debt", "new_3m", "prior_3m", "_severe"])
    t, first, qty = F.col("as_of"), F.col("first"), (F.col("q0") - F.col("q1")).cast("double")
    limit, total = F.col("credit_limit"), F.col("total_debt")
    return df.select(
        "client_id", "as_of", "overdue_180plus", "overdue_91_180", "overdue_61_90", "overdue_31_60", "overdue_1_30", "current_debt", "total_debt", "new_3m", "prior_3m", "n_lines", "credit_limit", "grace_days", "has_control",
        F.when(total > 0, F.col("overdue_180plus") / total).otherwise(0.0).alias("pct_180plus"), F.greatest(F.coalesce(F.datediff(t, "_due"), F.lit(0)), F.lit(0)).alias("max_overdue_days"), growth(F.col("new_3m"), F.col("prior_3m")).alias("growth"), (F.col("m0") - F.col("m1")).alias("months_12"),
        (F.col("_severe") >= 100).cast("int").alias("already_default"), (F.col("a0") - F.col("a1")).cast("double").alias("turnover"), (F.col("o0") - F.col("o1")).alias("orders"), F.coalesce(F.datediff(t, "last"), F.lit(sentinel)).alias("recency"),
        F.coalesce((F.year(t) - F.year(first)) * 12 + F.month(t) - F.month(first), F.lit(0)).alias("tenure"), F.when(qty > 0, (F.col("r0") - F.col("r1")).cast("double") / qty).otherwise(0.0).alias("return_rate"),
        F.when(limit > 0, F.least(F.greatest(total / limit, F.lit(0.0)), F.lit(2.0))).otherwise(0.0).alias("utilization"),
    )


#: The columns of the matrix, and how risk runs in each of those that do not restate the label.
DIRECTION = {
    "overdue_91_180": "up", "overdue_61_90": "up", "overdue_31_60": "up", "overdue_1_30": "up", "current_debt": "up", "total_debt": "up", "max_overdue_days": "up", "n_lines": "up", "growth": "up", "months_12": "up", "new_3m": "up",
    "credit_limit": "down", "utilization": "up", "grace_days": "up", "has_control": "up", "turnover": "down", "orders": "down", "recency": "up", "tenure": "down", "return_rate": "up",
}
FEATURES = ["overdue_180plus", "pct_180plus", *DIRECTION]


def owed_sql(as_of: str) -> str:
    """Debt lines of a day with their value and days past grace that day."""
    t = f"DATE '{as_of}'"
    return f"""SELECT d.*, CAST(d.total AS DOUBLE) * coalesce(f.rate, 1.0::DOUBLE) AS eur, date_diff('day', d.created, {t}) - grace_days AS od FROM debt_lines d JOIN agreements a ON a.client_id = d.client_id LEFT JOIN LATERAL
          (SELECT rate FROM fx_rates f WHERE f.currency_id = d.currency_id AND f.valid_from <= {t} ORDER BY valid_from DESC LIMIT 1) f ON true WHERE d.created <= {t}"""


def matrix_sql(name: str, as_of: str, sentinel: str = "w", label_day: str | None = None) -> dict[str, str]:
    """The same matrix in SQL, as a table `name`."""
    t = f"DATE '{as_of}'"
    return {
        f"{name}_then": owed_sql(label_day or as_of),
        f"{name}_label": f"SELECT client_id, CAST(sum(CASE WHEN od >= 180 THEN eur ELSE 0 END) >= 100 AS INTEGER) AS label FROM {name}_then GROUP BY 1",
        f"{name}_owed": owed_sql(as_of),
        f"{name}_debt": f"""SELECT client_id, sum(CASE WHEN od > 180 THEN eur ELSE 0 END) AS overdue_180plus, sum(CASE WHEN od BETWEEN 91 AND 180 THEN eur ELSE 0 END) AS overdue_91_180, sum(CASE WHEN od BETWEEN 61 AND 90 THEN eur ELSE 0 END) AS overdue_61_90,
          sum(CASE WHEN od BETWEEN 31 AND 60 THEN eur ELSE 0 END) AS overdue_31_60, sum(CASE WHEN od BETWEEN 1 AND 30 THEN eur ELSE 0 END) AS overdue_1_30, sum(CASE WHEN od <= 0 THEN eur ELSE 0 END) AS current_debt, sum(eur) AS total_debt,
          greatest(max(od), 0) AS max_overdue_days, count(*) AS n_lines, sum(CASE WHEN created > {t} - INTERVAL 3 MONTH THEN eur ELSE 0 END) AS new_3m, sum(CASE WHEN created > {t} - INTERVAL 6 MONTH AND created <= {t} - INTERVAL 3 MONTH THEN eur ELSE 0 END) AS prior_3m,
          count(DISTINCT CASE WHEN created > {t} - INTERVAL 12 MONTH THEN strftime(created, '%Y-%m') END) AS months_12, CAST(sum(CASE WHEN od >= 180 THEN eur ELSE 0 END) >= 100 AS INTEGER) AS already_default FROM {name}_owed GROUP BY 1""",
        f"{name}_sold": f"""SELECT client_id, coalesce(CAST(sum(amount) FILTER (created >= {t} - INTERVAL 12 MONTH) AS DOUBLE), 0) AS turnover, count(DISTINCT order_id) FILTER (created >= {t} - INTERVAL 12 MONTH) AS orders, date_diff('day', max(created), {t}) AS recency,
          date_diff('month', min(created), {t}) AS tenure, CAST(sum(qty) FILTER (created >= {t} - INTERVAL 12 MONTH) AS DOUBLE) AS q FROM valid_sales WHERE created < {t} GROUP BY 1""",
        f"{name}_back": f"SELECT client_id, CAST(sum(q) AS DOUBLE) AS r FROM (SELECT client_id, return_id, line_no, max(qty) AS q FROM return_lines WHERE return_date >= {t} - INTERVAL 12 MONTH AND return_date < {t} GROUP BY 1, 2, 3) GROUP BY 1",
        name: f"""SELECT *, CASE WHEN credit_limit > 0 THEN least(greatest(total_debt / credit_limit, 0), 2) ELSE 0 END AS utilization FROM (SELECT g.client_id, CAST(CASE WHEN control_amount THEN amount_limit ELSE 0 END AS DOUBLE) AS credit_limit, grace_days, CAST(control_amount OR control_days AS INTEGER) AS has_control,
          coalesce(turnover, 0) AS turnover, coalesce(orders, 0) AS orders, coalesce(recency, {sentinel}) AS recency, coalesce(tenure, 0) AS tenure, CASE WHEN q > 0 THEN coalesce(r, 0) / q ELSE 0 END AS return_rate,
          {', '.join(f'coalesce({x}, 0) AS {x}' for x in ('overdue_180plus', 'overdue_91_180', 'overdue_61_90', 'overdue_31_60', 'overdue_1_30', 'current_debt', 'total_debt', 'max_overdue_days', 'n_lines', 'new_3m', 'prior_3m', 'months_12', 'already_default', 'label'))},
          CASE WHEN total_debt > 0 THEN overdue_180plus / total_debt ELSE 0 END AS pct_180plus, CASE WHEN prior_3m > 0 THEN least(new_3m / prior_3m, 10) WHEN new_3m > 0 THEN 10 ELSE 0 END AS growth
          FROM agreements g LEFT JOIN {name}_debt d ON d.client_id = g.client_id LEFT JOIN {name}_sold s ON s.client_id = g.client_id LEFT JOIN {name}_back b ON b.client_id = g.client_id LEFT JOIN {name}_label l ON l.client_id = g.client_id CROSS JOIN (SELECT max(recency) + 1 AS w FROM {name}_sold) WHERE g.client_id IN (SELECT o_custkey FROM orders))""",
    }


MATRIX = matrix_sql("mat", END, label_day=LABEL_DAY)
COLUMNS = [*FEATURES, "prior_3m", "already_default", "label"]
SHOWN = "client_id, " + ", ".join(f"round(CAST({f} AS DOUBLE) + 0.000000001::DOUBLE, 4) AS {f}" for f in COLUMNS)


def shown(m):
    return m.select("client_id", *[F.round(F.col(f).cast("double") + 1e-9, 4).alias(f) for f in COLUMNS])


@P.add("e2_feature_matrix", f"SELECT {SHOWN} FROM mat", **MATRIX)
def e2(spark, d):
    """Features of a day, arrears of that day and the label of half a year later."""
    return shown(labelled(spark, d))


@P.add("e3_serving_features", f"SELECT {SHOWN} FROM served", **matrix_sql("served", END, "3000"))
def e3(spark, d):
    """The serving variant: a fixed recency for buyers without sales, so that one client's row needs no other's."""
    return shown(matrix(spark, d, sentinel=3000))


#: A card to score with where a query's subject is not the fit; weights are made up, points and bands are the fixed ones.
CARD = {
    "intercept": -1.2, "a": 1.0, "b": 0.0, **rk.POINTS,
    "features": {
        "pct_180plus": {"splits": [0.0, 0.4, 0.8], "woe": [1.5, 0.4, -0.6, -1.8], "coef": -0.9},
        "recency": {"splits": [60.0, 180.0], "woe": [0.6, 0.0, -0.7], "coef": -0.5},
        "orders": {"splits": [1.0, 4.0], "woe": [-0.5, 0.1, 0.5], "coef": -0.4},
    },
}


SCORE = "least(greatest((600 + 20 / ln(2.0::DOUBLE) * ln((1 - pd) / pd) - 400) / 400 * 100, 0), 100)"


def card_sql(table: str) -> dict[str, str]:
    """lin, pd and score of CARD over a matrix table, and the five-factor score."""
    return {
        f"{table}_card": f"""SELECT *, 1 / (1 + exp(-lin)) AS pd FROM (SELECT m.*, -1.2::DOUBLE - 0.9::DOUBLE * CASE WHEN pct_180plus <= 0 THEN 1.5 WHEN pct_180plus <= 0.4 THEN 0.4 WHEN pct_180plus <= 0.8 THEN -0.6 ELSE -1.8 END::DOUBLE
          - 0.5::DOUBLE * CASE WHEN recency <= 60 THEN 0.6 WHEN recency <= 180 THEN 0.0 ELSE -0.7 END::DOUBLE - 0.4::DOUBLE * CASE WHEN orders <= 1 THEN -0.5 WHEN orders <= 4 THEN 0.1 ELSE 0.5 END::DOUBLE AS lin FROM {table} m)""",
        f"{table}_five": f"""SELECT *, CASE WHEN score >= 80 THEN 'A' WHEN score >= 65 THEN 'B' WHEN score >= 45 THEN 'C' ELSE 'D' END AS rating FROM (SELECT client_id, label, CAST(round_even(CASE WHEN blocked THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN util > 1 THEN least(raw, 40) WHEN util > 0.9 THEN least(raw, 60) ELSE raw END, 0) AS INTEGER) AS score FROM
          (SELECT m.client_id, label, CASE WHEN has_control = 1 AND credit_limit > 0 AND total_debt > 0 THEN total_debt / credit_limit END AS util, m.client_id % 50 = 0 AS blocked,
            round(35 * coalesce((paid + 0.5::DOUBLE * partial) / (paid + partial + notpaid), 1), 4) + round(25 * CASE WHEN turnover > 0 THEN greatest(0, least(1, 1 - greatest(0, (total_debt - current_debt) / turnover - 0.25::DOUBLE) / 1.25::DOUBLE)) WHEN total_debt - current_debt <= 0 THEN 1 ELSE 0 END, 4)
            + round(20 * (0.5::DOUBLE * greatest(0, least(1, 1 - recency / 90)) + 0.5::DOUBLE * least(1, orders / 24)), 4) + round(10 * least(1, tenure / 24), 4) + round(10 * greatest(0, least(1, 1 - 2 * return_rate)), 4) AS raw
            FROM {table} m LEFT JOIN paid_counts p ON p.client_id = m.client_id))""",
    }


PAID = {
    "paid_counts": "SELECT o_custkey AS client_id, count(*) FILTER (o_orderstatus = 'F') AS paid, count(*) FILTER (o_orderstatus = 'P' AND o_orderpriority <> '5-LOW') AS partial, count(*) FILTER (o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')) AS notpaid FROM orders GROUP BY 1"
}
FIVE = MATRIX | PAID | card_sql("mat")


@P.add(
    "e10_scorecard",
    """SELECT client_id, round(lin, 4) AS lin, round(pd, 6) AS pd, round(least(greatest((600 + 20 / ln(2.0::DOUBLE) * ln((1 - pd) / pd) - 400) / 400 * 100, 0), 100), 2) AS score, CASE WHEN pd < 0.02 THEN 'A' WHEN pd < 0.05 THEN 'B' WHEN pd < 0.15 THEN 'C' ELSE 'D' END AS band,
    CASE WHEN c1 >= c2 AND c1 >= c3 THEN 'pct_180plus' WHEN c3 > c2 THEN 'recency' ELSE 'orders' END AS leading FROM (SELECT *, round(0.9 * CASE WHEN pct_180plus <= 0 THEN 1.5 WHEN pct_180plus <= 0.4 THEN 0.4 WHEN pct_180plus <= 0.8 THEN 0.6 ELSE 1.8 END, 4) AS c1,
      round(0.4 * CASE WHEN orders <= 1 THEN 0.5 WHEN orders <= 4 THEN 0.1 ELSE 0.5 END, 4) AS c2, round(0.5 * CASE WHEN recency <= 60 THEN 0.6 WHEN recency <= 180 THEN 0.0 ELSE 0.7 END, 4) AS c3 FROM mat_card)""",
    **FIVE,
)
def e10(spark, d):
    return rk.apply_scorecard(labelled(spark, d), CARD).select("client_id", F.round("lin", 4).alias("lin"), F.round("pd", 6).alias("pd"), "score", "band", F.col("contributions")[0]["feature"].alias("leading"))


def five(spark, d, m=None):
    """The five-factor score of every buyer: discipline from payment states, utilisation of controlled limits, every fiftieth blocked."""
    from tidemark.plans.more import a52

    m = (labelled(spark, d) if m is None else m).join(rk.discipline(a52(spark, d)), "client_id", "left").fillna(1.0, ["discipline"])
    use = F.when((F.col("has_control") == 1) & (F.col("credit_limit") > 0) & (F.col("total_debt") > 0), F.col("total_debt") / F.col("credit_limit"))
    df = m.select("client_id", "label", "discipline", (F.col("total_debt") - F.col("current_debt")).alias("overdue"), "turnover", "orders", F.col("recency").alias("recency_days"), F.col("tenure").alias("tenure_months"), "return_rate", use.alias("utilization"), (F.col("client_id") % 50 == 0).alias("blocked"))
    return rk.five_factor_score(df)


@P.add("e12_five_factor_score", "SELECT client_id, score, rating FROM mat_five", **FIVE)
def e12(spark, d):
    return five(spark, d).select("client_id", "score", "rating")


@P.add(
    "e6_woe_of_recency",
    """SELECT CAST(bin AS INTEGER) AS bin, min(x) AS lo, max(x) AS hi, count(*) AS n, CAST(sum(label) AS BIGINT) AS bad, round(ln(any_value(1.0::DOUBLE) * ((sum(label) + 0.5::DOUBLE) / any_value(tb)) / ((count(*) - sum(label) + 0.5::DOUBLE) / any_value(tg))), 4) AS woe,
    round(((sum(label) + 0.5::DOUBLE) / any_value(tb) - (count(*) - sum(label) + 0.5::DOUBLE) / any_value(tg)) * ln(((sum(label) + 0.5::DOUBLE) / any_value(tb)) / ((count(*) - sum(label) + 0.5::DOUBLE) / any_value(tg))), 6) AS iv FROM
    (SELECT x, label, tb, tg, CASE WHEN x = 0 THEN 0 WHEN x <= q[1] THEN 1 WHEN x <= q[2] THEN 2 WHEN x <= q[3] THEN 3 WHEN x <= q[4] THEN 4 ELSE 5 END AS bin FROM (SELECT CAST(recency AS DOUBLE) AS x, label FROM mat),
      (SELECT quantile_cont(CAST(recency AS DOUBLE), [0.2, 0.4, 0.6, 0.8]) AS q FROM mat WHERE recency <> 0), (SELECT greatest(sum(label), 0.5::DOUBLE) AS tb, greatest(count(*) - sum(label), 0.5::DOUBLE) AS tg FROM mat)) GROUP BY 1""",
    **MATRIX,
)
def e6(spark, d):
    m = labelled(spark, d).select(F.col("recency").cast("double").alias("recency"), "label")
    return sc.quantile_woe(m, "recency", "label").select("bin", "lo", "hi", "n", "bad", F.round("woe", 4).alias("woe"), F.round("iv", 6).alias("iv"))


AUC_SQL = "round((sum(CASE WHEN label = 1 THEN r END) - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label))), 6)"


@P.add(
    "e13_auc_of_worst_overdue",
    "SELECT CAST(count(*) AS BIGINT) AS n, round((sum(CASE WHEN label = 1 THEN r END) - CAST(sum(label) AS DOUBLE) * (sum(label) + 1) / 2) / (CAST(sum(label) AS DOUBLE) * (count(*) - sum(label))), 6) AS auc FROM (SELECT label, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS r FROM aging JOIN label USING (client_id))",
    **T,
)
def e13(spark, d):
    lines = aged(spark, d)
    df = rk.debt_aging(lines).join(rk.severe_label(lines), "client_id").select(F.col("n_lines").cast("double").alias("s"), "label")
    return rk.binary_metrics(df, "s", "label").select("n", F.round("auc", 6).alias("auc"))


@P.add(
    "e13_metrics_of_the_card",
    f"""SELECT n, auc, round(2 * auc - 1, 6) AS gini, round(ks, 6) AS ks, round(brier, 6) AS brier FROM (SELECT CAST(count(*) AS BIGINT) AS n, {AUC_SQL} AS auc, avg((pd - label) * (pd - label)) AS brier FROM
      (SELECT pd, label, rank() OVER (ORDER BY pd) + (count(*) OVER (PARTITION BY pd) - 1) / 2 AS r FROM mat_card)),
    (SELECT max(abs(p / tp - g / tg)) AS ks FROM (SELECT pd, sum(sum(label)) OVER (ORDER BY pd) AS p, sum(count(*) - sum(label)) OVER (ORDER BY pd) AS g FROM mat_card GROUP BY 1), (SELECT CAST(sum(label) AS DOUBLE) AS tp, CAST(count(*) - sum(label) AS DOUBLE) AS tg FROM mat_card))""",
    **FIVE,
)
def e13_card(spark, d):
    m = rk.binary_metrics(rk.apply_scorecard(labelled(spark, d), CARD).select(F.round("pd", 12).alias("pd"), "label"), "pd", "label")
    return m.select("n", F.round("auc", 6).alias("auc"), F.round(2 * F.round("auc", 6) - 1, 6).alias("gini"), F.round("ks", 6).alias("ks"), F.round("brier", 6).alias("brier"))


@P.add("e13_reliability", "SELECT CAST(least(floor(pd * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(pd) + 0.000000001::DOUBLE, 6) AS mean_score, round(avg(label), 6) AS rate FROM mat_card GROUP BY 1", **FIVE)
def e13_bins(spark, d):
    r = rk.reliability(rk.apply_scorecard(labelled(spark, d), CARD), "pd", "label")
    return r.select("bin", "n", F.round(F.col("mean_score") + 1e-9, 6).alias("mean_score"), F.round("rate", 6).alias("rate"))


DRIFT = ["score", "turnover", "orders", "recency", "tenure", "return_rate", "total_debt", "max_overdue_days", "n_lines", "new_3m", "utilization"]
BEFORE = matrix_sql("was", "1999-01-01")


def edges_sql(table: str, by: str = "") -> str:
    """Interpolated decile edges of v in table, without repeats, as a list e."""
    return f"SELECT {by + ', ' if by else ''}list_sort(list_distinct(list_transform(range(1, 10), lambda i: xs[CAST(floor(i / 10 * (len(xs) - 1)) AS INTEGER) + 1] + (xs[CAST(ceil(i / 10 * (len(xs) - 1)) AS INTEGER) + 1] - xs[CAST(floor(i / 10 * (len(xs) - 1)) AS INTEGER) + 1]) * (i / 10 * (len(xs) - 1) - floor(i / 10 * (len(xs) - 1)))))) AS e FROM (SELECT {by + ', ' if by else ''}list(v ORDER BY v) AS xs FROM {table}{' GROUP BY 1' if by else ''})"


PSI = "sum((greatest(a, 0.000001::DOUBLE) - greatest(e, 0.000001::DOUBLE)) * ln(greatest(a, 0.000001::DOUBLE) / greatest(e, 0.000001::DOUBLE)))"
LEVEL = "CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'ok' END AS level"


@P.add(
    "e17_psi",
    f"SELECT feature, round(psi, 6) AS psi, {LEVEL} FROM (SELECT feature, {PSI} AS psi FROM (SELECT feature, bin, coalesce(sum(share) FILTER (side = 'now'), 0) AS a, coalesce(sum(share) FILTER (side = 'was'), 0) AS e FROM shares GROUP BY 1, 2) GROUP BY 1)",
    **FIVE,
    **BEFORE,
    **card_sql("was"),
    longed="SELECT 'now' AS side, feature, v FROM (SELECT {c} FROM mat_card) UNPIVOT (v FOR feature IN ({n})) UNION ALL SELECT 'was', feature, v FROM (SELECT {c} FROM was_card) UNPIVOT (v FOR feature IN ({n}))".format(
        n=", ".join(DRIFT), c="CAST(round(least(greatest((600 + 20 / ln(2.0::DOUBLE) * ln((1 - pd) / pd) - 400) / 400 * 100, 0), 100), 2) AS DOUBLE) AS score, " + ", ".join(f"CAST(round({f}, 9) AS DOUBLE) AS {f}" for f in DRIFT[1:])
    ),
    base="SELECT feature, v FROM longed WHERE side = 'was'",
    edged=edges_sql("base", "feature"),
    binned="SELECT side, l.feature, len(list_filter(e, lambda x: x < v)) AS bin FROM longed l JOIN edged d ON d.feature = l.feature",
    shares="SELECT side, feature, bin, count(*) / CAST(sum(count(*)) OVER (PARTITION BY side, feature) AS DOUBLE) AS share FROM binned GROUP BY 1, 2, 3",
)
def e17(spark, d):
    """Drift of the score and ten features between two year ends."""
    was, now = (rk.apply_scorecard(matrix(spark, d, t), CARD).select("score", *[F.round(F.col(f).cast("double"), 9).alias(f) for f in DRIFT[1:]]) for t in ("1999-01-01", END))
    return rk.psi(was, now, DRIFT).select("feature", F.round("psi", 6).alias("psi"), "level")


@P.add(
    "e17_psi_of_turnover",
    f"SELECT round(psi, 6) AS psi, {LEVEL} FROM (SELECT {PSI} AS psi FROM (SELECT bin, coalesce(max(share) FILTER (NOT base), 0) AS a, coalesce(max(share) FILTER (base), 0) AS e FROM (SELECT base, bin, count(*) / CAST(sum(count(*)) OVER (PARTITION BY base) AS DOUBLE) AS share FROM (SELECT base, len(list_filter(e, lambda x: x < v)) AS bin FROM turned, edged) GROUP BY 1, 2) GROUP BY 1))",
    turned="SELECT created < DATE '1999-01-01' AS base, CAST(sum(amount) AS DOUBLE) AS v FROM valid_sales WHERE created >= DATE '1998-01-01' AND created < DATE '2000-01-01' GROUP BY client_id, 1",
    before="SELECT v FROM turned WHERE base",
    edged=edges_sql("before"),
)
def e17_turnover(spark, d):
    """Drift of the buyers' turnover between two years, buyers without a sale in a year left out."""
    lines = valid(spark, d)
    was, now = (sales.window(lines, a, b).groupBy("client_id").agg(F.sum("amount").cast("double").alias("v")) for a, b in (("1998-01-01", "1999-01-01"), ("1999-01-01", END)))
    return rk.psi(was, now, ["v"]).select(F.round("psi", 6).alias("psi"), "level")


@P.add(
    "e18_two_scores",
    f"""SELECT 'five_factor' AS model, {AUC_SQL} AS auc FROM (SELECT label, rank() OVER (ORDER BY -score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM mat_five) UNION ALL
    SELECT 'scorecard', {AUC_SQL} FROM (SELECT label, rank() OVER (ORDER BY pd) + (count(*) OVER (PARTITION BY pd) - 1) / 2 AS r FROM mat_card)""",
    **FIVE,
)
def e18(spark, d):
    """The older five-factor score against the scorecard's probability, on the same label."""
    m = checkpointed(labelled(spark, d))
    old = five(spark, d, m).select((-F.col("score")).cast("double").alias("s"), "label")
    new = rk.apply_scorecard(m, CARD).select(F.round("pd", 12).alias("s"), "label")
    both = [rk.binary_metrics(t, "s", "label").select(F.lit(n).alias("model"), F.round("auc", 6).alias("auc")) for n, t in (("five_factor", old), ("scorecard", new))]
    return both[0].union(both[1])


def fitted(spark, d, label="label"):
    m = checkpointed(labelled(spark, d))
    return m, sc.fit_scorecard(m, DIRECTION, label)


@P.add("e5_monotone_bins")
def e5(spark, d):
    """Monotone weights of every feature by bin; the merging works on counts of a few bins."""
    m = labelled(spark, d)
    found = sc.monotone_bins(m, DIRECTION, "label")
    rows = [(f, i, [None, *b["splits"]][i], [*b["splits"], None][i], round(b["woe"][min(i, len(b["woe"]) - 1)], 6)) for f, b in found.items() for i in range(len(b["splits"]) + 1)]
    return spark.createDataFrame(rows, "feature string, bin int, lo double, hi double, woe double")


@P.add("e8_scorecard_fit")
def e8(spark, d):
    """The card fitted on WOE with balanced labels and a Platt step, as its model table (S5): coefficients and weights by bin."""
    m, card = fitted(spark, d)
    return sc.card_rows(spark, card).select("feature", "bin", "lo", "hi", F.round("woe", 6).alias("woe"), F.round("coef", 6).alias("coef"), F.round(F.col("header")["a"], 6).alias("platt_a"), F.round(F.col("header")["intercept"], 6).alias("intercept"))


@P.add("e7_s5_score_by_model_table")
def e7(spark, d):
    """The fitted card published as a version of the model table, read back pinned to it and applied: probability, points and band."""
    m, card = fitted(spark, d)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/card-{uuid.uuid4().hex}"
    version = publish(sc.card_rows(spark, card), path)
    read = sc.card_from(read_published(spark, path, version))
    return rk.apply_scorecard(m, read).select("client_id", F.round("pd", 6).alias("pd"), "score", "band", F.col("contributions")[0]["feature"].alias("leading"))


def metrics(rows, name, score="p", label="label"):
    return rk.binary_metrics(rows.select(F.round(score, 12).alias("s"), F.col(label).cast("int").alias("y")), "s", "y").select(F.lit(name).alias("model"), "n", F.round("auc", 4).alias("auc"), F.round("ks", 4).alias("ks"), F.round("brier", 4).alias("brier"))


def union(parts):
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def by_card(directions, c=0.5, l1=False, label="label"):
    def fit(train):
        card = sc.fit_scorecard(train, directions, label, c, l1)
        return lambda t: rk.apply_scorecard(t, card).withColumn("p", F.col("pd")).drop("pd", "lin", "score", "band", "contributions")

    return fit


@P.add("e9_challengers_out_of_fold")
def e9(spark, d):
    """Scorecard and boosted trees on the same folds of clients: out-of-fold AUC, KS and Brier."""
    m = checkpointed(labelled(spark, d))
    trees = lambda train: sc.fit_trees(train, list(DIRECTION), "label")
    return union([metrics(sc.out_of_fold(m, "client_id", 3, fit), name) for name, fit in (("scorecard", by_card(DIRECTION)), ("trees", trees))])


DEBT_TABLE = ["overdue_91_180", "overdue_61_90", "overdue_31_60", "overdue_1_30", "current_debt", "total_debt", "max_overdue_days", "n_lines"]
DERIVED = ["growth", "months_12", "new_3m"]


@P.add("e16_tier_ablation")
def e16(spark, d):
    """AUC of trees on nested groups of features: what is left of the skill without the debt table the label comes from."""
    m = checkpointed(labelled(spark, d))
    free = [f for f in DIRECTION if f not in DEBT_TABLE + DERIVED]
    tiers = {"non_debt_table_only": free, "leading_no_aging_buckets": free + DERIVED, "primary_full": list(DIRECTION), "with_tautological": FEATURES}
    return union([metrics(sc.out_of_fold(m, "client_id", 2, lambda t, fs=fs: sc.fit_trees(t, fs, "label")), name).withColumn("n_features", F.lit(len(fs))) for name, fs in tiers.items()])


VINTAGES = "SELECT CAST(DATE '1997-01-05' + to_days(CAST(i * 14 AS INTEGER)) AS DATE) AS m FROM range(0, 40) t(i)"


def vintages(spark, d, n=40, horizon=180):
    """At-risk clients at biweekly dates with features of the day and whether they are severe `horizon` days later.

    At risk: with debt, and less than 100 EUR of it 180 days past grace. Debt lines are read once for all dates; each is worth what it was on its own day.
    """
    dates = [(dt.date(1997, 1, 5) + dt.timedelta(days=14 * i)).isoformat() for i in range(n)]
    created = F.col("created")
    rated = rk.to_eur(c.debt_lines(spark, d).where(created <= F.lit(dates[-1]).cast("date")), c.fx_rates(spark), "total", "created", "eur")
    lines = checkpointed(rated.join(c.agreements(spark, d).select("client_id", "grace_days"), "client_id").select("client_id", "created", "grace_days", F.col("eur").cast("decimal(28,8)").alias("eur")))
    one, e, at = F.lit(1).cast("long"), F.col("eur"), first_at(created, dates)
    past = lambda days: first_at(F.date_add(created, F.greatest(F.col("grace_days") + days, F.lit(0))), dates)
    debt = totals_at(
        lines, ["client_id"], n,
        {"p": (e, at), **{f"p{k}": (e, past(k)) for k in (1, 31, 61, 91, 180)}, "l3": (e, first_at(created, shifted(dates, 3))), "n_lines": (one, at), "later": (e, past(180 - horizon))},
        {"due": (F.date_add(created, F.col("grace_days")), at)},
    )
    months = lines.groupBy("client_id", F.date_format("created", "yyyy-MM").alias("ym")).agg(F.min("created").alias("a"), F.max("created").alias("b"))
    months = totals_at(months, ["client_id"], n, {"m0": (one, first_at(F.col("a"), dates)), "m1": (one, first_at(F.col("b"), shifted(dates, 12)))})
    df = debt.fillna(0, ["p1", "p31", "p61", "p91", "p180", "l3", "later"]).where("p > 0 and p180 < 100").join(months.fillna(0, ["m1"]), ["client_id", "date_index"])
    grid = F.broadcast(spark.createDataFrame(list(enumerate(dates)), "date_index int, m string").withColumn("m", F.to_date("m")))
    between = lambda a, b, name: (F.col(a) - F.col(b)).cast("double").alias(name)
    return df.join(grid, "date_index").select(
        F.col("m").alias("vintage"), "client_id", between("p91", "p180", "overdue_91_180"), between("p61", "p91", "overdue_61_90"), between("p31", "p61", "overdue_31_60"), between("p1", "p31", "overdue_1_30"), between("p", "p1", "current_debt"), F.col("p").cast("double").alias("total_debt"),
        F.greatest(F.datediff("m", "due"), F.lit(0)).alias("max_overdue_days"), "n_lines", between("p", "l3", "new_3m"), (F.col("m0") - F.col("m1")).alias("months_12"), (F.col("later") >= 100).cast("int").alias("label"),
    )


@P.add(
    "e4_vintage_pool",
    """SELECT CAST(m AS VARCHAR) AS vintage, client_id, round(total, 4) AS total_debt, round(overdue, 4) AS overdue_1_30, n AS n_lines, label FROM (SELECT m, client_id, sum(eur) FILTER (created <= m) AS total, coalesce(sum(eur) FILTER (created <= m AND od BETWEEN 1 AND 30), 0) AS overdue, CAST(count(*) FILTER (created <= m) AS BIGINT) AS n,
      coalesce(sum(eur) FILTER (created <= m AND od >= 180), 0) AS severe, CAST(coalesce(sum(eur) FILTER (od + 180 >= 180), 0) >= 100 AS INTEGER) AS label FROM
      (SELECT dates.m, d.client_id, d.created, d.eur, date_diff('day', d.created, dates.m) - grace_days AS od FROM dates JOIN (SELECT d.*, CAST(d.total AS DOUBLE) * coalesce(f.rate, 1.0::DOUBLE) AS eur FROM debt_lines d ASOF LEFT JOIN fx_rates f ON d.currency_id = f.currency_id AND d.created >= f.valid_from) d ON d.created <= dates.m + 180 JOIN agreements a ON a.client_id = d.client_id)
      GROUP BY 1, 2) WHERE total > 0 AND severe < 100""",
    dates=VINTAGES,
)
def e4(spark, d):
    return vintages(spark, d).select(F.col("vintage").cast("string").alias("vintage"), "client_id", F.round("total_debt", 4).alias("total_debt"), F.round("overdue_1_30", 4).alias("overdue_1_30"), "n_lines", "label")


AGING = {"overdue_31_60": "up", "overdue_1_30": "up", "current_debt": "up", "total_debt": "up", "max_overdue_days": "up", "n_lines": "up", "months_12": "up", "new_3m": "up"}
BEHAVIOUR = {"total_debt": "up", "n_lines": "up", "months_12": "up", "new_3m": "up"}


def halves(spark, d):
    """The vintages before and after the middle one."""
    rows = checkpointed(vintages(spark, d))
    return rows, rows.where("vintage < date'1997-10-12'"), rows.where("vintage >= date'1997-10-12'")


POOL = """SELECT client_id, label FROM (SELECT m, client_id, sum(eur) FILTER (created <= m) AS total, coalesce(sum(eur) FILTER (created <= m AND od >= 180), 0) AS severe, CAST(coalesce(sum(eur) FILTER (od + 180 >= 180), 0) >= 100 AS INTEGER) AS label FROM
      (SELECT dates.m, d.client_id, d.created, d.eur, date_diff('day', d.created, dates.m) - grace_days AS od FROM dates JOIN (SELECT d.*, CAST(d.total AS DOUBLE) * coalesce(f.rate, 1.0::DOUBLE) AS eur FROM debt_lines d ASOF LEFT JOIN fx_rates f ON d.currency_id = f.currency_id AND d.created >= f.valid_from) d ON d.created <= dates.m + 180 JOIN agreements a ON a.client_id = d.client_id)
      GROUP BY 1, 2) WHERE total > 0 AND severe < 100"""


@P.add(
    "e14_fold_sizes",
    """SELECT fold, count(*) AS clients, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos) / sum(n), 6) AS rate FROM (SELECT n, pos, CAST(CASE WHEN (place // 5) % 2 = 0 THEN place % 5 ELSE 4 - place % 5 END AS INTEGER) AS fold FROM
      (SELECT n, pos, row_number() OVER (ORDER BY pos DESC, n DESC, client_id % 256, client_id) - 1 AS place FROM (SELECT client_id, count(*) AS n, sum(label) AS pos FROM pool GROUP BY 1))) GROUP BY 1""",
    dates=VINTAGES,
    pool=POOL,
)
def e14_sizes(spark, d):
    """Clients, rows, positives and rate of each stratified fold of the vintages."""
    rows = checkpointed(vintages(spark, d).select("client_id", "label"))
    both = rows.join(sc.stratified_folds(rows, "client_id", "label", 5), "client_id")
    return both.groupBy("fold").agg(F.countDistinct("client_id").alias("clients"), F.count(F.lit(1)).alias("n_rows"), F.sum("label").cast("long").alias("positives"), F.round(F.avg("label"), 6).alias("rate"))


@P.add("e14_folds_and_penalties")
def e14(spark, d):
    """Stratified folds by client over all vintages, then all penalties tried on the early half and tested on the later one."""
    rows, early, late = halves(spark, d)
    dealt = checkpointed(rows.join(sc.stratified_folds(rows, "client_id", "label", 5), "client_id"))
    grouped = metrics(sc.out_of_fold(dealt, "client_id", 5, by_card(BEHAVIOUR), F.col("fold")), "stratified folds").withColumns({"penalty": F.lit("l2"), "c": F.lit(0.5)})
    sweep = [metrics(by_card(BEHAVIOUR, c_, l1)(early)(late), "later half").withColumns({"penalty": F.lit("l1" if l1 else "l2"), "c": F.lit(c_)}) for l1 in (False, True) for c_ in (0.05, 0.1, 0.25, 0.5, 1.0, 2.0)]
    return union([grouped, *sweep])


@P.add("e15_calibration_and_bands")
def e15(spark, d):
    """Out-of-time Brier of raw, Platt and isotonic scores, and quantile bands with their realised rates."""
    _, early, late = halves(spark, d)
    scored = checkpointed(by_card(BEHAVIOUR)(early)(late).select("client_id", "p", "label"))
    cal = sc.calibrations(scored, "p", "label").select(F.lit("calibration").alias("part"), F.col("method").alias("name"), F.lit(None).cast("long").alias("n"), F.round("brier", 6).alias("value"))
    cuts = sc.exact_quantiles(scored, "p", list(sc.FORWARD_CUTS.values()))
    band = F.when(F.col("p") >= cuts[2], "very_high").when(F.col("p") >= cuts[1], "high").when(F.col("p") >= cuts[0], "medium").otherwise("low")
    rates = scored.groupBy(band.alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("value")).select(F.lit("band").alias("part"), "name", "n", "value")
    return cal.unionByName(rates)


@P.add("e11_forward_score")
def e11(spark, d):
    """Forward risk of every buyer by two cards fitted on the vintages: without and with the aging buckets."""
    rows, _, _ = halves(spark, d)
    behaviour, aging = sc.fit_scorecard(rows, BEHAVIOUR, "label"), sc.fit_scorecard(rows, AGING, "label")
    raw = {**behaviour, "a": 1.0, "b": 0.0}
    q = sc.exact_quantiles(rk.apply_scorecard(rows, raw).select("pd"), "pd", list(sc.FORWARD_CUTS.values()))
    scored = rk.forward_score(matrix(spark, d, sentinel=3000), behaviour, aging, dict(zip(sc.FORWARD_CUTS, q)))
    return scored.select("client_id", "score", "pd_behavioral", "pd_with_aging", "band", "already_rolling")


@P.add("e22_buyer_sample")
def e22(spark, d):
    """A sampling operator: the first 200 buyers in the order of a hash."""
    return c.read(spark, d, "customer").select(F.col("c_custkey").alias("client_id")).orderBy(F.xxhash64("client_id", F.lit(42)), "client_id").limit(200)
