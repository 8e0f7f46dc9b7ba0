"""Queries over many as-of dates at once, gates against stored floors, and pooled fits."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import saturation
from tidemark.operators import actions as ac, pricing as pr, reco, risk as rk, sales, scorecard as sc, supply
from tidemark.operators.asof import first_at, totals_at
from tidemark.operators.ranking import first_per
from tidemark.plans import actions, reco as reco_plans, risk
from tidemark.plans.base import Plans
from tidemark.plans.sales import END, past, valid
from tidemark.sources import canonical as c
from tidemark.sources.sinks import checkpointed

P = Plans()
DATES = "SELECT CAST(DATE '1999-01-01' + to_days(CAST(i * 14 AS INTEGER)) AS DATE) AS m FROM range(0, 20) t(i)"


def dates(spark, n=20):
    return spark.range(n).select(F.date_add(F.lit("1999-01-01").cast("date"), (F.col("id") * 14).cast("int")).alias("m"))


@P.add(
    "g9_panel_sweep",
    "SELECT CAST(m AS VARCHAR) AS as_of, count(*) AS n, round(sum(least(before, after)) / sum(after), 4) AS fill FROM (SELECT m, product_id, CAST(coalesce(sum(qty) FILTER (created < m), 0) AS DOUBLE) AS before, CAST(coalesce(sum(qty) FILTER (created >= m), 0) AS DOUBLE) AS after FROM dates JOIN valid_sales ON created >= m - 30 AND created < m + 30 GROUP BY 1, 2) GROUP BY 1",
    dates=DATES,
)
def g9(spark, d):
    """Last month's units as the plan of the next one, for all dates in one job."""
    lines = valid(spark, d).join(F.broadcast(dates(spark)), (F.col("created") >= F.date_sub("m", 30)) & (F.col("created") < F.date_add("m", 30)))
    new = F.col("created") >= F.col("m")
    per = lines.groupBy("m", "product_id").agg(F.coalesce(F.sum(F.when(~new, F.col("qty"))), F.lit(0)).cast("double").alias("before"), F.coalesce(F.sum(F.when(new, F.col("qty"))), F.lit(0)).cast("double").alias("after"))
    return per.groupBy(F.col("m").cast("string").alias("as_of")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.least("before", "after")) / F.sum("after"), 4).alias("fill"))


@P.add(
    "a40_learned_override",
    "SELECT producer_id, abc, round(least(greatest(quantile_cont(f, 0.5), 0.5::DOUBLE), 1.5::DOUBLE) + 0.000000001::DOUBLE, 4) AS factor, count(*) AS n FROM (SELECT l_suppkey AS producer_id, CASE WHEN l_partkey % 10 < 2 THEN 'A' WHEN l_partkey % 10 < 5 THEN 'B' ELSE 'C' END AS abc, (1 - l_discount) * (1 + l_tax) AS f FROM lineitem) GROUP BY 1, 2 HAVING count(*) >= 5",
)
def a40(spark, d):
    return supply.learned_factors(c.quantity_feedback(spark, d))


FLOORS = {"hit_rate": 0.05, "precision": 0.01, "recall": 0.02, "mrr": 0.02}


@P.add("c14_regression_floors", "SELECT metric, value, least, value >= least AS holds FROM (SELECT * FROM judged UNPIVOT (value FOR metric IN (hit_rate, precision, recall, mrr))) JOIN (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in FLOORS.items()) + ") t(metric, least) USING (metric)", **reco_plans.T, **reco_plans.BLEND, judged="SELECT CAST(hit_rate AS DOUBLE) AS hit_rate, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(mrr AS DOUBLE) AS mrr FROM (" + reco_plans.C11_SQL + ")")
def c14(spark, d):
    """Metrics of the hybrid against stored floors; a row per metric and whether it holds."""
    from tidemark.plans.reco import c11b

    floors = spark.createDataFrame(list(FLOORS.items()), "metric string, least double")
    row = c11b(spark, d)
    long = row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("hit_rate", "precision", "recall", "mrr")])).alias("x")).select("x.metric", "x.value")
    return long.join(F.broadcast(floors), "metric").withColumn("holds", F.col("value") >= F.col("least"))


@P.add("r10_pooled_elasticity")
def r10(spark, d):
    """One slope per group over its products' cells: agreement and product means are swept out by turns, then a regression."""
    cells = sales.panel_cells(valid(spark, d).withColumn("agreement_id", F.col("region_id")))
    groups = c.read(spark, d, "part").select(F.col("p_partkey").alias("product_id"), F.col("p_brand").alias("group_id"))
    df = cells.join(groups, "product_id").where("qty > 0 and price > 0").select("group_id", "product_id", "agreement_id", F.ln("price").alias("x"), F.ln("qty").alias("y"))
    return pr.pooled_slope(df, "group_id", ["product_id", "agreement_id"]).select("group_id", F.round(-F.col("slope"), 6).alias("elasticity"), "n")


SNAPSHOTS = ac.rolling_snapshots(END, 4)
SIGNAL_COLUMNS = [f"sig_{k}" for ks in ac.SIGNALS.values() for k in ks]
INPUTS = ["monetary", "recency_days", "order_count", *[f"is_{t}" for t in ac.SIGNALS], *SIGNAL_COLUMNS]


def training_rows(spark, d, snapshots=SNAPSHOTS):
    """Candidates of all types at each snapshot with features, signals, label and the old priority.

    Every table is read once: what a client has at a snapshot are totals of what has entered and left by then, and labels are
    totals of what enters when its outcome window opens and leaves when the window has passed it.
    """
    n, created, one = len(snapshots), F.col("created"), F.lit(1).cast("long")
    last = F.date_add(F.lit(snapshots[-1]).cast("date"), ac.OUTCOME_DAYS)
    at = lambda days, day=created: first_at(F.date_add(day, days), snapshots)
    grid = F.broadcast(spark.createDataFrame(list(enumerate(snapshots)), "date_index int, m string").withColumn("m", F.to_date("m")))
    lines = checkpointed(valid(spark, d).where(created <= last).select("client_id", "group_id", "order_id", "created", "amount"))

    orders = lines.groupBy("client_id", "order_id", "created").agg(F.sum("amount").alias("amount"))
    totals = totals_at(orders, ["client_id"], n, {"a0": (F.col("amount"), at(1)), "a1": (F.col("amount"), at(366)), "o0": (one, at(1)), "o90": (one, at(91)), "o184": (one, at(185)), "o365": (one, at(366))}, highs={"last": (created, at(1))})
    totals = checkpointed(totals.fillna(0, ["a1", "o90", "o184", "o365"]).join(grid, "date_index").withColumn("silence_days", F.datediff("m", "last")))
    lots = lines.select("client_id", "group_id", "order_id", "created").distinct()
    per = checkpointed(totals_at(lots, ["client_id", "group_id"], n, {"n_orders": (one, at(1))}, {"a": (created, at(1))}, {"b": (created, at(1))}))
    ahead = lambda keys: totals_at(lines.select(*keys, "created").distinct(), keys, n, {"h0": (one, at(-ac.OUTCOME_DAYS)), "h1": (one, at(0))}).where("h0 > coalesce(h1, 0)").select("date_index", *keys, F.lit(1).alias("hit"))
    bought = checkpointed(ahead(["client_id", "group_id"]))
    item = ["date_index", "client_id", "group_id"]

    cycle, gone = F.greatest(F.datediff("b", "a") / (F.col("n_orders") - 1), F.lit(7.0)), F.datediff("m", "b")
    due = per.where("n_orders >= 3 and b > a").join(grid, "date_index").select(*item, "n_orders", cycle.alias("cycle_days"), gone.alias("elapsed_days")).where("elapsed_days between cycle_days and 3 * cycle_days")
    reorder = due.join(bought, item, "left").withColumns({"task_type": F.lit("reorder_due"), "overdue_ratio": F.col("elapsed_days") / F.col("cycle_days"), "u": ac.reorder_urgency(F.col("elapsed_days"), F.col("cycle_days"))})

    eur = lambda t, amount, day: rk.to_eur(t, c.fx_rates(spark), amount, day, "eur").withColumn("eur", F.col("eur").cast("decimal(28,8)"))
    owed = eur(c.debt_lines(spark, d).where(created <= last), "total", "created").join(c.agreements(spark, d).select("client_id", "grace_days"), "client_id")
    owed = owed.groupBy("client_id", "grace_days", "created").agg(F.sum("eur").alias("eur"), F.count(F.lit(1)).alias("n"))
    owed = owed.withColumns({"enters": first_at(F.date_add(created, F.col("grace_days") + 1), snapshots), "leaves": at(366)}).where("enters < leaves")
    # The oldest line in the window is the one whose elders have left it; a row per day.
    elder = F.lag("leaves").over(Window.partitionBy("client_id").orderBy("created"))
    owed = checkpointed(owed.withColumn("leads", F.greatest("enters", elder)).withColumn("day", F.unix_date("created").cast("long")))
    oldest = totals_at(owed.where("leads < leaves"), ["client_id"], n, {"d0": (F.col("day"), F.col("leads")), "d1": (F.col("day"), F.col("leaves"))})
    debt = totals_at(owed, ["client_id"], n, {"e0": (F.col("eur"), F.col("enters")), "e1": (F.col("eur"), F.col("leaves")), "n0": (F.col("n"), F.col("enters")), "n1": (F.col("n"), F.col("leaves"))}).fillna(0, ["e1", "n1"]).where("n0 > n1")
    debt = debt.join(oldest.fillna(0, ["d1"]), ["client_id", "date_index"]).join(grid, "date_index").join(c.agreements(spark, d).select("client_id", "grace_days"), "client_id")
    age = F.datediff("m", F.date_from_unix_date((F.col("d0") - F.col("d1")).cast("int")))
    debt = debt.select("date_index", "client_id", (F.col("e0") - F.col("e1")).cast("double").alias("overdue_amount"), (age - F.col("grace_days")).alias("days_past_terms"), age.alias("max_overdue_days"), (F.col("n0") - F.col("n1")).alias("debt_lines")).where("overdue_amount >= 10")
    paid = eur(c.payments(spark, d).where(F.col("from_date") <= last), "amount", "from_date")
    paid = totals_at(paid, ["client_id"], n, {"p0": (F.col("eur"), at(-ac.OUTCOME_DAYS, F.col("from_date"))), "p1": (F.col("eur"), at(0, F.col("from_date")))}).select("date_index", "client_id", (F.col("p0") - F.coalesce("p1", F.lit(0))).cast("double").alias("paid"))
    debt = debt.join(paid, ["date_index", "client_id"], "left").withColumns({"task_type": F.lit("debt_followup"), "hit": (F.coalesce("paid", F.lit(0.0)) >= ac.PAYDOWN * F.col("overdue_amount")).cast("int"), "u": ac.debt_urgency(F.col("days_past_terms"))}).drop("paid")

    churn = totals.select("date_index", "client_id", (F.col("o0") - F.col("o90")).alias("recent_orders"), (F.col("o90") - F.col("o365")).alias("prior_orders"), "silence_days").where("prior_orders >= 2 and recent_orders / 90 < 0.5 * (prior_orders / 275)")
    churn = churn.join(ahead(["client_id"]), ["date_index", "client_id"], "left").withColumns({"task_type": F.lit("churn_winback"), "drop_ratio": F.col("recent_orders") / F.col("prior_orders")})
    churn = churn.withColumn("u", ac.churn_urgency(F.col("drop_ratio"), F.col("silence_days")))

    own = per.select(*item)
    degree = own.groupBy("date_index", "group_id").agg(F.count(F.lit(1)).alias("deg"))
    deg = lambda name: degree.select("date_index", F.col("group_id").alias(name), F.col("deg").alias(f"d_{name}"))
    # what a client has it keeps, so two groups meet in it once and count at all dates from then on
    met = reco.together(own.groupBy("client_id", "group_id").agg(F.min("date_index").alias("since")), "group_id", since="since").where("seed <> cand")
    co = met.join(grid, F.col("date_index") >= F.col("since")).groupBy("date_index", "seed", "cand").agg(F.sum("co").alias("co")).where("co >= 2")
    sim = co.join(deg("seed"), ["date_index", "seed"]).join(deg("cand"), ["date_index", "cand"]).select("date_index", "seed", F.col("cand").alias("group_id"), (F.col("co") / F.sqrt(F.col("d_seed") * F.col("d_cand"))).alias("sim"))
    active = totals.where("o0 > o184").select("date_index", "client_id")
    score = reco.lacking_scores(own.join(active, ["date_index", "client_id"], "left_semi"), sim.withColumnRenamed("group_id", "cand"), "group_id", ["date_index"])
    score = score.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy("date_index", "client_id")), 9)).where("score >= 0.05")
    found = first_per(score, ["date_index", "client_id"], [F.desc("score"), F.col("group_id")], 5).join(bought, item, "left")
    cross = found.groupBy("date_index", "client_id").agg(F.max("score").alias("top_score"), F.count(F.lit(1)).alias("reco_candidates"), F.max("hit").alias("hit")).withColumn("task_type", F.lit("cross_sell"))
    cross = cross.withColumn("u", ac.cross_sell_urgency(F.col("top_score")))

    feats = totals.where("o0 > o365").select("date_index", "client_id", (F.col("a0") - F.col("a1")).cast("double").alias("monetary"), (F.col("o0") - F.col("o365")).alias("order_count"), F.col("silence_days").alias("recency_days"))
    rows = reorder
    for part in (debt, churn, cross):
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows = rows.join(feats, ["date_index", "client_id"], "left").join(grid, "date_index")
    worth = saturation(F.when(F.col("task_type") == "debt_followup", F.col("overdue_amount")).otherwise(F.coalesce("monetary", F.lit(0.0))), 6000.0)
    legacy = ac.priority(F.col("u"), worth, ac.legacy_confidence(F.col("task_type"), F.col("n_orders"), F.col("prior_orders"), F.col("top_score")))
    number = lambda k: F.coalesce(F.col(k).cast("double"), F.lit(9999.0 if k == "recency_days" else 0.0)).alias(k)
    return rows.select(
        F.col("m").cast("string").alias("vintage"), "task_type", "client_id", F.coalesce("group_id", F.lit("")).alias("group_id"), *map(number, ("monetary", "recency_days", "order_count")), *[(F.col("task_type") == t).cast("int").alias(f"is_{t}") for t in ac.SIGNALS],
        *[F.coalesce(F.col(k).cast("double"), F.lit(0.0)).alias(f"sig_{k}") for ks in ac.SIGNALS.values() for k in ks], F.coalesce("hit", F.lit(0)).cast("int").alias("label"), F.round(legacy + 1e-9, 2).alias("old_priority"),
    )


@P.add("n10_snapshots", "SELECT strftime(DATE '1999-08-01' + to_months(CAST(i AS INTEGER)), '%Y-%m-%d') AS snapshot, (SELECT count(DISTINCT client_id) FROM past_sales WHERE created < DATE '1999-08-01' + to_months(CAST(i AS INTEGER))) AS n_clients FROM range(0, 4) t(i)")
def n10_snapshots(spark, d):
    """Month starts whose outcome window has closed before the as-of day, with the clients known at each."""
    m = F.broadcast(spark.createDataFrame([(x,) for x in SNAPSHOTS], "snapshot string"))
    return past(spark, d).select("client_id", "created").join(m, F.col("created") < F.to_date("snapshot")).groupBy("snapshot").agg(F.countDistinct("client_id").alias("n_clients"))


ROWS = {
    "snaps": "SELECT CAST(DATE '1999-08-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS m FROM range(0, 4) t(i)",
    "seen": "SELECT m, client_id, group_id, order_id, created, amount FROM snaps JOIN valid_sales ON created < m",
    "later": "SELECT m, client_id, group_id FROM snaps JOIN valid_sales ON created > m AND created <= m + 60",
    "due": """SELECT *, elapsed / cycle AS ratio FROM (SELECT m, client_id, group_id, n, greatest(date_diff('day', a, b) / (n - 1), 7.0::DOUBLE) AS cycle, date_diff('day', b, m) AS elapsed FROM (SELECT m, client_id, group_id, count(DISTINCT order_id) AS n, min(created) AS a, max(created) AS b FROM seen GROUP BY 1, 2, 3) WHERE n >= 3 AND b > a) WHERE elapsed BETWEEN cycle AND 3 * cycle""",
    "eur_debt": "SELECT d.*, CAST(d.total AS DOUBLE) * coalesce(f.rate, 1.0::DOUBLE) AS eur, grace_days FROM debt_lines d ASOF LEFT JOIN fx_rates f ON d.currency_id = f.currency_id AND d.created >= f.valid_from JOIN agreements a ON a.client_id = d.client_id",
    "debts": "SELECT m, client_id, sum(eur) AS overdue, max(date_diff('day', created, m) - grace_days) AS past, max(date_diff('day', created, m)) AS age, count(*) AS n FROM snaps JOIN eur_debt ON created <= m WHERE date_diff('day', created, m) > grace_days AND date_diff('day', created, m) <= 365 GROUP BY 1, 2 HAVING sum(eur) >= 10",
    "paydown": "SELECT m, client_id, sum(CAST(amount AS DOUBLE) * coalesce(rate, 1.0::DOUBLE)) AS paid FROM snaps JOIN (SELECT p.*, f.rate FROM payments p ASOF LEFT JOIN fx_rates f ON p.currency_id = f.currency_id AND p.from_date >= f.valid_from) ON from_date > m AND from_date <= m + 60 GROUP BY 1, 2",
    "quiet": "SELECT * FROM (SELECT m, client_id, count(*) FILTER (date_diff('day', created, m) <= 90) AS recent, count(*) FILTER (date_diff('day', created, m) BETWEEN 91 AND 365) AS prior, min(date_diff('day', created, m)) AS silence FROM (SELECT DISTINCT m, client_id, order_id, created FROM seen) GROUP BY 1, 2) WHERE prior >= 2 AND recent / 90 < 0.5::DOUBLE * (prior / 275)",
    "held": "SELECT DISTINCT m, client_id, group_id FROM seen",
    "degrees": "SELECT m, group_id, count(*) AS deg FROM held GROUP BY 1, 2",
    "likes": "SELECT c.m, seed, cand, co / sqrt(CAST(x.deg AS DOUBLE) * y.deg) AS sim FROM (SELECT a.m, a.group_id AS seed, b.group_id AS cand, count(*) AS co FROM held a JOIN held b ON a.m = b.m AND a.client_id = b.client_id AND a.group_id <> b.group_id GROUP BY 1, 2, 3 HAVING count(*) >= 2) c JOIN degrees x ON x.m = c.m AND x.group_id = seed JOIN degrees y ON y.m = c.m AND y.group_id = cand",
    "wishes": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m, client_id ORDER BY share DESC, group_id) AS r FROM (SELECT m, client_id, group_id, round(s / max(s) OVER (PARTITION BY m, client_id), 9) AS share FROM (SELECT h.m, h.client_id, cand AS group_id, sum(sim) AS s FROM held h JOIN likes l ON l.m = h.m AND l.seed = h.group_id GROUP BY 1, 2, 3) w
      WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.m = w.m AND o.client_id = w.client_id AND o.group_id = w.group_id)) WHERE share >= 0.05::DOUBLE AND (m, client_id) IN (SELECT (m, client_id) FROM seen WHERE date_diff('day', created, m) <= 184)) WHERE r <= 5""",
    "labelled": """SELECT m, 'reorder_due' AS task_type, client_id, group_id, elapsed AS s1, ratio AS s2, CAST(EXISTS (SELECT 1 FROM later l WHERE l.m = d.m AND l.client_id = d.client_id AND l.group_id = d.group_id) AS INTEGER) AS label FROM due d
      UNION ALL SELECT d.m, 'debt_followup', d.client_id, '', overdue, past, CAST(coalesce(paid, 0) >= 0.5::DOUBLE * overdue AS INTEGER) FROM debts d LEFT JOIN paydown p ON p.m = d.m AND p.client_id = d.client_id
      UNION ALL SELECT m, 'churn_winback', client_id, '', recent / prior, silence, CAST(EXISTS (SELECT 1 FROM later l WHERE l.m = q.m AND l.client_id = q.client_id) AS INTEGER) FROM quiet q
      UNION ALL SELECT m, 'cross_sell', client_id, '', max(share), count(*), max(CAST(EXISTS (SELECT 1 FROM later l WHERE l.m = w.m AND l.client_id = w.client_id AND l.group_id = w.group_id) AS INTEGER)) FROM wishes w GROUP BY 1, 3""",
    "bases": "SELECT m, client_id, CAST(sum(amount) AS DOUBLE) AS monetary, count(DISTINCT order_id) AS order_count, min(date_diff('day', created, m)) AS recency_days FROM seen WHERE date_diff('day', created, m) <= 365 GROUP BY 1, 2",
}


HITS = {
    "reorder_due": "CAST(EXISTS (SELECT 1 FROM later l WHERE l.m = x.m AND l.client_id = x.client_id AND l.group_id = x.group_id) AS INTEGER)",
    "churn_winback": "CAST(EXISTS (SELECT 1 FROM later l WHERE l.m = x.m AND l.client_id = x.client_id) AS INTEGER)",
}
SIGNALLED = f"""SELECT m, 'reorder_due' AS task_type, client_id, group_id, elapsed AS elapsed_days, cycle AS cycle_days, ratio AS overdue_ratio, n AS n_orders, greatest(0, least(1, 0.3::DOUBLE + 0.25::DOUBLE * (ratio - 1))) AS u, least(1, 0.4::DOUBLE + 0.1::DOUBLE * n) AS sure, {HITS["reorder_due"]} AS label FROM due x
  UNION ALL BY NAME SELECT x.m, 'debt_followup' AS task_type, x.client_id, '' AS group_id, overdue AS overdue_amount, past AS days_past_terms, age AS max_overdue_days, n AS debt_lines, CASE WHEN past <= 0 THEN 0 ELSE 0.6::DOUBLE + 0.4::DOUBLE * (past / (past + 60)) END AS u, 1.0::DOUBLE AS sure, CAST(coalesce(paid, 0) >= 0.5::DOUBLE * overdue AS INTEGER) AS label FROM debts x LEFT JOIN paydown p ON p.m = x.m AND p.client_id = x.client_id
  UNION ALL BY NAME SELECT m, 'churn_winback' AS task_type, client_id, '' AS group_id, recent / prior AS drop_ratio, silence AS silence_days, recent AS recent_orders, prior AS prior_orders, 0.6::DOUBLE * (1 - recent / prior) + 0.4::DOUBLE * CASE WHEN silence > 0 THEN silence / (silence + 120) ELSE 0 END AS u, least(1, 0.5::DOUBLE + 0.05::DOUBLE * prior) AS sure, {HITS["churn_winback"]} AS label FROM quiet x
  UNION ALL BY NAME SELECT m, 'cross_sell' AS task_type, client_id, '' AS group_id, max(share) AS top_score, count(*) AS reco_candidates, 0.3::DOUBLE + 0.5::DOUBLE * max(share) AS u, max(share) AS sure, max({HITS["reorder_due"]}) AS label FROM wishes x GROUP BY m, client_id"""


@P.add(
    "n8_training_set",
    "SELECT CAST(s.m AS VARCHAR) AS vintage, task_type, s.client_id, group_id, coalesce(monetary, 0.0::DOUBLE) AS monetary, CAST(coalesce(recency_days, 9999) AS DOUBLE) AS recency_days, CAST(coalesce(order_count, 0) AS DOUBLE) AS order_count, "
    + ", ".join(f"CAST(task_type = '{t}' AS INTEGER) AS is_{t}" for t in ac.SIGNALS)
    + ", "
    + ", ".join(f"round(coalesce(CAST({k} AS DOUBLE), 0.0::DOUBLE) + 0.000000001::DOUBLE, 4) AS sig_{k}" for ks in ac.SIGNALS.values() for k in ks)
    + """, label, round(round(100 * greatest(0, least(1, 0.5::DOUBLE * u + 0.3::DOUBLE * CASE WHEN worth > 0 THEN worth / (worth + 6000) ELSE 0 END + 0.2::DOUBLE * sure)), 2) + 0.000000001::DOUBLE, 2) AS old_priority
    FROM (SELECT s.*, monetary, recency_days, order_count, CASE task_type WHEN 'debt_followup' THEN overdue_amount ELSE coalesce(monetary, 0) END AS worth FROM signalled s LEFT JOIN bases b ON b.m = s.m AND b.client_id = s.client_id) s""",
    **ROWS,
    signalled=SIGNALLED,
)
def n8(spark, d):
    """The training set of all types: features, one-hot types, all signals, label and the old priority."""
    rows = training_rows(spark, d)
    return rows.withColumns({x: F.round(F.col(x) + 1e-9, 4) for x in SIGNAL_COLUMNS})


@P.add(
    "n9_live_labels",
    """SELECT task_type, client_id, round(CAST(amount AS DOUBLE), 2) AS monetary, CAST(amount > 250 AS INTEGER) AS label FROM (SELECT list_extract(['debt_followup', 'reorder_due', 'churn_winback', 'cross_sell'], CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 + 1 AS INTEGER)) AS task_type, user_id AS client_id, CAST(value AS DECIMAL(18,2)) AS amount FROM events WHERE event_type = 'purchase')""",
)
def n9(spark, d):
    """Finished tasks of the log as training rows: a purchase is done, and sold above 250; other ends have no outcome."""
    log = actions.logged(spark, d).where(F.col("kind").isin("done", "dismissed"))
    none = F.lit(None).cast("boolean")
    tasks = log.select("task_type", "client_id", F.col("kind").alias("status"), F.struct(F.when(F.col("kind") == "done", F.col("amount") > 250).otherwise(none).alias("sold")).alias("outcome"), F.create_map(F.lit("monetary"), F.col("amount").cast("double")).alias("signals"), F.lit(50.0).alias("priority"))
    return ac.live_rows(tasks).select("task_type", "client_id", F.round("monetary", 2).alias("monetary"), "label")


@P.add(
    "n13_base_rates",
    "SELECT coalesce(task_type, 'all') AS task_type, coalesce(CAST(m AS VARCHAR), 'all') AS vintage, count(*) AS n, round(avg(label), 6) AS rate FROM labelled GROUP BY GROUPING SETS ((task_type, m), (task_type), ())",
    **ROWS,
)
def n13(spark, d):
    """Base rates by type and vintage, by type, and of all."""
    sets = training_rows(spark, d).groupingSets([["task_type", "vintage"], ["task_type"], []], "task_type", "vintage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 6).alias("rate"))
    return sets.fillna("all", ["task_type", "vintage"])


@P.add("n13_feature_report")
def n13_features(spark, d):
    """Coverage and single-feature AUC by type, all features in one long table."""
    rows = training_rows(spark, d)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.round(f, 6).alias("v")) for f in ("monetary", "recency_days", "order_count", *SIGNAL_COLUMNS)])
    counts = rows.select("task_type", "label", F.explode(pairs).alias("x")).groupBy("task_type", "x.feature", "x.v").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"))
    return rk.feature_auc(counts, ("task_type", "feature")).where("coverage > 0").select("task_type", "feature", "n", F.round("coverage", 6).alias("coverage"), F.round("auc", 6).alias("auc"))


def logit(train):
    """A scaled logistic fit of the inputs: a function that adds p."""
    assembler = VectorAssembler(inputCols=INPUTS, outputCol="_x")
    model = LogisticRegression(labelCol="label", featuresCol="_x", regParam=1e-4, maxIter=100).fit(assembler.transform(train))
    return lambda t: model.transform(assembler.transform(t)).withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def calibrated(fit):
    """The fit with an isotonic step on the predictions of folds that did not see their client."""

    def whole(train):
        held = sc.out_of_fold(train, "client_id", 2, fit).select("p", F.col("label").cast("double").alias("y"))
        shape = VectorAssembler(inputCols=["p"], outputCol="_p")
        iso = IsotonicRegression(labelCol="y", featuresCol="_p", predictionCol="q").fit(shape.transform(held))
        model = fit(train)
        return lambda t: iso.transform(shape.transform(model(t))).withColumn("p", F.col("q")).drop("q", "_p")

    return whole


MODELS = {"trees": lambda train: sc.fit_trees(train, INPUTS, "label", 15, 4), "logit": logit}


def trained(spark, d, models=tuple(MODELS), folds=True):
    """Metrics of the models on folds of clients and out of time, and of the old priority."""
    rows = checkpointed(training_rows(spark, d))
    early, late = rows.where(F.col("vintage") < SNAPSHOTS[-1]), rows.where(F.col("vintage") == SNAPSHOTS[-1])
    parts = []
    for name in models:
        fit = MODELS[name]
        if folds:
            parts.append(risk.metrics(sc.out_of_fold(rows, "client_id", 2, fit), f"{name} folds"))
        parts.append(risk.metrics(calibrated(fit)(early)(late), f"{name} out of time"))
    parts.append(risk.metrics(late.withColumn("p", F.col("old_priority") / 100), "old priority out of time"))
    return risk.union(parts)


@P.add("n11_propensity_models")
def n11(spark, d):
    """Trees and logistic regression: which is taken follows from out-of-time Brier and AUC."""
    rows = trained(spark, d)
    at = lambda m, k: F.max(F.when(F.col("model") == f"{m} out of time", F.col(k)))
    one = rows.agg(at("trees", "auc").alias("ta"), at("logit", "auc").alias("la"), at("trees", "brier").alias("tb"), at("logit", "brier").alias("lb"))
    trees, logits = (F.col("tb") <= F.col("lb") + 0.002) & (F.col("ta") >= F.col("la") - 0.01), (F.col("lb") < F.col("tb")) & (F.col("la") >= F.col("ta") - 0.01)
    chosen = F.when(trees, "trees").when(logits, "logit").when(F.col("ta") >= F.col("la"), "trees").otherwise("logit")
    return rows.join(F.broadcast(one.select(chosen.alias("production"))))


@P.add("n23_promotion_gate")
def n23(spark, d):
    """The new model's out-of-time AUC against the floor and the stored one, here the old priority's."""
    rows = trained(spark, d, ("trees",), folds=False)
    new = F.max(F.when(F.col("model") == "trees out of time", F.col("auc")))
    old = F.max(F.when(F.col("model") == "old priority out of time", F.col("auc")))
    one = rows.agg(new.alias("new_auc"), old.alias("old_auc"))
    floor, kept = F.col("new_auc") >= ac.AUC_FLOOR, F.col("new_auc") >= F.col("old_auc") - ac.AUC_EPSILON
    return one.select("new_auc", "old_auc", floor.alias("floor_ok"), kept.alias("regress_ok"), (floor & kept).alias("promote"))


@P.add("n12_expected_value_by_model")
def n12(spark, d):
    """Probability, expected value, ranking score and priority of the newest candidates by the calibrated model."""
    rows = checkpointed(training_rows(spark, d))
    scored = calibrated(MODELS["logit"])(rows.where(F.col("vintage") < SNAPSHOTS[-1]))(rows.where(F.col("vintage") == SNAPSHOTS[-1]))
    ev = ac.expected_value(F.col("task_type"), F.col("monetary"), F.col("order_count"), F.col("sig_overdue_amount"))
    return scored.select("client_id", "task_type", "group_id", F.round("p", 6).alias("p_outcome"), F.round(ev, 2).alias("expected_value"), F.round(F.col("p") * ev, 4).alias("ev_score"), F.round(100 * F.col("p"), 2).alias("priority"))
