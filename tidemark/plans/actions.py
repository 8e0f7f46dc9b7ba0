"""Next-best-action queries and the batch twins of the streaming jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.columns import saturation
from tidemark.operators import actions as ac, payloads as pl, ranking, reco, sales
from tidemark.plans import risk
from tidemark.plans.base import Plans
from tidemark.plans.sales import END, past, valid, year
from tidemark.plans.timeseries import PACE, targets
from tidemark.sources import canonical as c
from tidemark.sources.sinks import checkpointed

P = Plans()
T = {
    **risk.T,
    "reorders": "SELECT client_id, group_id, n AS n_orders, greatest(date_diff('day', a, b) / (n - 1), 7.0::DOUBLE) AS cycle_days, CAST(date_diff('day', b, DATE '2000-01-01') AS INTEGER) AS elapsed_days FROM (SELECT client_id, group_id, count(DISTINCT order_id) AS n, min(created) AS a, max(created) AS b FROM past_sales GROUP BY 1, 2) WHERE n >= 3 AND b > a AND date_diff('day', b, DATE '2000-01-01') BETWEEN greatest(date_diff('day', a, b) / (n - 1), 7.0::DOUBLE) AND 3 * greatest(date_diff('day', a, b) / (n - 1), 7.0::DOUBLE)",
    "churn": "SELECT * FROM (SELECT client_id, CAST(count(*) FILTER (created >= DATE '1999-10-03') AS BIGINT) AS recent_orders, CAST(count(*) FILTER (created >= DATE '1999-01-01' AND created < DATE '1999-10-03') AS BIGINT) AS prior_orders, CAST(date_diff('day', max(created), DATE '2000-01-01') AS INTEGER) AS silence_days FROM (SELECT DISTINCT client_id, order_id, created FROM past_sales) GROUP BY 1) WHERE prior_orders >= 2 AND recent_orders / 90 < 0.5::DOUBLE * (prior_orders / 275)",
}


def reorders(spark, d):
    return ac.reorder_candidates(past(spark, d), "group_id", END)


@P.add("n1_w14_reorder_candidates", "SELECT client_id, group_id, n_orders, round(cycle_days, 4) AS cycle_days, elapsed_days FROM reorders", **T)
def n1(spark, d):
    return reorders(spark, d).withColumn("cycle_days", F.round("cycle_days", 4))


@P.add(
    "n1_bundled_reorders",
    """SELECT client_id, array_to_string(list_transform(x[1:5], lambda s: s.g), ',') AS items, CAST(len(x) AS INTEGER) AS n_items, round(-x[CAST(greatest(ceil(len(x) * 0.25), 1) AS INTEGER)].r, 4) AS p75_ratio FROM
    (SELECT client_id, list({'r': -ratio, 'g': group_id} ORDER BY ratio DESC, group_id) AS x FROM (SELECT client_id, group_id, elapsed_days / cycle_days AS ratio FROM reorders) GROUP BY 1)""",
    **T,
)
def n1b(spark, d):
    return ac.bundled(reorders(spark, d), "group_id").select("client_id", F.array_join("items", ",").alias("items"), "n_items", F.round("p75_ratio", 4).alias("p75_ratio"))


@P.add("n2_debt_candidates", "SELECT client_id, round(sum(eur), 4) AS overdue, CAST(max(od) AS INTEGER) AS days_past, count(*) AS n_lines FROM aged WHERE od > 0 AND date_diff('day', created, DATE '2000-01-01') <= 365 GROUP BY 1 HAVING sum(eur) >= 10", **T)
def n2(spark, d):
    return ac.debt_candidates(risk.aged(spark, d), END).select("client_id", F.round("overdue", 4).alias("overdue"), "days_past", "n_lines")


@P.add("n3_churn_candidates", "SELECT * FROM churn", **T)
def n3(spark, d):
    return ac.churn_candidates(past(spark, d), END)


def discoveries(spark, d):
    """(client_id, group_id, score, rank): groups that active clients lack, by their share of the best co-purchase score."""
    own = reco.owned(past(spark, d), "group_id")
    scores = reco.co_scores(own, reco.co_purchase(own, "group_id"), "group_id").join(own, ["client_id", "group_id"], "left_anti")
    active = sales.window(valid(spark, d), "1999-07-01", END).select("client_id").distinct()
    share = F.round(F.col("score") / F.max("score").over(Window.partitionBy("client_id")), 9)
    return ranking.first_per(scores.withColumn("score", share).where("score >= 0.05").join(active, "client_id", "left_semi"), ["client_id"], [F.desc("score"), F.col("group_id")], 5)


def tasks(spark, d):
    """Candidates of the four types for all managers with urgency, value and ranking fields."""
    feats = sales.client_features(year(spark, d), END).select("client_id", "monetary", "order_count")
    owner = c.read(spark, d, "customer").select(F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("manager_id"))
    debt = ac.debt_candidates(risk.aged(spark, d), END).select("client_id", F.lit("debt_followup").alias("task_type"), ac.debt_urgency(F.col("days_past")).alias("u"), "overdue")
    re = reorders(spark, d).groupBy("client_id").agg(F.max(ac.reorder_urgency(F.col("elapsed_days"), F.col("cycle_days"))).alias("u"), F.max("n_orders").alias("n_orders")).withColumn("task_type", F.lit("reorder_due"))
    churn = ac.churn_candidates(past(spark, d), END).select("client_id", F.lit("churn_winback").alias("task_type"), ac.churn_urgency(F.col("recent_orders") / F.col("prior_orders"), F.col("silence_days")).alias("u"), "prior_orders")
    cross = discoveries(spark, d).groupBy("client_id").agg(F.max("score").alias("top_score")).select("client_id", F.lit("cross_sell").alias("task_type"), ac.cross_sell_urgency(F.col("top_score")).alias("u"), "top_score")
    df = debt
    for part in (re, churn, cross):
        df = df.unionByName(part, allowMissingColumns=True)
    df = df.join(owner, "client_id").join(feats, "client_id", "left").fillna(0.0, ["monetary"]).fillna(0, ["order_count"])
    ev = ac.expected_value(F.col("task_type"), F.col("monetary"), F.col("order_count"), F.col("overdue"))
    worth = saturation(F.when(F.col("task_type") == "debt_followup", F.col("overdue")).otherwise(F.col("monetary")), 6000.0)
    sure = ac.legacy_confidence(F.col("task_type"), F.col("n_orders"), F.col("prior_orders"), F.col("top_score"))
    df = df.withColumns({"urgency": ac.urgency_band(F.col("u")), "priority": F.round(ac.priority(F.col("u"), worth, sure) + 1e-9, 2), "ev_score": ac.rounded(ev * F.col("u"), 2)})
    return df.select("manager_id", "client_id", "task_type", ac.rounded(F.col("u"), 4).alias("u"), "urgency", "priority", "ev_score")


#: The same candidates in SQL. urgency: debt .6 + .4 d / (d + 60), reorder .3 + .25 (ratio - 1), churn .6 drop + .4 s / (s + 120),
#: cross-sell .3 + .5 score; bands .85 / .6 / .3; priority .5 u + .3 value / (value + 6000) + .2 confidence.
TASKS = {
    **T,
    "own_groups": "SELECT DISTINCT client_id, group_id FROM past_sales",
    "group_deg": "SELECT group_id, count(*) AS deg FROM own_groups GROUP BY 1",
    "group_sim": "SELECT seed, cand, co / sqrt(CAST(x.deg AS DOUBLE) * y.deg) AS sim FROM (SELECT a.group_id AS seed, b.group_id AS cand, count(*) AS co FROM own_groups a JOIN own_groups b ON a.client_id = b.client_id AND a.group_id <> b.group_id GROUP BY 1, 2 HAVING count(*) >= 2) JOIN group_deg x ON x.group_id = seed JOIN group_deg y ON y.group_id = cand",
    "group_score": "SELECT o.client_id, cand AS group_id, sum(sim) AS score FROM own_groups o JOIN group_sim ON seed = o.group_id GROUP BY 1, 2",
    "found": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY share DESC, group_id) AS rank FROM (SELECT s.client_id, s.group_id, round(score / max(score) OVER (PARTITION BY s.client_id), 9) AS share FROM group_score s
      WHERE NOT EXISTS (SELECT 1 FROM own_groups o WHERE o.client_id = s.client_id AND o.group_id = s.group_id)) WHERE share >= 0.05::DOUBLE AND client_id IN (SELECT client_id FROM valid_sales WHERE created >= DATE '1999-07-01' AND created < DATE '2000-01-01')) WHERE rank <= 5""",
    "urged": """SELECT client_id, 'debt_followup' AS task_type, CASE WHEN max(od) <= 0 THEN 0 ELSE 0.6::DOUBLE + 0.4::DOUBLE * (max(od) / (max(od) + 60)) END AS u, sum(eur) AS overdue, 1.0::DOUBLE AS sure FROM aged WHERE od > 0 AND date_diff('day', created, DATE '2000-01-01') <= 365 GROUP BY 1 HAVING sum(eur) >= 10
      UNION ALL SELECT client_id, 'reorder_due', max(greatest(0, least(1, 0.3::DOUBLE + 0.25::DOUBLE * (elapsed_days / cycle_days - 1)))), NULL, least(1, 0.4::DOUBLE + 0.1::DOUBLE * max(n_orders)) FROM reorders GROUP BY 1
      UNION ALL SELECT client_id, 'churn_winback', 0.6::DOUBLE * (1 - recent_orders / prior_orders) + 0.4::DOUBLE * CASE WHEN silence_days > 0 THEN silence_days / (silence_days + 120) ELSE 0 END, NULL, least(1, 0.5::DOUBLE + 0.05::DOUBLE * prior_orders) FROM churn
      UNION ALL SELECT client_id, 'cross_sell', 0.3::DOUBLE + 0.5::DOUBLE * max(share), NULL, max(share) FROM found GROUP BY 1""",
    "spent": "SELECT client_id, CAST(sum(amount) AS DOUBLE) AS monetary, count(DISTINCT order_id) AS order_count FROM year_sales GROUP BY 1",
    "task": """SELECT manager_id, client_id, task_type, round(u + 0.000000001::DOUBLE, 4) AS u, CASE WHEN u >= 0.85 THEN 'critical' WHEN u >= 0.6 THEN 'high' WHEN u >= 0.3 THEN 'normal' ELSE 'low' END AS urgency, round(round(100 * greatest(0, least(1, 0.5::DOUBLE * u + 0.3::DOUBLE * (worth / (worth + 6000)) + 0.2::DOUBLE * sure)), 2) + 0.000000001::DOUBLE, 2) AS priority,
      round(ev * u + 0.000000001::DOUBLE, 2) AS ev_score FROM (SELECT c_nationkey AS manager_id, x.client_id, task_type, u, sure, CASE task_type WHEN 'debt_followup' THEN overdue ELSE coalesce(monetary, 0) END AS worth,
        CASE task_type WHEN 'debt_followup' THEN overdue WHEN 'churn_winback' THEN coalesce(monetary, 0) ELSE CASE WHEN order_count > 0 THEN monetary / order_count ELSE 0 END END AS ev FROM urged x JOIN customer ON c_custkey = x.client_id LEFT JOIN spent s ON s.client_id = x.client_id)""",
    "inbox": """SELECT *, CAST(row_number() OVER (PARTITION BY manager_id ORDER BY CASE urgency WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'normal' THEN 2 ELSE 3 END, ev_score DESC, CASE task_type WHEN 'debt_followup' THEN 0 WHEN 'reorder_due' THEN 1 WHEN 'churn_winback' THEN 2 ELSE 3 END, priority DESC, client_id, task_type) AS INTEGER) AS rank FROM task""",
    # The task log's key is user:k; k mod 4 is the type.
    "logged": """SELECT *, CAST(user_id AS BIGINT) AS client_id, list_extract(['debt_followup', 'reorder_due', 'churn_winback', 'cross_sell'], CAST(k % 4 + 1 AS INTEGER)) AS task_type FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts AS "at", event_type FROM events)""",
    "turned_down": """SELECT client_id, task_type, count(*) AS n FROM logged WHERE event_type NOT IN ('signup', 'view', 'click', 'purchase') AND "at" > (SELECT max("at") FROM logged) - INTERVAL 90 DAY GROUP BY 1, 2""",
    "seats": """SELECT manager_id, task_type, CAST(f + CAST(row_number() OVER (PARTITION BY manager_id ORDER BY f - ideal, share DESC, task_type) <= 50 - sum(f) OVER (PARTITION BY manager_id) AS INTEGER) AS INTEGER) AS seats FROM (SELECT *, CAST(floor(ideal) AS INTEGER) AS f FROM
      (SELECT *, share / sum(share) OVER (PARTITION BY manager_id) * 50 AS ideal FROM (SELECT DISTINCT manager_id, task_type, CASE task_type WHEN 'debt_followup' THEN 0.40 WHEN 'reorder_due' THEN 0.27 WHEN 'churn_winback' THEN 0.16 ELSE 0.17 END::DOUBLE AS share FROM task)))""",
}


@P.add("n4_cross_sell_candidates", "SELECT client_id, group_id, round(share, 4) AS score, CAST(rank AS INTEGER) AS rank FROM found", **TASKS)
def n4(spark, d):
    return discoveries(spark, d).select("client_id", "group_id", F.round("score", 4).alias("score"), "rank")


@P.add("n5_n6_n12_task_candidates", "SELECT * FROM task", **TASKS)
def n5(spark, d):
    return tasks(spark, d)


@P.add("w8_inbox_order", "SELECT manager_id, client_id, task_type, rank FROM inbox", **TASKS)
def w8(spark, d):
    return ac.inbox(tasks(spark, d)).select("manager_id", "client_id", "task_type", "rank")


@P.add("a45_type_by_urgency", "SELECT task_type, " + ", ".join(f"count(*) FILTER (urgency = '{u}') AS {u}" for u in ac.URGENCY_RANK) + " FROM task GROUP BY 1", **TASKS)
def a45(spark, d):
    return tasks(spark, d).groupBy("task_type").pivot("urgency", list(ac.URGENCY_RANK)).count().fillna(0)


@P.add("a46_head_dashboard", "SELECT coalesce(manager_id, -1) AS manager_id, count(*) AS open, count(*) FILTER (urgency = 'critical') AS critical, round(sum(ev_score), 2) AS at_risk FROM task GROUP BY ROLLUP (manager_id)", **TASKS)
def a46(spark, d):
    """By manager and, under -1, in total."""
    agg = tasks(spark, d).rollup("manager_id").agg(F.count(F.lit(1)).alias("open"), F.sum((F.col("urgency") == "critical").cast("long")).alias("critical"), F.round(F.sum("ev_score"), 2).alias("at_risk"))
    return agg.withColumn("manager_id", F.coalesce("manager_id", F.lit(-1)))


@P.add("a55_top_ten_mix", "SELECT manager_id, " + ", ".join(f"count(*) FILTER (task_type = '{t}') AS {t}" for t in ac.TYPE_RANK) + " FROM inbox WHERE rank <= 10 GROUP BY 1", **TASKS)
def a55(spark, d):
    return ac.inbox(tasks(spark, d)).where("rank <= 10").groupBy("manager_id").pivot("task_type", list(ac.TYPE_RANK)).count().fillna(0)


@P.add("n15_type_quotas", "SELECT * FROM seats", **TASKS)
def n15(spark, d):
    return ac.type_quotas(tasks(spark, d))


def logged(spark, d):
    """The task log with client and type: the key is user:k, k mod 4 the type."""
    k = F.substring_index("task_key", ":", -1).cast("long") % 4
    kinds = F.array(*[F.lit(t) for t in ac.SIGNALS])
    return c.task_events(spark, d).withColumns({"client_id": F.col("by"), "task_type": F.get(kinds, k.cast("int"))})


def rejections(spark, d, days=ac.FEEDBACK_DAYS):
    log = logged(spark, d)
    now = log.agg(F.max("at").alias("now"))
    return log.where("kind = 'dismissed'").join(F.broadcast(now)).where(F.col("at") > F.col("now") - F.make_dt_interval(F.lit(days))).groupBy("client_id", "task_type").agg(F.count(F.lit(1)).alias("n"))


@P.add("n16_rejections", "SELECT * FROM turned_down", **TASKS)
def n16(spark, d):
    return rejections(spark, d)


def boosted(spark, d):
    shipped, paid = targets(spark, d)
    share = lambda name: F.when(F.col("expected") > 0, F.greatest(F.lit(0.0), F.col("gap")) / F.col("expected")).otherwise(0.0).alias(name)
    pace = shipped.select("manager_id", share("shipped_behind")).join(paid.select("manager_id", share("paid_behind")), "manager_id", "full_outer")
    return ac.adjusted(tasks(spark, d), pace, rejections(spark, d))


@P.add(
    "n14_pace_and_feedback",
    """SELECT manager_id, client_id, task_type, least(100, round(p * penalty + 0.000000001::DOUBLE, 2)) AS priority, round(e * penalty + 0.000000001::DOUBLE, 4) AS ev_score FROM (SELECT t.manager_id, t.client_id, t.task_type, least(100, round(priority * lift + 0.000000001::DOUBLE, 2)) AS p, round(ev_score * lift + 0.000000001::DOUBLE, 4) AS e, greatest(0.5::DOUBLE, 1 - 0.15::DOUBLE * coalesce(n, 0)) AS penalty FROM
      (SELECT t.*, 1 + least(1, coalesce(CASE WHEN task_type IN ('reorder_due', 'cross_sell') THEN CASE WHEN s.expected > 0 THEN greatest(0, s.gap) / s.expected ELSE 0 END WHEN task_type = 'debt_followup' THEN CASE WHEN q.expected > 0 THEN greatest(0, q.gap) / q.expected ELSE 0 END END, 0)) * 0.25::DOUBLE AS lift
       FROM task t LEFT JOIN pace_shipped s ON s.manager_id = t.manager_id LEFT JOIN pace_paid q ON q.manager_id = t.manager_id) t LEFT JOIN turned_down r ON r.client_id = t.client_id AND r.task_type = t.task_type)""",
    **TASKS,
    **PACE,
)
def n14(spark, d):
    return boosted(spark, d).select("manager_id", "client_id", "task_type", "priority", "ev_score")


def task_table(spark, d):
    """The task log as a table of tasks with all columns, some null and some flags set.

    Keys are client:k; k mod 4 is the type, and k under 4 the window of the candidates. Managers are the clients' own. What the log lacks comes from k:
    started tasks of every third k are snoozed, every seventh has no due date, every fifth no expiry.
    """
    log = logged(spark, d)
    owner = c.read(spark, d, "customer").select(F.col("c_custkey").alias("client_id"), F.col("c_nationkey").alias("manager_id"))
    seen = log.groupBy("task_key", "client_id", "task_type").agg(F.min("at").alias("generated_at"), F.max("at").alias("updated_at"))
    k = F.substring_index("task_key", ":", -1).cast("int")
    df = ac.fold_events(log).select("task_key", "status").join(seen, "task_key").join(owner, "client_id").withColumn("k", k)
    after = lambda days: F.col("updated_at") + F.make_dt_interval(days)
    folded = F.coalesce("status", F.lit("generated"))
    df = df.withColumn("status", F.when((folded == "in_progress") & (F.col("k") % 3 == 0), "snoozed").otherwise(folded))
    urgencies = F.array(*[F.lit(u) for u in ac.URGENCY_RANK])
    return df.select(
        "task_key", "manager_id", "client_id", "task_type", "status", F.get(urgencies, F.col("k") % 3).alias("urgency"), F.col("k").cast("double").alias("priority"), (F.col("k") * 10.0).alias("ev_score"),
        F.when(F.col("k") % 7 > 0, after(F.lit(3))).alias("due_date"), F.when(F.col("status") == "snoozed", after(F.col("k") % 5)).alias("snooze_until"), F.when(F.col("k") % 5 > 0, after(F.lit(14))).alias("expires_at"),
        (F.col("k") % 11 == 0).alias("sla_breached"), F.when(F.col("k") % 22 == 0, 900).alias("escalated_to"), "generated_at", "updated_at", F.array().cast(ac.HISTORY).alias("status_history"),
    )


def keyed(df):
    """Candidates with the key they have in the task table, that of their window."""
    kind = F.array_position(F.array(*[F.lit(t) for t in ac.SIGNALS]), F.col("task_type")) - 1
    return df.withColumn("task_key", F.concat_ws(":", F.col("client_id").cast("string"), kind.cast("string")))


def admission_inputs(spark, d):
    """Candidates, seats, the task table after a sweep, and muted triples from the task log."""
    candidates, existing = checkpointed(keyed(boosted(spark, d))), checkpointed(ac.sweep(task_table(spark, d), "2024-03-01 00:00:00"))
    muted = rejections(spark, d, ac.MUTE_DAYS).join(existing.select("client_id", "manager_id").distinct(), "client_id").select("manager_id", "client_id", "task_type")
    return candidates, ac.type_quotas(candidates), existing, muted


@P.add("n17_admission")
def n17(spark, d):
    return ac.admit(*admission_inputs(spark, d))


@P.add(
    "a44_event_throughput",
    "SELECT coalesce(manager_id, -1) AS manager_id, CAST(count(*) FILTER (kind NOT IN ('done', 'dismissed')) AS BIGINT) AS active, CAST(count(*) FILTER (kind = 'done') AS BIGINT) AS done, CAST(count(*) FILTER (kind = 'dismissed') AS BIGINT) AS dismissed, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue FROM task_events GROUP BY ROLLUP (manager_id)",
)
def a44(spark, d):
    return ac.throughput(c.task_events(spark, d).withColumnRenamed("kind", "status")).select(F.coalesce("manager_id", F.lit(-1)).alias("manager_id"), "active", "done", "dismissed", "revenue")


FOLDED = """SELECT task_key, nullif(f.status, '') AS status, CAST(f.rejected AS INTEGER) AS rejected, CAST(len(e) AS INTEGER) AS n_events FROM (SELECT task_key, e, list_reduce(list_prepend({'kind': '', 'status': '', 'rejected': 0}, list_transform(e, lambda k: {'kind': k, 'status': k, 'rejected': 0})), lambda a, x: CASE WHEN
      (a.status = '' AND x.kind IN ('generated', 'open')) OR (a.status = 'generated' AND x.kind = 'open') OR (a.status = 'open' AND x.kind IN ('in_progress', 'done', 'snoozed', 'dismissed')) OR (a.status = 'in_progress' AND x.kind IN ('done', 'snoozed', 'dismissed', 'open')) OR (a.status = 'snoozed' AND x.kind IN ('open', 'dismissed'))
      THEN {'kind': x.kind, 'status': x.kind, 'rejected': a.rejected} ELSE {'kind': x.kind, 'status': a.status, 'rejected': a.rejected + 1} END) AS f FROM (SELECT task_key, list(kind ORDER BY "at", event_id) AS e FROM task_events GROUP BY 1))"""


@P.add("z1_fold_task_events", FOLDED)
def z1(spark, d):
    return ac.fold_events(c.task_events(spark, d)).select("task_key", "status", "rejected", "n_events")


def clocked(spark, d):
    """The task log with snoozes: dismissals of odd events are snoozes of as many days as the event's number mod 9, none at 0."""
    ev, odd = c.task_events(spark, d), (F.col("kind") == "dismissed") & (F.col("event_id") % 2 == 1)
    until = F.when(odd & (F.col("event_id") % 9 > 0), F.col("at") + F.make_dt_interval((F.col("event_id") % 9).cast("int")))
    return ev.withColumns({"kind": F.when(odd, "snoozed").otherwise(F.col("kind")), "until": until})


def clock_sql() -> str:
    """A left fold of each task's events; each name below is the text of an expression over the state a and the event x."""
    def advanced(s, t):
        woken = f"CASE WHEN {s}.status = 'snoozed' AND {s}.snooze <= {t} THEN 'open' ELSE {s}.status END"
        return f"CASE WHEN ({woken}) IN ('generated', 'open', 'in_progress', 'snoozed') AND {s}.expires < {t} THEN 'expired' ELSE {woken} END"

    st = f"({advanced('a', 'x.at')})"
    fresh = f"{st} IN ('', 'expired')"
    ok = f"(({fresh} AND x.kind IN ('generated', 'open')) OR ({st} = 'generated' AND x.kind = 'open') OR ({st} = 'open' AND x.kind IN ('in_progress', 'done', 'snoozed', 'dismissed')) OR ({st} = 'in_progress' AND x.kind IN ('done', 'snoozed', 'dismissed', 'open')) OR ({st} = 'snoozed' AND x.kind IN ('open', 'dismissed')))"
    until = "coalesce(x.until, x.at + INTERVAL 1 DAY)"
    snoozes = f"({ok} AND x.kind = 'snoozed')"
    step = f"""{{'at': x.at, 'kind': x.kind, 'until': x.until, 'status': CASE WHEN {ok} THEN x.kind ELSE {st} END, 'rejected': a.rejected + CASE WHEN {ok} THEN 0 ELSE 1 END,
      'snooze': CASE WHEN {snoozes} THEN {until} WHEN NOT {ok} AND {st} = 'snoozed' THEN a.snooze END, 'expires': CASE WHEN {snoozes} THEN greatest({until}, x.at) + INTERVAL 14 DAY WHEN {ok} AND {fresh} THEN x.at + INTERVAL 14 DAY ELSE a.expires END}}"""
    none = "CAST(NULL AS TIMESTAMP)"
    return f"""SELECT task_key, nullif({advanced('f', 't')}, '') AS status, CAST(f.rejected AS INTEGER) AS rejected, n_events, CASE WHEN ({advanced('f', 't')}) = 'snoozed' THEN strftime(f.snooze, '%Y-%m-%d %H:%M:%S.%f') END AS snooze_until, strftime(f.expires, '%Y-%m-%d %H:%M:%S.%f') AS expires_at FROM
      (SELECT task_key, CAST(len(e) AS INTEGER) AS n_events, TIMESTAMP '2024-01-28' AS t, list_reduce(list_prepend({{'at': {none}, 'kind': '', 'until': {none}, 'status': '', 'rejected': 0, 'snooze': {none}, 'expires': {none}}}, e), lambda a, x: {step}) AS f FROM
        (SELECT task_key, list({{'at': "at", 'kind': kind, 'until': until, 'status': '', 'rejected': 0, 'snooze': {none}, 'expires': {none}}} ORDER BY "at", event_id) AS e FROM
          (SELECT task_key, event_id, CAST("at" AS TIMESTAMP) AS "at", CASE WHEN odd THEN 'snoozed' ELSE kind END AS kind, CASE WHEN odd AND event_id % 9 > 0 THEN CAST("at" AS TIMESTAMP) + to_days(CAST(event_id % 9 AS INTEGER)) END AS until FROM (SELECT *, kind = 'dismissed' AND event_id % 2 = 1 AS odd FROM task_events)) GROUP BY 1))"""


@P.add("z1_task_states_with_timers", clock_sql())
def z1_clock(spark, d):
    """Snoozes that end and tasks that expire by the clock; the stream of `streaming.tasks` keeps the same states."""
    text = lambda name: F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(name)
    return ac.fold_with_clock(clocked(spark, d), "2024-01-28 00:00:00").select("task_key", "status", "rejected", "n_events", text("snooze_until"), text("expires_at"))


@P.add("z2_daily_throughput", """SELECT manager_id, CAST(CAST("at" AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(count(*) FILTER (kind = 'done') AS BIGINT) AS done, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS revenue FROM task_events GROUP BY 1, 2""")
def z2(spark, d):
    from tidemark.streaming.jobs import daily_throughput

    return daily_throughput(c.task_events(spark, d)).select("manager_id", F.date_format("day.start", "yyyy-MM-dd").alias("day"), "n", "done", F.coalesce("revenue", F.lit(0)).cast("double").alias("revenue"))


@P.add("z3_live_negatives", """SELECT task_key, strftime(max("at"), '%Y-%m-%d %H:%M:%S.%f') AS last FROM task_events WHERE kind = 'dismissed' GROUP BY 1 HAVING max("at") >= (SELECT max("at") FROM task_events) - INTERVAL 90 DAY""")
def z3(spark, d):
    """The batch twin of the streaming job: dismissals without repeats, of the 90 days before the newest event."""
    from tidemark.streaming.jobs import live_negatives

    ev = c.task_events(spark, d)
    now = ev.agg(F.max("at").alias("now"))
    last = live_negatives(ev).groupBy("task_key").agg(F.max("at").alias("last")).join(F.broadcast(now)).where(F.col("last") >= F.col("now") - F.expr("interval 90 days"))
    return last.select("task_key", F.date_format("last", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last"))


@P.add(
    "z2_weekly_throughput",
    """SELECT manager_id, CAST(w AS VARCHAR) AS week, count(*) AS n, CAST(count(*) FILTER (kind = 'done') AS BIGINT) AS done FROM (SELECT manager_id, kind, unnest(list_transform(range(0, 7), lambda i: CAST("at" AS DATE) - CAST(i AS INTEGER))) AS w FROM task_events) GROUP BY 1, 2""",
)
def z2_week(spark, d):
    from tidemark.streaming.jobs import weekly_throughput

    return weekly_throughput(c.task_events(spark, d)).select("manager_id", F.date_format("week.start", "yyyy-MM-dd").alias("week"), "n", "done")


#: The task table in SQL, and its spelling in results.
TASK_TABLE = {
    "folded": FOLDED,
    "task_table": """SELECT *, CASE WHEN status = 'snoozed' THEN updated_at + to_days(k % 5) END AS snooze_until FROM (SELECT f.task_key, c_nationkey AS manager_id, s.client_id, s.task_type, CASE WHEN f.status = 'in_progress' AND k % 3 = 0 THEN 'snoozed' ELSE coalesce(f.status, 'generated') END AS status, CASE k % 3 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' ELSE 'normal' END AS urgency,
      CAST(k AS DOUBLE) AS priority, k * 10.0::DOUBLE AS ev_score, CASE WHEN k % 7 > 0 THEN updated_at + INTERVAL 3 DAY END AS due_date, CASE WHEN k % 5 > 0 THEN updated_at + INTERVAL 14 DAY END AS expires_at, k % 11 = 0 AS sla_breached, CASE WHEN k % 22 = 0 THEN 900 END AS escalated_to, generated_at, updated_at, k, 0 AS steps
      FROM folded f JOIN (SELECT concat_ws(':', CAST(user_id AS VARCHAR), CAST(k AS VARCHAR)) AS task_key, client_id, task_type, CAST(k AS INTEGER) AS k, min("at") AS generated_at, max("at") AS updated_at FROM logged GROUP BY ALL) s ON s.task_key = f.task_key JOIN customer ON c_custkey = s.client_id)""",
    "logged": TASKS["logged"],
}
TIMES = ("due_date", "snooze_until", "expires_at", "generated_at", "updated_at")
SPELLED = ", ".join(f"strftime({x}, '%Y-%m-%d %H:%M:%S.%f') AS {x}" for x in TIMES)


def spelled(df):
    """Tasks with times as text and the history's length."""
    return df.withColumns({x: F.date_format(x, "yyyy-MM-dd HH:mm:ss.SSSSSS") for x in TIMES} | {"steps": F.size("status_history")}).drop("status_history")


@P.add(
    "n18_task_upsert",
    f"""SELECT task_key, manager_id, client_id, task_type, status, urgency, priority, ev_score, {SPELLED}, sla_breached, escalated_to, CAST(steps AS INTEGER) AS steps FROM (
    SELECT coalesce(o.task_key, n.task_key) AS task_key, coalesce(o.status, 'open') AS status, coalesce(o.sla_breached, false) AS sla_breached, o.escalated_to, o.snooze_until, CASE WHEN o.task_key IS NULL THEN TIMESTAMP '2024-01-20' ELSE o.generated_at END AS generated_at, CASE WHEN o.task_key IS NULL THEN 1 ELSE 0 END AS steps,
      {", ".join(f"CASE WHEN n.task_key IS NULL OR o.status IN ('done', 'dismissed') THEN o.{x} ELSE n.{x} END AS {x}" for x in ("manager_id", "client_id", "task_type", "urgency", "priority", "ev_score", "due_date", "expires_at", "updated_at"))}
    FROM task_table o FULL JOIN (SELECT concat_ws(':', CAST(client_id AS VARCHAR), CASE task_type WHEN 'debt_followup' THEN '0' WHEN 'reorder_due' THEN '1' WHEN 'churn_winback' THEN '2' ELSE '3' END) AS task_key, manager_id, client_id, task_type, urgency, priority, ev_score, TIMESTAMP '2024-01-23' AS due_date, TIMESTAMP '2024-02-03' AS expires_at, TIMESTAMP '2024-01-20' AS updated_at FROM task) n ON o.task_key = n.task_key)""",
    **TASKS,
    **{k: v for k, v in TASK_TABLE.items() if k != "logged"},
)
def n18(spark, d):
    """The candidates meet the task table: keys of finished tasks, active ones and new ones all occur."""
    new = keyed(tasks(spark, d)).select("task_key", "manager_id", "client_id", "task_type", "urgency", "priority", "ev_score", F.lit("2024-01-23 00:00:00").cast("timestamp").alias("due_date"))
    return spelled(ac.upsert(task_table(spark, d), new, "2024-01-20 00:00:00"))


@P.add(
    "n19_nightly_sweep",
    f"""SELECT task_key, manager_id, client_id, task_type, status, urgency, priority, ev_score, {SPELLED}, sla_breached, escalated_to, CAST(steps AS INTEGER) AS steps FROM (
    SELECT * REPLACE (CASE WHEN wakes THEN 'open' ELSE status END AS status, late AS sla_breached, CASE WHEN raised THEN 7 ELSE escalated_to END AS escalated_to, CASE WHEN wakes OR (late AND NOT sla_breached) OR raised THEN TIMESTAMP '2024-01-20' ELSE updated_at END AS updated_at, CAST(wakes AS INTEGER) AS steps) FROM (
    SELECT *, due AND late AND urgency IN ('critical', 'high') AND escalated_to IS NULL AS raised FROM (SELECT *, sla_breached OR (due AND coalesce(due_date < TIMESTAMP '2024-01-20', false)) AS late FROM (
    SELECT *, status = 'snoozed' AND snooze_until <= TIMESTAMP '2024-01-20' AS wakes, status NOT IN ('done', 'dismissed') AND (snooze_until IS NULL OR snooze_until <= TIMESTAMP '2024-01-20') AS due FROM task_table WHERE status IN ('done', 'dismissed') OR expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-20'))))""",
    **TASK_TABLE,
)
def n19(spark, d):
    return spelled(ac.sweep(task_table(spark, d), "2024-01-20 00:00:00", 7))


@P.add(
    "n17_task_keys",
    """SELECT t.manager_id, t.client_id, t.task_type, x.status, x.task_key IS NOT NULL AS known, coalesce(h.held, 0) AS held, m.client_id IS NOT NULL AS muted FROM task t
    LEFT JOIN swept x ON x.task_key = concat_ws(':', CAST(t.client_id AS VARCHAR), CASE t.task_type WHEN 'debt_followup' THEN '0' WHEN 'reorder_due' THEN '1' WHEN 'churn_winback' THEN '2' ELSE '3' END)
    LEFT JOIN (SELECT manager_id, client_id, count(*) AS held FROM swept WHERE status NOT IN ('done', 'dismissed') GROUP BY ALL) h ON h.manager_id = t.manager_id AND h.client_id = t.client_id
    LEFT JOIN (SELECT DISTINCT client_id, task_type FROM logged WHERE event_type NOT IN ('signup', 'view', 'click', 'purchase') AND "at" > (SELECT max("at") FROM logged) - INTERVAL 30 DAY) m ON m.client_id = t.client_id AND m.task_type = t.task_type""",
    **TASKS,
    swept="SELECT * REPLACE (CASE WHEN status = 'snoozed' AND snooze_until <= TIMESTAMP '2024-03-01' THEN 'open' ELSE status END AS status) FROM task_table WHERE status IN ('done', 'dismissed') OR expires_at IS NULL OR expires_at >= TIMESTAMP '2024-03-01'",
    **{k: v for k, v in TASK_TABLE.items() if k != "logged"},
)
def n17_keys(spark, d):
    """What admission knows of each candidate: its task of any status, the client's active tasks, and whether it is muted."""
    candidates, _, existing, muted = admission_inputs(spark, d)
    held = existing.where(ac.is_active(F.col("status"))).groupBy("manager_id", "client_id").agg(F.count(F.lit(1)).alias("held"))
    df = candidates.join(existing.select("task_key", "status", F.lit(True).alias("known")), "task_key", "left").join(held, ["manager_id", "client_id"], "left")
    df = df.join(muted.withColumn("muted", F.lit(True)), ["manager_id", "client_id", "task_type"], "left")
    return df.select("manager_id", "client_id", "task_type", "status", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("muted", F.lit(False)).alias("muted"))


@P.add("n21_ranking_backfill", "SELECT client_id, task_type, round(priority / 100 + 0.000000001::DOUBLE, 6) AS p_outcome, round(ev + 0.000000001::DOUBLE, 2) AS expected_value, round(round(priority / 100 + 0.000000001::DOUBLE, 6) * round(ev + 0.000000001::DOUBLE, 2) + 0.000000001::DOUBLE, 4) AS ev_score FROM (SELECT t.client_id, t.task_type, priority, CASE t.task_type WHEN 'debt_followup' THEN overdue WHEN 'churn_winback' THEN coalesce(monetary, 0) ELSE CASE WHEN order_count > 0 THEN monetary / order_count ELSE 0 END END AS ev FROM task t JOIN urged u ON u.client_id = t.client_id AND u.task_type = t.task_type LEFT JOIN spent s ON s.client_id = t.client_id)", **TASKS)
def n21(spark, d):
    """Tasks as they were before ranking fields were kept: all three are filled from priority and signals."""
    feats = sales.client_features(year(spark, d), END).select("client_id", "monetary", "order_count")
    owed = ac.debt_candidates(risk.aged(spark, d), END).select("client_id", F.col("overdue").alias("overdue_amount"))
    none = F.lit(None).cast("double")
    old = tasks(spark, d).select("client_id", "task_type", "priority").join(feats, "client_id", "left").join(owed, "client_id", "left").withColumns({"p_outcome": none, "expected_value": none, "ev_score": none})
    return ac.ranking_backfill(old).select("client_id", "task_type", "p_outcome", "expected_value", "ev_score")


@P.add("n22_escalation_queue", "SELECT manager_id, client_id, task_type, urgency, CAST(r AS INTEGER) AS rank, critical FROM (SELECT *, row_number() OVER (PARTITION BY manager_id ORDER BY rank) AS r, count(*) FILTER (urgency = 'critical') OVER (PARTITION BY manager_id) AS critical FROM inbox WHERE urgency IN ('critical', 'high')) WHERE r <= 100", **TASKS)
def n22(spark, d):
    """The first hundred urgent tasks of a manager, with the manager's number of critical ones."""
    urgent = tasks(spark, d).where("urgency in ('critical', 'high')")
    counts = urgent.groupBy("manager_id").agg(F.sum((F.col("urgency") == "critical").cast("long")).alias("critical"))
    return ac.inbox(urgent).where("rank <= 100").join(counts, "manager_id").select("manager_id", "client_id", "task_type", "urgency", "rank", "critical")


@P.add("w10_backlog_trim", "SELECT manager_id, client_id, task_type, rank FROM inbox WHERE rank > 40 AND urgency IN ('normal', 'low')", **TASKS)
def w10(spark, d):
    return ac.inbox(tasks(spark, d)).where((F.col("rank") > 40) & F.col("urgency").isin("normal", "low")).select("manager_id", "client_id", "task_type", "rank")


def payload_tasks(spark, d):
    """The task log's events as tasks with a payload: products k and k + 2 and one without an id; every tenth payload is cut off."""
    log = logged(spark, d)
    k = F.substring_index("task_key", ":", -1)
    text = F.concat(F.lit('{"products": [{"product_id": '), k, F.lit(', "score": 0.5}, {"product_id": "'), (k.cast("int") + 2).cast("string"), F.lit('"}, {"score": 0.1}], "note": "x"}'))
    payload = F.when(k.cast("int") % 10 == 0, F.substring(text, 1, 30)).when(k.cast("int") % 11 == 0, None).otherwise(text)
    return log.select("event_id", "client_id", "task_type", F.col("kind").alias("status"), F.when(F.col("kind") == "done", F.col("amount") > 250).alias("sold"), F.col("at").alias("updated_at"), payload.alias("payload"))


PAYLOADS = {
    "logged": TASKS["logged"],
    "payloads": "SELECT client_id, task_type, event_type, value, \"at\", k, CASE WHEN k % 10 = 0 THEN 'corrupt' WHEN k % 11 = 0 THEN 'none' ELSE 'good' END AS state FROM (SELECT l.*, e.value FROM logged l JOIN (SELECT user_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e ON e.user_id = l.user_id AND e.ts = l.\"at\" AND e.event_type = l.event_type AND e.k = l.k)",
}


@P.add("f7_payload_states", "SELECT task_type, count(*) AS n, CAST(count(*) FILTER (state = 'corrupt') AS BIGINT) AS corrupt, CAST(count(*) FILTER (state = 'none') AS BIGINT) AS without, CAST(count(*) FILTER (state = 'good') * 3 AS BIGINT) AS products FROM payloads GROUP BY 1", **PAYLOADS)
def f7_states(spark, d):
    """How payloads parse: by type, those that do not, those that are missing, and the entries of the others."""
    df = pl.parsed(payload_tasks(spark, d), "payload", pl.PRODUCTS)
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)).cast("long"))
    return df.groupBy("task_type").agg(F.count(F.lit(1)).alias("n"), n(F.col("corrupt").isNotNull().cast("int")).alias("corrupt"), n(F.col("payload").isNull().cast("int")).alias("without"), n(F.when(F.col("parsed").isNotNull(), F.size("parsed.products"))).alias("products"))


@P.add(
    "f7_cross_sell_negatives",
    """SELECT DISTINCT client_id, product_id FROM (SELECT client_id, unnest([k, k + 2]) AS product_id FROM payloads WHERE state = 'good' AND task_type = 'cross_sell' AND "at" >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAY AND (event_type NOT IN ('signup', 'view', 'click', 'purchase') OR (event_type = 'purchase' AND NOT CAST(value AS DECIMAL(18,2)) > 250)))""",
    **PAYLOADS,
)
def f7_negatives(spark, d):
    return pl.cross_sell_negatives(payload_tasks(spark, d), "2024-04-10 00:00:00")


@P.add(
    "f7_signals_json",
    """SELECT client_id, task_type, '{"urgency":"' || urgency || '","rank":' || rank || '}' AS signals FROM inbox WHERE rank <= 20""",
    **TASKS,
)
def f7_signals(spark, d):
    """Signals of the first tasks of each manager as JSON text."""
    top = ac.inbox(tasks(spark, d)).where("rank <= 20")
    return pl.as_json(top, ["urgency", "rank"], "signals").select("client_id", "task_type", "signals")
