"""Next best actions: candidates, urgency, expected value, quotas, task state and throughput."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, saturation, scaled_round

#: Rank of urgency and type in an inbox, allowed next states, terminal states.
URGENCY_RANK = {"critical": 0, "high": 1, "normal": 2, "low": 3}
TYPE_RANK = {"debt_followup": 0, "reorder_due": 1, "churn_winback": 2, "cross_sell": 3}
NEXT = {"generated": ("open",), "open": ("in_progress", "done", "snoozed", "dismissed"), "in_progress": ("done", "snoozed", "dismissed", "open"), "snoozed": ("open", "dismissed"), "done": (), "dismissed": ()}
TERMINAL = ("done", "dismissed")
ACTIVE = ("generated", "open", "in_progress", "snoozed")
#: Days until an untouched task expires, and of a snooze without an end.
TTL_DAYS, SNOOZE_DAYS = 14, 1
HISTORY = "array<struct<`from`:string,`to`:string,`at`:timestamp,`by`:string>>"
#: Shares of a manager's seats by type, caps, pace and feedback, label window and paydown share, ranking gate.
TYPE_SHARE = {"debt_followup": 0.40, "reorder_due": 0.27, "churn_winback": 0.16, "cross_sell": 0.17}
CAP, PER_CLIENT, RESERVE = 50, 2, 5
PACE_SPAN, PENALTY, PENALTY_FLOOR, FEEDBACK_DAYS, MUTE_DAYS = 0.25, 0.15, 0.5, 90, 30
OUTCOME_DAYS, PAYDOWN, AUC_FLOOR, AUC_EPSILON = 60, 0.5, 0.68, 0.01
#: Signals of each type, 0 elsewhere.
SIGNALS = {
    "debt_followup": ("overdue_amount", "days_past_terms", "max_overdue_days", "debt_lines"),
    "reorder_due": ("elapsed_days", "cycle_days", "overdue_ratio", "n_orders"),
    "churn_winback": ("drop_ratio", "silence_days", "recent_orders", "prior_orders"),
    "cross_sell": ("top_score", "reco_candidates"),
}


def rounded(x: Column, digits: int) -> Column:
    """round() with a nudge, so that a half that binary fractions put a hair lower still goes up."""
    return F.round(x + 1e-9, digits)


def _rank(label: Column, table: dict[str, int]) -> Column:
    out = F.lit(9)
    for name, i in table.items():
        out = F.when(label == name, i).otherwise(out)
    return out


def reorder_candidates(sales: DataFrame, item: str, as_of: str, least_cycle: float = 7.0, most: float = 3.0) -> DataFrame:
    """(client, item) whose time since the last order lies between one and `most` of its mean cycle; three orders at least."""
    per = sales.groupBy("client_id", item).agg(F.countDistinct("order_id").alias("n_orders"), F.min("created").alias("a"), F.max("created").alias("b")).where("n_orders >= 3 and b > a")
    cycle = F.greatest(F.datediff("b", "a") / (F.col("n_orders") - 1), F.lit(least_cycle))
    per = per.withColumns({"cycle_days": cycle, "elapsed_days": F.datediff(F.lit(as_of).cast("date"), "b")})
    return per.where((F.col("elapsed_days") >= F.col("cycle_days")) & (F.col("elapsed_days") <= F.col("cycle_days") * most)).select("client_id", item, "n_orders", "cycle_days", "elapsed_days")


def bundled(reorders: DataFrame, item: str, top: int = 5) -> DataFrame:
    """One row per client: its items by falling overdue ratio, the first `top`, and the ratio at the 75 % rank."""
    ratio = F.col("elapsed_days") / F.col("cycle_days")
    rows = reorders.groupBy("client_id").agg(F.sort_array(F.collect_list(F.struct((-ratio).alias("r"), item))).alias("x"))
    at = F.greatest(F.ceil(F.size("x") * 0.25), F.lit(1)).cast("int")
    return rows.select("client_id", F.transform(F.slice("x", 1, top), lambda s: s[item]).alias("items"), F.size("x").alias("n_items"), (-F.element_at("x", at)["r"]).alias("p75_ratio"))


def debt_candidates(lines: DataFrame, as_of: str, most_age: int = 365, least: float = 10.0) -> DataFrame:
    """Clients with debt past terms, not older than most_age days, of at least `least` EUR. lines have od and eur."""
    age = F.datediff(F.lit(as_of).cast("date"), "created")
    agg = lines.where((F.col("od") > 0) & (age <= most_age)).groupBy("client_id").agg(F.sum("eur").alias("overdue"), F.max(age).alias("max_age"), F.max("od").alias("days_past"), F.count(F.lit(1)).alias("n_lines"))
    return agg.where(F.col("overdue") >= least)


def churn_candidates(sales: DataFrame, as_of: str, recent: int = 90, base: int = 365) -> DataFrame:
    """Clients whose recent order rate is under half of the earlier one."""
    t = F.lit(as_of).cast("date")
    orders = sales.select("client_id", "order_id", "created").distinct()
    new, old = F.col("created") >= F.date_sub(t, recent), (F.col("created") >= F.date_sub(t, base)) & (F.col("created") < F.date_sub(t, recent))
    agg = orders.groupBy("client_id").agg(F.sum(new.cast("long")).alias("recent_orders"), F.sum(old.cast("long")).alias("prior_orders"), F.datediff(t, F.max("created")).alias("silence_days"))
    return agg.where((F.col("prior_orders") >= 2) & (F.col("recent_orders") / recent < 0.5 * (F.col("prior_orders") / (base - recent))))


def debt_urgency(days: Column) -> Column:
    return F.when(days <= 0, 0.0).otherwise(clamp(0.6 + 0.4 * saturation(days, 60.0), 0.0, 1.0))


def reorder_urgency(elapsed: Column, cycle: Column) -> Column:
    return F.when(cycle <= 0, 0.5).otherwise(clamp(0.3 + 0.25 * (elapsed / cycle - 1.0), 0.0, 1.0))


def churn_urgency(drop: Column, silence: Column) -> Column:
    return clamp(0.6 * (1.0 - clamp(drop, 0.0, 1.0)) + 0.4 * saturation(silence, 120.0), 0.0, 1.0)


def cross_sell_urgency(score: Column) -> Column:
    return clamp(0.3 + 0.5 * score, 0.0, 1.0)


def urgency_band(u: Column) -> Column:
    return F.when(u >= 0.85, "critical").when(u >= 0.6, "high").when(u >= 0.3, "normal").otherwise("low")


def priority(u: Column, value: Column, confidence: Column) -> Column:
    return scaled_round(100.0 * clamp(0.5 * u + 0.3 * value + 0.2 * confidence, 0.0, 1.0), 2)


def expected_value(task_type: Column, monetary: Column, orders: Column, overdue: Column) -> Column:
    average = F.when(orders > 0, monetary / orders).otherwise(0.0)
    return F.when(task_type == "debt_followup", F.coalesce(overdue, F.lit(0.0))).when(task_type.isin("reorder_due", "cross_sell"), average).otherwise(monetary)


def inbox(tasks: DataFrame) -> DataFrame:
    """Rank within each manager: urgency, expected value, type, priority, then client and type for a full order."""
    w = Window.partitionBy("manager_id").orderBy(_rank(F.col("urgency"), URGENCY_RANK), F.desc("ev_score"), _rank(F.col("task_type"), TYPE_RANK), F.desc("priority"), "client_id", "task_type")
    return tasks.withColumn("rank", F.row_number().over(w))


def type_quotas(tasks: DataFrame, shares: dict[str, float] = TYPE_SHARE, cap: int = CAP) -> DataFrame:
    """Seats per manager and task type by largest remainder over the types present; they sum to cap, and while cap allows,
    no present type is left without a seat: the largest gives one up."""
    share = F.lit(None).cast("double")
    for name, v in shares.items():
        share = F.when(F.col("task_type") == name, v).otherwise(share)
    present = tasks.select("manager_id", "task_type").distinct().withColumn("share", share).where("share > 0")
    w = Window.partitionBy("manager_id")  # a row per type
    df = present.withColumn("ideal", F.col("share") / F.sum("share").over(w) * cap).withColumn("floor", F.floor("ideal").cast("int"))
    order = w.orderBy((F.col("floor") - F.col("ideal")).asc(), F.desc("share"), "task_type")
    left = F.lit(cap) - F.sum("floor").over(w)
    df = df.withColumn("seats", F.col("floor") + (F.row_number().over(order) <= left).cast("int"))
    empty, donor = F.sum((F.col("seats") == 0).cast("int")).over(w), F.row_number().over(w.orderBy(F.desc("seats"), "task_type")) == 1
    given = F.least(empty, F.max("seats").over(w) - 1)
    starved = F.row_number().over(w.orderBy((F.col("seats") > 0).cast("int"), "share", "task_type"))
    seats = F.when(donor, F.col("seats") - given).when((F.col("seats") == 0) & (starved <= given), 1).otherwise(F.col("seats"))
    return df.withColumn("given", seats).select("manager_id", "task_type", F.col("given").alias("seats"))


def adjusted(tasks: DataFrame, pace: DataFrame, rejections: DataFrame) -> DataFrame:
    """priority and ev_score after pace and feedback: a manager behind the shipped target has reorder and cross-sell tasks
    lifted, one behind the paid target debt tasks, by up to PACE_SPAN; then each rejection of a (client, type) takes
    PENALTY off, down to PENALTY_FLOOR. pace has manager_id and the shares shipped_behind and paid_behind (0..1);
    rejections has client_id, task_type, n."""
    df = tasks.join(pace.select("manager_id", "shipped_behind", "paid_behind"), "manager_id", "left").join(rejections.groupBy("client_id", "task_type").agg(F.sum("n").alias("_n")), ["client_id", "task_type"], "left")
    behind = F.when(F.col("task_type").isin("reorder_due", "cross_sell"), F.col("shipped_behind")).when(F.col("task_type") == "debt_followup", F.col("paid_behind"))
    for factor in (1.0 + F.least(F.coalesce(behind, F.lit(0.0)), F.lit(1.0)) * PACE_SPAN, F.greatest(F.lit(PENALTY_FLOOR), 1.0 - PENALTY * F.coalesce("_n", F.lit(0)))):
        df = df.withColumns({"priority": F.least(F.lit(100.0), rounded(F.col("priority") * factor, 2)), "ev_score": rounded(F.col("ev_score") * factor, 4)})
    return df.select(tasks.columns)


def admit(tasks: DataFrame, quotas: DataFrame, existing: DataFrame, muted: DataFrame, cap: int = CAP, per_client: int = PER_CLIENT, reserve: int = RESERVE) -> DataFrame:
    """(manager_id, client_id, task_type, ev_score, via) of the candidates a manager takes on, best ev_score first.

    Three passes: `quota` within the type's seats, `refill` of what the seats held back, up to cap active tasks; then up to
    `reserve` critical debts above it. existing (task_key, manager_id, client_id, task_type, status) is the task table: a
    candidate whose key is in it, active or finished, is not taken again, and its active tasks count. Muted
    (manager_id, client_id, task_type) and a manager's clients with per_client active tasks are skipped.

    The order inside a manager is sequential, so each manager is one group of bounded size: besides tasks and clients that
    are out already, only the per-client limit skips rows, and it skips at most as many as are taken; so the first
    2 * (cap + reserve) of a type are enough, and Spark cuts to them first.
    """
    held_now = existing.where(is_active(F.col("status")))
    full = held_now.groupBy("manager_id", "client_id").agg(F.count(F.lit(1)).alias("held"))
    fresh = tasks.join(existing.select("task_key").distinct(), "task_key", "left_anti").join(muted, ["manager_id", "client_id", "task_type"], "left_anti")
    fresh = fresh.join(full, ["manager_id", "client_id"], "left").withColumn("held", F.coalesce("held", F.lit(0)).cast("int")).where(F.col("held") < per_client)
    best = [F.desc("ev_score"), F.desc("priority"), F.col("client_id"), F.col("task_type")]
    cut = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("manager_id", "task_type", F.col("urgency") == "critical").orderBy(*best))).where(F.col("_r") <= 2 * (cap + reserve))
    now = held_now.groupBy("manager_id", "task_type").agg(F.count(F.lit(1)).cast("int").alias("active"))
    own = now.groupBy("manager_id").agg(F.map_from_entries(F.collect_list(F.struct("task_type", "active"))).alias("active"))  # an entry per type
    seats = quotas.groupBy("manager_id").agg(F.map_from_entries(F.collect_list(F.struct("task_type", "seats"))).alias("seats"))
    rows = cut.join(own, "manager_id", "left").join(seats, "manager_id", "left").select("manager_id", "client_id", "task_type", "ev_score", "priority", "urgency", "held", "active", "seats")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ev_score", "priority", "client_id", "task_type"], ascending=[False, False, True, True], kind="stable")
        types, clients, critical = pdf["task_type"].tolist(), pdf["client_id"].tolist(), (pdf["urgency"] == "critical").tolist()
        held = dict(zip(clients, pdf["held"].tolist()))
        by_type, seats = dict(pdf["active"].iloc[0] or {}), dict(pdf["seats"].iloc[0] or {})
        active, via = sum(by_type.values()), {}

        def take(i: int, name: str, most: int) -> None:
            nonlocal active
            if i not in via and active < most and held[clients[i]] < per_client:
                via[i] = name
                active += 1
                held[clients[i]] += 1
                by_type[types[i]] = by_type.get(types[i], 0) + 1

        back = []
        for i, kind in enumerate(types):
            if by_type.get(kind, 0) >= seats.get(kind, cap):
                back.append(i)
            else:
                take(i, "quota", cap)
        for i in back:
            take(i, "refill", cap)
        before = active
        for i, kind in enumerate(types):
            if kind == "debt_followup" and critical[i] and active - before < reserve:
                take(i, "reserve", cap + reserve)
        took = sorted(via)
        rows = list(pdf[["manager_id", "client_id", "task_type", "ev_score"]].iloc[took].itertuples(index=False, name=None))
        return pd.DataFrame([(*row, via[i]) for row, i in zip(rows, took)], columns=["manager_id", "client_id", "task_type", "ev_score", "via"])

    return rows.groupBy("manager_id").applyInPandas(run, "manager_id int, client_id long, task_type string, ev_score double, via string")


def ranking_backfill(tasks: DataFrame) -> DataFrame:
    """Fills p_outcome, expected_value and ev_score of rows from before they were kept: the probability from the priority, the
    value from the signals (overdue_amount, monetary, order_count); values that are set stay."""
    p = F.coalesce("p_outcome", rounded(F.when(F.col("priority") > 0, F.col("priority") / 100.0).otherwise(0.0), 6))
    per_order = F.when(F.col("order_count") > 0, F.coalesce("monetary", F.lit(0.0)) / F.col("order_count"))
    derived = F.when(F.col("task_type") == "debt_followup", F.col("overdue_amount")).when(F.col("task_type").isin("reorder_due", "cross_sell"), per_order).when(F.col("task_type") == "churn_winback", F.col("monetary"))
    df = tasks.withColumns({"p_outcome": p, "expected_value": F.coalesce("expected_value", rounded(F.coalesce(derived, F.lit(0.0)), 2))})
    return df.withColumn("ev_score", F.coalesce("ev_score", rounded(F.col("p_outcome") * F.col("expected_value"), 4)))


def rolling_snapshots(today: str, n: int = 9, days: int = OUTCOME_DAYS) -> list[str]:
    """The newest n month starts whose outcome window of `days` has closed by today, oldest first."""
    last = pd.Timestamp(today) - pd.Timedelta(days=days)
    months = last.year * 12 + last.month - 1
    return [f"{k // 12:04d}-{k % 12 + 1:02d}-01" for k in range(months - n + 1, months + 1)]


def legacy_confidence(task_type: Column, n_orders: Column, prior: Column, top: Column) -> Column:
    return F.when(task_type == "debt_followup", 1.0).when(task_type == "reorder_due", F.least(F.lit(1.0), 0.4 + 0.1 * n_orders)).when(task_type == "churn_winback", F.least(F.lit(1.0), 0.5 + 0.05 * prior)).otherwise(top)


def live_rows(tasks: DataFrame) -> DataFrame:
    """Finished tasks with a recorded outcome as training rows of vintage `live`; the label is whether it sold. tasks has
    task_type, status, client_id, outcome struct<sold>, signals map<string,double>, priority."""
    some = tasks.where(F.col("status").isin(*TERMINAL) & F.col("outcome.sold").isNotNull() & F.col("client_id").isNotNull() & F.col("task_type").isin(*SIGNALS))
    read = lambda k, d: F.coalesce(F.try_element_at("signals", F.lit(k)), F.lit(d))
    signals = [F.when(F.col("task_type") == t, read(k, 0.0)).otherwise(0.0).alias(f"sig_{k}") for t, ks in SIGNALS.items() for k in ks]
    return some.select(F.lit("live").alias("vintage"), "task_type", "client_id", read("monetary", 0.0).alias("monetary"), read("recency_days", 9999.0).alias("recency_days"), read("order_count", 0.0).alias("order_count"), *signals, F.col("outcome.sold").cast("int").alias("label"), F.coalesce("priority", F.lit(0.0)).alias("old_priority"))


def throughput(tasks: DataFrame) -> DataFrame:
    """Active, done, sold, dismissed, revenue, close and conversion rate by manager, and the grand total (null manager)."""
    agg = tasks.rollup("manager_id").agg(
        F.sum((~F.col("status").isin(*TERMINAL)).cast("long")).alias("active"),
        F.sum((F.col("status") == "done").cast("long")).alias("done"),
        F.sum((F.col("status") == "dismissed").cast("long")).alias("dismissed"),
        F.sum(F.coalesce("amount", F.lit(0)).cast("decimal(18,2)")).cast("double").alias("revenue"),
    )
    closed = F.col("done") + F.col("dismissed")
    return agg.withColumns({"close_rate": closed / (closed + F.col("active")), "conversion": F.when(closed > 0, F.col("done") / closed).otherwise(0.0)})


def fold_events(events: DataFrame) -> DataFrame:
    """Current state per task from its ordered events; an event that is no allowed next state is counted and ignored."""
    ordered = events.groupBy("task_key").agg(F.sort_array(F.collect_list(F.struct("at", "event_id", "kind", "amount"))).alias("e"))
    allowed = F.create_map(*[F.lit(x) for k, v in NEXT.items() for x in (k, ",".join(v))])
    start = F.struct(F.lit("").alias("status"), F.lit(0).alias("rejected"), F.lit(None).cast("decimal(18,2)").alias("amount"))

    def step(acc: Column, x: Column) -> Column:
        ok = F.when(acc["status"] == "", x["kind"].isin("generated", "open")).otherwise(F.array_contains(F.split(allowed[acc["status"]], ","), x["kind"]))
        return F.struct(F.when(ok, x["kind"]).otherwise(acc["status"]).alias("status"), (acc["rejected"] + (~ok).cast("int")).alias("rejected"), F.when(ok & (x["kind"] == "done"), x["amount"]).otherwise(acc["amount"]).alias("amount"))

    done = F.aggregate("e", start, step)
    return ordered.withColumn("s", done).select("task_key", F.nullif("s.status", F.lit("")).alias("status"), "s.rejected", F.col("s.amount").alias("amount"), F.size("e").alias("n_events"))


def fold_with_clock(events: DataFrame, now: str) -> DataFrame:
    """Task states at `now` from events (task_key, event_id, kind, at, amount, until), with what time alone does.

    As in `fold_events`, and between events a snooze that is over opens the task, and an active one past its expiry is `expired`,
    after which it can only begin anew. A task expires TTL_DAYS after it began or after its snooze ends; a snooze without an end
    takes SNOOZE_DAYS.
    """
    ordered = events.groupBy("task_key").agg(F.sort_array(F.collect_list(F.struct("at", "event_id", "kind", "amount", "until"))).alias("e"))
    allowed = F.create_map(*[F.lit(x) for k, v in NEXT.items() for x in (k, ",".join(v))])
    ever, days = F.lit(None).cast("timestamp"), lambda n: F.make_dt_interval(F.lit(n))
    start = F.struct(F.lit("").alias("status"), F.lit(0).alias("rejected"), F.lit(None).cast("decimal(18,2)").alias("amount"), ever.alias("snooze"), ever.alias("expires"))

    def advanced(s: Column, t: Column) -> Column:
        woken = F.when((s["status"] == "snoozed") & (s["snooze"] <= t), "open").otherwise(s["status"])
        return F.when(woken.isin(*ACTIVE) & (s["expires"] < t), "expired").otherwise(woken)

    # A step is two lambdas, so that the advanced status is worked out once: zip with one element stands for a let.
    def step(acc: Column, x: Column) -> Column:
        def go(status: Column) -> Column:
            new = status.isin("", "expired")
            ok = F.when(new, x["kind"].isin("generated", "open")).otherwise(F.array_contains(F.split(allowed[status], ","), x["kind"]))
            until = F.coalesce(x["until"], x["at"] + days(SNOOZE_DAYS))
            snoozes = ok & (x["kind"] == "snoozed")
            expires = F.when(snoozes, F.greatest(until, x["at"]) + days(TTL_DAYS)).when(ok & new, x["at"] + days(TTL_DAYS)).otherwise(acc["expires"])
            return F.struct(
                F.when(ok, x["kind"]).otherwise(status).alias("status"),
                (acc["rejected"] + (~ok).cast("int")).alias("rejected"),
                F.when(ok & (x["kind"] == "done"), x["amount"]).otherwise(acc["amount"]).alias("amount"),
                F.when(snoozes, until).when(~ok & (status == "snoozed"), acc["snooze"]).alias("snooze"),
                expires.alias("expires"),
            )

        return F.transform(F.array(advanced(acc, x["at"])), go)[0]

    done = ordered.withColumn("s", F.aggregate("e", start, step)).withColumn("status", advanced(F.col("s"), F.lit(now).cast("timestamp")))
    return done.select("task_key", F.nullif("status", F.lit("")).alias("status"), "s.rejected", F.col("s.amount").alias("amount"), F.size("e").alias("n_events"), F.when(F.col("status") == "snoozed", F.col("s.snooze")).alias("snooze_until"), F.col("s.expires").alias("expires_at"))


def is_active(status: Column) -> Column:
    return F.coalesce(status.isin(*ACTIVE), F.lit(False))


def history_entry(old: Column | str, new: str, at: Column) -> Column:
    """One step of a status history, made by the system."""
    before = F.lit(old) if isinstance(old, str) else old
    return F.array(F.struct(before.alias("from"), F.lit(new).alias("to"), at.alias("at"), F.lit("system").alias("by"))).cast(HISTORY)


def sweep(tasks: DataFrame, now: str, escalate_to: int | None = None) -> DataFrame:
    """Nightly update of a task table at `now`: wake, flag, escalate, and drop what expired.

    tasks has status, due_date, snooze_until, expires_at, urgency, sla_breached, escalated_to, updated_at, status_history and
    any others. Snoozed tasks whose time has come are open again. Active tasks past due_date that are not snoozed into the
    future are flagged; flags that are set stay. With escalate_to, flagged ones of high or critical urgency go to it unless
    they went to somebody before. Active tasks past expires_at go; finished ones and those without expires_at stay. Null
    dates are never past, a null flag is not set, a null status is not active. Each changed row has now as updated_at.
    """
    t = F.lit(now).cast("timestamp")
    past = lambda name: F.coalesce(F.col(name) < t, F.lit(False))
    wakes = F.coalesce((F.col("status") == "snoozed") & (F.col("snooze_until") <= t), F.lit(False))
    due = is_active(F.col("status")) & (F.col("snooze_until").isNull() | (F.col("snooze_until") <= t))
    late = F.coalesce("sla_breached", F.lit(False)) | due & past("due_date")
    raised = F.lit(escalate_to is not None) & due & late & F.coalesce(F.col("urgency").isin("critical", "high"), F.lit(False)) & F.col("escalated_to").isNull()
    changed = wakes | (late & ~F.coalesce("sla_breached", F.lit(False))) | raised
    kept = tasks.where(~(is_active(F.col("status")) & past("expires_at")))
    return kept.withColumns(
        {
            "status": F.when(wakes, "open").otherwise(F.col("status")),
            "sla_breached": late,
            "escalated_to": F.when(raised, F.lit(escalate_to)).otherwise(F.col("escalated_to")),
            "status_history": F.when(wakes, F.concat(F.coalesce("status_history", F.array().cast(HISTORY)), history_entry("snoozed", "open", t))).otherwise(F.col("status_history")),
            "updated_at": F.when(changed, t).otherwise(F.col("updated_at")),
        }
    )


def upsert(old: DataFrame, new: DataFrame, now: str, ttl_days: int = TTL_DAYS) -> DataFrame:
    """The task table after a generation run at `now`: old (all columns of a task) and new (task_key and the computed columns).

    A new key enters as open, with its first step in the history. An active task of the table has all computed columns refreshed, and
    updated_at and expires_at, and keeps what its owner set: every other column. A finished task and one without a candidate
    stay as they are. Each table has a key once; a null key equals no other.
    """
    t = F.lit(now).cast("timestamp")
    fresh = new.withColumns({"updated_at": t, "expires_at": t + F.make_dt_interval(F.lit(ttl_days))})
    entry = {"status": F.lit("open"), "sla_breached": F.lit(False), "generated_at": t, "status_history": history_entry("generated", "open", t)}
    j = old.withColumn("_o", F.lit(True)).alias("o").join(fresh.withColumn("_n", F.lit(True)).alias("n"), F.col("o.task_key") == F.col("n.task_key"), "full_outer")
    there, comes = F.col("_o").isNotNull(), F.col("_n").isNotNull()
    keep = there & (~comes | F.coalesce(F.col("o.status").isin(*TERMINAL), F.lit(False)))
    out = [F.coalesce("o.task_key", "n.task_key").alias("task_key")]
    for name in [*old.columns, *(x for x in fresh.columns if x not in old.columns)]:
        if name == "task_key":
            continue
        was = F.col(f"o.{name}") if name in old.columns else F.lit(None)
        if name in fresh.columns:
            out.append(F.when(keep, was).otherwise(F.col(f"n.{name}")).alias(name))
        else:
            out.append(F.when(there, was).otherwise(entry.get(name, F.lit(None))).alias(name))
    return j.select(out)
