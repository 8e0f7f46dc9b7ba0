"""Small cases for operators that SQL cannot express, data rules, and invariants."""

import datetime as dt
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns as col
from tidemark.operators import actions, assortment, catalogue, pricing, ranking, reco, risk, scorecard, supply, timeseries as ts
from tidemark.sources import canonical as c, sinks
from tidemark.streaming import jobs


def series(spark, rows):
    return spark.createDataFrame(rows, "key long, series array<double>")


def test_inverse_normal(spark):
    from statistics import NormalDist

    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.975, 0.9999]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(col.inv_norm_cdf(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-6)


def test_working_days_leave_sundays_out(spark):
    got = spark.range(1).select(col.working_days(F.lit("2000-01-01").cast("date"), F.lit("2000-01-31").cast("date")).alias("n")).first()
    assert got.n == 26


def brute_croston(x, alpha, sba):
    at = [i for i, v in enumerate(x) if v > 0]
    if len(at) < 2:
        return sum(x) / len(x)
    z, p, prev = x[at[0]], at[0] + 1.0, at[0]
    for i in at[1:]:
        z, p, prev = z + alpha * (x[i] - z), p + alpha * (i - prev - p), i
    return z / p * (1 - alpha / 2 if sba else 1)


def test_smoothers_against_loops(spark):
    rnd = random.Random(3)
    rows = [(k, [rnd.choice([0.0, 0.0, rnd.random() * 100]) for _ in range(24)]) for k in range(40)] + [(40, [0.0] * 24), (41, [5.0])]
    s = F.col("series")
    got = series(spark, rows).select("key", col.ewma(s, 0.3).alias("e"), col.croston(s, 0.1, True).alias("c"), col.holt_path(s, 3).alias("h")).collect()
    for r in got:
        x = dict(rows)[r.key]
        level = x[0]
        for v in x[1:]:
            level = 0.3 * v + 0.7 * level
        l, b = x[0], x[1] - x[0] if len(x) > 1 else 0.0
        for v in x[1:]:
            new = 0.4 * v + 0.6 * (l + 0.85 * b)
            l, b = new, 0.2 * (new - l) + 0.8 * 0.85 * b
        assert r.e == pytest.approx(max(0, level))
        assert r.c == pytest.approx(brute_croston(x, 0.1, True))
        assert r.h == pytest.approx([max(0.0, l + b * sum(0.85**k for k in range(1, h + 1))) for h in (1, 2, 3)])


def test_demand_classes(spark):
    rows = [(1, [10.0] * 12), (2, [0.0] * 12), (3, [0.0, 10.0, 0.0, 0.0, 10.0, 0.0] * 2), (4, [1.0, 50.0, 1.0, 60.0] * 3), (5, [0.0, 1.0, 0.0, 0.0, 90.0, 0.0] * 2)]
    got = {r.key: r.segment for r in ts.with_demand_class(series(spark, rows)).collect()}
    assert got == {1: "smooth", 2: "no_demand", 3: "intermittent", 4: "erratic", 5: "lumpy"}


def test_thin_series_give_no_forecast(spark):
    assert ts.forecast(series(spark, [(1, [0.0, 1.0, 0.0, 2.0])]), "key", 6).count() == 0


def test_backtest_sees_only_its_past(spark):
    a, b = [5.0] * 12, [5.0] * 11 + [500.0]
    got = ts.backtest(series(spark, [(1, a), (2, b)]), "key", horizon=1, origins=1).where("method = 'moving_avg'").collect()
    assert {r.forecast for r in got} == {5.0} and {r.actual for r in got} == {5.0, 500.0}


def test_later_rows_change_no_series(spark):
    day = dt.date(1999, 6, 1)
    rows = [(1, day, 3.0), (1, dt.date(1999, 12, 31), 4.0)]
    base = spark.createDataFrame(rows, "product_id long, created date, qty double")
    more = base.union(spark.createDataFrame([(1, dt.date(2000, 1, 1), 99.0)], base.schema))
    assert ts.densify(base, "product_id", "qty", "2000-01-01", 12).collect() == ts.densify(more, "product_id", "qty", "2000-01-01", 12).collect()


@pytest.mark.parametrize("rows", [500_000, 40])
def test_running_sum_with_ties_nulls_and_one_heavy_value(spark, monkeypatch, rows):
    """Also with buckets so small that one value fills several."""
    monkeypatch.setattr(ranking, "BUCKET_ROWS", rows)
    rows = [(i, 7.0 if i % 3 else float(i % 50)) for i in range(1, 600)] + [(1000, None)]
    df = spark.createDataFrame(rows, "k long, v double").withColumn("v", F.col("v").cast("decimal(18,2)"))
    got = {r.k: float(r.running) for r in ranking.running_sum(df, "v", "k").collect()}
    total, want = 0.0, {}
    for k, v in sorted(((k, v or 0.0) for k, v in rows), key=lambda x: (-x[1], x[0])):
        total += v
        want[k] = total
    assert got == want


def test_abc_forms(spark):
    df = spark.createDataFrame([(1, 80), (2, 15), (3, 5), (4, 0)], "k long, v long").withColumn("v", F.col("v").cast("decimal(18,2)"))
    inclusive = {r.k: r.abc for r in ranking.abc_inclusive(df, "v", "k").collect()}
    exclusive = {r.k: r.abc for r in ranking.abc_exclusive(df, "v", "k").collect()}
    assert inclusive == {1: "A", 2: "B", 3: "C", 4: "C"} and exclusive == {1: "A", 2: "B", 3: "C", 4: "C"}
    none = spark.createDataFrame([(1, 0)], "k long, v long").withColumn("v", F.col("v").cast("decimal(18,2)"))
    assert ranking.abc_inclusive(none, "v", "k").first().abc == "unknown"


def test_mad_trim_keeps_flat_and_thin_groups(spark):
    rows = [("flat", 5.0)] * 5 + [("thin", 1.0), ("thin", 100.0)] + [("odd", float(x)) for x in (10, 11, 12, 10, 11, 500)]
    kept = pricing.mad_kept(spark.createDataFrame(rows, "g string, price double"), ["g"], "price").groupBy("g").count().collect()
    assert {r.g: r["count"] for r in kept} == {"flat": 5, "thin": 2, "odd": 5}


def test_recommended_price_rules(spark):
    rows = [(12.0, 11.0, 10.0), (5.0, 8.0, 10.0), (5.0, 20.0, 10.0), (5.0, 4.0, 10.0), (None, None, 10.0), (None, None, None), (5.0, 8.0, 0.0)]
    df = spark.createDataFrame(rows, "f double, p double, b double")
    price, why = pricing.recommended(F.col("f"), F.col("p"), F.col("b"))
    got = [(r.price, r.why) for r in df.select(price.alias("price"), why.alias("why")).collect()]
    assert got == [(12.0, "below-margin-loss-flag"), (8.0, "peer-median"), (10.0, "at-baseline"), (5.0, "margin-floor"), (10.0, "at-baseline"), (None, "no-anchor"), (None, "no-baseline")]


def test_budget_selection_equals_the_greedy_loop(spark):
    rnd = random.Random(11)
    rows = [(i, round(rnd.random(), 4), round(rnd.random() * 90 + 1, 2)) for i in range(60)]
    got = {r.item_id for r in supply.select_within_budget(spark.createDataFrame(rows, "item_id long, density double, line_cost double"), 400.0).collect()}
    used, want = 0.0, set()
    for i, _, cost in sorted(rows, key=lambda x: (-x[1], x[0])):
        if round(used + cost, 2) <= 400.0:
            used, want = round(used + cost, 2), want | {i}
    assert got == want


def test_budget_selection_does_not_stop_silently(spark):
    items = spark.createDataFrame([(1, 0.9, 1.0), (2, 0.8, 8.5), (3, 0.7, 1.0)], "item_id long, density double, line_cost double")
    assert {r.item_id for r in supply.select_within_budget(items, 9.0).collect()} == {1, 3}
    with pytest.raises(RuntimeError):
        supply.select_within_budget(items, 9.0, most_rounds=1)


def test_order_rounding(spark):
    rows = [(0.0, 5.0, 2.0, 0.0), (3.0, 5.0, 2.0, 6.0), (7.5, 5.0, 1.0, 7.5), (7.5, None, None, 7.5)]
    df = spark.createDataFrame(rows, "q double, moq double, m double, want double")
    assert all(r.got == r.want for r in df.select("want", supply.round_order(F.col("q"), F.col("moq"), F.col("m")).alias("got")).collect())


def test_fx_takes_the_rate_in_force(spark):
    rates = spark.createDataFrame([(1, dt.date(1999, 1, 1), 2.0), (1, dt.date(1999, 7, 1), 3.0)], "currency_id int, valid_from date, rate double")
    rows = [(1, 1.0, dt.date(1999, 6, 30)), (1, 1.0, dt.date(1999, 7, 1)), (0, 1.0, dt.date(1999, 7, 1)), (1, 1.0, dt.date(1998, 1, 1))]
    got = risk.to_eur(spark.createDataFrame(rows, "currency_id int, amount double, day date"), rates, "amount", "day", "eur").collect()
    assert sorted(r.eur for r in got) == [1.0, 1.0, 2.0, 3.0]


def test_binary_metrics_with_ties(spark):
    rows = [(0.1, 0), (0.4, 0), (0.4, 1), (0.8, 1), (0.8, 0), (0.9, 1)]
    got = risk.binary_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got.auc == pytest.approx(auc) and got.gini == pytest.approx(2 * auc - 1)
    assert got.brier == pytest.approx(sum((s - y) ** 2 for s, y in rows) / len(rows))


def test_psi_of_equal_samples_is_zero(spark):
    df = spark.range(1000).select((F.col("id") * 1.0).alias("v"))
    assert risk.psi(df, df, ["v"]).first().psi == pytest.approx(0, abs=1e-9)


def test_quotas_sum_to_the_cap(spark):
    tasks = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "manager_id int, task_type string")
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = actions.type_quotas(tasks, shares, 7).groupBy("manager_id").agg(F.sum("seats").alias("n")).collect()
    assert {r.n for r in got} == {7}
    few = {(r.manager_id, r.task_type): r.seats for r in actions.type_quotas(tasks, {"a": 0.9, "b": 0.06, "c": 0.04}, 5).collect()}
    assert few == {(1, "a"): 4, (1, "b"): 1, (2, "a"): 3, (2, "b"): 1, (2, "c"): 1}


def test_fold_rejects_illegal_steps(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "k", "open", t, None), (2, "k", "generated", t + dt.timedelta(1), None), (3, "k", "done", t + dt.timedelta(2), 5), (4, "k", "open", t + dt.timedelta(3), None)]
    df = spark.createDataFrame(rows, "event_id long, task_key string, kind string, at timestamp, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = actions.fold_events(df).first()
    assert (got.status, got.rejected, float(got.amount)) == ("done", 2, 5.0)


def test_terminal_tasks_stay(spark):
    old = spark.createDataFrame([("a", "done", 1.0), ("b", "open", 1.0), ("c", "open", 1.0)], "task_key string, status string, priority double")
    new = spark.createDataFrame([("a", 9.0), ("b", 9.0), ("d", 9.0)], "task_key string, priority double")
    got = {r.task_key: (r.status, r.priority) for r in actions.upsert(old, new, "2024-01-01 00:00:00").collect()}
    assert got == {"a": ("done", 1.0), "b": ("open", 9.0), "c": ("open", 1.0), "d": ("open", 9.0)}


def test_poison_rows_move_no_sales(spark, sf_dir):
    lines = c.sale_lines(spark, sf_dir)
    bad = lines.limit(5).withColumn("is_valid", F.lit(False)).union(lines.limit(5).withColumn("product_id", F.lit(1).cast("long")))
    assert c.valid_sales(lines.union(bad)).count() == c.valid_sales(lines).count()


def test_snapshots_replace_one_date(spark, tmp_path):
    path = str(tmp_path / "snap")
    a = spark.createDataFrame([(1,)], "x int")
    sinks.write_snapshot(a, path, "2000-01-01")
    sinks.write_snapshot(a.union(a), path, "2000-02-01")
    sinks.write_snapshot(a, path, "2000-02-01")
    assert spark.read.parquet(path).groupBy("vintage").count().count() == 2 and spark.read.parquet(path).count() == 2


def test_seed_terms_keeps_curated_rows(spark):
    curated = spark.createDataFrame([(1, 5)], "k int, moq int")
    derived = spark.createDataFrame([(1, 9), (2, 9)], "k int, moq int")
    assert sorted((r.k, r.moq, r.source) for r in sinks.seed_terms(curated, derived, ["k"]).collect()) == [(1, 5, "curated"), (2, 9, "derived")]


def test_diversity_cap(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "client_id long, product_id long, rank int")
    groups = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (4, "h")], "product_id long, group_id string")
    assert sorted(r.product_id for r in reco.diverse(ranked, groups, "product_id", 2).collect()) == [1, 2, 4, 5]


def test_daily_stream_counts_all_events(spark, sf_dir, tmp_path):
    events = c.task_events(spark, sf_dir)
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    daily = jobs.daily_throughput(stream, "400 days").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "cp2")).start()
    daily.processAllAvailable()
    daily.stop()
    assert spark.table("daily").agg(F.sum("n")).first()[0] == events.count()
    assert math.isfinite(spark.table("daily").count())


def test_pooled_slope_equals_least_squares(spark):
    rnd = np.random.default_rng(9)
    rows = [("g", p, a, float(x), float(2 - 1.3 * x + 0.3 * p - 0.2 * a + e)) for p, a, x, e in zip(rnd.integers(0, 6, 300), rnd.integers(0, 5, 300), rnd.normal(size=300), rnd.normal(size=300) * 0.1)]
    rows = [(g, int(p), int(a), x, y) for g, p, a, x, y in rows]
    got = pricing.pooled_slope(spark.createDataFrame(rows, "g string, p int, a int, x double, y double"), "g", ["p", "a"]).first()
    design = np.array([[x, *(float(p == k) for k in range(6)), *(float(a == k) for k in range(1, 5))] for _, p, a, x, _ in rows])
    beta = np.linalg.lstsq(design, np.array([r[4] for r in rows]), rcond=None)[0]
    assert got.n == 300 and got.slope == pytest.approx(beta[0], abs=1e-4)


def test_links_and_tier_roots(spark):
    products = spark.createDataFrame([(1, " AB-12 "), (2, "ab-12"), (3, "-"), (4, "-"), (5, None)], "product_id long, number string")
    pairs = spark.createDataFrame([(1, 2), (3, 5)], "product_id long, other_id long")
    got = {(r.product_id, r.other_id): r.curated for r in catalogue.links(pairs, products).collect()}
    assert got == {(1, 2): 1, (2, 1): 1, (3, 5): 1, (5, 3): 1}
    tiers = spark.createDataFrame([(0, None, 1.0), (1, 0, 5.0), (2, 1, 3.0)], "pricing_id int, parent_id int, extra double")
    assert {r.pricing_id: (r.root_id, r.extra) for r in catalogue.tier_roots(tiers).collect()} == {0: (0, 1.0), 1: (0, 5.0), 2: (0, 3.0)}
    deep = spark.createDataFrame([(i, i - 1 if i else None, float(i)) for i in range(9)], "pricing_id int, parent_id int, extra double")
    assert {r.root_id for r in catalogue.tier_roots(deep).collect()} == {0}
    with pytest.raises(RuntimeError):
        catalogue.tier_roots(spark.createDataFrame([(0, 1, 0.0), (1, 0, 0.0)], "pricing_id int, parent_id int, extra double"))


# --- rules with branches that the tables do not reach -------------------------------------------------------------------


def test_lead_times_by_history_currency_and_default(spark):
    day = dt.date(1999, 1, 1)
    rows = [(1, 0, day, day + dt.timedelta(n)) for n in (10, 20, 30)] + [(2, 0, day, day + dt.timedelta(500))] * 3
    rows += [(3, 1, day, None), (4, 2, day, None), (5, 3, day, day + dt.timedelta(5)), (6, 4, day, None)]
    got = {r.producer_id: (r.lead_days, round(r.lead_std, 4), r.lead_source) for r in supply.lead_times(spark.createDataFrame(rows, "producer_id long, currency_id int, event_date date, arrived date")).collect()}
    assert got[1] == (20.0, round(math.sqrt(200 / 3), 4), "empirical")
    assert {k: v for k, v in got.items() if k > 1} == {2: (18.0, 9.0, "geo"), 3: (35.0, 17.5, "geo"), 4: (14.0, 7.0, "geo"), 5: (7.0, 3.5, "geo"), 6: (30.0, 15.0, "default")}


def test_purchase_plan_branches(spark):
    names = "producer_id long, product_id long, mean_daily double, std_daily double, lead_days double, lead_std double, position double, abc string, cost double, sale double, moq double, multiple double, factor double"
    item = lambda i, position, **k: tuple({"producer_id": 1, "product_id": i, "mean_daily": 2.0, "std_daily": 0.0, "lead_days": 10.0, "lead_std": 0.0, "position": position, "abc": "C", "cost": 1.0, "sale": 2.0, "moq": None, "multiple": None, "factor": None, **k}.values())
    rows = [item(1, 0.0), item(2, 20.0), item(3, 50.0), item(4, 81.0), item(5, 0.0, moq=100.0, multiple=12.0), item(6, 0.0, factor=0.5), item(7, 5.0, mean_daily=0.0), item(8, 0.0, sale=None, abc="A"), item(9, 0.0, sale=1.05, abc="B"), item(10, 0.0, sale=1000.0, abc="C")]
    got = {r.product_id: r for r in supply.purchase_plan(spark.createDataFrame(rows, names)).collect()}
    assert [got[i].urgency for i in (1, 2, 3, 4)] == ["critical", "high", "normal", "none"]
    assert [got[i].suggested_qty for i in (1, 2, 3, 4, 5, 6)] == [80.0, 60.0, 0.0, 0.0, 108.0, 40.0]
    assert got[5].raw_qty == 80.0 and got[7].days_of_cover == 99999.0 and got[4].days_of_cover == 40.5
    assert (got[8].sl, got[9].sl, got[10].sl) == (0.95, 0.85, 0.99)


def test_position_counts_reservations_and_open_orders(spark):
    frame = lambda name, rows: spark.createDataFrame(rows, f"product_id long, {name} double")
    got = supply.inventory_position(frame("on_hand", [(1, 10.0)]), frame("reserved", [(1, 4.0), (2, 3.0)]), frame("on_order", [(3, 7.0), (1, 1.0)])).collect()
    assert {r.product_id: r.position for r in got} == {1: 7.0, 2: -3.0, 3: 7.0}


def test_plan_backtest_means_over_items_with_demand(spark):
    plan = spark.createDataFrame([(1, 5.0, 5.0, "critical", 2.0, 5.0), (2, 0.0, 1.0, "high", 2.0, None), (3, 8.0, 0.0, "none", None, 3.0)], "product_id long, position double, suggested_qty double, urgency string, cost double, sale double")
    need = spark.createDataFrame([(1, 8.0), (2, 4.0)], "product_id long, need double")
    r = supply.plan_backtest(plan, need, 30).first()
    assert (r.products, r.total_items, r.fill_rate, r.stockout_rate, r.coverage_without_policy) == (2, 3, 0.625, 0.5, 0.0)
    assert r.overstock_units == 10.0 and r.critical_share == 0.3333 and r.understock_loss == 0.0 and r.overstock_hold == round(2 * 0.25 / 365 * 30 * 2, 2)


def test_sweep_weighs_pairs_and_gates(spark):
    plan = spark.createDataFrame(
        [(1, 1, 5.0, 5.0, "critical", 2.0, 5.0), (1, 2, 0.0, 1.0, "high", 2.0, 4.0), (2, 3, 8.0, 0.0, "none", 2.0, 3.0), (3, 2, 4.0, 13.0, "none", None, 3.0)],
        "producer_id long, product_id long, position double, suggested_qty double, urgency string, cost double, sale double",
    )
    need = spark.createDataFrame([(1, 20.0), (2, 4.0)], "product_id long, need double")
    pairs = supply.plan_backtest(plan, need, 60, by=("producer_id",))
    got = {r.producer_id: r for r in pairs.collect()}
    assert (got[1].fill_rate, got[1].stockout_rate, got[1].understock_loss) == (0.375, 1.0, 36.0)
    assert (got[2].products, got[2].overstock_units, got[2].overstock_units_per_demand) == (0, 8.0, 0.0)
    assert (got[3].overstock_rate, got[3].overstock_units_per_demand, got[3].economic_cost) == (1.0, 3.25, 0.0)  # 13 is above 3 times 4
    r = supply.sweep_summary(pairs).first()
    assert (r.n_pairs, r.n_skipped, r.products, r.total_items, r.critical_items) == (2, 1, 3, 3, 1)
    assert (r.fill_rate, r.stockout_rate, r.overstock_units_total, r.economic_cost_per_product) == (0.5833, 0.6667, 13.0, 12.0)
    gate = {g.name: g.holds for g in supply.sweep_gate(supply.sweep_summary(pairs), {"min_n_pairs": 2.0, "max_stockout_rate": 0.5, "max_economic_cost_eur_per_product": 500.0}).collect()}
    assert gate == {"min_n_pairs": True, "max_stockout_rate": False, "max_economic_cost_eur_per_product": True}
    empty = supply.sweep_summary(pairs.where("products < 0")).first()
    assert (empty.n_pairs, empty.n_skipped, empty.fill_rate) == (0, 0, None)


def test_pairs_without_demand_are_planned(spark):
    names = "producer_id long, product_id long, mean_daily double, std_daily double, lead_days double, lead_std double, position double, abc string, cost double, sale double, moq double, multiple double, factor double"
    rows = [(1, 1, 0.0, 0.0, 10.0, 1.0, -4.0, "C", 1.0, 2.0, None, None, None), (1, 2, 0.0, 0.0, 10.0, 1.0, 3.0, "C", 1.0, 2.0, 5.0, None, None)]
    got = {r.product_id: (r.urgency, r.suggested_qty) for r in supply.purchase_plan(spark.createDataFrame(rows, names)).where("suggested_qty >= 0").collect()}
    assert got == {1: ("critical", 4.0), 2: ("none", 0.0)}


def test_month_grids():
    assert ts.month_grid("2000-02-29", 3) == ["1999-12", "2000-01", "2000-02"] and ts.future_months("1999-11-30", 3) == ["1999-12", "2000-01", "2000-02"]
    assert actions.rolling_snapshots("2000-03-01", 3) == ["1999-11-01", "1999-12-01", "2000-01-01"]


def test_five_factor_score_branches(spark):
    names = "client_id long, discipline double, overdue double, turnover double, orders long, recency_days int, tenure_months int, return_rate double, utilization double, blocked boolean"
    best = (1, 1.0, 0.0, 100.0, 24, 0, 24, 0.0, None, False)
    rows = [best, (2, *best[1:8], 1.01, False), (3, *best[1:8], 0.95, False), (4, *best[1:9], True), (5, 1.0, 10.0, 0.0, 24, 0, 24, 0.0, None, False), (6, 1.0, 87.5, 100.0, 24, 45, 24, 0.25, None, False), (7, 0.0, 0.0, 0.0, 0, None, 0, 1.0, None, False)]
    got = {r.client_id: (r.score, r.rating) for r in risk.five_factor_score(spark.createDataFrame(rows, names)).collect()}
    assert got == {1: (100, "A"), 2: (40, "D"), 3: (60, "C"), 4: (50, "C"), 5: (75, "B"), 6: (78, "B"), 7: (35, "D")}
    counts = spark.createDataFrame([(1, 2, 2, 0), (2, 0, 0, 0), (3, 0, 0, 4)], "client_id long, paid long, partial long, notpaid long")
    assert {r.client_id: r.discipline for r in risk.discipline(counts).collect()} == {1: 0.75, 2: 1.0, 3: 0.0}


def test_quantile_woe_of_zeros_and_quantiles(spark):
    rows = [(0.0, 1)] * 4 + [(0.0, 0)] * 6 + [(float(i), int(i % 3 == 0)) for i in range(1, 21)]
    got = {r.bin: r for r in scorecard.quantile_woe(spark.createDataFrame(rows, "x double, y int"), "x", "y").collect()}
    bad, good = 4 + 6, 6 + 14
    assert got[0].woe == pytest.approx(math.log(4.5 / bad / (6.5 / good))) and (got[0].lo, got[0].hi, got[0].n) == (0.0, 0.0, 10)
    cuts = np.quantile(np.arange(1, 21), [0.2, 0.4, 0.6, 0.8])
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, 99]), 1):
        own = [y for x, y in rows if a < x <= b]
        assert got[k].n == len(own) and got[k].woe == pytest.approx(math.log((sum(own) + 0.5) / bad / ((len(own) - sum(own) + 0.5) / good)))


def test_exact_quantiles_equal_numpy(spark):
    values = np.random.default_rng(3).integers(0, 40, 500) / 4
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = [0.0, 0.11, 0.5, 0.83, 1.0]
    assert scorecard.exact_quantiles(df, "v", probs) == pytest.approx(np.quantile(values, probs).tolist())
    assert scorecard.exact_quantiles(df.limit(0), "v", probs) == []


def test_monotone_bins_keep_direction_and_size(spark):
    rnd = np.random.default_rng(8)
    x = np.where(rnd.random(3000) < 0.4, 0.0, rnd.exponential(10, 3000))
    y = (rnd.random(3000) < 1 / (1 + np.exp(2.5 - 0.15 * x + 1.5 * (x > 20)))).astype(int)
    df = spark.createDataFrame([(float(a), float(-a), 7.0, int(b)) for a, b in zip(x, y)], "up double, down double, same double, y int")
    bins = scorecard.monotone_bins(df, {"up": "up", "down": "down", "same": "up"}, "y")
    assert bins["up"]["woe"] == sorted(bins["up"]["woe"]) and bins["down"]["woe"] == sorted(bins["down"]["woe"], reverse=True)
    assert bins["same"]["splits"] == [] and len(bins["same"]["woe"]) == 1
    edges = [-np.inf, *bins["up"]["splits"], np.inf]
    for a, b, w in zip(edges, edges[1:], bins["up"]["woe"]):
        own = y[(x > a) & (x <= b)]
        k = len(bins["up"]["woe"])
        assert len(own) >= 90 and w == pytest.approx(math.log((own.sum() + 0.5) / (y.sum() + 0.5 * k) / ((len(own) - own.sum() + 0.5) / (len(y) - y.sum() + 0.5 * k))))


def test_card_survives_its_model_table(spark):
    card = {"intercept": -0.5, "a": 1.1, "b": 0.2, **scorecard.SCALE, "bands": dict(scorecard.BANDS), "features": {"x": {"splits": [0.0, 2.0], "woe": [-1.0, 0.2, 0.9], "coef": 0.7}, "y": {"splits": [], "woe": [0.3], "coef": -0.4}}}
    assert scorecard.card_from(scorecard.card_rows(spark, card)) == card
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, None, 0.0), (3, 0.0, None)], "client_id long, x double, y double")
    rows = {r.client_id: r for r in risk.apply_scorecard(df, card).collect()}
    lin = {1: -0.5 + 0.63 - 0.12, 2: -0.5 - 0.7 - 0.12, 3: -0.5 - 0.7 - 0.12}
    for i, r in rows.items():
        p = 1 / (1 + math.exp(-(1.1 * lin[i] + 0.2)))
        score = min(max((600 + 20 / math.log(2) * math.log((1 - p) / p) - 400) / 400 * 100, 0), 100)
        assert r.pd == pytest.approx(p) and r.score == pytest.approx(score, abs=0.01) and [c.feature for c in r.contributions] == ["x", "y"]


def brute_admission(tasks, seats, existing, muted, cap, per_client, reserve):
    """The three passes one task at a time, over all candidates of a manager; existing tasks may be finished."""
    took, by_type, by_client = {}, {}, {}
    held = [(c_, t) for _, c_, t, status in existing if status in actions.ACTIVE]
    for c_, t in held:
        by_type[t] = by_type.get(t, 0) + 1
        by_client[c_] = by_client.get(c_, 0) + 1
    known, active = {(c_, t) for _, c_, t, _ in existing}, len(held)
    order = sorted(tasks, key=lambda x: (-x[3], -x[4], x[1], x[2]))

    def attempt(x, via, most):
        nonlocal active
        _, c_, t, *_ = x
        if (c_, t) in known or (c_, t) in muted or (c_, t) in took or active >= most or by_client.get(c_, 0) >= per_client:
            return False
        took[(c_, t)] = via
        by_type[t], by_client[c_] = by_type.get(t, 0) + 1, by_client.get(c_, 0) + 1
        active += 1
        return True

    late = []
    for x in order:
        if by_type.get(x[2], 0) >= seats.get(x[2], cap):
            late.append(x)
        else:
            attempt(x, "quota", cap)
    for x in late:
        attempt(x, "refill", cap)
    extra = 0
    for x in order:
        if x[2] == "debt_followup" and x[5] == "critical" and extra < reserve and attempt(x, "reserve", cap + reserve):
            extra += 1
    return took


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_admission_equals_one_task_at_a_time(spark, seed):
    rnd = random.Random(seed)
    types = list(actions.TYPE_SHARE)
    cap, reserve = 12, 3
    tasks = [(m, c_, t, round(rnd.random() * 100, 1), float(rnd.randrange(50)), rnd.choice(["critical", "high"])) for m in (1, 2) for c_ in range(m * 100, m * 100 + 40) for t in types if rnd.random() < 0.7]
    existing = [(m, c_, t, rnd.choice(["open", "snoozed", "done", "dismissed"])) for m, c_, t, *_ in tasks if rnd.random() < 0.12]
    muted = {(c_, t) for _, c_, t, *_ in tasks if rnd.random() < 0.2}
    df = spark.createDataFrame(tasks, "manager_id int, client_id long, task_type string, ev_score double, priority double, urgency string")
    df = df.withColumn("task_key", F.concat_ws("|", "client_id", "task_type"))
    quotas = actions.type_quotas(df, cap=cap)
    seats = {(r.manager_id, r.task_type): r.seats for r in quotas.collect()}
    known = spark.createDataFrame(existing, "manager_id int, client_id long, task_type string, status string").withColumn("task_key", F.concat_ws("|", "client_id", "task_type"))
    # Another manager's mute of the same pair counts for nothing.
    mutes = [(m, c_, t) for c_, t in muted for m in (c_ // 100, 9)] + [(9, c_, t) for _, c_, t, *_ in tasks]
    got = actions.admit(df, quotas, known, spark.createDataFrame(sorted(set(mutes)), "manager_id int, client_id long, task_type string"), cap, 2, reserve).collect()
    want = {}
    for m in (1, 2):
        want |= brute_admission([x for x in tasks if x[0] == m], {t: n for (k, t), n in seats.items() if k == m}, [x for x in existing if x[0] == m], muted, cap, 2, reserve)
    assert {(r.client_id, r.task_type): r.via for r in got} == want and "reserve" in want.values()


def test_pace_and_feedback(spark):
    tasks = spark.createDataFrame([(1, 10, "reorder_due", 80.0, 100.0), (1, 11, "debt_followup", 80.0, 100.0), (1, 12, "churn_winback", 80.0, 100.0), (2, 13, "cross_sell", 90.0, 100.0)], "manager_id int, client_id long, task_type string, priority double, ev_score double")
    pace = spark.createDataFrame([(1, 0.4, 0.0), (2, 3.0, 0.0)], "manager_id int, shipped_behind double, paid_behind double")
    turned = spark.createDataFrame([(11, "debt_followup", 2), (12, "churn_winback", 9)], "client_id long, task_type string, n long")
    got = {r.client_id: (r.priority, r.ev_score) for r in actions.adjusted(tasks, pace, turned).collect()}
    assert got == {10: (88.0, 110.0), 11: (56.0, 70.0), 12: (40.0, 50.0), 13: (100.0, 125.0)}


def test_ranking_backfill_keeps_what_is_set(spark):
    names = "task_type string, priority double, p_outcome double, expected_value double, ev_score double, monetary double, order_count long, overdue_amount double"
    rows = [("debt_followup", 40.0, None, None, None, 1.0, 1, 250.0), ("reorder_due", 0.0, None, None, None, 90.0, 0, None), ("churn_winback", 50.0, 0.2, 10.0, 7.0, 1.0, 1, None), ("cross_sell", 50.0, None, None, None, 90.0, 3, None)]
    got = [(r.p_outcome, r.expected_value, r.ev_score) for r in actions.ranking_backfill(spark.createDataFrame(rows, names)).collect()]
    assert got == [(0.4, 250.0, 100.0), (0.0, 0.0, 0.0), (0.2, 10.0, 7.0), (0.5, 30.0, 15.0)]


def test_live_rows_need_an_outcome(spark):
    names = "task_type string, status string, client_id long, outcome struct<sold:boolean>, signals map<string,double>, priority double"
    rows = [("reorder_due", "done", 1, (True,), {"elapsed_days": 9.0, "top_score": 1.0}, 30.0), ("reorder_due", "done", 2, (None,), {}, 1.0), ("debt_followup", "open", 3, (True,), {}, 1.0), ("other", "done", 4, (True,), {}, 1.0), ("churn_winback", "dismissed", 5, (False,), None, None)]
    got = {r.client_id: r for r in actions.live_rows(spark.createDataFrame(rows, names)).collect()}
    assert set(got) == {1, 5} and (got[1].label, got[1].sig_elapsed_days, got[1].sig_top_score, got[1].recency_days) == (1, 9.0, 0.0, 9999.0) and (got[5].label, got[5].old_priority) == (0, 0.0)


def test_own_cut_offs_see_no_later_purchase(spark):
    d = lambda n: dt.date(1999, 1, n)
    rows = [(1, "a", 1, d(1)), (1, "b", 2, d(2)), (1, "z", 3, d(9)), (2, "a", 4, d(1)), (2, "b", 5, d(3)), (2, "c", 6, d(5)), (3, "a", 7, d(2)), (3, "b", 8, d(2)), (3, "c", 9, d(4)), (3, "e", 10, d(20))]
    sales_ = spark.createDataFrame(rows, "client_id long, item string, order_id long, created date")
    cases = reco.last_basket_cases(sales_)
    assert {(r.client_id, r.order_id) for r in cases.collect()} == {(1, 3), (2, 6), (3, 10)}
    found = {(r.client_id, r.item): r.score for r in reco.discovery_at(sales_, cases, "item").collect()}
    assert found == {(1, "c"): pytest.approx(2 / 3)}
    own = {(r.client_id, r.item) for r in reco.repurchase_at(reco.history(sales_, cases), "item").collect()}
    assert (1, "z") not in own and (1, "a") in own and (3, "e") not in own


def test_quota_lists_limit_groups_and_sources(spark):
    own = spark.createDataFrame([(1, f"p{i}", 1.0 - i / 100) for i in range(8)], "client_id long, item string, score double")
    found = spark.createDataFrame([(1, f"q{i}", 1.0 - i / 100) for i in range(8)], "client_id long, item string, score double")
    grp = spark.createDataFrame([(f"p{i}", "g" if i < 5 else "h") for i in range(8)] + [(f"q{i}", "g") for i in range(8)], "item string, group_id string")
    got = [(r.item, r.source) for r in reco.quota_lists(own, found, grp, "item", top=8, repurchase=4).orderBy("rank").collect()]
    assert got == [("p0", "repurchase"), ("p1", "repurchase"), ("p2", "repurchase"), ("p5", "repurchase"), ("q0", "discovery"), ("q1", "discovery"), ("q2", "discovery")]


def test_backfill_takes_co_purchases_then_popular_items(spark):
    lists = spark.createDataFrame([(1, 10, "repurchase", 1), (1, 11, "discovery", 2)], "client_id long, product_id long, source string, rank int")
    clients = spark.createDataFrame([(1,), (2,), (1,)], "client_id long")
    co = spark.createDataFrame([(1, 12, 0.1), (1, 10, 0.9), (1, 13, 0.1)], "client_id long, product_id long, score double")
    lines = spark.createDataFrame([(10,)] * 5 + [(20,)] * 4 + [(12,)] * 3 + [(30,), (29,)], "product_id long")
    got = lambda top: {c: [r.product_id for r in sorted(rows, key=lambda r: r["rank"])] for c, rows in itertools.groupby(sorted(reco.backfilled(lists, clients, co, lines, "product_id", top).collect(), key=lambda r: r.client_id), key=lambda r: r.client_id)}
    assert got(6) == {1: [10, 11, 12, 13, 20, 29], 2: [10, 20, 12, 29, 30]}
    assert got(3) == {1: [10, 11, 12], 2: [10, 20, 12]} and got(2)[1] == [10, 11]
    assert reco.backfilled(lists.limit(0), clients, co.limit(0), lines.limit(0), "product_id").count() == 0


def test_future_margin_needs_a_cost(spark):
    snap = spark.createDataFrame([(1, 2.0), (2, None), (3, 1.0)], "product_id long, unit_cost double")
    sold = spark.createDataFrame([(1, 10, 50.0), (2, 5, 20.0)], "product_id long, qty int, amount double")
    back = spark.createDataFrame([(1, 1, 1, 2, 12.0), (1, 1, 1, 2, 12.0)], "return_id long, line_no int, product_id long, qty int, amount double")
    got = {r.product_id: (r.future_units, r.future_revenue_eur, r.future_returned_units, r.future_margin_eur) for r in assortment.future_outcomes(snap, sold, back).collect()}
    assert got == {1: (10.0, 50.0, 2.0, 22.0), 2: (5.0, 20.0, 0.0, None), 3: (0.0, 0.0, 0.0, 0.0)}


def test_forward_score_without_debt(spark):
    card = {"intercept": 0.0, "features": {"n": {"splits": [1.0], "woe": [-3.0, 3.0], "coef": 1.0}}}
    df = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 5.0), (3, 10.0, 0.0)], "client_id long, total_debt double, n double")
    got = {r.client_id: (r.score, r.band, r.already_rolling) for r in risk.forward_score(df, card, card, {"medium": 0.1, "high": 0.5, "very_high": 0.9}).collect()}
    assert got == {1: (0.0, "none", False), 2: (95.3, "very_high", True), 3: (4.7, "low", False)}


def test_classes_tell_shares_that_six_places_do_not(spark):
    """sums of decimals divide as doubles; rounded to six places, a share a hair over or under a border falls on it."""
    over = spark.createDataFrame([(1, "8000003.00"), (2, "1999997.00")], "product_id long, v string").withColumn("v", F.col("v").cast("decimal(18,2)"))
    assert {r.product_id: r.abc for r in ranking.abc_inclusive(over, "v", "product_id").collect()} == {1: "B", 2: "C"}
    under = spark.createDataFrame([(1, "7999997.00"), (2, "2000003.00")], "product_id long, v string").withColumn("v", F.col("v").cast("decimal(18,2)"))
    assert {r.product_id: r.abc for r in ranking.abc_exclusive(under, "v", "product_id").collect()} == {1: "A", 2: "A"}
