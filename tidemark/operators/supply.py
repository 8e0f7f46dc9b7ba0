"""Lead times, supplier costs, reorder policy and purchase plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import computed_once, inv_norm_cdf
from tidemark.operators.asof import first_at
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.operators.ranking import bucket_of, range_cuts
from tidemark.sources.sinks import checkpointed

#: Lead time in days by the agreement's currency (domestic, PLN, EUR, USD), and otherwise.
LEAD_BY_CURRENCY = {3: 7.0, 2: 14.0, 0: 18.0, 1: 35.0}
LEAD_DEFAULT, LEAD_CV = 30.0, 0.5
FACTOR_MIN, FACTOR_MAX, FACTOR_LEAST = 0.5, 1.5, 5
FLOORS = {"A": 0.95, "B": 0.85}
SL_MIN, SL_MAX, HOLDING, LEAST_MARGIN = 0.50, 0.99, 0.25, 0.1
URGENCY_ORDER = {"critical": 0, "high": 1, "normal": 2, "none": 3}
URGENCY_WEIGHT = {"critical": 1.0, "high": 0.7, "normal": 0.4, "none": 0.1}


def lead_times(ordered: DataFrame, low: int = 1, high: int = 120, least: int = 3) -> DataFrame:
    """Per producer: mean and deviation of lead times in [low, high] days, else by the modal currency, else the default."""
    days = F.datediff("arrived", "event_date")
    seen = ordered.where(days.between(low, high)).groupBy("producer_id").agg(F.avg(days).alias("m"), F.stddev_pop(days).alias("s"), F.count(F.lit(1)).alias("k"))
    modal = modal_currency(ordered)
    by_currency = F.lit(None).cast("double")
    for c, v in LEAD_BY_CURRENCY.items():
        by_currency = F.when(F.col("currency_id") == c, v).otherwise(by_currency)
    enough = F.coalesce(F.col("k") >= least, F.lit(False))
    mean = F.when(enough, F.col("m")).otherwise(F.coalesce(by_currency, F.lit(LEAD_DEFAULT)))
    df = modal.join(seen, "producer_id", "left").withColumn("lead_days", mean)
    std = F.when(enough, F.greatest(F.col("s"), 0.1 * F.col("lead_days"))).otherwise(LEAD_CV * F.col("lead_days"))
    return df.select("producer_id", "lead_days", std.alias("lead_std"), F.when(enough, "empirical").when(by_currency.isNotNull(), "geo").otherwise("default").alias("lead_source"))


def modal_currency(ordered: DataFrame) -> DataFrame:
    """The commonest currency per producer, ties to the smallest id."""
    counts = ordered.groupBy("producer_id", "currency_id").count()
    return counts.groupBy("producer_id").agg(F.max_by("currency_id", F.struct("count", -F.col("currency_id"))).alias("currency_id"))


def supplier_costs(ordered_eur: DataFrame) -> DataFrame:
    """Median unit price in EUR by producer and product."""
    lines = checkpointed(ordered_eur.select("producer_id", "product_id", "price_eur"))
    return grouped_quantiles(lines, ["producer_id", "product_id"], "price_eur", [0.5]).select("producer_id", "product_id", F.col("q")[0].alias("cost_eur"))


def cheapest_alternative(costs: DataFrame, gain: float = 0.98) -> DataFrame:
    """Another producer whose cost is below gain times the own one: the cheapest such, ties by id."""
    w = Window.partitionBy("product_id").orderBy("cost_eur", "producer_id")
    two = costs.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("cost_eur", "producer_id"))).alias("t"))
    df = costs.join(two, "product_id")
    alt = F.when(F.col("t")[0]["producer_id"] != F.col("producer_id"), F.col("t")[0]).otherwise(F.try_element_at("t", F.lit(2)))
    return df.withColumn("alt", alt).where(F.col("alt.cost_eur") < F.col("cost_eur") * gain).select("producer_id", "product_id", "cost_eur", F.col("alt.producer_id").alias("alt_producer_id"), F.col("alt.cost_eur").alias("alt_cost_eur"))


def service_level(sale: Column, cost: Column, abc: Column, horizon: int) -> Column:
    floor = F.when(abc == "A", FLOORS["A"]).when(abc == "B", FLOORS["B"]).otherwise(SL_MIN)
    margin = sale - cost
    economic = F.least(F.greatest(margin / (margin + HOLDING / 365.0 * cost * horizon), floor), F.lit(SL_MAX))
    known = (cost > 0) & sale.isNotNull()
    return F.when(~F.coalesce(known, F.lit(False)), floor).when(margin < LEAST_MARGIN, F.least(floor, F.lit(SL_MAX))).otherwise(economic)


def urgency(position: Column, safety: Column, reorder: Column, upto: Column) -> Column:
    return F.when(position <= F.greatest(safety, F.lit(0.0)), "critical").when(position <= reorder, "high").when(position <= upto, "normal").otherwise("none")


def round_order(qty: Column, moq: Column, multiple: Column) -> Column:
    """At least the minimum quantity, then up to a whole multiple; nothing stays nothing."""
    q = F.greatest(qty, F.coalesce(moq, F.lit(0.0)))
    return F.when(qty <= 0, 0.0).when(multiple > 1, F.ceil(q / multiple) * multiple).otherwise(q)


def inventory_position(on_hand: DataFrame, reserved: DataFrame, on_order: DataFrame) -> DataFrame:
    """(product_id, on_hand, reserved, on_order, position) of every product in any of the three; what is missing is 0."""
    df = on_hand.join(reserved, "product_id", "full_outer").join(on_order, "product_id", "full_outer").fillna(0.0, ["on_hand", "reserved", "on_order"])
    return df.select("product_id", "on_hand", "reserved", "on_order", (F.col("on_hand") - F.col("reserved") + F.col("on_order")).alias("position"))


def ledger(movements: DataFrame, keys: list[str]) -> DataFrame:
    """Balances as validity intervals (keys, since, until, qty, value) of signed movements (keys, day, qty, value).

    A balance holds from its day up to the next day with a movement, which until excludes; the last one's is null. Movements
    without a day or key are left out. Decimals sum exactly. A key's rows are as many as days.
    """
    daily = movements.dropna(subset=[*keys, "day"]).groupBy(*keys, "day").agg(F.sum("qty").alias("qty"), F.sum("value").alias("value"))
    order = Window.partitionBy(*keys).orderBy("day")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(*keys, F.col("day").alias("since"), F.lead("day").over(order).alias("until"), *[F.sum(c).over(upto).alias(c) for c in ("qty", "value")])


def balances_at(book: DataFrame, keys: list[str], dates: list[str]) -> DataFrame:
    """(keys, as_of, qty, value) at each of the ascending dates, from intervals; balances of nothing are left out. An interval is
    looked up by its ends, so the dates cost no join."""
    first, last = first_at(F.col("since"), dates), first_at(F.col("until"), dates)
    held = book.where("qty <> 0 or value <> 0").withColumns({"_a": first, "_b": last}).where("_a < _b")
    names = F.array(*[F.lit(d) for d in dates])
    return held.withColumn("_i", F.explode(F.sequence("_a", F.col("_b") - 1))).select(*keys, F.get(names, F.col("_i")).cast("date").alias("as_of"), "qty", "value")


def learned_factors(feedback: DataFrame, least: int = FACTOR_LEAST, stored: bool = False) -> DataFrame:
    """(producer_id, abc, factor, n): the median of final over suggested quantity, clamped, from `least` changes on. Feedback that is
    stored, as a table is, is not written again."""
    feedback = feedback.select("producer_id", "abc", "ratio")
    feedback = feedback if stored else checkpointed(feedback)
    agg = grouped_quantiles(feedback, ["producer_id", "abc"], "ratio", [0.5], more=(F.count(F.lit(1)).alias("n"),)).withColumn("m", F.col("q")[0]).where(F.col("n") >= least)
    return agg.select("producer_id", "abc", F.round(F.least(F.greatest("m", F.lit(FACTOR_MIN)), F.lit(FACTOR_MAX)) + 1e-9, 4).alias("factor"), "n")


def purchase_plan(items: DataFrame, horizon: int = 30) -> DataFrame:
    """items (producer_id, product_id, mean_daily, std_daily, lead_days, lead_std, position, abc, cost, sale, moq, multiple,
    factor) with reorder point, safety stock, cover, urgency, the policy's own quantity (raw_qty) and the suggested one:
    scaled by the learned factor, then rounded to the terms. One pass, no loop over producers; null terms or factor do nothing."""
    df = computed_once(items, sl=service_level(F.col("sale"), F.col("cost"), F.col("abc"), horizon))
    spread = F.sqrt(F.col("lead_days") * F.col("std_daily") ** 2 + F.col("mean_daily") ** 2 * F.col("lead_std") ** 2)
    df = computed_once(df, safety_stock=inv_norm_cdf(F.col("sl")) * spread)
    df = df.withColumn("reorder_point", F.col("mean_daily") * F.col("lead_days") + F.col("safety_stock")).withColumn("order_upto", F.col("reorder_point") + F.col("mean_daily") * horizon)
    need = F.when(F.col("position") <= F.col("reorder_point"), F.greatest(F.lit(0.0), F.col("order_upto") - F.col("position"))).otherwise(0.0)
    cover = F.when(F.col("mean_daily") > 0, F.greatest(F.lit(0.0), F.col("position") / F.col("mean_daily"))).otherwise(99999.0)
    df = df.withColumns({"urgency": urgency(F.col("position"), F.col("safety_stock"), F.col("reorder_point"), F.col("order_upto")), "days_of_cover": cover, "raw_qty": F.round(need + 1e-9, 2)})
    scaled = F.round(F.col("raw_qty") * F.coalesce("factor", F.lit(1.0)) + 1e-9, 2)
    return df.withColumn("suggested_qty", F.round(round_order(scaled, F.col("moq"), F.col("multiple")), 2))


def plan_backtest(plan: DataFrame, demand: DataFrame, window: int, overstock_factor: float = 3.0, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each `by`: how a plan (position, suggested_qty, urgency, cost, sale) meets the demand (product_id, need) of the window.

    Rates of service are means over items with demand; excess units and the economic cost (lost margin of what falls
    short, holding of what is left over) take all items.
    """
    df = plan.join(demand, "product_id", "left").withColumn("need", F.coalesce("need", F.lit(0.0)))
    have, need, position = F.col("position") + F.col("suggested_qty"), F.col("need"), F.col("position")
    df = df.withColumns({"have": have, "excess": F.greatest(F.lit(0.0), have - need), "short": F.greatest(F.lit(0.0), need - have)})
    wanted = need > 0

    def share(test: Column) -> Column:
        return F.round(F.coalesce(F.avg(F.when(wanted, test.cast("double"))), F.lit(0.0)) + 1e-9, 3)

    loss = F.sum(F.coalesce(F.col("short") * F.greatest(F.lit(0.0), F.col("sale") - F.col("cost")), F.lit(0.0)))
    hold = F.sum(F.coalesce(F.col("excess") * (HOLDING / 365.0) * window * F.col("cost"), F.lit(0.0)))
    demanded = F.sum("need")
    return df.groupBy(*by).agg(
        F.sum(wanted.cast("long")).alias("products"),
        F.count(F.lit(1)).alias("total_items"),
        F.sum((F.col("urgency") == "critical").cast("long")).alias("critical_items"),
        F.round(F.avg((F.col("urgency") == "critical").cast("double")) + 1e-9, 4).alias("critical_share"),
        F.round(F.coalesce(F.avg(F.when(wanted, F.least("have", "need") / need)), F.lit(0.0)) + 1e-9, 3).alias("fill_rate"),
        share(F.col("have") < need).alias("stockout_rate"),
        share(F.col("have") >= need).alias("coverage_with_policy"),
        share(position >= need).alias("coverage_without_policy"),
        F.round(F.sum("excess"), 2).alias("overstock_units"),
        F.round(F.sum("excess") / F.count(F.lit(1)) + 1e-9, 3).alias("overstock_units_per_product"),
        F.when(demanded > 0, F.round(F.sum("excess") / demanded + 1e-9, 3)).otherwise(0.0).alias("overstock_units_per_demand"),
        demanded.alias("demand_units"),
        F.round(F.avg((F.col("suggested_qty") > need * overstock_factor).cast("double")) + 1e-9, 3).alias("overstock_rate"),
        F.round(loss, 2).alias("understock_loss"),
        F.round(hold, 2).alias("overstock_hold"),
        F.round(loss + hold, 2).alias("economic_cost"),
    )


def sweep_summary(pairs: DataFrame) -> DataFrame:
    """One row over backtests of (producer, date) pairs: rates weighted by products with demand; pairs without such products
    are skipped and counted."""
    met = F.col("products") > 0

    def total(name: str) -> Column:
        return F.sum(F.when(met, F.col(name)))

    def per(amount: Column, of: Column) -> Column:
        return F.round(amount / of + 1e-9, 4)

    products = F.sum("products")
    return pairs.agg(
        F.count(F.when(met, 1)).alias("n_pairs"),
        F.count(F.when(~met, 1)).alias("n_skipped"),
        products.alias("products"),
        total("total_items").alias("total_items"),
        total("critical_items").alias("critical_items"),
        per(total("critical_items"), total("total_items")).alias("critical_share"),
        per(F.sum(F.col("fill_rate") * F.col("products")), products).alias("fill_rate"),
        per(F.sum(F.col("stockout_rate") * F.col("products")), products).alias("stockout_rate"),
        F.round(total("overstock_units"), 2).alias("overstock_units_total"),
        per(total("overstock_units"), products).alias("overstock_units_per_product"),
        per(total("overstock_units"), total("demand_units")).alias("overstock_units_per_demand"),
        *[F.round(total(name), 2).alias(name) for name in ("understock_loss", "overstock_hold", "economic_cost")],
        per(total("economic_cost"), products).alias("economic_cost_per_product"),
    )


def sweep_gate(summary: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(name, actual, limit, holds) of a sweep's row for each limit; names begin with min or max."""
    columns = {"max_economic_cost_eur_per_product": "economic_cost_per_product"}
    checks = []
    for name, limit in limits.items():
        actual = F.col(columns.get(name, name[4:])).cast("double")
        checks.append(F.struct(F.lit(name).alias("name"), actual.alias("actual"), F.lit(limit).alias("limit"), (actual >= limit if name.startswith("min") else actual <= limit).alias("holds")))
    return summary.select(F.explode(F.array(*checks)).alias("x")).select("x.*")


def value_density(plan: DataFrame) -> DataFrame:
    weight = F.lit(0.1)
    for name, w in URGENCY_WEIGHT.items():
        weight = F.when(F.col("urgency") == name, w).otherwise(weight)
    risk = F.greatest(F.col("sale") - F.col("cost"), F.lit(0.0)) * F.col("suggested_qty") * weight
    df = plan.withColumn("profit_at_risk", F.coalesce(risk, F.lit(0.0))).withColumn("line_cost", F.round(F.col("cost") * F.col("suggested_qty"), 2))
    return df.withColumn("density", F.when(F.col("line_cost") > 0, F.round(F.col("profit_at_risk") / F.col("line_cost"), 4)).otherwise(0.0))


def select_within_budget(items: DataFrame, budget: float, most_rounds: int | None = None) -> DataFrame:
    """Items by falling density, each taken if it still fits, as (item_id, line_cost): exact in rounds.

    A round takes the prefix that fits, then drops every item dearer than what is left; those can never fit, as what is
    left only shrinks. Each round takes at least one item or ends. With most_rounds, more rounds are an error.
    """
    left = budget
    rest = items.where("line_cost > 0").select("item_id", "density", F.col("line_cost").cast("decimal(18,2)").alias("line_cost"))
    chosen = rest.limit(0).select("item_id", "line_cost")
    rounds = 0
    while True:
        rest = checkpointed(rest.where(F.col("line_cost") <= F.lit(left).cast("decimal(18,2)")))
        run = checkpointed(_running_cost(rest))
        take = run.where(F.col("upto") <= F.lit(left).cast("decimal(18,2)"))
        got = take.agg(F.count(F.lit(1)), F.sum("line_cost")).first()
        if not got[0]:
            break
        rounds += 1
        if most_rounds is not None and rounds > most_rounds:
            raise RuntimeError(f"budget selection needs more than {most_rounds} rounds")
        chosen = chosen.union(take.select("item_id", "line_cost"))
        left = round(left - float(got[1]), 2)
        rest = run.join(take.select("item_id"), "item_id", "left_anti").select("item_id", "density", "line_cost")
    return chosen


def _running_cost(items: DataFrame) -> DataFrame:
    """Adds upto, the running cost in the order of falling density and item id, through range buckets of the density."""
    cuts = range_cuts(items, F.col("density").cast("double"))
    keyed = items.withColumn("_b", -bucket_of(F.col("density"), cuts))
    before = keyed.groupBy("_b").agg(F.sum("line_cost").alias("_t")).select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
    inside = Window.partitionBy("_b").orderBy(F.col("density").desc(), "item_id").rowsBetween(Window.unboundedPreceding, 0)
    return keyed.join(F.broadcast(before), "_b").withColumn("upto", F.sum("line_cost").over(inside) + F.col("_before")).drop("_b", "_before")
