"""Monthly series, demand classes, forecasts and their rolling-origin accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import croston, ewma, half_open, holt_path, mean_of

METHODS = ("moving_avg", "croston", "sba", "ewma", "damped_trend")
ALPHA, CROSTON_ALPHA = 0.3, 0.1
ADI_CUT, CV2_CUT = 1.32, 0.49


def month_grid(as_of: str, months: int) -> list[str]:
    """The last `months` month labels, oldest first, ending with the month of as_of."""
    y, m = int(as_of[:4]), int(as_of[5:7])
    at = [y * 12 + m - 1 - k for k in range(months - 1, -1, -1)]
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in at]


def future_months(as_of: str, horizon: int) -> list[str]:
    """The labels of the `horizon` months after the month of as_of."""
    y, m = int(as_of[:4]), int(as_of[5:7])
    return [f"{k // 12:04d}-{k % 12 + 1:02d}" for k in range(y * 12 + m, y * 12 + m + horizon)]


def densify(sales: DataFrame, key: str, measure: str, as_of: str, months: int, until: str | None = None) -> DataFrame:
    """(key, series): zero-filled values of the month grid, oldest first, from sales before as_of (or until). One shuffle by
    key; no row per missing month. The days are cut before anything else, so that the scan can skip the rest of the history."""
    first = month_grid(as_of, months)[0]
    lines = sales.where(half_open(F.col("created"), f"{first}-01", until or as_of))
    nth = (F.year("created") - int(first[:4])) * 12 + F.month("created") - int(first[5:7])
    by_month = lines.select(key, nth.alias("nth"), measure).groupBy(key).agg(*[F.sum(F.when(F.col("nth") == i, F.col(measure))).cast("double").alias(f"m{i}") for i in range(months)])
    return by_month.select(key, F.array(*[F.coalesce(f"m{i}", F.lit(0.0)) for i in range(months)]).alias("series"))


def active_span(series: Column) -> Column:
    """The series from its first positive month on."""
    first = F.aggregate(series, F.struct(F.lit(0).alias("i"), F.lit(0).alias("at")), lambda a, x: F.struct((a["i"] + 1).alias("i"), F.when((a["at"] == 0) & (x > 0), a["i"] + 1).otherwise(a["at"]).alias("at")), lambda a: a["at"])
    return F.when(first > 0, F.slice(series, first, F.size(series) - first + 1)).otherwise(F.slice(series, 1, 0))


def with_demand_class(df: DataFrame) -> DataFrame:
    """Adds adi, cv2 and segment. adi is null without demand."""
    sizes = F.filter("series", lambda x: x > 0)
    df = df.withColumn("_sizes", sizes).withColumn("_n", F.size("_sizes")).withColumn("adi", F.size(active_span(F.col("series"))) / F.nullif(F.col("_n"), F.lit(0)))
    df = df.withColumn("_mean", mean_of(F.col("_sizes")))
    var = F.aggregate("_sizes", F.lit(0.0), lambda a, x: a + x * x) / F.col("_n") - F.col("_mean") * F.col("_mean")
    df = df.withColumn("cv2", F.when(F.col("_n") < 2, 0.0).otherwise(F.greatest(var, F.lit(0.0)) / (F.col("_mean") * F.col("_mean"))))
    rare, rough = F.col("adi") >= ADI_CUT, F.col("cv2") >= CV2_CUT
    segment = F.when(F.col("_n") == 0, "no_demand").when(~rare & ~rough, "smooth").when(~rare, "erratic").when(~rough, "intermittent").otherwise("lumpy")
    return df.withColumn("segment", segment).drop("_sizes", "_mean").withColumnRenamed("_n", "n_events")


def method_for(segment: Column) -> Column:
    return F.when(segment == "smooth", "ewma").when(segment.isin("intermittent", "lumpy"), "sba").otherwise("moving_avg")


def path_of(series: Column, method: str, horizon: int) -> Column:
    if method == "damped_trend":
        return holt_path(series, horizon)
    rate = {"moving_avg": mean_of(series), "croston": croston(series, CROSTON_ALPHA, False), "sba": croston(series, CROSTON_ALPHA, True), "ewma": ewma(series, ALPHA)}[method]
    return F.array_repeat(rate, horizon)


def forecast(series: DataFrame, key: str, horizon: int, least_months: int = 3, forced: str | None = None) -> DataFrame:
    """(key, segment, method, step, amount): thin series give no rows; the method follows the segment unless forced."""
    df = with_demand_class(series).where(F.col("n_events") >= least_months)
    method = F.lit(forced) if forced else method_for(F.col("segment"))
    df = df.withColumn("method", method)
    path = F.when(F.col("method") == METHODS[0], path_of(F.col("series"), METHODS[0], horizon))
    for m in METHODS[1:]:
        path = path.when(F.col("method") == m, path_of(F.col("series"), m, horizon))
    return df.select(key, "segment", "method", F.posexplode(path).alias("step", "amount")).withColumn("step", F.col("step") + 1)


def backtest(series: DataFrame, key: str, horizon: int = 3, origins: int = 6, least_train: int = 6, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(key, segment, origin, method, step, forecast, actual) of methods for the last origins; each sees only its own past."""
    df = with_demand_class(series)
    size = F.size("series")
    first, last = F.greatest(F.lit(least_train - 1), size - 1 - origins), size - 2
    df = df.where(last >= first).select(key, "segment", "series", F.explode(F.sequence(first, last)).alias("origin"))
    df = df.select(key, "segment", "origin", F.slice("series", F.lit(1), F.col("origin") + 1).alias("train"), F.slice("series", F.col("origin") + 2, F.lit(horizon)).alias("actuals"))
    paths = F.array(*[F.struct(F.lit(m).alias("method"), path_of(F.col("train"), m, horizon).alias("path")) for m in methods])
    df = df.select(key, "segment", "origin", "actuals", F.explode(paths).alias("p"))
    df = df.select(key, "segment", "origin", F.col("p.method").alias("method"), F.posexplode(F.zip_with("actuals", F.slice("p.path", F.lit(1), F.size("actuals")), lambda a, f: F.struct(a.alias("actual"), f.alias("forecast")))).alias("step", "x"))
    return df.select(key, "segment", "origin", "method", (F.col("step") + 1).alias("step"), "x.forecast", "x.actual")


def accuracy(tested: DataFrame, keys: list[str]) -> DataFrame:
    """n, MAE, sMAPE and bias by keys."""
    err = F.col("forecast") - F.col("actual")
    half = (F.abs("forecast") + F.abs("actual")) / 2
    return tested.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(err)).alias("mae"), F.avg(F.when(half == 0, 0.0).otherwise(F.abs(err) / half)).alias("smape"), F.avg(err).alias("bias"))


def best_method(scores: DataFrame) -> DataFrame:
    """The method of the lowest MAE per segment, ties by name."""
    return scores.groupBy("segment").agg(F.min_by("method", F.struct("mae", "method")).alias("method"))


def interval_cv(series: Column) -> Column:
    """Deviation over mean of the gaps between months with demand; null with fewer than two such months."""
    months = F.filter(F.transform(series, lambda x, i: F.when(x > 0, i)), lambda i: i.isNotNull())
    n = F.size(months)
    gaps = F.zip_with(F.slice(months, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(months, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: (b - a).cast("double"))
    mean = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x) / (n - 1)
    square = F.aggregate(gaps, F.lit(0.0), lambda a, x: a + x * x) / (n - 1)
    return F.when(n < 2, F.lit(None).cast("double")).otherwise(F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))) / mean)


def xyz(cv: Column, x: float, y: float) -> Column:
    return F.when(cv < x, "X").when(cv < y, "Y").otherwise("Z")


def lifecycle(series: Column, sold_in_dead_window: Column, trend: int = 6, new_days: int = 90, growing: float = 1.2, declining: float = 0.5, dormant: int = 9) -> Column:
    """dead, new, growing, declining or mature from the recent and prior halves and the time since the last sale."""
    n = F.size(series)

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0.0), lambda a, v: a + v)

    recent = total(F.slice(series, n - trend + 1, F.lit(trend)))
    prior = total(F.slice(series, n - 2 * trend + 1, F.lit(trend)))
    months = F.filter(F.transform(series, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    since_first = (n - 1 - F.try_element_at(months, F.lit(1))) * 30 + 15
    since_last = n - 1 - F.try_element_at(months, F.lit(-1))
    return (
        F.when(~sold_in_dead_window, "dead")
        .when(since_first <= new_days, "new")
        .when((recent <= 0) & (F.coalesce(since_last, F.lit(dormant)) >= dormant), "declining")
        .when(recent <= 0, "mature")
        .when((prior <= 0) | (recent >= prior * growing), "growing")
        .when(recent <= prior * declining, "declining")
        .otherwise("mature")
    )


def seasonal_index(sales: DataFrame, key: str, month: int, k: float = 4.0, low: float = 0.6, high: float = 1.6, least_months: int = 12) -> DataFrame:
    """Demand of a calendar month against the mean month, drawn toward 1 by k months and clamped; 1 for thin histories."""
    monthly = sales.groupBy(key, F.trunc("created", "month").alias("m")).agg(F.sum("qty").cast("double").alias("units"))
    own = F.month("m") == month
    agg = monthly.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg("units").alias("mean"), F.sum(own.cast("long")).alias("obs"), F.avg(F.when(own, F.col("units"))).alias("month_mean"))
    shrunk = (F.col("obs") * (F.col("month_mean") / F.col("mean")) + k) / (F.col("obs") + k)
    return agg.select(key, F.when((F.col("n") < least_months) | (F.col("mean") <= 0) | (F.col("obs") == 0), 1.0).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), shrunk))).alias("season"))


def run_rate(monthly: DataFrame, key: str, value: str, current: str, n: int = 3) -> DataFrame:
    """Mean of the n latest completed months of each key."""
    last = monthly.where(F.col("ym") < current).groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("ym", value)), asc=False), 1, n).alias("x"))
    return last.select(key, (F.aggregate("x", F.lit(0.0), lambda a, r: a + r[value]) / F.size("x")).alias("target"))


def pace(monthly: DataFrame, key: str, value: str, to_date: DataFrame, month: str, elapsed: Column, whole: Column, n: int = 3) -> DataFrame:
    """Target (mean of the n latest completed months) against what is reached so far (key, mtd): expected to date, gap
    (positive is behind), needed a working day from now on, attainment in percent and status."""
    df = run_rate(monthly, key, value, month, n).join(to_date, key, "left").withColumn("mtd", F.coalesce("mtd", F.lit(0.0)))
    expected, t, mtd = F.col("target") / whole * elapsed, F.col("target"), F.col("mtd")
    rest = F.greatest(t - mtd, F.lit(0.0))
    ratio = mtd / expected
    status = F.when(t <= 0, "no_target").when(expected <= 0, "on").when(ratio >= 1.05, "ahead").when(ratio < 0.95, "behind").otherwise("on")
    return df.select(
        key, F.round("target", 2).alias("target"), F.round("mtd", 2).alias("mtd"), F.round(expected, 2).alias("expected"), F.round(expected - mtd, 2).alias("gap"),
        F.round(F.when(whole > elapsed, rest / (whole - elapsed)).otherwise(rest), 2).alias("today_needed"), F.round(F.when(t > 0, 100.0 * mtd / t).otherwise(0.0), 1).alias("attainment"), status.alias("status"),
    )


def daily_croston(daily: DataFrame, window_days: int, alpha: float = 0.1, sba: bool = True) -> DataFrame:
    """(product_id, rate) from days with demand (product_id, created, u). The first interval looks back to what the window
    leaves before the first demand day; with fewer than two days the total is spread over the window."""
    events = daily.where("u > 0").groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("created", "u"))).alias("e"))
    first, last = F.element_at("e", 1), F.element_at("e", -1)
    look = F.greatest(F.least(F.lit(window_days), F.greatest(F.lit(window_days) - F.datediff(last["created"], first["created"]), F.lit(0))), F.lit(1)).cast("double")
    start = F.struct(first["u"].alias("z"), look.alias("p"), first["created"].alias("prev"))

    def fold(acc: Column, x: Column) -> Column:
        gap = F.greatest(F.datediff(x["created"], acc["prev"]), F.lit(1)).cast("double")
        return F.struct((acc["z"] + F.lit(alpha) * (x["u"] - acc["z"])).alias("z"), (acc["p"] + F.lit(alpha) * (gap - acc["p"])).alias("p"), x["created"].alias("prev"))

    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x["u"])
    smooth = F.aggregate(F.slice("e", F.lit(2), F.greatest(F.size("e") - 1, F.lit(0))), start, fold, lambda a: a["z"] / a["p"] * F.lit(1.0 - alpha / 2.0 if sba else 1.0))
    return events.select("product_id", F.when(F.size("e") < 2, total / window_days).otherwise(smooth).alias("rate"))
