"""Credit risk: currency conversion, debt features, labels, scorecards, drift and model metrics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import psi_term
from tidemark.operators import ranking
from tidemark.operators.quantiles import grouped_quantiles
from tidemark.operators.scorecard import woe_of
from tidemark.sources.sinks import checkpointed

#: Floor of a share and levels of drift; points, range and probability bands of a card.
PSI_FLOOR, PSI_WARN, PSI_ALERT = 1e-6, 0.10, 0.25
POINTS = {"pdo": 20.0, "offset": 600.0, "lo": 400.0, "hi": 800.0, "bands": {"A": 0.02, "B": 0.05, "C": 0.15}}


def to_eur(df: DataFrame, rates: DataFrame, amount: str, day: str | None, out: str, as_of: str | None = None) -> DataFrame:
    """Adds amount in EUR at the rate in force on the row's day, or on as_of; currencies without a rate are EUR.

    Validity intervals come from lead(); the rates table is small by nature (currencies times rate changes).
    """
    spans = rates.withColumn("_to", F.lead("valid_from").over(Window.partitionBy("currency_id").orderBy("valid_from"))).select(F.col("currency_id").alias("_c"), F.col("valid_from").alias("_from"), "_to", "rate")
    at = F.lit(as_of).cast("date") if as_of else F.col(day)
    on = (F.col("currency_id") == F.col("_c")) & (at >= F.col("_from")) & (F.col("_to").isNull() | (at < F.col("_to")))
    return df.join(F.broadcast(spans), on, "left").withColumn(out, F.col(amount).cast("double") * F.coalesce("rate", F.lit(1.0))).drop("_c", "_from", "_to", "rate")


def aged(debt_eur: DataFrame, terms: DataFrame, as_of: str) -> DataFrame:
    """Debt lines with od, the days past the client's grace."""
    return debt_eur.join(terms.select("client_id", "grace_days"), "client_id").withColumn("od", F.datediff(F.lit(as_of).cast("date"), "created") - F.col("grace_days"))


def debt_aging(lines: DataFrame) -> DataFrame:
    od, e = F.col("od"), F.col("eur")

    def part(test: Column, name: str) -> Column:
        return F.sum(F.when(test, e).otherwise(0.0)).alias(name)

    agg = lines.groupBy("client_id").agg(
        part(od > 180, "overdue_180plus"), part(od.between(91, 180), "overdue_91_180"), part(od.between(61, 90), "overdue_61_90"), part(od.between(31, 60), "overdue_31_60"), part(od.between(1, 30), "overdue_1_30"), part(od <= 0, "current_debt"),
        F.sum(e).alias("total_debt"), F.greatest(F.max(od), F.lit(0)).alias("max_overdue_days"), F.count(F.lit(1)).alias("n_lines"),
    )
    return agg.withColumn("pct_180plus", F.when(F.col("total_debt") > 0, F.col("overdue_180plus") / F.col("total_debt")).otherwise(0.0))


def debt_trajectory(debt_eur: DataFrame, as_of: str) -> DataFrame:
    t = F.lit(as_of).cast("date")
    c = F.col("created")
    new = F.sum(F.when(c > F.add_months(t, -3), F.col("eur")).otherwise(0.0))
    prior = F.sum(F.when((c > F.add_months(t, -6)) & (c <= F.add_months(t, -3)), F.col("eur")).otherwise(0.0))
    months = F.countDistinct(F.when(c > F.add_months(t, -12), F.date_format(c, "yyyy-MM")))
    agg = debt_eur.groupBy("client_id").agg(new.alias("new_3m"), prior.alias("prior_3m"), months.alias("months_12"))
    growth = F.when(F.col("prior_3m") > 0, F.least(F.col("new_3m") / F.col("prior_3m"), F.lit(10.0))).when(F.col("new_3m") > 0, 10.0).otherwise(0.0)
    return agg.withColumn("growth", growth)


def severe_label(lines: DataFrame, days: int = 180, least: float = 100.0) -> DataFrame:
    """1 where at least `least` EUR is more than days past grace."""
    bad = F.sum(F.when(F.col("od") >= days, F.col("eur")).otherwise(0.0))
    return lines.groupBy("client_id").agg((bad >= least).cast("int").alias("label"))


def apply_scorecard(df: DataFrame, card: dict) -> DataFrame:
    """Adds lin, contributions (by size), pd, score (0..100, higher is safer) and band from a card: features {name: {splits,
    woe, coef}}, intercept, a, b, pdo, offset, lo, hi, bands. Missing values take the first bin."""
    points = {name: F.lit(f["coef"]) * woe_of(F.col(name), f) for name, f in card["features"].items()}
    df = df.withColumns({f"_pt_{i}": v for i, v in enumerate(points.values())})
    lin = F.lit(card["intercept"])
    for i in range(len(points)):
        lin = lin + F.col(f"_pt_{i}")
    parts = F.array(*[F.struct(F.lit(name).alias("feature"), F.round(f"_pt_{i}", 4).alias("points")) for i, name in enumerate(points)])
    by_size = lambda x, y: F.when(F.abs(x["points"]) > F.abs(y["points"]), -1).when(F.abs(x["points"]) < F.abs(y["points"]), 1).when(x["feature"] < y["feature"], -1).otherwise(1)
    df = df.withColumns({"lin": lin, "contributions": F.array_sort(parts, by_size)}).drop(*[f"_pt_{i}" for i in range(len(points))])
    df = df.withColumn("pd", 1 / (1 + F.exp(-(F.lit(card["a"]) * F.col("lin") + F.lit(card["b"])))))
    p = F.least(F.greatest(F.col("pd"), F.lit(1e-6)), F.lit(1 - 1e-6))
    raw = F.lit(card["offset"]) + F.lit(card["pdo"] / math.log(2)) * F.log((1 - p) / p)
    score = F.least(F.greatest((raw - card["lo"]) / (card["hi"] - card["lo"]) * 100, F.lit(0.0)), F.lit(100.0))
    bands = card["bands"]
    band = F.when(F.col("pd") < bands["A"], "A").when(F.col("pd") < bands["B"], "B").when(F.col("pd") < bands["C"], "C").otherwise("D")
    return df.withColumns({"score": F.round(score, 2), "band": band})


def forward_score(df: DataFrame, behaviour: dict, aging: dict, cuts: dict) -> DataFrame:
    """Adds the forward view: score = 100 pd (higher is riskier), pd_behavioral, pd_with_aging, band by cuts and
    already_rolling (pd_with_aging of one half or more). Without debt all are 0 and the band is `none`."""
    none = F.coalesce(F.col("total_debt"), F.lit(0.0)) <= 0

    def pd(card: dict) -> Column:
        lin = F.lit(card["intercept"])
        for name, f in card["features"].items():
            lin = lin + F.lit(f["coef"]) * woe_of(F.coalesce(F.col(name).cast("double"), F.lit(0.0)), f)
        return F.when(none, 0.0).otherwise(1 / (1 + F.exp(-lin)))

    df = df.withColumns({"_b": pd(behaviour), "_a": pd(aging)})
    b = F.col("_b")
    band = F.when(none, "none").when(b >= cuts["very_high"], "very_high").when(b >= cuts["high"], "high").when(b >= cuts["medium"], "medium").otherwise("low")
    return df.withColumns({"score": F.round(100 * b, 1), "pd_behavioral": F.round(b, 4), "pd_with_aging": F.round("_a", 4), "band": band, "already_rolling": F.col("_a") >= 0.5}).drop("_a", "_b")


def discipline(counts: DataFrame) -> DataFrame:
    """(client_id, discipline): paid in full and half of the partly paid over all; refunds do not count. No order gives 1."""
    n = F.col("paid") + F.col("partial") + F.col("notpaid")
    return counts.select("client_id", F.when(n > 0, (F.col("paid") + 0.5 * F.col("partial")) / n).otherwise(1.0).alias("discipline"))


#: Fixed values of the five-factor score: weights, horizons and targets, load, bands.
WEIGHTS = {"discipline": 0.35, "debt_load": 0.25, "activity": 0.20, "tenure": 0.10, "return_quality": 0.10}
RECENCY_DAYS, ORDERS, MONTHS, HEALTHY_LOAD, LOAD_SPAN = 90.0, 24.0, 24.0, 0.25, 1.25
RATINGS = {"A": 80, "B": 65, "C": 45}


def five_factor_score(df: DataFrame) -> DataFrame:
    """The older score from discipline, overdue, turnover, orders, recency_days, tenure_months, return_rate, utilization, blocked."""

    def unit(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    ratio = F.col("overdue") / F.col("turnover")
    factors = {
        "discipline": unit(F.col("discipline")),
        "debt_load": F.when(F.col("turnover") > 0, unit(1 - F.greatest(F.lit(0.0), ratio - HEALTHY_LOAD) / LOAD_SPAN)).when(F.col("overdue") <= 0, 1.0).otherwise(0.0),
        "activity": 0.5 * F.coalesce(unit(1 - F.col("recency_days") / RECENCY_DAYS), F.lit(0.0)) + 0.5 * unit(F.col("orders") / ORDERS),
        "tenure": unit(F.col("tenure_months") / MONTHS),
        "return_quality": unit(1 - 2 * F.col("return_rate")),
    }
    raw = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        raw = raw + F.round(F.lit(100 * weight) * factors[name], 4)
    df = df.withColumn("_raw", raw)
    cap = F.when(F.col("utilization") > 1.0, F.least("_raw", F.lit(40.0))).when(F.col("utilization") > 0.9, F.least("_raw", F.lit(60.0))).otherwise(F.col("_raw"))
    score = F.bround(F.when(F.col("blocked"), cap * 0.5).otherwise(cap)).cast("int")
    s = F.col("score")
    return df.withColumn("score", score).withColumn("rating", F.when(s >= RATINGS["A"], "A").when(s >= RATINGS["B"], "B").when(s >= RATINGS["C"], "C").otherwise("D")).drop("_raw")


def binary_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """n, auc (ties count half), gini, ks and brier of score against label 0/1, from counts per distinct score."""
    counts = checkpointed(df.groupBy(F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("pos")))
    t = ranking._running_count(counts, "s", more={"pos": "pos_upto"}).withColumn("neg_upto", F.col("_upto") - F.col("pos_upto"))
    totals = counts.agg(F.sum("pos").alias("P"), (F.sum("_n") - F.sum("pos")).alias("N"))
    t = t.join(F.broadcast(totals))
    neg = F.col("_n") - F.col("pos")
    auc = F.sum(F.col("pos") * (F.col("neg_upto") - neg / 2)) / F.first(F.col("P") * F.col("N"))
    out = t.agg(F.sum("_n").alias("n"), auc.alias("auc"), F.max(F.abs(F.col("pos_upto") / F.col("P") - F.col("neg_upto") / F.col("N"))).alias("ks"), (F.sum(F.col("pos") * (1 - F.col("s")) ** 2 + neg * F.col("s") ** 2) / F.sum("_n")).alias("brier"))
    return out.withColumn("gini", 2 * F.col("auc") - 1)


def feature_auc(counts: DataFrame, keys: tuple[str, ...] = ("feature",)) -> DataFrame:
    """From counts (keys, v, n, p) of rows and positives per value: coverage, base_rate and the AUC in its better direction."""
    w = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("r", F.sum("n").over(w) - (F.col("n") - 1) / 2)
    agg = ranked.groupBy(*keys).agg(F.sum(F.col("p") * F.col("r")).alias("s"), F.sum("p").alias("P"), F.sum("n").alias("N"), F.sum(F.when(F.col("v") != 0, F.col("n")).otherwise(0)).alias("nz"))
    auc = (F.col("s") - F.col("P") * (F.col("P") + 1) / 2) / (F.col("P") * (F.col("N") - F.col("P")))
    return agg.select(*keys, (F.col("nz") / F.col("N")).alias("coverage"), F.greatest(auc, 1 - auc).alias("auc"), (F.col("P") / F.col("N")).alias("base_rate"), F.col("N").alias("n"))


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, n, mean_score, rate): equal bins of the score against the realised rate."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))


def psi(baseline: DataFrame, current: DataFrame, values: list[str], bins: int = 10) -> DataFrame:
    """(feature, psi, level) of each value column between two tables.

    Bins lie between the baseline's interpolated quantiles, open below and closed above; equal edges are one; nulls lie in the
    first bin. Shares are floored at PSI_FLOOR; a side without rows counts as even. Levels: `ok`, `warn` from 0.10, `alert`
    from 0.25. All features are one long table; the driver holds the edges alone.
    """

    def long(df: DataFrame) -> DataFrame:
        cells = [F.struct(F.lit(v).alias("feature"), F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double")).alias("v")) for v in values]
        return checkpointed(df.select(F.explode(F.array(*cells)).alias("x")).select("x.feature", "x.v"))

    was, now = long(baseline), long(current)
    edges: dict[str, list[float]] = {v: [] for v in values}
    for row in grouped_quantiles(was, ["feature"], "v", [i / bins for i in range(1, bins)]).collect():
        for e in row.q:
            if not edges[row.feature] or e > edges[row.feature][-1] + 1e-12:
                edges[row.feature].append(e)
    grid = was.sparkSession.createDataFrame([(v, b, len(edges[v]) + 1) for v in values for b in range(len(edges[v]) + 1)], "feature string, bin int, n_bins int")
    place = F.lit(0)
    for v in values:
        place = F.when(F.col("feature") == v, ranking.bucket_of(F.col("v"), edges[v])).otherwise(place)

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = checkpointed(df.groupBy("feature", place.alias("bin")).agg(F.count(F.lit(1)).alias("_n")))
        totals = counts.groupBy("feature").agg(F.sum("_n").alias("_t"))
        share = F.when(F.col("_t").isNull(), 1 / F.col("n_bins")).otherwise(F.coalesce(F.col("_n") / F.col("_t"), F.lit(0.0)))
        return grid.join(totals, "feature", "left").join(counts, ["feature", "bin"], "left").select("feature", "bin", share.alias(name))

    both = shares(was, "expected").join(shares(now, "actual"), ["feature", "bin"])
    total = both.groupBy("feature").agg(F.sum(psi_term(F.col("actual"), F.col("expected"), PSI_FLOOR)).alias("psi"))
    return total.withColumn("level", F.when(F.col("psi") >= PSI_ALERT, "alert").when(F.col("psi") >= PSI_WARN, "warn").otherwise("ok"))


def band_rates(scored: DataFrame, label: str = "label") -> DataFrame:
    """(band, n, rate, mean_score, min_score, max_score) of a scored table: the realised rate of each band."""
    s = F.col("score")
    return scored.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("rate"), F.avg(s).alias("mean_score"), F.min(s).alias("min_score"), F.max(s).alias("max_score"))
