"""Scorecards: quantile and monotone WOE bins, fits, calibration, folds and model tables.

Counts per bin come from Spark in one pass for all features; what runs on the driver are tables of a few bins.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import ranking
from tidemark.sources.sinks import checkpointed

WOE_CLIP, LEAST_SHARE, LEAST_ROWS, ZERO_SHARE = 4.0, 0.03, 20, 0.30
#: The points scale and the bands by probability of default.
SCALE = {"pdo": 20.0, "offset": 600.0, "lo": 400.0, "hi": 800.0}
BANDS = {"A": 0.02, "B": 0.05, "C": 0.15}
FORWARD_CUTS = {"medium": 0.50, "high": 0.80, "very_high": 0.95}


def exact_quantiles(df: DataFrame, value: str, probs: list[float]) -> list[float]:
    """Linearly interpolated quantiles of the non-null values, from a running count over distinct values: no task holds
    them all, and two rows for each quantile reach the driver. Empty input gives an empty list."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = ranking._running_count(counts, "v")
    total = counts.agg(F.sum("_n")).first()[0]
    if not total:
        return []
    spots = [p * (total - 1) for p in probs]
    need = sorted({int(x) for at in spots for x in (math.floor(at), math.ceil(at))})
    holds = F.exists(F.array(*[F.lit(r) for r in need]), lambda r: (F.col("_upto") > r) & (F.col("_upto") - F.col("_n") <= r))
    rows = ranked.where(holds).select("v", "_upto", "_n").collect()
    at = {r: x.v for r in need for x in rows if x["_upto"] - x["_n"] <= r < x["_upto"]}
    return [at[math.floor(s)] + (at[math.ceil(s)] - at[math.floor(s)]) * (s - math.floor(s)) for s in spots]


def quantile_woe(df: DataFrame, feature: str, label: str, bins: int = 5) -> DataFrame:
    """(bin, lo, hi, n, bad, woe, iv): bin 0 holds zeros, the others quantiles of the rest, open below and closed above.

    woe = ln(bad share / good share), half a case added to each count, totals floored at half a case.
    """
    cuts = sorted(set(exact_quantiles(df.where(F.col(feature) != 0), feature, [i / bins for i in range(1, bins)])))
    which = F.when(F.col(feature) == 0, 0).when(F.col(feature) > 0, 1 + ranking.bucket_of(F.col(feature), cuts))
    counts = df.withColumn("bin", which).groupBy("bin").agg(F.min(feature).alias("lo"), F.max(feature).alias("hi"), F.count(F.lit(1)).alias("n"), F.sum(label).alias("bad"))
    totals = counts.agg(F.greatest(F.sum("bad").cast("double"), F.lit(0.5)).alias("tb"), F.greatest((F.sum("n") - F.sum("bad")).cast("double"), F.lit(0.5)).alias("tg"))
    df = counts.where("bin is not null").join(F.broadcast(totals))
    bad, good = (F.col("bad") + 0.5) / F.col("tb"), (F.col("n") - F.col("bad") + 0.5) / F.col("tg")
    woe = F.log(bad / good)
    return df.select("bin", "lo", "hi", "n", "bad", woe.alias("woe"), ((bad - good) * woe).alias("iv"))


def _seeds(df: DataFrame, features: list[str], most: int) -> dict[str, list[float]]:
    """Interior cuts by approximate quantiles, all features in one pass; zeros apart where they are frequent."""
    whole, positive = [i / most for i in range(1, most)], [i / (most - 1) for i in range(1, most - 1)]
    asked = []
    for f in features:
        v = F.col(f).cast("double")
        asked += [F.min(v), F.max(v), F.avg((v == 0).cast("double")), F.sum((v > 0).cast("long")), F.percentile_approx(v, whole, 10_000), F.percentile_approx(F.when(v > 0, v), positive, 10_000)]
    row, out = df.agg(*[c.alias(f"x{i}") for i, c in enumerate(asked)]).first(), {}
    for i, f in enumerate(features):
        low, high, zeros, above, every, some = row[6 * i : 6 * i + 6]
        if low is None or low == high:
            out[f] = []
        elif zeros >= ZERO_SHARE and above:
            out[f] = sorted({0.0, *(round(x, 6) for x in (some or []) if above > 5)})
        else:
            out[f] = sorted({round(x, 6) for x in every})
    return out


def _weights(cells: list[tuple[int, int]]) -> list[float]:
    """WOE of each (rows, bad) cell, half a case added to each."""
    bad, good = max(sum(b for _, b in cells), 1), max(sum(n - b for n, b in cells), 1)
    k = len(cells)
    odds = (((b + 0.5) / (bad + 0.5 * k)) / ((n - b + 0.5) / (good + 0.5 * k)) for n, b in cells)
    return [max(-WOE_CLIP, min(WOE_CLIP, math.log(x))) for x in odds]


def _settle(cuts: list[float], cells: list[tuple[int, int]], sign: int, least: int) -> tuple[list[float], list[float]]:
    """Joins neighbouring cells until each is large enough and the weights run in one direction."""
    cuts, cells = list(cuts), list(cells)
    while cuts:
        held = [x for x in cells if x[0]]
        weights = _weights(held)
        thin = [max(k - 1, 0) for k, x in enumerate(held) if x[0] < least]
        turns = [k for k in range(len(held) - 1) if sign * weights[k] > sign * weights[k + 1] + 1e-9]
        if len(held) < 2 or not thin and not turns:
            break
        at = min((thin or turns)[0], len(cuts) - 1)
        cells[at : at + 2] = [(cells[at][0] + cells[at + 1][0], cells[at][1] + cells[at + 1][1])]
        del cuts[at]
    return cuts, _weights([x for x in cells if x[0]] or [(0, 0)])


def monotone_bins(df: DataFrame, directions: dict[str, str], label: str, most: int = 5) -> dict[str, dict]:
    """{feature: {splits, woe}}; a feature whose direction is `up` has weights that never fall. Two passes for all features."""
    features = list(directions)
    seeds = _seeds(df, features, most)
    where = [F.struct(F.lit(i).alias("f"), ranking.bucket_of(F.col(f).cast("double"), seeds[f]).alias("b")) for i, f in enumerate(features)]
    counted = df.select(F.explode(F.array(*where)).alias("x"), F.col(label).alias("y")).groupBy("x.f", "x.b").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("bad")).collect()
    cells = {f: [(0, 0)] * (len(seeds[f]) + 1) for f in features}
    for r in counted:
        cells[features[r.f]][r.b] = (r.n, int(r.bad or 0))
    total = sum(n for n, _ in cells[features[0]])
    out = {}
    for f in features:
        splits, woe = _settle(seeds[f], cells[f], 1 if directions[f] == "up" else -1, max(int(LEAST_SHARE * total), LEAST_ROWS))
        out[f] = {"splits": splits, "woe": woe}
    return out


def woe_of(value: Column, bins: dict) -> Column:
    """The weight of value's bin; missing values take the first, and a bin without weight the last."""
    last = bins["woe"][-1]
    out = F.lit(last)
    for i in reversed(range(len(bins["splits"]))):
        out = F.when(value <= bins["splits"][i], bins["woe"][min(i, len(bins["woe"]) - 1)]).otherwise(out)
    return F.when(value.isNull(), bins["woe"][0]).otherwise(out)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds _w, weights under which both labels count alike and sum to the number of rows."""
    n, ones = df.agg(F.count(F.lit(1)), F.sum(label)).first()
    ones = float(ones or 0)
    return df.withColumn("_w", F.when(F.col(label) == 1, n / (2 * max(ones, 1.0))).otherwise(n / (2 * max(n - ones, 1.0))))


def fit_scorecard(df: DataFrame, directions: dict[str, str], label: str, c: float = 0.5, l1: bool = False) -> dict:
    """A card: monotone bins, logistic weights on their WOE with balanced labels, then a Platt step on the linear score."""
    bins = monotone_bins(df, directions, label)
    names = list(directions)
    base = balanced(df.select(*[woe_of(F.col(f), bins[f]).alias(f"w{i}") for i, f in enumerate(names)], F.col(label).cast("double").alias("_y")), "_y")
    rows = VectorAssembler(inputCols=[f"w{i}" for i in range(len(names))], outputCol="x").transform(base).select("x", "_y", "_w").cache()
    n = rows.count()
    fit = LogisticRegression(labelCol="_y", featuresCol="x", weightCol="_w", regParam=1.0 / (c * max(n, 1)), elasticNetParam=1.0 if l1 else 0.0, standardization=False, maxIter=200).fit(rows)
    line = fit.transform(rows).select(vector_to_array("rawPrediction")[1].alias("lin"), "_y")
    platt = LogisticRegression(labelCol="_y", featuresCol="x", regParam=1e-6 / max(n, 1), standardization=False, maxIter=200).fit(VectorAssembler(inputCols=["lin"], outputCol="x").transform(line).select("x", "_y"))
    rows.unpersist()
    features = {f: {**bins[f], "coef": float(w)} for f, w in zip(names, fit.coefficients)}
    return {"intercept": float(fit.intercept), "a": float(platt.coefficients[0]), "b": float(platt.intercept), "features": features, **SCALE, "bands": dict(BANDS)}


def card_rows(spark, card: dict) -> DataFrame:
    """The model table of a card: a row per feature and bin, and a header row of feature '' with the scale in `header`."""
    rows = []
    for name, f in card["features"].items():
        edges = [None, *f["splits"], None]
        rows += [(name, i, edges[i], edges[i + 1], f["woe"][min(i, len(f["woe"]) - 1)], f["coef"], None) for i in range(len(f["splits"]) + 1)]
    header = {k: float(card[k]) for k in ("intercept", "a", "b", "pdo", "offset", "lo", "hi")} | {f"band_{k}": float(v) for k, v in card["bands"].items()}
    return spark.createDataFrame([*rows, ("", 0, None, None, None, None, header)], "feature string, bin int, lo double, hi double, woe double, coef double, header map<string,double>")


def card_from(table: DataFrame) -> dict:
    """The card of a model table; its rows are the bins of a card, so they fit the driver."""
    rows = table.orderBy("feature", "bin").collect()
    head = next(r.header for r in rows if r.feature == "")
    features: dict[str, dict] = {}
    for r in rows:
        if r.feature:
            f = features.setdefault(r.feature, {"splits": [], "woe": [], "coef": r.coef})
            f["woe"].append(r.woe)
            f["splits"] += [r.hi] if r.hi is not None else []
    scale = {k: v for k, v in head.items() if not k.startswith("band_")}
    return {**scale, "bands": {k[5:]: v for k, v in head.items() if k.startswith("band_")}, "features": features}


FOLD_BUCKETS = 256


def fold_of(key: str, k: int) -> Column:
    """The fold of a client, so that all its rows fall together."""
    return F.pmod(F.xxhash64(key), F.lit(k)).cast("int")


def fit_trees(df: DataFrame, features: list[str], label: str, rounds: int = 20, depth: int = 3):
    """The tree challenger, balanced: a function that adds the probability `p` to a table with the features."""
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol="_x")
    numbers = lambda t: t.withColumns({f"_f{i}": F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for i, f in enumerate(features)})
    model = GBTClassifier(labelCol=label, featuresCol="_x", weightCol="_w", maxIter=rounds, maxDepth=depth, stepSize=0.1, minInstancesPerNode=10, seed=42).fit(assembler.transform(numbers(balanced(df, label))))
    return lambda t: model.transform(assembler.transform(numbers(t))).withColumn("p", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction", *[f"_f{i}" for i in range(len(features))])


def stratified_folds(df: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """(key, fold): clients dealt to k folds so that all rows of one fall together and rows and positives are even.

    Clients go in turn, those with most positives first, then those with most rows; the turn's direction changes each round, so no
    fold always gets the larger one, and folds differ in positives by those of one client at most. The place in that order is a count of the classes and key buckets before, one row each,
    and a rank inside a bucket; so no task orders all clients. Null labels count as 0; null keys are one client.
    """
    groups = df.groupBy(key).agg(F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0)).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    groups = checkpointed(groups.withColumn("_b", F.coalesce(F.pmod(F.col(key).cast("long"), F.lit(FOLD_BUCKETS)), F.lit(0))))
    order = [F.desc("_pos"), F.desc("_n"), F.col("_b")]
    counts = groups.groupBy("_pos", "_n", "_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.select("_pos", "_n", "_b", (F.sum("_c").over(Window.orderBy(*order)) - F.col("_c")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_pos", "_n", "_b").orderBy(key)) - 1
    at, turn = F.pmod(place, F.lit(k)), F.floor(place / k) % 2
    return groups.join(F.broadcast(before), ["_pos", "_n", "_b"]).select(key, F.when(turn == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"))


def out_of_fold(df: DataFrame, key: str, k: int, fit, fold: Column | None = None) -> DataFrame:
    """df with `p` by models that did not see the row's fold; fit(train) gives a function that adds p. fold is by hash of key if not given."""
    own = fold_of(key, k) if fold is None else fold
    parts = [fit(df.where(own != i))(df.where(own == i)).withColumn("fold", F.lit(i)) for i in range(k)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def calibrations(df: DataFrame, score: str, label: str) -> DataFrame:
    """(method, brier) of the raw score, a Platt step and an isotonic fit on it; the least wins."""
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y"))
    shaped = VectorAssembler(inputCols=["s"], outputCol="x").transform(rows)
    platt = LogisticRegression(labelCol="y", featuresCol="x", maxIter=200).fit(shaped)
    iso = IsotonicRegression(labelCol="y", featuresCol="x").fit(shaped)
    both = iso.transform(platt.transform(shaped).select("s", "y", "x", vector_to_array("probability")[1].alias("q")))
    miss = lambda c: F.avg((F.col(c) - F.col("y")) ** 2)
    row = both.agg(miss("s").alias("raw"), miss("q").alias("platt"), miss("prediction").alias("isotonic"))
    return row.select(F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).alias("brier")) for m in ("isotonic", "platt", "raw")])).alias("x")).select("x.method", "x.brier")
