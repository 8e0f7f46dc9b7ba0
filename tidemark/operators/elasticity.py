"""Own-price elasticity with two fixed effects for every key at once, by normal equations from aggregates.

The slope of ln qty on ln price beside agreement and month effects: agreement means are taken out cell by cell, which leaves
one unknown for each month. Its normal equations are sums over cells; a key's system has the size of the calendar, however
many cells and agreements it has, and is solved by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.pricing import mad_kept
from tidemark.sources.sinks import checkpointed

#: Least residual degrees of freedom, price levels and variance inside effects; the sane band; the least price move.
LEAST_DF, LEAST_LEVELS, LEAST_VAR = 3, 3, 1e-4
SANE, FLAT = (0.5, 5.0), 0.01


def solve(n: int, agreements: int, sxx: float, sxy: float, syy: float, total: float, months: list, pairs: list) -> tuple[float | None, float | None, str]:
    """(elasticity, r_squared, note) of one key: sums over its cells less their agreement's mean, and by month (month, cells,
    sums of x and y) and pair of months (month, month, weight)."""
    place = {m[0]: i for i, m in enumerate(sorted(months))}
    count, t, u = (np.array([m[k] for m in sorted(months)], float) for k in (1, 2, 3))
    system = np.diag(count)
    for a, b, w in pairs:
        system[place[a], place[b]] -= w
    values, vectors = np.linalg.eigh(system)
    real = values > 1e-9 * max(values.max(), 1.0)
    half = vectors[:, real] / np.sqrt(values[real])
    x_part, y_part = half.T @ t, half.T @ u
    left = sxx - x_part @ x_part
    free = left > 1e-10 * max(sxx, 1e-300)
    rank = agreements + int(real.sum()) + int(free)
    if n - rank < LEAST_DF:
        return None, None, "insufficient-residual-df"
    if (sxx - float((t * t / count).sum())) / n < LEAST_VAR:
        return None, None, "no-within-price-variation"
    if rank < agreements + len(months):
        return None, None, "rank-deficient"
    slope = (sxy - x_part @ y_part) / left
    rest = syy - y_part @ y_part - slope * slope * left
    return -float(slope), 1 - float(rest) / total if total > 0 else None, "ok"


def elasticity(cells: DataFrame, key: str = "product_id") -> DataFrame:
    """key, elasticity, r_squared, n_cells, n_kept, note from cells (key, agreement_id, ym, qty, price), each cell once.

    Cells need a positive quantity and price; prices far from the key's median in logarithms are left out. elasticity is minus
    the slope; where a key's cells do not identify it, it is null and the note says why. Keys without a cell left have
    `no-positive-cells`; an empty table gives no rows.
    """
    every = cells.groupBy(key).agg(F.count(F.lit(1)).alias("n_cells"))
    good = cells.where("qty > 0 and price > 0").select(key, "agreement_id", "ym", F.ln("price").alias("lnp"), F.ln("qty").alias("lnq"))
    kept = mad_kept(good, [key], "lnp")
    own = Window.partitionBy(key, "agreement_id")  # at most a row per month
    kept = kept.withColumns({"x": F.col("lnp") - F.avg("lnp").over(own), "y": F.col("lnq") - F.avg("lnq").over(own), "w": 1 / F.count(F.lit(1)).over(own)})
    kept = checkpointed(kept)
    x, y = F.col("x"), F.col("y")
    sums = kept.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_kept"), F.countDistinct("agreement_id").alias("agreements"), F.countDistinct(F.round("lnp", 6)).alias("levels"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"),
        (F.count(F.lit(1)) * F.var_pop("lnq")).alias("total"),
    )
    fit = sums.where(F.col("levels") >= LEAST_LEVELS)
    some = kept.join(fit.select(key), key, "left_semi")
    months = some.groupBy(key, "ym").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y")).groupBy(key).agg(F.collect_list(F.struct("ym", "n", "x", "y")).alias("months"))
    lists = some.groupBy(key, "agreement_id").agg(F.collect_list("ym").alias("yms"), F.first("w").alias("w"))
    pairs = lists.withColumn("a", F.explode("yms")).withColumn("b", F.explode("yms")).groupBy(key, "a", "b").agg(F.sum("w").alias("w"))
    pairs = pairs.groupBy(key).agg(F.collect_list(F.struct("a", "b", "w")).alias("pairs"))  # the calendar squared at most
    kind = dict(cells.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [
                (k, *solve(n, a, sxx, sxy, syy, total, [(m["ym"], m["n"], m["x"], m["y"]) for m in months_], [(p["a"], p["b"], p["w"]) for p in pairs_]))
                for k, n, a, sxx, sxy, syy, total, months_, pairs_ in f.itertuples(index=False)
            ]
            yield pd.DataFrame(rows, columns=[key, "elasticity", "r_squared", "note"])

    systems = fit.join(months, key).join(pairs, key).select(key, "n_kept", "agreements", "sxx", "sxy", "syy", "total", "months", "pairs")
    solved = systems.mapInPandas(run, f"{key} {kind}, elasticity double, r_squared double, note string")
    found = every.join(sums.select(key, "n_kept", "levels"), key, "left").join(solved, key, "left")
    why = F.when(F.col("n_kept").isNull(), "no-positive-cells").when(F.col("levels") < LEAST_LEVELS, "insufficient-price-levels").otherwise(F.col("note"))
    return found.select(key, "elasticity", "r_squared", "n_cells", F.coalesce("n_kept", F.lit(0)).alias("n_kept"), why.alias("note"))


def is_sane(e):
    return F.coalesce((e >= SANE[0]) & (e <= SANE[1]), F.lit(False))


def backtest(fits: DataFrame, before: DataFrame, after: DataFrame, key: str = "product_id") -> DataFrame:
    """One row: how often the quantity moved against the price from one period to the next, as a fitted elasticity says.

    fits (key, elasticity, note) of the earlier period; before and after (key, price, qty) of the two. Moves under 1 % of the price say nothing.
    """
    real = lambda t, p, q: t.where("price > 0 and qty > 0").select(key, F.col("price").alias(p), F.col("qty").alias(q))
    move = (F.col("p1") - F.col("p0")) / F.col("p0")
    moved = fits.where("elasticity is not null").join(real(before, "p0", "q0"), key).join(real(after, "p1", "q1"), key).where(F.abs(move) >= FLAT)
    against, along = (F.signum(F.col("q1") - F.col("q0")) == F.lit(s) * F.signum(move) for s in (-1, 1))
    sane = is_sane(F.col("elasticity"))
    share = lambda x, of: F.when(F.sum(of.cast("int")) > 0, F.round(F.sum((x & of).cast("int")) / F.sum(of.cast("int")), 3))
    every = F.lit(True)
    moves = moved.agg(F.count(F.lit(1)).alias("movers"), share(against, every).alias("accuracy_elastic"), share(along, every).alias("comovement"), F.coalesce(F.sum(sane.cast("int")), F.lit(0)).alias("movers_sane"), share(against, sane).alias("accuracy_sane"))
    fitted = F.sum(F.col("elasticity").isNotNull().cast("int"))
    overall = fits.agg(F.count(F.lit(1)).alias("attempted"), F.coalesce(fitted, F.lit(0)).alias("fitted"), F.coalesce(F.sum(sane.cast("int")), F.lit(0)).alias("sane"), F.when(fitted > 0, F.round(F.sum((F.col("elasticity") > 0).cast("int")) / fitted, 3)).alias("frac_positive"))
    return overall.join(F.broadcast(moves))
