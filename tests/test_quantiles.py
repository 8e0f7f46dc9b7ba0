"""Grouped quantiles with light and heavy keys against numpy, and drift against a plain loop."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import quantiles, risk


@pytest.mark.parametrize("light", [10, 10**9])
def test_grouped_quantiles_equal_numpy(spark, light):
    rnd = random.Random(4)
    groups = {"half of all rows": [rnd.gauss(0, 5) for _ in range(3000)], "ties": [float(rnd.randrange(4)) for _ in range(500)], "one value": [2.5] * 60, "one": [7.0], "two": [1.0, 2.0], "few": [3.0, 1.0, None, 2.0]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("none", None)], "k string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in quantiles.grouped_quantiles(df, ["k"], "v", probs, light).collect()}
    assert set(got) == set(groups)
    for k, vs in groups.items():
        assert got[k] == pytest.approx(np.quantile([v for v in vs if v is not None], probs).tolist())
    assert quantiles.grouped_quantiles(df.limit(0), ["k"], "v", probs, light).count() == 0


def psi_by_loop(was, now, bins=10):
    xs = sorted(v for v in was if v is not None)
    edges = []
    for i in range(1, bins):
        at = i / bins * (len(xs) - 1) if xs else 0
        e = xs[math.floor(at)] + (xs[math.ceil(at)] - xs[math.floor(at)]) * (at - math.floor(at)) if xs else None
        if e is not None and (not edges or e > edges[-1] + 1e-12):
            edges.append(e)

    def shares(vs):
        n = [0] * (len(edges) + 1)
        for v in vs:
            n[0 if v is None else sum(e < v for e in edges)] += 1
        return [max(x / len(vs), 1e-6) for x in n] if vs else [1 / len(n)] * len(n)

    return sum((a - e) * math.log(a / e) for a, e in zip(shares(now), shares(was)))


def test_drift_equals_a_loop(spark):
    rnd = random.Random(2)
    was = [(rnd.gauss(0, 1), float(rnd.randrange(3)), None) for _ in range(400)] + [(None, 1.0, None)]
    now = [(rnd.gauss(0.4, 1), 2.0, 1.0) for _ in range(300)] + [(None, None, 1.0)]
    frame = lambda rows: spark.createDataFrame(rows, "a double, b double, c double")
    got = {r.feature: (r.psi, r.level) for r in risk.psi(frame(was), frame(now), ["a", "b", "c"]).collect()}
    for i, f in enumerate("abc"):
        assert got[f][0] == pytest.approx(psi_by_loop([r[i] for r in was], [r[i] for r in now]))
    assert (got["b"][1], got["c"]) == ("alert", (pytest.approx(0.0), "ok"))


def test_band_rates(spark):
    df = spark.createDataFrame([("A", 90.0, 0), ("A", 80.0, 1), ("D", 10.0, 1)], "band string, score double, label int")
    assert {r.band: (r.n, r.rate, r.mean_score, r.min_score, r.max_score) for r in risk.band_rates(df).collect()} == {"A": (2, 0.5, 85.0, 80.0, 90.0), "D": (1, 1.0, 10.0, 10.0, 10.0)}
