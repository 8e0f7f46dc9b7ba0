"""Elasticity by normal equations against dense least squares, and its refusals."""

import numpy as np
import pytest

from tidemark.operators import elasticity as el

NAMES = "product_id long, agreement_id long, ym string, qty double, price double"


def panel(key, e, rnd, agreements, months, share=1.0, noise=0.02):
    """Cells of a constant elasticity with effects; with a share under 1 the panel has gaps."""
    fa, fm = rnd.normal(0, 0.3, agreements), rnd.normal(0, 0.2, months)
    for a in range(agreements):
        for m in range(months):
            if rnd.random() < share:
                p = float(np.exp(rnd.normal(2.7, 0.25)))
                yield key, a, f"2025-{m + 1:02d}", float(np.exp(5 - e * np.log(p) + fa[a] + fm[m] + rnd.normal(0, noise))), p


def dense(cells):
    """(elasticity, r_squared) by one-hot least squares, after the same trimming."""
    x, y = np.log([c[4] for c in cells]), np.log([c[3] for c in cells])
    far = np.abs(x - np.median(x))
    mad = np.median(far)
    keep = far <= 3.5 * 1.4826 * mad if len(x) >= 4 and mad > 0 else far >= 0
    cells = [c for c, k in zip(cells, keep) if k]
    x, y = x[keep], y[keep]
    columns = [np.ones(len(x)), x]
    for i in (1, 2):
        columns += [np.array([c[i] == v for c in cells], float) for v in sorted({c[i] for c in cells})[1:]]
    full = np.stack(columns, axis=1)
    beta, _, rank, _ = np.linalg.lstsq(full, y, rcond=None)
    rest = y - full @ beta
    return -beta[1], 1 - rest @ rest / ((y - y.mean()) @ (y - y.mean())), len(x), rank == full.shape[1]


def test_equals_least_squares(spark):
    rnd = np.random.default_rng(5)
    panels = {1: (1.8, 12, 6, 1.0), 2: (0.4, 30, 10, 0.4), 3: (3.0, 5, 12, 0.7), 4: (1.2, 40, 3, 0.9), 5: (2.0, 8, 12, 0.5)}
    cells = {k: list(panel(k, e, rnd, a, m, share)) for k, (e, a, m, share) in panels.items()}
    cells[1].append((1, 0, "2025-11", 5.0, 90000.0))  # a price in another unit
    cells[1].append((1, 99, "2025-01", 5.0, 15.0))  # an agreement of one cell
    rows = [c for own in cells.values() for c in own] + [(1, 50, "2025-01", 0.0, 3.0), (1, 51, "2025-01", 1.0, -3.0)]
    got = {r.product_id: r for r in el.elasticity(spark.createDataFrame(rows, NAMES).repartition(3)).collect()}
    for k, own in cells.items():
        e, r2, n, full = dense(own)
        assert full and got[k].note == "ok" and got[k].n_kept == n
        assert (got[k].elasticity, got[k].r_squared) == (pytest.approx(e, abs=1e-8), pytest.approx(r2, abs=1e-8))
        assert abs(got[k].elasticity - panels[k][0]) < 0.15
    assert got[1].n_cells == len(cells[1]) + 2 and got[1].n_kept == len(cells[1]) - 1


def test_refusals(spark):
    rnd = np.random.default_rng(1)
    rows = [(1, a, "2025-01", 10.0, 5.0) for a in range(8)]
    rows += [(2, a, f"2025-{m + 1:02d}", 100 / (5.0 + a), 5.0 + a) for a in range(10) for m in range(4)]
    rows += [(3, 1, "2025-01", -1.0, 2.0)]
    rows += [(4, 1, f"2025-{m + 1:02d}", 3.0, 2.0 + m) for m in range(4)]
    two = list(panel(5, 1.0, rnd, 5, 4)) + [(5, a + 100, f"2026-{m + 1:02d}", q, p) for _, a, ym, q, p in panel(5, 1.0, rnd, 5, 4) for m in [int(ym[-2:]) - 1]]
    df = spark.createDataFrame(rows + two, NAMES)
    got = {r.product_id: (r.elasticity, r.note) for r in el.elasticity(df).collect()}
    assert got == {1: (None, "insufficient-price-levels"), 2: (None, "no-within-price-variation"), 3: (None, "no-positive-cells"), 4: (None, "insufficient-residual-df"), 5: (None, "rank-deficient")}
    assert el.elasticity(df.limit(0)).count() == 0


def test_backtest(spark):
    fits = spark.createDataFrame([(1, 1.5), (2, 7.0), (3, -1.0), (4, 2.0), (5, None)], "product_id long, elasticity double")
    before = spark.createDataFrame([(i, 10.0, 100.0) for i in range(1, 6)], "product_id long, price double, qty double")
    after = spark.createDataFrame([(1, 11.0, 90.0), (2, 9.0, 80.0), (3, 12.0, 110.0), (4, 10.05, 10.0), (5, 20.0, 1.0)], "product_id long, price double, qty double")
    r = el.backtest(fits, before, after).first()
    assert (r.attempted, r.fitted, r.sane, r.frac_positive, r.movers, r.movers_sane) == (5, 4, 2, 0.75, 3, 1)
    assert (r.accuracy_elastic, r.comovement, r.accuracy_sane) == (0.333, 0.667, 1.0)
    none = el.backtest(fits.limit(0), before, after).first()
    assert (none.attempted, none.fitted, none.movers, none.accuracy_elastic) == (0, 0, 0, None)
