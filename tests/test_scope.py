"""Discoveries without caps: every client that is alike enough counts, against brute force."""

import datetime as dt
import random

import pytest

from tidemark import registry
from tidemark.operators import reco


def test_every_alike_client_counts_without_caps(spark):
    """F8: 130 clients are alike to the first, more than the hundred nearest; those of the smallest overlap are the most alike."""
    r = random.Random(3)
    day = dt.date(1999, 1, 1)
    sets = {c: set(r.sample(range(20), r.randint(3, 9))) for c in range(130)}
    lines = [(c, c, i, day) for c, s in sets.items() for i in s]
    df = spark.createDataFrame(lines, "client_id long, order_id long, item long, created date")
    cases = spark.createDataFrame([(c, day + dt.timedelta(days=1)) for c in sets], "client_id long, as_of date")
    expected = {}
    for c, own in sets.items():
        near = {o: len(own & s) / len(own | s) for o, s in sets.items() if o != c and len(own & s) / len(own | s) >= 0.05}
        for i in set(range(20)) - own:
            of = [j for o, j in near.items() if i in sets[o]]
            if len(of) >= 2:
                expected[c, i] = pytest.approx(sum(of) / len(of), abs=1e-8)
    rows = lambda **caps: {(x.client_id, x.item): x.score for x in reco.discovery_at(df, cases, "item", **caps).collect()}
    assert rows(candidates=None, most=None) == expected
    assert rows(candidates=20, most=None) != expected and rows(candidates=None, most=20) != expected


def test_the_region_scope_has_no_caps(spark, sf_dir, monkeypatch):
    asked, real = [], reco.discovery_at
    monkeypatch.setattr(reco, "discovery_at", lambda *a, **k: asked.append(k) or real(*a, **k))
    assert {r.scope for r in registry.QUERIES["c11_region_scope"](spark, sf_dir).collect()} == {"all", "region"}
    assert asked == [{"candidates": None, "most": None}] * 2
