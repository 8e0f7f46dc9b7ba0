"""Similar sets by minimum hashes and by a client's newest lines, against brute force."""

import datetime as dt
import itertools
import math
import random

import pytest

from tidemark.operators import minhash, reco


def jaccards(sets, least):
    found = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        s = both / (len(sets[a] | sets[b]) or 1)
        if both and s >= least:
            found[a, b] = (both, s)
    return found


def grown(seed, clients, shared=None):
    """Sets drawn from few tastes, so that many similarities occur; `shared` is an item that everyone has."""
    r = random.Random(seed)
    tastes = [r.sample(range(1000), 60) for _ in range(12)]
    sets = {c: set(r.sample(r.choice(tastes), r.randint(1, 40))) | set(r.sample(range(1000), r.randint(0, 10))) for c in range(clients)}
    return {c: s | ({-1} if shared else set()) for c, s in sets.items()}


def table(spark, sets):
    return spark.createDataFrame([(c, i) for c, s in sets.items() for i in s], "client_id long, item long")


@pytest.mark.parametrize("most, shared", [(500, False), (40, True)])
def test_alike_finds_most_pairs_and_no_wrong_one(spark, most, shared):
    sets = grown(5, 300, shared)
    exact = jaccards(sets, 0.05)
    rows = minhash.alike(table(spark, sets), "client_id", "item", 0.05, most=most).collect()
    got = {(r.client_id, r.other): (r.both, pytest.approx(r.jaccard)) for r in rows}
    assert len(got) == len(rows) and set(got) <= set(exact)
    assert all(got[k] == exact[k] for k in got)
    assert len(got) >= 0.9 * len(exact)


def test_a_crowded_bucket_of_equal_sets_loses_nothing(spark):
    sets = {c: {1, 2, 3} for c in range(90)} | {c: {c} for c in range(90, 120)}
    got = {(r.client_id, r.other) for r in minhash.alike(table(spark, sets), "client_id", "item", 0.5, most=10).collect()}
    assert got == set(jaccards(sets, 0.5))


def test_alike_of_nothing_nulls_and_text(spark):
    assert minhash.alike(table(spark, {}), "client_id", "item", 0.05).count() == 0
    rows = [("a", "x"), ("b", "x"), (None, "x"), ("a", None), ("c", None)]
    got = minhash.alike(spark.createDataFrame(rows, "client_id string, item string"), "client_id", "item", 0.05).collect()
    assert [(r.client_id, r.other, r.both, r.jaccard) for r in got] == [("a", "b", 1, 1.0)]


def test_bands_reach_the_recall():
    for least, rows in ((0.05, 1), (0.5, 2), (0.8, 4)):
        n = minhash.bands_for(least, 0.96, rows)
        assert 1 - (1 - least**rows) ** n >= 0.96 > 1 - (1 - least**rows) ** (n - 1)


def test_newest_lines_ask_and_all_lines_answer(spark):
    day = lambda n: dt.date(1999, 1, n)
    lines = [(1, 10, 100, day(1)), (1, 11, 101, day(2)), (1, 12, 102, day(3)), (1, 12, 103, day(3)), (2, 20, 102, day(1)), (2, 20, 103, day(1)), (2, 20, 100, day(1)), (3, 30, 100, day(9))]
    df = spark.createDataFrame(lines, "client_id long, order_id long, item long, created date")
    newest = reco.newest_pairs(df, "item", 2)
    assert sorted((r.client_id, r.item) for r in newest.collect()) == [(1, 102), (1, 103), (2, 100), (2, 102), (3, 100)]
    got = {(r.client_id, r.other): r.jaccard for r in reco.similar_clients(reco.owned(df, "item"), "item", newest=newest).collect()}
    # client 1 asks with {102, 103}: two of client 2's three; client 3 no longer shares anything with it, but client 3's 100 is among its own
    assert got == {(1, 2): pytest.approx(2 / 3), (2, 1): pytest.approx(2 / 4), (2, 3): pytest.approx(1 / 2), (3, 2): pytest.approx(1 / 3), (3, 1): pytest.approx(1 / 4)}


@pytest.mark.parametrize("most", [500, 60])
def test_large_sets_meet_by_their_smallest_hashes(spark, monkeypatch, most):
    """sets larger than a sketch, also beside items that many have; what is found is exact."""
    monkeypatch.setattr(minhash, "SKETCH", 64)
    r = random.Random(7)
    tastes = [r.sample(range(4000), 150) for _ in range(20)]
    sets = {c: set(r.sample(tastes[c % 20], r.randint(30, 140))) | {-1} for c in range(160)}
    exact = jaccards(sets, 0.2)
    rows = minhash.alike(table(spark, sets), "client_id", "item", 0.2, most=most).collect()
    got = {(x.client_id, x.other): (x.both, pytest.approx(x.jaccard)) for x in rows}
    assert len(got) == len(rows) and all(exact[k] == v for k, v in got.items())
    assert len(got) >= 0.9 * len(exact) and len(exact) > 500
    below = lambda m: sum(math.comb(64, i) * 0.2**i * 0.8 ** (64 - i) for i in range(m))
    assert below(minhash.enough(0.2, 0.96, 64)) <= 0.04 < below(minhash.enough(0.2, 0.96, 64) + 1) and minhash.enough(0.01, 0.96, 64) == 1


def test_small_sets_are_compared_where_they_meet(spark, monkeypatch):
    """all pairs are found, and none of them is looked up again."""
    monkeypatch.setattr(minhash, "compared", lambda *a: pytest.fail("sets of a sketch are compared twice"))
    sets = grown(9, 200)
    rows = minhash.alike(table(spark, sets), "client_id", "item", 0.05).collect()
    assert {(x.client_id, x.other): x.both for x in rows} == {k: n for k, (n, _) in jaccards(sets, 0.05).items()} and len(rows) > 500
