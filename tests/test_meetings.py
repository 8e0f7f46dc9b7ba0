"""Pairs that meet by a shared value: against brute force, and what they send through the shuffle."""

import datetime as dt
import itertools
import random

import pytest

from tidemark.operators import reco


def shuffled(spark, act):
    """What act returns, and the records that it sent through shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = lambda: store.stageList(None, False, False, none, None)

    def sent():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        got = stages()
        return sum(got.apply(i).shuffleWriteRecords() for i in range(got.size()))

    before = sent()
    out = act()
    return out, sent() - before


def baskets(seed, clients, items, most):
    r = random.Random(seed)
    return {c: set(r.sample(range(items), r.randint(1, most))) for c in range(clients)}


def table(spark, sets):
    return spark.createDataFrame([(c, i) for c, s in sets.items() for i in s], "client_id long, item long")


@pytest.mark.parametrize("block, tasks", [(1000, 1_000_000), (3, 50)])
def test_similar_clients_are_the_exact_ones_at_few_records(spark, monkeypatch, block, tasks):
    monkeypatch.setattr(reco, "BLOCK", block)
    monkeypatch.setattr(reco, "MEETINGS_A_TASK", tasks)
    sets = baskets(3, 120, 200, 40)
    expected = set()
    for c, s in sets.items():
        met = sorted(((len(s & t), o) for o, t in sets.items() if o != c and s & t), key=lambda x: (-x[0], x[1]))[:20]
        alike = sorted(((n / len(s | sets[o]), o) for n, o in met if n / len(s | sets[o]) >= 0.05), key=lambda x: (-x[0], x[1]))[:7]
        expected |= {(c, o, round(j, 9)) for j, o in alike}
    got, records = shuffled(spark, lambda: reco.similar_clients(table(spark, sets), "item", most=7, candidates=20).collect())
    assert {(r.client_id, r.other, round(r.jaccard, 9)) for r in got} == expected and len(got) == len(expected)
    if block == 1000:  # every pair that met was a record before
        assert records < 10 * sum(map(len, sets.values()))


def test_discoveries_at_cut_offs_send_candidates_not_their_baskets(spark):
    r = random.Random(8)
    day = lambda n: dt.date(1999, 1, 1) + dt.timedelta(days=n)
    sets = baskets(4, 150, 150, 25)
    lines = [(c, 10 * c + i % 3, i, day(r.randint(0, 60))) for c, s in sets.items() for i in s]
    cut = {c: 40 + c % 20 for c in sets}
    df = spark.createDataFrame(lines, "client_id long, order_id long, item long, created date")
    cases = spark.createDataFrame([(c, day(n)) for c, n in cut.items()], "client_id long, as_of date")
    have = {(c, u): {i for k, _, i, at in lines if k == c and at < day(cut[u])} for c, u in itertools.product(sets, sets)}
    expected = {}
    for c in sets:
        own = have[c, c]
        met = sorted(((len(own & have[o, c]), o) for o in sets if o != c and own & have[o, c]), key=lambda x: (-x[0], x[1]))[:30]
        near = sorted(((n / len(own | have[o, c]), o) for n, o in met if n / len(own | have[o, c]) >= 0.05), key=lambda x: (-x[0], x[1]))[:10]
        for i in {i for _, o in near for i in have[o, c]} - own:
            of = [j for j, o in near if i in have[o, c]]
            if len(of) >= 2:
                expected[c, i] = pytest.approx(sum(of) / len(of), abs=1e-8)
    got, records = shuffled(spark, lambda: reco.discovery_at(df, cases, "item", most=10, candidates=30).collect())
    assert {(x.client_id, x.item): x.score for x in got} == expected and len(got) == len(expected)
    assert records < 20 * len(lines)


@pytest.mark.parametrize("items, itself", [(400, False), (400, True), (8, True)])
def test_co_purchase_and_scores_of_many_and_of_few_items(spark, items, itself):
    sets = baskets(6, 90, items, min(items, 20))
    pairs = table(spark, sets)
    of = {i: {c for c, s in sets.items() if i in s} for i in range(items)}
    sim = {(a, b): len(of[a] & of[b]) / (len(of[a]) * len(of[b])) ** 0.5 for a in of for b in of if len(of[a] & of[b]) >= 2 and (itself or a != b)}
    co = reco.co_purchase(pairs, "item", itself=itself)
    got, records = shuffled(spark, co.collect)
    assert {(x.seed, x.cand): (x.co, x.sim) for x in got} == {(a, b): (len(of[a] & of[b]), pytest.approx(s)) for (a, b), s in sim.items()}
    assert records < 6 * sum(map(len, sets.values()))
    scores = {}
    for c, s in sets.items():
        for (a, b), x in sim.items():
            if a in s:
                scores[c, b] = scores.get((c, b), 0) + x
    assert {(x.client_id, x.item): x.score for x in reco.co_scores(pairs, co, "item").collect()} == {k: pytest.approx(v) for k, v in scores.items()}


def test_nothing_meets_in_empty_tables(spark):
    none = table(spark, {})
    assert reco.similar_clients(none, "item").count() == 0
    assert reco.co_scores(none, reco.co_purchase(none, "item"), "item").count() == 0


def test_minhash_sends_few_of_the_baskets_that_meet(spark):
    """Baskets of 30 among 3,000 items meet but are hardly alike; a few are."""
    from tidemark.operators import minhash

    r = random.Random(2)
    sets = {c: set(r.sample(range(3000), 30)) for c in range(300)}
    for c in range(0, 300, 10):
        sets[c + 1] = set(r.sample(sorted(sets[c]), 20)) | set(r.sample(range(3000), 10))
    exact = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    met = spark.createDataFrame(list(itertools.combinations(sets, 2)), "client_id long, other long")
    got, records = shuffled(spark, lambda: minhash.compared(met, table(spark, sets), "client_id", "item", 0.3).collect())
    assert {(x.client_id, x.other): x.both for x in got} == exact and len(exact) >= 25
    assert records < 3 * 300 * 299 / 2


def test_substitutes_need_no_links_of_a_whole_number(spark):
    from tidemark.operators import catalogue

    r = random.Random(4)
    products = spark.createDataFrame([(i, f"number-{i % 3}" if i % 7 else "-") for i in range(300)], "product_id long, number string")
    pairs = spark.createDataFrame([(i, r.randrange(300)) for i in range(0, 300, 4)], "product_id long, other_id long")
    health = spark.createDataFrame([(i, float(r.randint(0, 2)), float(r.randint(1, 3))) for i in range(300) if i % 11], "product_id long, qty_on_hand double, health double")
    rows = lambda df: sorted((x.product_id, x.other_id, x.rank) for x in df.collect())
    all_links = rows(catalogue.substitutes(catalogue.links(pairs, products), health))
    got, records = shuffled(spark, lambda: rows(catalogue.best_substitutes(pairs, products, health)))
    assert got == all_links
    assert records < 20 * 300
