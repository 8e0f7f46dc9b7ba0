"""What meetings send: few bytes an id, and each pair of items once."""

import pytest

from tests.test_meetings import baskets, table
from tidemark.operators import reco


def sent_bytes(spark, act):
    """What act returns, and the bytes that it sent through shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def sent():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        got = store.stageList(None, False, False, none, None)
        return sum(got.apply(i).shuffleWriteBytes() for i in range(got.size()))

    before = sent()
    out = act()
    return out, sent() - before


def test_ids_travel_as_ints_where_they_fit(spark):
    """the same pairs with small, negative and large ids; small ones take fewer bytes."""
    sets = baskets(3, 300, 100, 40)
    found, size = {}, {}
    for times in (1, -7, 2**33 + 12_345):
        moved = {c * times: s for c, s in sets.items()}
        rows, size[times] = sent_bytes(spark, lambda: reco.similar_clients(table(spark, moved), "item", most=300).collect())
        found[times] = {(r.client_id // times, r.other // times, round(r.jaccard, 9)) for r in rows}
    assert found[1] == found[-7] == found[2**33 + 12_345] and found[1]
    assert size[1] < 0.8 * size[2**33 + 12_345]


def test_co_purchase_meets_each_pair_once(spark, monkeypatch):
    """who and other are sent one way and turned afterwards; text ids stay as they are."""
    asked, real = [], reco.meetings
    monkeypatch.setattr(reco, "meetings", lambda *a, **k: asked.append(real(*a, **k)) or asked[-1])
    pairs = table(spark, baskets(6, 90, 400, 20)).selectExpr("client_id", "concat('i', item) AS item")
    of = {}
    for r in pairs.collect():
        of.setdefault(r.item, set()).add(r.client_id)
    got = {(x.seed, x.cand): (x.co, x.sim) for x in reco.co_purchase(pairs, "item", itself=True).collect()}
    assert got == {(a, b): (len(of[a] & of[b]), pytest.approx(len(of[a] & of[b]) / (len(of[a]) * len(of[b])) ** 0.5)) for a in of for b in of if len(of[a] & of[b]) >= 2}
    assert all(r.who <= r.other for r in asked[0].collect())
