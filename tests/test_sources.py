"""Published versions, the lot ledger, payloads and folds."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import payloads, scorecard, supply
from tidemark.sources import published


def test_a_failed_run_leaves_the_old_version(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda *xs: spark.createDataFrame([(x,) for x in xs], "x int")
    assert published.current_version(spark, path) is None
    with pytest.raises(FileNotFoundError):
        published.read_published(spark, path)
    first = published.publish(rows(1, 2), path)
    pinned = published.read_published(spark, path)
    bad = rows(3).withColumn("x", F.when(F.col("x") == 3, F.raise_error(F.lit("no"))).cast("int"))
    with pytest.raises(Exception, match="no"):
        published.publish(bad, path)
    assert published.current_version(spark, path) == first and published.read_published(spark, path).count() == 2
    # The table's next version may read the table itself; a reader of the old one keeps it.
    second = published.publish(published.read_published(spark, path).union(rows(9)), path)
    assert second != first and published.read_published(spark, path).count() == 3
    assert pinned.count() == 2 and published.read_published(spark, path, first).count() == 2
    published.point_to(spark, path, first)
    assert published.read_published(spark, path).count() == 2
    with pytest.raises(FileNotFoundError):
        published.point_to(spark, path, "none")
    (tmp_path / "t/versions/half").mkdir()
    with pytest.raises(FileNotFoundError):
        published.point_to(spark, path, "half")


def test_derived_rows_never_overwrite_curated_ones(spark, tmp_path):
    path = f"file://{tmp_path}/terms"
    published.publish(spark.createDataFrame([(1, 5, "curated")], "k int, moq int, source string"), path)
    derived = lambda *rows: spark.createDataFrame(list(rows), "k int, moq int")
    read = lambda: sorted(map(tuple, published.read_published(spark, path).collect()))
    published.upsert_derived(derived((1, 9), (2, 9), (3, 1)), path, ["k"])
    assert read() == [(1, 5, "curated"), (2, 9, "derived"), (3, 1, "derived")]
    published.upsert_derived(derived((1, 8), (2, 7), (4, 4)), path, ["k"])
    assert read() == [(1, 5, "curated"), (2, 7, "derived"), (3, 1, "derived"), (4, 4, "derived")]
    published.upsert_derived(derived((1, 8)), path, ["k"], overwrite=True)
    assert (1, 8, "derived") in read() and len(read()) == 4


def test_ledger_balances_hold_from_day_to_day(spark):
    day = lambda n: dt.date(2000, 1, n)
    rows = [(1, day(1), 5), (1, day(3), -2), (1, day(3), 4), (1, day(9), -7), (2, day(4), 1), (3, None, 8), (None, day(1), 3)]
    df = spark.createDataFrame([(k, d, Decimal(q), Decimal(10 * q)) for k, d, q in rows], "k int, day date, qty decimal(18,2), value decimal(20,4)")
    book = supply.ledger(df, ["k"])
    assert sorted((r.k, r.since.day, r.until and r.until.day, int(r.qty)) for r in book.collect()) == [(1, 1, 3, 5), (1, 3, 9, 7), (1, 9, None, 0), (2, 4, None, 1)]
    dates = [f"2000-01-{n:02d}" for n in (1, 2, 3, 8, 9)]
    got = {(r.k, r.as_of.day): (int(r.qty), int(r.value)) for r in supply.balances_at(book, ["k"], dates).collect()}
    assert got == {(1, 1): (5, 50), (1, 2): (5, 50), (1, 3): (7, 70), (1, 8): (7, 70), (2, 8): (1, 10), (2, 9): (1, 10)}
    assert supply.ledger(df.limit(0), ["k"]).count() == 0


def test_payloads(spark):
    texts = ['{"products": [{"product_id": 7, "score": 0.5}, {"product_id": "8"}, {"score": 1.0}, {"product_id": "x"}]}', '{"products": [{"prod', "null", None, "{}", '{"products": null, "more": 1}', '{"products": []}', "[1]", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    got = {r.i: r for r in payloads.parsed(df, "payload", payloads.PRODUCTS).collect()}
    assert {i for i, r in got.items() if r.corrupt is not None} >= {1} and got[3].parsed is None and got[3].corrupt is None
    assert [r.product_id for r in payloads.product_rows(df).orderBy("product_id").collect()] == [7, 8]
    t = dt.datetime(2024, 1, 1)
    names = "client_id long, task_type string, status string, sold boolean, updated_at timestamp, payload string"
    one = '{"products": [{"product_id": 7}]}'
    rows = [(1, "cross_sell", "dismissed", None, t, one), (2, "cross_sell", "done", False, t, one), (3, "cross_sell", "done", True, t, one), (4, "cross_sell", "done", None, t, one), (5, "reorder_due", "dismissed", None, t, one), (6, "cross_sell", "dismissed", None, t - dt.timedelta(days=200), one), (None, "cross_sell", "dismissed", None, t, one), (1, "cross_sell", "dismissed", None, t, one)]
    assert sorted(map(tuple, payloads.cross_sell_negatives(spark.createDataFrame(rows, names), "2024-02-01 00:00:00").collect())) == [(1, 7), (2, 7)]
    text = payloads.as_json(spark.createDataFrame([(1, "a", None)], "x int, y string, z int"), ["x", "y", "z"], "j").first().j
    assert text == '{"x":1,"y":"a"}'


def test_stratified_folds_are_even_and_whole(spark):
    rnd = random.Random(3)
    rows = []
    for c in range(400):
        rate = 0.8 if c % 9 == 0 else 0.02
        rows += [(c, int(rnd.random() < rate)) for _ in range(rnd.choice([1, 2, 5, 30]))]
    df = spark.createDataFrame(rows + [(None, 1), (None, None)], "client_id long, label int")
    folds = {r.client_id: r.fold for r in scorecard.stratified_folds(df, "client_id", "label", 5).collect()}
    assert set(folds) == {c for c, _ in rows} | {None} and set(folds.values()) == set(range(5))
    count = lambda f, test: sum(test(y) for c, y in rows if folds[c] == f)
    positives, sizes = ([count(f, test) for f in range(5)] for test in (lambda y: y, lambda y: 1))
    most = max(sum(y for c, y in rows if c == i) for i in range(400))
    assert max(positives) - min(positives) <= most and max(sizes) - min(sizes) <= 0.2 * max(sizes)
