"""Totals at many dates against one pass per date."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators import asof


def test_shifted_dates_keep_to_the_month():
    assert asof.shifted(["2000-02-29", "2000-03-31", "2001-01-15"], 1) == ["2000-01-29", "2000-02-29", "2000-12-15"]
    assert asof.shifted(["2000-02-29", "2000-03-31"], 12) == ["1999-02-28", "1999-03-31"]


def test_totals_equal_a_pass_per_date(spark):
    rnd = random.Random(9)
    day = dt.date(2000, 1, 1)
    events = [(rnd.randrange(6), day + dt.timedelta(days=rnd.randrange(500)), rnd.randrange(-5, 50)) for _ in range(400)] + [(7, dt.date(2005, 1, 1), 1), (8, None, 1), (9, dt.date(1990, 1, 1), 3)]
    dates = ["2000-02-29", "2000-03-01", "2000-08-31", "2001-01-01", "2001-06-30"]
    df = spark.createDataFrame(events, "k int, day date, v long")
    at, gone = asof.first_at(F.col("day"), dates), asof.first_at(F.col("day"), asof.shifted(dates, 3))
    got = asof.totals_at(df, ["k"], len(dates), {"come": (F.col("v"), at), "gone": (F.col("v"), gone)}, {"low": (F.col("day"), at)}, {"high": (F.col("v"), at)}).collect()
    back = [dt.date.fromisoformat(x) for x in asof.shifted(dates, 3)]
    want = {}
    for i, t in enumerate(map(dt.date.fromisoformat, dates)):
        for k in {e[0] for e in events}:
            seen = [e for e in events if e[0] == k and e[1] is not None and e[1] <= t]
            if seen:
                want[k, i] = (sum(e[2] for e in seen if e[1] > back[i]), min(e[1] for e in seen), max(e[2] for e in seen))
    assert {(r.k, r.date_index): (r.come - (r.gone or 0), r.low, r.high) for r in got} == want
    assert asof.totals_at(df.limit(0), ["k"], len(dates), {"come": (F.col("v"), at)}).count() == 0
