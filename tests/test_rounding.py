"""Priorities at halves that binary fractions do not hold are rounded as SQL does; their ties decide an inbox's order."""

import duckdb
from pyspark.sql import functions as F

from tidemark.operators import actions


def test_priority_at_halves_equals_sql(spark):
    rows = [(i, 0.3 + 0.25 * (e / (days / n) - 1), min(1.0, 0.4 + 0.1 * (n + 1))) for i, (days, n, e) in enumerate((d, n, e) for d in (250, 500, 1000, 1250, 2000) for n in (2, 3, 4, 5) for e in range(d // n, 3 * d // n, 7))]
    rows += [(-1, 0.3635, 0.7000000000000001), (-2, 0.3935, 0.7000000000000001), (-3, 0.5914999999999999, 0.8), (-4, 0.33949999999999997, 0.7000000000000001)]
    got = spark.createDataFrame(rows, "i long, u double, sure double").select("i", actions.priority(F.col("u"), F.lit(0.0), F.col("sure")).alias("p")).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i BIGINT, u DOUBLE, sure DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    expected = con.execute("SELECT i, round(100 * greatest(0, least(1, 0.5::DOUBLE * u + 0.3::DOUBLE * 0.0::DOUBLE + 0.2::DOUBLE * sure)), 2) FROM t").fetchall()
    assert {r.i: r.p for r in got} == dict(expected)
    assert dict(expected)[-1] == 32.17 and dict(expected)[-3] == 45.58
