"""Tallies of the portfolio sum exactly."""

from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.operators import assortment


def test_overview_sums_values_exactly(spark):
    keys = [F.lit("x").alias(k) for k in ("band", "lifecycle", "action_label", "abc", "xyz")]
    rows = spark.range(20000).select((F.lit(1000000.0001) + F.col("id") % 7).alias("eur_value"), F.lit(50.1).alias("health"), *keys)
    exact = float(sum(Decimal("1000000.0001") + i % 7 for i in range(20000)))
    got = assortment.overview(rows).collect()
    assert len(got) == 6 and {(r.n, r.eur_value, r.avg_health) for r in got} == {(20000, exact, 50.1)}
