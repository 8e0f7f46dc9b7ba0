"""Totals as of many dates in one pass over the events, whatever the number of dates.

A window total at a date is the total of what has entered by then less the total of what has left. An event enters and leaves
once, at the first date on which a condition holds; so it gives a few rows, not one per date, and the totals are running sums
over at most one row per key and date.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import bucket_of


def shifted(dates: list[str], months: int) -> list[str]:
    """Each date some months earlier; a day that the month lacks becomes its last."""
    out = []
    for d in map(dt.date.fromisoformat, dates):
        k = d.year * 12 + d.month - 1 - months
        first, after = dt.date(k // 12, k % 12 + 1, 1), dt.date((k + 1) // 12, (k + 1) % 12 + 1, 1)
        out.append((first + dt.timedelta(days=min(d.day, (after - first).days) - 1)).isoformat())
    return out


def first_at(day: Column, dates: list[str]) -> Column:
    """The index of the first of the ascending dates that is not before day; their number where none is, or day is null."""
    cuts = [float((dt.date.fromisoformat(d) - dt.date(1970, 1, 1)).days) for d in dates]
    return F.when(day.isNull(), len(dates)).otherwise(bucket_of(F.unix_date(day).cast("double"), cuts))


def totals_at(events: DataFrame, keys: list[str], n: int, sums: dict[str, tuple[Column, Column]], lows: dict[str, tuple[Column, Column]] | None = None, highs: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """keys, date_index and the totals: sums of values from the index on at which each begins to count, and the least and largest
    of such values. Each is given as (value, first index). A key has rows from its first event on; indexes of n and more are after all dates.

    Decimal and whole values sum exactly, whatever leaves again.
    """
    every = [(name, "sum", *x) for name, x in sums.items()] + [(name, "min", *x) for name, x in (lows or {}).items()] + [(name, "max", *x) for name, x in (highs or {}).items()]
    types = {name: events.select(value.alias(name)).schema[0].dataType for name, _, value, _ in every}
    steps = [F.struct(at.cast("int").alias("date_index"), *[(value if other == name else F.lit(None).cast(types[other])).alias(other) for other, *_ in every]) for name, _, value, at in every]
    rows = events.select(*keys, F.explode(F.filter(F.array(*steps), lambda s: s["date_index"] < n)).alias("s")).select(*keys, "s.*")
    combine = {"sum": F.sum, "min": F.min, "max": F.max}
    by_date = rows.groupBy(*keys, "date_index").agg(*[combine[how](name).alias(name) for name, how, *_ in every])
    order = Window.partitionBy(*keys).orderBy("date_index")  # at most a row per date
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    running = by_date.select(*keys, "date_index", *[combine[how](name).over(upto).alias(name) for name, how, *_ in every], F.lead("date_index", 1, n).over(order).alias("_next"))
    return running.withColumn("date_index", F.explode(F.sequence("date_index", F.col("_next") - 1))).drop("_next")
