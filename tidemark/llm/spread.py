"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64


def salt(by: str) -> Column:
    return F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")


def salts_of(by: str) -> Column:
    """Aggregate: the salts that a key's rows have, as bits of a long. It combines before a shuffle and has a fixed size."""
    return F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64({by}), {SALTS}) as int))"))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], by: str) -> DataFrame:
    """rows joined with the one row of groups that has their keys; groups has a column _salts made by `salts_of(by)`.

    Rows of one key are dealt to up to SALTS tasks by their `by`, and each row of groups goes where its key has rows, so
    that neither a large key meets in one task nor a small one is copied. Inner join; null keys match nothing.
    """
    here = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("_salts", i) == 1)
    sent = groups.withColumn("_salt", F.explode(here)).drop("_salts")
    return rows.withColumn("_salt", salt(by)).join(sent.hint("merge"), [*keys, "_salt"]).drop("_salt")
