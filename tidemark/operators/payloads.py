"""Task payloads as JSON text: typed reading with a place for what does not parse, lists as rows, and back to text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids come as numbers or as text, so they are read as text and cast.
PRODUCTS = "products array<struct<product_id: string, score: double>>"


def parsed(df: DataFrame, column: str, schema: str, out: str = "parsed", corrupt: str = "corrupt") -> DataFrame:
    """Adds out, the typed JSON of a text column, and corrupt, the text where it is no JSON of that shape.

    Null text gives null for both; a missing field is null; fields that the schema does not name are left out.
    """
    typed = F.from_json(F.col(column), f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    df = df.withColumn("_typed", typed)
    bad = F.col("_typed._corrupt")
    return df.withColumns({out: F.when(bad.isNull(), F.col("_typed").dropFields("_corrupt")), corrupt: bad}).drop("_typed")


def as_json(df: DataFrame, fields: list[str], out: str) -> DataFrame:
    """Adds out, the fields as one JSON object; null fields are left out of it."""
    return df.withColumn(out, F.to_json(F.struct(*fields)))


def product_rows(tasks: DataFrame, column: str = "payload") -> DataFrame:
    """The tasks' rows once per product of their payload, with product_id and score. Payloads that do not parse, without a list, and
    entries without a whole number as id give none."""
    rows = parsed(tasks, column, PRODUCTS).withColumn("_p", F.explode("parsed.products"))
    kept = [c for c in tasks.columns if c not in ("product_id", "score")]
    return rows.select(*kept, F.expr("try_cast(_p.product_id as bigint)").alias("product_id"), F.col("_p.score").alias("score")).where("product_id is not null")


def cross_sell_negatives(tasks: DataFrame, now: str, days: int = 90) -> DataFrame:
    """(client_id, product_id) that managers turned down: products of cross-sell tasks dismissed, or done without a sale, in the last
    days. tasks has client_id, task_type, status, sold, updated_at and payload."""
    since = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days))
    down = (F.col("status") == "dismissed") | ((F.col("status") == "done") & (F.col("sold") == F.lit(False)))
    some = tasks.where((F.col("task_type") == "cross_sell") & (F.col("updated_at") >= since) & down & F.col("client_id").isNotNull())
    return product_rows(some).select("client_id", "product_id").distinct()
