"""Aggregations of the sales, stock and return spines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import half_open, month_of


def monthly(sales: DataFrame, keys: list[str], measure: str, out: str) -> DataFrame:
    """Sum of measure by keys and calendar month."""
    return sales.groupBy(*keys, month_of(F.col("created")).alias("ym")).agg(F.sum(measure).cast("double").alias(out))


def monthly_sets(sales: DataFrame) -> DataFrame:
    """Monthly value by client, by product and by both in one pass."""
    keyed = sales.withColumn("ym", month_of(F.col("created")))
    sets = keyed.groupingSets([["client_id", "ym"], ["product_id", "ym"], ["client_id", "product_id", "ym"]], "client_id", "product_id", "ym")
    return sets.agg(F.grouping_id().cast("long").alias("gid"), F.sum("amount").cast("double").alias("eur"))


def velocity(sales: DataFrame, as_of: str) -> DataFrame:
    return sales.groupBy("product_id").agg(
        F.sum("qty").cast("double").alias("sold_qty"),
        F.countDistinct("order_id").alias("n_orders"),
        F.min("created").alias("first_sale"),
        F.max("created").alias("last_sale"),
        F.datediff(F.lit(as_of).cast("date"), F.max("created")).alias("days_since"),
    )


def average_price(sales: DataFrame) -> DataFrame:
    """Quantity-weighted price; null where nothing was sold."""
    q = F.sum("qty").cast("double")
    return sales.groupBy("product_id").agg((F.sum("amount").cast("double") / F.nullif(q, F.lit(0.0))).alias("avg_price_eur"))


def returns_by_product(returns: DataFrame) -> DataFrame:
    """Each (return, line) counts once with its largest quantity, then sums by product."""
    once = returns.groupBy("return_id", "line_no", "product_id").agg(F.max("qty").alias("qty"), F.max("money_returned").alias("money"))
    return once.groupBy("product_id").agg(F.sum("qty").cast("double").alias("returned_qty"), F.count(F.lit(1)).alias("n_returns"), F.sum(F.col("money").cast("long")).alias("n_money_returned"))


def stock_by_product(lots: DataFrame) -> DataFrame:
    return lots.groupBy("product_id").agg(F.sum("qty").cast("double").alias("qty_on_hand"), F.sum("value").cast("double").alias("eur_value"))


def regional_demand(sales: DataFrame) -> DataFrame:
    return sales.groupBy("product_id", "region_id").agg(F.sum("qty").cast("double").alias("units"), F.countDistinct("order_id").alias("n_orders"), F.countDistinct("client_id").alias("n_clients"))


def regional_summary(sales: DataFrame) -> DataFrame:
    return sales.groupBy("region_id").agg(F.countDistinct("client_id").alias("n_clients"), F.countDistinct("order_id").alias("n_orders"), F.countDistinct("product_id").alias("n_products"), F.sum("qty").cast("double").alias("units"), F.sum("amount").cast("double").alias("revenue_eur"))


def panel_cells(sales: DataFrame) -> DataFrame:
    """(product, agreement, month): quantity and quantity-weighted price."""
    q = F.sum("qty").cast("double")
    return sales.groupBy("product_id", "agreement_id", month_of(F.col("created")).alias("ym")).agg(q.alias("qty"), (F.sum("amount").cast("double") / F.nullif(q, F.lit(0.0))).alias("price"))


def client_features(sales: DataFrame, as_of: str) -> DataFrame:
    return sales.groupBy("client_id").agg(F.sum("amount").cast("double").alias("monetary"), F.countDistinct("order_id").alias("order_count"), F.datediff(F.lit(as_of).cast("date"), F.max("created")).alias("recency_days"))


def repurchase_rate(sales: DataFrame, key: str = "product_id") -> DataFrame:
    """Share of a client's products (or groups) bought in two or more orders."""
    per = sales.groupBy("client_id", key).agg(F.countDistinct("order_id").alias("n"))
    return per.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_products"), (F.sum((F.col("n") >= 2).cast("long")) / F.count(F.lit(1))).alias("rate"))


def ubiquitous_products(sales: DataFrame, share: float, synthetic_ids=(1,)) -> DataFrame:
    """Products bought by more than share of all distinct clients, and the synthetic ones."""
    total = sales.agg(F.countDistinct("client_id").alias("total"))
    common = sales.groupBy("product_id").agg(F.countDistinct("client_id").alias("n")).join(F.broadcast(total)).where(F.col("n") > share * F.col("total")).select("product_id")
    extra = sales.sparkSession.createDataFrame([(i,) for i in synthetic_ids], "product_id long")
    return common.union(extra).distinct()


def window(sales: DataFrame, start: str, end: str) -> DataFrame:
    return sales.where(half_open(F.col("created"), start, end))
