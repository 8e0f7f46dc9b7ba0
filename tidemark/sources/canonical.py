"""The canonical tables, each derived lazily from the supplied Parquet tables.

Sales validity is a flag, never the absence of a deletion mark; the synthetic product is dropped from sales and stock
but debt keeps everything. All time windows key off the order's own date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import half_open

AS_OF = "2000-01-01"
SYNTHETIC_IDS = (1,)
#: Lots of this document type come from the debt import and are no stock.
DEBT_IMPORT = 1


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sale_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its client, product, group, region and manager. Money is exact decimal."""
    lines, orders = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "orders")
    clients, parts = read(spark, sf_dir, "customer"), read(spark, sf_dir, "part")
    spine = (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(clients, orders.o_custkey == clients.c_custkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
    )
    return spine.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("client_id"),
        F.col("o_custkey").alias("agreement_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("producer_id"),
        F.col("p_brand").alias("group_id"),
        F.col("c_nationkey").alias("region_id"),
        F.col("c_nationkey").alias("manager_id"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.to_date("o_orderdate").alias("created"),
        F.to_date("l_shipdate").alias("shipped"),
        (~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"))).alias("is_valid"),
        F.col("l_returnflag").alias("return_flag"),
        F.col("l_linestatus").alias("line_status"),
        F.col("l_discount").alias("discount"),
        F.col("l_linenumber").alias("line_no"),
    )


def valid_sales(lines: DataFrame, synthetic_ids=SYNTHETIC_IDS) -> DataFrame:
    """The only way to read sales: valid lines of real products."""
    return lines.where(F.col("is_valid") & ~F.col("product_id").isin(*synthetic_ids))


def supply_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered and received supply of both origins in one table: kind, source, producer, product, qty, price, dates.

    An order arrives 0 to 120 days after it was placed. Currencies: 0 EUR, 1 USD, 2 PLN, 3 domestic, 4 none known.
    """
    took = F.pmod(F.datediff("l_shipdate", "o_orderdate"), F.lit(121))
    lines = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    base = lines.select(
        F.when(F.col("l_suppkey") % 2 == 0, "intl").otherwise("domestic").alias("source"),
        F.col("l_suppkey").alias("producer_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        (F.col("l_suppkey") % 5).cast("int").alias("currency_id"),
        F.to_date("o_orderdate").alias("event_date"),
        F.date_add(F.to_date("o_orderdate"), took).alias("arrived"),
    )
    ordered = base.withColumn("kind", F.lit("ordered"))
    received = base.where("arrived >= event_date").withColumn("kind", F.lit("received")).withColumn("event_date", F.col("arrived"))
    return ordered.unionByName(received)


def lots(spark: SparkSession, sf_dir: str, exclude_doc_type: int | None = DEBT_IMPORT) -> DataFrame:
    """Sellable lots of all times: the day received, product, quantity, value, unit cost and origin document. A lot without an
    origin counts as stock."""
    all_lots = read(spark, sf_dir, "lineitem").where("l_returnflag = 'A' and l_linestatus = 'O'").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("lot_id"),
        F.col("l_partkey").alias("product_id"),
        F.to_date("l_shipdate").alias("received"),
        F.col("l_quantity").cast("decimal(18,2)").alias("qty"),
        (F.col("l_extendedprice").cast("decimal(18,2)") * F.lit("0.70").cast("decimal(3,2)")).cast("decimal(20,4)").alias("value"),
        (F.col("l_extendedprice") * 0.7 / F.col("l_quantity")).alias("unit_cost"),
        F.when(F.col("l_discount") == 0.10, 1).when(F.col("l_discount") > 0.0, 2).alias("doc_type"),
    )
    real = all_lots.where(~F.col("product_id").isin(*SYNTHETIC_IDS))
    return real if exclude_doc_type is None else real.where(F.col("doc_type").isNull() | (F.col("doc_type") != exclude_doc_type))


def stock_lots(spark: SparkSession, sf_dir: str, exclude_doc_type: int | None = DEBT_IMPORT) -> DataFrame:
    """Lots with stock at AS_OF: those of the year before; older ones are sold."""
    return lots(spark, sf_dir, exclude_doc_type).where(half_open(F.col("received"), "1999-01-01", AS_OF)).drop("received")


def lot_movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts and issues of lots as signed rows (product_id, day, kind, qty, value): a lot is in stock from the day after it is
    received, and is issued a year later."""
    every = lots(spark, sf_dir)
    sides = [("receipt", F.date_add("received", 1), 1), ("issue", F.date_add(F.add_months("received", 12), 1), -1)]
    moves = F.array(*[F.struct(day.alias("day"), F.lit(kind).alias("kind"), (F.col("qty") * sign).alias("qty"), (F.col("value") * sign).alias("value")) for kind, day, sign in sides])
    return every.select("product_id", F.explode(moves).alias("m")).select("product_id", "m.*")


def return_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned lines by their own date; the same (return, line) can appear more than once."""
    return sale_lines(spark, sf_dir).where("return_flag = 'R'").select(
        F.col("order_id").alias("return_id"), "line_no", "client_id", "product_id", "qty", "amount", (F.col("line_status") == "F").alias("money_returned"), F.col("shipped").alias("return_date")
    )


def debt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open debt: client, amount in its own currency, date. The synthetic product stays in debt."""
    orders, clients = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.where("o_orderstatus = 'O'").join(clients, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("debt_id"), F.col("o_custkey").alias("client_id"), F.col("c_nationkey").alias("manager_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("total"), (F.col("c_nationkey") % 3).cast("int").alias("currency_id"), F.to_date("o_orderdate").alias("created")
    )


def curated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchase terms that buyers set by hand, for every tenth product: minimum quantity and order multiple."""
    lines = read(spark, sf_dir, "lineitem").where("l_partkey % 10 = 0")
    return lines.select(F.col("l_suppkey").alias("producer_id"), F.col("l_partkey").alias("product_id")).distinct().select("producer_id", "product_id", F.lit(12.0).alias("moq"), F.lit(6.0).alias("multiple"))


def quantity_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buyers' changes to suggested quantities by producer and class; discount and tax stand in for the changes."""
    k = F.col("l_partkey") % 10
    return read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("producer_id"), F.when(k < 2, "A").when(k < 5, "B").otherwise("C").alias("abc"), ((1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("ratio"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, clients = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.where("o_orderstatus = 'F'").join(clients, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("client_id"), F.col("c_nationkey").alias("manager_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("amount"), (F.col("c_nationkey") % 3).cast("int").alias("currency_id"), F.to_date("o_orderdate").alias("from_date")
    )


def agreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agreement per client: currency, grace days by segment, limit from the balance, control flags."""
    grace = F.when(F.col("c_mktsegment") == "AUTOMOBILE", 14).when(F.col("c_mktsegment") == "BUILDING", 30).when(F.col("c_mktsegment") == "FURNITURE", 45).when(F.col("c_mktsegment") == "HOUSEHOLD", 0).otherwise(60)
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("client_id"), (F.col("c_nationkey") % 3).cast("int").alias("currency_id"), grace.cast("int").alias("grace_days"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).cast("decimal(18,2)").alias("amount_limit"), (F.col("c_acctbal") > 0).alias("control_amount"), (F.col("c_custkey") % 2 == 0).alias("control_days"), F.col("c_nationkey").alias("region_id"),
    )


def fx_rates(spark: SparkSession) -> DataFrame:
    """Rate to EUR by currency and first valid day: two half-years a year, currencies 1 and 2; 0 is EUR itself."""
    halves = spark.range(1990 * 2, 2005 * 2).select((F.col("id") / 2).cast("int").alias("y"), (F.col("id") % 2).cast("int").alias("h"))
    days = halves.select(F.make_date("y", F.col("h") * 6 + 1, F.lit(1)).alias("valid_from"), "y", "h")
    one = days.select(F.lit(1).alias("currency_id"), "valid_from", ((90 + F.col("y") % 7 + F.col("h")) / 100).alias("rate"))
    two = days.select(F.lit(2).alias("currency_id"), "valid_from", ((110 + F.col("y") % 5 - F.col("h")) / 100).alias("rate"))
    return one.union(two)


def task_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only task log from the event stream: key, kind, time, amount, owner."""
    kind = F.when(F.col("event_type") == "signup", "generated").when(F.col("event_type") == "view", "open").when(F.col("event_type") == "click", "in_progress").when(F.col("event_type") == "purchase", "done").otherwise("dismissed")
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        "event_id", F.concat_ws(":", F.col("user_id").cast("string"), k).alias("task_key"), kind.alias("kind"), F.col("user_id").alias("by"), (F.col("user_id") % 25).alias("manager_id"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)")).alias("amount")
    )
