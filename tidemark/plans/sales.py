"""Sales, stock and return aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ranking, sales
from tidemark.plans.base import Plans
from tidemark.sources import canonical as c

P = Plans()
START, END = "1999-01-01", c.AS_OF


def valid(spark, d):
    return c.valid_sales(c.sale_lines(spark, d))


def year(spark, d):
    return sales.window(valid(spark, d), START, END)


def past(spark, d):
    return valid(spark, d).where(F.col("created") < F.lit(END).cast("date"))


@P.add("s1_valid_sales", "SELECT order_id, client_id, product_id, line_no, CAST(qty AS DOUBLE) AS qty, CAST(amount AS DOUBLE) AS amount, CAST(created AS VARCHAR) AS created FROM year_sales")
def s1(spark, d):
    return year(spark, d).select("order_id", "client_id", "product_id", "line_no", F.col("qty").cast("double").alias("qty"), F.col("amount").cast("double").alias("amount"), F.col("created").cast("string").alias("created"))


@P.add("s2_supply_lines", "SELECT kind, source, count(*) AS n, CAST(sum(qty) AS DOUBLE) AS qty FROM supply_lines GROUP BY ALL")
def s2(spark, d):
    return c.supply_lines(spark, d).groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").cast("double").alias("qty"))


@P.add("s3_stock_lots", "SELECT lot_id, product_id, CAST(qty AS DOUBLE) AS qty, CAST(value AS DOUBLE) AS value FROM stock_lots")
def s3(spark, d):
    return c.stock_lots(spark, d).select("lot_id", "product_id", F.col("qty").cast("double").alias("qty"), F.col("value").cast("double").alias("value"))


@P.add("a1_monthly_by_client", "SELECT client_id, strftime(created, '%Y-%m') AS ym, CAST(sum(amount) AS DOUBLE) AS eur FROM year_sales GROUP BY 1, 2")
def a1(spark, d):
    return sales.monthly(year(spark, d), ["client_id"], "amount", "eur")


@P.add("a2_monthly_by_product", "SELECT product_id, strftime(created, '%Y-%m') AS ym, CAST(sum(amount) AS DOUBLE) AS eur FROM year_sales GROUP BY 1, 2")
def a2(spark, d):
    return sales.monthly(year(spark, d), ["product_id"], "amount", "eur")


@P.add(
    "a3_monthly_sets",
    "SELECT coalesce(year_sales.client_id, -1) AS client_id, coalesce(year_sales.product_id, -1) AS product_id, strftime(created, '%Y-%m') AS ym, CAST(grouping(year_sales.client_id, year_sales.product_id, strftime(created, '%Y-%m')) AS BIGINT) AS gid, CAST(sum(amount) AS DOUBLE) AS eur FROM year_sales GROUP BY GROUPING SETS ((year_sales.client_id, strftime(created, '%Y-%m')), (year_sales.product_id, strftime(created, '%Y-%m')), (year_sales.client_id, year_sales.product_id, strftime(created, '%Y-%m')))",
)
def a3(spark, d):
    return sales.monthly_sets(year(spark, d)).fillna(-1, ["client_id", "product_id"])


@P.add("a4_daily_units", "SELECT product_id, CAST(created AS VARCHAR) AS d, CAST(sum(qty) AS DOUBLE) AS units FROM year_sales GROUP BY 1, 2")
def a4(spark, d):
    return year(spark, d).groupBy("product_id", F.col("created").cast("string").alias("d")).agg(F.sum("qty").cast("double").alias("units"))


@P.add("a5_trailing_revenue", "SELECT product_id, CAST(sum(amount) AS DOUBLE) AS revenue FROM year_sales GROUP BY 1")
def a5(spark, d):
    return year(spark, d).groupBy("product_id").agg(F.sum("amount").cast("double").alias("revenue"))


@P.add(
    "a6_velocity",
    "SELECT product_id, CAST(sum(qty) AS DOUBLE) AS sold_qty, count(DISTINCT order_id) AS n_orders, CAST(min(created) AS VARCHAR) AS first_sale, CAST(max(created) AS VARCHAR) AS last_sale, CAST(date_diff('day', max(created), DATE '2000-01-01') AS INTEGER) AS days_since FROM year_sales GROUP BY 1",
)
def a6(spark, d):
    return sales.velocity(year(spark, d), END).withColumns({k: F.col(k).cast("string") for k in ("first_sale", "last_sale")})


@P.add("a7_average_price", "SELECT product_id, CAST(sum(amount) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS avg_price_eur FROM year_sales GROUP BY 1")
def a7(spark, d):
    return sales.average_price(year(spark, d))


@P.add(
    "a8_returns_by_product",
    "SELECT product_id, CAST(sum(qty) AS DOUBLE) AS returned_qty, count(*) AS n_returns, CAST(sum(CASE WHEN money THEN 1 ELSE 0 END) AS BIGINT) AS n_money_returned FROM once GROUP BY 1",
    once="SELECT return_id, line_no, product_id, max(qty) AS qty, bool_or(money_returned) AS money FROM return_lines WHERE return_date >= DATE '1999-01-01' AND return_date < DATE '2000-01-01' GROUP BY 1, 2, 3",
)
def a8(spark, d):
    rets = c.return_lines(spark, d)
    return sales.returns_by_product(rets.where((F.col("return_date") >= F.lit(START).cast("date")) & (F.col("return_date") < F.lit(END).cast("date"))))


@P.add("a9_monthly_units", "SELECT product_id, strftime(created, '%Y-%m') AS ym, CAST(sum(qty) AS DOUBLE) AS units FROM year_sales GROUP BY 1, 2")
def a9(spark, d):
    return sales.monthly(year(spark, d), ["product_id"], "qty", "units")


@P.add("a10_on_hand", "SELECT product_id, CAST(sum(qty) AS DOUBLE) AS qty_on_hand, CAST(sum(value) AS DOUBLE) AS eur_value FROM stock_lots GROUP BY 1")
def a10(spark, d):
    return sales.stock_by_product(c.stock_lots(spark, d))


STOCK_DAYS = [f"{1998 + k // 12}-{k % 12 + 1:02d}-01" for k in range(6, 25)]


@P.add(
    "a10_on_hand_by_month",
    "SELECT product_id, CAST(day AS VARCHAR) AS as_of, CAST(sum(qty) AS DOUBLE) AS qty_on_hand, CAST(sum(value) AS DOUBLE) AS eur_value FROM lots JOIN (SELECT CAST(DATE '1998-07-01' + to_months(CAST(i AS INTEGER)) AS DATE) AS day FROM range(0, 19) t(i)) ON received < day AND received + INTERVAL 12 MONTH >= day GROUP BY 1, 2",
)
def a10_month(spark, d):
    """Stock at past dates from the lot ledger: receipts and issues, their running balances, and a look-up for each month."""
    from tidemark.operators import supply as g

    book = g.ledger(c.lot_movements(spark, d), ["product_id"])
    return g.balances_at(book, ["product_id"], STOCK_DAYS).select("product_id", F.col("as_of").cast("string").alias("as_of"), F.col("qty").cast("double").alias("qty_on_hand"), F.col("value").cast("double").alias("eur_value"))


@P.add(
    "a11_sellable_and_reserved",
    "SELECT coalesce(o.product_id, r.product_id) AS product_id, coalesce(on_hand, 0.0::DOUBLE) AS on_hand, coalesce(reserved, 0.0::DOUBLE) AS reserved FROM onh o FULL JOIN res r ON o.product_id = r.product_id",
    onh="SELECT product_id, CAST(sum(qty) AS DOUBLE) AS on_hand FROM stock_lots GROUP BY 1",
    res="SELECT product_id, CAST(sum(qty) AS DOUBLE) AS reserved FROM valid_sales WHERE line_status = 'O' AND return_flag = 'N' AND created >= DATE '1999-10-01' AND created < DATE '2000-01-01' GROUP BY 1",
)
def a11(spark, d):
    on_hand = c.stock_lots(spark, d).groupBy("product_id").agg(F.sum("qty").cast("double").alias("on_hand"))
    held = sales.window(valid(spark, d).where("line_status = 'O' and return_flag = 'N'"), "1999-10-01", END).groupBy("product_id").agg(F.sum("qty").cast("double").alias("reserved"))
    return on_hand.join(held, "product_id", "full_outer").fillna(0.0, ["on_hand", "reserved"])


@P.add(
    "a12_open_on_order",
    "SELECT product_id, CAST(o AS DOUBLE) - CAST(coalesce(r, 0) AS DOUBLE) AS on_order FROM net WHERE CAST(o AS DOUBLE) - CAST(coalesce(r, 0) AS DOUBLE) > 0.001",
    net="SELECT product_id, sum(CASE WHEN kind = 'ordered' THEN qty END) AS o, sum(CASE WHEN kind = 'received' THEN qty END) AS r FROM supply_lines WHERE event_date < DATE '2000-01-01' GROUP BY 1",
)
def a12(spark, d, as_of=END):
    lines = c.supply_lines(spark, d).where(F.col("event_date") < F.lit(as_of).cast("date"))
    net = lines.groupBy("product_id").agg(F.sum(F.when(F.col("kind") == "ordered", F.col("qty"))).cast("double").alias("o"), F.sum(F.when(F.col("kind") == "received", F.col("qty"))).cast("double").alias("r"))
    return net.select("product_id", (F.col("o") - F.coalesce("r", F.lit(0.0))).alias("on_order")).where("on_order > 0.001")


@P.add("a13_regional_demand", "SELECT product_id, region_id, CAST(sum(qty) AS DOUBLE) AS units, count(DISTINCT order_id) AS n_orders, count(DISTINCT client_id) AS n_clients FROM year_sales GROUP BY 1, 2")
def a13(spark, d):
    return sales.regional_demand(year(spark, d))


@P.add("a14_regional_summary", "SELECT region_id, count(DISTINCT client_id) AS n_clients, count(DISTINCT order_id) AS n_orders, count(DISTINCT product_id) AS n_products, CAST(sum(qty) AS DOUBLE) AS units, CAST(sum(amount) AS DOUBLE) AS revenue_eur FROM year_sales GROUP BY 1")
def a14(spark, d):
    return sales.regional_summary(year(spark, d))


@P.add("a23_panel_cells", "SELECT product_id, agreement_id, strftime(created, '%Y-%m') AS ym, CAST(sum(qty) AS DOUBLE) AS qty, CAST(sum(amount) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS price FROM year_sales GROUP BY 1, 2, 3")
def a23(spark, d):
    return sales.panel_cells(year(spark, d))


@P.add(
    "a24_pooled_panel",
    "SELECT s.group_id, s.product_id, s.agreement_id, strftime(created, '%Y-%m') AS ym, CAST(sum(qty) AS DOUBLE) AS qty FROM year_sales s JOIN top t ON s.group_id = t.group_id AND s.product_id = t.product_id GROUP BY 1, 2, 3, 4",
    top="SELECT group_id, product_id FROM (SELECT group_id, product_id, row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, product_id) AS r FROM year_sales GROUP BY 1, 2) WHERE r <= 400",
)
def a24(spark, d):
    lines = year(spark, d)
    counts = lines.groupBy("group_id", "product_id").count()
    top = ranking.first_per(counts, ["group_id"], [F.col("count").desc(), F.col("product_id")], 400).select("group_id", "product_id")
    return sales.monthly(lines.join(top, ["group_id", "product_id"], "left_semi"), ["group_id", "product_id", "agreement_id"], "qty", "qty")


@P.add("a25_line_counts", "SELECT product_id, count(*) AS n_lines FROM year_sales GROUP BY 1")
def a25(spark, d):
    return year(spark, d).groupBy("product_id").agg(F.count(F.lit(1)).alias("n_lines"))


@P.add("a31_client_features", "SELECT client_id, CAST(sum(amount) AS DOUBLE) AS monetary, count(DISTINCT order_id) AS order_count, CAST(date_diff('day', max(created), DATE '2000-01-01') AS INTEGER) AS recency_days FROM year_sales GROUP BY 1")
def a31(spark, d):
    return sales.client_features(year(spark, d), END)


@P.add(
    "a41_repurchase_rate",
    "SELECT client_id, count(*) AS n_products, round(CAST(sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS rate FROM per GROUP BY 1",
    per="SELECT client_id, group_id, count(DISTINCT order_id) AS n FROM past_sales GROUP BY 1, 2",
)
def a41(spark, d):
    return sales.repurchase_rate(past(spark, d), "group_id").withColumn("rate", F.round("rate", 6))


@P.add(
    "a42_most_frequent",
    "SELECT client_id, group_id, n, CAST(rank AS INTEGER) AS rank FROM (SELECT client_id, group_id, count(DISTINCT order_id) AS n, row_number() OVER (PARTITION BY client_id ORDER BY count(DISTINCT order_id) DESC, group_id) AS rank FROM past_sales GROUP BY 1, 2) WHERE rank <= 3",
)
def a42(spark, d):
    per = past(spark, d).groupBy("client_id", "group_id").agg(F.countDistinct("order_id").alias("n"))
    return ranking.first_per(per, ["client_id"], [F.col("n").desc(), F.col("group_id")], 3)


@P.add("a43_interactions", "SELECT client_id, product_id, count(DISTINCT order_id) AS n_orders FROM past_sales GROUP BY 1, 2")
def a43(spark, d):
    return past(spark, d).groupBy("client_id", "product_id").agg(F.countDistinct("order_id").alias("n_orders"))


@P.add("a48_producers", "SELECT producer_id, count(DISTINCT product_id) AS n_products FROM supply_lines WHERE event_date >= DATE '1999-01-01' AND event_date < DATE '2000-01-01' GROUP BY 1")
def a48(spark, d):
    lines = c.supply_lines(spark, d).where((F.col("event_date") >= F.lit(START).cast("date")) & (F.col("event_date") < F.lit(END).cast("date")))
    return lines.groupBy("producer_id").agg(F.countDistinct("product_id").alias("n_products"))


@P.add("a49_active_sets", "SELECT 'product' AS kind, product_id AS id FROM year_sales GROUP BY 2 UNION ALL SELECT 'client', client_id FROM year_sales GROUP BY 2")
def a49(spark, d):
    lines = year(spark, d)
    return lines.select(F.lit("product").alias("kind"), F.col("product_id").alias("id")).distinct().union(lines.select(F.lit("client"), "client_id").distinct())


@P.add("a51_manager_months", "SELECT manager_id, strftime(created, '%Y-%m') AS ym, CAST(sum(amount) AS DOUBLE) AS eur FROM year_sales GROUP BY 1, 2")
def a51(spark, d):
    return sales.monthly(year(spark, d), ["manager_id"], "amount", "eur")


@P.add("p3_ubiquitous_products", "SELECT product_id FROM year_sales GROUP BY 1 HAVING count(DISTINCT client_id) > 0.20 * (SELECT count(DISTINCT client_id) FROM year_sales) UNION SELECT 1")
def p3(spark, d):
    return sales.ubiquitous_products(year(spark, d), 0.20)


@P.add("j3_orders_with_a_real_line", "SELECT DISTINCT o_orderkey AS order_id FROM orders WHERE EXISTS (SELECT 1 FROM valid_sales v WHERE v.order_id = o_orderkey)")
def j3(spark, d):
    return c.read(spark, d, "orders").select(F.col("o_orderkey").alias("order_id")).join(valid(spark, d), "order_id", "left_semi").distinct()


@P.add("j4_clients_without_debt", "SELECT client_id FROM agreements WHERE NOT EXISTS (SELECT 1 FROM debt_lines d WHERE d.client_id = agreements.client_id)")
def j4(spark, d):
    return c.agreements(spark, d).join(c.debt_lines(spark, d), "client_id", "left_anti").select("client_id")


@P.add("j5_first_group", "SELECT product_id, min_by(group_id, order_id * 100 + line_no) AS group_id FROM valid_sales GROUP BY 1")
def j5(spark, d):
    return valid(spark, d).groupBy("product_id").agg(F.min_by("group_id", F.col("order_id") * 100 + F.col("line_no")).alias("group_id"))


@P.add("u3_sku_universe", "SELECT product_id FROM stock_lots UNION SELECT product_id FROM year_sales")
def u3(spark, d):
    return c.stock_lots(spark, d).select("product_id").union(year(spark, d).select("product_id")).distinct()


ABC_SQL = "SELECT product_id, CAST(sum(amount) AS DECIMAL(38,2)) AS revenue FROM year_sales GROUP BY 1"


@P.add("x1_running_sum", "SELECT product_id, CAST(revenue AS DOUBLE) AS revenue, CAST(sum(revenue) OVER (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM rev", rev=ABC_SQL)
def x1(spark, d):
    rev = year(spark, d).groupBy("product_id").agg(F.sum("amount").alias("revenue"))
    return ranking.running_sum(rev, "revenue", "product_id").select("product_id", F.col("revenue").cast("double").alias("revenue"), F.col("running").cast("double").alias("running"))


@P.add(
    "w1_abc_exclusive",
    "SELECT product_id, CASE WHEN before / total < 0.80 THEN 'A' WHEN before / total < 0.95 THEN 'B' ELSE 'C' END AS abc FROM run",
    rev=ABC_SQL,
    run="SELECT product_id, CAST(sum(revenue) OVER (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING) - revenue AS DOUBLE) AS before, CAST(sum(revenue) OVER () AS DOUBLE) AS total FROM rev",
)
def w1(spark, d):
    rev = year(spark, d).groupBy("product_id").agg(F.sum("amount").alias("revenue"))
    return ranking.abc_exclusive(rev, "revenue", "product_id").select("product_id", "abc")


@P.add(
    "w2_abc_inclusive",
    "SELECT product_id, CASE WHEN upto / total <= 0.80 THEN 'A' WHEN upto / total <= 0.95 THEN 'B' ELSE 'C' END AS abc FROM run",
    rev=ABC_SQL,
    run="SELECT product_id, CAST(sum(revenue) OVER (ORDER BY revenue DESC, product_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS upto, CAST(sum(revenue) OVER () AS DOUBLE) AS total FROM rev",
)
def w2(spark, d):
    rev = year(spark, d).groupBy("product_id").agg(F.sum("amount").alias("revenue"))
    return ranking.abc_inclusive(rev, "revenue", "product_id").select("product_id", "abc")


@P.add("w3_last_order", "SELECT client_id, order_id, CAST(created AS VARCHAR) AS created FROM (SELECT client_id, order_id, created, row_number() OVER (PARTITION BY client_id ORDER BY created DESC, order_id DESC, line_no) AS r FROM past_sales) WHERE r = 1")
def w3(spark, d):
    last = past(spark, d).groupBy("client_id").agg(F.max(F.struct("created", "order_id")).alias("x"))
    return last.select("client_id", "x.order_id", F.col("x.created").cast("string").alias("created"))


@P.add("w5_most_active", "SELECT client_id, count(DISTINCT strftime(created, '%Y-%m')) AS months, CAST(sum(amount) AS DOUBLE) AS eur FROM year_sales GROUP BY 1 ORDER BY months DESC, eur DESC, client_id LIMIT 100")
def w5(spark, d):
    per = year(spark, d).groupBy("client_id").agg(F.countDistinct(F.date_format("created", "yyyy-MM")).alias("months"), F.sum("amount").cast("double").alias("eur"))
    return per.orderBy(F.desc("months"), F.desc("eur"), "client_id").limit(100)
