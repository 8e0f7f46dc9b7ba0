"""The canonical tables as SQL, put before a query's own text."""

from __future__ import annotations

import re

TABLES = {
    "sale_lines": """SELECT o_orderkey AS order_id, o_custkey AS client_id, o_custkey AS agreement_id, l_partkey AS product_id, l_suppkey AS producer_id,
      p_brand AS group_id, c_nationkey AS region_id, c_nationkey AS manager_id, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
      l_extendedprice / l_quantity AS price, CAST(o_orderdate AS DATE) AS created, CAST(l_shipdate AS DATE) AS shipped, NOT (l_returnflag = 'N' AND l_linestatus = 'F') AS is_valid,
      l_returnflag AS return_flag, l_linestatus AS line_status, l_discount AS discount, l_linenumber AS line_no
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "valid_sales": "SELECT * FROM sale_lines WHERE is_valid AND product_id NOT IN (1)",
    "year_sales": "SELECT * FROM valid_sales WHERE created >= DATE '1999-01-01' AND created < DATE '2000-01-01'",
    "past_sales": "SELECT * FROM valid_sales WHERE created < DATE '2000-01-01'",
    "supply_base": """SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'intl' ELSE 'domestic' END AS source, l_suppkey AS producer_id, l_partkey AS product_id, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
      l_extendedprice / l_quantity AS unit_price, CAST(l_suppkey % 5 AS INTEGER) AS currency_id, CAST(o_orderdate AS DATE) AS event_date,
      CAST(o_orderdate AS DATE) + CAST((date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 121 + 121) % 121 AS INTEGER) AS arrived
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "supply_lines": """SELECT *, 'ordered' AS kind FROM supply_base UNION ALL BY NAME SELECT * REPLACE (arrived AS event_date), 'received' AS kind FROM supply_base WHERE arrived >= event_date""",
    "lots": """SELECT l_partkey AS product_id, CAST(l_shipdate AS DATE) AS received, CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST('0.70' AS DECIMAL(3,2)) AS DECIMAL(20,4)) AS value
      FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O' AND l_partkey NOT IN (1) AND (CASE WHEN l_discount = 0.10::DOUBLE THEN 1 ELSE 2 END) <> 1""",
    "stock_lots": """SELECT l_orderkey * 10 + l_linenumber AS lot_id, l_partkey AS product_id, CAST(l_quantity AS DECIMAL(18,2)) AS qty,
      CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST('0.70' AS DECIMAL(3,2)) AS DECIMAL(20,4)) AS value, l_extendedprice * 0.7::DOUBLE / l_quantity AS unit_cost,
      CASE WHEN l_discount = 0.10::DOUBLE THEN 1 WHEN l_discount > 0 THEN 2 END AS doc_type FROM lineitem
      WHERE l_returnflag = 'A' AND l_linestatus = 'O' AND CAST(l_shipdate AS DATE) >= DATE '1999-01-01' AND CAST(l_shipdate AS DATE) < DATE '2000-01-01' AND l_partkey NOT IN (1) AND (CASE WHEN l_discount = 0.10::DOUBLE THEN 1 ELSE 2 END) <> 1""",
    "return_lines": """SELECT order_id AS return_id, line_no, client_id, product_id, qty, amount, line_status = 'F' AS money_returned, shipped AS return_date FROM sale_lines WHERE return_flag = 'R'""",
    "debt_lines": """SELECT o_orderkey AS debt_id, o_custkey AS client_id, c_nationkey AS manager_id, CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(c_nationkey % 3 AS INTEGER) AS currency_id, CAST(o_orderdate AS DATE) AS created
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O'""",
    "payments": """SELECT o_custkey AS client_id, c_nationkey AS manager_id, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(c_nationkey % 3 AS INTEGER) AS currency_id, CAST(o_orderdate AS DATE) AS from_date
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'""",
    "agreements": """SELECT c_custkey AS client_id, CAST(c_nationkey % 3 AS INTEGER) AS currency_id,
      CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 14 WHEN 'BUILDING' THEN 30 WHEN 'FURNITURE' THEN 45 WHEN 'HOUSEHOLD' THEN 0 ELSE 60 END AS grace_days,
      CAST(greatest(c_acctbal, 0.0::DOUBLE) AS DECIMAL(18,2)) AS amount_limit, c_acctbal > 0 AS control_amount, c_custkey % 2 = 0 AS control_days, c_nationkey AS region_id FROM customer""",
    "fx_rates": """SELECT 1 AS currency_id, make_date(y, h * 6 + 1, 1) AS valid_from, (90 + y % 7 + h) / 100 AS rate FROM halves UNION ALL SELECT 2, make_date(y, h * 6 + 1, 1), (110 + y % 5 - h) / 100 FROM halves""",
    "halves": "SELECT CAST(floor(i / 2) AS INTEGER) AS y, CAST(i % 2 AS INTEGER) AS h FROM range(3980, 4010) t(i)",
    "debt_eur": """SELECT d.*, CAST(d.total AS DOUBLE) * coalesce(f.rate, 1.0::DOUBLE) AS eur FROM debt_lines d LEFT JOIN LATERAL
      (SELECT rate FROM fx_rates f WHERE f.currency_id = d.currency_id AND f.valid_from <= DATE '2000-01-01' ORDER BY valid_from DESC LIMIT 1) f ON true WHERE d.created <= DATE '2000-01-01'""",
    "task_events": """SELECT event_id, concat_ws(':', CAST(user_id AS VARCHAR), json_extract_string(props, '$.k')) AS task_key,
      CASE event_type WHEN 'signup' THEN 'generated' WHEN 'view' THEN 'open' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'done' ELSE 'dismissed' END AS kind,
      user_id AS "by", user_id % 25 AS manager_id, ts AS "at", CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END AS amount FROM events""",
}


def sql(body: str, **own: str) -> str:
    """body after the canonical tables it names, directly or through others; own adds tables of the query."""
    known = TABLES | own
    order: list[str] = []

    def need(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text) and known[name] is not text:
                need(known[name])
                if name not in order:
                    order.append(name)

    need(body)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({known[n]})" for n in order) + "\n" + body
