"""Independent SQL for the warehouse queries (DuckDB dialect)."""

from __future__ import annotations

from tidemark.plans.marketplace_sql import ref

_TRIM = "upper(trim({0}, ' \t\r\n'))"
_N = "CAST(NULL AS VARCHAR)"
_TS = "CAST(NULL AS TIMESTAMP)"

# --- The entities over the classic tables -----------------------------------------------

_CLASSIC = {
    "customers": f"SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS first_name, c_mktsegment AS last_name, {_N} AS email, {_N} AS phone_number, {_N} AS document_number, CAST(NULL AS DATE) AS birth_date, CAST(NULL AS BOOLEAN) AS is_active, {_TS} AS created_at, {_TS} AS updated_at, {_TS} AS deleted_at FROM customer",
    "orders": f"SELECT CAST(o_orderkey AS VARCHAR) AS order_id, o_orderpriority AS order_number, CAST(o_custkey AS VARCHAR) AS customer_id, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(19,4)) AS total_amount, CAST(NULL AS DECIMAL(19,4)) AS shipping_amount, o_orderdate AS created_at, {_TS} AS updated_at FROM orders",
    "order_items": "SELECT l_orderkey || '-' || l_linenumber AS order_item_id, CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_quantity AS INTEGER) AS quantity, CAST(CAST((2 * CAST(CAST(l_extendedprice AS DECIMAL(19,4)) * 10000 AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(15,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL(19,4)) AS unit_price, CAST(l_extendedprice AS DECIMAL(19,4)) AS total_price, l_shipdate AS created_at FROM lineitem",
    "products": f"SELECT CAST(p_partkey AS VARCHAR) AS product_id, CAST(p_partkey % 100 AS VARCHAR) AS seller_id, p_type AS category_id, {_N} AS sku, p_name AS name, {_N} AS description, p_brand AS brand, CAST(p_retailprice AS DECIMAL(19,4)) AS price, CAST(NULL AS DECIMAL(10,3)) AS weight, CAST(NULL AS DECIMAL(10,2)) AS height, CAST(NULL AS DECIMAL(10,2)) AS width, CAST(NULL AS DECIMAL(10,2)) AS length, {_N} AS status, CAST(NULL AS BOOLEAN) AS is_active, {_TS} AS created_at, {_TS} AS updated_at, {_TS} AS deleted_at FROM part",
    "sellers": f"SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, s_name AS company_name, {_N} AS trade_name, {_N} AS document_number, {_N} AS email, {_N} AS phone_number, s_acctbal > 0 AS is_active, {_TS} AS created_at, {_TS} AS updated_at, {_TS} AS deleted_at FROM supplier",
    "categories": f"SELECT DISTINCT p_type AS category_id, {_N} AS parent_category_id, lower(p_type) AS name, {_N} AS description, CAST(NULL AS BOOLEAN) AS is_active, {_TS} AS created_at, {_TS} AS updated_at FROM part",
    "payments": f"SELECT 'pay-' || o_orderkey AS payment_id, CAST(o_orderkey AS VARCHAR) AS order_id, {_N} AS payment_method_id, {_N} AS transaction_code, CAST(o_totalprice AS DECIMAL(19,4)) AS amount, 'PAID' AS status, {_TS} AS authorized_at, o_orderdate AS paid_at, {_TS} AS created_at, {_TS} AS updated_at FROM orders WHERE o_orderstatus <> 'O'",
    "order_status_history": f"SELECT CAST(event_id AS VARCHAR) AS history_id, CAST(user_id AS VARCHAR) AS order_id, {_N} AS previous_status, upper(event_type) AS current_status, ts AS changed_at FROM events",
}

# --- The entities over the marketplace tables ----------------------------------------------


#: Time columns with a zone; results show them as UTC without one.
_TIMES = {
    "marketplace_orders": ("created_at", "updated_at", "processed_at"),
    "order_items": ("created_at", "processed_at"),
    "payments": ("authorized_at", "paid_at", "created_at", "updated_at", "processed_at"),
    "products": ("created_at", "updated_at", "deleted_at", "processed_at"),
    "categories": ("created_at", "updated_at", "processed_at"),
}


def _utc(table: str) -> str:
    return f"(SELECT * REPLACE ({', '.join(f'{c} AT TIME ZONE \'UTC\' AS {c}' for c in _TIMES[table])}) FROM {table})"


def _last(table: str, key: str, order: str, columns: str, where: str = "") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {ref(key)} ORDER BY {order}) AS rn FROM {_utc(table)} WHERE {ref(key)} IS NOT NULL{where}) WHERE rn = 1"


_STATUS = _TRIM.format("status")
_MARKET = {
    "orders": _last("marketplace_orders", "order_id", "updated_at DESC, processed_at DESC", f"{ref('order_id')} AS order_id, order_number, {ref('customer_id')} AS customer_id, {_STATUS} AS status, total_amount, shipping_amount, created_at, updated_at"),
    "order_items": _last("order_items", "order_item_id", "processed_at DESC", f"{ref('order_item_id')} AS order_item_id, {ref('order_id')} AS order_id, {ref('product_id')} AS product_id, quantity, unit_price, total_price, created_at"),
    "products": _last("products", "product_id", "updated_at DESC, processed_at DESC", f"{ref('product_id')} AS product_id, {ref('seller_id')} AS seller_id, {ref('category_id')} AS category_id, sku, name, description, brand, price, weight, height, width, length, {_STATUS} AS status, is_active, created_at, updated_at, deleted_at"),
    "payments": _last("payments", "order_id", "updated_at DESC, processed_at DESC, payment_id DESC", f"payment_id, {ref('order_id')} AS order_id, payment_method_id, transaction_code, amount, {_STATUS} AS status, authorized_at, paid_at, created_at, updated_at"),
    "categories": _last("categories", "category_id", "updated_at DESC, processed_at DESC", f"{ref('category_id')} AS category_id, {ref('parent_category_id')} AS parent_category_id, name, description, is_active, created_at, updated_at"),
    "order_status_history": f"SELECT order_id || '|' || epoch_us(changed_at) || '|' || current_status AS history_id, order_id, {_N} AS previous_status, current_status, changed_at FROM (SELECT DISTINCT {ref('order_id')} AS order_id, {_STATUS} AS current_status, updated_at AS changed_at FROM {_utc('marketplace_orders')})",
    "sellers": "SELECT DISTINCT seller_id, 'Seller ' || left(seller_id, 8) AS company_name, CAST(NULL AS BOOLEAN) AS is_active FROM e_products WHERE seller_id IS NOT NULL",
}


def _with(entities: dict[str, str]) -> str:
    return "WITH " + ",\n".join(f"e_{n} AS ({sql})" for n, sql in entities.items())


# --- Models ------------------------------------------------------------------------------------

_FACTS = """, f_orders AS (
  SELECT o.order_id, o.order_number, o.customer_id, o.status AS order_status, o.total_amount, o.shipping_amount, o.created_at, o.updated_at,
         coalesce(l.item_count, 0) AS item_count, CAST(coalesce(l.total_quantity, 0) AS BIGINT) AS total_quantity,
         p.payment_id, p.status AS payment_status, p.payment_method_id, p.paid_at, x.delivered_at,
         ntile(3) OVER (ORDER BY o.total_amount ASC NULLS LAST, o.order_id) AS order_value_tier,
         year(o.created_at) AS order_year, month(o.created_at) AS order_month
  FROM e_orders o
  LEFT JOIN (SELECT order_id, count(*) AS item_count, sum(quantity) AS total_quantity FROM e_order_items GROUP BY 1) l ON o.order_id = l.order_id
  LEFT JOIN e_payments p ON o.order_id = p.order_id
  LEFT JOIN (SELECT order_id, min(changed_at) AS delivered_at FROM e_order_status_history WHERE current_status = 'DELIVERED' GROUP BY 1) x ON o.order_id = x.order_id
), f_items AS (
  SELECT i.order_item_id, i.order_id, i.product_id, i.quantity, i.unit_price, i.total_price, i.created_at AS order_item_created_at,
         o.order_number, o.status AS order_status, o.customer_id, p.name AS product_name, p.sku AS product_sku, p.price AS product_price,
         p.category_id, p.seller_id, s.company_name AS seller_name, c.name AS category_name
  FROM e_order_items i LEFT JOIN e_orders o ON i.order_id = o.order_id LEFT JOIN e_products p ON i.product_id = p.product_id
  LEFT JOIN e_sellers s ON p.seller_id = s.seller_id LEFT JOIN e_categories c ON p.category_id = c.category_id
), f_steps AS (
  SELECT h.history_id, h.order_id, h.previous_status, h.current_status, h.changed_at,
         date_sub('second', coalesce(lag(h.changed_at) OVER (PARTITION BY h.order_id ORDER BY h.changed_at, h.history_id), o.created_at), h.changed_at) AS duration_in_previous_status_seconds
  FROM e_order_status_history h LEFT JOIN e_orders o ON h.order_id = o.order_id
)
"""

_MODEL_SQL = {
    "dim_customers": "SELECT * FROM e_customers",
    "dim_products": "SELECT p.product_id, p.seller_id, p.category_id, p.sku, p.name AS product_name, p.description, p.brand, p.price, p.weight, p.height, p.width, p.length, p.status AS product_status, p.is_active, p.created_at, p.updated_at, p.deleted_at, s.company_name AS seller_name, s.is_active AS seller_is_active, c.name AS category_name FROM e_products p LEFT JOIN e_sellers s ON p.seller_id = s.seller_id LEFT JOIN e_categories c ON p.category_id = c.category_id",
    "int_order_items_enriched": "SELECT * FROM f_items",
    "fact_orders": "SELECT * FROM f_orders",
    "fact_orders_untiered": "SELECT * EXCLUDE (order_value_tier) FROM f_orders",
    "fact_order_status_transitions": "SELECT * FROM f_steps",
    "dash_total_orders": "SELECT count(*) AS total_orders FROM f_orders",
    "dash_orders_by_status": "SELECT order_status, count(*) AS total_orders, CASE order_status WHEN 'PENDING' THEN 1 WHEN 'PAID' THEN 2 WHEN 'PROCESSING' THEN 3 WHEN 'SHIPPED' THEN 4 WHEN 'DELIVERED' THEN 5 WHEN 'CANCELLED' THEN 6 END AS status_order FROM f_orders GROUP BY order_status",
    "dash_top_products": "SELECT product_id, product_name, CAST(sum(total_price) AS DECIMAL(38,4)) AS revenue, count(*) AS line_items FROM f_items GROUP BY 1, 2 ORDER BY revenue DESC NULLS LAST, product_id LIMIT 10",
    "dash_top_sellers": "SELECT seller_id, seller_name, count(DISTINCT order_id) AS total_orders FROM f_items GROUP BY 1, 2 ORDER BY total_orders DESC, seller_id NULLS LAST LIMIT 10",
    "dash_average_order_value": "SELECT CAST(round(CAST(sum(total_amount) AS DECIMAL(38,8)) / count(total_amount), 4) AS DECIMAL(19,4)) AS average_order_value FROM f_orders",
    "kpi_status_rate": "SELECT avg(CASE WHEN order_status = 'CANCELLED' THEN 1.0 WHEN order_status IS NOT NULL THEN 0.0 END) AS cancel_rate, avg(date_sub('second', created_at, delivered_at) / 3600.0) AS mean_delivery_hours FROM f_orders",
    "kpi_time_in_status": "SELECT current_status, avg(duration_in_previous_status_seconds) AS mean_seconds, count(*) AS steps FROM f_steps GROUP BY 1",
}

_C, _M = _with(_CLASSIC), _with(_MARKET)

ORACLES = {f"stg_{e}": f"{_C} SELECT * FROM e_{e}" for e in _CLASSIC}
ORACLES |= {f"market_stg_{e}": f"{_M} SELECT * FROM e_{e}" for e in ("orders", "order_items", "products", "payments", "categories", "order_status_history")}
ORACLES |= {n: _C + _FACTS + sql for n, sql in _MODEL_SQL.items()}
ORACLES |= {f"market_{n}": _M + _FACTS + sql for n, sql in _MODEL_SQL.items() if n != "dim_customers"}



ORACLES |= {
    "silver_trim_normalize": "SELECT c_custkey AS customer_key, trim('  ' || c_name || ' ') AS full_name, trim(c_mktsegment) AS market_segment, c_acctbal AS acct_bal FROM customer",
    "silver_dedup_exact": f"SELECT DISTINCT order_item_id, order_id, product_id, quantity, unit_price, total_price, created_at FROM {_utc('order_items')}",
    "silver_dedup_latest": f"SELECT category_id, parent_category_id, name, updated_at, processed_at FROM (SELECT *, row_number() OVER (PARTITION BY category_id ORDER BY updated_at DESC, processed_at DESC, parent_category_id DESC NULLS LAST, name DESC NULLS LAST) AS rn FROM {_utc('categories')}) WHERE rn = 1",
    "silver_standardize": "SELECT shipment_id, status, cdc_ts_ms FROM (SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY cdc_ts_ms DESC, status DESC NULLS LAST) AS rn FROM (SELECT trim(shipment_id) AS shipment_id, trim(status) AS status, epoch_us(updated_at) AS cdc_ts_ms FROM shipments)) WHERE rn = 1",
    "order_value_tier": f"{_C} SELECT order_id, total_amount, ntile(3) OVER (ORDER BY total_amount ASC NULLS LAST, order_id) AS order_value_tier FROM e_orders",
    "dq_not_null": "SELECT payment_id FROM payments WHERE order_id IS NULL",
    "dq_unique": "SELECT order_item_id, count(*) AS n_records FROM order_items WHERE order_item_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "dq_relationships": f"{_M} SELECT order_item_id, product_id FROM e_order_items WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM e_products)",
    "dq_accepted_values": "SELECT status AS value_field, count(*) AS n_records FROM marketplace_orders WHERE status NOT IN ('PENDING', 'PAID', 'PROCESSING', 'SHIPPED', 'DELIVERED', 'CANCELLED') GROUP BY 1",
    "dq_duration_non_negative": f"{_C}{_FACTS} SELECT history_id FROM f_steps WHERE duration_in_previous_status_seconds < 0",
    "dq_delivered_once": f"{_C} SELECT order_id, count(*) AS n FROM e_order_status_history WHERE current_status = 'PURCHASE' GROUP BY 1 HAVING count(*) > 1",
    "dq_delivered_after_created": f"{_M}{_FACTS} SELECT order_id FROM f_orders WHERE delivered_at < created_at",
    "dq_constraints": "SELECT 'price' AS constraint_name, count(*) FILTER (NOT price >= 0) AS n_rows FROM products UNION ALL SELECT 'status', count(*) FILTER (NOT status IN ('ACTIVE', 'INACTIVE', 'OUT_OF_STOCK')) FROM products",
    "dq_suite": f"""{_M}, f AS (
  SELECT 'orders.order_id not null' AS test_name, (SELECT count(*) FROM e_orders WHERE order_id IS NULL) AS n_failures
  UNION ALL SELECT 'orders.order_id unique', (SELECT count(*) FROM (SELECT order_id FROM e_orders GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'payments.order_id in orders', (SELECT count(*) FROM e_payments WHERE order_id NOT IN (SELECT order_id FROM e_orders))
  UNION ALL SELECT 'orders.customer_id not null', (SELECT count(*) FROM e_orders WHERE customer_id IS NULL))
SELECT *, n_failures = 0 AS passed FROM f""",
    "profile_nulls": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, " + (f"count(*) FILTER ({c} = '')" if s else "CAST(0 AS BIGINT)") + " AS n_blank FROM marketplace_orders" for c, s in (("order_id", 1), ("order_number", 1), ("customer_id", 1), ("status", 1), ("total_amount", 0), ("shipping_amount", 0), ("created_at", 0), ("updated_at", 0), ("processed_at", 0), ("processing_date", 0))),
    "profile_duplicates": "SELECT order_item_id, order_id, product_id, quantity, count(*) AS n_copies FROM order_items GROUP BY ALL HAVING count(*) > 1",
    "profile_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")),
    "insert_absent": "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey >= 5",
    "conditional_update": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'F' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders",
    "status_candidates": f"{_M} SELECT order_id, updated_at FROM e_orders WHERE status = 'PAID' AND updated_at <= TIMESTAMP '2026-06-01 00:00:00' - INTERVAL 60 SECOND ORDER BY updated_at LIMIT 15",
    "low_stock_priority": "SELECT p_partkey, p_size FROM part ORDER BY (p_size < 5) DESC, p_partkey LIMIT 5",
}


def _declared() -> str:
    from tidemark.operators.quality import DECLARED

    names = {"fact_orders": "f_orders", "transitions": "f_steps", "items": "f_items", "orders": "e_orders", "products": "e_products"}
    parts = []
    for name, column, kind, argument in DECLARED:
        t = names[name]
        if kind == "not_null":
            rows = f"SELECT 1 FROM {t} WHERE {column} IS NULL"
        elif kind == "unique":
            rows = f"SELECT {column} FROM {t} WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
        elif kind == "accepted_values":
            rows = f"SELECT {column} FROM {t} WHERE {column} NOT IN ({', '.join(map(repr, argument))}) GROUP BY 1"
        else:
            rows = f"SELECT 1 FROM {t} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {argument[1]} FROM {names[argument[0]]} WHERE {argument[1]} IS NOT NULL)"
        parts.append(f"SELECT '{name}.{column} {kind}' AS test_name, (SELECT count(*) FROM ({rows})) AS n_failures")
    return f"{_M}{_FACTS}, d AS ({' UNION ALL '.join(parts)}) SELECT *, n_failures = 0 AS passed FROM d"


ORACLES |= {
    "gold_fact_orders": f"{_M}{_FACTS} SELECT * FROM f_orders",
    "gold_orders_of_a_month": f"{_M}{_FACTS} SELECT order_id, order_status, total_amount FROM f_orders WHERE order_year = 2026 AND order_month = 1",
    "gold_dashboards": f"{_M}{_FACTS} SELECT order_status, count(*) AS total_orders, CAST(sum(total_amount) AS DECIMAL(38,4)) AS revenue FROM f_orders GROUP BY 1",
    "dq_declared": _declared(),
    "dq_shipped_before_order": "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate",
    "dq_negative_days": "SELECT * FROM (SELECT l_orderkey, l_linenumber, date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE days < 0",
    "active_products": f"{_M} SELECT product_id, status FROM e_products WHERE is_active",
    "preview": "SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 100",
    "set_operations": "SELECT c_custkey AS k, true AS has_orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, false FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "status_candidates": f"{_M} SELECT order_id, updated_at FROM e_orders WHERE status = 'PAID' AND updated_at <= TIMESTAMP '2026-06-01 00:00:00' - INTERVAL 60 SECOND ORDER BY updated_at, order_id LIMIT 15",
}
