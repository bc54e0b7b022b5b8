"""Independent SQL for the marketplace queries (DuckDB dialect)."""

_REF = "nullif(lower(trim({0}, ' \t\r\n')), '')"


def ref(c: str) -> str:
    return _REF.format(c)


_ORDERS = f"""
WITH ranked AS (
  SELECT {ref('order_id')} AS order_key, {ref('customer_id')} AS customer, upper(trim(status, ' \t\r\n')) AS status,
         CAST(coalesce(total_amount, 0) * 10000 AS BIGINT) AS amount, epoch_us(created_at) AS us,
         row_number() OVER (PARTITION BY {ref('order_id')} ORDER BY updated_at DESC NULLS LAST, processed_at DESC NULLS LAST) AS rn
  FROM marketplace_orders
), stats AS (
  SELECT customer, status, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total, max(us) AS last_us
  FROM ranked WHERE rn = 1 AND customer IS NOT NULL GROUP BY customer, status
)
"""

_STATUSES = ("PENDING", "PAID", "PROCESSING", "SHIPPED", "DELIVERED", "CANCELLED")

_TREE = f"""
WITH RECURSIVE nodes AS (
  SELECT id, parent FROM (
    SELECT {ref('category_id')} AS id, {ref('parent_category_id')} AS parent,
           row_number() OVER (PARTITION BY {ref('category_id')} ORDER BY updated_at DESC, processed_at DESC) AS rn
    FROM categories) WHERE rn = 1
), edges AS (
  SELECT n.id, p.id AS parent FROM nodes n LEFT JOIN nodes p ON n.parent = p.id
), down AS (
  SELECT id, id AS root, CAST(0 AS BIGINT) AS depth, id AS path FROM edges WHERE parent IS NULL
  UNION ALL
  SELECT e.id, d.root, d.depth + 1, d.path || '/' || e.id FROM edges e JOIN down d ON e.parent = d.id
), reach AS (
  SELECT parent AS top, id FROM edges WHERE parent IS NOT NULL
  UNION
  SELECT r.top, e.id FROM reach r JOIN edges e ON e.parent = r.id
)
"""

_BROKEN = f"""
WITH child AS (
  SELECT table_name, row_id, field_name, parent, key, min(created_at) AS created_at, min(processed_at) AS loaded FROM (
    SELECT 'order_items' AS table_name, order_item_id AS row_id, 'order_id' AS field_name, 'orders' AS parent, {ref('order_id')} AS key, created_at, processed_at FROM order_items
    UNION ALL SELECT 'order_items', order_item_id, 'product_id', 'products', {ref('product_id')}, created_at, processed_at FROM order_items
    UNION ALL SELECT 'payments', payment_id, 'order_id', 'orders', {ref('order_id')}, created_at, processed_at FROM payments
    UNION ALL SELECT 'shipments', shipment_id, 'order_id', 'orders', {ref('order_id')}, created_at, processed_at FROM shipments)
  GROUP BY table_name, row_id, field_name, parent, key
), parents AS (
  SELECT 'orders' AS parent, {ref('order_id')} AS key, min(processed_at) AS loaded, CAST(NULL AS TIMESTAMPTZ) AS deleted FROM marketplace_orders GROUP BY 2
  UNION ALL SELECT 'products', {ref('product_id')}, min(processed_at), min(deleted_at) FROM products GROUP BY 2
), broken AS (
  SELECT table_name, row_id, field_name,
         CASE WHEN p.key IS NULL THEN 'missing' WHEN p.deleted <= c.created_at THEN 'deleted' WHEN p.loaded > c.loaded THEN 'late' END AS problem,
         strftime(c.created_at AT TIME ZONE 'UTC', '%Y-%m') AS created_month
  FROM child c LEFT JOIN parents p ON c.parent = p.parent AND c.key = p.key WHERE c.key IS NOT NULL
)
"""

_KEYED = """
WITH keyed AS (
  SELECT c.*, json_extract_string(c.record, '$."' || k.field_name || '"') AS row_key
  FROM (SELECT * FROM cdc_changes WHERE record IS NULL OR json_valid(record)) c
  LEFT JOIN (SELECT entity, field_name FROM entity_fields WHERE is_row_key) k ON c.entity = k.entity
)
"""

_STATE = _KEYED + """, last AS (
  SELECT *, row_number() OVER (PARTITION BY source_db, entity, row_key ORDER BY source_ts_ms DESC NULLS LAST, lsn DESC NULLS LAST, op = 'd' DESC, record DESC) AS rn
  FROM keyed WHERE op IN ('r', 'c', 'u', 'd') AND row_key IS NOT NULL
)
"""

ORACLES = {
    "p2_found": _ORDERS + "SELECT customer AS customer_id, status, n AS n_orders, total AS total_e4, last_us AS last_created_us FROM stats",
    "p2_features": _ORDERS
    + "SELECT customer AS customer_id, CAST(sum(n) AS BIGINT) AS events, max(last_us) AS any_last_us, "
    + "CAST(coalesce(sum(n) FILTER (status IS NULL OR status NOT IN (" + ", ".join(f"'{s}'" for s in _STATUSES) + ")), 0) AS BIGINT) AS other_n, "
    + ", ".join(f"CAST(coalesce(sum(n) FILTER (status = '{s}'), 0) AS BIGINT) AS {s.lower()}_n, CAST(coalesce(sum(total) FILTER (status = '{s}'), 0) AS BIGINT) AS {s.lower()}_total, max(last_us) FILTER (status = '{s}') AS {s.lower()}_last_us" for s in _STATUSES)
    + " FROM stats GROUP BY customer",
    "p3_found": _TREE
    + """SELECT e.id AS category_id, coalesce(d.root, '') AS root_category_id, coalesce(d.depth, -1) AS depth, coalesce(r.n, 0) AS n_descendants
FROM edges e LEFT JOIN down d ON e.id = d.id
LEFT JOIN (SELECT top, count(*) AS n FROM reach WHERE top <> id GROUP BY top) r ON r.top = e.id""",
    "p3_paths": _TREE + "SELECT e.id AS category_id, coalesce(d.path, '') AS path FROM edges e LEFT JOIN down d ON e.id = d.id",
    "p3_ranges": _TREE + "SELECT d.id AS category_id, row_number() OVER (ORDER BY d.path) - 1 AS pos, 1 + coalesce(r.n, 0) AS size FROM down d LEFT JOIN (SELECT top, count(DISTINCT id) AS n FROM reach WHERE top <> id GROUP BY top) r ON d.id = r.top",
    "p3_descendants": _TREE + "SELECT root AS root_category_id, id AS category_id FROM down WHERE depth > 0",
    "p3_all_descendants": _TREE + "SELECT DISTINCT top AS category_id, id AS descendant_id FROM reach WHERE top <> id",
    "p6_found": _BROKEN + "SELECT * FROM broken WHERE problem IS NOT NULL",
    "p6_counts": _BROKEN + "SELECT table_name, field_name, problem, created_month, count(*) AS n FROM broken WHERE problem IS NOT NULL GROUP BY ALL",
    "p7_found": f"""
WITH rows AS (
  SELECT {ref('product_id')} AS product_id, epoch_us(updated_at) AS us, CAST(price * 10000 AS BIGINT) AS price_e4, upper(trim(status, ' \t\r\n')) AS status,
         row_number() OVER (PARTITION BY {ref('product_id')}, updated_at ORDER BY processed_at DESC) AS rn
  FROM products
), steps AS (
  SELECT *, lag(us) OVER w AS prev_us, lag(price_e4) OVER w AS prev_price, lag(status) OVER w AS prev_status
  FROM rows WHERE rn = 1 WINDOW w AS (PARTITION BY product_id ORDER BY us)
), starts AS (
  SELECT * FROM steps WHERE prev_us IS NULL OR price_e4 IS DISTINCT FROM prev_price OR status IS DISTINCT FROM prev_status
), gone AS (SELECT {ref('product_id')} AS product_id, min(epoch_us(deleted_at)) AS gone FROM products GROUP BY 1)
SELECT s.product_id, us AS valid_from_us, coalesce(lead(us) OVER (PARTITION BY s.product_id ORDER BY us), gone, -1) AS valid_to_us, price_e4, status
FROM starts s JOIN gone USING (product_id)""",
    "p4_found": _STATE + "SELECT source_db, entity, row_key, lsn FROM last WHERE rn = 1 AND op <> 'd'",
    "p4_state": _STATE + "SELECT source_db, entity, row_key, lsn, record FROM last WHERE rn = 1 AND op <> 'd'",
    "p5_found": _KEYED + "SELECT arrival_id FROM (SELECT arrival_id, row_number() OVER (PARTITION BY source_db, entity, lsn, row_key ORDER BY arrival_id) AS rn FROM keyed) WHERE rn > 1",
}
