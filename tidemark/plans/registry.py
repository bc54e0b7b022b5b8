"""All queries of the core and their SQL."""

from __future__ import annotations

from tidemark.plans import marketplace, marketplace_sql, streams, warehouse, warehouse_sql

QUERIES = {**marketplace.QUERIES, **warehouse.QUERIES, **streams.QUERIES}
ORACLES = {**marketplace_sql.ORACLES, **warehouse_sql.ORACLES, **streams.ORACLES, "cdc_incremental_apply": marketplace_sql.ORACLES["p4_found"]}
