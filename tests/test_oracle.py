"""Every query of the core that has SQL, against that SQL, over whole tables."""

import pytest

import oracle
from tidemark.plans import registry

ROOT = f"{oracle.DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_its_sql(spark, name):
    rows, ours, theirs = oracle.compare(spark, name, ROOT)
    assert not ours and not theirs, (name, rows, ours, theirs)


def test_every_core_query_is_checked():
    unchecked = set(registry.QUERIES) - set(registry.ORACLES)
    # These are tested against brute force in test_schema_drift.
    assert unchecked == {"p1_found", *(f"p1_{e}_table" for e in ("orders", "products", "payments", "shipments", "inventories", "reviews"))}
