"""Registered queries beside their SQL on the smallest tables.

``python tests/oracle.py SF_DIR`` runs all of them; here a spread over the families keeps the run short.
"""

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
SPREAD = ["p3_keyword_search", "l1_order_title", "a4_linkage_reason", "w6_evidence_packing", "g3_brief_citations", "d1_segment_html", "s3_normalize_papers"]


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SPREAD)
def test_same_rows_as_sql(spark, con, name):
    problem = compare(entry.queries()[name](spark, SF_DIR), con, entry.oracle_sql()[name])
    assert problem in (None, "no rows on either side")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_filters_reach_the_scan(spark):
    plan = entry.queries()["p12_entity_listing"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan or "GlobalLimit" in plan
    scan = entry.queries()["w1_latest_order_per_customer"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in scan and "o_totalprice" not in scan
