"""Registered queries against their oracle SQL on the smallest tables (all of them: tests/oracle_check.py)."""

import os

import pytest

import __spark_entry__ as entry
from listwright.oracle import SQL
from listwright.queries import QUERIES
from oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
FAST = [
    "latest_price", "price_change_on_arrival", "fee_asof", "cohort_stats", "ranked_products", "main_pain_points", "canonical_urls", "placeholder_urls", "match_names",
    "batch_dedupe", "source_freshness", "seed_fees_if_absent", "tracker_history", "stream_ledger",
]


def test_every_query_has_its_sql():
    assert set(SQL) == set(QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_row_order_and_partitions_do_not_matter(spark):
    before = entry.queries()["product_scores"](spark, SF).exceptAll
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        other = entry.queries()["product_scores"](spark, SF)
        assert before(other).isEmpty()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_plans_push_down_and_prune(spark):
    from listwright import binding
    from listwright.plans import rescore

    plan = rescore.signals(binding.catalog(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_tax" not in plan.split("ReadSchema", 1)[1]
