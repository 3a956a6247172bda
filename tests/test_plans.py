"""What the plans of large queries look like, and the engine's errors."""

import time

import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same
from thicket import catalogs as cat
from thicket import engine_queries  # noqa: F401  registers its queries
from thicket import queries as q
from thicket.model import FindRequest, OverviewRequest, SafeError, Scope
from thicket.operators import search, shape
from thicket.plans.engine import Engine, duration


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_reach_the_scan(spark, sf):
    symbols = cat.stored_orders(spark, sf)
    plan = plan_of(search.find(symbols, FindRequest("1-URGENT", Scope("ASIA"))))
    assert "EqualTo(leaf_base,1-URGENT)" in plan and "StringStartsWith(file,ASIA/)" in plan
    assert "content" not in plan


def test_a_budget_is_a_top_k_of_each_task(spark, sf):
    symbols = cat.stored_orders(spark, sf)
    ranked = search.ranked(search.find(symbols, FindRequest("1-URGENT")), 32_768)
    plan = plan_of(shape.within_budget(ranked, shape.found_item(), 32_768, shape.FOUND_ENVELOPE))
    assert "TakeOrderedAndProject" in plan


def test_references_broadcast_no_table_of_the_workspace(spark, sf):
    """Rows made by a generator look few to Spark: no limit on what it takes for
    small may decide that files, symbols or references go through the driver."""
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")
    try:
        for name in ("engine_references", "engine_property_references", "reference_candidate_evidence"):
            found = q.QUERIES[name](spark, sf)
            assert "Broadcast" not in plan_of(found), name
            assert_same(found.toPandas(), q.ORACLES[name], sf)
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")


def test_requests_are_stopped_in_time(spark, sf):
    assert [duration(x) for x in (360, 5, 3661)] == ["6m0s", "5s", "1h1m1s"]
    symbols = cat.stored_orders(spark, sf)
    slow = cat.workspace_catalog(spark, sf).withColumn("kind", F.udf(lambda k: time.sleep(0.3) or k, "int")("kind"))
    start = time.monotonic()
    with pytest.raises(SafeError, match="timed out"):
        Engine(slow, timeout=1).find_json(FindRequest("1-URGENT"))
    assert time.monotonic() - start < 30


def test_other_errors_are_internal(spark, sf):
    broken = cat.workspace_catalog(spark, sf).withColumn("kind", F.raise_error(F.lit("private")).cast("int"))
    with pytest.raises(SafeError, match="^internal error$"):
        Engine(broken).find_json(FindRequest("1-URGENT"))
    with pytest.raises(SafeError, match="not supported"):
        Engine(cat.stored_orders(spark, sf)).overview_json(OverviewRequest("a.sym"))
