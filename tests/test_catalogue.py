import pytest

from switchback.plans import catalogue
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(name, spark, sf, con):
    assert differences(spark, con, sf, catalogue.QUERIES[name], catalogue.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(name, spark):
    """On the scale that results are compared at; the smallest has too few points for some."""
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_filters_reach_the_scan(spark, sf):
    text = catalogue.QUERIES["filter_optional_and_between"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate)" in text and "o_comment" not in text


def test_distance_join_has_no_nested_loop(spark, sf):
    text = catalogue.QUERIES["distance_join"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_routes_and_users_of_an_area_are_counted_before_they_meet(spark, sf):
    text = catalogue.QUERIES["prune_pairs_both_sides"](spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(k for k, x in enumerate(text) if "Join" in x)
    assert sum("Aggregate" in x for x in text[join:]) == 2 and not any("Aggregate" in x for x in text[:join])
