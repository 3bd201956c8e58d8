"""Plans: filters and columns reach the scan, aggregates are partial, nothing is paired without a key, no Python where none is needed."""

import pytest

from evspark.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(catalogue.QUERIES["xql_flagship"](spark, SF))
    assert "In(event_type, [error,view])" in p
    schema = p[p.index("ReadSchema") :].split("\n")[0]
    assert "value" not in schema and "user_id" not in schema
    assert "partial_count" in p


def test_top_rows_are_not_sorted_whole(spark):
    assert "TakeOrderedAndProject" in plan(catalogue.QUERIES["scan_page"](spark, SF)) and "TakeOrderedAndProject" in plan(catalogue.QUERIES["xql_sort_mixed"](spark, SF))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_native_and_keyed(spark, name):
    p = plan(catalogue.QUERIES[name](spark, SF))
    assert "Python" not in p and "Arrow" not in p and "Pandas" not in p
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p or name == "match_none"  # one constant group: a row on each side


def test_addresses_become_a_row_for_each_length_that_occurs(spark):
    """Not one for every length that there could be."""
    from evspark.operators import lists

    ips = spark.createDataFrame([(f"10.0.{i // 250}.{i % 250}",) for i in range(500)] + [("2001:db8::1",)], "ip string")
    nets = spark.createDataFrame([("10.0.0.0/24",), ("10.0.0.0/16",), ("2001:db8::/32",), ("10.0.0.7",)], "net string")
    a, b = lists._blocks(ips, "ip"), lists._blocks(nets, "net")
    assert lists._levels(b) == [32, 112, 120, 128] and lists._levels(a) == [128]
    assert lists._above(a, lists._levels(b), False).count() == 501 * 4 and lists._above(b, lists._levels(a), True).count() == 0
    assert lists.overlapping(ips, nets, "ip", "net").count() == 250 + 500 + 1 + 1
