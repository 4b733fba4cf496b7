"""How often a query's plan reads the driver's events table."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
#: Queries over tables derived from the whole log.
QUERIES = ["topic_metadata", "topic_list", "topic_by_name", "latest_offsets", "topic_latest_offsets", "committed_offsets", "partition_lag", "lag_total", "lag_update",
           "lag_alerts", "topology_alerts", "topology_nodes", "topology_edges", "topology_metadata", "register_schemas", "active_schema", "schema_history",
           "schema_orphans", "topic_upsert", "schema_as_of", "validate_events", "route_events"]


def scans(df) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum("event_type#" in leaves.apply(i).toString() and "Relation" in leaves.apply(i).toString() for i in range(leaves.size()))


@pytest.mark.parametrize("name", QUERIES)
def test_at_most_two_scans(spark, name):
    assert scans(E.queries()[name](spark, SF)) <= 2


def test_scans_are_seen(spark):
    df = spark.read.parquet(f"{SF}/events.parquet")
    assert scans(df.union(df)) == 2
