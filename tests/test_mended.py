"""As-of joins, rewound commits, replays, snapshots and schema checks."""

import datetime as dt
import os
import uuid

import pytest
from pyspark.sql import functions as F

from pipewright import model as M
from pipewright.functions import jsonschema as JS
from pipewright.operators import dlq as D
from pipewright.operators import lag as L
from pipewright.operators import registry as REG
from pipewright.operators import route as R
from pipewright.session import checkpoint_dir
from pipewright.sources import fixtures as FX
from pipewright.sources import storage as ST

SF = "/root/testdata/sf0.001"


def _registry(spark, rows):
    return spark.createDataFrame(rows, M.SCHEMAS)


def test_as_of_gives_one_row_for_each(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    reg = _registry(spark, [("a1", "t", 1, "{}", False, day(5)), ("a2", "t", 2, "{}", False, day(3)),
                            ("a3", "t", 3, "{}", True, day(5)), ("b1", "u", 1, "{}", True, day(9))])
    rows = [(1, "t", day(2)), (2, "t", day(3)), (3, "t", day(4) + dt.timedelta(hours=5)), (4, "t", day(5)),
            (5, "t", day(20)), (6, "u", day(8)), (7, "x", day(8)), (8, None, day(8)), (9, "t", None)]
    df = spark.createDataFrame(rows, "id int, topic_name string, created_at timestamp_ntz")
    got = {r.id: r.schema_id for r in REG.as_of(df, reg).collect()}
    assert got == {1: None, 2: "a2", 3: "a2", 4: "a3", 5: "a3", 6: None, 7: None, 8: None, 9: None}
    assert REG.as_of(df.where("false"), reg).count() == 0


def test_a_rewound_group_is_behind_again(spark):
    rows = [("g", "t", 0, 100, 1), ("g", "t", 0, 40, 2)]
    c = spark.createDataFrame(rows, "consumer_group string, topic string, partition_id int, committed_offset bigint, seq bigint")
    assert [r.committed_offset for r in L.committed_offsets(c).collect()] == [40]


def test_a_reading_written_twice_is_there_once(spark):
    root = os.path.join(checkpoint_dir(spark), "r-" + uuid.uuid4().hex[:8])
    one = spark.createDataFrame([("t", "g", 1_700_000_000, 5), ("t", "g", 1_700_000_000, 5)], "topic string, consumer_group string, ts_sec bigint, lag bigint")
    L.write_readings(one, root)
    L.write_readings(one.unionByName(one.withColumn("lag", F.col("lag") + 1)), root)
    assert sorted(r.lag for r in spark.read.parquet(root).collect()) == [5, 6]


def _dlq(spark):
    return FX.dlq_events(spark, SF).filter("status = 'pending'")


def test_replay_messages_and_publish_failures(spark):
    dlq = _dlq(spark)
    requests = dlq.select(F.monotonically_increasing_id().alias("pos"), "id")
    out = D.retry(dlq, requests, FX.schemas(spark), M.FIXED_NOW, seq=3)
    ok = {r.id for r in out["results"].filter("success").collect()}
    sent = out["messages"].collect()
    assert {r.replay_of for r in sent} == ok and len(sent) == len(ok) and len({r.key for r in sent}) == len(ok)
    assert {r.headers[M.HEADER_PRODUCER] for r in sent} == {M.REPLAY_PRODUCER}
    lost = sorted(ok)[:5]
    failed = spark.createDataFrame([(i, "no leader") for i in lost], "id string, error string")
    again = D.retry(dlq, requests, FX.schemas(spark), M.FIXED_NOW, seq=3, failed=failed)
    assert {r.id for r in again["results"].filter("success").collect()} == ok - set(lost)
    rows = again["replay_rows"].filter(F.col("error_type") == M.ERROR_PUBLISH).collect()
    assert sorted(r.replay_of for r in rows) == lost
    assert {r.error_message for r in rows} == {"kafka write failed: no leader"}
    assert {r.replay_of for r in again["messages"].collect()} == ok - set(lost)


def test_system_errors_add_no_replay_row(spark):
    dlq = _dlq(spark).filter("topic_name = 'click'")
    requests = dlq.select(F.monotonically_increasing_id().alias("pos"), "id")
    broken = _registry(spark, [("s", "click", 1, '{"type": 7}', True, FX.D0)])
    out = D.retry(dlq, requests, broken, M.FIXED_NOW)
    assert out["replay_rows"].count() == 0 and out["messages"].count() == 0
    assert out["results"].filter("success").count() == 0


def test_a_leftover_folder_is_in_nobodys_way(spark):
    root = os.path.join(checkpoint_dir(spark), "p-" + uuid.uuid4().hex[:8])
    ST.write_snapshot(spark.range(3), root)
    spark.range(9).write.parquet(f"{root}/v=2/left-by-a-crash")
    assert ST.write_snapshot(spark.range(5), root) == 2
    assert ST.read_snapshot(spark, root).count() == 5 and ST.read_snapshot(spark, root, 1).count() == 3


@pytest.mark.parametrize("text", [
    '{"definitions": {"a": {"type": "nonsense"}}}',
    '{"definitions": {"a": {"items": {"$ref": "#/definitions/b"}}, "b": {"not": {"$ref": "#/definitions/a"}}}, "$ref": "#/definitions/a"}',
    '{"pattern": "(?P<x>a)"}', '{"pattern": "("}', '{"format": "email"}', '{"contentEncoding": "base64"}'])
def test_schemas_refused_at_registration(spark, text):
    with pytest.raises(JS.SchemaCompileError):
        JS.parse_schema(text)


def test_java_patterns_and_shared_definitions_are_accepted(spark):
    JS.parse_schema('{"pattern": "^\\\\p{Lu}++$"}')
    JS.parse_schema('{"definitions": {"a": {"type": "string"}, "b": {"items": {"$ref": "#/definitions/a"}}}, "properties": {"x": {"$ref": "#/definitions/b"}, "y": {"$ref": "#/definitions/a"}}}')


def test_one_bad_schema_stops_only_its_topic(spark):
    bad = '{"definitions": {"a": {"$ref": "#/definitions/a"}}, "$ref": "#/definitions/a"}'
    reg = FX.schemas(spark).filter("is_active and topic_name <> 'click'").unionByName(
        _registry(spark, [("s", "click", 1, bad, True, FX.D0)]))
    got = R.route(FX.event_log(spark, SF), reg, M.FIXED_NOW)
    assert {r.topic for r in got.filter("route = 'system_error'").select("topic").distinct().collect()} == {"click"}
    assert got.filter("topic <> 'click' and route = 'published'").count() > 0


def test_topology_alerts_judge_every_series(spark):
    """Over the topics' greatest totals of all series: more than the greatest of them that isn't over their mean."""
    from pipewright.plans import catalog

    q, worst = catalog.queries(), {}
    for r in q["lag_total"](spark, SF).collect():
        worst[r.topic] = max(worst.get(r.topic, 0), r.total_lag)
    mean = sum(worst.values()) / len(worst)
    threshold = max(v for v in worst.values() if v <= mean)
    got = q["topology_alerts"](spark, SF).collect()
    topics = {r.id: r.is_alert for r in got if r.type == "topic"}
    assert topics == {t: v > threshold for t, v in worst.items()} and set(topics.values()) == {True, False}
    assert not any(r.is_alert for r in got if r.type != "topic")
