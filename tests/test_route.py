"""Routing edge cases: broken active schema, validation switched off."""

import datetime as dt

from pyspark.sql import functions as F

from pipewright import model as M
from pipewright.operators import route as R
from pipewright.sources import fixtures as FX

SF = "/root/testdata/sf0.001"
D0 = dt.datetime(2024, 1, 1)


def test_broken_active_schema_is_system_error_without_dlq_row(spark):
    rows = [("s-click", "click", 1, '{"type": "strng"}', True, D0),
            ("s-view", "view", 1, FX.FULL_JSON, True, D0)]
    schemas = spark.createDataFrame(rows, M.SCHEMAS)
    routed = R.route(FX.event_log(spark, SF), schemas, M.FIXED_NOW)
    click = routed.filter(F.col("topic") == "click")
    assert click.filter(F.col("route") != R.ROUTE_SYSTEM_ERROR).count() == 0
    msg = click.select("error_message").first()[0]
    assert msg.startswith("schema validation system error: compiling schema:")
    dlq = R.dlq_rows(routed, M.FIXED_NOW)
    assert dlq.filter(F.col("topic_name") == "click").count() == 0
    assert dlq.filter(F.col("topic_name") == "view").count() > 0


def test_validation_switched_off_passes_everything(spark):
    routed = R.route(FX.event_log(spark, SF), FX.schemas(spark), M.FIXED_NOW, enabled=False)
    assert routed.filter(F.col("route") != R.ROUTE_PUBLISHED).count() == 0
    ids = {r[0]: r[1] for r in routed.select("topic", "schema_id").distinct().collect()}
    assert ids["view"] == "sch-view-v2" and ids["signup"] == ""


def test_publish_results_offsets_follow_the_log(spark):
    log = FX.event_log(spark, SF)
    res = R.publish_results(R.route(log, FX.schemas(spark), M.FIXED_NOW), log=log)
    pub = res.filter("success")
    nxt = {(r[0], r[1]): r[2] for r in log.groupBy("topic", "partition_id").agg(F.max("kafka_offset") + 1).collect()}
    per = {}
    for r in pub.orderBy("pos").collect():
        k = (r.topic, r.partition_id)
        assert r.kafka_offset == nxt[k] + per.get(k, 0)
        per[k] = per.get(k, 0) + 1
    assert res.filter(~F.col("success")).filter(F.col("kafka_offset").isNotNull()).count() == 0


def test_publish_reports_validation_counts(spark):
    import os
    import uuid
    from pipewright.session import checkpoint_dir
    d = os.path.join(checkpoint_dir(spark), "obs-" + uuid.uuid4().hex[:8])
    log = FX.event_log(spark, SF)
    routed = R.route(log, FX.schemas(spark), M.FIXED_NOW)
    status = R.publish(routed, M.FIXED_NOW, R.parquet_sink(f"{d}/t"),
                       R.parquet_sink(f"{d}/d", partition_by="topic_name"))
    v = status["validation"]
    assert v["events"] == log.count()
    assert v["invalid"] == spark.read.parquet(f"{d}/d").count()
    assert v["valid"] + v["invalid"] == v["events"]
