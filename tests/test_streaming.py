"""Streaming = batch, and a rerun of a micro-batch adds no duplicates."""

import os
import uuid

from pyspark.sql import functions as F

from pipewright import model as M
from pipewright.operators import route as R
from pipewright.session import checkpoint_dir
from pipewright.sources import fixtures as FX
from pipewright.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_stream_route_equals_batch(spark):
    s = {(r["topic"], r["route"]): r["n"] for r in jobs.stream_route_result(spark, SF).collect()}
    b = (R.route(FX.event_log(spark, SF), FX.schemas(spark), M.FIXED_NOW)
         .filter(F.col("route") != "system_error").groupBy("topic", "route").count().collect())
    assert s == {(r["topic"], r["route"]): r["count"] for r in b}


def test_publish_rerun_is_idempotent_and_sink_failure_goes_to_dlq(spark):
    d = os.path.join(checkpoint_dir(spark), "t-" + uuid.uuid4().hex[:8])
    routed = R.route(FX.event_log(spark, SF), FX.schemas(spark), M.FIXED_NOW)
    for _ in range(2):  # the same micro-batch twice
        R.publish(routed, M.FIXED_NOW, R.parquet_sink(f"{d}/topics", 7),
                  R.parquet_sink(f"{d}/dlq", 7, partition_by="topic_name"))
    dlq = spark.read.parquet(f"{d}/dlq")
    assert dlq.count() == dlq.select("id").distinct().count() > 0

    def broken(_df):
        raise RuntimeError("broker unavailable")
    status = R.publish(routed, M.FIXED_NOW, broken, R.parquet_sink(f"{d}/dlq2", 1, partition_by="topic_name"))
    assert status["published"] is False
    d2 = spark.read.parquet(f"{d}/dlq2")
    n_valid = routed.filter(F.col("route") == "published").count()
    assert d2.filter(F.col("error_type") == "publish_error").count() == n_valid
    msg = d2.filter(F.col("error_type") == "publish_error").select("error_message").first()[0]
    assert msg.startswith("batch kafka write failed: broker unavailable")


def test_schema_change_takes_effect_next_batch(spark):
    from pipewright.sources.fixtures import LENIENT_JSON
    base = FX.schemas(spark)
    lenient = spark.createDataFrame(
        [(f"x-{t}", t, 9, LENIENT_JSON, True, FX.D0) for t in ("click", "error", "purchase", "view")], M.SCHEMAS)
    strict = R.route(FX.event_log(spark, SF), base, M.FIXED_NOW).filter(F.col("route") == "dlq").count()
    loose = R.route(FX.event_log(spark, SF), lenient, M.FIXED_NOW).filter(F.col("route") == "dlq").count()
    assert loose < strict


def test_snapshot_registry_recompiles_only_on_new_version(spark):
    from pipewright.sources.fixtures import LENIENT_JSON
    from pipewright.sources.storage import write_snapshot
    root = os.path.join(checkpoint_dir(spark), "reg-" + uuid.uuid4().hex[:8])
    write_snapshot(FX.schemas(spark), root)
    reg = R.SnapshotRegistry(spark, root)
    v1 = reg()
    assert reg() is v1
    lenient = spark.createDataFrame(
        [(f"x-{t}", t, 9, LENIENT_JSON, True, FX.D0) for t in ("click", "error", "purchase", "view")], M.SCHEMAS)
    write_snapshot(lenient, root)
    v2 = reg()
    assert v2 is not v1
    strict = R.route(FX.event_log(spark, SF), None, M.FIXED_NOW, validator=v1).filter(F.col("route") == "dlq").count()
    loose = R.route(FX.event_log(spark, SF), None, M.FIXED_NOW, validator=v2).filter(F.col("route") == "dlq").count()
    assert loose < strict


def _rows(df, cols):
    return {tuple(r[c] for c in cols) for r in df.select(*cols).collect()}


def test_stream_event_rate_windows_equal_batch(spark):
    from pipewright.operators import topology as TP
    s = jobs.stream_event_rate_result(spark, SF)
    assert s.count() > 0
    b = TP.event_rate(FX.event_log(spark, SF), 1)
    cols = ["window_start", "topic", "events"]
    assert _rows(s.withColumn("window_start", F.col("window_start").cast("string")), cols) == \
        _rows(b.withColumn("window_start", F.col("window_start").cast("string")), cols)


def test_stream_alert_state_equals_batch(spark):
    from pipewright.operators import lag as L
    s = jobs.stream_alert_state_result(spark, SF, 2500)
    b = L.alert_state(FX.lag_readings(spark, SF).withColumnRenamed("lag", "total_lag"), 2500)
    assert _rows(s, ["topic", "consumer_group", "is_alert"]) == _rows(b, ["topic", "consumer_group", "is_alert"])


class _Broken(RuntimeError):
    pass


def _fails(_df):
    raise _Broken("down")


def test_failing_dlq_sink_raises_and_a_failing_input_reaches_no_sink(spark):
    import pytest
    routed = R.route(FX.event_log(spark, SF), FX.schemas(spark), M.FIXED_NOW)
    with pytest.raises(_Broken):
        R.publish(routed, M.FIXED_NOW, lambda df: df.count(), _fails)
    tried = []
    bad = FX.event_log(spark, SF).withColumn("payload", F.when(F.rand() >= 0, F.raise_error(F.lit("no input"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="no input"):
        R.publish(R.route(bad, FX.schemas(spark), M.FIXED_NOW), M.FIXED_NOW, tried.append, tried.append)
    assert tried == []


def test_stream_commits_no_batch_whose_dlq_write_failed(spark):
    import pytest
    from pipewright.sources.tables import read_event_stream
    wd = os.path.join(checkpoint_dir(spark), "f-" + uuid.uuid4().hex[:8])
    src = jobs._stage(FX.event_log(spark, SF), wd + "/in")
    clock = []

    def start(dlq_sink=None):
        stream = read_event_stream(spark, src, M.EVENT_LOG, max_files_per_trigger=1)
        now = lambda: clock.append(1) or M.FIXED_NOW
        return jobs.route_stream(stream, lambda: FX.schemas(spark), now, wd + "/t", wd + "/d", wd + "/c", dlq_sink=dlq_sink)
    with pytest.raises(Exception, match="down"):
        start(lambda batch_id: _fails).awaitTermination()
    assert not os.path.exists(wd + "/d") and len(os.listdir(wd + "/c/commits")) == 0
    start().awaitTermination()  # the sink is back: every rejected event once
    want = R.route(FX.event_log(spark, SF), FX.schemas(spark), M.FIXED_NOW).filter(F.col("route") == "dlq")
    got = spark.read.parquet(wd + "/d")
    assert sorted(r[0] for r in got.select("id").collect()) == sorted(r[0] for r in want.select("dlq_event_id").collect())
    assert clock


def test_log_shaped_rows_can_be_routed(spark):
    from pipewright.sources.tables import kafka_to_events
    h = [("pw-producer-id", bytearray(b"a")), ("pw-producer-id", bytearray(b"b"))]
    rows = [("click", p, o, bytearray(b"k"), bytearray(b'{"bad": 1}'), FX.D0, h if p else None) for p in (0, 1) for o in (5, 6)]
    df = spark.createDataFrame(rows, "topic string, partition int, offset bigint, key binary, value binary, timestamp timestamp, headers array<struct<key:string,value:binary>>")
    ev = kafka_to_events(df)
    routed = R.route(ev, FX.schemas(spark), M.FIXED_NOW).collect()
    assert len({r.dlq_event_id for r in routed}) == 4 and {r.route for r in routed} == {"dlq"}
    assert {(r.partition_id, r.producer_id) for r in ev.collect()} == {(0, None), (1, "b")}


def test_poll_trigger_checks_period():
    import pytest
    assert jobs.poll_trigger() == {"processingTime": "5 seconds"}
    with pytest.raises(ValueError):
        jobs.poll_trigger(0)


def test_route_stream_writes_per_batch_metrics(spark):
    from pipewright.sources.storage import write_snapshot
    from pipewright.sources.tables import read_event_stream
    wd = os.path.join(checkpoint_dir(spark), "m-" + uuid.uuid4().hex[:8])
    src = jobs._stage(FX.event_log(spark, SF), wd + "/in")
    write_snapshot(FX.schemas(spark), wd + "/reg")
    stream = read_event_stream(spark, src, M.EVENT_LOG, max_files_per_trigger=1)
    q = jobs.route_stream(stream, R.SnapshotRegistry(spark, wd + "/reg"), M.FIXED_NOW,
                          wd + "/t", wd + "/d", wd + "/c", metrics_out=wd + "/metrics")
    q.awaitTermination()
    m = spark.read.parquet(wd + "/metrics")
    tot = m.agg(F.sum("events"), F.sum("invalid")).first()
    assert tot[0] == FX.event_log(spark, SF).count()
    assert tot[1] == spark.read.parquet(wd + "/d").count()
