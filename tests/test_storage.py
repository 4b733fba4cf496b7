"""Snapshot pointer switch, idempotent batch appends, DLQ state from log."""

import datetime as dt
import os
import uuid

from pipewright import model as M
from pipewright.operators import dlq as D
from pipewright.session import checkpoint_dir
from pipewright.sources import storage as ST

NOW = dt.datetime(2024, 1, 31)


def test_snapshot_pointer(spark):
    root = os.path.join(checkpoint_dir(spark), "snap-" + uuid.uuid4().hex[:8])
    assert ST.current_version(spark, root) is None
    ST.write_snapshot(spark.range(3), root)
    assert ST.write_snapshot(spark.range(5), root) == 2
    assert ST.read_snapshot(spark, root).count() == 5
    assert ST.read_snapshot(spark, root, 1).count() == 3


def test_append_batch_rerun_replaces_only_itself(spark):
    root = os.path.join(checkpoint_dir(spark), "log-" + uuid.uuid4().hex[:8])
    ST.append_batch(spark.range(3), root, 0)
    ST.append_batch(spark.range(4), root, 1)
    ST.append_batch(spark.range(4), root, 1)
    assert spark.read.parquet(root).count() == 7


def test_state_from_transitions(spark):
    rows = [(i, "t", 0, -1, "{}", "schema_validation", "m", 0, "pending", "p", NOW, NOW, None) for i in ("a", "b")]
    log = spark.createDataFrame(rows, M.DLQ_EVENTS)
    after = D.discard(log, spark.createDataFrame([("a",)], "id string"), NOW.replace(day=30))
    tr = D.transitions(log, after, 1)
    assert [r.id for r in tr.collect()] == ["a"]
    st = {r.id: r.status for r in D.current_state(log, tr).collect()}
    assert st == {"a": "discarded", "b": "pending"}


def test_cut_lineage_uses_checkpoint_dir(spark):
    df = spark.range(100).selectExpr("id", "id % 7 as k").groupBy("k").count()
    cut = ST.cut_lineage(df)
    assert sorted(cut.collect()) == sorted(df.collect())
    assert "LogicalRDD" in cut._jdf.queryExecution().analyzed().toString()
    assert spark.sparkContext.getCheckpointDir() is not None
