"""Lag operators: boundary cases of SURVEY 0.1 and 2.12."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pipewright import model as M
from pipewright.functions import scalars as S
from pipewright.operators import lag as L

NOW = dt.datetime(2024, 1, 31)
NOW_S = int(NOW.replace(tzinfo=dt.timezone.utc).timestamp())


def readings(spark, rows):
    return spark.createDataFrame(rows, M.LAG_READINGS)


def test_history_inclusive_ends_and_text_order(spark):
    r = readings(spark, [("t", "g", NOW_S - 600, 5), ("t", "g", NOW_S, 10), ("t", "g", NOW_S, 9),
                         ("t", "g", NOW_S - 601, 1), ("t", "g", NOW_S + 1, 2)])
    got = [(x.ts_sec, x.lag) for x in L.history(r, NOW, 10).collect()]
    assert got == [(NOW_S - 600, 5), (NOW_S, 10), (NOW_S, 9)]


def test_prune_cutoff_inclusive(spark):
    r = readings(spark, [("t", "g", NOW_S - 3600, 1), ("t", "g", NOW_S - 3599, 2)])
    assert [x.lag for x in L.prune(r, NOW, 1).collect()] == [2]


def test_expiry(spark):
    r = readings(spark, [("t", "g", NOW_S - 7200, 1), ("t", "g", NOW_S - 100, 2), ("u", "g", NOW_S - 4000, 3)])
    got = sorted((x.topic, x.lag) for x in L.expiry(r, NOW, 1).collect())
    assert got == [("t", 2)]


def test_latest_tie_by_member_text(spark):
    r = readings(spark, [("t", "g", 100, 9), ("t", "g", 100, 10), ("t", "g", 50, 99)])
    assert L.latest_lag(r).collect()[0].lag == 9


def test_latest_1m_zero_for_stale(spark):
    r = readings(spark, [("t", "g", NOW_S - 61, 7), ("u", "g", NOW_S - 60, 3)])
    got = {x.topic: x.lag for x in L.latest_lag_1m(r, NOW).collect()}
    assert got == {"t": 0, "u": 3}


def test_store_collapses_same_second_and_lag(spark):
    r = readings(spark, [("t", "g", 1, 5), ("t", "g", 1, 5), ("t", "g", 1, 6)])
    assert L.store(r, r).count() == 2


def test_alert_is_strict(spark):
    t = spark.createDataFrame([("t", "g", 100), ("u", "g", 101)], "topic string, consumer_group string, total_lag bigint")
    assert [x.topic for x in L.lag_alerts(t, 100).collect()] == ["u"]


def test_params_rejected():
    with pytest.raises(ValueError):
        M.check_params(topics=[])
    with pytest.raises(ValueError):
        M.check_params(poll_seconds=0)
    with pytest.raises(ValueError):
        M.check_params(threshold=-1)


def test_partition_lag_semantics(spark):
    latest = spark.createDataFrame([("t", 0, 10), ("t", 1, 5), ("t", 2, 0)],
                                   "topic string, partition_id int, latest_offset bigint")
    commits = spark.createDataFrame([("g", "t", 0, 4), ("g", "t", 1, 9), ("g", "t", 7, 1)], M.COMMITTED_OFFSETS)
    got = sorted((x.partition_id, x.committed_offset, x.lag) for x in L.partition_lag(latest, commits).collect())
    assert got == [(0, 4, 6), (1, 9, 0), (2, 0, 0)]


def test_decode_and_humanize(spark):
    m = spark.createDataFrame([("t", "g", "100:5"), ("t", "g", "bad"), ("t", "g", "1:2:3"), ("t", "g", "x:1")],
                              "topic string, consumer_group string, member string")
    assert [(x.ts_sec, x.lag) for x in S.decode_member(m).collect()] == [(100, 5)]
    h = spark.createDataFrame([(999,), (1000,), (1450,), (1449,), (999_949,), (2_345_678,)], "lag bigint")
    got = [x[0] for x in h.select(S.humanize_lag(F.col("lag"))).collect()]
    assert got == ["999", "1.0K", "1.5K", "1.4K", "999.9K", "2.3M"]


def test_running_peak_and_transitions_skew_helpers(spark):
    rows = [("t", "g", k * 1000, (k * 37) % 11) for k in range(200)]
    r = readings(spark, rows)
    got = sorted((x.ts_sec, x.running_peak) for x in L.running_peak(r, bucket_seconds=7000).collect())
    peak, exp = 0, []
    for ts, lag in [(x[2], x[3]) for x in rows]:
        peak = max(peak, lag)
        exp.append((ts, peak))
    assert got == exp
    tr = L.alert_transitions(r.withColumnRenamed("lag", "total_lag"), 5, bucket_seconds=9000)
    flags = [lag > 5 for (_, _, _, lag) in rows]
    exp_tr = [rows[i][2] for i in range(len(rows)) if flags[i] != (flags[i - 1] if i else False)]
    assert sorted(x.ts_sec for x in tr.collect()) == exp_tr


def test_store_pruning_and_day_drop(spark):
    import os
    import uuid
    from pipewright.session import checkpoint_dir
    root = os.path.join(checkpoint_dir(spark), "lagstore-" + uuid.uuid4().hex[:8])
    rows = [("t", "g", NOW_S - k * 3600, k) for k in range(0, 24 * 5, 3)]
    r = readings(spark, rows)
    L.write_readings(r, root)
    got = [(x.ts_sec, x.lag) for x in L.read_history(spark, root, NOW, 600).collect()]
    assert got == [(x.ts_sec, x.lag) for x in L.history(r, NOW, 600).collect()]
    dropped = L.drop_expired_days(spark, root, NOW, 48)
    assert dropped and all(d < "dt=2024-01-29" for d in dropped)
    left = spark.read.parquet(root).drop("dt")
    assert L.prune(left, NOW, 48).count() == L.prune(r, NOW, 48).count()


def test_clock_literal_ignores_process_timezone(spark):
    import os
    import time
    old = os.environ.get("TZ")
    os.environ["TZ"] = "America/New_York"
    time.tzset()
    try:
        got = spark.range(1).select(S.ts_literal(NOW).cast("string")).first()[0]
    finally:
        if old is None:
            os.environ.pop("TZ")
        else:
            os.environ["TZ"] = old
        time.tzset()
    assert got == "2024-01-31 00:00:00"
