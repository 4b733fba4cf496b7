"""Live streams against the batch operators: every row, whatever the order and the batches."""

import os
import random
import uuid

import pytest
from pyspark.sql import functions as F

from pipewright import model as M
from pipewright.operators import lag as L
from pipewright.session import checkpoint_dir
from pipewright.streaming import jobs, live

HOUR, START = 3600, 1_704_067_200  # 2024-01-01


def _dir(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def _files(spark, parts, schema, src):
    """Each part as one file, read in that order."""
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(src)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for st in fs.listStatus(path):  # the source goes by time of writing
            if st.getPath().getName().startswith("part-") and st.getModificationTime() > 10**12:
                fs.setTimes(st.getPath(), (n + 1) * 10_000, -1)


def _run(df, out, ckpt, **trigger):
    with live.stateful(df.sparkSession):
        q = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", ckpt).trigger(**(trigger or {"availableNow": True})).start(out)
        q.awaitTermination()


def _shuffled(rows, files, seed, by):
    """Cut into files by time; rows swap places with others of nearby times."""
    rng = random.Random(seed)
    rows = sorted(rows, key=lambda r: by(r) + rng.uniform(0, 1500))
    size = -(-len(rows) // files)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


# -- live polls

GRID = [(t, p, g) for t, parts in (("a", 3), ("b", 1)) for p in range(parts) for g in ("g1", "g2")]
INPUT = "kind int, topic string, partition_id int, consumer_group string, value bigint, sec bigint, seq bigint"


def _poll_rows(seed=1, n=900):
    """Partition ("a", 2) is silent; ("b", 7) and group g3 aren't listed; commits are rewound; equal times."""
    rng, out, offset = random.Random(seed), [], {}
    for seq in range(n):
        t, p = rng.choice([("a", 0), ("a", 0), ("a", 0), ("a", 1), ("b", 0), ("b", 7)])
        sec = START + (seq // 3) * 97
        offset[t, p] = offset.get((t, p), 0) + rng.randint(1, 9)
        if rng.random() < 0.6:
            out.append((0, t, p, None, offset[t, p], sec, seq))
        if rng.random() < 0.4 and t == "a":
            out.append((1, t, p, rng.choice(["g1", "g1", "g3"]), max(offset[t, p] + rng.randint(-30, 4), 0), sec, seq))
    return out


def _batch_polls(spark, rows, ticks):
    """The batch operators on what happened before each poll."""
    df = spark.createDataFrame(rows, INPUT)
    parts = spark.createDataFrame([(t, p) for t, p in {(t, p) for t, p, _ in GRID}], "topic string, partition_id int")
    pairs = spark.createDataFrame([(t, g) for t, g in {(t, g) for t, _, g in GRID}], "topic string, consumer_group string")
    out = set()
    for tick in ticks:
        was = df.where(F.col("sec") < tick)
        offsets = was.where("kind = 0").select("topic", "partition_id", (F.col("value") - 1).alias("kafka_offset"))
        commits = was.where("kind = 1").select("consumer_group", "topic", "partition_id", F.col("value").alias("committed_offset"), (F.col("sec") * 10_000 + F.col("seq")).alias("seq"))
        plag = L.partition_lag(L.latest_offsets(parts, offsets), L.committed_offsets(commits), pairs)
        out |= {(tick, r.topic, r.consumer_group, r.partition_id, r.latest_offset, r.committed_offset, r.lag) for r in plag.collect()}
    return out


@pytest.mark.parametrize("files,trigger_files", [(1, None), (7, 1), (6, 2)])
def test_live_polls_equal_batch_polls(spark, files, trigger_files):
    rows = _poll_rows()
    last = max(r[5] for r in rows)
    ticks = range(START + HOUR, last + 2 * HOUR, HOUR)
    ticks = [t for t in ticks if t <= (last // HOUR + 1) * HOUR]
    src, out = _dir(spark, "in"), _dir(spark, "out")
    beat = [(live.HEARTBEAT, None, None, None, None, ticks[-1] + 1801, None)]
    _files(spark, [*_shuffled(rows, files, 4, lambda r: r[5]), beat], INPUT, src)
    reader = spark.readStream.schema(INPUT)
    stream = (reader.option("maxFilesPerTrigger", trigger_files) if trigger_files else reader).parquet(src)
    stream = stream.withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    polled = live.live_lag(stream, spark.createDataFrame(GRID, "topic string, partition_id int, consumer_group string"), jobs._utc(START), HOUR, "30 minutes")
    _run(polled, out, out + "-ckpt")
    got = [(r.s, r.topic, r.consumer_group, r.partition_id, r.latest_offset, r.committed_offset, r.lag) for r in spark.read.parquet(out).withColumn("s", F.unix_seconds("poll")).collect()]
    assert len(got) == len(set(got)) == len(ticks) * len(GRID)  # each poll once, the silent partitions too
    assert set(got) == _batch_polls(spark, rows, ticks)


def test_live_polls_go_on_after_a_restart(spark):
    rows = sorted(_poll_rows(seed=2, n=400), key=lambda r: r[5])
    half = len(rows) // 2
    src, out = _dir(spark, "in"), _dir(spark, "out")
    grid = spark.createDataFrame(GRID, "topic string, partition_id int, consumer_group string")

    def go():
        stream = spark.readStream.schema(INPUT).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
        _run(live.live_totals(live.live_lag(stream, grid, jobs._utc(START), HOUR, "10 minutes")), out, out + "-ckpt")

    _files(spark, [rows[:half]], INPUT, src)
    go()
    last = max(r[5] for r in rows)
    end = (last // HOUR + 1) * HOUR
    _files(spark, [rows[half:], [(live.HEARTBEAT, None, None, None, None, end + 601, None)]], INPUT, src)
    go()
    got = [(r.s, r.topic, r.consumer_group, r.total_lag) for r in spark.read.parquet(out).withColumn("s", F.unix_seconds("poll")).collect()]
    totals = {}
    for tick, t, g, _, _, _, lag in _batch_polls(spark, rows, range(START + HOUR, end + 1, HOUR)):
        totals[tick, t, g] = totals.get((tick, t, g), 0) + lag
    assert sorted(got) == sorted((*k, v) for k, v in totals.items())


def test_live_polls_run_on_the_poll_trigger(spark):
    src, out = _dir(spark, "in"), _dir(spark, "out")
    _files(spark, [[(0, "a", 0, None, 5, START + 10, 0)], [(live.HEARTBEAT, None, None, None, None, START + 2 * HOUR, None)]], INPUT, src)
    stream = spark.readStream.schema(INPUT).parquet(src).withColumn("ts", F.timestamp_seconds("sec")).drop("sec")
    polled = live.live_lag(stream, spark.createDataFrame([("a", 0, "g1")], "topic string, partition_id int, consumer_group string"), jobs._utc(START), HOUR, "1 second")
    with live.stateful(spark):
        q = polled.writeStream.format("parquet").outputMode("append").option("checkpointLocation", out + "-ckpt").trigger(**jobs.poll_trigger(1)).start(out)
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert [(r.latest_offset, r.lag) for r in spark.read.parquet(out).collect()] == [(5, 5)]


# -- expiry

READ = "topic string, consumer_group string, ts_sec bigint"


def _writes(seed=3, n=300):
    rng = random.Random(seed)
    series = [("a", "g1"), ("a", "g2"), ("b", "g1"), ("hot", "g1")]
    out = [(*series[3], START + k * 7) for k in range(n)]  # a third of the rows and more, never silent for long
    for s in series[:3]:
        at = START
        while at < START + 40 * HOUR:
            at += rng.choice([60, 600, 5 * HOUR, 6 * HOUR])
            out.append((*s, at))
    out.append(("c", "g9", START + 5 * HOUR))
    out.append(("c", "g9", START + 8 * HOUR))  # exactly the TTL later: anew
    return out


@pytest.mark.parametrize("files", [1, 5])
def test_expiry_stream_equals_batch_expiry(spark, files):
    rows, ttl = _writes(), 3 * HOUR
    src, out = _dir(spark, "in"), _dir(spark, "out")
    now = max(r[2] for r in rows) + 2 * HOUR
    _files(spark, [*_shuffled(rows, files, 5, lambda r: r[2]), [(None, None, now + 1801)]], READ, src)
    stream = spark.readStream.schema(READ).option("maxFilesPerTrigger", 1).parquet(src)
    _run(live.expiry_stream(stream, ttl, "30 minutes"), out, out + "-ckpt")
    gone = [(r.topic, r.consumer_group, r.first_write, r.last_write, r.at) for r in spark.read.parquet(out).withColumn("at", F.unix_seconds("expired_at")).collect()]
    want, by = [], {}
    for t, g, s in rows:
        by.setdefault((t, g), []).append(s)
    for key, ts in by.items():
        ts, first = sorted(ts), min(ts)
        for a, b in zip(ts, [*ts[1:], None]):
            if b is None or b - a >= ttl:
                if a + ttl <= now:
                    want.append((*key, first, a, a + ttl))
                first = b
    assert sorted(gone) == sorted(want) and len(want) > 10
    # alive at any time: written before and not expired since; as the batch operator sees it
    df = spark.createDataFrame([(*r, 1) for r in rows], READ + ", lag bigint")
    for at in (START + 4 * HOUR, START + 11 * HOUR, START + 23 * HOUR, now):
        batch = {(r.topic, r.consumer_group) for r in L.expiry(df.where(F.col("ts_sec") <= at), jobs._utc(at), ttl // HOUR).collect()}
        live_now = set()
        for key, ts in by.items():
            last = max((s for s in ts if s <= at), default=None)
            if last is not None and not any(k[:2] == key and k[3] == last and k[4] <= at for k in gone):
                live_now.add(key)
        assert live_now == batch


def _expired(spark, parts, ttl, delay="1 second", src=None):
    """Rows of the stream over these parts, a file a batch, and the query's plan."""
    src, out = src or _dir(spark, "in"), _dir(spark, "out")
    _files(spark, parts, READ, src)
    gone = live.expiry_stream(spark.readStream.schema(READ).option("maxFilesPerTrigger", 1).parquet(src), ttl, delay)
    _run(gone, out, out + "-ckpt")
    rows = spark.read.parquet(out).withColumn("at", F.unix_seconds("expired_at")).collect()
    return sorted(((r.topic, r.consumer_group, r.first_write, r.last_write, r.at) for r in rows), key=str), gone


def test_expiry_runs_no_python_for_a_series(spark):
    """A call of Python for each series took the time: 2.7 million of them are to pass in one run."""
    got, gone = _expired(spark, [[("a", "g", START)], [(None, None, START + 9 * HOUR)]], HOUR)
    plan = gone._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "Pandas" not in plan and "TransformWithState" not in plan
    assert got == [("a", "g", START, START, START + HOUR)]


def test_expiry_at_the_second_of_the_ttl(spark):
    """A write a second before the TTL keeps the series, one at the TTL starts it anew; gone at the TTL, not before."""
    ttl, beat = HOUR, START + 10 * HOUR
    rows = [("a", "keeps", START), ("a", "keeps", START + ttl - 1), ("a", "anew", START), ("a", "anew", START + ttl),
            ("a", "due", beat - ttl), ("a", "alive", beat - ttl + 1), ("a", None, START), (None, "x", START), ("a", "none", None)]
    got, _ = _expired(spark, [rows, [(None, None, beat + 1)]], ttl)
    assert got == sorted([("a", "keeps", START, START + ttl - 1, START + 2 * ttl - 1), ("a", "anew", START, START, START + ttl),
                          ("a", "anew", START + ttl, START + ttl, START + 2 * ttl), ("a", "due", beat - ttl, beat - ttl, beat),
                          ("a", None, START, START, START + ttl)], key=str)


def test_expiry_counts_a_late_write_while_its_series_lives(spark):
    beats = [[(None, None, START + h * HOUR)] for h in (2, 2, 9)]
    parts = [[("a", "g", START)], *beats[:2], [("a", "g", START + HOUR)], beats[2]]
    got, _ = _expired(spark, parts, 3 * HOUR)
    assert got == [("a", "g", START, START + HOUR, START + 4 * HOUR)]


def test_expiry_of_a_hot_series_crosses_the_shuffle_merged(spark):
    src, out = _dir(spark, "in"), _dir(spark, "out")
    spark.range(0, 20_000, 1, 4).selectExpr("'a' as topic", "'hot' as consumer_group", f"{START} + id as ts_sec").write.parquet(src)
    with live.stateful(spark):
        q = live.expiry_stream(spark.readStream.schema(READ).parquet(src), HOUR, "1 second").writeStream.format("parquet") \
            .option("checkpointLocation", out + "-ckpt").trigger(availableNow=True).start(out)
        q.awaitTermination()
    plan = q._jsq.streamingQuery().lastExecution().executedPlan().toString()
    assert plan.count("MergingSessions") == 2  # before the shuffle and after it
    assert q.recentProgress[0].stateOperators[0].numRowsTotal == 1


# -- alerts

TOTALS = "topic string, consumer_group string, ts_sec bigint, total_lag bigint"


@pytest.mark.parametrize("files,bucket", [(1, 3600), (6, 900), (4, 60)])
def test_transition_stream_equals_batch(spark, files, bucket):
    rng = random.Random(9)
    rows = [(rng.choice("aab"), rng.choice(["g1", "g1", "g2"]), START + rng.randrange(0, 12 * HOUR), rng.randint(0, 100)) for _ in range(1200)]
    rows += rows[:20]
    src, out = _dir(spark, "in"), _dir(spark, "out")
    _files(spark, [*_shuffled(rows, files, 6, lambda r: r[2]), [(None, None, START + 20 * HOUR, None)]], TOTALS, src)
    stream = spark.readStream.schema(TOTALS).option("maxFilesPerTrigger", 1).parquet(src)
    _run(live.transition_stream(stream, 50, "30 minutes", bucket), out, out + "-ckpt")
    cols = ["topic", "consumer_group", "ts_sec", "total_lag", "is_alert", "transition"]
    got = sorted(tuple(r[c] for c in cols) for r in spark.read.parquet(out).collect())
    df = spark.createDataFrame(rows, TOTALS)
    assert got == sorted(tuple(r[c] for c in cols) for r in L.alert_transitions(df, 50).collect()) and len(got) > 100
    topics = {r.topic for r in jobs.alerting_topics(spark.read.parquet(out)).collect()}
    assert topics == {r.topic for r in L.alert_topics(L.alert_state(df, 50)).where("is_alert").collect()}


def test_alert_state_log_keeps_the_newest_flag(spark):
    src, out = _dir(spark, "in"), _dir(spark, "out")
    _files(spark, [[("a", "g", 1, 9), ("b", "g", 1, 0)], [("a", "g", 2, 0)], [("b", "g", 3, 7)]], TOTALS, src)
    stream = spark.readStream.schema(TOTALS).option("maxFilesPerTrigger", 1).parquet(src)
    jobs.alert_state_log(jobs.alert_state_stream(stream, 5), out, out + "-ckpt").awaitTermination()
    assert {(r.topic, r.is_alert) for r in jobs.read_alert_state(spark, out).collect()} == {("a", False), ("b", True)}
    assert spark.read.parquet(out).select("batch_id").distinct().count() >= 3


def test_stateful_gives_the_store_back(spark):
    before = spark.conf.get(live.PROVIDER)
    with pytest.raises(ValueError):
        with live.stateful(spark):
            assert spark.conf.get(live.PROVIDER) == live.ROCKSDB
            raise ValueError
    assert spark.conf.get(live.PROVIDER) == before
    with pytest.raises(ValueError):
        live.live_lag(None, None, M.FIXED_NOW, 0, "1 second")
