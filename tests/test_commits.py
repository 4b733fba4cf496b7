"""Commits under several writers, across crashes, and what is built on them."""

import datetime as dt
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from pipewright import model as M
from pipewright.functions.jsonschema import SchemaCompileError
from pipewright.operators import dlq as D
from pipewright.operators import lag as L
from pipewright.operators import registry as REG
from pipewright.operators import route as R
from pipewright.session import checkpoint_dir
from pipewright.sources import commits as C
from pipewright.sources import fixtures as FX
from pipewright.sources import offset_log as O
from pipewright.streaming import jobs

SF = "/root/testdata/sf0.001"
NOW = dt.datetime(2024, 1, 31)


def root_of(spark, name):
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:8]}")


def requests(spark, rows):
    return spark.createDataFrame(rows, "topic_name string, schema_json string, requested_at timestamp_ntz, seq bigint")


def test_of_many_writers_one_gets_a_version(spark):
    root, won = root_of(spark, "race"), []

    def go(k):
        if C.create_absent(spark, f"{root}/_log/{1:020d}.json", f'{{"version": 1, "by": {k}}}'):
            won.append(k)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and C.entries(spark, root)[1]["by"] == won[0]
    assert C.versions(spark, root) == [1]
    with pytest.raises(C.Conflict):
        C.commit(spark, root, 1, {})


def test_racing_registrations_lose_no_version(spark):
    root = root_of(spark, "registry")
    doc = '{"type":"object","required":["%s"]}'
    errors = []

    def go(k):
        try:
            REG.register_at(spark, root, requests(spark, [("a", doc % f"w{k}", NOW, 1), ("a", doc % f"x{k}", NOW, 2), (f"own{k}", doc % "y", NOW, 1)]), NOW)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    version, tables = C.current(spark, root)
    rows = tables["schemas"].collect()
    assert version == 4 and len(rows) == 12
    a = sorted((r.version, r.schema_json, r.is_active) for r in rows if r.topic_name == "a")
    assert [v for v, *_ in a] == list(range(1, 9)) and [x for *_, x in a] == [False] * 7 + [True]
    assert {s for _, s, _ in a} == {doc % f"{c}{k}" for c in "wx" for k in range(4)}
    assert {a[i][1][-4] == a[i + 1][1][-4] for i in range(0, 8, 2)} == {True}  # each writer's two stay together
    assert {r.name for r in tables["topics"].collect()} == {"a", *(f"own{k}" for k in range(4))}


def test_a_bad_document_registers_nothing(spark):
    root = root_of(spark, "registry")
    for bad in ("{", '{"type":"nope"}', '{"pattern":"("}'):
        with pytest.raises(SchemaCompileError):
            REG.register_at(spark, root, requests(spark, [("a", '{"type":"object"}', NOW, 1), ("b", bad, NOW, 1)]), NOW)
    assert C.current(spark, root) == (0, {})
    REG.check_requests(requests(spark, [("a", '{"pattern":"^[a-z]+$"}', NOW, 1)]))


def test_batch_is_whole_or_not_there_and_once(spark):
    root, crashes = root_of(spark, "pair"), [True]

    def write(folder):
        spark.range(5).write.parquet(folder("topics"))
        if crashes.pop() if crashes else False:
            raise RuntimeError("the driver is gone")
        spark.range(3).write.parquet(folder("dlq"))

    with pytest.raises(RuntimeError):
        C.publish_batch(spark, root, "w", 7, write)
    rows = lambda t: C.read_table(spark, root, t, "id bigint").count()
    assert (rows("topics"), rows("dlq")) == (0, 0)
    assert C.publish_batch(spark, root, "w", 7, write) == 1
    assert C.publish_batch(spark, root, "w", 7, write) == 1  # again: nothing new
    assert (rows("topics"), rows("dlq")) == (5, 3)
    assert C.publish_batch(spark, root, "other", 7, write) == 2
    assert C.read_table(spark, root, "topics", "id bigint", after=1).count() == 5


def test_route_stream_across_a_crash_between_its_two_writes(spark):
    events, wd = FX.event_log(spark, SF), root_of(spark, "atomic")
    src = f"{wd}/in"
    events.repartition(4, "event_id").write.parquet(src)
    stream = lambda: spark.readStream.schema(M.EVENT_LOG).option("maxFilesPerTrigger", 1).parquet(src)
    crash = {2}

    def between(batch_id):
        if batch_id in crash:
            crash.discard(batch_id)
            raise RuntimeError("lost between the two writes")

    def go():
        q = jobs.route_stream_committed(stream(), lambda: FX.schemas(spark), M.FIXED_NOW, f"{wd}/out", f"{wd}/ckpt", between=between)
        q.awaitTermination()

    with pytest.raises(Exception, match="lost between"):
        go()
    go()
    topics, dlq = (C.read_table(spark, f"{wd}/out", t, s) for t, s in (("topics", jobs.MESSAGES), ("dlq", M.DLQ_EVENTS)))
    routed = R.route(events, FX.schemas(spark), M.FIXED_NOW)
    assert topics.count() == routed.where("route = 'published'").count()
    assert sorted(r.id for r in dlq.collect()) == sorted(r.dlq_event_id for r in routed.where("route = 'dlq'").collect())
    for v, e in C.entries(spark, f"{wd}/out").items():  # both tables in each commit
        assert set(e["tables"]) == {"topics", "dlq"}, v


def _state(spark):
    rows = [(f"e{i}", "click", 0, -1, '{"order_id":"a","amount":1,"currency":"USD"}' if i % 2 else "{", "schema_validation", "m", i % 5, "pending" if i % 7 else "retried", "p", NOW, NOW, None) for i in range(40)]
    return spark.createDataFrame(rows, M.DLQ_EVENTS)


def test_overlapping_retry_batches_replay_each_event_once(spark):
    root, state = root_of(spark, "claims"), _state(spark)
    a, b = (spark.createDataFrame([(k, f"e{i}") for k, i in enumerate([*part, part[0], 99])], M.RETRY_REQUESTS) for part in (range(0, 30), range(20, 40)))
    out, errors = {}, []

    def go(name, req):
        try:
            got = D.retry_claimed(state, req, FX.schemas(spark), NOW, root, name)
            out[name] = got["results"].collect(), got["messages"].collect(), got["transitions"].collect()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=go, args=x) for x in (("one", a), ("two", b))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    good = [r.id for n in out for r in out[n][0] if r.success]
    published = [r.replay_of for n in out for r in out[n][1]]
    passing = {f"e{i}" for i in range(40) if i % 2 and i % 7}
    assert sorted(good) == sorted(published) == sorted(passing)
    changed = [r.id for n in out for r in out[n][2]]
    assert len(changed) == len(set(changed)) == sum(1 for i in range(40) if i % 7)
    again = D.retry_claimed(state, a, FX.schemas(spark), NOW, root, "one")  # a rerun owns what it owned
    assert sorted(map(tuple, again["results"].collect())) == sorted(map(tuple, out["one"][0]))
    later = D.current_state(state, again["transitions"])  # a failed event, pending with a greater count, can be claimed again
    third = D.retry_claimed(later, a, FX.schemas(spark), NOW, root, "three")
    assert {r.id for r in third["owned"].collect()} == {r.id for r in later.where("status = 'pending'").join(again["transitions"].select("id"), "id").collect()}


def test_reading_from_offsets_takes_only_the_files_that_hold_them(spark):
    root, log = root_of(spark, "offsets"), FX.event_log(spark, SF)
    half = log.agg(F.expr("percentile(event_id, 0.5)")).first()[0]
    O.append(log.where(F.col("event_id") <= half), root, 0, rows_per_file=10)
    O.append(log.where(F.col("event_id") > half), root, 1, rows_per_file=10)
    assert O.append(log, root, 1) == 2  # committed already
    parts = FX.topic_partitions(spark, SF).select("topic", "partition_id")
    assert sorted(map(tuple, O.latest_offsets(spark, root).collect())) == sorted(tuple(r) for r in L.latest_offsets(parts, log).where("latest_offset > 0").collect())
    near = parts.join(O.latest_offsets(spark, root), ["topic", "partition_id"]).select("topic", "partition_id", (F.col("latest_offset") - 1).alias("from_offset"))
    got = O.read_from(spark, root, near)
    want = log.join(near, ["topic", "partition_id"]).where("kafka_offset >= from_offset")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())
    every = O.index(spark, root).select("file").distinct().count()
    assert 0 < len(O.files_from(spark, root, near)) < every / 2
    place = lambda files: {"/" + f.removeprefix("file:").lstrip("/") for f in files}
    held = place(r.file for r in O.index(spark, root).select("file").distinct().collect())
    assert place(got.inputFiles()) & held == place(O.files_from(spark, root, near))
    none = near.withColumn("from_offset", F.lit(10**9))
    assert O.files_from(spark, root, none) == [] and O.read_from(spark, root, none).count() == 0


def _files_read(df):
    """Files and rows that the scans of a collected query read."""
    plan = df._jdf.queryExecution().executedPlan()
    todo, files, rows = [plan], 0, 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if "QueryStageExec" in name:
            todo.append(p.plan())
            continue
        if name == "FileSourceScanExec":
            files += p.metrics().apply("numFiles").value()
            rows += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return files, rows


def test_lookup_by_id_reads_its_bucket(spark):
    from pipewright.sources import dlq_store

    root, dlq = root_of(spark, "store"), FX.dlq_events(spark, SF)
    early = F.col("id") < "dlq-5"
    dlq_store.append(dlq.where(early), root, 0, buckets=8)
    dlq_store.append(dlq.where(~early), root, 1, buckets=32)
    assert dlq_store.append(dlq, root, 1) == 2
    for event in ("dlq-40", "dlq-999", "dlq-7", "no such id"):
        got = dlq_store.by_id(spark, root, event)
        rows = got.collect()
        assert rows == dlq.where(F.col("id") == event).collect()
        files, read = _files_read(got)
        assert files <= 2 and read < dlq.count() / 5
    ids = spark.createDataFrame([("dlq-1",), ("dlq-77",), ("dlq-77",), ("none",)], "id string")
    assert sorted(r.id for r in dlq_store.by_ids(spark, root, ids).collect()) == ["dlq-1", "dlq-77"]


def test_kept_counts_equal_full_counts_after_random_batches(spark):
    import random

    rng = random.Random(4)
    state = {f"e{i}": [rng.choice(["a", "b", None]), rng.choice(M.STATUSES)] for i in range(60)}
    frame = lambda: spark.createDataFrame([(i, t, s) for i, (t, s) in state.items()], "id string, topic_name string, status string")
    counts = D.status_counts(frame())
    for batch in range(3):
        new = {f"n{batch}-{i}": [rng.choice(["a", "b", "c", None]), "pending"] for i in range(rng.randint(0, 9))}
        moves = []
        for i in rng.sample(sorted(state), 25):
            for _ in range(rng.randint(1, 2)):  # an id may move twice in a batch
                to = rng.choice(M.STATUSES)
                moves.append((i, state[i][0], state[i][1], to))
                state[i][1] = to
        state |= new
        rows = spark.createDataFrame([(i, t, s) for i, (t, s) in new.items()], "id string, topic_name string, status string")
        change = D.count_changes(rows, spark.createDataFrame(moves, "id string, topic_name string, from_status string, status string"))
        counts = spark.createDataFrame(D.apply_changes(counts, change).collect(), "topic_name string, status string, n bigint")
    assert D.stats_of_counts(counts).collect() == D.stats(frame()).collect()
    assert D.stats_of_counts(counts, "a").collect() == D.stats(frame(), "a").collect()
    left = lambda df: sorted((str(r.topic_name), r.depth) for r in df.collect() if r.depth)
    assert left(D.depth_of_counts(counts)) == left(D.depth(frame()))
    with pytest.raises(ValueError):
        D.count_changes()


def test_transitions_carry_the_status_before(spark):
    state = _state(spark)
    req = spark.createDataFrame([(i, f"e{i}") for i in range(40)], M.RETRY_REQUESTS)
    out = D.retry(state, req, FX.schemas(spark), NOW)
    for trans in (out["transitions"], D.transitions(state, out["state"], 0)):
        counts = D.apply_changes(D.status_counts(state), D.count_changes(transitions=trans))
        assert D.stats_of_counts(counts).collect() == D.stats(out["state"]).collect()
    gone = D.discard_transitions(state, state.select("id").limit(9), NOW)
    counts = D.apply_changes(D.status_counts(state), D.count_changes(transitions=gone))
    assert D.stats_of_counts(counts).collect() == D.stats(D.current_state(state, gone)).collect()


def test_sketched_p95_over_any_range_of_days(spark):
    rows = [("a", "g", 1_704_067_200 + d * 86_400 + i, (i * 7919 + d * 31) % 5003) for d in range(6) for i in range(4000)]
    rows += [("b", "g", 1_704_067_200, 3)]
    r = spark.createDataFrame(rows, "topic string, consumer_group string, ts_sec bigint, lag bigint")
    sketches = L.day_sketches(r)
    for first, last in ((0, 5), (2, 3), (4, 4)):
        day = lambda d: dt.date(2024, 1, 1 + d)
        got = {x.topic: x for x in L.p95_from_sketches(sketches, day(first), day(last)).collect()}
        values = sorted(v for t, _, s, v in rows if t == "a" and first <= (s - 1_704_067_200) // 86_400 <= last)
        under, upto = (sum(v < got["a"].lag_p95 for v in values) / len(values), sum(v <= got["a"].lag_p95 for v in values) / len(values))
        assert under <= 0.95 + L.SKETCH_ERROR and upto >= 0.95 - L.SKETCH_ERROR and got["a"].n_sketched == len(values)
        assert ("b" in got) == (first == 0)
