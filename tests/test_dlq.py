"""DLQ state machine: closed forms against a step-by-step Python model."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pipewright import model as M
from pipewright.operators import dlq as D
from pipewright.sources.fixtures import FULL_JSON

NOW = dt.datetime(2024, 1, 31)
SCHEMAS = [("s1", "orders", 1, FULL_JSON, True, dt.datetime(2024, 1, 1))]
GOOD = '{"order_id":"a","amount":1,"currency":"USD"}'
BAD = '{"order_id":"a","amount":-1,"currency":"USD"}'


def dlq_frame(spark, rows):
    data = [(i, "orders", 0, -1, p, "schema_validation", "m", r, s, "p", NOW, NOW, None)
            for (i, p, s, r) in rows]
    return spark.createDataFrame(data, M.DLQ_EVENTS)


def model_retry(state, requests, verdict):
    """The reference's loop: one request at a time."""
    st_ = {k: dict(v) for k, v in state.items()}
    out = []
    for rid in requests:
        if rid not in st_:
            out.append((rid, False, "not found"))
            continue
        e = st_[rid]
        if e["status"] != "pending":
            out.append((rid, False, "cannot"))
            continue
        if verdict[rid]:
            e["status"], e["retry"] = "retried", e["retry"] + 1
            out.append((rid, True, "ok"))
        else:
            e["status"] = "discarded" if e["retry"] + 1 >= 5 else "pending"
            e["retry"] += 1
            out.append((rid, False, "failed"))
    return out, st_


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([GOOD, BAD]), st.sampled_from(list(M.STATUSES)),
                          st.integers(0, 7)), min_size=1, max_size=4),
       st.lists(st.integers(0, 4), min_size=1, max_size=10))
def test_retry_batch_matches_loop(spark, events, req_idx):
    rows = [(f"id{i}", p, s, r) for i, (p, s, r) in enumerate(events)]
    ids = [f"id{i}" for i in req_idx]
    dlq = dlq_frame(spark, rows)
    schemas = spark.createDataFrame(SCHEMAS, M.SCHEMAS)
    req = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "pos bigint, id string")
    out = D.retry(dlq, req, schemas, NOW)
    res = sorted(out["results"].collect())
    state = {r[0]: {"status": r[2], "retry": r[3]} for r in rows}
    verdict = {r[0]: r[1] == GOOD for r in rows}
    exp, exp_state = model_retry(state, ids, verdict)
    assert [r["success"] for r in res] == [e[1] for e in exp]
    for r, e in zip(res, exp):
        kind = {"not found": "event not found", "cannot": "cannot retry", "ok": "event replayed",
                "failed": "replay failed"}[e[2]]
        assert r["message"].startswith(kind), (r, e)
    got_state = {r["id"]: (r["status"], r["retry_count"]) for r in out["state"].collect()}
    assert got_state == {k: (v["status"], v["retry"]) for k, v in exp_state.items()}
    n_fail_runs = sum(1 for e in exp if e[2] == "failed")
    assert out["replay_rows"].count() == n_fail_runs


def model_fold(actions):
    st_, n = "pending", 0
    for a in actions:
        if a == "discard":
            st_ = "discarded"
        elif st_ != "pending":
            pass
        elif a == "retry_ok":
            st_, n = "retried", n + 1
        else:
            n += 1
            st_ = "discarded" if n >= 5 else "pending"
    return st_, n


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["retry_ok", "retry_fail", "discard"]), min_size=1, max_size=12),
                min_size=1, max_size=5))
def test_fold_matches_model(spark, logs):
    data = []
    seq = 0
    for i, log in enumerate(logs):
        for a in log:
            data.append((f"x{i}", seq, NOW, a))
            seq += 1
    got = {r[0]: (r[1], r[2]) for r in D.fold(spark.createDataFrame(data, M.DLQ_ACTIONS)).collect()}
    assert got == {f"x{i}": model_fold(log) for i, log in enumerate(logs)}


def test_fifth_failure_discards(spark):
    dlq = dlq_frame(spark, [("a", BAD, "pending", 4), ("b", BAD, "pending", 3)])
    schemas = spark.createDataFrame(SCHEMAS, M.SCHEMAS)
    req = spark.createDataFrame([(0, "a"), (1, "b")], "pos bigint, id string")
    st_ = {r["id"]: (r["status"], r["retry_count"]) for r in D.retry(dlq, req, schemas, NOW)["state"].collect()}
    assert st_ == {"a": ("discarded", 5), "b": ("pending", 4)}


def test_stats_empty_input_is_one_zero_row(spark):
    empty = spark.createDataFrame([], M.DLQ_EVENTS)
    rows = D.stats(empty).collect()
    assert len(rows) == 1 and rows[0]["total"] == 0 and rows[0]["pending"] == 0


def test_list_defaults_and_filters(spark):
    dlq = dlq_frame(spark, [(f"i{k}", GOOD, "pending" if k % 2 else "retried", 0) for k in range(120)])
    assert D.list_events(dlq).count() == 50
    assert D.list_events(dlq, status="pending", limit=100).count() == 60
    assert D.list_events(dlq, status="pending", offset=50, limit=100).count() == 10
    assert D.page(dlq, 2).count() == 20


def test_discard_any_status_unknown_ok(spark):
    dlq = dlq_frame(spark, [("a", GOOD, "retried", 2), ("b", GOOD, "pending", 1)])
    ids = spark.createDataFrame([("a",), ("zz",)], "id string")
    got = {r["id"]: (r["status"], r["retry_count"]) for r in D.discard(dlq, ids, NOW).collect()}
    assert got == {"a": ("discarded", 2), "b": ("pending", 1)}


def test_payload_view(spark):
    dlq = dlq_frame(spark, [("a", GOOD, "pending", 0), ("b", "null", "pending", 0), ("c", "not json", "pending", 0)])
    v = D.payload_view(dlq.withColumn("producer_id", F.lit("")))
    rows = {r["id"]: r for r in v.select("id", F.to_json("payload").alias("j"), "producer_id").collect()}
    assert rows["a"]["j"].startswith('{"amount":1')
    assert rows["b"]["j"] is None
    assert rows["c"]["j"] == '{"raw":"not json"}'
    assert rows["a"]["producer_id"] is None


def test_transitions_rebuild_the_state(spark):
    from pipewright.sources import fixtures as FX
    sf = "/root/testdata/sf0.001"
    dlq = FX.dlq_events(spark, sf)
    out = D.retry(dlq, FX.retry_requests(spark, sf), FX.schemas(spark), NOW, seq=1)
    rebuilt = D.current_state(dlq, out["transitions"])
    cols = ["id", "status", "retry_count", "error_message", "last_retry_at", "updated_at"]
    assert sorted(rebuilt.select(*cols).collect()) == sorted(out["state"].select(*cols).collect())
    ids = dlq.filter(F.col("error_type") == "publish_error").select("id")
    tr = D.discard_transitions(dlq, ids, NOW, seq=2)
    rebuilt2 = D.current_state(dlq, tr)
    assert sorted(rebuilt2.select(*cols).collect()) == sorted(D.discard(dlq, ids, NOW).select(*cols).collect())
