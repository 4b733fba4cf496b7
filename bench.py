"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Each query runs once to warm up, then $BENCH_REPS times; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pipewright import model as M  # noqa: E402
from pipewright.operators import route as R  # noqa: E402
from pipewright.plans import catalog as C  # noqa: E402
from pipewright.session import checkpoint_dir, local_session  # noqa: E402
from pipewright.sources import fixtures as FX  # noqa: E402


def _consume(df) -> int:
    """Run the whole plan (no driver collect of the rows)."""
    return df.write.format("noop").mode("overwrite").save() or 0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16)
    scratch = os.path.join(checkpoint_dir(spark), "bench-" + uuid.uuid4().hex[:8])
    n_events = FX.events(spark, sf_dir).count()

    def route_batch():
        routed = R.route(FX.event_log(spark, sf_dir), FX.schemas(spark), M.FIXED_NOW)
        out = os.path.join(scratch, uuid.uuid4().hex[:8])
        R.publish(routed, M.FIXED_NOW, R.parquet_sink(os.path.join(out, "topics")),
                  R.parquet_sink(os.path.join(out, "dlq"), partition_by="topic_name"))

    def stream_route():
        C.queries()["stream_route"](spark, sf_dir).count()

    def q(name):
        return lambda: _consume(C.queries()[name](spark, sf_dir))

    jobs = {
        "route_batch": route_batch,
        "stream_route": stream_route,
        "validate_events": q("validate_events"),
        "publish_results": q("publish_results"),
        "jsonschema_extended": q("jsonschema_extended"),
        "partition_lag": q("partition_lag"),
        "lag_update": q("lag_update"),
        "lag_history": q("lag_history"),
        "latest_lag_1m": q("latest_lag_1m"),
        "lag_chart": q("lag_chart"),
        "lag_running_peak": q("lag_running_peak"),
        "dlq_retry_batch": q("dlq_retry_batch"),
        "dlq_fold": q("dlq_fold"),
        "dlq_list": q("dlq_list"),
        "schema_as_of": q("schema_as_of"),
        "topology_nodes": q("topology_nodes"),
        "metric_event_rate": q("metric_event_rate"),
    }
    only = os.environ.get("BENCH_ONLY")
    if only:
        jobs = {k: v for k, v in jobs.items() if re.fullmatch(only, k)}
    times: dict[str, float] = {}
    for name, fn in jobs.items():
        fn()  # warm-up
        runs = []
        for _ in range(reps):
            t = time.perf_counter()
            fn()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs), 3)
    total = round(sum(times.values()), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": float(sf.group(1)) if sf else sf_dir, "cpus": cpus, "reps": reps,
        "events": n_events,
        "route_batch_events_per_sec": round(n_events / times["route_batch"], 1) if times.get("route_batch") else None,
        "stream_route_events_per_sec": round(n_events / times["stream_route"], 1) if times.get("stream_route") else None,
        "driver_memory": spark.conf.get("spark.driver.memory", None),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
