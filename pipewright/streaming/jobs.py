"""Structured Streaming jobs (STR-1..4, STR-7).

Each job reads an append-only source with ``readStream`` and keeps its state
in Spark (watermarked windows, stateful aggregations) or writes idempotently
per micro-batch (``foreachBatch`` into ``batch_id=N`` folders). The
``*_result`` helpers used by the registered queries stage the driver data as
files in the shared checkpoint folder, run the stream to completion with
``availableNow`` and read the sink back.
"""

from __future__ import annotations

import datetime as _dt
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import ts_literal
from ..operators import route as R
from ..session import checkpoint_dir, configure
from ..sources import commits
from ..sources import fixtures as FX
from ..sources.tables import read_event_stream
from . import live

DEFAULT_POLL_SECONDS = 5


def poll_trigger(seconds: int = DEFAULT_POLL_SECONDS) -> dict:
    """STR-2: the poll period as a processing-time trigger (at least 1 s;
    checked before any job starts). The first trigger fires immediately."""
    M.check_params(poll_seconds=seconds)
    return {"processingTime": f"{int(seconds)} seconds"}


def _workdir(spark: SparkSession, job: str) -> str:
    d = os.path.join(checkpoint_dir(spark), "pw-stream", f"{job}-{uuid.uuid4().hex[:12]}")
    return d


def _stage(df: DataFrame, path: str, rows_per_file: int = 0) -> str:
    """Write a frame as files, one or more for each of its partitions."""
    df.write.option("maxRecordsPerFile", rows_per_file).mode("overwrite").parquet(path)
    return path


# -- STR-1: continuous validate-and-route -------------------------------------

def route_stream(stream: DataFrame, schemas_reader, now, topic_out: str, dlq_out: str,
                 checkpoint: str, trigger: dict | None = None, metrics_out: str | None = None,
                 topic_sink=None, dlq_sink=None):
    """STR-1: validate and route every micro-batch. ``schemas_reader``
    returns the registry (a DataFrame) or a compiled ``Validator`` (e.g. a
    ``SnapshotRegistry``) and is called per batch, so a newly registered
    schema takes effect at the next batch. Outputs go to ``batch_id=N`` folders (overwritten on a rerun of
    the same batch), and DLQ ids are deterministic: reruns are idempotent.

    ``now`` is a fixed time or a function called for each batch. A batch
    whose DLQ write fails isn't committed; the next start runs it again.
    ``topic_sink`` and ``dlq_sink`` (batch id -> sink) replace the Parquet logs."""
    def each(batch: DataFrame, batch_id: int) -> None:
        at = now() if callable(now) else now
        reg = schemas_reader()
        if isinstance(reg, R.Validator):
            routed = R.route(batch, None, at, validator=reg)
        else:
            routed = R.route(batch, reg, at)
        to_topic = topic_sink(batch_id) if topic_sink else R.parquet_sink(topic_out, batch_id)
        to_dlq = dlq_sink(batch_id) if dlq_sink else R.parquet_sink(dlq_out, batch_id, partition_by="topic_name")
        status = R.publish(routed, at, to_topic, to_dlq)
        if metrics_out and "validation" in status:
            # DOC-2 per batch: one row, idempotent per batch_id like the outputs
            v = status["validation"]
            row = [(int(batch_id), int(v["events"]), int(v["valid"]), int(v["invalid"]),
                    int(v["no_schema"]), bool(status["published"]))]
            m = batch.sparkSession.createDataFrame(
                row, "batch_id long, events long, valid long, invalid long, no_schema long, published boolean")
            m.write.mode("overwrite").parquet(f"{metrics_out}/batch_id={batch_id}")
    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


#: Columns of the committed topic log.
MESSAGES = "topic string, key string, value string, headers map<string,string>"


def route_stream_committed(stream: DataFrame, schemas_reader, now, root: str, checkpoint: str,
                           trigger: dict | None = None, writer: str = "route", between=None):
    """STR-1 with SNK-1 and SNK-2 as one commit: a batch's messages (table
    ``topics``) and rejected events (``dlq``) become visible together.

    A batch that dies between its two writes has committed nothing, and one that
    runs again after its commit commits nothing more, so each event is in exactly
    one of the tables exactly once. Read them with ``commits.read_table``.
    ``between`` is called with the batch id after the first write (tests).
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        at = now() if callable(now) else now
        reg = schemas_reader()
        routed = R.route(batch, None, at, validator=reg) if isinstance(reg, R.Validator) else R.route(batch, reg, at)

        def write(folder) -> None:
            failed: list[Exception] = []

            def topics(df: DataFrame) -> None:
                try:
                    df.write.parquet(folder("topics"))
                    if between:
                        between(batch_id)
                except Exception as e:
                    failed.append(e)
                    raise

            R.publish(routed, at, topics, lambda df: df.write.parquet(folder("dlq")))
            if failed:  # nothing is half published here: the batch runs again
                raise failed[0]

        commits.publish_batch(batch.sparkSession, root, writer, batch_id, write)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def stream_route_committed_result(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    wd = _workdir(spark, "route-committed")
    src = _stage(FX.event_log(spark, sf), os.path.join(wd, "in"), rows_per_file=50_000)
    stream = read_event_stream(spark, src, M.EVENT_LOG, max_files_per_trigger=16)
    out = os.path.join(wd, "out")
    route_stream_committed(stream, lambda: FX.schemas(spark), M.FIXED_NOW, out, os.path.join(wd, "ckpt")).awaitTermination()
    pub = commits.read_table(spark, out, "topics", MESSAGES).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    dlq = commits.read_table(spark, out, "dlq", M.DLQ_EVENTS).groupBy(F.col("topic_name").alias("topic")).agg(F.count(F.lit(1)).alias("n"))
    return pub.withColumn("route", F.lit(R.ROUTE_PUBLISHED)).unionByName(dlq.withColumn("route", F.lit(R.ROUTE_DLQ)))


def stream_route_result(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    wd = _workdir(spark, "route")
    src = _stage(FX.event_log(spark, sf), os.path.join(wd, "in"), rows_per_file=50_000)
    stream = read_event_stream(spark, src, M.EVENT_LOG, max_files_per_trigger=16)
    from ..sources.storage import write_snapshot
    write_snapshot(FX.schemas(spark), os.path.join(wd, "registry"))
    q = route_stream(stream, R.SnapshotRegistry(spark, os.path.join(wd, "registry")), M.FIXED_NOW,
                     os.path.join(wd, "topics"), os.path.join(wd, "dlq"), os.path.join(wd, "ckpt"))
    q.awaitTermination()
    pub = spark.read.parquet(os.path.join(wd, "topics")).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n")).withColumn("route", F.lit(R.ROUTE_PUBLISHED))
    dlq = spark.read.parquet(os.path.join(wd, "dlq")).groupBy(F.col("topic_name").alias("topic")).agg(
        F.count(F.lit(1)).alias("n")).withColumn("route", F.lit(R.ROUTE_DLQ))
    return pub.unionByName(dlq)


# -- STR-2/3: live lag polls ----------------------------------------------------

def _drained(df: DataFrame, wd: str, mode: str = "append") -> str:
    """Runs a stream over what its source holds into a Parquet log."""
    out = os.path.join(wd, "out")
    with live.stateful(df.sparkSession):
        q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", os.path.join(wd, "ckpt"))
             .trigger(availableNow=True).start(out))
        q.awaitTermination()
    return out


def stream_lag_result(spark: SparkSession, sf: str, period_seconds: int = 3600,
                      delay_seconds: int = 600) -> DataFrame:
    """Totals of every poll from the first event's hour to the one after the last event."""
    configure(spark)
    wd = _workdir(spark, "lag")
    rows = FX.poll_rows(spark, sf)
    src = _stage(rows, os.path.join(wd, "in"))
    first, last = spark.read.parquet(src).agg(F.min(F.unix_seconds("ts")), F.max(F.unix_seconds("ts"))).first()
    start = first // period_seconds * period_seconds
    end = (last // period_seconds + 1) * period_seconds
    beat = spark.range(1).select(F.lit(live.HEARTBEAT).alias("kind"), *[F.lit(None).cast(t).alias(n) for n, t in (
        ("topic", "string"), ("partition_id", "int"), ("consumer_group", "string"), ("value", "bigint"))],
        F.timestamp_seconds(F.lit(end + delay_seconds + 1)).alias("ts"), F.lit(None).cast("bigint").alias("seq"))
    beat.write.mode("append").parquet(src)
    stream = spark.readStream.schema(live.POLL_INPUT).parquet(src)
    polled = live.live_lag(stream, FX.poll_grid(spark, sf), _utc(start), period_seconds, f"{delay_seconds} seconds")
    out = _drained(live.live_totals(polled), wd)
    res = spark.read.schema("poll timestamp, topic string, consumer_group string, total_lag bigint").parquet(out)
    return res.withColumn("poll", F.col("poll").cast("timestamp_ntz"))


def _utc(seconds: int) -> _dt.datetime:
    return _dt.datetime.fromtimestamp(seconds, _dt.timezone.utc).replace(tzinfo=None)


# -- STR-6: expiry, STR-4: alerts ----------------------------------------------

def _beaten(readings: DataFrame, src: str, at_sec: int) -> DataFrame:
    """Readings staged as files with a heartbeat (a row without a series) at `at_sec`, as a stream."""
    _stage(readings, src)
    spark = readings.sparkSession
    blank = spark.range(1).select(*[F.lit(at_sec if f.name == "ts_sec" else None).cast(f.dataType).alias(f.name) for f in readings.schema])
    blank.write.mode("append").parquet(src)
    return spark.readStream.schema(readings.schema).parquet(src)


def stream_expiry_result(spark: SparkSession, sf: str, now=M.FIXED_NOW, ttl_hours: int = M.LAG_TTL_HOURS) -> DataFrame:
    """Every expiry of a series up to `now`."""
    configure(spark)
    wd = _workdir(spark, "expiry")
    at = spark.range(1).select(F.unix_seconds(ts_literal(now).cast("timestamp"))).first()[0]
    stream = _beaten(FX.user_readings(spark, sf), os.path.join(wd, "in"), at + 60)
    out = _drained(live.expiry_stream(stream, ttl_hours * 3600, "60 seconds"), wd)
    res = spark.read.schema("topic string, consumer_group string, first_write bigint, last_write bigint, expired_at timestamp").parquet(out)
    return res.withColumn("expired_at", F.col("expired_at").cast("timestamp_ntz"))


def stream_transitions_result(spark: SparkSession, sf: str, threshold: int) -> DataFrame:
    """Every raise and clear of the readings' alerts, from the stream's append-only log."""
    configure(spark)
    wd = _workdir(spark, "transitions")
    readings = FX.lag_readings(spark, sf).withColumnRenamed("lag", "total_lag")
    last = readings.agg(F.max("ts_sec")).first()[0] or 0
    stream = _beaten(readings, os.path.join(wd, "in"), last + 2 * 3600 + 1)
    out = _drained(live.transition_stream(stream, threshold, "10 minutes"), wd)
    return spark.read.schema("topic string, consumer_group string, ts_sec bigint, total_lag bigint, is_alert boolean, transition string").parquet(out)


def alerting_topics(transitions: DataFrame) -> DataFrame:
    """STR-4 by topic: topics of which some series' newest transition is a raise, with their number."""
    newest = transitions.groupBy("topic", "consumer_group").agg(F.max_by("is_alert", F.struct("ts_sec", "total_lag")).alias("is_alert"))
    return newest.where("is_alert").groupBy("topic").agg(F.count(F.lit(1)).alias("alerting_groups"))


def alert_state_stream(totals: DataFrame, threshold: int) -> DataFrame:
    """STR-4: the newest alert flag per series (a stateful max_by)."""
    t = totals.withColumn("is_alert", F.col("total_lag") > F.lit(threshold))
    return t.groupBy("topic", "consumer_group").agg(
        F.max_by("is_alert", F.struct("ts_sec", "total_lag")).alias("is_alert"))


def alert_state_log(state: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Series whose flag a batch updated, in a `batch_id=N` folder of its own:
    a rerun of the batch overwrites its folder only, and readers always find the earlier ones."""
    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
    return (state.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def read_alert_state(spark: SparkSession, out: str) -> DataFrame:
    """The state as of the newest batch that each series was in."""
    log = spark.read.schema("topic string, consumer_group string, is_alert boolean, batch_id bigint").parquet(out)
    return log.groupBy("topic", "consumer_group").agg(F.max_by("is_alert", "batch_id").alias("is_alert"))


def stream_alert_state_result(spark: SparkSession, sf: str, threshold: int) -> DataFrame:
    configure(spark)
    wd = _workdir(spark, "alerts")
    src = _stage(FX.lag_readings(spark, sf).withColumnRenamed("lag", "total_lag"), os.path.join(wd, "in"))
    stream = (spark.readStream.schema("topic string, consumer_group string, ts_sec bigint, total_lag bigint")
              .option("maxFilesPerTrigger", 1).parquet(src))
    out = os.path.join(wd, "out")
    alert_state_log(alert_state_stream(stream, threshold), out, os.path.join(wd, "ckpt")).awaitTermination()
    return read_alert_state(spark, out)


# -- STR-7: event rate over time ----------------------------------------------

def event_rate_stream(log: DataFrame, window: str = "1 minute", delay: str = "10 minutes",
                      seconds: float = 60.0) -> DataFrame:
    """STR-7: events per second per topic and tumbling window; rows later
    than the watermark are dropped (our stated rule)."""
    return (log.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "topic")
            .agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").alias("window_start"), "topic", "events",
                    (F.col("events") / F.lit(seconds)).alias("rate")))


def stream_event_rate_result(spark: SparkSession, sf: str) -> DataFrame:
    configure(spark)
    wd = _workdir(spark, "rate")
    log = FX.event_log(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), "topic")
    src = _stage(log, os.path.join(wd, "in"))
    # a row without a topic, so far on that the watermark passes every window
    last = spark.read.parquet(src).agg(F.max("ts").alias("ts"))
    last.select((F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"), F.lit(None).cast("string").alias("topic")) \
        .write.mode("append").parquet(src)
    stream = spark.readStream.schema("ts timestamp, topic string").parquet(src)
    out = os.path.join(wd, "out")
    q = (event_rate_stream(stream).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", os.path.join(wd, "ckpt")).trigger(availableNow=True).start(out))
    q.awaitTermination()
    res = spark.read.schema("window_start timestamp, topic string, events bigint, rate double").parquet(out)
    return res.where("topic is not null").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
