"""

Each entry takes (spark, sf_dir) and returns a DataFrame over the whole
input tables (or data Spark derives from them). Column names and types
match the oracle SQL in ``sql.py`` one to one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions import scalars as S
from ..operators import dlq as D
from ..operators import lag as L
from ..operators import registry as REG
from ..operators import route as R
from ..operators import topology as TP
from ..session import checkpoint_dir, configure
from ..sources import commits, dlq_store, offset_log
from ..sources import fixtures as FX
from ..sources.storage import cut_lineage

NOW = M.FIXED_NOW
RET_NOW = M.RETENTION_NOW
LAG_ALERT = 5000          # partition-lag alert threshold (total per series)
READING_ALERT = 2500      # alert threshold over the readings series
STORE_CUT = M.RETENTION_NOW

Query = Callable[[SparkSession, str], DataFrame]
_REG: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return fn(spark, sf_dir)
        wrapped.__name__ = fn.__name__
        wrapped.__doc__ = fn.__doc__
        _REG[name] = wrapped
        return wrapped
    return deco


def _root(spark: SparkSession, name: str) -> str:
    """A new folder for tables that a query writes and reads."""
    return f"{checkpoint_dir(spark).rstrip('/')}/pw-{name}/{uuid.uuid4().hex}"


def queries() -> dict[str, Query]:
    return dict(_REG)


# -- validate and route -------------------------------------------------------

def _routed(spark, sf):
    return R.route(FX.event_log(spark, sf), FX.schemas(spark), NOW)


@query("validate_events")
def validate_events(spark, sf):
    r = _routed(spark, sf)
    return r.select("event_id", "topic", "is_valid", "schema_id",
                    F.when(~F.col("is_valid"), F.col("error_message")).alias("error_message"),
                    F.when(F.col("is_valid"), F.lit(0)).otherwise(F.size("errors")).cast("bigint").alias("n_errors"))


@query("validation_errors")
def validation_errors(spark, sf):
    r = _routed(spark, sf).filter(~F.col("is_valid"))
    return r.select("topic", F.explode("errors").alias("error")).groupBy("topic", "error") \
        .agg(F.count(F.lit(1)).alias("n"))


@query("route_events")
def route_events(spark, sf):
    return _routed(spark, sf).groupBy("topic", "route", "error_type").agg(F.count(F.lit(1)).alias("n"))


@query("publish_results")
def publish_results(spark, sf):
    return R.publish_results(_routed(spark, sf), log=FX.event_log(spark, sf))


@query("published_messages")
def published_messages(spark, sf):
    m = R.published_messages(_routed(spark, sf), now=NOW)
    h = F.col("headers")
    return m.select("topic", "key", "value", h[M.HEADER_PRODUCER].alias("h_producer_id"),
                    h[M.HEADER_SCHEMA].alias("h_schema_id"), h[M.HEADER_PUBLISHED_AT].alias("h_published_at"))


@query("dlq_insert")
def dlq_insert(spark, sf):
    return R.dlq_rows(_routed(spark, sf), NOW)


@query("metric_rejection_rate")
def metric_rejection_rate(spark, sf):
    return TP.rejection_rate(_routed(spark, sf))


@query("parse_csv")
def parse_csv(spark, sf):
    items = S.parse_csv(F.col("payload"))
    return FX.event_log(spark, sf).select("event_id", F.size(items).cast("bigint").alias("n_items"),
                                          F.try_element_at(items, F.lit(1)).alias("first_item"))


@query("jsonschema_extended")
def jsonschema_extended(spark, sf):
    """Tier-B keywords (additionalProperties, minProperties, pattern,
    min/maxLength, maximum, exclusiveMinimum, multipleOf, not/const,
    dependencies) over every event payload."""
    from ..functions.jsonschema import errors_column, strict_parse
    log = FX.event_log(spark, sf).withColumn("_v", strict_parse(F.col("payload")))
    out = errors_column(log, FX.EXTENDED_SCHEMA, F.col("_v"))
    return out.select("event_id", F.col("_v").isNotNull().alias("is_json"),
                      F.when(F.col("_v").isNull(), F.lit(0)).otherwise(F.size("errors")).cast("bigint").alias("n_errors"),
                      F.when(F.col("_v").isNotNull(), F.array_join("errors", "; ")).alias("error_message"))


@query("jsonschema_keywords")
def jsonschema_keywords(spark, sf):
    """JS-6, JS-8 to JS-11: a document of array, object, combinator and reference keywords for each topic."""
    r = R.route(FX.keyword_events(spark, sf), FX.keyword_schemas(spark), NOW)
    return r.select("event_id", "topic", "is_valid", F.col("route").alias("route"))


# -- registry -----------------------------------------------------------------

def _registered(spark, sf, log=None):
    return REG.register(FX.schemas(spark), FX.schema_requests(spark, sf, log))


_SCHEMA_COLS = ["id", "topic_name", "version", "schema_json", "is_active", "created_at"]


@query("register_schemas")
def register_schemas(spark, sf):
    return _registered(spark, sf).select(*_SCHEMA_COLS)


@query("register_concurrent")
def register_concurrent(spark, sf):
    """Two writers: while the first one's registration is being written, the second commits its own."""
    root, log = _root(spark, "registry"), FX.log_summary(spark, sf)
    req = FX.schema_requests(spark, sf, log)
    commits.update_tables(spark, root, lambda _: {"schemas": FX.schemas(spark), "topics": FX.topics(spark, sf, log)})
    odd = F.dayofmonth("requested_at") % 2 == 1
    first, second, got_ahead = req.where(~odd), req.where(odd), []

    def change(tables):
        if not got_ahead:
            got_ahead.append(REG.register_at(spark, root, second, NOW))
        return {"schemas": REG.register(tables["schemas"], first), "topics": REG.upsert_topics(tables["topics"], first, NOW)}

    commits.update_tables(spark, root, change)
    return commits.current(spark, root)[1]["schemas"].select(*_SCHEMA_COLS)


@query("active_schema")
def active_schema(spark, sf):
    return REG.active_schema(_registered(spark, sf)).select(*_SCHEMA_COLS)


@query("schema_history")
def schema_history(spark, sf):
    return REG.schema_history(_registered(spark, sf), "view").select(*_SCHEMA_COLS)


@query("schema_orphans")
def schema_orphans(spark, sf):
    log = FX.log_summary(spark, sf)
    return REG.orphans(_registered(spark, sf, log), FX.topics(spark, sf, log)).select(*_SCHEMA_COLS)


@query("topic_upsert")
def topic_upsert(spark, sf):
    log = FX.log_summary(spark, sf)
    return REG.upsert_topics(FX.topics(spark, sf, log), FX.schema_requests(spark, sf, log), NOW) \
        .select("id", "name", "description", "partitions", "replication_factor", "created_at", "updated_at")


@query("schema_as_of")
def schema_as_of(spark, sf):
    d = FX.dlq_events(spark, sf).select("id", "topic_name", "created_at")
    return REG.as_of(d, _registered(spark, sf)).select("id", "topic_name", "created_at", "schema_id",
                                                       "schema_version")


# -- topics and offsets -------------------------------------------------------

def _topic_meta(spark, sf, log):
    managed = _registered(spark, sf, log).select(F.col("topic_name").alias("name")).distinct()
    return TP.topic_metadata(FX.topic_partitions(spark, sf, log), managed)


@query("topic_metadata")
def topic_metadata(spark, sf):
    return _topic_meta(spark, sf, FX.log_summary(spark, sf))


@query("topic_list")
def topic_list(spark, sf):
    log = FX.log_summary(spark, sf)
    return TP.topic_list(_topic_meta(spark, sf, log), FX.topics(spark, sf, log))


@query("topic_by_name")
def topic_by_name(spark, sf):
    return TP.topic_by_name(_topic_meta(spark, sf, FX.log_summary(spark, sf)), "click")


def _latest(spark, sf, log=None):
    log = FX.log_summary(spark, sf) if log is None else log
    return L.latest_offsets(FX.topic_partitions(spark, sf, log), log)


def _plag(spark, sf, log=None):
    log = FX.log_summary(spark, sf) if log is None else log
    return L.partition_lag(_latest(spark, sf, log), L.committed_offsets(FX.committed_offsets(spark, sf, log)))


@query("latest_offsets")
def latest_offsets(spark, sf):
    return _latest(spark, sf)


@query("unread_messages")
def unread_messages(spark, sf):
    """SRC-9 from committed offsets, over an indexed log."""
    root, log = _root(spark, "offsets"), FX.event_log(spark, sf)
    offset_log.append(log, root, 0)
    index = offset_log.index(spark, root).withColumn("kafka_offset", F.col("high"))
    u = offset_log.unread(spark, root, L.committed_offsets(FX.committed_offsets(spark, sf, index)), FX.poll_grid(spark, sf, index))
    return u.select("consumer_group", "topic", "partition_id", "kafka_offset", "msg_key", "payload")


@query("topic_latest_offsets")
def topic_latest_offsets(spark, sf):
    """SRC-3; the nested list is compared as its JSON text."""
    t = L.topic_latest_offsets(_latest(spark, sf))
    return t.select("topic", F.to_json("latest_offsets").alias("latest_offsets_json"))


@query("committed_offsets")
def committed_offsets(spark, sf):
    return L.committed_offsets(FX.committed_offsets(spark, sf, FX.log_summary(spark, sf))).select(
        "consumer_group", "topic", "partition_id", "committed_offset")


@query("partition_lag")
def partition_lag(spark, sf):
    return _plag(spark, sf)


@query("lag_total")
def lag_total(spark, sf):
    return L.lag_total(_plag(spark, sf))


@query("lag_update")
def lag_update(spark, sf):
    """LAG-2 / AGG-4; the nested per-partition list is compared as JSON text."""
    u = L.lag_update(_plag(spark, sf), LAG_ALERT, NOW)
    return u.select("topic", "consumer_group", "total_lag", "is_alert", "ts",
                    F.to_json("partitions").alias("partitions_json"))


def _series_threshold(totals) -> int:
    """A threshold with series on both sides and one exactly on it: the
    greatest total that isn't over their mean."""
    mean = totals.agg(F.avg("total_lag")).first()[0]
    return int(totals.filter(F.col("total_lag") <= mean).agg(F.max("total_lag")).first()[0] or 0)


@query("lag_alerts")
def lag_alerts(spark, sf):
    totals = L.lag_total(_plag(spark, sf))
    return L.lag_alerts(totals, _series_threshold(totals))


@query("alert_topics")
def alert_topics(spark, sf):
    return L.alert_topics(L.alert_state(_totals_series(spark, sf), READING_ALERT))


@query("topology_alerts")
def topology_alerts(spark, sf):
    log = FX.log_summary(spark, sf)
    totals = L.lag_total(_plag(spark, sf, log))
    # over the topics' greatest totals, so that some topics alert and some don't
    worst = totals.groupBy("topic").agg(F.max("total_lag").alias("total_lag"))
    alerts = L.lag_alerts(totals, _series_threshold(worst))
    return TP.with_alerts(TP.nodes(log, FX.committed_offsets(spark, sf, log)), alerts)


# -- lag readings -------------------------------------------------------------

def _readings(spark, sf):
    return FX.lag_readings(spark, sf)


@query("lag_decode")
def lag_decode(spark, sf):
    m = FX.lag_members(spark, sf)
    d = S.decode_member(m.withColumn("_m", F.col("member")), keep_malformed=True)
    return d.select("topic", "consumer_group", "ts_sec", "lag",
                    S.series_key("pw", F.col("topic"), F.col("consumer_group")).alias("series_key"),
                    S.encode_member(F.split(F.col("_m"), ":", 2)[0].try_cast("bigint"),
                                    F.try_element_at(F.split(F.col("_m"), ":", 2), F.lit(2)).try_cast("bigint"))
                    .alias("member_text"))


@query("lag_store")
def lag_store(spark, sf):
    r = _readings(spark, sf)
    cut = S.unix_seconds_ntz(S.ts_literal(STORE_CUT))
    existing = r.filter(F.col("ts_sec") < cut)
    new = r.filter(F.col("ts_sec") >= cut - F.lit(6 * 86400))
    return L.store(existing, new)


@query("lag_history")
def lag_history(spark, sf):
    return L.history(_readings(spark, sf), NOW, 1440)


@query("lag_prune")
def lag_prune(spark, sf):
    return L.prune(_readings(spark, sf), RET_NOW, 24)


@query("lag_expiry")
def lag_expiry(spark, sf):
    return L.expiry(_readings(spark, sf), NOW, 24)


@query("latest_lag")
def latest_lag(spark, sf):
    return L.latest_lag(_readings(spark, sf))


@query("latest_lag_1m")
def latest_lag_1m(spark, sf):
    return L.latest_lag_1m(_readings(spark, sf), NOW)


@query("lag_peak")
def lag_peak(spark, sf):
    return L.peak(_readings(spark, sf))


@query("lag_running_peak")
def lag_running_peak(spark, sf):
    return L.running_peak(_readings(spark, sf)).select("topic", "consumer_group", "ts_sec", "lag", "running_peak")


@query("lag_chart")
def lag_chart(spark, sf):
    return L.chart(_readings(spark, sf), NOW, minutes=10080)


@query("lag_chart_topic")
def lag_chart_topic(spark, sf):
    return L.chart(_readings(spark, sf), NOW, minutes=10080, topic="view")


@query("lag_format")
def lag_format(spark, sf):
    r = _readings(spark, sf)
    return r.select("topic", "consumer_group", "ts_sec", "lag", S.humanize_lag(F.col("lag")).alias("lag_text"),
                    S.humanize_lag(F.col("lag") * 997).alias("big_text"))


def _totals_series(spark, sf):
    return _readings(spark, sf).withColumnRenamed("lag", "total_lag")


@query("alert_transitions")
def alert_transitions(spark, sf):
    return L.alert_transitions(_totals_series(spark, sf), READING_ALERT)


@query("alert_state")
def alert_state(spark, sf):
    return L.alert_state(_totals_series(spark, sf), READING_ALERT)


@query("metric_lag_p95")
def metric_lag_p95(spark, sf):
    return L.lag_p95(_readings(spark, sf), exact=True)


@query("metric_lag_p95_sketch")
def metric_lag_p95_sketch(spark, sf):
    """DOC-4 for a range of days from one sketch a series and day: is the value's rank as near as promised?"""
    r = _readings(spark, sf)
    est = L.p95_from_sketches(L.day_sketches(r), first=RET_NOW.date(), last=NOW.date())
    inside = r.where(L._day(F.col("ts_sec")).between(F.lit(RET_NOW.date()), F.lit(NOW.date()))).join(est, L.SERIES)
    g = inside.groupBy(*L.SERIES).agg(F.count("*").alias("n"), F.count_if(F.col("lag") < F.col("lag_p95")).alias("under"),
                                      F.count_if(F.col("lag") <= F.col("lag_p95")).alias("upto"), F.first("n_sketched").alias("n_sketched"))
    near = (F.col("under") / F.col("n") <= 0.95 + L.SKETCH_ERROR) & (F.col("upto") / F.col("n") >= 0.95 - L.SKETCH_ERROR)
    return g.select(*L.SERIES, "n", "n_sketched", near.alias("within_bound"))


# -- DLQ ----------------------------------------------------------------------

def _dlq(spark, sf):
    return FX.dlq_events(spark, sf)


@query("dlq_list")
def dlq_list(spark, sf):
    return D.list_events(_dlq(spark, sf), status="pending", limit=0, offset=10)


@query("dlq_page")
def dlq_page(spark, sf):
    return D.page(_dlq(spark, sf), 2)


@query("dlq_by_id")
def dlq_by_id(spark, sf):
    return D.by_id(_dlq(spark, sf), "dlq-40")


@query("dlq_by_id_store")
def dlq_by_id_store(spark, sf):
    """SRC-6 over the store with id buckets."""
    root = _root(spark, "dlq-store")
    dlq_store.append(_dlq(spark, sf), root, 0)
    return dlq_store.by_id(spark, root, "dlq-40").select(*[f.name for f in M.DLQ_EVENTS])


@query("dlq_stats_incremental")
def dlq_stats_incremental(spark, sf):
    """AGG-5 from a snapshot of counts and three batches: new rows, retries, discards."""
    d = _dlq(spark, sf)
    cut = S.ts_literal(STORE_CUT)
    counts = D.status_counts(d.where(F.col("created_at") < cut))
    once = d.select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("pos"), "id")
    retried = cut_lineage(_retry(spark, sf, once)["transitions"])
    late = D.current_state(d, retried)
    gone = D.discard_transitions(late, late.where(F.col("error_type") == M.ERROR_PUBLISH).select("id"), NOW, 1)
    for change in (D.count_changes(new=d.where(F.col("created_at") >= cut)), D.count_changes(transitions=retried), D.count_changes(transitions=gone)):
        counts = D.apply_changes(counts, change)
    return D.stats_of_counts(counts)


@query("dlq_stats")
def dlq_stats(spark, sf):
    return D.stats(_dlq(spark, sf))


@query("metric_dlq_depth")
def metric_dlq_depth(spark, sf):
    return D.depth(_dlq(spark, sf))


@query("dlq_payload_view")
def dlq_payload_view(spark, sf):
    from ..functions.jsonschema import strict_parse
    d = _dlq(spark, sf).withColumn("_orig", F.col("payload"))
    v = D.payload_view(d)
    parsed = strict_parse(F.col("_orig"))
    kind = (F.when(F.try_variant_get(parsed, "$", "struct<>").isNotNull(), F.lit("object"))
            .when(F.is_variant_null(parsed), F.lit("null")).otherwise(F.lit("raw")))
    p = F.col("payload")
    return v.select("id", "producer_id", kind.alias("payload_kind"),
                    F.when(kind == "object", F.try_variant_get(p, "$.order_id", "string")).alias("payload_order_id"),
                    F.when(kind == "raw", F.try_variant_get(p, "$.raw", "string")).alias("payload_raw"))


@query("dlq_mark_retrying")
def dlq_mark_retrying(spark, sf):
    return D.mark_retrying(_dlq(spark, sf), FX.retry_requests(spark, sf), NOW)


@query("dlq_discard_batch")
def dlq_discard_batch(spark, sf):
    d = _dlq(spark, sf)
    ids = d.filter(F.col("error_type") == M.ERROR_PUBLISH).select("id")
    return D.discard(d, ids, NOW)


def _retry(spark, sf, requests=None):
    d = _dlq(spark, sf)
    req = requests if requests is not None else FX.retry_requests(spark, sf)
    return D.retry(d, req, FX.schemas(spark), NOW)


@query("dlq_retry_batch")
def dlq_retry_batch(spark, sf):
    return _retry(spark, sf)["results"]


@query("dlq_retry_overlapping")
def dlq_retry_overlapping(spark, sf):
    """Two batches that name the same events: the one that claims an event first replays it."""
    root, d, req = _root(spark, "claims"), _dlq(spark, sf), FX.retry_requests(spark, sf)
    out = [D.retry_claimed(d, req, FX.schemas(spark), NOW, root, b)["results"].withColumn("batch", F.lit(b)) for b in ("one", "two")]
    return out[0].unionByName(out[1])


@query("dlq_retry_one")
def dlq_retry_one(spark, sf):
    d = _dlq(spark, sf)
    once = d.select(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint").alias("pos"), "id")
    st = _retry(spark, sf, once)["state"]
    return st.select("id", "status", "retry_count", "error_message", "last_retry_at", "updated_at")


@query("dlq_replay_rows")
def dlq_replay_rows(spark, sf):
    rows = _retry(spark, sf)["replay_rows"]
    return rows.select("id", "replay_of", F.col("attempt").cast("bigint").alias("attempt"), "topic_name",
                       "payload", "error_type", "error_message", "producer_id", "created_at")


@query("dlq_replay_messages")
def dlq_replay_messages(spark, sf):
    m = _retry(spark, sf)["messages"]
    return m.select("replay_of", "topic", "key", "value", F.element_at("headers", "pw-producer-id").alias("h_producer_id"),
                    F.element_at("headers", "pw-schema-id").alias("h_schema_id"))


@query("dlq_fold")
def dlq_fold(spark, sf):
    return D.fold(FX.dlq_actions(spark, sf))


@query("metric_replay_success")
def metric_replay_success(spark, sf):
    return D.replay_success(FX.dlq_actions(spark, sf))


# -- topology and metrics -----------------------------------------------------

@query("topology_nodes")
def topology_nodes(spark, sf):
    log = FX.log_summary(spark, sf)
    return TP.nodes(log, FX.committed_offsets(spark, sf, log))


@query("topology_config_nodes")
def topology_config_nodes(spark, sf):
    """TOP-1 in its configuration form, for the topics of the log."""
    topics = [r.topic for r in FX.log_summary(spark, sf).select("topic").distinct().collect()]  # names, as configured
    return TP.nodes_from_config(spark, topics, "analytics").withColumn("type_text", S.node_type_text(F.col("type")))


@query("topology_edges")
def topology_edges(spark, sf):
    log = FX.log_summary(spark, sf)
    return TP.edges(log, FX.committed_offsets(spark, sf, log))


@query("topology_event_rate")
def topology_event_rate(spark, sf):
    return TP.edge_event_rate(FX.event_log(spark, sf), NOW, 86400)


@query("topology_metadata")
def topology_metadata(spark, sf):
    log = FX.log_summary(spark, sf)
    nodes = TP.nodes(log, FX.committed_offsets(spark, sf, log))
    m = TP.node_metadata(nodes, _topic_meta(spark, sf, log), L.lag_total(_plag(spark, sf, log)))
    return m.select("id", "label", "type", F.to_json("metadata").alias("metadata_json"))


@query("metric_event_rate")
def metric_event_rate(spark, sf):
    return TP.event_rate(FX.event_log(spark, sf), 1)


# -- streaming --------------------------------------------

@query("stream_route")
def stream_route(spark, sf):
    from ..streaming import jobs
    return jobs.stream_route_result(spark, sf)


@query("stream_route_committed")
def stream_route_committed(spark, sf):
    from ..streaming import jobs
    return jobs.stream_route_committed_result(spark, sf)


@query("stream_lag")
def stream_lag(spark, sf):
    from ..streaming import jobs
    return jobs.stream_lag_result(spark, sf)


@query("stream_alert_state")
def stream_alert_state(spark, sf):
    from ..streaming import jobs
    return jobs.stream_alert_state_result(spark, sf, READING_ALERT)


@query("stream_expiry")
def stream_expiry(spark, sf):
    from ..streaming import jobs
    return jobs.stream_expiry_result(spark, sf)


@query("stream_alert_transitions")
def stream_alert_transitions(spark, sf):
    from ..streaming import jobs
    return jobs.stream_transitions_result(spark, sf, READING_ALERT)


@query("stream_alert_topics")
def stream_alert_topics(spark, sf):
    from ..streaming import jobs
    return jobs.alerting_topics(jobs.stream_transitions_result(spark, sf, READING_ALERT))


@query("stream_event_rate")
def stream_event_rate(spark, sf):
    from ..streaming import jobs
    return jobs.stream_event_rate_result(spark, sf)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice: events -> validate -> route -> counts."""
    return queries()["route_events"](spark, sf_dir)

