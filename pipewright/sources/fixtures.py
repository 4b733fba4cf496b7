"""Fixture tables derived from the driver's ``events`` table (FIXTURES.md).

Every fixture is a set-based derivation of the whole input table -- no id
subsets, no row caps, no windows over unbounded groups -- so its size and the
work on it grow with the data. Offsets are the event id (unique and rising
within every partition; gaps are allowed, as in a compacted Kafka topic).
"""

from __future__ import annotations

import datetime as _dt
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from .storage import cut_lineage
from .tables import read_table

# Fixed schema documents used by the fixtures: FULL is the documented example
# schema; LENIENT only requires order_id; EXTENDED exercises tier-B keywords.
FULL_SCHEMA = {
    "type": "object",
    "required": ["order_id", "amount", "currency"],
    "properties": {
        "order_id": {"type": "string"},
        "amount": {"type": "number", "minimum": 0},
        "currency": {"type": "string", "enum": ["USD", "EUR", "GBP"]},
    },
}
LENIENT_SCHEMA = {"type": "object", "required": ["order_id"]}
EXTENDED_SCHEMA = {
    "type": "object",
    "additionalProperties": False,
    "minProperties": 3,
    "properties": {
        "order_id": {"type": "string", "pattern": "^[0-9]+$", "minLength": 2, "maxLength": 3},
        "amount": {"type": "number", "maximum": 400, "exclusiveMinimum": 0, "multipleOf": 0.05},
        "currency": {"type": "string", "not": {"const": "GBP"}},
    },
    "dependencies": {"currency": ["amount"]},
}

# One document per topic for the keywords of arrays, objects, combinators and
# references (the F11 payloads).
KEYWORD_SCHEMAS = {
    "click": {"properties": {"tags": {"type": "array", "items": {"type": "integer", "minimum": 1}, "minItems": 1,
                                      "maxItems": 2, "uniqueItems": True, "contains": {"const": 1}}}},
    "view": {"properties": {"attrs": {"patternProperties": {"^x_": {"type": "integer"}},
                                      "propertyNames": {"pattern": "^[a-z_]+$"}, "maxProperties": 3}}},
    "purchase": {"allOf": [{"properties": {"amount": {"minimum": 0}}}],
                 "oneOf": [{"properties": {"amount": {"maximum": 100}}}, {"properties": {"amount": {"minimum": 50}}}],
                 "if": {"properties": {"currency": {"const": "USD"}}},
                 "then": {"properties": {"amount": {"exclusiveMaximum": 400}}},
                 "else": {"anyOf": [{"properties": {"amount": {"minimum": 10}}}, {"properties": {"currency": {"const": "GBP"}}}]}},
    "error": {"definitions": {"money": {"type": "number", "minimum": 5}, "small": {"maximum": 3},
                              "priced": {"properties": {"amount": {"$ref": "#/definitions/money"}}}},
              "allOf": [{"$ref": "#/definitions/priced"}],
              "properties": {"tags": {"items": {"$ref": "#/definitions/small"}}}},
    "signup": {"properties": {"tags": {"items": [{"type": "integer"}, {"minimum": 1}], "additionalItems": False}}},
}

FULL_JSON = json.dumps(FULL_SCHEMA, separators=(",", ":"))
LENIENT_JSON = json.dumps(LENIENT_SCHEMA, separators=(",", ":"))
EXTENDED_JSON = json.dumps(EXTENDED_SCHEMA, separators=(",", ":"))

D0 = _dt.datetime(2024, 1, 1)
D15 = _dt.datetime(2024, 1, 15)

# the registry's starting rows (topic, version, schema, active, created_at).
SCHEMA_ROWS = [
    ("click", 1, FULL_JSON, True, D0),
    ("error", 1, FULL_JSON, True, D0),
    ("purchase", 1, FULL_JSON, True, D0),
    ("view", 1, LENIENT_JSON, False, D0),
    ("view", 2, FULL_JSON, True, D15),
    ("ghost", 1, LENIENT_JSON, True, D0),
]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events")


def _payload(ev: DataFrame) -> F.Column:
    eid = F.col("event_id")
    v = F.col("value").cast("string")
    currency = (F.when(eid % 3 == 0, "USD").when(eid % 3 == 1, "EUR").otherwise("GBP"))
    return (F.when(eid % 97 == 0, F.lit('{"order_id":'))
            .when(eid % 20 == 0, F.lit('{"note":"no order here","amount":"twelve","seen":0}'))
            .when(eid % 33 == 0, F.concat(F.lit('{"order_id":"'), eid.cast("string"), F.lit('","amount":-'), v, F.lit(',"currency":"USD"}')))
            .when(eid % 29 == 0, F.concat(F.lit('{"order_id":"'), eid.cast("string"), F.lit('","amount":'), v, F.lit(',"currency":"JPY"}')))
            .otherwise(F.concat(F.lit('{"order_id":"'), eid.cast("string"), F.lit('","amount":'), v,
                                F.lit(',"currency":"'), currency, F.lit('"}'))))


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the event log, one row per driver event."""
    ev = events(spark, sf_dir)
    return ev.select(
        F.col("event_id"),
        F.col("event_type").alias("topic"),
        (F.col("user_id") % 4).cast("int").alias("partition_id"),
        F.col("event_id").alias("kafka_offset"),
        F.col("user_id").cast("string").alias("msg_key"),
        F.concat(F.lit("producer-"), (F.col("user_id") % 7).cast("string")).alias("producer_id"),
        F.col("ts"),
        _payload(ev).alias("payload"),
    )


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the log: a row for each (topic, partition, producer, day)
    with its greatest offset, first and last time. It stands for the log
    wherever only these matter, and is written once to the checkpoint folder, so what
    is derived from it doesn't read the log again. Bounded by metadata and days."""
    log = event_log(spark, sf_dir)
    return cut_lineage(log.groupBy("topic", "partition_id", "producer_id", F.to_date("ts").alias("day")).agg(
        F.max("kafka_offset").alias("kafka_offset"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))


def committed_offsets(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """two consumer groups' commits (next offset to read).

    analytics: behind by 500 x partition id, no commit on partition 3;
    billing: partition 1 committed ahead of the log (lag clamps to 0),
    every other partition committed at 0. ``seq`` is the commit order: each
    group first committed further on and was then rewound to these.
    """
    latest = ((event_log(spark, sf_dir) if log is None else log).groupBy("topic", "partition_id")
              .agg((F.max("kafka_offset") + 1).alias("next_offset")))
    analytics = (latest.filter(F.col("partition_id") != 3)
                 .select(F.lit("analytics").alias("consumer_group"), "topic", "partition_id",
                         (F.col("next_offset") - F.col("partition_id") * 500).cast("bigint").alias("committed_offset")))
    billing = latest.select(
        F.lit("billing").alias("consumer_group"), "topic", "partition_id",
        F.when(F.col("partition_id") == 1, F.col("next_offset") + 2).otherwise(F.lit(0))
        .cast("bigint").alias("committed_offset"))
    final = analytics.unionByName(billing).withColumn("seq", F.lit(2).cast("bigint"))
    first = final.withColumns({"committed_offset": F.col("committed_offset") + 1000, "seq": F.lit(1).cast("bigint")})
    return final.unionByName(first)


def epoch_seconds(ts: F.Column) -> F.Column:
    """Whole Unix seconds of a TIMESTAMP_NTZ read as UTC (the session zone is
    pinned to UTC by ``configure``)."""
    return F.unix_seconds(ts.cast("timestamp")).cast("bigint")


def lag_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw sorted-set members ``"{unix_ts}:{lag}"``, some malformed."""
    ev = events(spark, sf_dir)
    member = F.when(F.col("event_id") % 101 == 0, F.lit("malformed")).otherwise(
        F.concat(epoch_seconds(F.col("ts")).cast("string"), F.lit(":"),
                 F.floor(F.col("value") * 10).cast("bigint").cast("string")))
    return ev.select(
        F.col("event_type").alias("topic"),
        F.concat(F.lit("cg-"), (F.col("user_id") % 2).cast("string")).alias("consumer_group"),
        member.alias("member"))


def dlq_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a dead letter table, one row per driver event, every status."""
    eid = F.col("event_id")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    payload = (F.when(eid % 97 == 0, F.lit('{"order_id":'))
               .when(eid % 20 == 0, F.lit('{"bad_field":"x","amount":"not-a-number"}'))
               .when(eid % 33 == 0, F.lit('{"order_id":"a","amount":-1,"currency":"USD"}'))
               .when(eid % 13 == 0, F.lit('null'))
               .when(eid % 17 == 0, F.lit('[1,2]'))
               .otherwise(F.lit('{"order_id":"a","amount":1,"currency":"USD"}')))
    status = (F.when(eid % 7 == 4, "retrying").when(eid % 7 == 5, "retried")
              .when(eid % 7 == 6, "discarded").otherwise("pending"))
    return events(spark, sf_dir).select(
        F.concat(F.lit("dlq-"), eid.cast("string")).alias("id"),
        F.col("event_type").alias("topic_name"),
        F.lit(0).cast("int").alias("partition_id"),
        F.lit(-1).cast("bigint").alias("kafka_offset"),
        payload.alias("payload"),
        F.when(eid % 29 == 0, "publish_error").otherwise("schema_validation").alias("error_type"),
        F.lit("fixture").alias("error_message"),
        (eid % 5).cast("int").alias("retry_count"),
        status.alias("status"),
        F.when(eid % 11 == 0, F.lit("")).otherwise(
            F.concat(F.lit("producer-"), (F.col("user_id") % 7).cast("string"))).alias("producer_id"),
        hour.alias("created_at"),
        hour.alias("updated_at"),
        F.when(eid % 5 == 0, F.lit(None).cast("timestamp_ntz")).otherwise(hour).alias("last_retry_at"),
    )


def schemas(spark: SparkSession) -> DataFrame:
    """registry rows (tiny, fixed); queries always combine it with data."""
    rows = [(f"sch-{t}-v{v}", t, v, js, a, c) for (t, v, js, a, c) in SCHEMA_ROWS]
    return spark.createDataFrame(rows, M.SCHEMAS)


def topics(spark: SparkSession, sf_dir: str, summary: DataFrame | None = None) -> DataFrame:
    """the topics table, derived from the event log (one row per topic)."""
    return ((log_summary(spark, sf_dir) if summary is None else summary).groupBy("topic")
            .agg(F.min("first_ts").alias("created_at"), F.max("last_ts").alias("updated_at"))
            .select(F.col("topic").alias("id"), F.col("topic").alias("name"),
                    F.lit(None).cast("string").alias("description"),
                    F.lit(1).alias("partitions"), F.lit(1).alias("replication_factor"),
                    "created_at", "updated_at"))


def schema_requests(spark: SparkSession, sf_dir: str, summary: DataFrame | None = None) -> DataFrame:
    """Bulk registration requests: one per (topic, day) of traffic, plus the
    unmanaged topic ``brand-new`` on its first day; even days send FULL,
    odd days LENIENT, so versions keep rising and the last one wins."""
    log = log_summary(spark, sf_dir) if summary is None else summary
    days = log.select(F.col("topic").alias("topic_name"), "day").distinct()
    extra = log.agg(F.min("day").alias("day")).select(F.lit("brand-new").alias("topic_name"), "day")
    req = days.unionByName(extra)
    return req.select(
        "topic_name",
        F.when(F.dayofmonth("day") % 2 == 0, F.lit(FULL_JSON)).otherwise(F.lit(LENIENT_JSON)).alias("schema_json"),
        F.col("day").cast("timestamp_ntz").alias("requested_at"),
        # arrival order inside a topic: the day (unique per topic)
        F.datediff("day", F.lit("2000-01-01").cast("date")).cast("bigint").alias("seq"),
    )


def topic_partitions(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """partitions seen in the log, plus an empty partition 4 on click."""
    seen = (event_log(spark, sf_dir) if log is None else log).select("topic", "partition_id").distinct()
    empty = seen.filter(F.col("topic") == "click").select(
        "topic", F.lit(4).cast("int").alias("partition_id")).distinct()
    both = seen.unionByName(empty)
    return both.select("topic", "partition_id", F.when(
        F.col("topic") == "view", F.array(F.lit(1))).otherwise(
        F.array(F.lit(1), F.lit(2), F.lit(3))).alias("replicas"))


RETRY_POS_STRIDE = 1_000_000_000_000


def retry_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """every DLQ id once, ids with retry_count >= 3 three times, one
    unknown id first. Positions are unique without a global window."""
    dlq = dlq_events(spark, sf_dir).select("id", "retry_count")
    num = F.regexp_extract("id", r"(\d+)$", 1).cast("bigint")
    reps = dlq.select("id", "retry_count", F.explode(
        F.when(F.col("retry_count") >= 3, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    ).alias("rep"))
    req = reps.select((F.col("rep") * RETRY_POS_STRIDE + num).alias("pos"), "id")
    missing = spark.range(1).select(F.lit(-1).cast("bigint").alias("pos"), F.lit("dlq-missing").alias("id"))
    return req.unionByName(missing)


def dlq_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: an ordered action log per DLQ id (one id per driver user)."""
    eid = F.col("event_id")
    return events(spark, sf_dir).select(
        F.concat(F.lit("ev-"), F.col("user_id").cast("string")).alias("id"),
        eid.alias("seq"), F.col("ts").alias("at"),
        F.when(eid % 6 == 0, "retry_ok").when(eid % 6 == 5, "discard").otherwise("retry_fail").alias("action"))


def lag_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 decoded: well-formed members only."""
    from ..functions.scalars import decode_member
    return decode_member(lag_members(spark, sf_dir))


def poll_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """what a live poll hears: an offset for every event, and commits
    beside them. analytics commits with every event but on partition 3, 500 x
    partition id behind (each tenth 1000 further on, rewound by the next);
    billing commits on partition 1 only, ahead of the log."""
    log = event_log(spark, sf_dir)
    part, nxt = F.col("partition_id"), F.col("kafka_offset") + 1
    none = F.lit(None).cast("string")
    offset = F.struct(F.lit(0).alias("kind"), none.alias("g"), nxt.alias("value"))
    behind = F.greatest(nxt - part * 500 + F.when(F.col("event_id") % 10 == 0, 1000).otherwise(0), F.lit(0)).cast("bigint")
    analytics = F.struct(F.lit(1).alias("kind"), F.lit("analytics").alias("g"), behind.alias("value"))
    billing = F.struct(F.lit(1).alias("kind"), F.lit("billing").alias("g"), (nxt + 2).alias("value"))
    said = F.when(part == 3, F.array(offset)).when(part == 1, F.array(offset, analytics, billing)).otherwise(F.array(offset, analytics))
    return log.select("topic", "partition_id", "event_id", "ts", F.explode(said).alias("s")).select(
        F.col("s.kind").alias("kind"), "topic", "partition_id", F.col("s.g").alias("consumer_group"),
        F.col("s.value").cast("bigint").alias("value"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


def poll_grid(spark: SparkSession, sf_dir: str, log: DataFrame | None = None) -> DataFrame:
    """the polled partitions (an empty one too) of both groups."""
    groups = F.explode(F.array(F.lit("analytics"), F.lit("billing")))
    return topic_partitions(spark, sf_dir, log).select("topic", "partition_id", groups.alias("consumer_group"))


def user_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one series per topic and user, silent for days at a time."""
    return events(spark, sf_dir).select(
        F.col("event_type").alias("topic"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("consumer_group"),
        epoch_seconds(F.col("ts")).alias("ts_sec"))


def keyword_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events whose payloads hold a list of up to three small numbers and an
    object with keys of several kinds."""
    eid = F.col("event_id")
    tags = F.slice(F.array(eid % 5, eid % 3, eid % 2), F.lit(1), (eid % 4).cast("int"))
    attrs = (F.when(eid % 3 == 0, F.lit('"x_a":1,"y":"s"')).when(eid % 3 == 1, F.lit('"x_a":"bad","y":"s"'))
             .otherwise(F.lit('"x_a":1,"Y2":"s"')))
    more = F.when(eid % 7 == 0, F.lit(',"w":0,"v":0')).otherwise(F.lit(""))
    payload = F.concat(F.lit('{"tags":['), F.array_join(tags.cast("array<string>"), ","), F.lit('],"attrs":{'), attrs, more,
                       F.lit('},"amount":'), F.col("value").cast("string"), F.lit(',"currency":"'),
                       F.when(eid % 3 == 0, "USD").when(eid % 3 == 1, "EUR").otherwise("GBP"), F.lit('"}'))
    return events(spark, sf_dir).select("event_id", F.col("event_type").alias("topic"), F.lit("p").alias("producer_id"), payload.alias("payload"))


def keyword_schemas(spark: SparkSession) -> DataFrame:
    rows = [(f"sch-{t}-v1", t, 1, json.dumps(doc, separators=(",", ":")), True, D0) for t, doc in KEYWORD_SCHEMAS.items()]
    return spark.createDataFrame(rows, M.SCHEMAS)
