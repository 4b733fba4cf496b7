"""Data model: table schemas, status vocabulary and fixed values.

Every operator in the package is a function from DataFrames to DataFrames;
the StructTypes below describe the tables those functions read and write.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must match the reference's behaviour (kept verbatim).
# ---------------------------------------------------------------------------
STATUS_PENDING = "pending"
STATUS_RETRYING = "retrying"
STATUS_RETRIED = "retried"
STATUS_DISCARDED = "discarded"
STATUSES = (STATUS_PENDING, STATUS_RETRYING, STATUS_RETRIED, STATUS_DISCARDED)
MAX_RETRIES = 5

ERROR_SCHEMA_VALIDATION = "schema_validation"
ERROR_PUBLISH = "publish_error"

NO_SCHEMA_MESSAGE = "no schema registered for topic — validation skipped"
NO_DETAILS_MESSAGE = "validation failed (no details)"
NOT_JSON_MESSAGE = "payload is not valid JSON"
MSG_REPLAYED = "event replayed successfully"
MSG_NOT_FOUND = "event not found: fetching DLQ event {id}: sql: no rows in result set"
MSG_NOT_PENDING = "cannot retry: event {id} is not in pending status — cannot retry"
MSG_REPLAY_FAILED = "replay failed: {error}"
KAFKA_WRITE_FAILED = "kafka write failed: {error}"
BATCH_KAFKA_WRITE_FAILED = "batch kafka write failed: {error}"

NODE_PRODUCER = "producer"
NODE_TOPIC = "topic"
NODE_GROUP = "consumer_group"

# Our own names (prefix pw-): published message headers (SNK-1) and the
# producer id a DLQ replay publishes under (DLQ-5).
REPLAY_PRODUCER = "pw-dlq-replay"
HEADER_PRODUCER = "pw-producer-id"
HEADER_SCHEMA = "pw-schema-id"
HEADER_PUBLISHED_AT = "pw-published-at"

# DLQ defaults for an event that never reached the log.
DLQ_DEFAULT_PARTITION = 0
DLQ_DEFAULT_OFFSET = -1

# Lag store defaults: chart keeps 360 points, history TTL 24 h, live window 1 min.
CHART_POINTS = 360
LAG_TTL_HOURS = 24

# The fixed clock used by fixtures and tests (every `now` is a parameter).
FIXED_NOW = _dt.datetime(2024, 1, 31, 0, 0, 0)
RETENTION_NOW = _dt.datetime(2024, 1, 16, 0, 0, 0)

# ---------------------------------------------------------------------------
# Table schemas
# ---------------------------------------------------------------------------
EVENT_LOG = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition_id", T.IntegerType()),
    T.StructField("kafka_offset", T.LongType()),
    T.StructField("msg_key", T.StringType()),
    T.StructField("producer_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("payload", T.StringType()),
])

DLQ_EVENTS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("topic_name", T.StringType()),
    T.StructField("partition_id", T.IntegerType()),
    T.StructField("kafka_offset", T.LongType()),
    T.StructField("payload", T.StringType()),
    T.StructField("error_type", T.StringType()),
    T.StructField("error_message", T.StringType()),
    T.StructField("retry_count", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("producer_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("last_retry_at", T.TimestampNTZType()),
])

SCHEMAS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("topic_name", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("schema_json", T.StringType()),
    T.StructField("is_active", T.BooleanType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

TOPICS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("partitions", T.IntegerType()),
    T.StructField("replication_factor", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
])

TOPIC_PARTITIONS = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition_id", T.IntegerType()),
    T.StructField("replicas", T.ArrayType(T.IntegerType())),
])

COMMITTED_OFFSETS = T.StructType([
    T.StructField("consumer_group", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition_id", T.IntegerType()),
    T.StructField("committed_offset", T.LongType()),
])

LAG_READINGS = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("consumer_group", T.StringType()),
    T.StructField("ts_sec", T.LongType()),
    T.StructField("lag", T.LongType()),
])

DLQ_ACTIONS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("at", T.TimestampNTZType()),
    T.StructField("action", T.StringType()),
])

RETRY_REQUESTS = T.StructType([
    T.StructField("pos", T.LongType()),
    T.StructField("id", T.StringType()),
])


def check_params(topics=None, poll_seconds=None, threshold=None):
    """FLT-8: configuration checks, raised before any job starts."""
    if topics is not None and len([t for t in topics if t]) == 0:
        raise ValueError("at least one topic is required")
    if poll_seconds is not None and poll_seconds < 1:
        raise ValueError("poll interval must be at least 1 second")
    if threshold is not None and threshold < 0:
        raise ValueError("lag alert threshold must be >= 0")
