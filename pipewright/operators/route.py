"""Validate-and-route (RTE-1..3) and the sinks around it (SNK-1..3).

The active schemas are a registry table with one row per topic. They are
fetched with a bounded collect and compiled (cached per registry version)
into one CASE expression over ``topic``; topics that share a schema
document share one compiled expression, so the plan grows with distinct
schemas, not topics. Validation is then a few narrow projections (one per
schema nesting level): no shuffle, no join, no Python per row -- it
partitions exactly like the input.
"""

from __future__ import annotations

import json
import uuid
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .. import model as M
from ..functions import jsonschema as JS
from ..functions.scalars import join_errors, rfc3339, stable_id, ts_literal
from ..session import checkpoint_dir, remove_path
from .skew import ordinal_within

# Plan-size guard: distinct active schema documents compiled into one plan.
MAX_DISTINCT_SCHEMAS = 2048

ROUTE_PUBLISHED = "published"
ROUTE_DLQ = "dlq"
ROUTE_SYSTEM_ERROR = "system_error"


class Validator:
    """Active schemas compiled into Columns (one per distinct document)."""

    def __init__(self, rows: list[tuple[str, str, str]], token: str | None = None):
        # rows: (topic, schema_id, schema_json)
        self.schema_id: dict[str, str] = {}
        self.broken: dict[str, str] = {}
        self.groups: dict[str, tuple[object, list[str]]] = {}
        for topic, sid, text in rows:
            if topic in self.schema_id or topic in self.broken:
                raise ValueError(f"more than one active schema for topic {topic!r}")
            try:
                doc = JS.parse_schema(text)
            except JS.SchemaCompileError as exc:
                self.broken[topic] = f"compiling schema: {exc}"
                continue
            self.schema_id[topic] = sid
            key = json.dumps(doc, sort_keys=True)
            self.groups.setdefault(key, (doc, []))[1].append(topic)
        if len(self.groups) > MAX_DISTINCT_SCHEMAS:
            raise ValueError(f"{len(self.groups)} distinct active schemas exceed the "
                             f"plan-size guard of {MAX_DISTINCT_SCHEMAS}")
        self.token = token or ("pw" + uuid.uuid4().hex)
        self._compiled: dict = {}

    @classmethod
    def from_registry(cls, schemas: DataFrame) -> "Validator":
        """The validator of the registry's current active schemas.

        One bounded fetch (at most one row per topic reaches the driver).
        Compiled validators are cached per registry content, so a stream's
        micro-batches recompile only when a schema was registered.
        """
        active = schemas.filter(F.col("is_active")).select("topic_name", "id", "schema_json")
        cap = MAX_DISTINCT_SCHEMAS * 64
        rows = active.limit(cap + 1).collect()
        if len(rows) > cap:
            raise ValueError("too many active schemas to compile into one plan")
        content = tuple(sorted((r[0], r[1], r[2]) for r in rows))
        # compiled Columns belong to one application's JVM gateway
        key = (schemas.sparkSession.sparkContext.applicationId, content)
        v = _CACHE.get(key)
        if v is None:
            v = cls(list(content))
            if len(_CACHE) >= _CACHE_SIZE:
                _CACHE.pop(next(iter(_CACHE)))
            _CACHE[key] = v
        return v

    def _topic_map(self, d: dict[str, str]) -> Column:
        if not d:
            return F.create_map().cast("map<string,string>")
        return F.create_map(*[F.lit(x) for kv in sorted(d.items()) for x in kv])

    def _plan(self, topic_name: str, payload_name: str):
        """Compiled columns for the given input column names (cached)."""
        key = (topic_name, payload_name)
        if key in self._compiled:
            return self._compiled[key]
        topic, payload = F.col(topic_name), F.col(payload_name)
        # one schema that doesn't compile is its topics' error and nobody else's
        compiled = []
        for gi, (doc, topics) in enumerate(self.groups.values()):
            gate = topic.isin(topics)
            try:
                compiled.append((gate, *JS.compile_errors(doc, F.col("_pw_v"), prefix=f"_pw_g{gi}_", gate=gate)))
            except (JS.SchemaCompileError, KeyError, TypeError, RecursionError) as exc:
                for t in topics:
                    self.schema_id.pop(t, None)
                    self.broken[t] = f"compiling schema: {exc}"
        sid = F.element_at(self._topic_map(self.schema_id), topic) if self.schema_id else F.lit(None).cast("string")
        broken = F.element_at(self._topic_map(self.broken), topic) if self.broken else F.lit(None).cast("string")
        first = {"schema_id": sid, "system_error": broken,
                 "_pw_w": F.when(sid.isNotNull(), JS.wrap_for_parse(payload, self.token))}
        second = {"_pw_v": JS.strict_unwrap(F.col("_pw_w"), self.token)}
        errs = None
        temps = ["_pw_w", "_pw_v"]
        all_lets = []
        for gate, lets, e in compiled:
            all_lets += lets
            temps += [n for n, _, _ in lets]
            errs = F.when(gate, e) if errs is None else errs.when(gate, e)
        if errs is None:
            errs = F.array().cast("array<string>")
        errs = JS.finalize(errs, M.NOT_JSON_MESSAGE)
        parsed = F.col("_pw_v")
        sidc = F.col("schema_id")
        errors = (F.when(sidc.isNull(), F.array(F.lit(M.NO_SCHEMA_MESSAGE)))
                  .when(parsed.isNull(), F.array(F.lit(M.NOT_JSON_MESSAGE)))
                  .otherwise(errs))
        is_valid = F.when(F.col("system_error").isNotNull(), F.lit(None).cast("boolean")).when(
            sidc.isNull(), F.lit(True)).when(parsed.isNull(), F.lit(False)).otherwise(
            F.size(F.col("errors")) == 0)
        plan = (first, second, all_lets, errors,
                {"is_valid": is_valid, "schema_id": F.coalesce(sidc, F.lit(""))}, temps)
        self._compiled[key] = plan
        return plan

    def apply(self, df: DataFrame, topic: str, payload: str) -> DataFrame:
        """Add is_valid, errors, schema_id and system_error to ``df``."""
        first, second, lets, errors, last, temps = self._plan(topic, payload)
        df = df.withColumns(first).withColumns(second)
        df = JS.add_lets(df, lets)
        out = df.withColumn("errors", errors).withColumns(last).drop(*temps)
        # Validation metrics (valid / invalid / no-schema counts per run).
        # The observation node also keeps later filters on the validation
        # result (e.g. route = 'dlq') from being pushed below it, which would
        # inline the per-node intermediate columns into the filter.
        obs = Observation(f"pw_validation_{uuid.uuid4().hex[:12]}")
        out = out.observe(
            obs,
            F.count(F.lit(1)).alias("events"),
            F.count_if(F.col("is_valid")).alias("valid"),
            F.count_if(~F.col("is_valid")).alias("invalid"),
            F.count_if(F.col("schema_id") == "").alias("no_schema"))
        out._pw_observation = obs
        return out


_CACHE: dict = {}
_CACHE_SIZE = 16


class SnapshotRegistry:
    """A registry kept with ``storage.write_snapshot``. Each call reads only
    the pointer file; the active schemas are fetched and compiled again only
    when a new version was registered, so a stream's micro-batches see a new
    schema at the next batch without a Spark job per batch."""

    def __init__(self, spark, root: str):
        self.spark, self.root = spark, root
        self._version = None
        self._validator: Validator | None = None

    def __call__(self) -> Validator:
        from ..sources.storage import current_version, read_snapshot
        v = current_version(self.spark, self.root)
        if v != self._version or self._validator is None:
            self._validator = Validator.from_registry(read_snapshot(self.spark, self.root, v))
            self._version = v
        return self._validator


def validate(events: DataFrame, schemas: DataFrame, topic: str = "topic",
             payload: str = "payload", enabled: bool = True,
             validator: Validator | None = None) -> DataFrame:
    """RTE-1: add is_valid, errors, schema_id (and system_error) columns.

    With ``enabled=False`` (the reference's unused switch) every event is
    valid and keeps the topic's schema id.
    """
    v = validator or Validator.from_registry(schemas)
    out = v.apply(events, topic, payload)
    obs = getattr(out, "_pw_observation", None)
    if not enabled:
        out = out.withColumns({"is_valid": F.lit(True), "errors": F.array().cast("array<string>"),
                               "system_error": F.lit(None).cast("string")})
    out._pw_observation = obs
    return out


def route(events: DataFrame, schemas: DataFrame, now, topic: str = "topic",
          payload: str = "payload", position: str = "event_id",
          producer: str = "producer_id", enabled: bool = True,
          validator: Validator | None = None) -> DataFrame:
    """RTE-2/RTE-3: one row per input event with its route.

    route: ``published`` (valid), ``dlq`` (schema_validation) or
    ``system_error`` (the topic's active schema does not compile; no DLQ row).
    DLQ ids are a hash of (position, topic, payload) so a rerun of the same
    micro-batch produces the same ids.
    """
    v = validate(events, schemas, topic, payload, enabled, validator)
    rt = (F.when(F.col("system_error").isNotNull(), F.lit(ROUTE_SYSTEM_ERROR))
          .when(F.col("is_valid"), F.lit(ROUTE_PUBLISHED)).otherwise(F.lit(ROUTE_DLQ)))
    dlq_id = stable_id(F.col(position), F.col(topic), F.col(payload))
    out = v.withColumns({
        "route": rt,
        "error_type": F.when(rt == ROUTE_DLQ, F.lit(M.ERROR_SCHEMA_VALIDATION)),
        "error_message": (F.when(rt == ROUTE_DLQ, join_errors(F.col("errors")))
                          .when(rt == ROUTE_SYSTEM_ERROR, F.concat(
                              F.lit("schema validation system error: "), F.col("system_error")))),
        "dlq_event_id": F.when(rt == ROUTE_DLQ, dlq_id),
    })
    out._pw_observation = getattr(v, "_pw_observation", None)
    return out


def published_messages(routed: DataFrame, now=None, topic: str = "topic",
                       key: str = "msg_key", payload: str = "payload",
                       producer: str = "producer_id") -> DataFrame:
    """SNK-1: the messages written to the topic log: key, value, headers.

    The single-event form stamps published-at (RFC 3339, UTC); the batch form
    (``now=None``) omits it.
    """
    entries = [F.lit(M.HEADER_PRODUCER), F.coalesce(F.col(producer), F.lit("")),
               F.lit(M.HEADER_SCHEMA), F.col("schema_id")]
    if now is not None:
        entries += [F.lit(M.HEADER_PUBLISHED_AT), rfc3339(ts_literal(now).cast("timestamp"))]
    return routed.filter(F.col("route") == ROUTE_PUBLISHED).select(
        F.col(topic).alias("topic"), F.col(key).alias("key"), F.col(payload).alias("value"),
        F.create_map(*entries).alias("headers"))


def dlq_rows(routed: DataFrame, now, topic: str = "topic", payload: str = "payload",
             producer: str = "producer_id", error_type: Column | None = None,
             error_message: Column | None = None, only_route: str | None = ROUTE_DLQ,
             position: str = "event_id") -> DataFrame:
    """SNK-2: rows to append to the DLQ log (pending, retry 0, partition 0,
    offset -1; a blank producer id is replaced by a generated one)."""
    df = routed if only_route is None else routed.filter(F.col("route") == only_route)
    rid = F.coalesce(F.col("dlq_event_id"), stable_id(F.col(position), F.col(topic), F.col(payload))) \
        if "dlq_event_id" in df.columns else stable_id(F.col(position), F.col(topic), F.col(payload))
    nowc = ts_literal(now)
    prod = F.col(producer)
    return df.select(
        rid.alias("id"),
        F.col(topic).alias("topic_name"),
        F.lit(M.DLQ_DEFAULT_PARTITION).cast("int").alias("partition_id"),
        F.lit(M.DLQ_DEFAULT_OFFSET).cast("bigint").alias("kafka_offset"),
        F.col(payload).alias("payload"),
        (error_type if error_type is not None else F.col("error_type")).alias("error_type"),
        (error_message if error_message is not None else F.col("error_message")).alias("error_message"),
        F.lit(0).cast("int").alias("retry_count"),
        F.lit(M.STATUS_PENDING).alias("status"),
        F.when(F.coalesce(prod, F.lit("")) == "", F.concat(F.lit("anon-"), rid)).otherwise(prod).alias("producer_id"),
        nowc.alias("created_at"), nowc.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_retry_at"),
    )


def publish_results(routed: DataFrame, position: str = "event_id",
                    topic: str = "topic", log: DataFrame | None = None) -> DataFrame:
    """SET-1: one result per input event, ordered by input position.

    With ``log`` (the file-based topic log being appended to), published
    events also get their landing partition and offset: the partition's
    next offset plus the event's ordinal among this batch's events for that
    partition (skew-safe ordinal, no window over a whole partition). Left
    null for Kafka, which assigns offsets itself.
    """
    res = routed.select(
        F.col(position).alias("pos"), F.col(topic).alias("topic"),
        (F.col("route") == ROUTE_PUBLISHED).alias("success"),
        F.col("dlq_event_id"),
        F.when(F.col("route") != ROUTE_PUBLISHED, F.col("error_message")).alias("error"),
        F.col("partition_id").alias("_part"))
    if log is not None:
        # one pass: rank every row inside (topic, partition, published) and
        # keep the rank only for published rows
        nxt = log.groupBy(F.col("topic"), F.col("partition_id").alias("_part")).agg(
            (F.max("kafka_offset") + 1).alias("_next"))
        ranked = ordinal_within(res, ["topic", "_part", "success"], "pos", out="_k")
        res = ranked.join(nxt, ["topic", "_part"], "left").withColumn(
            "kafka_offset", F.when(F.col("success"), (F.coalesce(F.col("_next"), F.lit(0))
                                                      + F.col("_k") - 1).cast("bigint")))
    else:
        res = res.withColumn("kafka_offset", F.lit(None).cast("bigint"))
    res = res.select("pos", "topic", "success", "dlq_event_id", "error",
                     F.when(F.col("success"), F.col("_part")).alias("partition_id"), "kafka_offset")
    return res.orderBy("pos")


Sink = Callable[[DataFrame], None]


def parquet_sink(path: str, batch_id: int | None = None, partition_by: str = "topic") -> Sink:
    """A log sink: Parquet partitioned by topic; with a batch id the output
    goes to ``batch_id=N`` and a rerun overwrites it (idempotent)."""
    def write(df: DataFrame) -> None:
        target = path if batch_id is None else f"{path}/batch_id={batch_id}"
        mode = "append" if batch_id is None else "overwrite"
        df.write.mode(mode).partitionBy(partition_by).parquet(target)
    return write


def kafka_sink(bootstrap: str, **options) -> Sink:
    """Kafka sink (needs the connector jar on the classpath)."""
    def write(df: DataFrame) -> None:
        out = df.select(
            F.col("topic"), F.col("key").cast("binary").alias("key"),
            F.col("value").cast("binary").alias("value"),
            F.transform(F.map_entries("headers"), lambda e: F.struct(
                e["key"].alias("key"), e["value"].cast("binary").alias("value"))).alias("headers"))
        (out.write.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("kafka.acks", "all").options(**options).save())
    return write


def publish(routed: DataFrame, now, topic_sink: Sink, dlq_sink: Sink,
            batch: bool = True, **cols) -> dict:
    """Write one routed frame to its two sinks.

    The routed rows are first written once to the shared checkpoint folder,
    partitioned by route, so a read or validation failure raises here, before
    any sink is tried, and each sink reads only its own route. A failing
    topic write sends every valid event of the batch to the DLQ as
    ``publish_error`` (SNK-3). A failing DLQ write raises: rejected events
    are in no other place, so a stream must not commit the batch and a batch
    caller must know. The stage folder is removed in either case.

    ``cols`` names the input columns (topic, payload, producer, position,
    and key for the message key).
    """
    observation = getattr(routed, "_pw_observation", None)
    spark = routed.sparkSession
    staged = f"{checkpoint_dir(spark)}/pw-stage/{uuid.uuid4().hex}"
    keep = routed.select(*[c for c in routed.columns if c != "errors"])
    message_cols = {k: v for k, v in cols.items() if k in ("topic", "key", "payload", "producer")}
    dlq_cols = {k: v for k, v in cols.items() if k != "key"}
    try:
        keep.write.partitionBy("route").parquet(staged)
        routed = spark.read.schema(keep.schema).parquet(staged)
        status = {"published": True, "error": None}
        try:
            topic_sink(published_messages(routed, None if batch else now, **message_cols))
        except Exception as exc:  # noqa: BLE001 - the sink's failure is data here
            msg = (M.BATCH_KAFKA_WRITE_FAILED if batch else M.KAFKA_WRITE_FAILED).format(
                error=str(exc).splitlines()[0] if str(exc) else type(exc).__name__)
            status = {"published": False, "error": msg}
        dlq = dlq_rows(routed, now, **dlq_cols)
        if not status["published"]:
            failed = dlq_rows(routed, now, only_route=ROUTE_PUBLISHED,
                              error_type=F.lit(M.ERROR_PUBLISH),
                              error_message=F.lit(status["error"]), **dlq_cols)
            dlq = dlq.unionByName(failed)
        dlq_sink(dlq)
        if observation is not None:
            # filled by the stage write's job; no extra pass over the data
            status["validation"] = dict(observation.get)
        return status
    finally:
        remove_path(spark, staged)
