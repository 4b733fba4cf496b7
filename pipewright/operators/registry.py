"""Schema registry operators (RTE-4, FLT-2, SRT-3, JON-6, JON-7, SNK-5, AGG-2, WIN-1).

The registry is a versioned table ``schemas`` (id, topic_name, version,
schema_json, is_active, created_at): versions start at 1 and rise by one per
topic, exactly one (the newest) is active, old versions are kept. Every
operator returns a new snapshot or a view of one; ``storage.write_snapshot``
makes a snapshot current all at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions import jsonschema as JS
from ..functions.scalars import ts_literal
from ..sources import commits
from ..sources.storage import cut_lineage
from .skew import ordinal_within

def active_schema(schemas: DataFrame, topic: str | None = None) -> DataFrame:
    """FLT-2: the active schema of each topic (or of one topic; empty when
    the topic has none -- not an error)."""
    out = schemas.filter(F.col("is_active"))
    if topic is not None:
        out = out.filter(F.col("topic_name") == topic)
    return out


def schema_history(schemas: DataFrame, topic: str | None = None) -> DataFrame:
    """SRT-3: all versions, newest first (per topic)."""
    out = schemas if topic is None else schemas.filter(F.col("topic_name") == topic)
    return out.orderBy("topic_name", F.desc("version"))


def _compiled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        errors, patterns = [], []
        for text in b["schema_json"]:
            try:
                patterns.append(JS.parse_without_java(text))
                errors.append(None)
            except JS.SchemaCompileError as e:
                patterns.append([])
                errors.append(str(e))
        yield pd.DataFrame({"error": errors, "patterns": patterns})


def check_requests(requests: DataFrame) -> None:
    """Compile every distinct schema document of a registration batch, in the
    tasks that hold them, and their patterns by Java's own compiler; any
    failure rejects the whole batch (all or nothing)."""
    docs = requests.select("schema_json").distinct()
    checked = cut_lineage(docs.mapInPandas(_compiled, "error string, patterns array<string>"))
    if bad := checked.where("error is not null").orderBy("error").limit(1).collect():
        raise JS.SchemaCompileError(bad[0].error)
    patterns = checked.select(F.explode("patterns").alias("p")).distinct()
    try:
        patterns.agg(F.count_if(F.regexp_like(F.lit(""), F.col("p")))).collect()
    except Exception as e:  # Spark wraps what Java's compiler says in more than one way
        if said := re.search(r"PatternSyntaxException: (.*)|INVALID_PARAMETER_VALUE.PATTERN", str(e)):
            raise JS.SchemaCompileError(f"invalid pattern: {said[1] or str(e).splitlines()[0]}") from e
        raise


def register(schemas: DataFrame, requests: DataFrame, check: bool = True) -> DataFrame:
    """RTE-4 (+ AGG-2, WIN-1): register a batch of schemas.

    ``requests``: topic_name, schema_json, requested_at, seq (arrival order
    within a topic). New versions are numbered after the topic's current
    maximum in arrival order; the last new version of a topic becomes the
    only active one. Returns the complete new snapshot.
    """
    if check:
        check_requests(requests)
    current_max = schemas.groupBy("topic_name").agg(F.max("version").alias("_max_v"))
    per_topic = requests.groupBy("topic_name").agg(F.count(F.lit(1)).alias("_cnt"))
    numbered = (ordinal_within(requests, ["topic_name"], "seq", out="_n")
                .join(current_max, "topic_name", "left")
                .join(per_topic, "topic_name", "inner")
                .withColumn("version", (F.coalesce(F.col("_max_v"), F.lit(0)) + F.col("_n")).cast("int")))
    new_rows = numbered.select(
        F.concat(F.lit("sch-"), F.col("topic_name"), F.lit("-v"), F.col("version").cast("string")).alias("id"),
        "topic_name", "version", "schema_json",
        (F.col("_n") == F.col("_cnt")).alias("is_active"),
        F.col("requested_at").cast("timestamp_ntz").alias("created_at"))
    touched = requests.select("topic_name").distinct().withColumn("_touched", F.lit(True))
    old = (schemas.join(touched, "topic_name", "left")
           .withColumn("is_active", F.col("is_active") & F.col("_touched").isNull())
           .select(*schemas.columns))
    return old.unionByName(new_rows)


def register_at(spark: SparkSession, root: str, requests: DataFrame, now) -> int:
    """RTE-4 + SNK-5 under several writers: the documents are checked, then the registry
    (``schemas``) and the topics table change in one commit, or neither does.

    A registration that another one got ahead of is done again on top of it:
    no version is lost and (topic, version) stays unique. Returns the commit's version.
    """
    check_requests(requests)

    def change(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        schemas = tables.get("schemas", spark.createDataFrame([], M.SCHEMAS))
        topics = tables.get("topics", spark.createDataFrame([], M.TOPICS))
        return {"schemas": register(schemas, requests, check=False), "topics": upsert_topics(topics, requests, now)}

    return commits.update_tables(spark, root, change)


def upsert_topics(topics: DataFrame, names: DataFrame, now) -> DataFrame:
    """SNK-5: insert unknown topic names (1 partition, factor 1), bump
    ``updated_at`` of known ones; a full outer join plus coalesce."""
    nowc = ts_literal(now)
    n = names.select(F.col("topic_name").alias("name")).distinct().withColumn("_req", F.lit(True))
    j = topics.join(n, "name", "full_outer")
    known = F.col("id").isNotNull()
    return j.select(
        F.when(known, F.col("id")).otherwise(F.col("name")).alias("id"),
        "name",
        F.col("description"),
        F.when(known, F.col("partitions")).otherwise(F.lit(1)).cast("int").alias("partitions"),
        F.when(known, F.col("replication_factor")).otherwise(F.lit(1)).cast("int").alias("replication_factor"),
        F.when(known, F.col("created_at")).otherwise(nowc).alias("created_at"),
        F.when(F.col("_req").isNotNull(), nowc).otherwise(F.col("updated_at")).alias("updated_at"))


def orphans(schemas: DataFrame, topics: DataFrame) -> DataFrame:
    """JON-6: schema rows whose topic does not exist (anti join)."""
    return schemas.join(topics.select(F.col("name").alias("topic_name")), "topic_name", "left_anti")


def cascade_delete(schemas: DataFrame, surviving_topics: DataFrame) -> DataFrame:
    """JON-6: deleting a topic deletes its schemas (semi join on survivors)."""
    return schemas.join(surviving_topics.select(F.col("name").alias("topic_name")), "topic_name", "left_semi")


def validity(schemas: DataFrame) -> DataFrame:
    """Each version's validity interval [valid_from, valid_to): until the next
    created, the greater version at a tie (the others' intervals are empty)."""
    w = Window.partitionBy("topic_name").orderBy("created_at", "version")
    return schemas.select("id", "topic_name", "version", F.col("created_at").alias("valid_from"),
                          F.lead("created_at").over(w).alias("valid_to"))


def as_of(df: DataFrame, schemas: DataFrame, topic: str = "topic_name",
          ts: str = "created_at") -> DataFrame:
    """JON-7: the schema version in force when each row happened: the last
    created up to then, the greater version at a tie; one row out for each in.

    An as-of join by days: each version is listed under every day its
    interval touches, up to the rows' last day, and rows join on (topic, day)
    plus the interval. So a row meets the versions of one day, and a hot topic
    is spread over its days. The versions are bounded by topics x (versions + days).
    """
    last = df.agg(F.max(ts)).first()[0]
    day = lambda c: F.to_date(c)
    end = F.least(F.coalesce(F.col("valid_to"), F.lit(last)), F.lit(last)).cast("timestamp_ntz")
    v = validity(schemas).where(F.col("valid_from") <= F.lit(last).cast("timestamp_ntz"))
    v = v.where(F.col("valid_to").isNull() | (F.col("valid_to") > F.col("valid_from")))
    v = v.withColumn("_day", F.explode(F.sequence(day("valid_from"), day(end)))).select("_day", F.col("topic_name").alias("_t"), F.col("id").alias("schema_id"),
                                 F.col("version").alias("schema_version"), "valid_from", "valid_to")
    cond = ((F.col(topic) == F.col("_t")) & (day(F.col(ts)) == F.col("_day")) & (F.col(ts) >= F.col("valid_from"))
            & (F.col("valid_to").isNull() | (F.col(ts) < F.col("valid_to"))))
    return df.join(v, cond, "left").drop("_t", "_day", "valid_from", "valid_to")
