"""Pipeline topology (TOP-1..5, SET-2, JON-5, SRC-1, SRC-5) and the
documented metrics (DOC-1..4).

The graph is two small DataFrames (nodes, edges) derived from the data:
producer -> topic edges from the event log, topic -> group edges from the
commits. Each derivation is a partial aggregate (distinct) over the log, so
only the (small) graph is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import group_node_id, producer_node_id, producer_node_label, ts_literal


def nodes_from_config(spark: SparkSession, topics: list[str], group: str) -> DataFrame:
    """TOP-1, configuration form: a simulated producer per topic, the topic,
    one consumer-group node (distinct, unlike the reference's duplicates)."""
    M.check_params(topics=topics)
    t = spark.createDataFrame([(x,) for x in topics], "topic string")
    return _nodes(t.select(producer_node_id(F.col("topic")).alias("id"),
                           producer_node_label(F.col("topic")).alias("label")),
                  t.select("topic"),
                  spark.createDataFrame([(group,)], "consumer_group string"))


def _nodes(producers: DataFrame, topics: DataFrame, groups: DataFrame) -> DataFrame:
    p = producers.select("id", "label", F.lit(M.NODE_PRODUCER).alias("type"))
    t = topics.select(F.col("topic").alias("id"), F.col("topic").alias("label"),
                      F.lit(M.NODE_TOPIC).alias("type"))
    g = groups.select(group_node_id(F.col("consumer_group")).alias("id"),
                      F.col("consumer_group").alias("label"), F.lit(M.NODE_GROUP).alias("type"))
    return p.unionByName(t).unionByName(g).distinct()


def nodes(log: DataFrame, commits: DataFrame) -> DataFrame:
    """TOP-1 / SET-2: producers U topics U groups, from the data."""
    prod = log.select(F.col("producer_id").alias("id")).distinct().select(
        "id", F.col("id").alias("label"))
    tops = log.select("topic").unionByName(commits.select("topic")).distinct()
    groups = commits.select("consumer_group").distinct()
    return _nodes(prod, tops, groups)


def edges(log: DataFrame, commits: DataFrame) -> DataFrame:
    """TOP-2: producer -> topic and topic -> group edges."""
    pt = log.select(F.col("producer_id").alias("source"), F.col("topic").alias("target")).distinct()
    tg = commits.select(F.col("topic").alias("source"),
                        group_node_id(F.col("consumer_group")).alias("target")).distinct()
    return pt.unionByName(tg)


def with_alerts(nodes_df: DataFrame, alert_topics: DataFrame) -> DataFrame:
    """TOP-3 / JON-5: alert flag on topic nodes (topics with any series in
    alert); other nodes are never flagged."""
    a = alert_topics.select(F.col("topic").alias("id")).distinct().withColumn("_a", F.lit(True))
    j = nodes_df.join(a, "id", "left")  # both sides are graph-sized; AQE picks broadcast at run time
    return j.select(*nodes_df.columns, ((F.col("type") == M.NODE_TOPIC) & F.col("_a").isNotNull()).alias("is_alert"))


def edge_event_rate(log: DataFrame, now, window_seconds: int) -> DataFrame:
    """TOP-4: events per second on each producer -> topic edge over the
    window [now - w, now)."""
    hi = ts_literal(now)
    lo = hi - F.make_interval(secs=F.lit(window_seconds))
    recent = log.filter((F.col("ts") >= lo) & (F.col("ts") < hi))
    counts = recent.groupBy(F.col("producer_id").alias("source"), F.col("topic").alias("target")) \
        .agg(F.count(F.lit(1)).alias("events"))
    return counts.withColumn("event_rate", F.col("events").cast("double") / F.lit(float(window_seconds)))


def node_metadata(nodes_df: DataFrame, topic_meta: DataFrame, totals: DataFrame) -> DataFrame:
    """TOP-5: topic -> partitions, group -> summed lag, as a string map."""
    tm = topic_meta.select(F.col("topic").alias("id"), F.col("partitions").cast("string").alias("_p"))
    gl = totals.groupBy("consumer_group").agg(F.sum("total_lag").alias("_l")).select(
        group_node_id(F.col("consumer_group")).alias("id"), F.col("_l").cast("string").alias("_l"))
    j = nodes_df.join(tm, "id", "left").join(gl, "id", "left")
    meta = (F.when(F.col("_p").isNotNull(), F.create_map(F.lit("partitions"), F.col("_p")))
            .when(F.col("_l").isNotNull(), F.create_map(F.lit("total_lag"), F.col("_l")))
            .otherwise(F.create_map().cast("map<string,string>")))
    return j.select(*nodes_df.columns, meta.alias("metadata"))


def topic_metadata(topic_partitions: DataFrame, managed: DataFrame) -> DataFrame:
    """SRC-1 / AGG-1: partitions per managed topic; replication factor =
    replica count of the lowest partition (1 if it has none); topics not
    found are skipped."""
    m = managed.select(F.col("name").alias("topic")).distinct()
    tp = topic_partitions.join(m, "topic", "left_semi")
    return tp.groupBy("topic").agg(
        F.count(F.lit(1)).alias("partitions"),
        F.coalesce(F.size(F.min_by("replicas", "partition_id")), F.lit(1)).cast("int").alias("replication_factor"))


def topic_list(topic_meta: DataFrame, topics: DataFrame) -> DataFrame:
    """SRC-5: the stored topics with the partitions the log has for them; a
    topic the log doesn't have keeps its stored figures."""
    m = topic_meta.select(F.col("topic").alias("name"), F.col("partitions").alias("_p"),
                          F.col("replication_factor").alias("_r"))
    return topics.join(m, "name", "left").select(
        "id", "name", "description", F.coalesce("_p", "partitions").cast("bigint").alias("partitions"),
        F.coalesce("_r", "replication_factor").cast("int").alias("replication_factor"), "created_at", "updated_at")


def topic_by_name(topic_meta: DataFrame, name: str) -> DataFrame:
    """SRC-5: one topic by name (empty when absent)."""
    return topic_meta.filter(F.col("topic") == name)


# -- documented metrics ------------------------------------------------------

def event_rate(log: DataFrame, minutes: int = 1) -> DataFrame:
    """DOC-1: events per second per topic and tumbling window."""
    w = F.window(F.col("ts"), f"{minutes} minute")
    return (log.groupBy(w.alias("w"), "topic").agg(F.count(F.lit(1)).alias("events"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "topic", "events",
                    (F.col("events").cast("double") / F.lit(60.0 * minutes)).alias("rate")))


def rejection_rate(validated: DataFrame) -> DataFrame:
    """DOC-2: share of events failing validation per topic."""
    return validated.groupBy("topic").agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(~F.col("is_valid")).alias("rejected"),
        F.avg((~F.col("is_valid")).cast("double")).alias("rejection_rate"))
