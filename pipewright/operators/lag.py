"""Consumer lag operators (SRC-2..4, JON-1, LAG-1..10, AGG-3/4/6, WIN-2/3/4/6,
FLT-3/4/6, SNK-4, SET-3).

Offsets: ``latest`` = the next offset to be written per partition,
``committed`` = the next offset a group will read (0 only when the group
never committed on that partition). Lag readings are a time series per
(topic, consumer_group) with whole-second timestamps ``ts_sec``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import model as M
from ..functions.scalars import clamp_lag, hms_label, ts_literal
from .skew import prefix_sum_within, previous_within, running_max_within, top_k_within

SERIES = ["topic", "consumer_group"]


def _secs(now) -> Column:
    return F.unix_seconds(ts_literal(now).cast("timestamp")).cast("bigint")


# -- offsets -----------------------------------------------------------------

def latest_offsets(topic_partitions: DataFrame, log: DataFrame) -> DataFrame:
    """SRC-2: next offset per listed partition (0 on an empty partition).
    The log is reduced by a partial aggregate before the (small) join."""
    hi = log.groupBy("topic", "partition_id").agg((F.max("kafka_offset") + 1).alias("_next"))
    return (topic_partitions.select("topic", "partition_id")
            .join(hi, ["topic", "partition_id"], "left")
            .select("topic", "partition_id",
                    F.coalesce(F.col("_next"), F.lit(0)).cast("bigint").alias("latest_offset")))


def topic_latest_offsets(latest: DataFrame) -> DataFrame:
    """SRC-3: per topic, its partitions' latest offsets as a sorted list
    (bounded: one entry per partition of the topic)."""
    return latest.groupBy("topic").agg(F.array_sort(F.collect_list(
        F.struct(F.col("partition_id"), F.col("latest_offset")))).alias("latest_offsets"))


def committed_offsets(commits: DataFrame, seq: str = "seq") -> DataFrame:
    """SRC-4: the committed offset per (group, topic, partition): the newest
    commit of the log (``seq`` = commit order), also after a rewind."""
    keys = ["consumer_group", "topic", "partition_id"]
    return commits.groupBy(*keys).agg(F.max_by("committed_offset", seq).alias("committed_offset"))


def partition_lag(latest: DataFrame, committed: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """JON-1 + SCL-4 (LAG-1): lag per (group, topic, partition) for every
    listed partition of every polled (group, topic); a missing commit counts
    as 0; partitions that only appear in the commits are dropped.

    ``groups``: (consumer_group, topic) pairs to poll; by default every pair
    that has commits. Joined to partitions on topic (an equi-join).
    """
    pairs = groups if groups is not None else committed.select("consumer_group", "topic").distinct()
    # pairs and partitions are metadata-sized; AQE broadcasts them at run time
    grid = latest.join(pairs, "topic", "inner")
    j = grid.join(committed, ["consumer_group", "topic", "partition_id"], "left")
    c = F.coalesce(F.col("committed_offset"), F.lit(0)).cast("bigint")
    return j.select("topic", "consumer_group", "partition_id", "latest_offset",
                    c.alias("committed_offset"),
                    clamp_lag(F.col("latest_offset") - c).alias("lag"))


def lag_total(plag: DataFrame) -> DataFrame:
    """AGG-3: total lag per (topic, group)."""
    return plag.groupBy(*SERIES).agg(F.sum("lag").cast("bigint").alias("total_lag"))


def lag_update(plag: DataFrame, threshold: int, now) -> DataFrame:
    """LAG-2 / AGG-4 / FLT-6: one update per (topic, group): total, alert
    (strictly above the threshold), the per-partition list (bounded by the
    topic's partition count)."""
    M.check_params(threshold=threshold)
    parts = F.array_sort(F.collect_list(F.struct("partition_id", "latest_offset", "committed_offset", "lag")))
    return plag.groupBy(*SERIES).agg(F.sum("lag").cast("bigint").alias("total_lag"), parts.alias("partitions")) \
        .withColumns({"is_alert": F.col("total_lag") > F.lit(threshold),
                      "ts": ts_literal(now)})


def lag_alerts(totals: DataFrame, threshold: int) -> DataFrame:
    """FLT-6 / LAG-7: series whose total lag is strictly above the threshold."""
    M.check_params(threshold=threshold)
    return totals.filter(F.col("total_lag") > F.lit(threshold))


# -- readings (the time series) ----------------------------------------------

def store(existing: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-4 / LAG-3: append readings; the same second and lag collapse to one."""
    return existing.unionByName(new).dropDuplicates(SERIES + ["ts_sec", "lag"])


def history(readings: DataFrame, now, minutes: int, topic: str | None = None,
            group: str | None = None) -> DataFrame:
    """FLT-3 + SRT-4 (LAG-4): readings in [floor(now - d), floor(now)], both
    ends inclusive, oldest first; ties in one second by the lag's text."""
    hi = _secs(now)
    lo = hi - F.lit(int(minutes) * 60)
    out = readings.filter(F.col("ts_sec").between(lo, hi))
    if topic is not None:
        out = out.filter(F.col("topic") == topic)
    if group is not None:
        out = out.filter(F.col("consumer_group") == group)
    return out.orderBy(*SERIES, "ts_sec", F.col("lag").cast("string"))


def prune(readings: DataFrame, now, ttl_hours: int = M.LAG_TTL_HOURS) -> DataFrame:
    """FLT-4 / LAG-5: drop readings at or before now - TTL."""
    cutoff = _secs(now) - F.lit(int(ttl_hours) * 3600)
    return readings.filter(F.col("ts_sec") > cutoff)


def expiry(readings: DataFrame, now, ttl_hours: int = M.LAG_TTL_HOURS) -> DataFrame:
    """LAG-6: the TTL restarts at each write; a series not written for TTL
    vanishes. Visible points: ts > last_write - TTL, while now < last_write
    + TTL. The per-series last write is a small aggregate joined back."""
    ttl = F.lit(int(ttl_hours) * 3600)
    # one row per series; AQE turns this into a broadcast join at run time
    # when the aggregate is small (no second pass over the readings to size it)
    last = readings.groupBy(*SERIES).agg(F.max("ts_sec").alias("_last"))
    j = readings.join(last, SERIES, "inner")
    return j.filter((F.col("ts_sec") > F.col("_last") - ttl) & (_secs(now) < F.col("_last") + ttl)) \
        .drop("_last")


def _newest(readings: DataFrame) -> DataFrame:
    order = F.struct(F.col("ts_sec"), F.col("lag").cast("string"))
    return readings.groupBy(*SERIES).agg(F.max_by("lag", order).alias("lag"))


def latest_lag(readings: DataFrame) -> DataFrame:
    """LAG-8 / WIN-4: the newest reading ever per series (ties in a second:
    the greatest member text); a partial + final aggregate, no sort."""
    return _newest(readings)


def latest_lag_1m(readings: DataFrame, now) -> DataFrame:
    """LAG-9: the last reading within the last minute, else 0, for every
    known series."""
    series = readings.select(*SERIES).distinct()
    recent = _newest(history_window(readings, now, 1))
    return series.join(recent, SERIES, "left").select(
        *SERIES, F.coalesce(F.col("lag"), F.lit(0)).cast("bigint").alias("lag"))


def history_window(readings: DataFrame, now, minutes: int) -> DataFrame:
    hi = _secs(now)
    return readings.filter(F.col("ts_sec").between(hi - F.lit(int(minutes) * 60), hi))


def peak(readings: DataFrame) -> DataFrame:
    """AGG-6: peak lag per series, floored at 0."""
    return readings.groupBy(*SERIES).agg(F.greatest(F.max("lag"), F.lit(0)).cast("bigint").alias("peak_lag"))


def running_peak(readings: DataFrame, bucket_seconds: int = 60) -> DataFrame:
    """WIN-2: running maximum per series in time order (ties by lag text),
    skew-safe: windows inside time buckets of each series plus a carried
    bucket maximum."""
    r = readings.withColumn("_lag_txt", F.col("lag").cast("string"))
    out = running_max_within(r, SERIES, ["ts_sec", "_lag_txt"], "lag", bucket_seconds, "ts_sec",
                             out="running_peak")
    return out.drop("_lag_txt")


def chart(readings: DataFrame, now, minutes: int = 30, points: int = M.CHART_POINTS,
          topic: str | None = None) -> DataFrame:
    """LAG-10 (FLT-7, WIN-2, WIN-3, SCL-10): the chart series per (topic,
    group): history of the last ``minutes``, the newest ``points`` points,
    oldest first, an HH:mm:ss label and the running peak floored at 0."""
    h = history_window(readings, now, minutes)
    if topic is not None:
        h = h.filter(F.col("topic") == topic)
    h = h.withColumn("_lag_txt", F.col("lag").cast("string"))
    kept = top_k_within(h, SERIES, [F.desc("ts_sec"), F.desc("_lag_txt")], points, out="_rank",
                        salt=F.abs(F.xxhash64("ts_sec", "lag")) % F.lit(256))
    w = Window.partitionBy(*SERIES).orderBy("ts_sec", "_lag_txt").rowsBetween(Window.unboundedPreceding, 0)
    return kept.select(
        *SERIES, "ts_sec", "lag",
        hms_label(F.timestamp_seconds("ts_sec")).alias("label"),
        F.greatest(F.max("lag").over(w), F.lit(0)).cast("bigint").alias("running_peak"))


def alert_transitions(totals: DataFrame, threshold: int, bucket_seconds: int = 60) -> DataFrame:
    """WIN-6: raise/clear events of a topic's alert flag over a series of
    updates (topic, consumer_group, ts_sec, total_lag): a row whose flag
    differs from the previous update's (the first update counts when it
    raises)."""
    t = totals.withColumn("is_alert", F.col("total_lag") > F.lit(threshold))
    t = previous_within(t, SERIES, ["ts_sec", "total_lag"], "is_alert", bucket_seconds, "ts_sec",
                        out="_prev")
    return t.filter(F.col("is_alert") != F.coalesce(F.col("_prev"), F.lit(False))).select(
        *SERIES, "ts_sec", "total_lag", "is_alert",
        F.when(F.col("is_alert"), F.lit("raise")).otherwise(F.lit("clear")).alias("transition"))


def alert_state(totals: DataFrame, threshold: int) -> DataFrame:
    """SET-3: the current alert set: the newest flag per series."""
    t = totals.withColumn("is_alert", F.col("total_lag") > F.lit(threshold))
    return t.groupBy(*SERIES).agg(F.max_by("is_alert", F.struct("ts_sec", "total_lag")).alias("is_alert"))


def alert_topics(state: DataFrame) -> DataFrame:
    """SET-3 by topic: a topic is alerting while any of its groups is."""
    return state.groupBy("topic").agg(F.bool_or("is_alert").alias("is_alert"),
                                      F.count_if("is_alert").alias("alerting_groups"))


def lag_p95(readings: DataFrame, exact: bool = True, q: float = 0.95) -> DataFrame:
    """DOC-4: the q-quantile of lag per series, linear interpolation between
    the values at ranks floor/ceil of q x (n - 1).

    Exact form without holding a series in one task: counts per (series,
    lag value) are a partial aggregate; their running sums (bucketed prefix
    sums) locate the two ranks; one join picks the values. The approximate
    form is ``percentile_approx`` (a bounded sketch)."""
    if not exact:
        return readings.groupBy(*SERIES).agg(
            F.percentile_approx(F.col("lag"), q, 10000).cast("double").alias("lag_p95"))
    counts = readings.groupBy(*SERIES, "lag").agg(F.count(F.lit(1)).alias("_c"))
    cum = prefix_sum_within(counts, SERIES, "lag", "_c", out="_before")
    n = counts.groupBy(*SERIES).agg(F.sum("_c").alias("_n"))
    pos = F.lit(q) * (F.col("_n") - 1)
    ranks = n.select(*SERIES, F.floor(pos).cast("bigint").alias("_lo"), F.ceil(pos).cast("bigint").alias("_hi"),
                     (pos - F.floor(pos)).alias("_frac"))
    j = cum.join(ranks, SERIES)
    holds = lambda r: (F.col("_before") <= F.col(r)) & (F.col(r) < F.col("_before") + F.col("_c"))
    picked = j.groupBy(*SERIES).agg(
        F.max(F.when(holds("_lo"), F.col("lag"))).alias("_vlo"),
        F.max(F.when(holds("_hi"), F.col("lag"))).alias("_vhi"),
        F.first("_frac").alias("_frac"))
    # lo x (1 - d) + hi x d, the common SQL convention for continuous quantiles
    lo, hi, d = F.col("_vlo").cast("double"), F.col("_vhi").cast("double"), F.col("_frac")
    return picked.select(*SERIES, (lo * (F.lit(1.0) - d) + hi * d).alias("lag_p95"))


#: KLL size, and the normalised rank error a sketch of that size keeps (99 % of the time).
SKETCH_K, SKETCH_ERROR = 400, 0.01


def day_sketches(readings: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """DOC-4, kept per day: one mergeable quantile sketch for each series and day.

    A partial aggregation: a hot series sends a sketch for each task, not its
    rows. Later days only add rows to this table."""
    return readings.groupBy(*SERIES, _day(F.col("ts_sec")).alias("dt")).agg(
        F.kll_sketch_agg_bigint("lag", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def p95_from_sketches(sketches: DataFrame, first, last, q: float = 0.95) -> DataFrame:
    """DOC-4 over any range of days, both ends inclusive: merged sketches, no reading
    touched. The value's rank is within SKETCH_ERROR of q."""
    merged = sketches.where(F.col("dt").between(F.lit(first), F.lit(last))).groupBy(*SERIES).agg(
        F.kll_merge_agg_bigint("sketch").alias("_s"), F.sum("n").alias("n_sketched"))
    return merged.select(*SERIES, F.kll_sketch_get_quantile_bigint("_s", F.lit(float(q))).alias("lag_p95"), "n_sketched")


# -- STR-6: a date-partitioned readings store ----------------------------------

def _day(ts_sec: Column) -> Column:
    return F.to_date(F.timestamp_seconds(ts_sec))


def write_readings(readings: DataFrame, root: str) -> None:
    """SNK-4: append readings to a table partitioned by day (``dt``), so range
    reads prune whole days and retention drops whole folders. Readings the
    table holds already are left out: the new ones meet only their own days."""
    spark, key = readings.sparkSession, SERIES + ["ts_sec", "lag"]
    new = readings.select(*key).dropDuplicates(key).withColumn("dt", _day(F.col("ts_sec")))
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        span = new.agg(F.min("dt"), F.max("dt")).first()
        held = spark.read.parquet(root).filter(F.col("dt").between(F.lit(span[0]), F.lit(span[1])))
        new = new.join(held.select(*key, "dt"), key + ["dt"], "left_anti")
    new.write.mode("append").partitionBy("dt").parquet(root)


def read_history(spark, root: str, now, minutes: int) -> DataFrame:
    """LAG-4 over the store: the day filter derived from the ts range lets
    Spark prune partitions; the exact second filter is then applied."""
    hi = _secs(now)
    lo = hi - F.lit(int(minutes) * 60)
    df = spark.read.parquet(root)
    df = df.filter(F.col("dt").between(_day(lo), _day(hi)))
    return history(df.drop("dt"), now, minutes)


def drop_expired_days(spark, root: str, now, ttl_hours: int = M.LAG_TTL_HOURS) -> list[str]:
    """STR-6 compaction: delete day folders entirely before the TTL cutoff's
    day (the cutoff day itself is trimmed at read time by ``prune``).
    Returns the dropped folder names."""
    import datetime as _dt
    cutoff = (now if isinstance(now, _dt.datetime) else _dt.datetime.fromisoformat(str(now))) \
        - _dt.timedelta(hours=int(ttl_hours))
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    dropped = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("dt="):
            if _dt.date.fromisoformat(name[3:]) < cutoff.date():
                fs.delete(st.getPath(), True)
                dropped.append(name)
    return sorted(dropped)
