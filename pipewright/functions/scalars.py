"""Scalar functions (SCL-*), all built-in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M


def ts_literal(now) -> Column:
    """A clock value as a TIMESTAMP_NTZ literal (UTC wall time).

    Built from its text: a naive ``datetime`` passed to ``F.lit`` would be
    converted with the Python process's local time zone. Aware datetimes
    are converted to UTC first; a Column is cast as is."""
    import datetime as _dt
    if isinstance(now, Column):
        return now.cast("timestamp_ntz")
    if isinstance(now, _dt.datetime):
        if now.tzinfo is not None:
            now = now.astimezone(_dt.timezone.utc).replace(tzinfo=None)
        return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(str(now)).cast("timestamp_ntz")


def join_errors(errors: Column) -> Column:
    """SCL-3: errors joined with "; ", default text when there are none."""
    return F.when(F.coalesce(F.size(errors), F.lit(0)) <= 0, F.lit(M.NO_DETAILS_MESSAGE)).otherwise(
        F.array_join(errors, "; "))


def clamp_lag(expr: Column) -> Column:
    """SCL-4: lag never below zero."""
    return F.greatest(expr, F.lit(0).cast("bigint"))


def encode_member(ts_sec: Column, lag: Column) -> Column:
    """SCL-5: sorted-set member text ``"{ts}:{lag}"``."""
    return F.concat_ws(":", ts_sec.cast("string"), lag.cast("string"))


def decode_member(df: DataFrame, member: str = "member", keep_malformed: bool = False) -> DataFrame:
    """SCL-6: split on the first ':' into two int64s; malformed members are
    dropped (history skips them) unless ``keep_malformed``."""
    parts = F.split(F.col(member), ":", 2)
    ts = F.try_element_at(parts, F.lit(1))
    lag = F.try_element_at(parts, F.lit(2))
    # int64 parse: optional sign and digits only (no spaces, no decimals)
    ok = F.col(member).rlike(r"^[+-]?[0-9]+:[+-]?[0-9]+$")
    out = df.withColumn("ts_sec", F.when(ok, ts.try_cast("bigint"))) \
            .withColumn("lag", F.when(ok, lag.try_cast("bigint")))
    if not keep_malformed:
        out = out.filter(F.col("ts_sec").isNotNull() & F.col("lag").isNotNull())
    return out.drop(member)


def series_key(prefix: str, topic: Column, group: Column) -> Column:
    """SCL-7: the series label ``prefix:lag:{topic}:{group}``."""
    return F.concat_ws(":", F.lit(prefix), F.lit("lag"), topic, group)


def humanize_lag(lag: Column) -> Column:
    """SCL-8: >= 1e6 -> x.xM, >= 1e3 -> x.xK, in integer tenths rounded half up."""
    def tenths(unit: int) -> Column:
        t = F.floor((lag + F.lit(unit // 20)) / F.lit(unit // 10)).cast("bigint")
        return F.concat(F.floor(t / 10).cast("bigint").cast("string"), F.lit("."),
                        (t % 10).cast("string"))
    return (F.when(lag >= 1_000_000, F.concat(tenths(1_000_000), F.lit("M")))
            .when(lag >= 1_000, F.concat(tenths(1_000), F.lit("K")))
            .otherwise(lag.cast("string")))


def parse_csv(s: Column) -> Column:
    """SCL-9: comma separated text -> trimmed, non-empty list."""
    return F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != F.lit(""))


def hms_label(ts: Column) -> Column:
    """SCL-10: chart label HH:mm:ss (session zone pinned to UTC)."""
    return F.date_format(ts, "HH:mm:ss")


def rfc3339(ts: Column) -> Column:
    """SCL-11: RFC 3339 UTC text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_seconds_ntz(ts: Column) -> Column:
    """SCL-12: whole Unix seconds of a timestamp (UTC session)."""
    return F.unix_seconds(ts.cast("timestamp")).cast("bigint")


def producer_node_id(topic: Column) -> Column:
    """SCL-13: node ids and labels of the topology."""
    return F.concat(F.lit("producer-"), topic)


def producer_node_label(topic: Column) -> Column:
    return F.concat(topic, F.lit("-producer"))


def group_node_id(group: Column) -> Column:
    return F.concat(F.lit("cg-"), group)


def node_type_text(node_type: Column) -> Column:
    return F.replace(node_type, F.lit("_"), F.lit(" "))


def stable_id(*cols: Column) -> Column:
    """SCL-14: deterministic ids (reruns of a batch give the same ids)."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]), 256)
