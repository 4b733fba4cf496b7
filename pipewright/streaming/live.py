"""Stateful streams: live lag polls, expiry of silent series, alert transitions.

Polls and alerts keep arbitrary keyed state (`transformWithStateInPandas`), expiry keeps session
windows; all act by the watermark, so results come out once, in time order and also for keys that
no new row arrives for. Rows of polls and expiry are combined inside each Arrow batch or partition before the
shuffle, so a key with a third of all rows sends few. State lives in RocksDB stores
checkpointed to the shared folder; a restarted query goes on from there.

A stream's last results wait for the watermark. A heartbeat row (`kind`
HEARTBEAT, no key) further on moves it when the sources are silent.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import model as M

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Sessions are merged inside each partition before the shuffle, so a hot series sends few rows.
MERGED_EARLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"

#: Kinds of rows in a poll's input.
OFFSET, COMMIT, HEARTBEAT = 0, 1, 2
POLL_INPUT = "kind int, topic string, partition_id int, consumer_group string, value bigint, ts timestamp, seq bigint"
_POLLED = "poll timestamp, topic string, consumer_group string, partition_id int, latest_offset bigint, committed_offset bigint, lag bigint"
_RUNS = "topic string, consumer_group string, ends timestamp, ts_sec bigint, total_lag bigint, is_alert boolean"
_TRANSITIONS = "topic string, consumer_group string, ts_sec bigint, total_lag bigint, is_alert boolean, transition string"


@contextmanager
def stateful(spark: SparkSession):
    """The session's state store, and sessions merged early, while a query that needs keyed state is started."""
    wanted = {PROVIDER: ROCKSDB, MERGED_EARLY: "true"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _ms(column: str) -> F.Column:
    return F.unix_millis(F.col(column))


def _stamp(ms: pd.Series | list) -> pd.Series:
    return pd.to_datetime(pd.Series(ms, dtype="int64"), unit="ms")


def _none(columns: str) -> pd.DataFrame:
    return pd.DataFrame({c.split()[0]: [] for c in columns.split(", ")})


# -- STR-3 / LAG-2: every partition and group at every poll -------------------

def _newest(rows: pd.DataFrame) -> pd.DataFrame:
    """One row for each key and tick: the greatest offset, the newest commit."""
    order = rows["value"].where(rows["kind"] == OFFSET, rows["at_ms"])
    rows = rows.assign(_order=order).sort_values(["_order", "seq"], kind="stable").drop(columns="_order")
    return rows.drop_duplicates(["kind", "topic", "partition_id", "consumer_group", "tick"], keep="last")


def _combined(start_ms: int, period_ms: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["tick"] = start_ms + ((b["at_ms"] - start_ms) // period_ms + 1) * period_ms  # the first poll after it
            yield _newest(b)

    return run


class _Poll(StatefulProcessor):
    """Key (topic, partition): its newest offset, each polled group's commit, and rows for polls to come."""

    def __init__(self, start_ms: int, period_ms: int):
        self.start_ms, self.period_ms = start_ms, period_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "tick bigint, latest bigint")
        self.commits = handle.getMapState("commits", "consumer_group string", "committed bigint")
        self.ahead = handle.getListState("ahead", "kind int, consumer_group string, value bigint, at_ms bigint, seq bigint, tick bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for group in initialState["consumer_group"]:
            self.commits.updateValue((group,), (0,))
        if not self.done.exists():
            self.done.update((self.start_ms, 0))
            self.handle.registerTimer(self.start_ms + self.period_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():  # else not a listed partition
            names = ["kind", "consumer_group", "value", "at_ms", "seq", "tick"]
            held = pd.DataFrame(list(self.ahead.get()), columns=names)
            parts = [p for p in (held, *(r[names] for r in rows)) if len(p)]
            if parts:
                kept = _newest(pd.concat(parts).assign(topic=key[0], partition_id=key[1]))[names]
                self.ahead.put([(int(k), g, int(v), int(a), int(s), int(t)) for k, g, v, a, s, t in kept.itertuples(index=False)])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        tick, latest = self.done.get()
        commits = {g: c for (g,), (c,) in self.commits.iterator()}
        ahead = sorted(self.ahead.get(), key=lambda r: (r[5], r[3], r[4]))
        out, at = [], 0
        while tick + self.period_ms <= upto:
            tick += self.period_ms
            while at < len(ahead) and ahead[at][5] <= tick:
                kind, group, value = ahead[at][:3]
                if kind == OFFSET:
                    latest = max(latest, value)
                elif group in commits:
                    commits[group] = value
                at += 1
            out += [(tick, group, latest, c, max(latest - c, 0)) for group, c in commits.items()]
        if at:
            self.ahead.put([tuple(r) for r in ahead[at:]]) if at < len(ahead) else self.ahead.clear()
            for group, c in commits.items():
                self.commits.updateValue((group,), (c,))
        self.done.update((tick, latest))
        self.handle.registerTimer(tick + self.period_ms)
        if out:
            polls, groups, latests, committed, lags = zip(*out)
            yield pd.DataFrame({"poll": _stamp(list(polls)), "topic": key[0], "consumer_group": groups, "partition_id": key[1], "latest_offset": latests, "committed_offset": committed, "lag": lags})

    def close(self) -> None:
        pass


def live_lag(rows: DataFrame, grid: DataFrame, start, period_seconds: int, delay: str) -> DataFrame:
    """STR-3 / LAG-2, live: at each poll (`start` + k periods) the lag of every listed partition.

    ``rows`` (POLL_INPUT): offsets and commits as they come, in any order the
    watermark allows. ``grid``: (topic, partition_id, consumer_group) to
    poll; others are ignored. A poll sees what happened before it: the greatest
    offset, and each group's newest commit (by time, then seq; none: 0). Silent
    partitions count with what they last had. Append mode, one row for
    each poll, group and partition once the watermark reaches the poll.
    """
    M.check_params(poll_seconds=period_seconds)
    start_ms, period_ms = int(pd.Timestamp(start, tz="UTC").value // 1_000_000), int(period_seconds) * 1000
    timed = rows.select("kind", "topic", "partition_id", "consumer_group", "value", F.coalesce("seq", F.lit(0).cast("bigint")).alias("seq"), "ts", _ms("ts").alias("at_ms"))
    few = timed.mapInPandas(_combined(start_ms, period_ms), "kind int, topic string, partition_id int, consumer_group string, value bigint, seq bigint, ts timestamp, at_ms bigint, tick bigint")
    keyed = few.withWatermark("ts", delay).groupBy("topic", "partition_id")
    listed = grid.select("topic", F.col("partition_id").cast("int").alias("partition_id"), "consumer_group").distinct()
    return keyed.transformWithStateInPandas(_Poll(start_ms, period_ms), _POLLED, "Append", "EventTime", listed.groupBy("topic", "partition_id"), "poll")


def live_totals(polled: DataFrame) -> DataFrame:
    """Total lag of each (poll, topic, group): a streaming aggregation on top of the polls."""
    return polled.groupBy("poll", "topic", "consumer_group").agg(F.sum("lag").cast("bigint").alias("total_lag"))


# -- STR-6 / LAG-6: a series unwritten for its TTL ----------------------------

def expiry_stream(readings: DataFrame, ttl_seconds: int, delay: str) -> DataFrame:
    """LAG-6 / STR-6 in the stream: one row each time a series has not been written for the TTL.

    ``readings``: topic, consumer_group, ts_sec (a null topic is a heartbeat).
    Each write starts the TTL again; ``expired_at`` is the last write plus the TTL. A write at that
    time or after starts the series anew. These are session windows, so state is a stretch of
    writes for each series, and nothing runs in Python for a row or a series. A write that comes after
    the watermark still counts while its own TTL hasn't passed.
    """
    ttl = int(ttl_seconds)
    timed = readings.select("topic", "consumer_group", F.timestamp_seconds("ts_sec").alias("at")).withWatermark("at", delay)
    # sessions join where one starts as the other ends: the gap is a microsecond less than the TTL
    window = F.session_window("at", f"{ttl * 1_000_000 - 1} microseconds").alias("w")
    spans = timed.groupBy("topic", "consumer_group", window).agg(F.count("topic").alias("writes"))
    # heartbeats go by their count: a condition on the topic would be pushed below the watermark
    gone = spans.where("writes > 0").withColumn("expired_at", F.timestamp_micros(F.unix_micros("w.end") + 1))
    return gone.select("topic", "consumer_group", F.unix_seconds("w.start").alias("first_write"),
                       (F.unix_seconds("expired_at") - ttl).alias("last_write"), "expired_at")


# -- STR-4 / WIN-6: alerts raised and cleared ---------------------------------

class _Runs(StatefulProcessor):
    """Key (topic, group, bucket of time): its updates until the watermark passes the bucket, then where its flag changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "ts_sec bigint, total_lag bigint, is_alert boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None:
            return iter([])
        if not self.held.exists():
            self.handle.registerTimer(int(key[2]) * 1000)
        for r in rows:
            self.held.appendList([(int(t), int(v), bool(a)) for t, v, a in zip(r["ts_sec"], r["total_lag"], r["is_alert"])])
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(tuple(r) for r in self.held.get())
        self.held.clear()
        rows = [r for n, r in enumerate(rows) if n == 0 or r[2] != rows[n - 1][2]]
        if rows:
            ts, totals, flags = zip(*rows)
            yield pd.DataFrame({"topic": key[0], "consumer_group": key[1], "ends": _stamp([int(key[2]) * 1000] * len(rows)), "ts_sec": ts, "total_lag": totals, "is_alert": flags})

    def close(self) -> None:
        pass


class _Transitions(StatefulProcessor):
    """Key (topic, group): its flag; buckets come whole and none after a later one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flag = handle.getValueState("flag", "is_alert boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(["ts_sec", "total_lag"], kind="stable")
        flag, out = bool(self.flag.get()[0]) if self.flag.exists() else False, []
        for t, v, a in zip(got["ts_sec"], got["total_lag"], got["is_alert"]):
            if bool(a) != flag:
                flag = bool(a)
                out.append((int(t), int(v), flag, "raise" if flag else "clear"))
        self.flag.update((flag,))
        if out:
            ts, totals, flags, names = zip(*out)
            yield pd.DataFrame({"topic": key[0], "consumer_group": key[1], "ts_sec": ts, "total_lag": totals, "is_alert": flags, "transition": names})

    def close(self) -> None:
        pass


def transition_stream(totals: DataFrame, threshold: int, delay: str, bucket_seconds: int = 3600) -> DataFrame:
    """WIN-6 / STR-4 in the stream: each raise and clear of a series' alert once, in time order.

    ``totals``: topic, consumer_group, ts_sec, total_lag, in any order the
    watermark allows (a null topic is a heartbeat). Updates wait in buckets of time, each a key
    of its own, so a hot series is spread; a passed bucket sends only the updates at which its
    flag changes, and a second state, one flag for each series, joins them.
    """
    M.check_params(threshold=threshold)
    ends = ((F.floor(F.col("ts_sec") / bucket_seconds) + 1) * bucket_seconds).cast("bigint")
    timed = totals.select("topic", "consumer_group", ends.alias("bucket"), "ts_sec", "total_lag", (F.col("total_lag") > F.lit(threshold)).alias("is_alert"), F.timestamp_seconds("ts_sec").alias("at"))
    runs = timed.withWatermark("at", delay).groupBy("topic", "consumer_group", "bucket").transformWithStateInPandas(_Runs(), _RUNS, "Append", "EventTime", None, "ends")
    return runs.groupBy("topic", "consumer_group").transformWithStateInPandas(_Transitions(), _TRANSITIONS, "Append", "EventTime")
