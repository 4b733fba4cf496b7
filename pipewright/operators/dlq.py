"""Dead letter queue operators (FLT-1, FLT-5, PRJ-2, SRT-1/2, AGG-5, SRC-6/7,
JON-3/4, WIN-5, DLQ-1..9).

State changes are set-based: a request frame is joined with the current
state once and every outcome is a column expression -- no per-event loop,
no per-event round trip. Retries of a batch use the closed form of the
state machine (attempt k of an id is decided by k, the starting status and
retry count, and the replay verdict, which is fixed within a batch).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import model as M
from ..functions import jsonschema as JS
from ..functions.scalars import join_errors, stable_id, ts_literal
from ..sources import commits
from .route import Validator
from .skew import ordinal_within

DEFAULT_LIMIT = 50
PAGE_SIZE = 20


def filters(topic: str = "", status: str = "") -> Column:
    """FLT-1: optional filters, ANDed; an empty string means no filter."""
    conds = [F.lit(True)]
    if topic:
        conds.append(F.col("topic_name") == topic)
    if status:
        conds.append(F.col("status") == status)
    return reduce(lambda a, b: a & b, conds)


def list_events(dlq: DataFrame, topic: str = "", status: str = "", limit: int = 0,
                offset: int = 0) -> DataFrame:
    """FLT-1 + SRT-1: newest first, LIMIT (0 -> 50) OFFSET; ties by id.
    Sort and limit stay adjacent so Spark plans a top-N, not a full sort."""
    limit = limit or DEFAULT_LIMIT
    out = dlq.filter(filters(topic, status)).orderBy(F.desc("created_at"), F.asc("id"))
    if offset:
        out = out.offset(offset)
    return out.limit(limit)


def page(dlq: DataFrame, page_no: int = 0, status: str = M.STATUS_PENDING,
         topic: str = "") -> DataFrame:
    """SRT-2: the UI page (20 rows, offset = page x 20, pending preselected)."""
    return list_events(dlq, topic, status, PAGE_SIZE, page_no * PAGE_SIZE)


def by_id(dlq: DataFrame, event_id: str) -> DataFrame:
    """SRC-6: true point lookup (not limited to the newest rows)."""
    return dlq.filter(F.col("id") == event_id)


def payload_view(dlq: DataFrame) -> DataFrame:
    """PRJ-2: API rows: a JSON object payload as a VARIANT object, JSON null
    as NULL, anything else as ``{"raw": text}``; a blank producer is NULL."""
    v = JS.strict_parse(F.col("payload"))
    is_obj = F.try_variant_get(v, "$", "struct<>").isNotNull()
    is_null = F.is_variant_null(v)
    raw = F.to_variant_object(F.named_struct(F.lit("raw"), F.col("payload")))
    return dlq.withColumns({
        "payload": F.when(is_obj, v).when(is_null, F.lit(None).cast("variant")).otherwise(raw),
        "producer_id": F.nullif(F.col("producer_id"), F.lit("")),
    })


def stats(dlq: DataFrame, topic: str = "") -> DataFrame:
    """AGG-5: counts per status, zero-filled; total sums the four known
    statuses only. A global aggregate: one row even on empty input."""
    st = F.col("status")
    counts = [F.count_if(st == s).alias(s) for s in M.STATUSES]
    out = dlq.filter(filters(topic)).agg(*counts)
    return out.withColumn("total", reduce(lambda a, b: a + b, [F.col(s) for s in M.STATUSES]))


def mark_retrying(dlq: DataFrame, ids: DataFrame, now) -> DataFrame:
    """DLQ-1 / FLT-5: guarded transition pending -> retrying for the
    requested ids; ``ok`` is false (the reference's error) when the guard
    fails or the id is unknown. One row per requested id."""
    req = ids.select("id").distinct()
    j = req.join(dlq.select("id", "status"), "id", "left")
    ok = F.coalesce(F.col("status") == M.STATUS_PENDING, F.lit(False))
    return j.select("id", ok.alias("ok"),
                    F.when(ok, F.lit(M.STATUS_RETRYING)).otherwise(F.col("status")).alias("status"),
                    F.when(ok, ts_literal(now)).alias("updated_at"))


def discard(dlq: DataFrame, ids: DataFrame, now) -> DataFrame:
    """DLQ-4 / DLQ-7 / JON-4: discard any status; unknown ids are no error;
    the retry count is untouched. Returns the whole new state."""
    hit = ids.select("id").distinct().withColumn("_hit", F.lit(True))
    j = dlq.join(hit, "id", "left")
    h = F.col("_hit").isNotNull()
    return j.withColumns({
        "status": F.when(h, F.lit(M.STATUS_DISCARDED)).otherwise(F.col("status")),
        "updated_at": F.when(h, ts_literal(now)).otherwise(F.col("updated_at")),
    }).select(*dlq.columns)


def discard_transitions(dlq: DataFrame, ids: DataFrame, now, seq: int = 0) -> DataFrame:
    """DLQ-4 as append-only transition records: one per requested id that
    exists (any status), nothing for unknown ids."""
    hit = dlq.join(ids.select("id").distinct(), "id", "left_semi")
    return hit.select("id", F.lit(int(seq)).cast("bigint").alias("seq"), "topic_name", F.col("status").alias("from_status"),
                      F.lit(M.STATUS_DISCARDED).alias("status"), "retry_count", "error_message",
                      "last_retry_at", ts_literal(now).alias("updated_at"))


def _replay_verdicts(state: DataFrame, schemas: DataFrame) -> DataFrame:
    """Re-validate each DLQ payload with the schema active *now*."""
    v = Validator.from_registry(schemas)
    out = v.apply(state, "topic_name", "payload")
    return out.withColumns({
        "_pass": F.coalesce(F.col("is_valid"), F.lit(False)),
        "_err": F.when(F.col("system_error").isNotNull(),
                       F.concat(F.lit("schema validation system error: "), F.col("system_error")))
        .otherwise(join_errors(F.col("errors"))),
        "_system": F.col("system_error").isNotNull(),
        "_sid": F.col("schema_id"),
    }).drop("is_valid", "errors", "schema_id", "system_error")


def retry(dlq: DataFrame, requests: DataFrame, schemas: DataFrame, now,
          seq: int = 0, failed: DataFrame | None = None) -> dict[str, DataFrame]:
    """DLQ-5/6/8 (+ SRC-7, JON-3, WIN-5): replay a batch of requested ids.

    ``requests``: (pos, id), duplicates allowed. Returns:
    ``results`` (one per request: pos, id, success, message);
    ``transitions`` (only the ids whose state changed, stamped ``seq``: the
    rows to append to the transitions log -- the scalable write path);
    ``state`` (the whole new DLQ state, for small tables or snapshots);
    ``replay_rows`` (the new DLQ rows each failing replay adds, producer
    ``pw-dlq-replay``; none for a schema that doesn't compile, as RTE-2);
    ``messages`` (what the passing replays publish: topic, a new key, value,
    headers with the replay producer).

    Publish ``messages`` first; if some couldn't be written, call again with
    ``failed`` (id, error): those replays fail with that error and their
    rows are of type ``publish_error``.
    """
    nowc = ts_literal(now)
    req = ordinal_within(requests.select("pos", "id"), ["id"], "pos", out="k")
    per_id = requests.groupBy("id").agg(F.count(F.lit(1)).alias("attempts"))
    known = _replay_verdicts(dlq.join(per_id.select("id"), "id", "left_semi"), schemas)
    if failed is None:
        known = known.withColumn("_publish", F.lit(None).cast("string"))
    else:
        known = known.join(failed.groupBy("id").agg(F.min("error").alias("_publish")), "id", "left")
    unpublished = F.col("_pass") & F.col("_publish").isNotNull()
    known = known.withColumns({
        "_err": F.when(unpublished, F.concat(F.lit(M.KAFKA_WRITE_FAILED.format(error="")), F.col("_publish")))
        .otherwise(F.col("_err")),
        "_type": F.when(unpublished, F.lit(M.ERROR_PUBLISH)).when(~F.col("_system"), F.lit(M.ERROR_SCHEMA_VALIDATION)),
        "_pass": F.col("_pass") & F.col("_publish").isNull(),
    })
    known = known.select("id", "topic_name", "payload", "producer_id", "status", "retry_count",
                         "error_message", "_pass", "_err", "_type", "_sid")
    j = req.join(known, "id", "left")
    k, r, s = F.col("k"), F.col("retry_count"), F.col("status")
    found = s.isNotNull()
    pending = s == M.STATUS_PENDING
    runs = found & pending & ((k == 1) | (~F.col("_pass") & (r + k - 1 < M.MAX_RETRIES)))
    success = runs & F.col("_pass")
    not_found = F.concat(F.lit("event not found: fetching DLQ event "), F.col("id"),
                         F.lit(": sql: no rows in result set"))
    not_pending = F.concat(F.lit("cannot retry: event "), F.col("id"),
                           F.lit(" is not in pending status — cannot retry"))
    message = (F.when(~found, not_found).when(~runs, not_pending)
               .when(success, F.lit(M.MSG_REPLAYED))
               .otherwise(F.concat(F.lit("replay failed: "), F.col("_err"))))
    results = j.select("pos", "id", F.coalesce(success, F.lit(False)).alias("success"),
                       message.alias("message"))

    # final state per requested id, closed form
    att = known.join(per_id, "id").filter(F.col("status") == M.STATUS_PENDING)
    n_run = F.when(F.col("_pass"), F.lit(1)).otherwise(
        F.least(F.col("attempts"), F.greatest(F.lit(1), F.lit(M.MAX_RETRIES) - F.col("retry_count"))))
    att = att.withColumn("_n", n_run.cast("int"))
    new_retry = (F.col("retry_count") + F.col("_n")).cast("int")
    changes = att.select(
        "id", "topic_name", F.lit(True).alias("_chg"),
        F.when(F.col("_pass"), F.lit(M.STATUS_RETRIED))
        .when(new_retry >= M.MAX_RETRIES, F.lit(M.STATUS_DISCARDED))
        .otherwise(F.lit(M.STATUS_PENDING)).alias("_status"),
        new_retry.alias("_retry"),
        F.when(~F.col("_pass"), F.col("_err")).alias("_msg"),
        F.col("error_message").alias("_old_msg"))
    trans = changes.select(
        "id", F.lit(int(seq)).cast("bigint").alias("seq"), "topic_name", F.lit(M.STATUS_PENDING).alias("from_status"),
        F.col("_status").alias("status"),
        F.col("_retry").alias("retry_count"),
        F.coalesce(F.col("_msg"), F.col("_old_msg")).alias("error_message"),
        nowc.alias("last_retry_at"), nowc.alias("updated_at"))
    changes = changes.drop("_old_msg", "topic_name")
    st = dlq.join(changes, "id", "left")
    chg = F.col("_chg").isNotNull()
    state = st.withColumns({
        "status": F.when(chg, F.col("_status")).otherwise(F.col("status")),
        "retry_count": F.when(chg, F.col("_retry")).otherwise(F.col("retry_count")),
        "error_message": F.when(chg & F.col("_msg").isNotNull(), F.col("_msg")).otherwise(F.col("error_message")),
        "last_retry_at": F.when(chg, nowc).otherwise(F.col("last_retry_at")),
        "updated_at": F.when(chg, nowc).otherwise(F.col("updated_at")),
    }).select(*dlq.columns)

    # DLQ-8: every failing run of a schema-invalid replay inserts a new row
    failing = att.filter(~F.col("_pass") & F.col("_type").isNotNull()).select(
        "id", "topic_name", "payload", "_err", "_type", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("attempt"))
    rid = stable_id(F.col("id"), F.col("attempt"), F.lit("replay"))
    replay_rows = failing.select(
        rid.alias("id"), "topic_name",
        F.lit(M.DLQ_DEFAULT_PARTITION).cast("int").alias("partition_id"),
        F.lit(M.DLQ_DEFAULT_OFFSET).cast("bigint").alias("kafka_offset"),
        "payload", F.col("_type").alias("error_type"),
        F.col("_err").alias("error_message"), F.lit(0).cast("int").alias("retry_count"),
        F.lit(M.STATUS_PENDING).alias("status"), F.lit(M.REPLAY_PRODUCER).alias("producer_id"),
        nowc.alias("created_at"), nowc.alias("updated_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_retry_at"), F.col("id").alias("replay_of"),
        "attempt")
    # the replayed events themselves: one message for each id whose replay passes
    messages = att.filter("_pass").select(
        F.col("topic_name").alias("topic"), stable_id(F.col("id"), F.lit(int(seq)), F.lit("message")).alias("key"),
        F.col("payload").alias("value"),
        F.create_map(F.lit(M.HEADER_PRODUCER), F.lit(M.REPLAY_PRODUCER), F.lit(M.HEADER_SCHEMA), F.col("_sid")).alias("headers"),
        F.col("id").alias("replay_of"))
    return {"results": results, "transitions": trans, "state": state, "replay_rows": replay_rows,
            "messages": messages}


def retry_claimed(dlq: DataFrame, requests: DataFrame, schemas: DataFrame, now, root: str, batch: str,
                  seq: int = 0, failed: DataFrame | None = None) -> dict[str, DataFrame]:
    """DLQ-1 as a lock: ``retry`` for the events that ``batch`` is the first to claim.

    Pending events it names are claimed in the claims table at ``root`` with
    their retry count as epoch; one that an earlier batch holds is not pending for this
    one ("cannot retry"), so of overlapping batches exactly one replays
    an event. A batch that runs again, also after a crash, owns the same events.
    """
    named = requests.select("id").distinct()
    pending = dlq.where(F.col("status") == M.STATUS_PENDING).join(named, "id", "left_semi")
    own = commits.claim(dlq.sparkSession, root, batch, pending.select("id", F.col("retry_count").alias("epoch")))
    mine = own.select("id", F.col("epoch").cast("int").alias("retry_count"), F.lit(True).alias("_own"))
    lost = (F.col("status") == M.STATUS_PENDING) & F.col("_own").isNull()
    seen = dlq.join(mine, ["id", "retry_count"], "left").withColumn(
        "status", F.when(lost, F.lit(M.STATUS_RETRYING)).otherwise(F.col("status"))).select(*dlq.columns)
    out = retry(seen, requests, schemas, now, seq, failed)
    return out | {"state": current_state(dlq, out["transitions"]), "owned": own}


def fold(actions: DataFrame) -> DataFrame:
    """DLQ-9: fold an ordered action log (id, seq, action in retry_ok,
    retry_fail, discard) from ``pending, 0`` into the current state.

    Closed form, no per-id collect. The state leaves ``pending`` at the first
    terminal action: a discard, a retry_ok, or the 5th retry_fail. With
    T = first discard/retry_ok and F = retry_fails before T:
    F >= 5 -> discarded with 5; no T -> pending with F; T a discard ->
    discarded with F; T a retry_ok -> retried with F + 1, unless a later
    discard (discard applies in any state) makes it discarded, count kept.
    Two partial aggregations and one join on id.
    """
    a = F.col("action")
    # the terminal action as a small int keeps every buffer fixed-width, so
    # the partial aggregates are hash aggregates (a string value would force
    # a sort-based aggregate on the map side)
    code = F.when(a == "discard", F.lit(1)).when(a == "retry_ok", F.lit(2))
    first = (actions.groupBy("id").agg(
        F.min(F.when(code.isNotNull(), F.col("seq"))).alias("_t"),
        F.min_by(code, F.when(code.isNotNull(), F.col("seq"))).alias("_tc"),
        F.max(F.when(a == "discard", F.col("seq"))).alias("_d"))
        .withColumn("_ta", F.when(F.col("_tc") == 1, F.lit("discard")).when(F.col("_tc") == 2, F.lit("retry_ok")))
        .drop("_tc"))
    fails = (actions.filter(a == "retry_fail").select("id", "seq")
             .join(first.select("id", "_t"), "id", "left")
             .filter(F.col("_t").isNull() | (F.col("seq") < F.col("_t")))
             .groupBy("id").agg(F.count(F.lit(1)).alias("_f")))
    j = first.join(fails, "id", "left")
    f = F.coalesce(F.col("_f"), F.lit(0))
    status = (F.when(f >= M.MAX_RETRIES, F.lit(M.STATUS_DISCARDED))
              .when(F.col("_t").isNull(), F.lit(M.STATUS_PENDING))
              .when(F.col("_ta") == "discard", F.lit(M.STATUS_DISCARDED))
              .when(F.col("_d") > F.col("_t"), F.lit(M.STATUS_DISCARDED))
              .otherwise(F.lit(M.STATUS_RETRIED)))
    retry_count = (F.when(f >= M.MAX_RETRIES, F.lit(M.MAX_RETRIES))
                   .when(F.col("_ta") == "retry_ok", f + 1).otherwise(f))
    return j.select("id", status.alias("status"), retry_count.cast("bigint").alias("retry_count"))


TRACKED = ["status", "retry_count", "error_message", "last_retry_at", "updated_at"]


def transitions(before: DataFrame, after: DataFrame, seq: int) -> DataFrame:
    """The rows of ``after`` whose tracked fields differ from ``before``, as
    append-only transition records (id, seq, topic, the status before, tracked fields)."""
    b = before.select("id", *[F.col(c).alias(f"_b_{c}") for c in TRACKED])
    j = after.select("id", "topic_name", *TRACKED).join(b, "id", "left")
    changed = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in TRACKED])
    return j.filter(changed).select("id", F.lit(int(seq)).cast("bigint").alias("seq"), "topic_name",
                                    F.col("_b_status").alias("from_status"), *TRACKED)


# -- AGG-5 / DOC-3 kept up to date ------------------------------------------------

COUNTS = ["topic_name", "status"]


def status_counts(dlq: DataFrame) -> DataFrame:
    """Events by topic and status: the snapshot that changes are added to."""
    return dlq.groupBy(*COUNTS).agg(F.count(F.lit(1)).alias("n"))


def count_changes(new: DataFrame | None = None, transitions: DataFrame | None = None) -> DataFrame:
    """What a batch changes in the counts, from the batch alone: one more for each new
    row; for each transition one less where it was and one more where it is."""
    parts = []
    if new is not None:
        parts.append(new.select(*COUNTS, F.lit(1).alias("d")))
    if transitions is not None:
        moves = F.array(F.struct(F.col("from_status").alias("status"), F.lit(-1).alias("d")), F.struct("status", F.lit(1).alias("d")))
        parts.append(transitions.select("topic_name", F.explode(moves).alias("m")).select("topic_name", "m.status", "m.d"))
    if not parts:
        raise ValueError("a batch has new rows, transitions or both")
    return reduce(DataFrame.unionByName, parts).where("status is not null").groupBy(*COUNTS).agg(F.sum("d").alias("n"))


def apply_changes(counts: DataFrame, *changes: DataFrame) -> DataFrame:
    """The counts after some batches, in any order."""
    every = reduce(DataFrame.unionByName, changes, counts)
    return every.groupBy(*COUNTS).agg(F.sum("n").alias("n")).where("n <> 0")


def stats_of_counts(counts: DataFrame, topic: str = "") -> DataFrame:
    """AGG-5 (as ``stats``) from kept counts."""
    of = counts.filter(F.col("topic_name") == topic) if topic else counts
    wide = of.agg(*[F.coalesce(F.sum(F.when(F.col("status") == s, F.col("n"))), F.lit(0)).cast("bigint").alias(s) for s in M.STATUSES])
    return wide.withColumn("total", reduce(lambda a, b: a + b, [F.col(s) for s in M.STATUSES]))


def depth_of_counts(counts: DataFrame) -> DataFrame:
    """DOC-3 (as ``depth``) from kept counts."""
    waiting = F.col("status").isin(M.STATUS_PENDING, M.STATUS_RETRYING)
    return counts.groupBy("topic_name").agg(F.coalesce(F.sum(F.when(waiting, F.col("n"))), F.lit(0)).cast("bigint").alias("depth"))


def current_state(log: DataFrame, trans: DataFrame) -> DataFrame:
    """The DLQ's current state at read time: the newest transition per id
    (a partial + final ``max_by`` aggregate, no per-id collect) applied to
    the append-only log rows."""
    last = trans.groupBy("id").agg(F.max_by(F.struct(*TRACKED), "seq").alias("_t"))
    j = log.join(last, "id", "left")
    return j.select(*[F.when(F.col("_t").isNotNull(), F.col(f"_t.{c}")).otherwise(F.col(c)).alias(c)
                      if c in TRACKED else F.col(c) for c in log.columns])


def replay_success(actions: DataFrame) -> DataFrame:
    """DOC-5: replay success rate = successes / attempts."""
    a = F.col("action")
    return actions.agg(
        F.count_if(a.isin("retry_ok", "retry_fail")).alias("attempts"),
        F.count_if(a == "retry_ok").alias("successes")).withColumn(
        "success_rate", F.try_divide(F.col("successes").cast("double"), F.col("attempts").cast("double")))


def depth(dlq: DataFrame) -> DataFrame:
    """DOC-3: DLQ depth (pending + retrying) per topic."""
    return dlq.groupBy("topic_name").agg(
        F.count_if(F.col("status").isin(M.STATUS_PENDING, M.STATUS_RETRYING)).alias("depth"))


__all__ = ["list_events", "page", "by_id", "payload_view", "stats", "mark_retrying", "discard",
           "retry", "fold", "replay_success", "depth"]
