"""Oracle SQL (DuckDB dialect) for every value-checked query.

Written independently of the Spark code: the fixtures are re-derived from
the driver tables with plain SQL, and every operator is restated as SQL
(the DLQ fold even as a recursive CTE). The driver runs these against the
same parquet files and compares rows, schema and values.
"""

from __future__ import annotations

from ..sources.fixtures import EXTENDED_JSON, FULL_JSON, LENIENT_JSON

NOW = "TIMESTAMP '2024-01-31 00:00:00'"
RETENTION_NOW = "TIMESTAMP '2024-01-16 00:00:00'"
NOW_SEC = "cast(floor(epoch(TIMESTAMP '2024-01-31 00:00:00')) as bigint)"
RET_SEC = "cast(floor(epoch(TIMESTAMP '2024-01-16 00:00:00')) as bigint)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FULL = _q(FULL_JSON)
LENIENT = _q(LENIENT_JSON)
EXTENDED = _q(EXTENDED_JSON)

# ---------------------------------------------------------------------------
# Fixture CTEs
# ---------------------------------------------------------------------------
EVENT_LOG = """event_log as (
  select event_id, event_type as topic, cast(user_id % 4 as integer) as partition_id,
    event_id as kafka_offset, cast(user_id as varchar) as msg_key,
    'producer-' || cast(user_id % 7 as varchar) as producer_id, ts,
    case when event_id % 97 = 0 then '{"order_id":'
         when event_id % 20 = 0 then '{"note":"no order here","amount":"twelve","seen":0}'
         when event_id % 33 = 0 then '{"order_id":"' || cast(event_id as varchar) || '","amount":-' || cast(value as varchar) || ',"currency":"USD"}'
         when event_id % 29 = 0 then '{"order_id":"' || cast(event_id as varchar) || '","amount":' || cast(value as varchar) || ',"currency":"JPY"}'
         else '{"order_id":"' || cast(event_id as varchar) || '","amount":' || cast(value as varchar) || ',"currency":"'
              || case event_id % 3 when 0 then 'USD' when 1 then 'EUR' else 'GBP' end || '"}' end as payload
  from events)"""

SCHEMAS = f"""schemas as (
  select * from (values
    ('sch-click-v1', 'click', 1, {FULL}, true, TIMESTAMP '2024-01-01 00:00:00'),
    ('sch-error-v1', 'error', 1, {FULL}, true, TIMESTAMP '2024-01-01 00:00:00'),
    ('sch-purchase-v1', 'purchase', 1, {FULL}, true, TIMESTAMP '2024-01-01 00:00:00'),
    ('sch-view-v1', 'view', 1, {LENIENT}, false, TIMESTAMP '2024-01-01 00:00:00'),
    ('sch-view-v2', 'view', 2, {FULL}, true, TIMESTAMP '2024-01-15 00:00:00'),
    ('sch-ghost-v1', 'ghost', 1, {LENIENT}, true, TIMESTAMP '2024-01-01 00:00:00'))
    t(id, topic_name, version, schema_json, is_active, created_at))"""

REQUESTS = f"""requests as (
  select topic_name, case when day(d) % 2 = 0 then {FULL} else {LENIENT} end as schema_json,
    cast(d as timestamp) as requested_at, cast(d - DATE '2000-01-01' as bigint) as seq
  from (select distinct event_type as topic_name, cast(ts as date) as d from events
        union all select 'brand-new', min(cast(ts as date)) from events) r)"""

REGISTERED = """registered as (
  with cur as (select topic_name, max(version) as max_v from schemas group by topic_name),
  num as (select r.*, coalesce(c.max_v, 0) + row_number() over (partition by r.topic_name order by r.seq) as version,
            row_number() over (partition by r.topic_name order by r.seq) as n,
            count(*) over (partition by r.topic_name) as cnt
          from requests r left join cur c on c.topic_name = r.topic_name)
  select s.id, s.topic_name, s.version, s.schema_json,
    s.is_active and s.topic_name not in (select topic_name from requests) as is_active, s.created_at
  from schemas s
  union all
  select 'sch-' || topic_name || '-v' || cast(version as varchar), topic_name, cast(version as integer), schema_json,
    n = cnt, requested_at from num)"""

TOPICS = """topics as (
  select topic as id, topic as name, cast(null as varchar) as description, 1 as partitions,
    1 as replication_factor, min(ts) as created_at, max(ts) as updated_at
  from event_log group by topic)"""

TOPIC_PARTITIONS = """topic_partitions as (
  select topic, partition_id, case when topic = 'view' then [1] else [1, 2, 3] end as replicas
  from (select distinct topic, partition_id from event_log
        union select 'click', 4 from event_log where topic = 'click') p)"""

COMMITTED = """committed as (
  select 'analytics' as consumer_group, topic, partition_id,
    cast(max(kafka_offset) + 1 - partition_id * 500 as bigint) as committed_offset
  from event_log where partition_id <> 3 group by topic, partition_id
  union all
  select 'billing', topic, partition_id,
    cast(case when partition_id = 1 then max(kafka_offset) + 1 + 2 else 0 end as bigint)
  from event_log group by topic, partition_id)"""

LATEST = """latest as (
  select tp.topic, tp.partition_id, cast(coalesce(h.nxt, 0) as bigint) as latest_offset
  from topic_partitions tp left join
    (select topic, partition_id, max(kafka_offset) + 1 as nxt from event_log group by topic, partition_id) h
    on h.topic = tp.topic and h.partition_id = tp.partition_id)"""

PLAG = """plag as (
  select l.topic, p.consumer_group, l.partition_id, l.latest_offset,
    cast(coalesce(c.committed_offset, 0) as bigint) as committed_offset,
    greatest(l.latest_offset - coalesce(c.committed_offset, 0), 0) as lag
  from latest l join (select distinct consumer_group, topic from committed) p on p.topic = l.topic
  left join committed c on c.consumer_group = p.consumer_group and c.topic = l.topic and c.partition_id = l.partition_id)"""

MEMBERS = """members as (
  select event_type as topic, 'cg-' || cast(user_id % 2 as varchar) as consumer_group,
    case when event_id % 101 = 0 then 'malformed'
         else cast(cast(floor(epoch(ts)) as bigint) as varchar) || ':' || cast(cast(floor(value * 10) as bigint) as varchar) end as member
  from events)"""

READINGS = """readings as (
  select topic, consumer_group, try_cast(split_part(member, ':', 1) as bigint) as ts_sec,
    try_cast(split_part(member, ':', 2) as bigint) as lag
  from members where regexp_matches(member, '^[+-]?[0-9]+:[+-]?[0-9]+$')
    and try_cast(split_part(member, ':', 1) as bigint) is not null
    and try_cast(split_part(member, ':', 2) as bigint) is not null)"""

DLQ = """dlq as (
  select 'dlq-' || cast(event_id as varchar) as id, event_type as topic_name, 0 as partition_id,
    cast(-1 as bigint) as kafka_offset,
    case when event_id % 97 = 0 then '{"order_id":'
         when event_id % 20 = 0 then '{"bad_field":"x","amount":"not-a-number"}'
         when event_id % 33 = 0 then '{"order_id":"a","amount":-1,"currency":"USD"}'
         when event_id % 13 = 0 then 'null'
         when event_id % 17 = 0 then '[1,2]'
         else '{"order_id":"a","amount":1,"currency":"USD"}' end as payload,
    case when event_id % 29 = 0 then 'publish_error' else 'schema_validation' end as error_type,
    'fixture' as error_message, cast(event_id % 5 as integer) as retry_count,
    case event_id % 7 when 4 then 'retrying' when 5 then 'retried' when 6 then 'discarded' else 'pending' end as status,
    case when event_id % 11 = 0 then '' else 'producer-' || cast(user_id % 7 as varchar) end as producer_id,
    date_trunc('hour', ts) as created_at, date_trunc('hour', ts) as updated_at,
    case when event_id % 5 = 0 then cast(null as timestamp) else date_trunc('hour', ts) end as last_retry_at
  from events)"""

RETRY_REQUESTS = """retry_requests as (
  select cast(rep * 1000000000000 + cast(regexp_extract(id, '(\\d+)$', 1) as bigint) as bigint) as pos, id
  from (select id, 0 as rep from dlq
        union all select id, 1 from dlq where retry_count >= 3
        union all select id, 2 from dlq where retry_count >= 3) r
  union all select cast(-1 as bigint), 'dlq-missing')"""

ACTIONS = """dlq_actions as (
  select 'ev-' || cast(user_id as varchar) as id, event_id as seq, ts as at,
    case event_id % 6 when 0 then 'retry_ok' when 5 then 'discard' else 'retry_fail' end as action
  from events)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def _tn(t: str) -> str:
    return (f"(case when {t} = 'OBJECT' then 'object' when {t} = 'ARRAY' then 'array' "
            f"when {t} = 'VARCHAR' then 'string' when {t} = 'BOOLEAN' then 'boolean' "
            f"when {t} = 'NULL' then 'null' else 'number' end)")


NUM = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"


def _canon(expr: str) -> str:
    return f"regexp_replace(cast(cast({expr} as decimal(38, 9)) as varchar), '\\.?0+$', '')"


def validation_cte(src: str = "event_log", payload: str = "payload", topic: str = "topic",
                   sid_case: str | None = None) -> str:
    """Validation of the FULL schema restated in SQL, with our message
    catalogue, errors in schema order."""
    sid_case = sid_case or (f"case {topic} when 'click' then 'sch-click-v1' when 'error' then 'sch-error-v1' "
                            f"when 'purchase' then 'sch-purchase-v1' when 'view' then 'sch-view-v2' end")
    p = payload
    return f"""v0 as (select s.*, {sid_case} as sid, json_valid({p}) as ok from {src} s),
v1 as (select *, case when sid is not null and ok then json_type({p}) end as rt from v0),
v2 as (select *, coalesce(rt = 'OBJECT', false) as is_obj,
  case when rt = 'OBJECT' then json_type({p}, '$.order_id') end as t_oid,
  case when rt = 'OBJECT' then json_type({p}, '$.amount') end as t_amt,
  case when rt = 'OBJECT' then json_type({p}, '$.currency') end as t_cur from v1),
v3 as (select *,
  case when rt is not null and rt <> 'OBJECT' then '/: must be object (got ' || {_tn('rt')} || ')' end as e1,
  case when is_obj and t_oid is null then '/: missing required property ''order_id''' end as e2,
  case when is_obj and t_amt is null then '/: missing required property ''amount''' end as e3,
  case when is_obj and t_cur is null then '/: missing required property ''currency''' end as e4,
  case when is_obj and t_oid is not null and t_oid <> 'VARCHAR' then '/order_id: must be string (got ' || {_tn('t_oid')} || ')' end as e5,
  case when is_obj and t_amt is not null and t_amt not in {NUM} then '/amount: must be number (got ' || {_tn('t_amt')} || ')' end as e6,
  case when is_obj and t_amt in {NUM} and cast(json_extract_string({p}, '$.amount') as double) < 0
       then '/amount: must be >= 0 (got ' || {_canon(f"cast(json_extract_string({p}, '$.amount') as double)")} || ')' end as e7,
  case when is_obj and t_cur is not null and t_cur <> 'VARCHAR' then '/currency: must be string (got ' || {_tn('t_cur')} || ')' end as e8,
  case when is_obj and t_cur = 'VARCHAR' and json_extract_string({p}, '$.currency') not in ('USD', 'EUR', 'GBP')
       then '/currency: must be one of [USD, EUR, GBP] (got ' || cast(json_extract({p}, '$.currency') as varchar) || ')' end as e9
  from v2),
validated as (select *,
  case when sid is null then true when not ok then false
       else e1 is null and e2 is null and e3 is null and e4 is null and e5 is null and e6 is null
            and e7 is null and e8 is null and e9 is null end as is_valid,
  coalesce(sid, '') as schema_id,
  case when sid is null then ['no schema registered for topic — validation skipped']
       when not ok then ['payload is not valid JSON']
       else list_filter([e1, e2, e3, e4, e5, e6, e7, e8, e9], lambda x: x is not null) end as errs
  from v3)"""


def _msg(errs: str = "errs") -> str:
    return (f"case when len({errs}) = 0 then 'validation failed (no details)' "
            f"else array_to_string({errs}, '; ') end")


ROUTED = f"""routed as (
  select *, case when is_valid then 'published' else 'dlq' end as route,
    case when not is_valid then 'schema_validation' end as error_type,
    case when not is_valid then {_msg()} end as error_message,
    case when not is_valid then sha256(concat_ws('|', cast(event_id as varchar), topic, payload)) end as dlq_event_id
  from validated)"""


def base_validate() -> str:
    return with_(EVENT_LOG, validation_cte(), ROUTED)


# ---------------------------------------------------------------------------
# Queries
# ---------------------------------------------------------------------------

def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    V = base_validate()
    q["validate_events"] = V + """select event_id, topic, is_valid, schema_id,
  case when not is_valid then error_message end as error_message,
  cast(case when is_valid then 0 else len(errs) end as bigint) as n_errors from routed"""
    q["validation_errors"] = V + """select topic, e as error, count(*) as n
  from (select topic, unnest(errs) as e from routed where not is_valid) x group by topic, e"""
    q["route_events"] = V + """select topic, route, error_type, count(*) as n from routed group by topic, route, error_type"""
    q["publish_results"] = V + """, nxt as (select topic as t, partition_id as p, max(kafka_offset) + 1 as n
    from event_log group by topic, partition_id)
  select event_id as pos, topic, route = 'published' as success, dlq_event_id,
  case when route <> 'published' then error_message end as error,
  case when route = 'published' then partition_id end as partition_id,
  case when route = 'published' then cast(nxt.n + row_number() over (
    partition by topic, partition_id, route = 'published' order by event_id) - 1 as bigint) end as kafka_offset
  from routed left join nxt on nxt.t = routed.topic and nxt.p = routed.partition_id"""
    q["published_messages"] = V + """select topic, msg_key as key, payload as value,
  producer_id as h_producer_id, schema_id as h_schema_id, '2024-01-31T00:00:00Z' as h_published_at
  from routed where route = 'published'"""
    q["dlq_insert"] = V + f"""select dlq_event_id as id, topic as topic_name, 0 as partition_id,
  cast(-1 as bigint) as kafka_offset, payload, error_type, error_message, 0 as retry_count,
  'pending' as status, case when coalesce(producer_id, '') = '' then 'anon-' || dlq_event_id else producer_id end as producer_id,
  {NOW} as created_at, {NOW} as updated_at, cast(null as timestamp) as last_retry_at
  from routed where route = 'dlq'"""
    q["metric_rejection_rate"] = V + """select topic, count(*) as events, count(*) filter (where not is_valid) as rejected,
  avg(case when not is_valid then 1.0 else 0.0 end) as rejection_rate from routed group by topic"""
    q["parse_csv"] = with_(EVENT_LOG) + """select event_id,
  cast(len(list_filter(list_transform(string_split(payload, ','), lambda x: trim(x)), lambda x: x <> '')) as bigint) as n_items,
  list_filter(list_transform(string_split(payload, ','), lambda x: trim(x)), lambda x: x <> '')[1] as first_item
  from event_log"""

    q["jsonschema_extended"] = extended_sql()

    # registry
    R = with_(EVENT_LOG, SCHEMAS, REQUESTS, REGISTERED, TOPICS)
    q["register_schemas"] = R + "select id, topic_name, version, schema_json, is_active, created_at from registered"
    # the writer of the odd days was first, the other's versions follow
    late = REGISTERED.replace("order by r.seq", "order by 1 - day(r.requested_at) % 2, r.seq")
    q["register_concurrent"] = with_(SCHEMAS, REQUESTS, late) + "select id, topic_name, version, schema_json, is_active, created_at from registered"
    q["active_schema"] = R + "select id, topic_name, version, schema_json, is_active, created_at from registered where is_active"
    q["schema_history"] = R + "select id, topic_name, version, schema_json, is_active, created_at from registered where topic_name = 'view'"
    q["schema_orphans"] = R + """select id, topic_name, version, schema_json, is_active, created_at from registered
  where topic_name not in (select name from topics)"""
    q["topic_upsert"] = R + f"""select coalesce(t.id, n.name) as id, coalesce(t.name, n.name) as name, t.description,
  cast(case when t.id is not null then t.partitions else 1 end as integer) as partitions,
  cast(case when t.id is not null then t.replication_factor else 1 end as integer) as replication_factor,
  case when t.id is not null then t.created_at else {NOW} end as created_at,
  case when n.name is not null then {NOW} else t.updated_at end as updated_at
  from topics t full outer join (select distinct topic_name as name from requests) n on n.name = t.name"""
    # from the statement: of the versions created up to then, the last created
    q["schema_as_of"] = with_(EVENT_LOG, SCHEMAS, REQUESTS, REGISTERED, DLQ) + """
select d.id, any_value(d.topic_name) as topic_name, any_value(d.created_at) as created_at,
  arg_max(r.id, struct_pack(a := r.created_at, b := r.version)) as schema_id,
  arg_max(r.version, struct_pack(a := r.created_at, b := r.version)) as schema_version
  from dlq d left join registered r on r.topic_name = d.topic_name and r.created_at <= d.created_at
  group by d.id"""

    # topics and offsets
    T = with_(EVENT_LOG, SCHEMAS, REQUESTS, REGISTERED, TOPIC_PARTITIONS)
    tm = """select topic, count(*) as partitions,
  cast(coalesce(len(arg_min(replicas, partition_id)), 1) as integer) as replication_factor
  from topic_partitions where topic in (select distinct topic_name from registered) group by topic"""
    q["topic_metadata"] = T + tm
    q["topic_list"] = with_(EVENT_LOG, SCHEMAS, REQUESTS, REGISTERED, TOPIC_PARTITIONS, TOPICS) + f"""
select t.id, t.name, t.description, cast(coalesce(m.partitions, t.partitions) as bigint) as partitions,
  cast(coalesce(m.replication_factor, t.replication_factor) as integer) as replication_factor,
  t.created_at, t.updated_at from topics t left join ({tm}) m on m.topic = t.name"""
    q["topic_by_name"] = T + f"select * from ({tm}) m where topic = 'click'"
    O = with_(EVENT_LOG, TOPIC_PARTITIONS, COMMITTED, LATEST, PLAG)
    q["latest_offsets"] = O + "select topic, partition_id, latest_offset from latest"
    q["committed_offsets"] = O + "select consumer_group, topic, partition_id, committed_offset from committed"
    q["unread_messages"] = with_(EVENT_LOG, TOPIC_PARTITIONS, COMMITTED) + """select g.consumer_group, e.topic, e.partition_id,
  e.kafka_offset, e.msg_key, e.payload
  from event_log e join topic_partitions tp on tp.topic = e.topic and tp.partition_id = e.partition_id
  cross join (values ('analytics'), ('billing')) g(consumer_group)
  left join committed c on c.consumer_group = g.consumer_group and c.topic = e.topic and c.partition_id = e.partition_id
  where e.kafka_offset >= coalesce(c.committed_offset, 0)"""
    q["partition_lag"] = O + "select topic, consumer_group, partition_id, latest_offset, committed_offset, lag from plag"
    q["lag_total"] = O + "select topic, consumer_group, cast(sum(lag) as bigint) as total_lag from plag group by topic, consumer_group"
    q["topic_latest_offsets"] = O + """select topic, cast(to_json(list_sort(list(struct_pack(
    partition_id := partition_id, latest_offset := latest_offset)))) as varchar) as latest_offsets_json
  from latest group by topic"""
    q["lag_update"] = O + f"""select topic, consumer_group, cast(sum(lag) as bigint) as total_lag,
  sum(lag) > 5000 as is_alert, {NOW} as ts,
  cast(to_json(list_sort(list(struct_pack(partition_id := partition_id, latest_offset := latest_offset,
    committed_offset := committed_offset, lag := lag)))) as varchar) as partitions_json
  from plag group by topic, consumer_group"""
    # alerts over the greatest total that isn't over the mean: some series are over it, one is on it
    tot = """tot as (select topic, consumer_group, cast(sum(lag) as bigint) as total_lag from plag
    group by topic, consumer_group)"""
    q["lag_alerts"] = with_(EVENT_LOG, TOPIC_PARTITIONS, COMMITTED, LATEST, PLAG, tot, """lim as (
  select max(total_lag) as t from tot where total_lag <= (select avg(total_lag) from tot))""") + """
select topic, consumer_group, total_lag from tot where total_lag > (select t from lim)"""
    # a topic's worst series against the topics' worst series
    q["topology_alerts"] = with_(EVENT_LOG, TOPIC_PARTITIONS, COMMITTED, LATEST, PLAG, _NODES, tot, """worst as (
  select topic, max(total_lag) as w from tot group by topic),
  lim as (select max(w) as t from worst where w <= (select avg(w) from worst)),
  al as (
  select distinct topic as id from tot where total_lag > (select t from lim))""") + """
select n.id, n.label, n.type, (n.type = 'topic' and al.id is not null) as is_alert
  from nodes n left join al on al.id = n.id"""

    # readings
    L = with_(MEMBERS, READINGS)
    q["lag_decode"] = with_(MEMBERS) + """select topic, consumer_group,
  case when regexp_matches(member, '^[+-]?[0-9]+:[+-]?[0-9]+$') then try_cast(split_part(member, ':', 1) as bigint) end as ts_sec,
  case when regexp_matches(member, '^[+-]?[0-9]+:[+-]?[0-9]+$') then try_cast(split_part(member, ':', 2) as bigint) end as lag,
  concat_ws(':', 'pw', 'lag', topic, consumer_group) as series_key,
  concat_ws(':', cast(try_cast(split_part(member, ':', 1) as bigint) as varchar), cast(try_cast(split_part(member, ':', 2) as bigint) as varchar)) as member_text
  from members"""
    q["lag_store"] = L + f"""select distinct topic, consumer_group, ts_sec, lag from (
  select * from readings where ts_sec < {RET_SEC}
  union all select * from readings where ts_sec >= {RET_SEC} - 6 * 86400) u"""
    q["lag_history"] = L + f"""select topic, consumer_group, ts_sec, lag from readings
  where ts_sec between {NOW_SEC} - 1440 * 60 and {NOW_SEC}"""
    q["lag_prune"] = L + f"select topic, consumer_group, ts_sec, lag from readings where ts_sec > {RET_SEC} - 24 * 3600"
    q["lag_expiry"] = L + f"""select r.topic, r.consumer_group, r.ts_sec, r.lag from readings r join
  (select topic, consumer_group, max(ts_sec) as last from readings group by topic, consumer_group) m
  on m.topic = r.topic and m.consumer_group = r.consumer_group
  where r.ts_sec > m.last - 24 * 3600 and {NOW_SEC} < m.last + 24 * 3600"""
    q["latest_lag"] = L + """select topic, consumer_group, arg_max(lag, struct_pack(a := ts_sec, b := cast(lag as varchar))) as lag
  from readings group by topic, consumer_group"""
    q["latest_lag_1m"] = L + f"""select s.topic, s.consumer_group, cast(coalesce(r.lag, 0) as bigint) as lag
  from (select distinct topic, consumer_group from readings) s left join
  (select topic, consumer_group, arg_max(lag, struct_pack(a := ts_sec, b := cast(lag as varchar))) as lag
   from readings where ts_sec between {NOW_SEC} - 60 and {NOW_SEC} group by topic, consumer_group) r
  on r.topic = s.topic and r.consumer_group = s.consumer_group"""
    q["lag_peak"] = L + "select topic, consumer_group, cast(greatest(max(lag), 0) as bigint) as peak_lag from readings group by topic, consumer_group"
    q["lag_running_peak"] = L + """select topic, consumer_group, ts_sec, lag,
  max(lag) over (partition by topic, consumer_group order by ts_sec, cast(lag as varchar)
                 rows between unbounded preceding and current row) as running_peak from readings"""
    q["lag_chart"] = L + f"""select topic, consumer_group, ts_sec, lag, strftime(to_timestamp(ts_sec) at time zone 'UTC', '%H:%M:%S') as label,
  cast(greatest(max(lag) over (partition by topic, consumer_group order by ts_sec, cast(lag as varchar)
       rows between unbounded preceding and current row), 0) as bigint) as running_peak
  from (select *, row_number() over (partition by topic, consumer_group order by ts_sec desc, cast(lag as varchar) desc) as rk
        from readings where ts_sec between {NOW_SEC} - 10080 * 60 and {NOW_SEC}) h where rk <= 360"""

    q["lag_chart_topic"] = f"select * from ({q['lag_chart']}) c where topic = 'view'"

    def human(x: str) -> str:
        def tenths(unit: int) -> str:
            t = f"cast(floor(({x} + {unit // 20}) / {unit // 10}) as bigint)"
            return f"cast(cast(floor({t} / 10) as bigint) as varchar) || '.' || cast({t} % 10 as varchar)"
        return (f"case when {x} >= 1000000 then {tenths(1000000)} || 'M' "
                f"when {x} >= 1000 then {tenths(1000)} || 'K' else cast({x} as varchar) end")
    q["lag_format"] = L + f"""select topic, consumer_group, ts_sec, lag, {human('lag')} as lag_text,
  {human('lag * 997')} as big_text from readings"""
    q["alert_transitions"] = L + """select topic, consumer_group, ts_sec, total_lag, is_alert,
  case when is_alert then 'raise' else 'clear' end as transition from (
  select *, lag(is_alert) over (partition by topic, consumer_group order by ts_sec, total_lag) as prev
  from (select topic, consumer_group, ts_sec, lag as total_lag, lag > 2500 as is_alert from readings) t) x
  where is_alert <> coalesce(prev, false)"""
    q["alert_state"] = L + """select topic, consumer_group, arg_max(lag > 2500, struct_pack(a := ts_sec, b := lag)) as is_alert
  from readings group by topic, consumer_group"""
    q["metric_lag_p95"] = L + "select topic, consumer_group, quantile_cont(lag, 0.95) as lag_p95 from readings group by topic, consumer_group"
    # a sketch's value must have a rank near 0.95 in every series, over all readings of the days
    q["metric_lag_p95_sketch"] = L + """select topic, consumer_group, count(*) as n, cast(count(*) as bigint) as n_sketched, true as within_bound
  from readings where cast(make_timestamp(ts_sec * 1000000) as date) between DATE '2024-01-16' and DATE '2024-01-31'
  group by topic, consumer_group"""

    # DLQ
    D = with_(DLQ)
    cols = ("id, topic_name, partition_id, kafka_offset, payload, error_type, error_message, retry_count, "
            "status, producer_id, created_at, updated_at, last_retry_at")
    q["dlq_list"] = D + f"select {cols} from dlq where status = 'pending' order by created_at desc, id limit 50 offset 10"
    q["dlq_page"] = D + f"select {cols} from dlq where status = 'pending' order by created_at desc, id limit 20 offset 40"
    q["dlq_by_id"] = D + f"select {cols} from dlq where id = 'dlq-40'"
    q["dlq_by_id_store"] = q["dlq_by_id"]
    q["dlq_stats"] = D + """select count(*) filter (where status = 'pending') as pending,
  count(*) filter (where status = 'retrying') as retrying, count(*) filter (where status = 'retried') as retried,
  count(*) filter (where status = 'discarded') as discarded,
  count(*) filter (where status in ('pending', 'retrying', 'retried', 'discarded')) as total from dlq"""
    q["metric_dlq_depth"] = D + """select topic_name, count(*) filter (where status in ('pending', 'retrying')) as depth
  from dlq group by topic_name"""
    q["dlq_payload_view"] = D + """select id, nullif(producer_id, '') as producer_id, kind as payload_kind,
  case when kind = 'object' then json_extract_string(payload, '$.order_id') end as payload_order_id,
  case when kind = 'raw' then payload end as payload_raw
  from (select *, case when not json_valid(payload) then 'raw'
                       when json_type(case when json_valid(payload) then payload end) = 'OBJECT' then 'object'
                       when json_type(case when json_valid(payload) then payload end) = 'NULL' then 'null'
                       else 'raw' end as kind from dlq) x"""
    q["dlq_mark_retrying"] = with_(DLQ, RETRY_REQUESTS) + f"""select r.id, coalesce(d.status = 'pending', false) as ok,
  case when d.status = 'pending' then 'retrying' else d.status end as status,
  case when d.status = 'pending' then {NOW} end as updated_at
  from (select distinct id from retry_requests) r left join dlq d on d.id = r.id"""
    q["dlq_discard_batch"] = D + f"""select id, topic_name, partition_id, kafka_offset, payload, error_type, error_message,
  retry_count, case when error_type = 'publish_error' then 'discarded' else status end as status, producer_id, created_at,
  case when error_type = 'publish_error' then {NOW} else updated_at end as updated_at, last_retry_at from dlq"""

    RV = with_(DLQ, RETRY_REQUESTS, validation_cte(
        "dlq", "payload", "topic_name",
        "case topic_name when 'click' then 'sch-click-v1' when 'error' then 'sch-error-v1' "
        "when 'purchase' then 'sch-purchase-v1' when 'view' then 'sch-view-v2' end"),
        f"""verd as (select id, topic_name, payload, status, retry_count, is_valid as pass,
    {_msg()} as err from validated)""",
        """att as (select r.pos, r.id, row_number() over (partition by r.id order by r.pos) as k from retry_requests r)""",
        """per_id as (select id, count(*) as attempts from retry_requests group by id)""",
        """chg as (select v.*, p.attempts,
    case when v.pass then 1 else least(p.attempts, greatest(1, 5 - v.retry_count)) end as n
    from verd v join per_id p on p.id = v.id where v.status = 'pending')""")
    q["dlq_retry_batch"] = RV + """select a.pos, a.id,
  coalesce(v.status = 'pending' and v.pass and a.k = 1, false) as success,
  case when v.id is null then 'event not found: fetching DLQ event ' || a.id || ': sql: no rows in result set'
       when not (v.status = 'pending' and (a.k = 1 or (not v.pass and v.retry_count + a.k - 1 < 5)))
         then 'cannot retry: event ' || a.id || ' is not in pending status — cannot retry'
       when v.pass then 'event replayed successfully'
       else 'replay failed: ' || v.err end as message
  from att a left join verd v on v.id = a.id"""
    # of two batches with the same requests, all that could run ran in the first
    q["dlq_retry_overlapping"] = RV + f"""select 'one' as batch, x.* from ({q["dlq_retry_batch"].removeprefix(RV)}) x
  union all select 'two', a.pos, a.id, false,
  case when v.id is null then 'event not found: fetching DLQ event ' || a.id || ': sql: no rows in result set'
       else 'cannot retry: event ' || a.id || ' is not in pending status — cannot retry' end
  from att a left join verd v on v.id = a.id"""
    q["dlq_retry_one"] = with_(DLQ, validation_cte(
        "dlq", "payload", "topic_name",
        "case topic_name when 'click' then 'sch-click-v1' when 'error' then 'sch-error-v1' "
        "when 'purchase' then 'sch-purchase-v1' when 'view' then 'sch-view-v2' end"),
        f"""verd as (select id, is_valid as pass, {_msg()} as err from validated)""") + f"""select d.id,
  case when d.status <> 'pending' then d.status when v.pass then 'retried'
       when d.retry_count + 1 >= 5 then 'discarded' else 'pending' end as status,
  cast(case when d.status = 'pending' then d.retry_count + 1 else d.retry_count end as integer) as retry_count,
  case when d.status = 'pending' and not v.pass then v.err else d.error_message end as error_message,
  case when d.status = 'pending' then {NOW} else d.last_retry_at end as last_retry_at,
  case when d.status = 'pending' then {NOW} else d.updated_at end as updated_at
  from dlq d join verd v on v.id = d.id"""
    # every event once retried, then the publish errors discarded
    q["dlq_stats_incremental"] = f"""with one as ({q["dlq_retry_one"]}),
  now_ as (select case when d.event_id % 29 = 0 then 'discarded' else one.status end as status
    from events d join one on one.id = 'dlq-' || cast(d.event_id as varchar))
select count(*) filter (where status = 'pending') as pending, count(*) filter (where status = 'retrying') as retrying,
  count(*) filter (where status = 'retried') as retried, count(*) filter (where status = 'discarded') as discarded,
  count(*) as total from now_"""
    q["dlq_replay_rows"] = RV + f"""select sha256(concat_ws('|', id, cast(attempt as varchar), 'replay')) as id, id as replay_of,
  attempt, topic_name, payload, 'schema_validation' as error_type, err as error_message,
  'pw-dlq-replay' as producer_id, {NOW} as created_at
  from (select *, unnest(range(1, n + 1)) as attempt from chg where not pass) x"""
    q["dlq_replay_messages"] = RV + """select id as replay_of, topic_name as topic,
  sha256(concat_ws('|', id, '0', 'message')) as key, payload as value, 'pw-dlq-replay' as h_producer_id,
  case topic_name when 'click' then 'sch-click-v1' when 'error' then 'sch-error-v1' when 'purchase' then 'sch-purchase-v1'
    when 'view' then 'sch-view-v2' else '' end as h_schema_id from chg where pass"""
    q["dlq_fold"] = with_(ACTIONS) + """select * from (
  with recursive o as (select id, action, row_number() over (partition by id order by seq) as k from dlq_actions),
  f as (select distinct id, cast(0 as bigint) as k, 'pending' as st, cast(0 as bigint) as n from dlq_actions
    union all
    select f.id, o.k,
      case when o.action = 'discard' then 'discarded' when f.st <> 'pending' then f.st
           when o.action = 'retry_ok' then 'retried' when f.n + 1 >= 5 then 'discarded' else 'pending' end,
      case when o.action = 'discard' or f.st <> 'pending' then f.n else f.n + 1 end
    from f join o on o.id = f.id and o.k = f.k + 1)
  select id, arg_max(st, k) as status, cast(arg_max(n, k) as bigint) as retry_count from f group by id) z"""
    q["metric_replay_success"] = with_(ACTIONS) + """select count(*) filter (where action in ('retry_ok', 'retry_fail')) as attempts,
  count(*) filter (where action = 'retry_ok') as successes,
  cast(count(*) filter (where action = 'retry_ok') as double) / cast(count(*) filter (where action in ('retry_ok', 'retry_fail')) as double) as success_rate
  from dlq_actions"""

    # topology and metrics
    G = with_(EVENT_LOG, TOPIC_PARTITIONS, COMMITTED, _NODES)
    q["topology_nodes"] = G + "select id, label, type from nodes"
    q["topology_edges"] = with_(EVENT_LOG, TOPIC_PARTITIONS, COMMITTED) + """select distinct producer_id as source, topic as target from event_log
  union all select distinct topic, 'cg-' || consumer_group from committed"""
    q["topology_event_rate"] = with_(EVENT_LOG) + f"""select producer_id as source, topic as target, count(*) as events,
  cast(count(*) as double) / 86400.0 as event_rate
  from event_log where ts >= {NOW} - INTERVAL 86400 SECOND and ts < {NOW} group by producer_id, topic"""
    q["topology_metadata"] = with_(
        EVENT_LOG, SCHEMAS, REQUESTS, REGISTERED, TOPIC_PARTITIONS, COMMITTED, LATEST, PLAG, _NODES,
        """tm as (select topic as id, cast(count(*) as varchar) as p from topic_partitions
    where topic in (select distinct topic_name from registered) group by topic)""",
        """gl as (select 'cg-' || consumer_group as id, cast(sum(lag) as varchar) as l from plag group by consumer_group)""") + """
select n.id, n.label, n.type, cast(to_json(case when tm.p is not null then map(['partitions'], [tm.p])
    when gl.l is not null then map(['total_lag'], [gl.l]) else map([]::varchar[], []::varchar[]) end) as varchar) as metadata_json
  from nodes n left join tm on tm.id = n.id left join gl on gl.id = n.id"""
    # streams: one trigger over the staged input, so the emitted windows are
    # exactly those the final watermark (max event time - delay) has passed
    q["stream_route"] = V + """select topic, count(*) as n, route from routed group by topic, route"""
    q["stream_route_committed"] = q["stream_route"]
    q["stream_alert_state"] = q["alert_state"]
    q["alert_topics"] = f"""select topic, bool_or(is_alert) as is_alert, count(*) filter (where is_alert) as alerting_groups
  from ({q['alert_state']}) s group by topic"""
    q["stream_event_rate"] = with_(EVENT_LOG) + """select date_trunc('minute', ts) as window_start, topic,
  count(*) as events, cast(count(*) as double) / 60.0 as rate
  from event_log group by date_trunc('minute', ts), topic"""
    # a poll each hour: of every listed partition the greatest offset and each group's newest commit before it
    q["stream_lag"] = with_(EVENT_LOG, TOPIC_PARTITIONS, """hours as (
    select date_trunc('hour', ts) + INTERVAL 1 HOUR as poll, topic, partition_id, max(kafka_offset) + 1 as nxt,
      arg_max(greatest(kafka_offset + 1 - 500 * partition_id + case when event_id % 10 = 0 then 1000 else 0 end, 0),
        struct_pack(a := ts, b := event_id)) filter (where partition_id <> 3) as analytics,
      arg_max(kafka_offset + 3, struct_pack(a := ts, b := event_id)) filter (where partition_id = 1) as billing
    from event_log group by all)""", """polls as (
    select unnest(generate_series(date_trunc('hour', min(ts)) + INTERVAL 1 HOUR, date_trunc('hour', max(ts)) + INTERVAL 1 HOUR,
      INTERVAL 1 HOUR)) as poll from event_log)""", """polled as (
    select p.poll, tp.topic, tp.partition_id, coalesce(max(h.nxt) over w, 0) as latest,
      coalesce(last_value(h.analytics ignore nulls) over w, 0) as analytics,
      coalesce(last_value(h.billing ignore nulls) over w, 0) as billing
    from polls p cross join topic_partitions tp
    left join hours h on h.poll = p.poll and h.topic = tp.topic and h.partition_id = tp.partition_id
    window w as (partition by tp.topic, tp.partition_id order by p.poll))""") + """select poll, topic, consumer_group,
  cast(sum(greatest(latest - committed, 0)) as bigint) as total_lag
  from (select poll, topic, 'analytics' as consumer_group, latest, analytics as committed from polled
    union all select poll, topic, 'billing', latest, billing from polled) u
  group by poll, topic, consumer_group"""
    q["stream_expiry"] = f"""with r as (select event_type as topic, 'user-' || cast(user_id as varchar) as consumer_group,
    cast(floor(epoch(ts)) as bigint) as ts_sec from events),
  g as (select *, case when ts_sec - lag(ts_sec) over w < 24 * 3600 then 0 else 1 end as fresh from r
    window w as (partition by topic, consumer_group order by ts_sec)),
  n as (select *, sum(fresh) over (partition by topic, consumer_group order by ts_sec) as run from g),
  s as (select topic, consumer_group, min(ts_sec) as first_write, max(ts_sec) as last_write from n group by topic, consumer_group, run)
select topic, consumer_group, first_write, last_write, make_timestamp((last_write + 24 * 3600) * 1000000) as expired_at
  from s where last_write + 24 * 3600 <= {NOW_SEC}"""
    q["stream_alert_transitions"] = q["alert_transitions"]
    q["stream_alert_topics"] = f"""select topic, cast(count(*) as bigint) as alerting_groups
  from ({q["alert_state"]}) a where is_alert group by topic"""
    q["topology_config_nodes"] = """with t as (select distinct event_type as topic from events)
select 'producer-' || topic as id, topic || '-producer' as label, 'producer' as type, 'producer' as type_text from t
union all select topic, topic, 'topic', 'topic' from t
union all select 'cg-analytics', 'analytics', 'consumer_group', 'consumer group'"""
    # what each topic's document says of lists, objects and amounts, restated
    q["jsonschema_keywords"] = """with k as (select event_id, event_type as topic, value as amount, event_id % 4 as n,
    event_id % 5 as a, event_id % 3 as b, event_id % 2 as c, event_id % 3 as kind,
    case event_id % 3 when 0 then 'USD' when 1 then 'EUR' else 'GBP' end as currency from events),
  l as (select *, list_slice([a, b, c], 1, n) as tags from k),
  v as (select event_id, topic, case topic
    when 'click' then n between 1 and 2 and len(list_filter(tags, lambda x: x < 1)) = 0
      and len(list_distinct(tags)) = n and list_contains(tags, 1)
    when 'view' then kind = 0 and event_id % 7 <> 0
    when 'purchase' then amount >= 0 and (amount <= 100) <> (amount >= 50)
      and case when currency = 'USD' then amount < 400 else amount >= 10 or currency = 'GBP' end
    when 'error' then amount >= 5 and len(list_filter(tags, lambda x: x > 3)) = 0
    when 'signup' then n <= 2 and (n < 2 or b >= 1)
    else true end as is_valid from l)
select event_id, topic, is_valid, case when is_valid then 'published' else 'dlq' end as route from v"""
    q["metric_event_rate"] = with_(EVENT_LOG) + """select date_trunc('minute', ts) as window_start, topic, count(*) as events,
  cast(count(*) as double) / 60.0 as rate from event_log group by date_trunc('minute', ts), topic"""
    return q


_NODES = """nodes as (
  select distinct * from (
    select distinct producer_id as id, producer_id as label, 'producer' as type from event_log
    union all select distinct topic, topic, 'topic' from (select topic from event_log union select topic from committed) t
    union all select distinct 'cg-' || consumer_group, consumer_group, 'consumer_group' from committed) u)"""


def extended_sql() -> str:
    """The EXTENDED fixture schema (tier-B keywords) restated in SQL."""
    canon_a = _canon("cast(json_extract_string(p, '$.amount') as double)")
    extra = "list_filter(ks, lambda k: k not in ('order_id', 'amount', 'currency'))"
    quoted = "list_transform(list_sort(" + extra + "), lambda k: chr(39) || k || chr(39))"
    checks = [
        f"case when ok and rt <> 'OBJECT' then '/: must be object (got ' || {_tn('rt')} || ')' end",
        f"case when t_o is not null and t_o <> 'VARCHAR' then '/order_id: must be string (got ' || {_tn('t_o')} || ')' end",
        "case when length(s_o) < 2 then '/order_id: length must be >= 2 (got ' || cast(length(s_o) as varchar) || ')' end",
        "case when length(s_o) > 3 then '/order_id: length must be <= 3 (got ' || cast(length(s_o) as varchar) || ')' end",
        "case when s_o is not null and not regexp_matches(s_o, '^[0-9]+$') "
        "then '/order_id: must match pattern \"^[0-9]+$\"' end",
        f"case when t_a is not null and t_a not in {NUM} then '/amount: must be number (got ' || {_tn('t_a')} || ')' end",
        f"case when d_a > 400 then '/amount: must be <= 400 (got ' || {canon_a} || ')' end",
        f"case when d_a <= 0 then '/amount: must be > 0 (got ' || {canon_a} || ')' end",
        f"case when m_a * 20 <> floor(m_a * 20) then '/amount: must be a multiple of 0.05 (got ' || {canon_a} || ')' end",
        f"case when t_c is not null and t_c <> 'VARCHAR' then '/currency: must be string (got ' || {_tn('t_c')} || ')' end",
        "case when s_c = 'GBP' then '/currency: must not match the schema in not' end",
        "case when obj and len(ks) < 3 then '/: must have at least 3 properties (got ' || cast(len(ks) as varchar) || ')' end",
        f"case when obj and len({extra}) > 0 then '/: additional properties not allowed: ' || array_to_string({quoted}, ', ') end",
        "case when obj and t_c is not null and t_a is null then '/: property ' || chr(39) || 'amount' || chr(39) "
        "|| ' is required by ' || chr(39) || 'currency' || chr(39) end",
    ]
    return with_(
        EVENT_LOG,
        "x0 as (select event_id, payload as p, json_valid(payload) as ok from event_log)",
        "x1 as (select *, case when ok then json_type(p) end as rt from x0)",
        """x2 as (select *, coalesce(rt = 'OBJECT', false) as obj,
    case when rt = 'OBJECT' then json_type(p, '$.order_id') end as t_o,
    case when rt = 'OBJECT' then json_type(p, '$.amount') end as t_a,
    case when rt = 'OBJECT' then json_type(p, '$.currency') end as t_c,
    case when rt = 'OBJECT' then json_keys(p) end as ks from x1)""",
        f"""x3 as (select *,
    case when t_o = 'VARCHAR' then json_extract_string(p, '$.order_id') end as s_o,
    case when t_a in {NUM} then cast(json_extract_string(p, '$.amount') as double) end as d_a,
    case when t_a in {NUM} then cast(json_extract_string(p, '$.amount') as decimal(38, 9)) end as m_a,
    case when t_c = 'VARCHAR' then json_extract_string(p, '$.currency') end as s_c from x2)""",
        "x4 as (select *, list_filter([\n    " + ",\n    ".join(checks) + "\n  ], lambda x: x is not null) as l from x3)",
    ) + """select event_id, ok as is_json, cast(case when ok then len(l) else 0 end as bigint) as n_errors,
  case when ok then array_to_string(l, '; ') end as error_message from x4"""
