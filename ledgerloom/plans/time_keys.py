"""Schedules, feeds, windows and liveness."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cron, hints
from ..functions.scalars import backoff_seconds
from ..operators.ledger_query import page
from ..sources.event_log import Snapshot, current_executions, shown
from ..sources.shared import dealt, new_folder
from ..streaming import feeds
from .registry import key

NOW, DAY = "2024-01-15 10:07:00", "2024-01-15"
AT = f"timestamp_ntz'{NOW}'"
#: What the schedules of v_def mean, said by filters on a series of times.
FIRES = f"""(
  select s.schedule, t.m as fires_at from (select distinct schedule, cast(regexp_extract(schedule, '/([0-9]+)', 1) as int) as step from v_def where schedule like '0 */%') s,
    (select unnest(generate_series(timestamp '{DAY} 00:00:00', timestamp '{DAY} 23:59:00', interval 1 minute)) as m) t where minute(t.m) % s.step = 0
  union all select '30 15,45 9-17/4 * * MON-FRI', m + interval 30 second from (select unnest(generate_series(timestamp '2024-01-12 00:00:00', timestamp '2024-01-17 00:00:00', interval 15 minute)) as m) t
    where minute(m) in (15, 45) and hour(m) in (9, 13, 17) and isodow(m) <= 5
  union all select '0 0 12 29 2 ?', m from (values (timestamp '2020-02-29 12:00:00'), (timestamp '2024-02-29 12:00:00')) t(m)
  union all select '10 5 0 1 * *', m from (values (timestamp '2024-01-01 00:05:10'), (timestamp '2024-02-01 00:05:10')) t(m))"""
SCHEDULED = "(select *, cast(id as bigint) as def_id, timestamp '2024-01-15 09:30:00' + to_minutes(cast(id as bigint) % 60) as last_fired from v_def where schedule <> '')"


def _schedules(v):
    """Definitions that have a schedule, with the schedule as columns and a watermark."""
    last = F.expr("timestamp_ntz'2024-01-15 09:30:00'") + F.make_dt_interval(mins=(F.col("id").cast("long") % 60).cast("int"))
    rows = v.definitions.where("schedule <> ''").withColumn("last_fired", last).withColumn("id", F.col("id").cast("long"))
    return dealt(rows).withColumn("cron", cron.parse(F.col("schedule")))


@key("cron_occurrences", f"select d.def_id as id, f.fires_at from {SCHEDULED} d join {FIRES} f on f.schedule = d.schedule where cast(f.fires_at as date) = date '{DAY}'")
def _(v):
    return _schedules(v).select("id", F.explode(cron.occurrences_on(F.col("cron"), F.lit(DAY).cast("date"))).alias("fires_at"))


def _next(v):
    return _schedules(v).select("id", cron.next_occurrence(F.col("cron"), F.expr(AT)).alias("fires_at"))


_NEXT = f"select d.def_id as id, min(f.fires_at) as fires_at from {SCHEDULED} d join {FIRES} f on f.schedule = d.schedule where f.fires_at > timestamp '{NOW}' group by d.def_id"
key("next_fire", _NEXT)(_next)


#: Schedules with wrapped ranges, marks and macros, each beside what it means, said of an hour ``t``.
MARKED = {
    "0 0 22-2 * * *": "hour(t) in (22, 23, 0, 1, 2)",
    "0 0 6 * * FRI-MON": "hour(t) = 6 and isodow(t) in (5, 6, 7, 1)",
    "0 0 12 L * ?": "hour(t) = 12 and cast(t as date) = last_day(t)",
    "0 0 12 15W * ?": "hour(t) = 12 and day(t) = case isodow(date_trunc('month', t) + interval 14 day) when 6 then 14 when 7 then 16 else 15 end",
    "0 0 9 * * MON#2": "hour(t) = 9 and isodow(t) = 1 and day(t) between 8 and 14",
    "0 0 9 ? * 5L": "hour(t) = 9 and isodow(t) = 5 and month(t + interval 7 day) <> month(t)",
    "@weekly": "hour(t) = 0 and isodow(t) = 7",
    "0 0 8 LW * ?": "hour(t) = 8 and day(t) = day(last_day(t)) - case isodow(last_day(t)) when 6 then 1 when 7 then 2 else 0 end",
    "0 0 0 L-3 DEC-FEB ?": "hour(t) = 0 and month(t) in (12, 1, 2) and day(t) = day(last_day(t)) - 3",
    "0 0 4 1W 6-8 ?": "hour(t) = 4 and month(t) in (6, 7, 8) and day(t) = case isodow(date_trunc('month', t)) when 6 then 3 when 7 then 2 else 1 end",
    "0 0 23-1/2 * * MON-SUN": "hour(t) in (23, 1)",
}
_MARKED = " union all ".join(f"select {i} as kind, t from (select unnest(generate_series(timestamp '2024-01-01 00:00:00', timestamp '2027-06-01 00:00:00', interval 1 hour)) as t) h where {rule}" for i, rule in enumerate(MARKED.values()))


@key("next_fire_marked", f"select c.id, min(f.t) as fires_at from (select cast(id as bigint) as id, cast(id as bigint) % {len(MARKED)} as kind, timestamp '2024-01-01 00:30:00' + to_hours(cast(id as bigint) % 500 * 37) as since from v_def) c join ({_MARKED}) f on f.kind = c.kind and f.t > c.since group by c.id")
def _(v):
    """The first time after some time of each definition, for schedules that wrap, count from the month's end or move to working days."""
    n = F.col("id").cast("long")
    expression = F.element_at(F.array(*map(F.lit, MARKED)), (n % len(MARKED)).cast("int") + 1)
    since = F.expr("timestamp_ntz'2024-01-01 00:30:00'") + F.make_dt_interval(hours=(n % 500 * 37).cast("int"))
    rows = dealt(v.definitions.select(n.alias("id"), expression.alias("schedule"), since.alias("since")))
    return rows.withColumn("cron", cron.parse(F.col("schedule"))).select("id", cron.next_occurrence(F.col("cron"), F.col("since")).alias("fires_at"))


@key("cron_errors", """select c_custkey as id, case when c_custkey % 17 = 0 then 'fields' when c_custkey % 70 > 59 then 'minute' when c_nationkey = 24 then 'hour' when c_custkey % 33 = 0 or c_custkey % 33 > 31 then 'day' else 'weekday' end as problem
from customer where c_custkey % 17 = 0 or c_custkey % 70 > 59 or c_nationkey = 24 or c_custkey % 33 = 0 or c_custkey % 33 > 31 or length(c_mktsegment) > 8""")
def _(v):
    """Expressions that are no schedules, and the first field that is wrong; they are made of the customers' numbers and names."""
    n, text = F.col("c_custkey"), lambda c: c.cast("string")
    weekday = F.when(F.length("c_mktsegment") > 8, F.col("c_mktsegment")).otherwise("?")
    whole = F.concat_ws(" ", F.lit("0"), text(n % 70), text(F.col("c_nationkey")), text(n % 33), F.lit("*"), weekday)
    expression = F.when(n % 17 == 0, text(n)).otherwise(whole)
    rows = dealt(v.table("customer").select(n.alias("id"), expression.alias("expression")))
    behind = F.when(F.spark_partition_id() >= 0, F.col("problem"))  # keeps the filter from being moved before the rows are dealt out
    return rows.select("id", cron.problem(F.col("expression")).alias("problem")).where(behind.isNotNull())


@key("next_due", f"select id, fires_at from ({_NEXT}) t order by fires_at, id limit 1")
def _(v):
    return page(_next(v), [F.col("fires_at"), F.col("id")], 0, 1)


@key("catchup_decision", f"""select def_id as id, missed, case when catch_up_minutes is not null and missed + to_minutes(catch_up_minutes) >= timestamp '{NOW}' then missed end as replay
from (select d.def_id, d.catch_up_minutes, max(f.fires_at) as missed from {SCHEDULED} d left join {FIRES} f on f.schedule = d.schedule and f.fires_at > d.last_fired and f.fires_at <= timestamp '{NOW}' group by d.def_id, d.catch_up_minutes) t""")
def _(v):
    window = F.make_dt_interval(mins="catch_up_minutes")
    return _schedules(v).select(
        "id", cron.last_occurrence(F.col("cron"), F.col("last_fired"), F.expr(AT)).alias("missed"), cron.catch_up(F.col("cron"), F.col("last_fired"), F.expr(AT), window).alias("replay")
    )


@key("schedule_resume", f"""select def_id as id, case when source = 'Code' then 'immutable' when schedule_enabled then 'active' else 'resumed' end as outcome,
  case when source <> 'Code' and not schedule_enabled and catch_up_minutes is not null then greatest(last_fired, timestamp '{NOW}') else last_fired end as watermark from {SCHEDULED} d""")
def _(v):
    """A resumed schedule that catches up has its watermark moved to now, never back, so that the pause is not replayed."""
    resumed = (F.col("source") != "Code") & ~F.col("schedule_enabled")
    outcome = F.when(F.col("source") == "Code", "immutable").when(F.col("schedule_enabled"), "active").otherwise("resumed")
    moved = F.when(resumed & F.col("catch_up_minutes").isNotNull(), F.greatest(F.col("last_fired"), F.expr(AT))).otherwise(F.col("last_fired"))
    return _schedules(v).select("id", outcome.alias("outcome"), moved.alias("watermark"))


@key("schedule_watermark", "select user_id, max(ts) as last_fired from events where event_type <> 'view' group by user_id")
def _(v):
    return v.events.where("event_type <> 'view'").groupBy("user_id").agg(F.max("ts").alias("last_fired"))


@key("layout_hints", """select id, step, cast(x as double) as x, cast(y as double) as y from (
  select id, 'a' as step, cast(id as bigint) % 50 + 0.5 as x, cast(id as bigint) % 7 as y from v_def union all select id, 'b', case when cast(id as bigint) % 3 = 0 then 9 else 1 end, 2 from v_def
  union all select id, 'c', 4, 5 from v_def where cast(id as bigint) % 3 = 0) t""")
def _(v):
    """Stored hints under those that are set now; text, missing numbers, infinite ones and names that are too long are no hints."""
    n = F.col("id").cast("long")
    stored = F.format_string('{"other": 1, "dashboard.layoutHints": {"a": {"x": %d.5, "y": %d}, "b": {"x": 1, "y": 2}, "d": {"x": "7", "y": 1}, "e": {"y": 3}, "f": {"x": 1e999, "y": 3}, "%s": {"x": 1, "y": 1}}}', n % 50, n % 7, F.repeat(F.lit("n"), 129))
    now = F.when(n % 3 == 0, F.lit('{"dashboard.layoutHints": {"b": {"x": 9, "y": 2}, "c": {"x": 4, "y": 5}}}')).otherwise(F.lit("[]"))
    places = v.definitions.select("id", F.explode(hints.merged(hints.parse(stored), hints.parse(now))).alias("step", "place"))
    return places.select("id", "step", "place.x", "place.y")


@key("retry_schedule", "select event_id, least(power(2.0, cast(event_id % 10 as int)), 60.0) as delay_s from v_param")
def _(v):
    return v.params.select("event_id", backoff_seconds((F.col("event_id") % 10 + 1).cast("int")).alias("delay_s"))


@key("worker_liveness", """select worker_name, status, last_seen, status = 'Online' and last_seen + interval '2' hour >= timestamp '2024-01-30 23:00:00' as online
from (select cast(user_id as string) as worker_name, arg_max(case event_type when 'error' then 'Draining' else 'Online' end, ts) as status, max(ts) as last_seen from events where ts <= timestamp '2024-01-30 23:00:00' group by user_id) t
where last_seen + interval '1' day >= timestamp '2024-01-30 23:00:00' order by last_seen desc, worker_name limit 1000""")
def _(v):
    now = F.expr("timestamp_ntz'2024-01-30 23:00:00'")
    beats = v.events.where(F.col("ts") <= now).select(F.col("user_id").cast("string").alias("worker_name"), F.when(F.col("event_type") == "error", "Draining").otherwise("Online").alias("status"), F.col("ts").alias("at"))
    return feeds.liveness(beats, now, "2 hours", "1 day")


@key("workers_list", "select worker_name, min(job_name) as first_job from v_exec group by worker_name order by worker_name")
def _(v):
    return v.executions.groupBy("worker_name").agg(F.min("job_name").alias("first_job")).orderBy("worker_name")


@key("workers_cap", "select worker_name, last_seen from (select worker_name, max(enqueued_at) as last_seen from v_exec group by worker_name) t order by last_seen desc, worker_name limit 30")
def _(v):
    return page(v.executions.groupBy("worker_name").agg(F.max("enqueued_at").alias("last_seen")), [F.col("last_seen").desc(), F.col("worker_name")], 0, 30)


@key("progress_debounce", "select user_id, date_trunc('hour', ts) as slot, arg_max(value, ts) as value, max(ts) as at from events group by user_id, date_trunc('hour', ts)")
def _(v):
    return feeds.debounced(v.events.select("user_id", "ts", "value"), "user_id", "ts", slot="1 hour")


@key("session_debounce", "select user_id, started_at, max(ts) + interval '2' hour as due_at, count(*) as n from (select user_id, ts, max(case when gap is null or gap >= 7200000000 then ts end) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as started_at from (select user_id, event_id, ts, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events) a) b group by user_id, started_at")
def _(v):
    return feeds.quiet_bursts(v.events.select("user_id", "ts"), "user_id", "ts", "2 hours")


_STATE = "case event_type when 'view' then 'Pending' when 'click' then 'Running' when 'purchase' then 'Completed' when 'error' then 'Failed' else 'Cancelling' end"


_FOLD = f"""select cast(user_id as string) as execution_id, arg_max({_STATE}, ts) as status, min(ts) as enqueued_at, min(case when event_type = 'click' then ts end) as started_at,
  max(case when event_type in ('purchase', 'error') then ts end) as completed_at, arg_max(case when event_type = 'error' then props end, ts) filter (where event_type = 'error') as last_error, count(case when event_type = 'click' then 1 end) as attempts from events group by user_id"""


def _log(v):
    """The events in the shape of the event log."""
    text = lambda c: F.lit(None).cast("string").alias(c)
    return v.events.select(
        F.format_string("%020d", "event_id").alias("event_id"), F.col("user_id").cast("string").alias("execution_id"), text("job_name"), text("batch_id"), text("batch_step_id"),
        F.expr(_STATE).alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.lit(None).cast("map<string,string>").alias("outputs"), F.col("ts").alias("at"), F.to_date("ts").alias("day"),
    )


_SHOWN = ["execution_id", "status", "enqueued_at", "started_at", "completed_at", "last_error", "attempts"]


@key("fold_event_log", _FOLD)
def _(v):
    """The fold of the event log, over events of that shape."""
    return current_executions(_log(v)).select(*_SHOWN)


@key("snapshot_fold", _FOLD)
def _(v):
    """The same from a snapshot of two thirds of the days, advanced once, and the events since."""
    log, kept = _log(v), Snapshot(v.spark, new_folder(v.spark, "snapshot"), f"snapshot_{uuid.uuid4().hex}", buckets=8)
    kept.advance(log, None, "2024-01-10")
    kept.advance(log, "2024-01-10", "2024-01-20")
    return shown(kept.state(log, "2024-01-20")).select(*_SHOWN)


@key("dedupe_completion", "select user_id, min(ts) as first_ts from events where event_type = 'purchase' group by user_id")
def _(v):
    return v.events.where("event_type = 'purchase'").groupBy("user_id").agg(F.min("ts").alias("first_ts"))


@key("dedupe_message_id", "select message_id, min(event_id) as processed_as, count(*) - 1 as replays from (select event_id, event_id // 3 as message_id from events) t group by message_id")
def _(v):
    messages = v.events.select("event_id", F.expr("event_id div 3").alias("message_id"))
    return messages.groupBy("message_id").agg(F.min("event_id").alias("processed_as"), (F.count(F.lit(1)) - 1).alias("replays"))


@key("dedupe_result_replay", "select event_id, event_id // 3 as message_id, event_id % 3 <> 0 as replayed, first_value(value) over (partition by event_id // 3 order by event_id) as result from events")
def _(v):
    """A message that comes again is answered with the first one's result; a message's few deliveries are one window."""
    messages = v.events.select("event_id", F.expr("event_id div 3").alias("message_id"), "value")
    first = Window.partitionBy("message_id").orderBy("event_id")
    return messages.select("event_id", "message_id", (F.row_number().over(first) > 1).alias("replayed"), F.first("value").over(first).alias("result"))


@key("first_terminal_event", "select user_id, event_type, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) n from events where event_type in ('purchase', 'signup')) t where n = 1")
def _(v):
    first = v.events.where("event_type in ('purchase', 'signup')").groupBy("user_id").agg(F.min(F.struct("ts", "event_id", "event_type")).alias("x"))
    return first.select("user_id", "x.event_type", "x.event_id")


@key("backpressure_ratio", "select worker_name, cast(sum(total_items - processed) as bigint) as waiting, case when sum(total_items - processed) * 2 >= sum(total_items) then 'Degraded' else 'Healthy' end as health from v_exec group by worker_name")
def _(v):
    rows = v.executions.groupBy("worker_name").agg(F.sum(F.col("total_items") - F.col("processed")).alias("waiting"), F.sum("total_items").alias("capacity"))
    return rows.select("worker_name", "waiting", F.when(F.col("waiting") * 2 >= F.col("capacity"), "Degraded").otherwise("Healthy").alias("health"))


@key("version_conflicts", "select user_id, event_id, coalesce(seen, 0) + 1 <> n as conflict from (select user_id, event_id, row_number() over (partition by user_id order by event_id) n, case when event_id % 11 = 0 then 0 else row_number() over (partition by user_id order by event_id) - 1 end as seen from events) t")
def _(v):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    seen = F.when(F.col("event_id") % 11 == 0, 0).otherwise(n - 1)
    return v.events.select("user_id", "event_id", (seen + 1 != n).alias("conflict"))
