"""Rules that depend on order, over the ledger and its events; SQL walks the rows or compares them in pairs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import backoff_seconds
from ..operators import ordered, progression
from ..sources.shared import checkpointed
from .registry import key

_FINAL = "('Completed', 'Failed', 'Cancelled', 'Skipped')"
_GROUPS = f"""c as (select e.batch_id, e.execution_id, e.job_name, e.processed, e.step_order, e.status, e.completed_at, s.join_policy as p, e.completed_at is not null and e.status in {_FINAL} as ended from v_exec e join v_step s on s.ord = e.batch_id where s.step_type = 'ParallelGroup'),
n as (select batch_id, p, count(*) as n from c group by batch_id, p),
pre as (select a.batch_id, a.execution_id, a.completed_at, count(*) as i, count(case when b.status = 'Completed' then 1 end) as done, count(case when b.status <> 'Completed' then 1 end) as bad, bool_or(b.status in ('Failed', 'Cancelled')) as failed
  from c a join c b on a.batch_id = b.batch_id and a.ended and b.ended and (b.completed_at < a.completed_at or (b.completed_at = a.completed_at and b.execution_id <= a.execution_id)) group by a.batch_id, a.execution_id, a.completed_at),
verdict as (select pre.*, case p when 1 then case when done >= 1 then 'succeeded' when i = n then 'failed' end when 2 then case when done >= n // 2 + 1 then 'succeeded' when bad > n - (n // 2 + 1) then 'failed' end
  else case when i = n then case when failed then 'failed' else 'succeeded' end end end as verdict from pre join n using (batch_id)),
decided as (select * from (select *, row_number() over (partition by batch_id order by i) as first from verdict where verdict is not null) t where first = 1),
joined as (select c.*, coalesce(d.verdict, 'open') as outcome, d.completed_at as decided_at, case when not c.ended and d.i is null then 'open' when d.i is not null and (not c.ended or pre.i > d.i) then 'cancelled' when c.status = 'Completed' then 'won' else 'lost' end as part
  from c left join decided d on d.batch_id = c.batch_id left join pre on pre.batch_id = c.batch_id and pre.execution_id = c.execution_id)"""


def _groups(v):
    """Executions as the children of the parallel groups of the step tables."""
    groups = v.steps.where("step_type = 'ParallelGroup'").select(F.col("ord").alias("batch_id"), "join_policy")
    rows = v.executions.select("batch_id", "execution_id", "job_name", "processed", "step_order", "status", "completed_at")
    return progression.joined_in_order(rows.join(groups, "batch_id"))


key("group_joins", f"with {_GROUPS} select batch_id, execution_id, part, outcome, decided_at from joined")(lambda v: _groups(v).select("batch_id", "execution_id", "part", "outcome", "decided_at"))


@key("group_outputs", f"with {_GROUPS} select batch_id, output_key, output from (select batch_id, job_name as output_key, processed as output, row_number() over (partition by batch_id, job_name order by step_order desc, execution_id desc) as r from joined where part = 'won' and outcome = 'succeeded') t where r = 1")
def _(v):
    """Outputs of the winners of groups that succeeded, folded in the children's order."""
    won = _groups(v).where("part = 'won' and outcome = 'succeeded'").groupBy("batch_id", F.col("job_name").alias("output_key"))
    return won.agg(F.max_by("processed", F.struct("step_order", "execution_id")).alias("output"))


#: Three failures in two days and no success open a breaker for a day; the times fit the events.
TRIPS, SAMPLING, PAUSE = 3, "48 hours", "24 hours"


@key("breaker_state", f"""with recursive c as (select user_id, event_id, ts, event_type in ('error', 'click', 'signup') as failed, row_number() over (partition by user_id order by ts, event_id) as n from events),
s as (select user_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, 'closed' as mode, cast(null as timestamp) as until, cast([] as struct(called timestamp, failed boolean)[]) as seen, '' as state, false as tripped from (select distinct user_id from c) u
  union all select user_id, n, event_id, case when trips then 'open' when found = 'open' then 'open' else 'closed' end, case when trips then ts + interval '{PAUSE}' else until end, case when trips or found = 'half_open' then [] when found = 'open' then seen else now end, found, trips
  from (select *, case found when 'open' then false when 'half_open' then failed else failed and len(now) >= {TRIPS} and len(list_filter(now, lambda x: not x.failed)) = 0 end as trips
    from (select s.user_id, c.n, c.event_id, c.ts, c.failed, s.until, s.seen, case when s.mode = 'open' and c.ts < s.until then 'open' when s.mode = 'open' then 'half_open' else 'closed' end as found,
      list_append(list_filter(s.seen, lambda x: x.called > c.ts - interval '{SAMPLING}'), {{'called': c.ts, 'failed': c.failed}}) as now from s join c on c.user_id = s.user_id and c.n = s.n + 1) a) b)
select user_id, event_id, state, tripped from s where n > 0""")
def _(v):
    calls = v.events.select("user_id", "event_id", "ts", F.col("event_type").isin("error", "click", "signup").alias("failed"))
    found = ordered.breaker(calls, ["user_id"], "ts", "event_id", TRIPS, timedelta(hours=48), timedelta(hours=24))
    return found.select("user_id", "event_id", "state", "tripped")


_GIVEN = """u as (select batch_id, step_order, execution_id, job_name as k, processed as v from v_exec where status = 'Completed' union all select batch_id, -1, '', 'Job.0', succeeded from v_run where current_step_index is not null)"""


def _forwarded(v):
    """Outputs of completed executions over the state that was persisted for runs that have a cursor."""
    done = v.executions.where("status = 'Completed'").select("batch_id", "step_order", F.col("execution_id").alias("ordinal"), F.create_map("job_name", "processed").alias("outputs"))
    kept = v.runs.where("current_step_index is not null").select("batch_id", F.create_map(F.lit("Job.0"), "succeeded").alias("outputs"))
    return progression.forwarded(done, kept)


key("forwarded_outputs", f"""with {_GIVEN}, l as (select batch_id, step_order, k, v, row_number() over (partition by batch_id, step_order, k order by execution_id desc) as r from u)
select a.batch_id, a.k as key, a.v as value, case when a.step_order >= 0 then a.step_order + 1 end as from_step, (select min(b.step_order) + 1 from u b where b.batch_id = a.batch_id and b.k = a.k and b.step_order > a.step_order) as until_step from l a where r = 1""")(_forwarded)


@key("forwarded_params", f"""with {_GIVEN}, s as (select distinct batch_id, step_order from v_exec),
p as (select s.batch_id, s.step_order, u.k, u.v, row_number() over (partition by s.batch_id, s.step_order, u.k order by u.step_order desc, u.execution_id desc) as r from s join u on u.batch_id = s.batch_id and u.step_order < s.step_order)
select s.batch_id, s.step_order, coalesce(string_agg(k||'='||cast(v as varchar), ',' order by k), '') as params from s left join p on p.batch_id = s.batch_id and p.step_order = s.step_order and r = 1 group by s.batch_id, s.step_order""")
def _(v):
    maps = progression.parameters_of_steps(v.executions, _forwarded(v))
    said = F.transform(F.map_entries("params"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("batch_id", "step_order", F.array_join(said, ",").alias("params"))


@key("compare_and_append", """with recursive a as (select user_id, event_id, ts, ts - to_minutes(cast(floor(value) * 30 as bigint)) as read_at, row_number() over (partition by user_id order by ts, event_id) as n from events),
s as (select user_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, cast([] as timestamp[]) as times, cast(0 as bigint) as store_version, cast(0 as bigint) as caller_version from (select distinct user_id from a) u
  union all select s.user_id, a.n, a.event_id, case when len(list_filter(s.times, lambda x: x > a.read_at)) = 0 then list_append(s.times, a.ts) else s.times end, len(s.times) + 1, len(list_filter(s.times, lambda x: x <= a.read_at)) + 1 from s join a on a.user_id = s.user_id and a.n = s.n + 1)
select user_id, event_id, store_version, caller_version, store_version = caller_version as accepted from s where n > 0""")
def _(v):
    """Whoever attempts a change has read the record some time before; the events' values say how long."""
    rows = v.events.select("user_id", "event_id", "ts", (F.col("ts") - F.make_dt_interval(mins=(F.floor("value") * 30).cast("int"))).alias("read_at"))
    return ordered.compare_and_append(rows, ["user_id"], "ts", "read_at", "event_id").select("user_id", "event_id", "store_version", "caller_version", "accepted")


@key("retry_chains", """with recursive c as (select batch_id, batch_id as root, cast(0 as bigint) as depth, started_at from v_run r where retry_of_batch_id is null or not exists (select 1 from v_run o where o.batch_id = r.retry_of_batch_id)
  union all select r.batch_id, c.root, c.depth + 1, r.started_at from v_run r join c on r.retry_of_batch_id = c.batch_id)
select batch_id, root, depth, first_value(batch_id) over (partition by root order by started_at desc, batch_id desc) as latest from c""")
def _(v):
    return progression.chains(v.runs.select("batch_id", "retry_of_batch_id", "started_at"), "batch_id", "retry_of_batch_id", [F.col("started_at")], checkpointed)


@key("redeliveries", f"""with recursive d as (select user_id, event_id, event_type = 'purchase' as ok, row_number() over (partition by user_id order by ts, event_id) as n from events),
s as (select user_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, cast(0 as bigint) as life, 0 as delivery, 'acknowledged' as outcome from (select distinct user_id from d) u
  union all select s.user_id, d.n, d.event_id, case when s.outcome = 'redelivered' then s.life else s.life + 1 end, case when s.outcome = 'redelivered' then s.delivery + 1 else 1 end,
    case when d.ok then 'acknowledged' when s.outcome = 'redelivered' and s.delivery + 1 = {progression.DELIVERY_LIMIT} then 'dead' else 'redelivered' end from s join d on d.user_id = s.user_id and d.n = s.n + 1)
select user_id, event_id, life, delivery, outcome from s where n > 0""")
def _(v):
    return progression.deliveries(v.events.select("user_id", "event_id", "event_type", "ts"), "user_id", ["ts", "event_id"], F.col("event_type") == "purchase").select("user_id", "event_id", "life", "delivery", "outcome")


@key("await_outcomes", """with e as (select *, cast(user_id as varchar)||'@'||cast(cast(ts as date) as varchar) as execution_id from events),
f as (select execution_id, min(ts) as at, arg_min(event_type, ts) as event_type from e where event_type in ('purchase', 'error') group by execution_id)
select w.event_id, case when f.at <= w.ts then 'caught_up' when f.at <= w.ts + interval '6' hour then 'ended' else 'timed_out' end as outcome,
  case when f.at <= w.ts + interval '6' hour then case f.event_type when 'purchase' then 'Completed' else 'Failed' end end as status, case when f.at <= w.ts then w.ts when f.at <= w.ts + interval '6' hour then f.at else w.ts + interval '6' hour end as resolved_at
from e w left join f on f.execution_id = w.execution_id where w.event_type = 'view'""")
def _(v):
    """A user's day is an execution; each view waits six hours for its end."""
    rows = v.events.withColumn("execution_id", F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    ends = rows.where("event_type in ('purchase', 'error')").select("execution_id", F.when(F.col("event_type") == "purchase", "Completed").otherwise("Failed").alias("status"), F.col("ts").alias("at"))
    waits = rows.where("event_type = 'view'").select("event_id", "execution_id", F.col("ts").alias("asked_at"), (F.col("ts") + F.expr("interval '6' hour")).alias("due_at"))
    return progression.awaited(waits, ends).select("event_id", "outcome", "status", "resolved_at")


@key("failure_routes", """with o as (select batch_id, case when bool_or(status = 'Cancelled') then 'Cancelled' when bool_or(status = 'Failed') then 'Failed' else 'Completed' end as outcome from v_exec where step_order = 1 group by batch_id),
s as (select v.definition_id, v.step_id, coalesce(o.outcome, 'Completed') as outcome, v.comp_job is not null as has_undo, h.failure_policy as policy, row_number() over (partition by v.definition_id order by v.ord) as position from v_step v join v_head h using (definition_id) left join o on o.batch_id = v.ord where v.part = 'main'),
f as (select definition_id, step_id, row_number() over (partition by definition_id order by ord) as position from v_step where part = 'failure'),
e as (select definition_id, min(position) as stop from s where outcome = 'Cancelled' or (outcome = 'Failed' and policy <> 1) group by definition_id),
b as (select e.definition_id, e.stop from e join s on s.definition_id = e.definition_id and s.position = e.stop and s.outcome = 'Failed' and s.policy = 2
  where exists (select 1 from s u where u.definition_id = e.definition_id and u.position < e.stop and u.has_undo) or exists (select 1 from f where f.definition_id = e.definition_id))
select s.definition_id, 'main' as phase, position, step_id, case when position > e.stop then 'not reached' when outcome = 'Failed' then 'failed' when outcome = 'Cancelled' then 'cancelled' else 'ran' end as action from s left join e on e.definition_id = s.definition_id
union all select s.definition_id, 'undo', row_number() over (partition by s.definition_id order by position desc), step_id||':comp', 'undone' from s join b on b.definition_id = s.definition_id and s.position < b.stop where has_undo
union all select f.definition_id, 'failure', position, step_id, 'ran' from f join b on b.definition_id = f.definition_id""")
def _(v):
    """Definitions run once: a step's outcome is that of its order's first lines, the policy that of the definition."""
    status = lambda name: F.bool_or(F.col("status") == name)
    outcome = v.executions.where("step_order = 1").groupBy(F.col("batch_id").alias("ord")).agg(F.when(status("Cancelled"), "Cancelled").when(status("Failed"), "Failed").otherwise("Completed").alias("outcome"))
    numbered = lambda part: v.steps.where(F.col("part") == part).withColumn("position", F.row_number().over(Window.partitionBy("definition_id").orderBy("ord")))
    main = numbered("main").join(outcome, "ord", "left").join(v.heads.select("definition_id", F.col("failure_policy").alias("policy")), "definition_id")
    main = main.select("definition_id", "position", "step_id", F.coalesce("outcome", F.lit("Completed")).alias("outcome"), F.col("comp_job").isNotNull().alias("has_undo"), "policy")
    return progression.failure_route(main, numbered("failure").select("definition_id", "position", "step_id"), "definition_id")


@key("gate_decisions", """with recursive e as (select *, cast(user_id as varchar)||'@'||cast(cast(ts as date) as varchar) as gate from events where event_type <> 'click'),
o as (select gate, event_id, event_type, row_number() over (partition by gate order by ts, event_id) as n from e),
s as (select gate, cast(0 as bigint) as n, cast(null as bigint) as event_id, 'none' as state, cast(null as varchar) as outcome, cast(null as varchar) as result, cast(null as varchar) as existing from (select distinct gate from o) g
  union all select s.gate, o.n, o.event_id, case when o.event_type = 'view' then 'pending' when s.state = 'pending' then 'decided' else s.state end, case when o.event_type = 'view' then null when s.state = 'pending' then o.event_type else s.outcome end,
    case when o.event_type = 'view' then null when s.state = 'none' then 'not_found' when s.state = 'pending' then 'recorded' else 'already_decided' end, case when o.event_type <> 'view' and s.state = 'decided' then s.outcome end from s join o on o.gate = s.gate and o.n = s.n + 1)
select event_id, result, existing from s where result is not null""")
def _(v):
    """A user's day is a gate that views save; purchases, errors and signups decide on it."""
    rows = v.events.where("event_type <> 'click'").withColumn("gate", F.concat_ws("@", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    log = rows.select("gate", "ts", "event_id", (F.col("event_type") == "view").alias("saved"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("outcome"))
    return progression.recorded(log, "gate", ["ts", "event_id"]).select("event_id", "result", "existing")


@key("resume_steps", """with r as (select batch_id, current_step_index as cursor from v_run where status is null),
g as (select batch_id, step_id + 1 as batch_step_id, max(case on_timeout when 'AutoApprove' then 'Approved' when 'Fail' then 'TimedOut' end) as outcome, count(*) as n from v_gate group by batch_id, step_id),
s as (select batch_id, batch_step_id, min(step_order) as o, count(case when status = 'Completed' then 1 end) as done, count(case when status = 'Skipped' then 1 end) as skipped from v_exec where batch_step_id is not null group by batch_id, batch_step_id)
select s.batch_id, s.batch_step_id, case when o <= coalesce(cursor, 0) then 'behind' when done > 0 then 'reuse' when skipped > 0 then 'skip' when outcome is not null then 'follow '||outcome when n > 0 then 'await' else 'dispatch' end as action
from s join r on r.batch_id = s.batch_id left join g on g.batch_id = s.batch_id and g.batch_step_id = s.batch_step_id""")
def _(v):
    """Steps of the runs in flight; gates of the first four steps hold, or were decided when they ran out of time."""
    outcome = F.when(F.col("on_timeout") == "AutoApprove", "Approved").when(F.col("on_timeout") == "Fail", "TimedOut")
    gates = v.gates.select("batch_id", (F.col("step_id") + 1).cast("int").alias("batch_step_id"), outcome.alias("outcome"), F.col("deadline").alias("decided_at"), "approval_id")
    return progression.resumed_steps(v.runs.where("status is null").select("batch_id", F.col("current_step_index").alias("cursor")), v.executions, gates)


@key("resume_policies", """select batch_id, policy, least(greatest(case policy when 'Forward' then coalesce(current_step_index, 0) when 'RestartAll' then 0 else succeeded end, 0), top_steps) as start_index
from (select r.batch_id, r.current_step_index, r.succeeded, d.top_steps from v_run r join v_def d on cast(r.batch_definition_id as string) = d.id) t, (values ('Forward'), ('RestartAll'), ('RestartFrom')) p(policy)""")
def _(v):
    """Where a run begins again under each policy: at its cursor, at the first step, or at a step that is named (here the number that succeeded)."""
    steps = v.definitions.select(F.col("id").cast("long").alias("batch_definition_id"), "top_steps")
    asked = F.array(*[F.struct(F.lit(name).alias("policy"), k.cast("int").alias("k")) for name, k in (("Forward", F.lit(None)), ("RestartAll", F.lit(None)), ("RestartFrom", F.col("succeeded")))])
    rows = v.runs.join(steps, "batch_definition_id").select("batch_id", "current_step_index", "top_steps", F.explode(asked).alias("p"))
    return rows.select("batch_id", "p.policy", progression.start_index(F.col("p.policy"), F.col("p.k"), F.col("current_step_index"), F.col("top_steps")).alias("start_index"))


SET_CAPACITY = 40


@key("dedupe_recent_set", f"""with e as (select event_type, event_id, user_id, row_number() over (partition by event_type order by ts, event_id) as i from events),
p as (select *, lag(i) over (partition by event_type, user_id order by i) as before from e)
select p.event_type, p.event_id, p.before is null or (select count(distinct o.user_id) from e o where o.event_type = p.event_type and o.i > p.before and o.i < p.i) >= {SET_CAPACITY} as is_new from p""")
def _(v):
    """An id is new again when 40 others were used since: its reuse distance."""
    rows = v.events.select("event_type", "event_id", "user_id", "ts")
    return ordered.recently_seen(rows, ["event_type"], "user_id", ["ts", "event_id"], F.to_date("ts"), SET_CAPACITY).select("event_type", "event_id", "is_new")


@key("refused_inserts", """select event_id, first_value(event_id) over (partition by user_id, event_type, cast(ts as date) order by ts, event_id) as holder from events
qualify row_number() over (partition by user_id, event_type, cast(ts as date) order by ts, event_id) > 1""")
def _(v):
    """A user's day and type is an id: the first row that brings it is stored, each later one is refused."""
    ids = ["user_id", "event_type", "day"]
    rows = v.events.select("event_id", "ts", "user_id", "event_type", F.to_date("ts").alias("day"))
    first = rows.groupBy(*ids).agg(F.min(F.struct("ts", "event_id")).alias("x"))
    return rows.join(first.select(*ids, F.col("x.event_id").alias("holder")), ids).where("event_id <> holder").select("event_id", "holder")


@key("watermark_updates", """with p as (select user_id, event_id, ts - to_minutes(cast(floor(value) * 30 as bigint)) as fired_at from events)
select p.user_id, p.event_id, not exists (select 1 from p o where o.user_id = p.user_id and o.event_id < p.event_id and o.fired_at >= p.fired_at) as advanced,
  (select max(o.fired_at) from p o where o.user_id = p.user_id and o.event_id <= p.event_id) as watermark from p""")
def _(v):
    """Times at which a schedule fired, as they are reported: only a later one than is stored moves the watermark, which never goes back."""
    rows = v.events.select("user_id", "event_id", (F.col("ts") - F.make_dt_interval(mins=(F.floor("value") * 30).cast("int"))).alias("fired_at"))
    along = Window.partitionBy("user_id").orderBy("event_id")
    before = F.max("fired_at").over(along.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("user_id", "event_id", F.coalesce(F.col("fired_at") > before, F.lit(True)).alias("advanced"), F.greatest(before, "fired_at").alias("watermark"))


@key("parameter_changes", """with s as (select user_id, event_id, cast(json_extract_string(props, '$.k') as int) as k, event_type from events),
b as (select *, lag(k) over w as k0, lag(event_type) over w as t0, row_number() over w as n from s window w as (partition by user_id order by event_id))
select event_id, n = 1 or k is distinct from k0 or event_type is distinct from t0 as changed from b""")
def _(v):
    """Whether what an event sets differs from the one before, by the text of JSON objects whose keys are in order, whatever their order was."""
    own = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("type"), F.col("event_type")))
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(own))))
    before = F.lag("text").over(Window.partitionBy("user_id").orderBy("event_id"))
    return v.events.select("user_id", "event_id", text.alias("text")).select("event_id", (~F.col("text").eqNullSafe(before)).alias("changed"))


#: A failed execution is tried again so often.
MOST_RETRIES = 3


@key("retry_timeline", f"""with recursive d as (select user_id, event_id, ts, event_type = 'purchase' as ok, row_number() over (partition by user_id order by ts, event_id) as n from events where event_type in ('purchase', 'error')),
s as (select user_id, cast(0 as bigint) as n, cast(null as bigint) as event_id, 0 as attempt, 'Completed' as status, cast(null as timestamp) as next_at from (select distinct user_id from d) u
  union all select user_id, n, event_id, attempt, status, case when status = 'Retrying' then ts + to_seconds(least(power(2, attempt - 1), 60)) end
  from (select *, case when ok then 'Completed' when attempt > {MOST_RETRIES} then 'Failed' else 'Retrying' end as status
    from (select s.user_id, d.n, d.event_id, d.ts, d.ok, case when s.status = 'Retrying' then s.attempt + 1 else 1 end as attempt from s join d on d.user_id = s.user_id and d.n = s.n + 1) a) b)
select event_id, attempt, status, next_at from s where n > 0""")
def _(v):
    """A user's errors are failed attempts at one job and a purchase its success; after three retries the job has failed, and what comes next is another."""
    rows = v.events.where("event_type in ('purchase', 'error')").select("user_id", "event_id", "event_type", "ts")
    tried = progression.deliveries(rows, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 1 + MOST_RETRIES)
    status = F.when(F.col("outcome") == "acknowledged", "Completed").when(F.col("outcome") == "dead", "Failed").otherwise("Retrying")
    next_at = F.when(status == "Retrying", F.col("ts") + F.make_dt_interval(secs=backoff_seconds(F.col("delivery")).cast("decimal(18,6)")))
    return tried.select("event_id", F.col("delivery").alias("attempt"), status.alias("status"), next_at.alias("next_at"))


@key("cross_service_steps", f"""with p as (select ord as batch_id, cast(1 as int) as step_order, false as nested from v_step where part = 'main' and step_type = 'Job' and has_payload and service = 'billing'
  union all select distinct k.parent, k.ord, true from v_child k join v_step s on s.ord = k.parent where s.step_type = 'ParallelGroup' and s.has_payload and k.step_type = 'Job' and k.has_job and k.service = 'billing'),
r as (select *, row_number() over (partition by batch_id, step_order order by completed_at, status, processed) as n from v_exec where status in {_FINAL} and completed_at is not null),
x as (select p.*, coalesce(r.completed_at <= u.started_at + interval '900' day, false) as in_time, r.status, r.processed from p join v_run u on u.batch_id = p.batch_id left join r on r.batch_id = p.batch_id and r.step_order = p.step_order and r.n = 1),
y as (select *, case when in_time then status else 'Failed' end as returned from x)
select batch_id, step_order, nested, case when returned = 'Cancelled' then 'Failed' else returned end as shadow_status, returned, case when nested then 'joins' when returned in ('Failed', 'Cancelled') then 'throws' else 'goes on' end as effect,
  case when returned = 'Completed' then processed end as outputs, not in_time as timed_out from y""")
def _(v):
    """Steps and children that the billing service runs; an order's first line replies to its step, each line to its child, within 900 days."""
    step = v.steps.where("part = 'main' and step_type = 'Job' and has_payload and service = 'billing'").select(F.col("ord").alias("batch_id"), F.lit(1).alias("step_order"), F.lit(False).alias("nested"))
    groups = v.steps.where("step_type = 'ParallelGroup' and has_payload").select(F.col("ord").alias("parent"))
    child = v.children.where("step_type = 'Job' and has_job and service = 'billing'").join(groups, "parent").select(F.col("parent").alias("batch_id"), F.col("ord").alias("step_order"), F.lit(True).alias("nested")).distinct()
    due = v.runs.select("batch_id", (F.col("started_at") + F.expr("interval '900' day")).alias("due_at"))
    final = v.executions.where(f"status in {_FINAL} and completed_at is not null")
    replies = final.select("batch_id", "step_order", "status", F.col("completed_at").alias("replied_at"), F.col("processed").alias("outputs"))
    return progression.cross_service(step.unionByName(child).join(due, "batch_id"), replies, ["batch_id", "step_order"]).drop("due_at")
