"""Joins, set operations, folds and gates over the ledger."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.status import legal, rank
from ..operators import rollups
from ..operators.ledger_query import page
from .registry import key

LATEST = "row_number() over (partition by batch_id, coalesce(cast(batch_step_id as string), 'exec:'||execution_id) order by enqueued_at desc, execution_id desc)"
NOW = "timestamp_ntz'1998-06-01 00:00:00'"


@key("latest_attempt_per_step", f"select batch_id, execution_id, status from (select *, {LATEST} rn from v_exec) t where rn = 1")
def _(v):
    return rollups.latest_attempts(v.executions).select("batch_id", "execution_id", "status")


_ROLLUP = f"""select f.batch_id, f.total, l.succeeded, l.failed, l.cancelled, case when l.cancelled>0 then 'Cancelled' when l.failed>0 then 'Failed' else 'Completed' end as st
from (select batch_id, count(*) total from v_exec group by batch_id) f
join (select batch_id, cast(sum(case when status='Completed' then 1 else 0 end) as bigint) succeeded, cast(sum(case when status='Failed' then 1 else 0 end) as bigint) failed, cast(sum(case when status='Cancelled' then 1 else 0 end) as bigint) cancelled
      from (select *, {LATEST} rn from v_exec) t where rn = 1 group by batch_id) l on f.batch_id = l.batch_id"""


@key("run_rollup", _ROLLUP)
def _(v):
    return rollups.run_rollup(v.executions)


@key("run_terminal_status", f"select r.batch_id, coalesce(r.status, x.st) as status from v_run r join ({_ROLLUP}) x on r.batch_id = x.batch_id")
def _(v):
    rows = rollups.run_rollup(v.executions).select("batch_id", "st")
    return v.runs.select("batch_id", "status").join(rows, "batch_id").select("batch_id", F.coalesce("status", "st").alias("status"))


@key("batch_completion_summary", "select batch_id, count(*) as total, cast(sum(case when status='Completed' then 1 else 0 end) as bigint) as completed, cast(sum(case when status='Failed' then 1 else 0 end) as bigint) as failed, cast(sum(case when status='Cancelled' then 1 else 0 end) as bigint) as cancelled, cast(sum(case when status='Skipped' then 1 else 0 end) as bigint) as skipped, max(coalesce(completed_at, timestamp '1998-06-01 00:00:00')) as completed_at from v_exec group by batch_id")
def _(v):
    return rollups.completion_summary(v.executions, F.expr(NOW))


@key("run_summary_from_execs", """select x.batch_id, case when x.bad = 1 then 'Failed' when x.at_work = 1 then 'Running' when g.batch_id is not null then 'AwaitingApproval' else 'Completed' end as st, x.s, case when x.n = x.ended and g.batch_id is null then x.e end as e
from (select batch_id, max(case when status in ('Failed','Cancelled') then 1 else 0 end) as bad, max(case when status not in ('Completed','Skipped','Failed','Cancelled') then 1 else 0 end) as at_work, min(enqueued_at) as s, count(*) as n, count(completed_at) as ended, max(completed_at) as e from v_exec group by batch_id) x
left join (select distinct batch_id from v_gate where on_timeout = 'Hold') g on g.batch_id = x.batch_id""")
def _(v):
    return rollups.run_summary(v.executions, v.gates.where("on_timeout = 'Hold'"))


@key("decision_status", """select batch_id, case when bool_or(status = 'Failed') then 'Failed' when bool_or(status in ('Cancelled', 'Cancelling')) then 'Cancelled' when bool_or(status in ('Running', 'Retrying', 'AwaitingApproval', 'Pending', 'Scheduled')) then 'Running' when bool_or(status = 'Completed') then 'Completed' else 'Skipped' end as status from v_exec where batch_step_id is not null group by batch_id""")
def _(v):
    return rollups.decision_status(v.executions.where("batch_step_id is not null"))


@key("definition_step_count", "select batch_definition_id, cast(sum(case when step_order % 3 = 0 then 2 else 1 end) as bigint) as steps from v_exec where batch_definition_id is not null group by batch_definition_id")
def _(v):
    parts = v.executions.where("batch_definition_id is not null").withColumn("parts", F.when(F.col("step_order") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))))
    return parts.groupBy("batch_definition_id").agg(F.sum(F.size("parts")).alias("steps"))


@key("fold_outputs_by_order", "select batch_id, output_key, output from (select batch_id, job_name as output_key, processed as output, row_number() over (partition by batch_id, job_name order by step_order desc, execution_id desc) n from v_exec) t where n = 1")
def _(v):
    last = v.executions.groupBy("batch_id", F.col("job_name").alias("output_key")).agg(F.max(F.struct("step_order", "execution_id", "processed")).alias("x"))
    return last.select("batch_id", "output_key", F.col("x.processed").alias("output"))


@key("accumulated_outputs", "select batch_id, execution_id, last_value(out ignore nulls) over (partition by batch_id order by step_order, execution_id rows between unbounded preceding and current row) as forwarded from (select *, case when status = 'Completed' then processed end as out from v_exec) t")
def _(v):
    along = Window.partitionBy("batch_id").orderBy("step_order", "execution_id").rowsBetween(Window.unboundedPreceding, 0)
    out = F.when(F.col("status") == "Completed", F.col("processed"))
    return v.executions.select("batch_id", "execution_id", F.last(out, ignorenulls=True).over(along).alias("forwarded"))


@key("progress_counts", "select job_name, cast(sum(processed) as bigint) as processed, cast(sum(failed_items) as bigint) as failed, max(total_items) as total from v_exec group by job_name")
def _(v):
    return v.executions.groupBy("job_name").agg(F.sum("processed").alias("processed"), F.sum("failed_items").alias("failed"), F.max("total_items").alias("total"))


@key("latest_gate_outcome", "select batch_id, step_id, approval_id from (select *, row_number() over (partition by batch_id % 100, step_id order by case when on_timeout = 'Hold' then null else deadline end desc nulls last, approval_id desc) n from v_gate) t where n = 1")
def _(v):
    rows = v.gates.withColumn("run", F.col("batch_id") % 100).withColumn("decided_at", F.when(F.col("on_timeout") != "Hold", F.col("deadline")))
    return rollups.latest_by(rows, ["run", "step_id"], [F.col("decided_at").desc_nulls_last(), F.col("approval_id").desc()], ["batch_id", "step_id", "approval_id"])


@key("latest_pending_gate", "select step_id, max(approval_id) as approval_id from v_gate where on_timeout = 'Hold' group by step_id")
def _(v):
    return v.gates.where("on_timeout = 'Hold'").groupBy("step_id").agg(F.max("approval_id").alias("approval_id"))


@key("gate_first_decision", "select step_id, approval_id from (select step_id, approval_id, row_number() over (partition by step_id order by deadline, approval_id) n from v_gate) t where n = 1")
def _(v):
    first = v.gates.groupBy("step_id").agg(F.min(F.struct("deadline", "approval_id")).alias("x"))
    return first.select("step_id", "x.approval_id")


@key("completed_step_probe", "select batch_id, batch_step_id, execution_id from (select *, row_number() over (partition by batch_id, batch_step_id order by enqueued_at desc, execution_id asc) n from v_exec where status = 'Completed' and batch_step_id is not null) t where n = 1")
def _(v):
    rows = v.executions.where("status = 'Completed' and batch_step_id is not null")
    return rollups.latest_by(rows, ["batch_id", "batch_step_id"], [F.col("enqueued_at").desc(), F.col("execution_id").asc()], ["batch_id", "batch_step_id", "execution_id"])


@key("skipped_step_ids", "select distinct batch_id, batch_step_id from v_exec where status = 'Skipped' and batch_step_id is not null")
def _(v):
    return v.executions.where("status = 'Skipped' and batch_step_id is not null").select("batch_id", "batch_step_id").distinct()


@key("job_catalog", "select distinct job_name, worker_name from v_exec")
def _(v):
    return v.executions.select("job_name", "worker_name").dropDuplicates()


@key("duplicate_step_ids", "select batch_id, batch_step_id, count(*) as n from v_exec where batch_step_id is not null group by batch_id, batch_step_id having count(*) > 1")
def _(v):
    return v.executions.where("batch_step_id is not null").groupBy("batch_id", "batch_step_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@key("duplicate_ids", "select execution_id, count(*) as n from v_exec group by execution_id having count(*) > 1")
def _(v):
    return v.executions.groupBy("execution_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@key("service_counts", "select 'jobs' as what, count(distinct job_name) as n from v_exec union all select 'batches', count(*) from v_def union all select 'pending', count(*) from v_gate")
def _(v):
    count = lambda df, what, c: df.agg(c.alias("n")).select(F.lit(what).alias("what"), "n")
    one = F.count(F.lit(1))
    return count(v.executions, "jobs", F.countDistinct("job_name")).unionByName(count(v.definitions, "batches", one)).unionByName(count(v.gates, "pending", one))


@key("current_state", "select user_id, event_type as status, n as events from (select user_id, event_type, count(*) over (partition by user_id) n, row_number() over (partition by user_id order by ts desc, event_id desc) r from events) t where r = 1")
def _(v):
    state = v.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("x"), F.count(F.lit(1)).alias("events"))
    return state.select("user_id", F.col("x.event_type").alias("status"), "events")


@key("current_run_state", "select user_id, min(ts) as started_at, max(ts) as changed_at, max(case when event_id % 7 <> 0 then event_id end) as cursor from events group by user_id")
def _(v):
    return v.events.groupBy("user_id").agg(F.min("ts").alias("started_at"), F.max("ts").alias("changed_at"), F.max(F.when(F.col("event_id") % 7 != 0, F.col("event_id"))).alias("cursor"))


@key("hub_fanout", "select 'exec:'||execution_id as group_key, status from v_exec union all select 'batch:'||cast(batch_id as string), status from v_exec union all select 'job:'||job_name, status from v_exec union all select 'all', status from v_exec")
def _(v):
    keys = F.array(F.concat(F.lit("exec:"), F.col("execution_id")), F.concat(F.lit("batch:"), F.col("batch_id").cast("string")), F.concat(F.lit("job:"), F.col("job_name")), F.lit("all"))
    return v.executions.select(F.explode(keys).alias("group_key"), "status")


# Joins and set operations.
_CATALOG = "select id, source, name from v_def where source = 'Code' union all select d.id, d.source, d.name from v_def d where d.source <> 'Code' and not exists (select 1 from v_def x where x.source = 'Code' and x.name = d.name)"


def catalog(v):
    """Code definitions hide stored ones of their name; stored ones do not hide one another."""
    rows = v.definitions.select("id", "source", "name")
    code = rows.where("source = 'Code'")
    return code.unionByName(rows.where("source <> 'Code'").join(code.select("name").distinct(), "name", "left_anti").select("id", "source", "name"))


key("catalog_merge", _CATALOG)(catalog)


@key("catalog_page", f"select id, name, count(*) over () as total from ({_CATALOG}) t order by name, id limit 25 offset 50")
def _(v):
    rows = catalog(v)
    total = rows.agg(F.count(F.lit(1)).alias("total"))  # one row
    return page(rows.select("id", "name"), [F.col("name"), F.col("id")], 50, 25).crossJoin(F.broadcast(total))


@key("gates_live_union_stored", "select approval_id, 'live' as kept_in from v_gate where step_id < 2 union all select approval_id, 'stored' from v_gate where step_id >= 2 and on_timeout <> 'Fail'")
def _(v):
    live, stored = v.gates.where("step_id < 2").select("approval_id"), v.gates.where("on_timeout <> 'Fail'").select("approval_id")
    return live.withColumn("kept_in", F.lit("live")).unionByName(stored.join(live, "approval_id", "left_anti").withColumn("kept_in", F.lit("stored")))


@key("gate_batch_name", "select g.approval_id, coalesce(d.name, cast(r.batch_definition_id as string), '<unknown>') as batch_name from v_gate g left join v_run r on g.batch_id = r.batch_id left join (select * from v_def where source <> 'Api') d on cast(r.batch_definition_id as string) = d.id")
def _(v):
    names = v.definitions.where("source <> 'Api'").select(F.col("id").alias("def_id"), "name")
    runs = v.runs.select("batch_id", F.col("batch_definition_id").cast("string").alias("def_id"))
    return v.gates.join(runs, "batch_id", "left").join(names, "def_id", "left").select("approval_id", F.coalesce("name", "def_id", F.lit("<unknown>")).alias("batch_name"))


@key("resolve_by_name_priority", "select name, id from (select name, id, row_number() over (partition by name order by case source when 'Code' then 0 when 'Dashboard' then 1 else 2 end, id) n from v_def) t where n = 1")
def _(v):
    tier = F.when(F.col("source") == "Code", 0).when(F.col("source") == "Dashboard", 1).otherwise(2).alias("tier")
    return v.definitions.groupBy("name").agg(F.min(F.struct(tier, "id")).alias("x")).select("name", "x.id")


@key("status_overlay", "select coalesce(g.batch_id, r.batch_id) as batch_id, coalesce(g.st, r.status) as status from (select batch_id, status from v_run where status is not null) r full outer join (select batch_id, 'AwaitingApproval' as st from v_gate) g on g.batch_id = r.batch_id")
def _(v):
    rows = v.runs.where("status is not null").select("batch_id", "status")
    over = v.gates.select("batch_id", F.lit("AwaitingApproval").alias("st"))
    return rows.join(over, "batch_id", "full").select("batch_id", F.coalesce("st", "status").alias("status"))


@key("skipped_indices", "select distinct e.batch_id, e.step_order from v_exec e where exists (select 1 from v_exec s where s.status = 'Skipped' and s.batch_id = e.batch_id and s.batch_step_id = e.batch_step_id)")
def _(v):
    skipped = v.executions.where("status = 'Skipped' and batch_step_id is not null").select("batch_id", "batch_step_id")
    return v.executions.join(skipped, ["batch_id", "batch_step_id"], "left_semi").select("batch_id", "step_order").distinct()


@key("decision_losers", "select distinct e.batch_id, e.batch_step_id from v_exec e where e.batch_step_id is not null and e.batch_step_id <> 1 and not exists (select 1 from v_exec s where s.status = 'Skipped' and s.batch_id = e.batch_id and s.batch_step_id = e.batch_step_id)")
def _(v):
    rows = v.executions.where("batch_step_id is not null")
    done = rows.where("status = 'Skipped'").select("batch_id", "batch_step_id")
    return rows.where("batch_step_id <> 1").select("batch_id", "batch_step_id").distinct().join(done, ["batch_id", "batch_step_id"], "left_anti")


@key("request_reply_join", "select q.event_id, case when count(p.event_id) > 0 then 'replied' else 'timeout' end as outcome from (select event_id, user_id, ts from events where event_type = 'view') q left join (select event_id, user_id, ts from events where event_type <> 'view') p on p.user_id = q.user_id and p.ts > q.ts and p.ts <= q.ts + interval '5' hour group by q.event_id")
def _(v):
    requests = v.events.where("event_type = 'view'").select("event_id", "user_id", "ts")
    replies = v.events.where("event_type <> 'view'").select(F.col("user_id").alias("u"), F.col("ts").alias("t"))
    # The next reply of the same correlation decides; a running minimum over one sort replaces the pairs of a range join.
    both = requests.select("event_id", "user_id", "ts", F.lit(None).cast("timestamp_ntz").alias("reply")).unionByName(replies.select(F.lit(None).cast("long").alias("event_id"), F.col("u").alias("user_id"), F.col("t").alias("ts"), F.col("t").alias("reply")))
    ordered = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("reply").isNotNull().asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("next_reply", F.min("reply").over(ordered)).where("event_id is not null")
    return found.select("event_id", F.when(F.col("next_reply") <= F.col("ts") + F.expr("interval '5' hour"), "replied").otherwise("timeout").alias("outcome"))


@key("dag_edges", "select distinct a.batch_id, a.step_order as source_step, b.step_order as target_step from v_exec a join v_exec b on a.batch_id = b.batch_id and b.step_order = a.step_order + 1")
def _(v):
    steps = v.executions.select("batch_id", "step_order").distinct()
    following = steps.select("batch_id", (F.col("step_order") - 1).alias("step_order"), F.col("step_order").alias("target_step"))
    return steps.join(following, ["batch_id", "step_order"]).select("batch_id", F.col("step_order").alias("source_step"), "target_step")


@key("retry_lineage", "select r.batch_id, r.retry_of_batch_id, o.status as original_status from v_run r join v_run o on r.retry_of_batch_id = o.batch_id")
def _(v):
    original = v.runs.select(F.col("batch_id").alias("retry_of_batch_id"), F.col("status").alias("original_status"))
    return v.runs.where("retry_of_batch_id is not null").select("batch_id", "retry_of_batch_id").join(original, "retry_of_batch_id").select("batch_id", "retry_of_batch_id", "original_status")


@key("missing_required_params", "select o.o_orderkey as batch_id, p.name from orders o join (select 'orderId' as name, 0 as m union all select 'retries', 2 union all select 'dryRun', 3) p on true where p.m <> 3 and not (o.o_orderkey % 4 >= p.m and p.m > 0)")
def _(v):
    declared = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(m).alias("m")) for n, m in (("orderId", 0), ("retries", 2), ("dryRun", 3))])
    runs = v.table("orders").select(F.col("o_orderkey").alias("batch_id"), F.explode(declared).alias("p"))
    supplied, default = (F.col("p.m") > 0) & (F.col("batch_id") % 4 >= F.col("p.m")), F.col("p.m") == 3
    return runs.where(~supplied & ~default).select("batch_id", "p.name")


@key("uncataloged_steps", "select distinct job_name, worker_name from v_exec e where not exists (select 1 from v_exec c where c.status = 'Failed' and c.job_name = e.job_name and c.worker_name is not distinct from e.worker_name)")
def _(v):
    pairs = v.executions.select("job_name", "worker_name").distinct()
    known = v.executions.where("status = 'Failed'").select(F.col("job_name").alias("j"), F.col("worker_name").alias("w")).distinct()
    return pairs.join(known, (F.col("job_name") == F.col("j")) & F.col("worker_name").eqNullSafe(F.col("w")), "left_anti")


@key("services_merge", "select distinct s_name as service, 'configured' as origin from supplier union all select distinct worker_name, 'seen' from v_exec where worker_name not in (select s_name from supplier)")
def _(v):
    configured = v.table("supplier").select(F.col("s_name").alias("service")).distinct()
    seen = v.executions.select(F.col("worker_name").alias("service")).distinct()
    return configured.withColumn("origin", F.lit("configured")).unionByName(seen.join(configured, "service", "left_anti").withColumn("origin", F.lit("seen")))


# Gates.
@key("gates_pending", "select approval_id, pending_since from v_gate where on_timeout = 'Hold' order by pending_since, approval_id")
def _(v):
    return v.gates.where("on_timeout = 'Hold'").select("approval_id", "pending_since").orderBy("pending_since", "approval_id")


@key("gates_for_role", "select approval_id from v_gate where list_contains(string_split(allowed_roles, ','), 'dev') or list_contains(string_split(allowed_roles, ','), '*')")
def _(v):
    roles = F.split("allowed_roles", ",")
    return v.gates.where(F.array_contains(roles, "dev") | F.array_contains(roles, "*")).select("approval_id")


@key("gate_authorize", "select approval_id, case when allowed_roles = '' then 'config error' when batch_id % 3 <> 0 and list_contains(string_split(allowed_roles, ','), '*') then 'ok' when list_has_any(string_split(allowed_roles, ','), ['dev','admin']) then 'ok' else 'denied' end as verdict from v_gate")
def _(v):
    roles, anonymous = F.split("allowed_roles", ","), F.col("batch_id") % 3 == 0
    verdict = (
        F.when(F.col("allowed_roles") == "", "config error")
        .when(~anonymous & F.array_contains(roles, "*"), "ok")  # the wildcard admits whoever has a name, a role anyone who has it
        .when(F.arrays_overlap(roles, F.array(F.lit("dev"), F.lit("admin"))), "ok")
        .otherwise("denied")
    )
    return v.gates.select("approval_id", verdict.alias("verdict"))


@key("gate_timeout_eval", "select approval_id, case when timestamp '1998-06-01 00:00:00' < deadline then 'Pending' when on_timeout='Fail' then 'TimedOutFail' when on_timeout='AutoApprove' then 'AutoApproved' else 'Pending' end as outcome from v_gate")
def _(v):
    late = F.expr(NOW) >= F.col("deadline")
    return v.gates.select("approval_id", F.when(late & (F.col("on_timeout") == "Fail"), "TimedOutFail").when(late & (F.col("on_timeout") == "AutoApprove"), "AutoApproved").otherwise("Pending").alias("outcome"))


@key("reap_gates", "select approval_id, case when pending_since < timestamp '1998-06-01 00:00:00' - interval '2' minute then 'Interrupted' else 'Pending' end as outcome from v_gate")
def _(v):
    return v.gates.select("approval_id", F.when(F.col("pending_since") < F.expr(NOW + " - interval '2' minute"), "Interrupted").otherwise("Pending").alias("outcome"))


# Status lattice.
_STATUS = "case event_type when 'view' then 'Pending' when 'click' then 'Running' when 'purchase' then 'Completed' when 'signup' then 'Failed' else 'Cancelling' end"
_LEGAL = "('Pending>Running','Pending>Cancelling','Pending>Failed','Running>Completed','Running>Failed','Running>Cancelling')"


@key("transition_audit", f"select event_id, s as status, p is null or p||'>'||s in {_LEGAL} as is_legal from (select event_id, s, lag(s) over (partition by user_id order by ts, event_id) as p from (select *, {_STATUS} as s from events) a) t")
def _(v):
    rows = v.events.withColumn("status", F.expr(_STATUS))
    before = F.lag("status").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return rows.select("event_id", "status", legal(before, F.col("status")).alias("is_legal"))


@key("monotonic_status", f"select user_id, event_id, max(r) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as shown_rank from (select *, case {_STATUS} when 'Pending' then 0 when 'Running' then 1 when 'Cancelling' then 2 else 3 end as r from events) t")
def _(v):
    along = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return v.events.select("user_id", "event_id", F.max(rank(F.expr(_STATUS))).over(along).alias("shown_rank"))
