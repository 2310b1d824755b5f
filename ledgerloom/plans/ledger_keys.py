"""Scans, filters, conditions, projections and paging over the ledger."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.conditions import Condition, compile_condition
from ..functions.status import is_terminal
from ..operators.ledger_query import ExecutionQuery, RunQuery, holds_text, newest_executions, newest_runs, page
from ..streaming import feeds
from .registry import key

SHORT = ["execution_id", "job_name", "batch_id", "status", "enqueued_at"]


def executions(name: str, query: ExecutionQuery, where: str) -> None:
    """A filter over executions under a name."""
    key(name, f"select execution_id, job_name, batch_id, status, enqueued_at from v_exec where {where}")(lambda v: query.apply(v.executions).select(*SHORT))


@key("scan_executions", "select * from v_exec")
def _(v):
    return v.executions


@key("get_execution", "select execution_id, job_name, batch_id, status, enqueued_at from v_exec where execution_id = (select min(execution_id) from v_exec where batch_id = 1)")
def _(v):
    wanted = v.executions.where("batch_id = 1").agg(F.min("execution_id").alias("execution_id"))  # one row
    return v.executions.join(F.broadcast(wanted), "execution_id", "left_semi").select(*SHORT)


@key("get_execution_unknown", "select execution_id, job_name, batch_id, status, enqueued_at from v_exec where execution_id = 'no such id'")
def _(v):
    return ExecutionQuery(execution_id="no such id").apply(v.executions).select(*SHORT)


executions("filter_status_in", ExecutionQuery(statuses=("Failed", "Cancelled")), "status in ('Failed', 'Cancelled')")
executions("filter_job_name", ExecutionQuery(job_name="Job.3"), "job_name = 'Job.3'")
executions("filter_batch_id", ExecutionQuery(batch_id=7), "batch_id = 7")
executions("filter_definition_id", ExecutionQuery(batch_definition_id=7), "batch_definition_id = 7")
executions("filter_worker", ExecutionQuery(worker_name="worker-5"), "worker_name = 'worker-5'")
executions("filter_time_range", ExecutionQuery(since=datetime(1996, 1, 1), until=datetime(1996, 3, 1)), "enqueued_at >= timestamp '1996-01-01 00:00:00' and enqueued_at < timestamp '1996-03-01 00:00:00'")
executions("search_text", ExecutionQuery(search="job.1"), "contains(lower(last_error), 'job.1') or contains(lower(job_name), 'job.1')")
executions("search_text_literal_wildcards", ExecutionQuery(search="err_7%"), "contains(lower(last_error), 'err_7%') or contains(lower(job_name), 'err_7%')")


@key("get_run", "select * from v_run where batch_id = 33")
def _(v):
    return v.runs.where("batch_id = 33")


def runs(name: str, query: RunQuery, where: str) -> None:
    key(name, f"select batch_id, status, started_at from v_run where {where}")(lambda v: query.apply(v.runs).select("batch_id", "status", "started_at"))


runs("runs_filter_running", RunQuery(statuses=("None",)), "status is null")
runs("runs_filter_terminal", RunQuery(include_running=False), "status is not null")
runs("runs_filter_status_plus_running", RunQuery(statuses=("Failed",)), "status is null or status = 'Failed'")


@key("inflight_runs", "select batch_id, started_at from v_run where status is null and completed_at is null")
def _(v):
    return v.runs.where("status is null and completed_at is null").select("batch_id", "started_at")


@key("count_executions", "select count(*) as n from v_exec where status in ('Failed', 'Running')")
def _(v):
    return ExecutionQuery(statuses=("Failed", "Running")).apply(v.executions).agg(F.count(F.lit(1)).alias("n"))


@key("count_runs", "select count(*) as n from v_run where status is null or status = 'Failed'")
def _(v):
    return RunQuery(statuses=("Failed",)).apply(v.runs).agg(F.count(F.lit(1)).alias("n"))


@key("count_defs_by_source", "select source, count(*) as n from v_def group by source")
def _(v):
    return v.definitions.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@key("list_definitions_by_source", "select id, source, name from v_def where source = 'Api' order by id limit 20 offset 10")
def _(v):
    return page(v.definitions.where("source = 'Api'").select("id", "source", "name"), [F.col("id")], 10, 20)


@key("list_jobs", "select p_partkey as ord, p_name as job_name, p_size % 2 = 0 as partitioned from part where p_size % 2 = 0 order by p_partkey limit 50 offset 5")
def _(v):
    jobs = v.table("part").select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("job_name"), (F.col("p_size") % 2 == 0).alias("partitioned"))
    return page(jobs.where("partitioned"), [F.col("ord")], 5, 50)


@key("schedulable_defs", "select id, schedule from v_def where schedule is not null and schedule <> '' and schedule_enabled")
def _(v):
    return v.definitions.where("schedule <> '' and schedule_enabled").select("id", "schedule")


@key("reap_orphans", "select execution_id, case when status not in ('Completed', 'Failed', 'Cancelled', 'Skipped') and enqueued_at < timestamp '1998-10-01 00:00:00' - interval '2' minute then 'Failed' else status end as status, case when status not in ('Completed', 'Failed', 'Cancelled', 'Skipped') and enqueued_at < timestamp '1998-10-01 00:00:00' - interval '2' minute then 'interrupted' else last_error end as last_error from v_exec")
def _(v):
    stale = ~is_terminal(F.col("status")) & (F.col("enqueued_at") < F.expr("timestamp_ntz'1998-10-01 00:00:00' - interval '2' minute"))
    return v.executions.select("execution_id", F.when(stale, "Failed").otherwise(F.col("status")).alias("status"), F.when(stale, "interrupted").otherwise(F.col("last_error")).alias("last_error"))


@key("catalog_name_contains", "select id, name from v_def where contains(lower(name), lower('H-1'))")
def _(v):
    return v.definitions.where(holds_text("name", "H-1")).select("id", "name")


@key("errors_by_path", "select 'Steps['||cast(l_linenumber as string)||']' as path, count(distinct l_returnflag) as n, min(l_returnflag) as first_message from lineitem where l_linenumber <> 7 group by l_linenumber")
def _(v):
    errors = v.table("lineitem").select(F.when(F.col("l_linenumber") == 7, "Schedule").otherwise(F.concat(F.lit("Steps["), F.col("l_linenumber").cast("string"), F.lit("]"))).alias("path"), F.col("l_returnflag").alias("message"))
    return errors.where(F.col("path").startswith("Steps[")).groupBy("path").agg(F.count_distinct("message").alias("n"), F.min("message").alias("first_message"))


# Conditions over the parameter bags of v_param: the key may be missing, or there with a null.
_NUM = "try_cast(k as double)"
for _name, _condition, _where in (
    ("cond_exists", Condition("k", "Exists"), "has_k"),
    ("cond_not_exists", Condition("k", "NotExists"), "not has_k"),
    ("cond_null_guard", Condition("k", "NotEquals", "x"), "has_k and k is not null"),
    ("cond_gt", Condition("k", "GreaterThan", "50"), f"has_k and {_NUM} > 50"),
    ("cond_gte", Condition("k", "GreaterThanOrEqual", "50"), f"has_k and {_NUM} >= 50"),
    ("cond_lt", Condition("k", "LessThan", "50"), f"has_k and {_NUM} < 50"),
    ("cond_lte", Condition("k", "LessThanOrEqual", "50"), f"has_k and {_NUM} <= 50"),
    ("cond_eq_numeric", Condition("k", "Equals", "50.0"), f"has_k and {_NUM} = 50"),
    ("cond_eq_string", Condition("k", "Equals", "x50"), "has_k and k = 'x50'"),
    ("cond_neq", Condition("k", "NotEquals", "50"), f"has_k and k is not null and {_NUM} <> 50"),
    ("cond_contains", Condition("k", "Contains", "7"), "has_k and contains(k, '7')"),
    ("cond_unknown", Condition("k", "Resembles", "7"), "false"),
):
    key(_name, f"select event_id from v_param where coalesce({_where}, false)")(lambda v, c=_condition: v.params.where(compile_condition(c, F.col("k"), F.col("has_k"))).select("event_id"))

_WORD = "case event_id % 6 when 0 then 'true' when 1 then ' False' when 2 then '1' when 3 then 'yes' when 4 then null else 'FALSE' end"
for _name, _condition, _where in (
    ("cond_is_true", Condition("k", "IsTrue"), "lower(trim(w)) = 'true'"),
    ("cond_is_false", Condition("k", "IsFalse"), "lower(trim(w)) = 'false'"),
    ("cond_eq_bool", Condition("k", "Equals", "false"), "lower(trim(w)) = 'false'"),
):
    key(_name, f"select event_id from (select event_id, has_k, {_WORD} as w from v_param) t where coalesce(has_k and {_where}, false)")(
        lambda v, c=_condition: v.params.withColumn("w", F.expr(_WORD)).where(compile_condition(c, F.col("w"), F.col("has_k"))).select("event_id")
    )


@key("exec_row_projection", "select execution_id, job_name, batch_id, batch_step_id, status, enqueued_at, completed_at, last_error, processed, failed_items, total_items from v_exec")
def _(v):
    return v.executions.drop("worker_name", "step_order", "batch_definition_id")


@key("run_summary", "select batch_id, coalesce(status, 'Running') as status, cast(date_diff('second', started_at, completed_at) as bigint) as seconds from v_run")
def _(v):
    return v.runs.select("batch_id", F.coalesce("status", F.lit("Running")).alias("status"), scalars.seconds_between(F.col("started_at"), F.col("completed_at")).alias("seconds"))


@key("progress_math", "select execution_id, greatest(0, total_items - processed - failed_items) as remaining, least(greatest(cast(floor((processed - failed_items) * 100 / 60.0) as int), 0), 100) as percent, processed + failed_items >= total_items as is_complete from v_exec")
def _(v):
    p, f, t = F.col("processed"), F.col("failed_items"), F.col("total_items")
    return v.executions.select("execution_id", scalars.remaining(p, f, t).alias("remaining"), scalars.percent_succeeded(p, f, t).alias("percent"), (p + f >= t).alias("is_complete"))


@key("gate_overdue", "select approval_id, cast(date_diff('second', timestamp '1998-06-01 00:00:00', deadline) as bigint) as seconds_left, timestamp '1998-06-01 00:00:00' >= deadline as overdue from v_gate")
def _(v):
    now = F.expr("timestamp_ntz'1998-06-01 00:00:00'")
    return v.gates.select("approval_id", scalars.seconds_between(now, F.col("deadline")).alias("seconds_left"), (now >= F.col("deadline")).alias("overdue"))


@key("gate_view", "select approval_id, batch_id, step_id, pending_since, deadline, on_timeout from v_gate")
def _(v):
    return v.gates.drop("allowed_roles")


@key("definition_summary", "select l_orderkey as id, count(*) as step_count, max(l_linenumber) as last_step from lineitem group by l_orderkey")
def _(v):
    return v.table("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count(F.lit(1)).alias("step_count"), F.max("l_linenumber").alias("last_step"))


@key("format_duration", "select execution_id, case when s < 60 then cast(s as string)||'s' when s < 3600 then cast(s // 60 as string)||'m '||cast(s % 60 as string)||'s' else cast(s // 3600 as string)||'h '||cast(s % 3600 // 60 as string)||'m' end as shown from (select execution_id, processed * 137 as s from v_exec) t")
def _(v):
    return v.executions.select("execution_id", scalars.duration_text(F.col("processed") * 137).alias("shown"))


@key("relative_age", "select event_id, case when s < 60 then cast(s as string)||'s ago' when s < 3600 then cast(s // 60 as string)||'m ago' when s < 86400 then cast(s // 3600 as string)||'h ago' else cast(s // 86400 as string)||'d ago' end as age from (select event_id, greatest(cast(date_diff('second', date_trunc('second', ts), timestamp '2024-01-15 00:00:00') as bigint), 0) as s from v_param) t")
def _(v):
    age = scalars.seconds_between(F.date_trunc("second", "ts").cast("timestamp_ntz"), F.expr("timestamp_ntz'2024-01-15 00:00:00'"))
    return v.params.select("event_id", scalars.age_text(age).alias("age"))


@key("window_unit", "select event_id, case when m % 1440 = 0 then 'days' when m % 60 = 0 then 'hours' else 'minutes' end as unit from (select event_id, event_id * 20 as m from v_param) t")
def _(v):
    return v.params.select("event_id", scalars.largest_unit(F.col("event_id") * 20).alias("unit"))


@key("condition_label", "select event_id, case event_id % 4 when 0 then 'else' when 1 then 'k exists' when 2 then 'k > '||cast(event_id % 100 as string) else 'k = '||coalesce(k, '') end as label from v_param")
def _(v):
    kind, n = F.col("event_id") % 4, (F.col("event_id") % 100).cast("string")
    text = F.when(kind == 0, "else").when(kind == 1, "k exists").when(kind == 2, F.concat(F.lit("k > "), n)).otherwise(F.concat(F.lit("k = "), F.coalesce("k", F.lit(""))))
    return v.params.select("event_id", text.alias("label"))


@key("id_tail", "select execution_id, right(execution_id, 8) as tail, job_name||', '||worker_name as tags from v_exec")
def _(v):
    return v.executions.select("execution_id", F.right("execution_id", F.lit(8)).alias("tail"), F.array_join(F.array("job_name", "worker_name"), ", ").alias("tags"))


@key("reindex_steps", "select batch_id, execution_id, row_number() over (partition by batch_id order by step_order, execution_id) - 1 as position from v_exec where worker_name <> 'worker-1'")
def _(v):
    drafts = v.executions.where("worker_name <> 'worker-1'").groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct("step_order", "execution_id"))).alias("steps"))
    return drafts.select("batch_id", F.posexplode("steps").alias("position", "s")).select("batch_id", "s.execution_id", F.col("position").cast("long").alias("position"))


for _name, _newest, _order in (("page_executions_desc", True, "enqueued_at desc, execution_id asc"), ("page_executions_asc", False, "enqueued_at asc, execution_id asc")):
    key(_name, f"select execution_id, enqueued_at from v_exec order by {_order} limit 50 offset 100")(lambda v, n=_newest: page(v.executions.select("execution_id", "enqueued_at"), newest_executions(v.executions, n), 100, 50))
for _name, _newest, _order in (("page_runs_desc", True, "started_at desc, batch_id desc"), ("page_runs_asc", False, "started_at asc, batch_id asc")):
    key(_name, f"select batch_id, started_at from v_run order by {_order} limit 50 offset 20")(lambda v, n=_newest: page(v.runs.select("batch_id", "started_at"), newest_runs(v.runs, n), 20, 50))


@key("page_clamp", "select execution_id from v_exec order by enqueued_at desc, execution_id asc limit 10 offset 0")
def _(v):
    return page(v.executions.select("execution_id", "enqueued_at"), newest_executions(v.executions), -5, 10).select("execution_id")


@key("run_detail_top50", "select execution_id, batch_id, enqueued_at from v_exec order by enqueued_at desc, execution_id desc limit 50")
def _(v):
    return page(v.executions.select("execution_id", "batch_id", "enqueued_at"), [F.col("enqueued_at").desc(), F.col("execution_id").desc()], 0, 50)


@key("tail_200", "select user_id, event_id from (select user_id, event_id, ts, row_number() over (partition by user_id order by ts desc, event_id desc) n from events) t where n = 1 order by ts desc, event_id desc limit 200")
def _(v):
    last = v.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("x")).select("user_id", "x.ts", "x.event_id")
    return page(last, [F.col("ts").desc(), F.col("event_id").desc()], 0, 200).select("user_id", "event_id")


@key("ordered_steps", "select batch_id, min(step_order) as first_step, max(step_order) as last_step from v_exec group by batch_id")
def _(v):
    return v.executions.groupBy("batch_id").agg(F.min("step_order").alias("first_step"), F.max("step_order").alias("last_step"))


@key("json_roundtrip", "select event_id, user_id, event_type from events")
def _(v):
    text = v.events.select(F.to_json(F.struct("event_id", "user_id", "event_type")).alias("j"))
    return text.select(F.from_json("j", "event_id long, user_id long, event_type string").alias("x")).select("x.*")


@key("json_equal", "select l_orderkey as batch_id, l_quantity <> l_linenumber as changed from lineitem")
def _(v):
    rows = v.table("lineitem")
    return rows.select(F.col("l_orderkey").alias("batch_id"), (F.col("l_quantity").cast("double") != F.col("l_linenumber").cast("double")).alias("changed"))


@key("poison_split", "select event_id, 'bad' as route from events where event_id % 13 = 0 union all select event_id, 'good' from events where event_id % 13 <> 0")
def _(v):
    """Messages that are no JSON any more, every thirteenth was cut off on its way, are dead letters."""
    messages = v.events.select("event_id", F.when(F.col("event_id") % 13 == 0, F.left("props", F.lit(4))).otherwise(F.col("props")).alias("body"))
    good, bad = feeds.dead_letters(messages, "body", "k int")
    return good.select("event_id", F.lit("good").alias("route")).unionByName(bad.select("event_id", F.lit("bad").alias("route")))


@key("json_wildcard_roles", "select event_id, case when event_id % 2 = 0 then 'admin,'||event_type else event_type end as roles from events")
def _(v):
    access = F.to_json(F.create_map(F.lit("app"), F.struct(F.array("event_type").alias("roles")), F.lit("api"), F.struct(F.when(F.col("event_id") % 2 == 0, F.array(F.lit("admin"), F.lit(" "))).otherwise(F.array("event_type")).alias("roles"))))
    roles = F.flatten(F.transform(F.map_values(F.from_json(access, "map<string,struct<roles:array<string>>>")), lambda x: x["roles"]))
    return v.events.select("event_id", F.array_join(F.array_sort(F.array_distinct(F.filter(roles, lambda r: F.trim(r) != ""))), ",").alias("roles"))
