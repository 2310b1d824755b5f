"""Workflow plans as queries, and data-parallel items."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.partitioned import MOST_WORKERS, process_items
from ..sources.finalized import finalize
from ..sources.shared import new_folder
from .registry import key


def _with_definition(v):
    """Runs beside the steps of their definition, at top level and in all; ``drifted`` if these are others than when the run began."""
    definitions = v.definitions.select(F.col("id").cast("long").alias("batch_definition_id"), "top_steps", F.col("step_count").alias("now"))
    return v.runs.join(definitions, "batch_definition_id").withColumn("drifted", F.col("step_count") != F.col("now"))


def _start(cursor, steps):
    """A cursor within 0 to the number of steps; at that number every step has run."""
    return F.least(F.greatest(cursor, F.lit(0)), steps)


_RUNS = "(select r.*, d.top_steps, r.step_count <> d.step_count as drifted from v_run r join v_def d on cast(r.batch_definition_id as string) = d.id)"


@key("resume_start_index", f"select batch_id, least(greatest(coalesce(current_step_index, 0), 0), top_steps) as start_index from {_RUNS} t")
def _(v):
    return _with_definition(v).select("batch_id", _start(F.coalesce("current_step_index", F.lit(0)), F.col("top_steps")).alias("start_index"))


@key("retryable_runs", f"select batch_id, case when status is null then 'in_progress' when status<>'Failed' then 'not_failed' when compensation_step_index is not null then 'compensated' when current_step_index is null and succeeded>0 then 'no_cursor' when drifted then 'drift' else 'ok' end as verdict from {_RUNS} t")
def _(v):
    verdict = (
        F.when(F.col("status").isNull(), "in_progress")
        .when(F.col("status") != "Failed", "not_failed")
        .when(F.col("compensation_step_index").isNotNull(), "compensated")
        .when(F.col("current_step_index").isNull() & (F.col("succeeded") > 0), "no_cursor")
        .when(F.col("drifted"), "drift")
        .otherwise("ok")
    )
    return _with_definition(v).select("batch_id", verdict.alias("verdict"))


@key("resume_plan", f"select batch_id, case when unwinding then 'resume unwind' when start >= top_steps then 'finalize' when drifted then 'restart all' else 'resume' end as action, case when unwinding then null else start end as from_step from (select *, compensation_step_index is not null as unwinding, case when drifted then 0 else least(greatest(coalesce(current_step_index, 0), 0), top_steps) end as start from {_RUNS} t where status is null) u")
def _(v):
    unwinding = F.col("compensation_step_index").isNotNull()
    start = F.when(F.col("drifted"), 0).otherwise(_start(F.coalesce("current_step_index", F.lit(0)), F.col("top_steps")))
    action = F.when(unwinding, "resume unwind").when(start >= F.col("top_steps"), "finalize").when(F.col("drifted"), "restart all").otherwise("resume")
    return _with_definition(v).where("status is null").select("batch_id", action.alias("action"), F.when(~unwinding, start).alias("from_step"))


@key("unwind_plan", "select batch_id, batch_step_id||':comp' as compensator, row_number() over (partition by batch_id order by batch_step_id desc) as position from (select distinct batch_id, cast(batch_step_id as string) as batch_step_id from v_exec where status = 'Completed' and batch_step_id is not null) t")
def _(v):
    done = v.executions.where("status = 'Completed' and batch_step_id is not null").groupBy("batch_id").agg(F.sort_array(F.collect_set(F.col("batch_step_id").cast("string")), asc=False).alias("steps"))
    steps = done.select("batch_id", F.posexplode("steps").alias("i", "step"))
    return steps.select("batch_id", F.concat("step", F.lit(":comp")).alias("compensator"), (F.col("i") + 1).cast("long").alias("position"))


@key("compensator_ids", "select distinct cast(batch_step_id as string)||':comp' as compensator, true as reserved from v_exec where batch_step_id is not null")
def _(v):
    name = F.concat(F.col("batch_step_id").cast("string"), F.lit(":comp"))
    return v.executions.where("batch_step_id is not null").select(name.alias("compensator")).distinct().withColumn("reserved", F.endswith("compensator", F.lit(":comp")))


@key("onfailure_plan", "select batch_id, case when compensation_step_index is not null then 'after unwind' else 'at once' end as runs_when from v_run where status = 'Failed'")
def _(v):
    return v.runs.where("status = 'Failed'").select("batch_id", F.when(F.col("compensation_step_index").isNotNull(), "after unwind").otherwise("at once").alias("runs_when"))


@key("failure_policy_eval", "select batch_id, case batch_id % 3 when 0 then 'stop' when 1 then 'continue' else case when exists (select 1 from v_exec e where e.batch_id = r.batch_id and e.status = 'Completed') then 'compensate' else 'stop' end end as action from v_run r where r.status = 'Failed'")
def _(v):
    done = v.executions.where("status = 'Completed'").select("batch_id").distinct().withColumn("done", F.lit(True))
    policy = F.col("batch_id") % 3
    action = F.when(policy == 0, "stop").when(policy == 1, "continue").when(F.col("done"), "compensate").otherwise("stop")
    return v.runs.where("status = 'Failed'").join(done, "batch_id", "left").select("batch_id", action.alias("action"))


@key("join_policy_eval", "select batch_id, n, done, case when bad > 0 then 'fail' else 'ok' end as wait_all, case when done > 0 then 'ok' else 'fail' end as wait_any, case when done >= n // 2 + 1 then 'ok' when bad > n - (n // 2 + 1) then 'fail' else 'open' end as wait_majority from (select batch_id, count(*) as n, count(case when status = 'Completed' then 1 end) as done, count(case when status in ('Failed', 'Cancelled') then 1 end) as bad from v_exec group by batch_id) t")
def _(v):
    groups = v.executions.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "Completed").alias("done"), F.count_if(F.col("status").isin("Failed", "Cancelled")).alias("bad"))
    quorum = F.expr("n div 2 + 1")
    return groups.select(
        "batch_id", "n", "done",
        F.when(F.col("bad") > 0, "fail").otherwise("ok").alias("wait_all"),
        F.when(F.col("done") > 0, "ok").otherwise("fail").alias("wait_any"),
        F.when(F.col("done") >= quorum, "ok").when(F.col("bad") > F.col("n") - quorum, "fail").otherwise("open").alias("wait_majority"),
    )


@key("decision_route", "select event_id, case when has_k and try_cast(k as double) > 66 then 'high' when has_k and try_cast(k as double) > 33 then 'middle' else 'else' end as branch from v_param")
def _(v):
    from ..functions.conditions import Condition, compile_condition

    holds = lambda x: compile_condition(Condition("k", "GreaterThan", x), F.col("k"), F.col("has_k"))
    return v.params.select("event_id", F.when(holds("66"), "high").when(holds("33"), "middle").otherwise("else").alias("branch"))


@key("wf_run_if", "select event_id, case when coalesce(has_k and try_cast(k as double) >= 50, false) then 'Pending' else 'Skipped' end as status from v_param")
def _(v):
    from ..functions.conditions import Condition, compile_condition

    return v.params.select("event_id", F.when(compile_condition(Condition("k", "GreaterThanOrEqual", "50"), F.col("k"), F.col("has_k")), "Pending").otherwise("Skipped").alias("status"))


@key("wf_sequence", "select batch_id, count(*) as steps, count(case when step_order < coalesce(f, 99) then 1 end) as ran_before_failure from (select batch_id, step_order, min(case when status = 'Failed' then step_order end) over (partition by batch_id) as f from v_exec) t group by batch_id")
def _(v):
    failed = F.min(F.when(F.col("status") == "Failed", F.col("step_order"))).over(Window.partitionBy("batch_id"))  # one run's steps; the count below shares the exchange
    rows = v.executions.select("batch_id", "step_order", "status").withColumn("f", failed)
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("step_order") < F.coalesce("f", F.lit(99))).alias("ran_before_failure"))


@key("shadow_status", "select execution_id, case when status = 'Cancelled' then 'Failed' else status end as status from v_exec where worker_name <> 'worker-1'")
def _(v):
    return v.executions.where("worker_name <> 'worker-1'").select("execution_id", F.when(F.col("status") == "Cancelled", "Failed").otherwise(F.col("status")).alias("status"))


@key("unregistered_jobs", "select distinct job_name from v_exec where job_name not in (select 'Job.'||cast(p_partkey % 15 as string) from part)")
def _(v):
    known = v.table("part").select(F.concat(F.lit("Job."), (F.col("p_partkey") % 15).cast("string")).alias("job_name")).distinct()
    return v.executions.select("job_name").distinct().join(known, "job_name", "left_anti")


@key("merge_params", "select event_id, coalesce(case when event_id % 3 = 0 then 'step' end, case when event_id % 2 = 0 then 'accumulated' end, 'initial') as origin from events")
def _(v):
    layer = lambda name, where: F.when(where, F.create_map(F.lit("origin"), F.lit(name))).otherwise(F.create_map().cast("map<string,string>"))
    later = lambda a, b: F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))
    n = F.col("event_id")
    merged = later(later(layer("initial", F.lit(True)), layer("accumulated", n % 2 == 0)), layer("step", n % 3 == 0))
    return v.events.select("event_id", merged["origin"].alias("origin"))


@key("declared_param_errors", "select p_partkey as ord, case when p_partkey % 5 = 0 then 'blank name' when p_partkey % 7 = 0 then 'reserved prefix' when p_partkey % 11 = 0 then 'duplicate' end as problem from part where p_partkey % 5 = 0 or p_partkey % 7 = 0 or p_partkey % 11 = 0")
def _(v):
    n = F.col("p_partkey")
    name = F.when(n % 5 == 0, F.lit(" ")).when(n % 7 == 0, F.lit("system.x")).when(n % 11 == 0, F.lit("same")).otherwise(F.concat(F.lit("p"), n.cast("string")))
    rows = v.table("part").select(n.alias("ord"), name.alias("name"))
    twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and trim(name) <> ''").select("name", F.lit(True).alias("twice"))
    problem = F.when(F.trim("name") == "", "blank name").when(F.startswith("name", F.lit("system.")), "reserved prefix").when(F.col("twice"), "duplicate")
    return rows.join(twice, "name", "left").select("ord", problem.alias("problem")).where("problem is not null")


@key("worker_override", "select event_id, case when n is null then 8 else least(greatest(n, 1), 128) end as workers from (select event_id, try_cast(case when event_id % 3 = 0 then k when event_id % 3 = 1 then 'many' else cast(event_id as string) end as int) as n from v_param) t")
def _(v):
    asked = F.when(F.col("event_id") % 3 == 0, F.col("k")).when(F.col("event_id") % 3 == 1, F.lit("many")).otherwise(F.col("event_id").cast("string"))
    number = asked.try_cast("int")
    bounded = F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(1)), F.lit(MOST_WORKERS)))
    return v.params.select("event_id", F.coalesce(bounded, F.lit(8)).alias("workers"))


# Items.
@key("partitioned_source", "select l_orderkey as batch_id, l_linenumber as item, l_quantity as amount from lineitem where l_quantity > 25")
def _(v):
    return v.table("lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("batch_id"), F.col("l_linenumber").alias("item"), F.col("l_quantity").alias("amount"))


@key("partitioned_map", "select event_id, user_id * 3 + event_id % 5 as result from events")
def _(v):
    return v.events.select("event_id", (F.col("user_id") * 3 + F.col("event_id") % 5).alias("result"))


@key("partitioned_finalize", "select job_name, count(*) as items, cast(sum(processed) as bigint) as processed from v_exec where status <> 'Failed' group by job_name")
def _(v):
    return v.executions.where("status <> 'Failed'").groupBy("job_name").agg(F.count(F.lit(1)).alias("items"), F.sum("processed").alias("processed"))


@key("finalize_once", "select count(*) filter (where event_id % 5 <> 0) as completed, count(*) filter (where event_id % 5 = 0) as failed, cast(1 as bigint) as finalized from events")
def _(v):
    """Items of any outcome are worked on, and then the whole of them is finalised in one call, whose file is read."""
    folder = new_folder(v.spark, "finalized")
    finalize(process_items(v.events.select("event_id"), _flaky, "long", "continue"), folder)
    return v.spark.read.schema("completed long, failed long, finalized long").json(f"{folder}/finalized.json")


@key("item_policy_continue", "select count(*) filter (where l_linenumber % 5 <> 0) as processed, count(*) filter (where l_linenumber % 5 = 0) as failed from lineitem")
def _(v):
    good = F.try_divide(F.lit(1), F.col("l_linenumber") % 5).isNotNull()
    return v.table("lineitem").agg(F.count_if(good).alias("processed"), F.count_if(~good).alias("failed"))


def _flaky(row):
    if row["event_id"] % 5 == 0:
        raise ValueError("item fails")
    return int(row["event_id"]) * 2


@key("item_policy_retry", "select event_id, case when event_id % 5 = 0 then 'Failed' else 'Completed' end as outcome, case when event_id % 5 = 0 then 2 else 1 end as attempts, case when event_id % 5 <> 0 then event_id * 2 end as result from events")
def _(v):
    items = v.events.select("event_id")
    return process_items(items, _flaky, "long", "retry_then_continue", retries=1, delay=0.0).select("event_id", "outcome", "attempts", "result")


@key("item_policy_failfast", "select event_id from events where event_type is not null")
def _(v):
    """An item without a type would end the query; what comes out has one."""
    checked = F.when(F.col("event_type").isNull(), F.raise_error(F.lit("item fails"))).otherwise(F.col("event_id"))
    return v.events.select(checked.cast("long").alias("event_id"))


@key("worker_index", "select count(*) as items, true as within_workers from events")
def _(v):
    """Every item sees the index of the worker that has it, counted from 0."""
    seen = v.events.repartition(8, "event_id").select(F.spark_partition_id().alias("worker"))
    return seen.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.bool_and(F.col("worker").between(0, 7)), F.lit(True)).alias("within_workers"))
