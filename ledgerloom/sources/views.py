"""Ledger-shaped views over the star-schema tables: executions, runs, definitions, gates, parameter bags.

The select lists are valid in Spark SQL and in ANSI SQL, so an oracle can use them as they are.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..operators import step_tree

V_EXEC = """
select cast(l_orderkey as string)||'-'||cast(l_linenumber as string)||'-'||cast(l_partkey as string)||'-'||
       cast(l_suppkey as string)||'-'||cast(cast(l_quantity as int) as string)||'-'||cast(cast(l_shipdate as date) as string) as execution_id,
       'Job.'||cast(l_partkey % 20 as string) as job_name,
       l_orderkey as batch_id,
       case when l_linenumber = 7 then null else l_linenumber end as batch_step_id,
       l_linenumber as step_order,
       case when l_linenumber = 6 then null else l_orderkey % 50 end as batch_definition_id,
       case when l_returnflag='N' then 'Completed'
            when l_returnflag='R' and l_linestatus='F' then 'Failed'
            when l_returnflag='R' then case l_partkey % 12 when 0 then 'Pending' when 1 then 'Scheduled' when 2 then 'Retrying' when 3 then 'AwaitingApproval' when 4 then 'Cancelling' else 'Running' end
            when l_linestatus='F' then 'Cancelled' else 'Skipped' end as status,
       l_shipdate as enqueued_at,
       case when l_returnflag='R' and l_linestatus='O' then null else l_shipdate + interval '1' hour end as completed_at,
       case when l_returnflag='R' and l_linestatus='F' then 'ERR_'||cast(l_partkey % 100 as string)||'% capacity' end as last_error,
       'worker-'||cast(l_suppkey as string) as worker_name,
       cast(l_quantity as int) as processed, cast(round(l_discount*100) as int) as failed_items, 60 as total_items
from lineitem"""
V_RUN = """
select o_orderkey as batch_id, o_custkey as batch_definition_id,
       case o_orderstatus when 'P' then null when 'F' then 'Failed' else 'Completed' end as status,
       o_orderdate as started_at,
       case o_orderstatus when 'P' then null else o_orderdate + interval '2' hour end as completed_at,
       case when o_orderkey % 5 = 0 then null else cast(o_orderkey % 4 as int) end as current_step_index,
       case when o_orderkey % 11 = 0 then 2 end as compensation_step_index,
       case when o_orderkey % 9 = 0 and o_orderkey > 9 then o_orderkey - 9 end as retry_of_batch_id,
       cast(o_orderkey % 6 as int) as succeeded, o_orderpriority as triggered_by,
       cast(3 + o_custkey % 3 + o_custkey % 4 + case when o_orderkey % 8 = 0 then 1 else 0 end as int) as step_count
from orders"""
V_DEF = """
select cast(c_custkey as string) as id,
       case when c_mktsegment='BUILDING' then 'Code' when c_mktsegment in ('MACHINERY','HOUSEHOLD') then 'Dashboard' else 'Api' end as source,
       'batch-'||cast(c_custkey % 400 as string) as name,
       case when c_custkey % 12 = 0 then '30 15,45 9-17/4 * * MON-FRI' when c_custkey % 12 = 3 then '0 0 12 29 2 ?' when c_custkey % 12 = 6 then '10 5 0 1 * *'
            when c_custkey % 3 = 0 then '0 */'||cast(5 + c_custkey % 20 as string)||' * * * *' when c_custkey % 3 = 1 then '' end as schedule,
       c_custkey % 7 <> 0 as schedule_enabled,
       case when c_custkey % 4 <> 0 then cast(c_custkey % 4 * 5 as int) end as catch_up_minutes,
       cast(c_custkey % 5 as int) as version,
       cast(3 + c_custkey % 3 as int) as top_steps, cast(3 + c_custkey % 3 + c_custkey % 4 as int) as step_count
from customer"""
V_GATE = """
select cast(o_orderkey as string) as approval_id, o_orderkey as batch_id, o_orderkey % 4 as step_id, o_orderdate as pending_since,
       o_orderdate + interval '3' day as deadline,
       case o_orderpriority when '1-URGENT' then 'Fail' when '2-HIGH' then 'AutoApprove' else 'Hold' end as on_timeout,
       case when o_orderkey % 7 = 0 then '*,dev' when o_orderkey % 5 = 0 then '*' when o_orderkey % 5 = 1 then 'ops' when o_orderkey % 5 = 2 then 'ops,dev' when o_orderkey % 5 = 3 then 'admin' else '' end as allowed_roles
from orders where o_orderstatus='P'"""
V_PARAM = """
select event_id, user_id, ts, event_type, value,
       case when event_id % 10 = 0 then null else cast(regexp_extract(props,'([0-9]+)',1) as string) end as k,
       event_id % 7 <> 0 as has_k
from events"""
V_HEAD = """
select c_custkey as definition_id, case when c_nationkey = 3 then ' ' else c_name end as name, cast(c_custkey % 4 as int) as failure_policy,
       case when c_nationkey % 2 = 0 then cast(floor(c_acctbal) as bigint) end as catch_up_seconds
from customer"""
V_STEP = """
select definition_id, ord, part, step_id, step_type, has_payload, job_name, service, join_policy, title, on_timeout, timeout_s, comp_job, has_cond, cond_key, cond_op, cond_value,
       row_number() over (partition by definition_id, part order by started, ord) - 1 as pos
from (
  select o_custkey as definition_id, o_orderkey as ord, o_orderdate as started, case when o_orderstatus = 'F' and o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then 'failure' else 'main' end as part,
         case when t % 40 = 0 then ' ' when t % 40 = 1 then 's'||cast(t % 7 as string)||':comp' else 's'||cast(t % 400 as string) end as step_id,
         case o_orderpriority when '1-URGENT' then 'ParallelGroup' when '2-HIGH' then 'Decision' when '3-MEDIUM' then 'ApprovalGate' else case when t % 30 = 7 then 'Wait' else 'Job' end end as step_type,
         t % 25 <> 3 as has_payload, case when t % 20 = 5 then '' else 'Job.'||cast(t % 20 as string) end as job_name, case when t % 8 = 1 then 'billing' when t % 8 = 2 then ' ' end as service,
         cast(o_orderkey % 4 as int) as join_policy, case when t % 15 = 4 then null else 'Approve '||cast(t % 9 as string) end as title, cast(o_orderkey % 3 as int) as on_timeout,
         case t % 3 when 0 then null when 1 then 0 else 3600 end as timeout_s, case t % 6 when 0 then '' when 1 then 'Undo.'||cast(t % 4 as string) end as comp_job,
         t % 5 = 2 as has_cond, case when t % 35 = 2 then ' ' else 'k' end as cond_key, cast(t % 13 as int) as cond_op, case t % 4 when 0 then null when 1 then 'many' when 2 then '10.5' else '7' end as cond_value
  from (select *, cast(floor(o_totalprice) as bigint) as t from orders) o) s"""
V_CHILD = """
select l_orderkey as parent, l_linenumber as ord, case l_partkey % 50 when 0 then '' when 1 then 'c:comp' else 'c'||cast(l_partkey % 300 as string) end as step_id,
       case l_partkey % 17 when 3 then 'ApprovalGate' when 4 then 'ParallelGroup' when 5 then 'Decision' else 'Job' end as step_type, l_suppkey % 20 <> 0 as has_job,
       case when l_suppkey % 20 = 1 then ' ' else 'Job.'||cast(l_partkey % 20 as string) end as job_name, case when l_partkey % 9 = 1 then 'billing' end as service,
       case l_suppkey % 9 when 0 then ' ' when 1 then ' Fast ' end as label, case l_partkey % 19 when 0 then 'Undo' when 1 then '' end as comp_job,
       l_tax > 0.015 as has_when, l_tax > 0.075 as has_cond, case when l_suppkey % 11 = 0 then '  ' else 'k' end as cond_key, cast(l_partkey % 13 as int) as cond_op,
       case l_suppkey % 4 when 0 then null when 1 then 'many' when 2 then '10.5' else '7' end as cond_value,
       row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_shipdate) - 1 as pos
from lineitem"""
SELECTS = {"v_exec": V_EXEC, "v_run": V_RUN, "v_def": V_DEF, "v_gate": V_GATE, "v_param": V_PARAM, "v_head": V_HEAD, "v_step": V_STEP, "v_child": V_CHILD}
BASE = {"v_exec": "lineitem", "v_run": "orders", "v_def": "customer", "v_gate": "orders", "v_param": "events", "v_head": "customer", "v_step": "orders", "v_child": "lineitem"}
#: What the windows of a view go along: its table is shuffled by that first, as its own columns are narrower than the view's.
ALONG = {"v_step": "o_custkey", "v_child": "l_orderkey"}


class Views:
    """The views over one folder of Parquet tables; each reads its own columns only."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        rows = self.table(BASE[name])
        rows = rows.repartition(ALONG[name]) if name in ALONG else rows
        return self.spark.sql(SELECTS[name].replace(f"from {BASE[name]}", "from {t}"), t=rows)

    executions = cached_property(lambda self: self._view("v_exec"))
    runs = cached_property(lambda self: self._view("v_run"))
    definitions = cached_property(lambda self: self._view("v_def"))
    gates = cached_property(lambda self: self._view("v_gate"))
    params = cached_property(lambda self: self._view("v_param"))
    events = cached_property(lambda self: self.table("events"))
    steps = cached_property(lambda self: self._view("v_step"))
    heads = cached_property(lambda self: self._view("v_head"))
    children = cached_property(lambda self: self._view("v_child"))

    @cached_property
    def trees(self) -> DataFrame:
        """Definitions as trees: one row each, with its steps, their children and branches, and the steps after a failure."""
        return step_tree.assembled(self.heads, self.steps, self.children)


def with_views(sql: str) -> str:
    """The SQL with the views that it names as common table expressions."""
    used = [f"{name} as ({body})" for name, body in SELECTS.items() if name in sql]
    if not used:
        return sql
    head, rest = ("with recursive ", sql[len("with recursive ") :]) if sql.startswith("with recursive ") else ("with ", sql[len("with ") :]) if sql.startswith("with ") else ("with ", None)
    return head + ", ".join(used) + (", " + rest if rest is not None else "\n" + sql)
