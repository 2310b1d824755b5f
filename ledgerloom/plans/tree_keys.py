"""Definitions as trees: their nodes, edges, errors and step counts, held against rules over the flat tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import step_tree
from .registry import key

#: Children of groups and branches of decisions that have a payload, beside their step.
_KIDS = "kid as (select k.*, s.definition_id, s.part, s.pos as step_pos, s.ord as step_ord, s.step_id as owner, s.step_type as owner_type from v_child k join v_step s on s.ord = k.parent where s.has_payload and s.step_type in ('ParallelGroup', 'Decision'))"
_OPS = "['Equals','NotEquals','GreaterThan','GreaterThanOrEqual','LessThan','LessThanOrEqual','Exists','NotExists','IsTrue','IsFalse','Contains']"
_PLACE = "case part when 'main' then 'Steps[' else 'OnFailureSteps[' end||cast({pos} as varchar)||']'"

key("step_nodes", f"""with {_KIDS} select definition_id, part, cast(pos as varchar) as path, 0 as level, step_id, step_type from v_step
union all select definition_id, part, cast(step_pos as varchar)||'.'||cast(pos as varchar), 1, step_id, case owner_type when 'Decision' then 'Job' else step_type end from kid""")(lambda v: step_tree.nodes(v.trees))

key("tree_step_count", f"""with {_KIDS}, inner_ as (select parent, count(*) as n from kid group by parent)
select c.definition_id, cast(coalesce(sum(case when s.part = 'failure' then 1 else case when s.has_payload and s.step_type in ('ParallelGroup', 'Decision') then coalesce(n, 0) else 1 end + case when comp_job is not null then 1 else 0 end end), 0) as bigint) as steps
from v_head c left join v_step s on s.definition_id = c.definition_id left join inner_ i on i.parent = s.ord group by c.definition_id""")(lambda v: step_tree.step_count(v.trees))

_LABEL = f"""case when trim(coalesce(label, '')) <> '' then trim(label) when not has_when or trim(cond_key) = '' then 'else' when cond_op = 6 then trim(cond_key)||' exists' when cond_op = 7 then trim(cond_key)||' not set' when cond_op = 8 then trim(cond_key)||' is true'
  when cond_op = 9 then trim(cond_key)||' is false' else trim(cond_key)||' '||coalesce(['=','≠','>','≥','<','≤','','','','','contains'][cond_op + 1], cast(cond_op as varchar))||' '||coalesce(cond_value, '') end"""

key("definition_edges", f"""with {_KIDS},
spine as (select *, row_number() over (partition by definition_id order by ord) as i, count(*) over (partition by definition_id) as n,
  case when has_payload and step_type = 'ParallelGroup' then 'g' when has_payload and step_type = 'Decision' then 'd' else 's' end as form from v_step where part = 'main'),
entry as (select definition_id, i, form, step_id as node from spine where form <> 'g' union all select s.definition_id, s.i, s.form, k.step_id from spine s join kid k on k.parent = s.ord where form = 'g'),
leave as (select definition_id, i, n, form, comp_job, step_id, step_id as node from spine where form = 's' union all select s.definition_id, s.i, s.n, s.form, s.comp_job, s.step_id, k.step_id from spine s join kid k on k.parent = s.ord where form <> 's'),
fallen as (select definition_id, step_id, row_number() over (partition by definition_id order by ord) as i from v_step where part = 'failure')
select l.definition_id, l.node as source, e.node as target, case when e.form = 'g' or l.form <> 's' then 'Parallel' else 'Sequential' end as kind, l.form <> 's' as is_fan_in, null as label from leave l join entry e on e.definition_id = l.definition_id and e.i = l.i + 1
union all select k.definition_id, owner, k.step_id, 'Decision', false, {_LABEL} from kid k where part = 'main' and owner_type = 'Decision'
union all select l.definition_id, l.node, f.step_id, 'OnFailure', false, null from leave l join fallen f on f.definition_id = l.definition_id and l.i = l.n and f.i = 1
union all select a.definition_id, a.step_id, b.step_id, 'OnFailure', false, null from fallen a join fallen b on b.definition_id = a.definition_id and b.i = a.i + 1
union all select definition_id, node, step_id||':comp', 'Compensation', false, null from leave where comp_job is not null""")(lambda v: step_tree.edges(v.trees))


def _wrong(source: str, *rules: tuple[str, str, str]) -> str:
    """Rows of errors: each rule is a condition, what follows the path, and a message as SQL."""
    return " union all ".join(f"select definition_id, {path} as path, {message} as message from {source} where {where}" for where, path, message in rules)


def _conditions(source: str, there: str, path: str) -> str:
    name, unary = f"{_OPS}[cond_op + 1]", "cond_op in (6, 7, 8, 9)"
    return _wrong(
        source,
        (f"{there} and trim(cond_key) = ''", f"{path}||'.ParameterKey'", "'must be non-empty'"),
        (f"{there} and cond_op not between 0 and 10", f"{path}||'.Operator'", "'unknown enum value '||cast(cond_op as varchar)"),
        (f"{there} and cond_op between 0 and 10 and not {unary} and coalesce(cond_value, '') = ''", f"{path}||'.Value'", f"'required for the '||{name}||' operator'"),
        (f"{there} and cond_op between 2 and 5 and cond_value is not null and try_cast(cond_value as double) is null", f"{path}||'.Value'", f"'must be a number for the '||{name}||' operator'"),
    )


_ID = [("trim(step_id) = ''", "p||'.StepId'", "'must be non-empty'"), ("step_id like '%:comp'", "p||'.StepId'", "'must not end with the reserved compensator suffix '':comp'''")]
_ERRORS = f"""{_KIDS},
step as (select *, {_PLACE.format(pos="pos")} as p, (select count(*) from kid k where k.parent = s.ord) as n from v_step s),
child as (select *, {_PLACE.format(pos="step_pos")}||'.ParallelGroup.Steps['||cast(pos as varchar)||']' as p from kid where owner_type = 'ParallelGroup'),
branch as (select *, {_PLACE.format(pos="step_pos")}||'.Decision.Branches['||cast(pos as varchar)||']' as p, coalesce(bool_or(not has_when) over (partition by parent order by pos rows between unbounded preceding and 1 preceding), false) as late from kid where owner_type = 'Decision'),
ids as (select definition_id, step_id as id from v_step union all select definition_id, step_id||':comp' from v_step where part = 'main' and comp_job is not null union all select definition_id, step_id from kid where part = 'main'),
head as (select definition_id, name, failure_policy, catch_up_seconds, (select count(*) from v_step s where s.definition_id = h.definition_id and s.part = 'main') as n from v_head h),
errors as ({_wrong("head", ("trim(name) = ''", "'Name'", "'must be non-empty'"), ("n = 0", "'Steps'", "'must contain at least one step'"), ("failure_policy not between 0 and 2", "'FailurePolicy'", "'unknown enum value '||cast(failure_policy as varchar)"), ("catch_up_seconds < 0", "'ScheduleCatchUpWindow'", "'must be non-negative'"))}
union all {_wrong("step", *_ID,
  ("step_type = 'Job' and not has_payload", "p||'.Job'", "'Job step requires Job payload'"), ("step_type = 'Job' and has_payload and trim(job_name) = ''", "p||'.Job.JobName'", "'must be non-empty'"),
  ("step_type = 'ApprovalGate' and not has_payload", "p||'.Approval'", "'ApprovalGate step requires payload'"), ("step_type = 'ApprovalGate' and has_payload and title is null", "p||'.Approval.Title'", "'must be non-empty'"),
  ("step_type = 'ApprovalGate' and has_payload and on_timeout <> 0 and coalesce(timeout_s, 0) <= 0", "p||'.Approval.Timeout'", "'required when the on-timeout action is AutoApprove or Hold'"),
  ("step_type = 'ParallelGroup' and not has_payload", "p||'.ParallelGroup'", "'ParallelGroup step requires payload'"), ("step_type = 'ParallelGroup' and has_payload and join_policy > 2", "p||'.ParallelGroup.JoinPolicy'", "'unknown enum value '||cast(join_policy as varchar)"),
  ("step_type = 'ParallelGroup' and has_payload and n < 2", "p||'.ParallelGroup.Steps'", "'ParallelGroup must contain >=2 children'"), ("step_type = 'ParallelGroup' and has_payload and join_policy = 2 and n < 3", "p||'.ParallelGroup.Steps'", "'WaitMajority requires >=3 children (degenerate with fewer; use WaitAll instead)'"),
  ("step_type = 'Decision' and not has_payload", "p||'.Decision'", "'Decision step requires payload'"), ("step_type = 'Decision' and has_payload and n < 1", "p||'.Decision.Branches'", "'Decision must contain at least one branch'"),
  ("part = 'main' and comp_job is not null and step_type = 'ApprovalGate'", "p||'.Compensation'", "'an ApprovalGate step cannot have a compensator'"), ("part = 'failure' and comp_job is not null", "p||'.Compensation'", "'compensation is not allowed here (only on top-level Job, ParallelGroup, or Decision steps)'"),
  ("comp_job = ''", "p||'.Compensation.JobName'", "'must be non-empty'"), ("part = 'failure' and has_cond", "p||'.Condition'", "'a run-if condition is not allowed here (only on top-level steps)'"))}
union all {_conditions("step", "has_cond", "p||'.Condition'")}
union all {_wrong("child", *_ID,
  ("step_type = 'Job' and not has_job", "p||'.Job'", "'Job step requires Job payload'"), ("step_type = 'Job' and has_job and trim(job_name) = ''", "p||'.Job.JobName'", "'must be non-empty'"), ("step_type = 'ApprovalGate' and not has_job", "p||'.Approval'", "'ApprovalGate step requires payload'"),
  ("step_type = 'ParallelGroup'", "p||'.StepType'", "'Nested ParallelGroup steps are forbidden in v0.1'"), ("step_type = 'Decision'", "p||'.Decision'", "'Decision step requires payload'"),
  ("comp_job is not null", "p||'.Compensation'", "'compensation is not allowed here (only on top-level Job, ParallelGroup, or Decision steps)'"), ("comp_job = ''", "p||'.Compensation.JobName'", "'must be non-empty'"), ("has_cond", "p||'.Condition'", "'a run-if condition is not allowed here (only on top-level steps)'"))}
union all {_conditions("child", "has_cond", "p||'.Condition'")}
union all {_wrong("branch", *_ID, ("not has_job", "p||'.Job'", "'Decision branch requires Job payload'"), ("has_job and trim(job_name) = ''", "p||'.Job.JobName'", "'must be non-empty'"),
  ("late and not has_when", "p||'.When'", "'a Decision may have at most one else (unconditional) branch'"), ("late and has_when", "p||'.When'", "'the else (unconditional) branch must be the last branch'"))}
union all {_conditions("branch", "has_when", "p||'.When'")}
union all select definition_id, 'StepId', 'duplicate step id '''||id||''' — every step id in a definition must be unique' from ids where trim(id) <> '' group by definition_id, id having count(*) > 1)"""

key("definition_errors", f"with {_ERRORS} select * from errors")(lambda v: step_tree.errors(v.trees))

key("errors_by_rule", f"with {_ERRORS} select regexp_replace(path, '[0-9]+', '#', 'g') as rule, message, count(*) as n from errors where path <> 'StepId' group by all")(
    lambda v: step_tree.errors(v.trees).where("path <> 'StepId'").groupBy(F.regexp_replace("path", "[0-9]+", "#").alias("rule"), "message").agg(F.count(F.lit(1)).alias("n"))
)


@key("trigger_errors", f"""with {_ERRORS},
job as (select definition_id, 'step '''||step_id||'''' as step, job_name, service from v_step where step_type = 'Job' and has_payload
  union all select definition_id, 'step '''||step_id||''' compensator', comp_job, null from v_step where part = 'main' and comp_job is not null
  union all select definition_id, 'step '''||step_id||'''', job_name, service from kid where part = 'main' and has_job and (owner_type = 'Decision' or step_type <> 'ApprovalGate'))
select * from errors union all
select definition_id, step, 'job '''||job_name||''' is not registered' from job where job_name <> '' and trim(coalesce(service, '')) = '' and job_name not in (select 'Job.'||cast(p_partkey % 15 as varchar) from part)""")
def _(v):
    """Errors of structure and unknown jobs; the registry is the parts' fifteen jobs."""
    registered = v.table("part").select(F.concat(F.lit("Job."), (F.col("p_partkey") % 15).cast("string")).alias("job_name"))
    return step_tree.trigger_errors(v.trees, registered)
