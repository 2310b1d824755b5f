"""Definitions of workflows as trees in columns: their nodes, edges, errors, jobs and step counts.

A definition is one row with an array of steps. A group holds children, a decision branches, and any step of
the main sequence may hold a compensator and a condition; ``failure_steps`` are run after a
failed run. All rules are expressions over one row, so none of them shuffles; what comes out are arrays
that are exploded, one row a node, edge or error.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.conditions import NUMBER

#: Operators, policies and actions by their number, the reserved ending of ids, and the symbols of labels.
OPERATORS = ("Equals", "NotEquals", "GreaterThan", "GreaterThanOrEqual", "LessThan", "LessThanOrEqual", "Exists", "NotExists", "IsTrue", "IsFalse", "Contains")
UNARY, ORDERING = ("Exists", "NotExists", "IsTrue", "IsFalse"), OPERATORS[2:6]
JOIN_POLICIES, FAILURE_POLICIES, TIMEOUT_ACTIONS = ("WaitAll", "WaitAny", "WaitMajority"), ("StopOnFailure", "ContinueOnFailure", "Compensate"), ("Fail", "AutoApprove", "Hold")
RESERVED = ":comp"
SYMBOLS = {"Equals": "=", "NotEquals": "≠", "GreaterThan": ">", "GreaterThanOrEqual": "≥", "LessThan": "<", "LessThanOrEqual": "≤", "Contains": "contains"}
PHRASES = {"Exists": "exists", "NotExists": "not set", "IsTrue": "is true", "IsFalse": "is false"}

_CONDITION, _JOB = "struct<key:string,op:int,value:string>", "struct<job_name:string,service:string>"
_COMMON = f"ord:bigint,step_id:string,step_type:string,job:{_JOB},approval:struct<title:string,on_timeout:int,timeout_s:int>,compensation:{_JOB},condition:{_CONDITION}"
CHILD = f"struct<{_COMMON}>"
BRANCH = f"struct<step_id:string,label:string,job:{_JOB},when:{_CONDITION}>"
STEP = f"struct<{_COMMON},group:struct<join_policy:int,steps:array<{CHILD}>>,decision:struct<branches:array<{BRANCH}>>>"
ERROR, EDGE = "array<struct<path:string,message:string>>", "array<struct<source:string,target:string,kind:string,is_fan_in:boolean,label:string>>"


def assembled(heads: DataFrame, steps: DataFrame, children: DataFrame) -> DataFrame:
    """The trees of flat tables of definitions, steps and children; places in a list are in ``pos``."""
    record = lambda where, **fields: F.when(where, F.struct(*[F.col(c).alias(n) if isinstance(c, str) else c.alias(n) for n, c in fields.items()]))
    job, gate = record(F.col("has_job"), job_name="job_name", service="service"), F.col("step_type") == "ApprovalGate"
    undo = record(F.col("comp_job").isNotNull(), job_name="comp_job", service=F.lit(None).cast("string"))
    check = record(F.col("has_cond"), key="cond_key", op="cond_op", value="cond_value")
    approval = record(gate & F.col("has_job"), title=F.lit("Approve"), on_timeout=F.lit(0), timeout_s=F.lit(None).cast("int"))
    child = F.struct(F.col("ord").cast("long").alias("ord"), "step_id", "step_type", F.when(~gate, job).alias("job"), approval.alias("approval"), undo.alias("compensation"), check.alias("condition"))
    branch = F.struct("step_id", "label", job.alias("job"), record(F.col("has_when"), key="cond_key", op="cond_op", value="cond_value").alias("when"))
    inner = children.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("pos", child.alias("child"), branch.alias("branch")))).alias("inner"))
    rows = steps.join(inner.withColumnRenamed("parent", "ord"), "ord", "left")
    is_a = lambda kind: F.col("has_payload") & (F.col("step_type") == kind)
    held = lambda name, kind: F.coalesce(F.transform("inner", lambda x: x[name]), F.array().cast(f"array<{kind}>"))
    step = F.struct(
        F.col("ord").cast("long").alias("ord"), "step_id", "step_type", record(is_a("Job"), job_name="job_name", service="service").alias("job"),
        record(is_a("ApprovalGate"), title="title", on_timeout="on_timeout", timeout_s="timeout_s").alias("approval"), undo.alias("compensation"), check.alias("condition"),
        record(is_a("ParallelGroup"), join_policy="join_policy", steps=held("child", CHILD)).alias("group"), record(is_a("Decision"), branches=held("branch", BRANCH)).alias("decision"),
    ).cast(STEP)
    parts = rows.select("definition_id", "part", F.struct("pos", step.alias("step")).alias("x"))
    own = lambda part: F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.col("x")))), lambda x: x["step"])
    trees = parts.groupBy("definition_id").agg(own("main").alias("steps"), own("failure").alias("failure_steps"))
    none = F.array().cast(f"array<{STEP}>")
    return heads.join(trees, "definition_id", "left").withColumns({c: F.coalesce(c, none) for c in ("steps", "failure_steps")})


def blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _in_order(steps: Column) -> Column:
    """Steps by their number, equal ones as they are listed."""
    return F.transform(F.sort_array(F.transform(steps, lambda s, i: F.struct(s["ord"].alias("ord"), i.alias("i"), s.alias("s")))), lambda x: x["s"])


def _children(step: Column) -> Column:
    return F.coalesce(step["group"]["steps"], _empty(f"array<{CHILD}>"))


def _branches(step: Column) -> Column:
    return F.coalesce(step["decision"]["branches"], _empty(f"array<{BRANCH}>"))


def _is_group(step: Column) -> Column:
    return F.coalesce((step["step_type"] == "ParallelGroup") & step["group"].isNotNull(), F.lit(False))


def _is_decision(step: Column) -> Column:
    return F.coalesce((step["step_type"] == "Decision") & step["decision"].isNotNull(), F.lit(False))


def condition_text(condition: Column) -> Column:
    """A condition in words; ``else`` where there is none."""
    op, key, text = condition["op"], F.trim(condition["key"]), F.lit(None).cast("string")
    for i, name in enumerate(OPERATORS):
        said = F.concat(key, F.lit(f" {PHRASES[name]}")) if name in PHRASES else F.concat(key, F.lit(f" {SYMBOLS[name]} "), F.coalesce(condition["value"], F.lit("")))
        text = F.when(op == i, said).otherwise(text)
    unknown = F.concat_ws(" ", key, op.cast("string"), F.coalesce(condition["value"], F.lit("")))
    return F.when(condition.isNull() | blank(condition["key"]), "else").otherwise(F.coalesce(text, unknown))


def branch_label(branch: Column) -> Column:
    return F.when(blank(branch["label"]), condition_text(branch["when"])).otherwise(F.trim(branch["label"]))


def edges(trees: DataFrame) -> DataFrame:
    """``definition_id, source, target, kind, is_fan_in, label``, one row an edge between nodes that are drawn.

    A group is drawn by its children alone: what comes before leads to each of them, and each leads to what follows. A
    decision is a node that leads to its branches, which lead on. The first step after
    a failure follows whatever the sequence ends in, and a compensator its own step.
    """
    ids = lambda steps: F.transform(steps, lambda s: s["step_id"])

    def node(s: Column) -> Column:
        group, decision, one = _is_group(s), _is_decision(s), F.array(s["step_id"])
        within = ids(_in_order(_children(s)))
        return F.struct(
            F.when(group, within).otherwise(one).alias("entry"), F.when(group, within).when(decision, ids(_branches(s))).otherwise(one).alias("exit"),
            group.alias("group"), decision.alias("decision"), F.when(s["compensation"].isNotNull(), F.concat(s["step_id"], F.lit(RESERVED))).alias("undo"), s.alias("s"),
        )

    edge = lambda a, b, kind, fan_in=F.lit(False), label=F.lit(None).cast("string"): F.struct(a.alias("source"), b.alias("target"), kind.alias("kind"), fan_in.alias("is_fan_in"), label.alias("label"))
    product = lambda xs, ys, *how: F.flatten(F.transform(xs, lambda a: F.transform(ys, lambda b: edge(a, b, *how))))

    def before(x: Column, i: Column) -> Column:
        """Edges from the step before; none leads to the first."""
        last = F.get("spine", i - 1)
        fan_in = last["group"] | last["decision"]
        return F.when(i > 0, product(last["exit"], x["entry"], F.when(x["group"] | fan_in, "Parallel").otherwise("Sequential"), fan_in)).otherwise(_empty(EDGE))

    def inside(x: Column) -> Column:
        return F.when(x["decision"], F.transform(_branches(x["s"]), lambda b: edge(x["s"]["step_id"], b["step_id"], F.lit("Decision"), F.lit(False), branch_label(b)))).otherwise(_empty(EDGE))

    def undone(x: Column) -> Column:
        return F.when(x["undo"].isNotNull(), F.transform(x["exit"], lambda a: edge(a, x["undo"], F.lit("Compensation")))).otherwise(_empty(EDGE))

    failed = F.lit("OnFailure")
    end = F.coalesce(F.get("spine", F.size("spine") - 1)["exit"], _empty("array<string>"))
    chain = F.flatten(F.transform("fallen", lambda to, i: F.when(i == 0, F.transform(end, lambda a: edge(a, to, failed))).otherwise(F.array(edge(F.get("fallen", i - 1), to, failed)))))
    rows = trees.select("definition_id", F.transform(_in_order(F.col("steps")), node).alias("spine"), ids(_in_order(F.col("failure_steps"))).alias("fallen"))
    found = F.concat(F.flatten(F.transform("spine", before)), F.flatten(F.transform("spine", inside)), chain, F.flatten(F.transform("spine", undone)))
    return rows.select("definition_id", F.explode(found.cast(EDGE)).alias("e")).select("definition_id", "e.*")


def _error(wrong: Column, path: Column, message: str | Column) -> Column:
    return F.when(wrong, F.struct(path.alias("path"), (F.lit(message) if isinstance(message, str) else message).alias("message")))


def _condition_errors(c: Column, path: Column) -> list[Column]:
    """The shape of a condition: a key, a known operator, a value where it takes one, and a number where it orders."""
    at, known, there = lambda name: F.concat(path, F.lit(f".{name}")), c["op"].between(0, len(OPERATORS) - 1), c.isNotNull()
    name = F.get(F.array(*map(F.lit, OPERATORS)), F.when(known, c["op"]))
    missing = ~name.isin(*UNARY) & (F.coalesce(c["value"], F.lit("")) == "")
    return [
        _error(there & blank(c["key"]), at("ParameterKey"), "must be non-empty"),
        _error(there & ~F.coalesce(known, F.lit(False)), at("Operator"), F.concat(F.lit("unknown enum value "), F.coalesce(c["op"].cast("string"), F.lit("null")))),
        _error(there & known & missing, at("Value"), F.concat(F.lit("required for the "), name, F.lit(" operator"))),
        _error(there & known & ~missing & name.isin(*ORDERING) & ~c["value"].rlike(NUMBER), at("Value"), F.concat(F.lit("must be a number for the "), name, F.lit(" operator"))),
    ]


def _id_errors(s: Column, at: Callable[[str], Column]) -> list[Column]:
    ending = f"must not end with the reserved compensator suffix '{RESERVED}'"
    return [_error(blank(s["step_id"]), at("StepId"), "must be non-empty"), _error(~blank(s["step_id"]) & F.endswith(s["step_id"], F.lit(RESERVED)), at("StepId"), ending)]


def _all(*lists: list[Column] | Column) -> Column:
    return F.concat(*[F.array_compact(F.array(*x)).cast(ERROR) if isinstance(x, list) else F.coalesce(x, _empty(ERROR)) for x in lists])


def _branch_errors(branches: Column, path: Column) -> Column:
    """At most one branch has no condition, and it is the last."""
    first_else = F.array_position(F.transform(branches, lambda b: b["when"].isNull()), True)  # from 1; 0 is none

    def one(b: Column, i: Column) -> Column:
        own = F.concat(path, F.lit(".Decision.Branches["), i.cast("string"), F.lit("]"))
        at = lambda name: F.concat(own, F.lit(f".{name}"))
        late, always = (first_else > 0) & (first_else <= i), b["when"].isNull()
        return _all([
            *_id_errors(b, at), _error(b["job"].isNull(), at("Job"), "Decision branch requires Job payload"), _error(b["job"].isNotNull() & blank(b["job"]["job_name"]), at("Job.JobName"), "must be non-empty"),
            _error(late & always, at("When"), "a Decision may have at most one else (unconditional) branch"), _error(late & ~always, at("When"), "the else (unconditional) branch must be the last branch"),
            *_condition_errors(b["when"], at("When")),
        ])

    return F.flatten(F.transform(branches, one))


def _step_errors(s: Column, path: Column, nested: bool, main: bool) -> Column:
    """All that is wrong with a step; ``nested`` ones are children, and only ``main`` ones may have compensators and conditions."""
    at = lambda name: F.concat(path, F.lit(f".{name}"))
    kind, group, gate, undo = s["step_type"], None if nested else s["group"], s["approval"], s["compensation"]
    is_a = lambda name: F.coalesce(kind == name, F.lit(False))
    own = [
        *_id_errors(s, at),
        _error(is_a("Job") & s["job"].isNull(), at("Job"), "Job step requires Job payload"),
        _error(is_a("Job") & s["job"].isNotNull() & blank(s["job"]["job_name"]), at("Job.JobName"), "must be non-empty"),
        _error(is_a("ApprovalGate") & gate.isNull(), at("Approval"), "ApprovalGate step requires payload"),
        _error(is_a("ApprovalGate") & gate.isNotNull() & blank(gate["title"]), at("Approval.Title"), "must be non-empty"),
        _error(is_a("ApprovalGate") & gate.isNotNull() & (gate["on_timeout"] != 0) & ~F.coalesce(gate["timeout_s"] > 0, F.lit(False)), at("Approval.Timeout"), "required when the on-timeout action is AutoApprove or Hold"),
    ]
    inner = []
    if nested:
        own += [_error(is_a("ParallelGroup"), at("StepType"), "Nested ParallelGroup steps are forbidden in v0.1"), _error(is_a("Decision"), at("Decision"), "Decision step requires payload")]
    else:
        n, held = F.size(_children(s)), _is_group(s)
        policy = group["join_policy"]
        own += [
            _error(is_a("ParallelGroup") & group.isNull(), at("ParallelGroup"), "ParallelGroup step requires payload"),
            _error(held & ~F.coalesce(policy.between(0, len(JOIN_POLICIES) - 1), F.lit(False)), at("ParallelGroup.JoinPolicy"), F.concat(F.lit("unknown enum value "), policy.cast("string"))),
            _error(held & (n < 2), at("ParallelGroup.Steps"), "ParallelGroup must contain >=2 children"),
            _error(held & (policy == JOIN_POLICIES.index("WaitMajority")) & (n < 3), at("ParallelGroup.Steps"), "WaitMajority requires >=3 children (degenerate with fewer; use WaitAll instead)"),
            _error(is_a("Decision") & s["decision"].isNull(), at("Decision"), "Decision step requires payload"),
            _error(_is_decision(s) & (F.size(_branches(s)) < 1), at("Decision.Branches"), "Decision must contain at least one branch"),
        ]
        within = lambda c, j: _step_errors(c, F.concat(path, F.lit(".ParallelGroup.Steps["), j.cast("string"), F.lit("]")), True, False)
        inner = [F.when(held, F.flatten(F.transform(_children(s), within))), F.when(_is_decision(s), _branch_errors(_branches(s), path))]
    if main:
        own.append(_error(undo.isNotNull() & is_a("ApprovalGate"), at("Compensation"), "an ApprovalGate step cannot have a compensator"))
    else:
        own.append(_error(undo.isNotNull(), at("Compensation"), "compensation is not allowed here (only on top-level Job, ParallelGroup, or Decision steps)"))
        own.append(_error(s["condition"].isNotNull(), at("Condition"), "a run-if condition is not allowed here (only on top-level steps)"))
    own.append(_error(undo.isNotNull() & blank(undo["job_name"]), at("Compensation.JobName"), "must be non-empty"))
    return _all([*own, *_condition_errors(s["condition"], at("Condition"))], *inner)


def _repeated_ids() -> Column:
    """Ids that a definition uses more than once, at whatever level; a compensator's derived id is one of them."""
    each = lambda s: F.concat(
        F.array(s["step_id"]), F.when(s["compensation"].isNotNull(), F.array(F.concat(s["step_id"], F.lit(RESERVED)))).otherwise(_empty("array<string>")),
        F.when(_is_group(s), F.transform(_children(s), lambda c: c["step_id"])).otherwise(_empty("array<string>")), F.when(_is_decision(s), F.transform(_branches(s), lambda b: b["step_id"])).otherwise(_empty("array<string>")),
    )
    ids = F.sort_array(F.filter(F.concat(F.flatten(F.transform("steps", each)), F.transform("failure_steps", lambda s: s["step_id"])), lambda x: ~blank(x)))
    return F.transform(F.array(ids), lambda xs: F.array_distinct(F.filter(F.transform(xs, lambda x, i: F.when(x == F.get(xs, i - 1), x)), lambda x: x.isNotNull())))[0]


def errors(trees: DataFrame) -> DataFrame:
    """``definition_id, path, message`` of all that is wrong with the structure of definitions; sound ones have no row."""
    policy, twice = F.col("failure_policy"), F.transform(_repeated_ids(), lambda x: F.struct(F.lit("StepId").alias("path"), F.concat(F.lit("duplicate step id '"), x, F.lit("' — every step id in a definition must be unique")).alias("message")))
    head = [
        _error(blank(F.col("definition_id").cast("string")), F.lit("Id"), "must be non-empty"),
        _error(blank(F.col("name")), F.lit("Name"), "must be non-empty"),
        _error(F.size("steps") == 0, F.lit("Steps"), "must contain at least one step"),
        _error(~F.coalesce(policy.between(0, len(FAILURE_POLICIES) - 1), F.lit(False)), F.lit("FailurePolicy"), F.concat(F.lit("unknown enum value "), policy.cast("string"))),
        _error(F.col("catch_up_seconds") < 0, F.lit("ScheduleCatchUpWindow"), "must be non-negative"),
    ]
    listed = lambda name, title, main: F.flatten(F.transform(name, lambda s, i: _step_errors(s, F.concat(F.lit(f"{title}["), i.cast("string"), F.lit("]")), False, main)))
    found = _all(head, listed("steps", "Steps", True), listed("failure_steps", "OnFailureSteps", False), twice)
    return trees.select("definition_id", F.explode(found).alias("e")).select("definition_id", "e.*")


def jobs(trees: DataFrame) -> DataFrame:
    """``definition_id, step, job_name`` of all jobs that run here: steps, children, branches, compensators and the steps after a failure."""
    kind = "array<struct<step:string,job:" + _JOB + ">>"
    one = lambda id_, job, tail="": F.struct(F.concat(F.lit("step '"), id_, F.lit(f"'{tail}")).alias("step"), job.alias("job"))
    each = lambda s: F.concat(
        F.array(one(s["step_id"], s["job"]), one(s["step_id"], s["compensation"], " compensator")).cast(kind),
        F.transform(_children(s), lambda c: one(c["step_id"], c["job"])).cast(kind),
        F.when(s["group"].isNull(), F.transform(_branches(s), lambda b: one(b["step_id"], b["job"])).cast(kind)).otherwise(_empty(kind)),
    )
    found = F.concat(F.flatten(F.transform("steps", each)), F.transform("failure_steps", lambda s: one(s["step_id"], s["job"])).cast(kind))
    rows = trees.select("definition_id", F.explode(found).alias("x")).select("definition_id", "x.step", "x.job.job_name", "x.job.service")
    return rows.where((F.col("job_name") != "") & blank(F.col("service"))).drop("service")


def trigger_errors(trees: DataFrame, registered: DataFrame) -> DataFrame:
    """What keeps definitions from being started: errors of structure, and jobs that run here and are not in ``registered``."""
    unknown = jobs(trees).join(registered.select("job_name").distinct(), "job_name", "left_anti")
    said = unknown.select("definition_id", F.col("step").alias("path"), F.concat(F.lit("job '"), "job_name", F.lit("' is not registered")).alias("message"))
    return errors(trees).unionByName(said)


def step_count(trees: DataFrame) -> DataFrame:
    """``definition_id, steps``: branches of decisions, children of groups, other steps, compensators, and the steps after a failure."""
    own = lambda s: F.when(s["decision"].isNotNull(), F.size(_branches(s))).when(s["group"].isNotNull(), F.size(_children(s))).otherwise(1) + F.when(s["compensation"].isNotNull(), 1).otherwise(0)
    total = F.aggregate("steps", F.lit(0).cast("long"), lambda n, s: n + own(s)) + F.size("failure_steps")
    return trees.select("definition_id", total.alias("steps"))


def nodes(trees: DataFrame) -> DataFrame:
    """``definition_id, part, path, level, step_id, step_type`` of all steps, children and branches, in places of their lists."""
    kind = "array<struct<path:string,level:int,step_id:string,step_type:string>>"
    row = lambda path, level, id_, type_: F.struct(path.alias("path"), F.lit(level).alias("level"), id_.alias("step_id"), type_.alias("step_type"))

    def each(s: Column, i: Column) -> Column:
        inner = lambda j: F.concat_ws(".", i.cast("string"), j.cast("string"))
        return F.concat(
            F.array(row(i.cast("string"), 0, s["step_id"], s["step_type"])).cast(kind),
            F.transform(_children(s), lambda c, j: row(inner(j), 1, c["step_id"], c["step_type"])).cast(kind),
            F.transform(_branches(s), lambda b, j: row(inner(j), 1, b["step_id"], F.lit("Job"))).cast(kind),
        )

    parts = F.array(*[F.struct(F.lit(name).alias("part"), F.col(c).alias("steps")) for name, c in (("main", "steps"), ("failure", "failure_steps"))])
    rows = trees.select("definition_id", F.explode(parts).alias("p"))
    return rows.select("definition_id", "p.part", F.explode(F.flatten(F.transform("p.steps", each))).alias("n")).select("definition_id", "part", "n.*")
