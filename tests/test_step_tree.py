"""Edges, errors and step counts of small trees."""

import json

import pytest

from ledgerloom.operators import step_tree
from ledgerloom.sources.views import Views

SCHEMA = f"definition_id int, name string, failure_policy int, catch_up_seconds long, steps array<{step_tree.STEP}>, failure_steps array<{step_tree.STEP}>"


def job(id_, order, **more):
    return {"ord": order, "step_id": id_, "step_type": "Job", "job": {"job_name": "J"}, **more}


def group(id_, order, *children, policy=0, **more):
    return {"ord": order, "step_id": id_, "step_type": "ParallelGroup", "group": {"join_policy": policy, "steps": list(children)}, **more}


def decision(id_, order, *branches, **more):
    return {"ord": order, "step_id": id_, "step_type": "Decision", "decision": {"branches": list(branches)}, **more}


def branch(id_, when=None, label=None):
    return {"step_id": id_, "label": label, "job": {"job_name": "J"}, "when": when}


def trees(spark, *definitions):
    rows = [json.dumps({"definition_id": i, "name": "n", "failure_policy": 0, "steps": [], "failure_steps": [], **d}) for i, d in enumerate(definitions)]
    return spark.createDataFrame([(r,) for r in rows], "j string").selectExpr(f"from_json(j, '{SCHEMA}') as d").select("d.*")


def edges(spark, **definition):
    return sorted((r["source"], r["target"], r["kind"], r["is_fan_in"]) for r in step_tree.edges(trees(spark, definition)).collect())


def test_job_group_job_fans_out_and_in(spark):
    got = edges(spark, steps=[job("c", 3), group("g", 2, job("x", 2), job("w", 1)), job("a", 1)])
    assert got == sorted([("a", "w", "Parallel", False), ("a", "x", "Parallel", False), ("w", "c", "Parallel", True), ("x", "c", "Parallel", True)])


def test_groups_in_a_row_and_at_the_ends(spark):
    got = edges(spark, steps=[group("g", 1, job("a", 1), job("b", 2)), group("h", 2, job("c", 1), job("d", 2))], failure_steps=[job("f", 2), job("e", 1)])
    product = [(s, t, "Parallel", True) for s in "ab" for t in "cd"]
    assert got == sorted([*product, ("c", "e", "OnFailure", False), ("d", "e", "OnFailure", False), ("e", "f", "OnFailure", False)])


def test_decisions_lead_to_branches_which_lead_on(spark):
    more = {"key": " k ", "op": 2, "value": "5"}
    rows = step_tree.edges(trees(spark, {"steps": [job("a", 1), decision("d", 2, branch("x", more), branch("y", label=" Fast "), branch("z")), job("b", 3)]})).collect()
    got = {(r["source"], r["target"]): (r["kind"], r["is_fan_in"], r["label"]) for r in rows}
    assert got == {("a", "d"): ("Sequential", False, None), ("d", "x"): ("Decision", False, "k > 5"), ("d", "y"): ("Decision", False, "Fast"), ("d", "z"): ("Decision", False, "else"), **{(s, "b"): ("Parallel", True, None) for s in "xyz"}}


def test_compensators_hang_on_what_is_drawn(spark):
    undo = {"compensation": {"job_name": "U"}}
    got = edges(spark, steps=[job("a", 1, **undo), group("g", 2, job("x", 1), job("y", 2), **undo)])
    assert got == sorted([("a", "x", "Parallel", False), ("a", "y", "Parallel", False), ("a", "a:comp", "Compensation", False), ("x", "g:comp", "Compensation", False), ("y", "g:comp", "Compensation", False)])


def test_a_group_without_children_breaks_the_line(spark):
    assert edges(spark, steps=[job("a", 1), group("g", 2), job("b", 3)]) == []
    assert edges(spark) == []


def test_step_count(spark):
    undo = {"compensation": {"job_name": "U"}}
    df = trees(spark, {"steps": [job("a", 1, **undo), group("g", 2, job("x", 1), job("y", 2)), decision("d", 3, branch("p"), branch("q"), branch("r"))], "failure_steps": [job("z", 1)]}, {})
    assert {r["definition_id"]: r["steps"] for r in step_tree.step_count(df).collect()} == {0: 8, 1: 0}


CONDITION = {"key": "k", "op": 6, "value": None}


RULES = [
    ({"name": " "}, "Name", "must be non-empty"),
    ({}, "Steps", "must contain at least one step"),
    ({"failure_policy": 7}, "FailurePolicy", "unknown enum value 7"),
    ({"catch_up_seconds": -1}, "ScheduleCatchUpWindow", "must be non-negative"),
    ({"steps": [job("", 1)]}, "Steps[0].StepId", "must be non-empty"),
    ({"steps": [job("a", 1), job("b:comp", 2)]}, "Steps[1].StepId", "must not end with the reserved compensator suffix ':comp'"),
    ({"steps": [{**job("a", 1), "job": None}]}, "Steps[0].Job", "Job step requires Job payload"),
    ({"steps": [group("g", 1, job("a", 1), policy=9)]}, "Steps[0].ParallelGroup.JoinPolicy", "unknown enum value 9"),
    ({"steps": [group("g", 1, job("a", 1))]}, "Steps[0].ParallelGroup.Steps", "ParallelGroup must contain >=2 children"),
    ({"steps": [group("g", 1, job("a", 1), job("b", 2), policy=2)]}, "Steps[0].ParallelGroup.Steps", "WaitMajority requires >=3 children (degenerate with fewer; use WaitAll instead)"),
    ({"steps": [group("g", 1, job("a", 1), {"ord": 2, "step_id": "b", "step_type": "ParallelGroup"})]}, "Steps[0].ParallelGroup.Steps[1].StepType", "Nested ParallelGroup steps are forbidden in v0.1"),
    ({"steps": [group("g", 1, job("a", 1, condition=CONDITION), job("b", 2))]}, "Steps[0].ParallelGroup.Steps[0].Condition", "a run-if condition is not allowed here (only on top-level steps)"),
    ({"steps": [{"ord": 1, "step_id": "a", "step_type": "ApprovalGate", "approval": {"title": "t", "on_timeout": 1, "timeout_s": 0}}]}, "Steps[0].Approval.Timeout", "required when the on-timeout action is AutoApprove or Hold"),
    ({"steps": [{"ord": 1, "step_id": "a", "step_type": "ApprovalGate", "approval": {"title": "t", "on_timeout": 0}, "compensation": {"job_name": "U"}}]}, "Steps[0].Compensation", "an ApprovalGate step cannot have a compensator"),
    ({"steps": [decision("d", 1)]}, "Steps[0].Decision.Branches", "Decision must contain at least one branch"),
    ({"steps": [decision("d", 1, branch("a"), branch("b"))]}, "Steps[0].Decision.Branches[1].When", "a Decision may have at most one else (unconditional) branch"),
    ({"steps": [decision("d", 1, branch("a"), branch("b", CONDITION))]}, "Steps[0].Decision.Branches[1].When", "the else (unconditional) branch must be the last branch"),
    ({"steps": [job("a", 1, condition={"key": "", "op": 6})]}, "Steps[0].Condition.ParameterKey", "must be non-empty"),
    ({"steps": [job("a", 1, condition={"key": "k", "op": 11})]}, "Steps[0].Condition.Operator", "unknown enum value 11"),
    ({"steps": [job("a", 1, condition={"key": "k", "op": 0, "value": ""})]}, "Steps[0].Condition.Value", "required for the Equals operator"),
    ({"steps": [job("a", 1, condition={"key": "k", "op": 3, "value": "5d"})]}, "Steps[0].Condition.Value", "must be a number for the GreaterThanOrEqual operator"),
    ({"failure_steps": [job("a", 1, compensation={"job_name": ""})]}, "OnFailureSteps[0].Compensation.JobName", "must be non-empty"),
    ({"steps": [job("a", 1)], "failure_steps": [job("a", 1)]}, "StepId", "duplicate step id 'a' — every step id in a definition must be unique"),
    ({"steps": [group("g", 1, job("a", 1), job("b", 2)), decision("d", 2, branch("b"))]}, "StepId", "duplicate step id 'b' — every step id in a definition must be unique"),
]


def test_each_rule_gives_its_row(spark):
    found = {(r["definition_id"], r["path"], r["message"]) for r in step_tree.errors(trees(spark, *[d for d, _, _ in RULES])).collect()}
    assert [(path, message) for i, (_, path, message) in enumerate(RULES) if (i, path, message) not in found] == []


def test_sound_definitions_have_no_errors(spark):
    sound = {"steps": [job("a", 1, compensation={"job_name": "U"}, condition={"key": "k", "op": 4, "value": "1e3"}), group("g", 2, job("x", 1), job("y", 2)), decision("d", 3, branch("p", CONDITION), branch("q"))], "failure_steps": [job("z", 1)]}
    assert step_tree.errors(trees(spark, sound)).collect() == []
    known = spark.createDataFrame([("J",)], "job_name string")
    assert {(r["path"], r["message"]) for r in step_tree.trigger_errors(trees(spark, sound), known).collect()} == {("step 'a' compensator", "job 'U' is not registered")}


@pytest.mark.parametrize("view", ["steps", "children"])
def test_flat_tables_are_shuffled_once_by_their_own_columns(spark, view):
    """What the view makes of a row (names, titles, operators) comes behind the exchange; the window adds none."""
    plan = getattr(Views(spark, "/root/testdata/sf0.001"), view)._jdf.queryExecution()
    made, shuffled = plan.optimizedPlan().toString().split("RepartitionByExpression")
    assert "Job." in made and "Job." not in shuffled
    assert plan.executedPlan().toString().count("Exchange") == 1
