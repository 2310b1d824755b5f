"""Definitions of workflows: what a batch is, how many steps it has, and whether it is well formed.

The work of a step is a Spark job that the step's function starts. What happened, what comes
next, and what to resume or undo are queries over the ledger (``workflow_keys``); there is
no scheduler here.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from ..functions.conditions import Condition

Job = Callable[[SparkSession, dict], "dict | None"]


@dataclass(frozen=True)
class Step:
    """One job. ``when`` guards it; ``undo`` is run in reverse order when a later step fails."""

    id: str
    job: Job
    when: Condition | None = None
    params: dict = field(default_factory=dict)
    undo: Job | None = None
    retries: int = 0


@dataclass(frozen=True)
class Parallel:
    """Jobs side by side; ``join`` is all, any or majority."""

    id: str
    children: tuple[Step, ...]
    join: str = "all"


@dataclass(frozen=True)
class Decision:
    """The first branch whose condition holds runs; one without a condition comes last."""

    id: str
    branches: tuple[Step, ...]


@dataclass(frozen=True)
class Batch:
    name: str
    steps: tuple[Step | Parallel | Decision, ...]
    on_failure: str = "stop"  # or continue, compensate
    after_failure: tuple[Step, ...] = ()


def problems(batch: Batch) -> list[str]:
    """All that is wrong with a batch, before anything runs."""
    found, ids = [], []
    for step in batch.steps:
        own = step.children if isinstance(step, Parallel) else step.branches if isinstance(step, Decision) else ()
        ids += [step.id, *[c.id for c in own]]
        if isinstance(step, Parallel) and len(own) < (3 if step.join == "majority" else 2):
            found.append(f"{step.id}: too few children")
        if isinstance(step, Parallel) and step.join not in ("all", "any", "majority"):
            found.append(f"{step.id}: no such join")
        if isinstance(step, Decision) and (not own or any(b.when is None for b in own[:-1])):
            found.append(f"{step.id}: only the last branch may have no condition")
        for c in [step, *own]:
            if isinstance(c, Step) and c.when:
                found += [f"{c.id}: {p}" for p in c.when.problems()]
    found += [f"{i}: id is used twice" for i in sorted({i for i in ids if ids.count(i) > 1})]
    found += [f"{i}: the ending :comp is reserved" for i in ids if i.endswith(":comp")]
    if batch.on_failure not in ("stop", "continue", "compensate"):
        found.append(f"no such failure policy: {batch.on_failure}")
    return found


def step_count(batch: Batch) -> int:
    """Branches of decisions, children of groups, other steps, compensators and the steps after a failure: changes of it are drift."""
    inner = [step.children if isinstance(step, Parallel) else step.branches if isinstance(step, Decision) else (step,) for step in batch.steps]
    undone = sum(isinstance(step, Step) and step.undo is not None for step in batch.steps)
    return sum(map(len, inner)) + undone + len(batch.after_failure)
