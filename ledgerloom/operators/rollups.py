"""Folds of executions to steps and runs. The three run roll-ups differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import is_terminal


def step_key() -> Column:
    """A row without a step is a step of its own."""
    return F.coalesce(F.col("batch_step_id").cast("string"), F.concat(F.lit("exec:"), F.col("execution_id")))


def latest_attempts(executions: DataFrame) -> DataFrame:
    """The last attempt of each step of each run, by time and then id.

    A maximum of structs is aggregated before the shuffle and after it, so one row a step and task is
    shuffled; as structs are no mutable state, Spark sorts a task's rows by step for it.
    """
    last = executions.groupBy("batch_id", step_key().alias("step")).agg(F.max(F.struct("enqueued_at", "execution_id", "status", "batch_step_id")).alias("x"))
    return last.select("batch_id", "step", "x.execution_id", "x.status", "x.enqueued_at", "x.batch_step_id")


def count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def run_rollup(executions: DataFrame) -> DataFrame:
    """What a run's record holds: outcomes of the latest attempts, and the total of all rows.

    Both come from one shuffle: attempts are folded by step with their number, steps by run.
    """
    steps = executions.groupBy("batch_id", step_key().alias("step")).agg(F.max(F.struct("enqueued_at", "execution_id", "status")).alias("x"), F.count(F.lit(1)).alias("n"))
    status = F.col("x.status")
    rolled = steps.groupBy("batch_id").agg(
        F.sum("n").alias("total"), count_if(status == "Completed").alias("succeeded"), count_if(status == "Failed").alias("failed"), count_if(status == "Cancelled").alias("cancelled")
    )
    return rolled.withColumn("st", F.when(F.col("cancelled") > 0, "Cancelled").when(F.col("failed") > 0, "Failed").otherwise("Completed"))


def completion_summary(executions: DataFrame, now: Column) -> DataFrame:
    """What is announced when a run ends: flat counts, and ``now`` for what has not ended."""
    counts = [count_if(F.col("status") == s).alias(s.lower()) for s in ("Completed", "Failed", "Cancelled", "Skipped")]
    return executions.groupBy("batch_id").agg(F.count(F.lit(1)).alias("total"), *counts, F.max(F.coalesce("completed_at", now)).alias("completed_at"))


def run_summary(executions: DataFrame, paused: DataFrame) -> DataFrame:
    """What a page shows of a run it knows by executions alone; a cancelled row makes it failed.

    ``paused`` has the ``batch_id`` of each run with a pending gate, which has no row of
    its own: such a run waits for approval when it would be done, and has no end.
    """
    bad, open_ = F.col("status").isin("Failed", "Cancelled"), ~is_terminal(F.col("status"))
    rows = executions.groupBy("batch_id").agg(
        F.max(F.when(bad, 2).when(open_, 1).otherwise(0)).alias("worst"), F.min("enqueued_at").alias("s"), F.max("completed_at").alias("e"), F.count(F.lit(1)).alias("n"), F.count("completed_at").alias("ended")
    )
    rows = rows.join(paused.select("batch_id").distinct().withColumn("waits", F.lit(True)), "batch_id", "left")
    status = F.when(F.col("worst") == 2, "Failed").when(F.col("worst") == 1, "Running").when(F.col("waits"), "AwaitingApproval").otherwise("Completed")
    return rows.select("batch_id", status.alias("st"), "s", F.when((F.col("n") == F.col("ended")) & F.col("waits").isNull(), F.col("e")).alias("e"))


def decision_status(branches: DataFrame) -> DataFrame:
    """A decision's status from its branches': failed, cancelled (or about to be), at work (or waiting to be), done, else skipped."""
    status = F.col("status")
    weight = F.when(status == "Failed", 4).when(status.isin("Cancelled", "Cancelling"), 3).when(~is_terminal(status), 2).when(status == "Completed", 1).otherwise(0)
    top = branches.groupBy("batch_id").agg(F.max(weight).alias("w"))
    return top.select("batch_id", F.element_at(F.array(*map(F.lit, ("Skipped", "Completed", "Running", "Cancelled", "Failed"))), F.col("w") + 1).alias("status"))


def latest_by(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """One row per key, the first in the order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").select(*columns)
