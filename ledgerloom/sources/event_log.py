"""The execution ledger: an append-only table of events, folded to states.

Parquet has no update, so every change is a new event; the current state of an execution is
an aggregate over its events and is never stored in place.
"""

from __future__ import annotations

import threading
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import time_ordered_id
from ..functions.status import TERMINAL, allowed, legal

EVENT = "event_id string, execution_id string, job_name string, batch_id string, batch_step_id string, status string, error string, outputs map<string,string>, at timestamp, day date"


class EventLog:
    """One writer appends; readers fold, or follow it as a stream.

    Appending checks nothing, as a writer that knew all states would be a bottleneck;
    :func:`illegal_moves` and :func:`repeated_events` audit the log as queries.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._lock = spark, path, threading.Lock()

    def append(self, events: Sequence[dict]) -> None:
        """Append events; each gets a time-ordered id, which also orders events of one instant."""
        rows = []
        for e in events:
            at = e.get("at") or datetime.now(timezone.utc)
            at = at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)  # a time without zone is UTC
            rows.append((time_ordered_id(), e["execution_id"], e.get("job_name"), e.get("batch_id"), e.get("batch_step_id"), e["status"], e.get("error"), e.get("outputs"), at, at.date()))
        with self._lock:
            self.spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").partitionBy("day").parquet(self.path)

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENT).parquet(self.path)

    def watch(self, files_per_trigger: int = 100) -> DataFrame:
        """The log as a stream: every event once, none dropped."""
        return self.spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(self.path)


def current_executions(events: DataFrame) -> DataFrame:
    """One row per execution: last status, first start, last end, and the last error that was given.

    An error stays when a later event has none. All columns are aggregates, so events are
    folded before they are shuffled.
    """
    order = F.struct("at", "event_id")
    running, ended = F.col("status") == "Running", F.col("status").isin(*TERMINAL)
    return events.groupBy("execution_id").agg(
        F.max_by("status", order).alias("status"),
        F.min_by("job_name", order).alias("job_name"),
        F.min_by("batch_id", order).alias("batch_id"),
        F.min_by("batch_step_id", order).alias("batch_step_id"),
        F.min("at").alias("enqueued_at"),
        F.min(F.when(running, F.col("at"))).alias("started_at"),
        F.max(F.when(ended, F.col("at"))).alias("completed_at"),
        F.max(F.when(F.col("error").isNotNull(), F.struct("at", "event_id", "error")))["error"].alias("last_error"),
        F.count_if(running).alias("attempts"),
        F.max(F.when(F.col("outputs").isNotNull(), F.struct("at", "event_id", F.to_json("outputs").alias("json"))))["json"].alias("outputs"),
    )


def states(events: DataFrame) -> DataFrame:
    """What :func:`current_executions` shows, as aggregates that can be merged: one row per execution."""
    order = F.struct("at", "event_id")
    running, ended = F.col("status") == "Running", F.col("status").isin(*TERMINAL)
    return events.groupBy("execution_id").agg(
        F.max(F.struct("at", "event_id", "status")).alias("last"),
        F.min(F.struct("at", "event_id", "job_name", "batch_id", "batch_step_id")).alias("first"),
        F.min(F.when(running, F.col("at"))).alias("started_at"),
        F.max(F.when(ended, F.col("at"))).alias("completed_at"),
        F.max(F.when(F.col("error").isNotNull(), F.struct("at", "event_id", "error"))).alias("error"),
        F.max_by(F.struct(F.col("outputs").alias("held")), F.when(F.col("outputs").isNotNull(), order)).alias("outputs"),
        F.max(F.when(F.col("outputs").isNotNull(), order)).alias("outputs_order"),
        F.count_if(running).alias("attempts"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """The states of two sets of events that have none in common; ``old`` is not shuffled if it is bucketed by ``execution_id``."""
    o, n = old.alias("o"), new.alias("n")
    both = lambda c, pick: pick(F.coalesce(f"o.{c}", f"n.{c}"), F.coalesce(f"n.{c}", f"o.{c}")).alias(c)
    later = F.col("o.outputs_order").isNull() | (F.col("n.outputs_order") > F.col("o.outputs_order"))
    return o.join(n, F.col("o.execution_id") == F.col("n.execution_id"), "full").select(
        F.coalesce("o.execution_id", "n.execution_id").alias("execution_id"), both("last", F.greatest), both("first", F.least), both("started_at", F.least), both("completed_at", F.greatest), both("error", F.greatest),
        F.when(later, F.coalesce("n.outputs", "o.outputs")).otherwise(F.col("o.outputs")).alias("outputs"), F.when(later, F.coalesce("n.outputs_order", "o.outputs_order")).otherwise(F.col("o.outputs_order")).alias("outputs_order"),
        (F.coalesce("o.attempts", F.lit(0)) + F.coalesce("n.attempts", F.lit(0))).alias("attempts"),
    )


def shown(rows: DataFrame) -> DataFrame:
    """States as :func:`current_executions` gives them."""
    return rows.select(
        "execution_id", "last.status", "first.job_name", "first.batch_id", "first.batch_step_id", F.col("first.at").alias("enqueued_at"), "started_at", "completed_at",
        F.col("error.error").alias("last_error"), "attempts", F.to_json("outputs.held").alias("outputs"),
    )


class Snapshot:
    """States of all events up to a day, kept as a table that is bucketed by execution; a later one reads new days only.

    A day must be over when it is taken in: events that come for it afterwards are seen
    by a new snapshot from the whole log alone. Each snapshot is a table of its own, complete
    before it is named, so a writer that is lost leaves the one before.
    """

    def __init__(self, spark: SparkSession, folder: str, name: str = "executions", buckets: int = 64):
        self.spark, self.folder, self.name, self.buckets = spark, folder, name, buckets

    def read(self, upto: str) -> DataFrame:
        """The snapshot up to and with a day (``2024-01-20``), which must have been written; any session can read it."""
        table = f"{self.name}_{upto.replace('-', '')}"
        if not self.spark.catalog.tableExists(table):
            schema = self.spark.read.parquet(f"{self.folder}/{upto}").schema
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            self.spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (execution_id) SORTED BY (execution_id) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{upto}'")
        return self.spark.table(table)

    def state(self, events: DataFrame, upto: str | None) -> DataFrame:
        """The states of the whole log: the snapshot, if there is one, and the events of later days."""
        if upto is None:
            return states(events)
        return merged(self.read(upto), states(events.where(F.col("day") > F.lit(upto).cast("date"))))

    def advance(self, events: DataFrame, since: str | None, upto: str) -> None:
        """Write the snapshot up to and with ``upto`` from the one of ``since`` (or none) and the days between."""
        rows = self.state(events.where(F.col("day") <= F.lit(upto).cast("date")), since)
        table = f"{self.name}_{upto.replace('-', '')}"
        rows.repartition(self.buckets, "execution_id").write.bucketBy(self.buckets, "execution_id").sortBy("execution_id").option("path", f"{self.folder}/{upto}").saveAsTable(table)


def illegal_moves(events: DataFrame) -> DataFrame:
    """Events whose status does not follow from the one before of their execution; the first must be Pending or Scheduled.

    An execution's few events are one window.
    """
    before = F.lag("status").over(Window.partitionBy("execution_id").orderBy("at", "event_id"))
    rows = events.select("event_id", "execution_id", "at", before.alias("before"), "status")
    return rows.where(F.when(F.col("before").isNull(), ~F.col("status").isin("Pending", "Scheduled", "Skipped")).otherwise(~legal(F.col("before"), F.col("status"))))


def repeated_events(events: DataFrame) -> DataFrame:
    """Event ids that the log has more than once, with their number."""
    return events.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_move(before: str | None, after: str) -> None:
    """Raise on a change of status that the lattice does not have."""
    if before is not None and not allowed(before, after):
        raise ValueError(f"{before} cannot become {after}")
