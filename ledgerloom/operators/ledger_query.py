"""Typed filters over executions and runs, stable order and paging."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_STATUSES, LONGEST_SEARCH, LONGEST_ID, DEFAULT_PAGE, LARGEST_PAGE = 20, 1024, 64, 50, 500


@dataclass(frozen=True)
class ExecutionQuery:
    """All members are optional and hold together; an empty one is no condition."""

    statuses: Sequence[str] = ()
    execution_id: str | None = None
    job_name: str | None = None
    batch_id: int | str | None = None
    batch_definition_id: int | str | None = None
    worker_name: str | None = None
    since: datetime | None = None
    until: datetime | None = None
    search: str | None = None

    def problems(self) -> list[str]:
        found = [f"at most {MOST_STATUSES} statuses"] if len(self.statuses) > MOST_STATUSES else []
        if self.search and len(self.search) > LONGEST_SEARCH:
            found.append(f"search has at most {LONGEST_SEARCH} characters")
        if self.batch_definition_id is not None and not 0 < len(str(self.batch_definition_id)) <= LONGEST_ID:
            found.append(f"a definition id has 1 to {LONGEST_ID} characters")
        return found

    def apply(self, executions: DataFrame) -> DataFrame:
        """Plain comparisons only, which the Parquet scan can use; a null never matches."""
        rows = executions
        if self.statuses:
            rows = rows.where(F.col("status").isin(*self.statuses))
        for name in ("execution_id", "job_name", "batch_id", "batch_definition_id", "worker_name"):
            if getattr(self, name) is not None:
                rows = rows.where(F.col(name) == getattr(self, name))
        if self.since is not None:
            rows = rows.where(F.col("enqueued_at") >= F.lit(self.since).cast("timestamp_ntz"))
        if self.until is not None:
            rows = rows.where(F.col("enqueued_at") < F.lit(self.until).cast("timestamp_ntz"))
        if self.search:
            rows = rows.where(holds_text("last_error", self.search) | holds_text("job_name", self.search))
        return rows


def holds_text(column: str, text: str) -> Column:
    """Case-insensitive substring; no character is a wildcard."""
    return F.contains(F.lower(F.col(column)), F.lower(F.lit(text)))


@dataclass(frozen=True)
class RunQuery:
    """A run without a status is running; it is in the result if ``include_running``."""

    batch_definition_id: int | str | None = None
    statuses: Sequence[str] = ()
    include_running: bool = True

    def apply(self, runs: DataFrame) -> DataFrame:
        rows = runs if self.batch_definition_id is None else runs.where(F.col("batch_definition_id") == self.batch_definition_id)
        known = F.col("status").isin(*self.statuses) if self.statuses else F.lit(True)
        return rows.where(F.when(F.col("status").isNull(), F.lit(self.include_running)).otherwise(known))


def newest_executions(rows: DataFrame, newest: bool = True) -> list[Column]:
    """Ties go up by id either way."""
    return [F.col("enqueued_at").desc() if newest else F.col("enqueued_at").asc(), F.col("execution_id").asc()]


def newest_runs(rows: DataFrame, newest: bool = True) -> list[Column]:
    """Ties go the way of the time."""
    return [F.col(c).desc() if newest else F.col(c).asc() for c in ("started_at", "batch_id")]


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of a total order; negative numbers count as 0. Spark keeps offset + limit rows a task."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(0, limit))


def page_problems(offset: int, limit: int) -> list[str]:
    return [*(["offset is negative"] if offset < 0 else []), *([] if 1 <= limit <= LARGEST_PAGE else [f"limit is 1 to {LARGEST_PAGE}"])]
