"""Data-parallel work on items, with a policy for items that fail."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POLICIES = ("fail_fast", "continue", "retry_then_continue")
MOST_WORKERS, FIRST_DELAY = 128, 0.1


def workers(asked: str | None, registered: int) -> int:
    """The worker count that a run asks for, within 1 to MOST_WORKERS; what is no number counts as not asked."""
    try:
        return min(max(int(asked), 1), MOST_WORKERS)
    except (TypeError, ValueError):
        return registered


def process_items(items: DataFrame, work: Callable[[dict], object], result: T.DataType | str, policy: str = "continue", retries: int = 0, partitions: int | None = None, delay: float = FIRST_DELAY) -> DataFrame:
    """``items`` with ``outcome`` (Completed or Failed), ``attempts``, ``result`` and ``error``.

    ``work`` gets a row as a dictionary and is opaque, so it runs in Python, a batch of rows at a time;
    use columns where columns can say it. ``fail_fast`` lets the first error end the
    query. A task that Spark runs again calls ``work`` again for its rows.
    """
    if policy not in POLICIES:
        raise ValueError(f"no such policy: {policy}")
    schema = T.StructType([*items.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("result", result if isinstance(result, T.DataType) else T._parse_datatype_string(result)), T.StructField("error", T.StringType())])
    attempts = 1 + (retries if policy == "retry_then_continue" else 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                for attempt in range(1, attempts + 1):
                    try:
                        out.append(("Completed", attempt, work(row), None))
                        break
                    except Exception as error:
                        if policy == "fail_fast":
                            raise
                        if attempt == attempts:
                            out.append(("Failed", attempt, None, str(error)))
                        else:
                            time.sleep(delay * 2 ** (attempt - 1))
            yield pd.concat([batch.reset_index(drop=True), pd.DataFrame(out, columns=["outcome", "attempts", "result", "error"])], axis=1)

    return (items.repartition(partitions) if partitions else items).mapInPandas(run, schema)


def counts(processed: DataFrame) -> DataFrame:
    """Number of items that were completed and that failed."""
    return processed.agg(F.count_if(F.col("outcome") == "Completed").alias("processed"), F.count_if(F.col("outcome") == "Failed").alias("failed"))
