"""Snapshots of the log, items that are finalised once, and schedules with marks."""

import json
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cron
from ledgerloom.operators.partitioned import process_items
from ledgerloom.sources.event_log import EVENT, Snapshot, current_executions, shown
from ledgerloom.sources.finalized import Finalizer, finalize, written


def test_a_snapshot_and_later_days_are_the_whole_log(spark, tmp_path):
    t, rows = datetime(2024, 1, 1), []
    for i in range(300):
        at = t + timedelta(hours=i % 97, minutes=i)
        status = ("Pending", "Running", "Retrying", "Completed", "Failed")[i % 5]
        rows.append((f"{i:04d}", f"e{i % 17}", f"j{i % 3}", None, "s", status, "boom" if i % 11 == 0 else None, {"k": str(i)} if i % 7 == 0 else None, at, at.date()))
    events = spark.createDataFrame(rows, EVENT).repartition(4)
    kept = Snapshot(spark, str(tmp_path / "kept"), "test_executions", buckets=4)
    kept.advance(events, None, "2024-01-02")
    kept.advance(events, "2024-01-02", "2024-01-03")
    state = kept.state(events, "2024-01-03")
    columns = current_executions(events).columns
    same = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert same(shown(state)) == same(current_executions(events)) == same(shown(kept.state(events, None)))
    assert same(shown(kept.state(events.where("day > '2024-01-03'"), "2024-01-03"))) == same(current_executions(events))  # older days are not read
    spark.sql("DROP TABLE test_executions_20240103")  # another session names it anew
    plan = kept.state(events, "2024-01-03")._jdf.queryExecution().executedPlan().toString()
    assert same(shown(kept.state(events, "2024-01-03"))) == same(current_executions(events))
    assert plan.count("Exchange hashpartitioning(execution_id") == 1  # the new events alone


class Marked(Finalizer):
    """Leaves a file when it gives up."""

    @classmethod
    def name(cls) -> str:
        return "marked"

    @classmethod
    def give_up(cls, options: dict[str, str]) -> None:
        written(options["path"], "given_up.json", {})


def test_items_are_finalised_once_or_not_at_all(spark, tmp_path):
    items = spark.range(1000).withColumnRenamed("id", "event_id").repartition(7)

    def work(row):
        if row["event_id"] % 10 == 3:
            raise ValueError("three")
        return row["event_id"]

    finalize(process_items(items, work, "long", "continue"), str(tmp_path / "a"))
    assert [p.name for p in Path(tmp_path / "a").iterdir()] == ["finalized.json"]
    assert json.loads((tmp_path / "a" / "finalized.json").read_text()) == {"completed": 900, "failed": 100, "finalized": 1}
    with pytest.raises(Exception, match="three"):
        finalize(process_items(items, work, "long", "fail_fast"), str(tmp_path / "b"), Marked)
    assert [p.name for p in Path(tmp_path / "b").iterdir()] == ["given_up.json"]
    finalize(process_items(items.limit(0), work, "long"), str(tmp_path / "c"))
    assert json.loads((tmp_path / "c" / "finalized.json").read_text())["completed"] == 0


CASES = [
    ("0 0 22-2 * * *", datetime(2024, 1, 1, 2, 30), datetime(2024, 1, 1, 22)), ("0 0 6 * * FRI-MON", datetime(2024, 1, 1, 7), datetime(2024, 1, 5, 6)), ("0 0 0 * * MON-SUN", datetime(2024, 1, 2), datetime(2024, 1, 3)),
    ("0 0 0 1 DEC-FEB ?", datetime(2024, 2, 2), datetime(2024, 12, 1)), ("0 0 0 L * ?", datetime(2024, 2, 1), datetime(2024, 2, 29)), ("0 0 0 L-3 * ?", datetime(2023, 2, 1), datetime(2023, 2, 25)), ("0 0 0 15W * ?", datetime(2024, 6, 1), datetime(2024, 6, 14)),
    ("0 0 0 1W * ?", datetime(2024, 6, 1, 1), datetime(2024, 6, 3)), ("0 0 0 LW * ?", datetime(2024, 3, 1), datetime(2024, 3, 29)), ("0 0 0 31W * ?", datetime(2024, 4, 1), datetime(2024, 5, 31)), ("0 0 9 ? * MON#2", datetime(2024, 1, 1), datetime(2024, 1, 8, 9)), ("0 0 9 ? * 5L", datetime(2024, 1, 1), datetime(2024, 1, 26, 9)),
    ("0 0 9 ? * 5#5", datetime(2024, 1, 1), datetime(2024, 3, 29, 9)), ("@weekly", datetime(2024, 1, 1), datetime(2024, 1, 7)), ("@Hourly", datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 1)), ("@yearly", datetime(2024, 1, 1), datetime(2025, 1, 1)), ("0 0 23-1/2 * * *", datetime(2024, 1, 1, 1), datetime(2024, 1, 1, 23)), ("0 0 0 ? * 6-7", datetime(2024, 1, 1), datetime(2024, 1, 6)),
]


def test_marks_and_wrapped_ranges(spark):
    rows = spark.createDataFrame([(i, e, a) for i, (e, a, _) in enumerate(CASES)], "i int, e string, after timestamp_ntz").withColumn("c", cron.parse(F.col("e")))
    got = {r["i"]: r["n"] for r in rows.select("i", cron.next_occurrence(F.col("c"), F.col("after")).alias("n")).collect()}
    assert [(CASES[i][0], got[i]) for i in got if got[i] != CASES[i][2]] == []


def test_what_is_no_schedule_says_why(spark):
    wrong = {"": "fields", "* * * *": "fields", "60 * * * * *": "second", "0 70 * * * *": "minute", "0 0 24 * * *": "hour", "0 0 ? * * *": "hour", "0 0 0 32 * *": "day", "0 0 0 L-31 * ?": "day", "0 0 0 32W * ?": "day", "0 0 0 1,L * ?": "day", "0 0 0 1 13 ?": "month", "0 0 0 ? * 8": "weekday", "0 0 0 ? * 5#6": "weekday", "0 0 0 ? * MONDAY": "weekday", "0 */0 * * * *": "minute", "0 1- * * * *": "minute", "0 1,, * * * *": "minute", "@never": "fields", None: "fields"}
    rows = spark.createDataFrame([(e,) for e in wrong], "e string")
    got = {r["e"]: (r["p"], r["c"]) for r in rows.select("e", cron.problem(F.col("e")).alias("p"), cron.parse(F.col("e")).alias("c")).collect()}
    assert {e: p for e, (p, _) in got.items()} == wrong and not any(c for _, c in got.values())
    fine = spark.createDataFrame([(e,) for e, _, _ in CASES], "e string").select(cron.problem(F.col("e")).alias("p")).collect()
    assert all(r["p"] is None for r in fine)
