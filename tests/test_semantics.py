"""Conditions, statuses, schedules, the event log, feeds, items and workflows."""

import time
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cron
from ledgerloom.functions.conditions import OPERATORS, Condition, compile_condition, evaluate
from ledgerloom.functions.scalars import backoff_seconds, time_ordered_id
from ledgerloom.functions.status import EDGES, STATUSES, TERMINAL, allowed
from ledgerloom.operators.ledger_query import ExecutionQuery, page, page_problems
from ledgerloom.operators.partitioned import counts, process_items, workers
from ledgerloom.plans.catalog import QUERIES
from ledgerloom.plans.workflow import Batch, Decision, Parallel, Step, problems, step_count
from ledgerloom.sources.event_log import EventLog, check_move, current_executions, illegal_moves, repeated_events
from ledgerloom.sources.shared import dealt
from ledgerloom.streaming import feeds


def test_conditions_mean_the_same_in_columns_and_python(spark):
    values = [None, "", "5", "5.0", " 5 ", "5d", "1e1", "-3", "NaN", "Infinity", "true", " TRUE", "False", "yes", "1", "t", "abc", "ABC"]
    bags = [{}] + [{"k": v} for v in values]
    rows = spark.createDataFrame([(i, "k" in b, b.get("k")) for i, b in enumerate(bags)], "i int, present boolean, k string")
    others = ["5", "true", "FALSE", "abc", "NaN", "1", "", "b"]
    cases = [Condition("k", op, o) for op, o in product(OPERATORS, others)] + [Condition("k", "Resembles", "5"), Condition("k", "Equals", None)]
    got = rows.select("i", *[compile_condition(c, F.col("k"), F.col("present")).alias(f"c{n}") for n, c in enumerate(cases)]).collect()
    for r in got:
        for n, c in enumerate(cases):
            assert r[f"c{n}"] is evaluate(c, bags[r["i"]]), (c, bags[r["i"]])


@pytest.mark.parametrize(
    "value, operator, other, want",
    [(5, "Equals", "5.0", True), (True, "Equals", "1", False), (True, "IsTrue", None, True), (1, "IsTrue", None, False), ("yes", "IsTrue", None, False), (None, "NotEquals", "5", False), (7, "GreaterThan", "6.5", True), (True, "GreaterThan", "0", False), (True, "Contains", "ru", True)],
)
def test_typed_values(value, operator, other, want):
    assert evaluate(Condition("k", operator, other), {"k": value}) is want


def test_all_hundred_moves():
    legal = {(a, b) for a, bs in EDGES.items() for b in bs}
    assert len(legal) == 14
    for a, b in product(STATUSES, STATUSES):
        assert allowed(a, b) == ((a, b) in legal)
    assert not any(allowed(t, b) for t in TERMINAL for b in STATUSES)
    check_move(None, "Pending")
    with pytest.raises(ValueError):
        check_move("Completed", "Running")


@pytest.mark.parametrize(
    "expression, after, want",
    [
        ("0 */15 * * * *", datetime(2024, 1, 1, 10, 7), datetime(2024, 1, 1, 10, 15)),
        ("0 0 12 29 2 *", datetime(2023, 3, 1), datetime(2024, 2, 29, 12)),
        ("0 0 0 * * MON", datetime(2024, 1, 1), datetime(2024, 1, 8)),
        ("30 59 23 31 12 *", datetime(2024, 12, 31, 23, 59, 30), datetime(2025, 12, 31, 23, 59, 30)),
        ("5 4 * * *", datetime(2024, 1, 1, 4, 5), datetime(2024, 1, 2, 4, 5)),
        ("0 0 0 31 2 *", datetime(2024, 1, 1), None),
        ("0 0 9-17/4 * * 1-5", datetime(2024, 1, 5, 17), datetime(2024, 1, 8, 9)),
        ("0 0 0 29 2 MON", datetime(2025, 1, 1), datetime(2044, 2, 29)),
        ("0 0 0 29 2 ?", datetime(2096, 3, 1), datetime(2104, 2, 29)),
        ("5,10 * * * * *", datetime(2024, 1, 1, 0, 0, 5, 400_000), datetime(2024, 1, 1, 0, 0, 10)),
        ("0 0 0 1 JAN,JUN 7", datetime(2024, 1, 1), datetime(2025, 6, 1)),
    ],
)
def test_next_occurrence(spark, expression, after, want):
    rows = spark.createDataFrame([(expression, after)], "e string, t timestamp_ntz").select("t", cron.parse(F.col("e")).alias("c"))
    assert rows.select(cron.next_occurrence(F.col("c"), F.col("t"))).first()[0] == want


def test_catch_up_replays_the_latest_missed_once(spark):
    now, last = datetime(2024, 1, 1, 10, 7), datetime(2024, 1, 1, 8)
    rows = [
        ("0 0 * * * *", last, now, 10, datetime(2024, 1, 1, 10)), ("0 0 * * * *", last, now, 5, None), ("0 0 * * * *", None, now, 1440, None), ("0 0 * * * *", last, now, None, None),
        ("* * * * * *", datetime(2023, 12, 31), now, 100_000, None), ("0 0 0 1 * *", datetime(2023, 6, 1), now, 100_000, datetime(2024, 1, 1)), ("0 7 10 * * *", now, now, 10, None),
    ]
    table = spark.createDataFrame([r[:4] for r in rows], "e string, last timestamp_ntz, now timestamp_ntz, w int").withColumn("c", cron.parse(F.col("e")))
    got = table.select(cron.catch_up(F.col("c"), F.col("last"), F.col("now"), F.make_dt_interval(mins="w"))).collect()
    assert [r[0] for r in got] == [r[4] for r in rows]
    bad = spark.createDataFrame([(x,) for x in ("* *", "61 * * * * *", "0 0 0 0 1 *", "*/0 * * * * *", "x * * * * *", "", None)], "e string")
    assert bad.where(cron.parse(F.col("e")).isNotNull()).count() == 0


def test_cron_against_a_walk(spark):
    """Next, last and number of occurrences against a walk over every second."""
    expressions = ["*/17 */13 */5 * * *", "30 15,45 9-17/4 * * MON-FRI", "0 59 23 * * SUN", "10 5 0 1,15 * ?"]
    start = datetime(2024, 2, 27, 22, 3, 9)
    fields = {"*/17": range(0, 60, 17), "*/13": range(0, 60, 13), "*/5": range(0, 24, 5), "30": [30], "15,45": [15, 45], "9-17/4": [9, 13, 17], "0": [0], "59": [59], "23": [23], "10": [10], "5": [5], "1,15": [1, 15]}
    days = {"*": range(7), "?": range(7), "MON-FRI": range(5), "SUN": [6]}
    for e in expressions:
        s, m, h, d, _, w = e.split()
        fits = lambda t: t.second in fields[s] and t.minute in fields[m] and t.hour in fields[h] and (d == "*" or t.day in fields[d]) and t.weekday() in days[w]  # noqa: E731, B023
        hits = [t for i in range(1, 20 * 86400) if (t := start + timedelta(seconds=i)).second in fields[s] and fits(t)]
        end = start + timedelta(days=19, seconds=86399)
        row = spark.createDataFrame([(start, end, e)], "a timestamp_ntz, b timestamp_ntz, e string").withColumn("c", cron.parse(F.col("e")))
        got = row.select(cron.next_occurrence(F.col("c"), F.col("a")), cron.last_occurrence(F.col("c"), F.col("a"), F.col("b")), cron.count_between(F.col("c"), F.col("a"), F.col("b"))).first()
        assert tuple(got) == (hits[0], hits[-1], len(hits)), e


def test_expressions_with_marks_wraps_and_large_steps(spark):
    """Fields at the edges of what is allowed, and the first that is not."""
    want = {
        "0 0 0 L-30 * ?": None, "0 0 0 L-31 * ?": "day", "0 0 0 31W * ?": None, "0 0 0 32W * ?": "day", "0 0 0 * * 7#5": None, "0 0 0 * * 8L": "weekday", "*/2147483647 * * * * *": None, "*/2147483648 * * * * *": "second",
        "0 007 0 * * *": None, "0 60 0 * * *": "minute", "0 0 22-2/3 * * FRI-MON": None, "? * * * * *": "second", "0 0 24 * * x": "hour", "0 0 0 * 13 *": "month", "1, * * * * *": "second", "@daily": None, "@never": "fields", None: "fields",
    }
    rows = spark.createDataFrame([(e,) for e in want], "e string").select("e", cron.problem(F.col("e")).alias("p"), cron.parse(F.col("e")).isNotNull().alias("ok")).collect()
    assert {r["e"]: r["p"] for r in rows} == want and all(r["ok"] == (r["p"] is None) for r in rows)


def test_cron_work_grows_little_with_rows(spark, tmp_path):
    """Sparse schedules and expressions that are all different, one file of one part: dealt over cores, and no walk over the days."""
    n = F.col("id")
    rows = spark.range(0, 40_000, 1, 1).select(F.concat_ws(" ", F.lit("0"), (n % 60).cast("string"), (n % 24).cast("string"), F.lit("29 2 ?")).alias("e"), (F.lit("2024-03-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(n % 9000).cast("int"))).alias("t"))
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    table = dealt(spark.read.parquet(str(tmp_path / "rows")))
    assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    began = time.monotonic()
    found = table.withColumn("c", cron.parse(F.col("e"))).select(cron.next_occurrence(F.col("c"), F.col("t")).alias("at"), cron.problem(F.col("e")).alias("p")).groupBy("p", F.to_date("at").alias("day")).count().collect()
    assert [(r["p"], str(r["day"]), r["count"]) for r in found] == [(None, "2028-02-29", 40_000)]
    assert time.monotonic() - began < 40


@pytest.mark.parametrize("name", ["cron_errors", "next_fire_marked", "next_fire", "catchup_decision", "cron_occurrences"])
def test_cron_queries_are_dealt_over_cores(spark, name):
    """The tables are one file each; the expressions run behind the exchange."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert plan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "rlike" in text.lower() and "rlike" not in text.lower().split("repartition")[-1]


def test_ids_sort_by_time():
    ids = [time_ordered_id() for _ in range(50)]
    assert all(len(i) == 32 and i[12] == "7" for i in ids) and len(set(ids)) == 50


def test_backoff(spark):
    got = spark.range(1, 9).select(backoff_seconds(F.col("id")).alias("s")).collect()
    assert [r["s"] for r in got] == [1, 2, 4, 8, 16, 32, 60, 60]


def test_query_bounds_and_wildcards(spark):
    rows = spark.createDataFrame([("a", "Job.1", "50% full", datetime(2024, 1, 1)), ("b", "Job.2", None, datetime(2024, 1, 2)), ("c", "job_50", "505 full", datetime(2024, 1, 2))], "execution_id string, job_name string, last_error string, enqueued_at timestamp_ntz")
    ids = lambda q: sorted(r["execution_id"] for r in q.apply(rows).collect())
    assert ids(ExecutionQuery(search="0% F")) == ["a"] and ids(ExecutionQuery(search="_")) == ["c"]
    assert ids(ExecutionQuery(since=datetime(2024, 1, 1), until=datetime(2024, 1, 2))) == ["a"]
    assert ExecutionQuery(statuses=["x"] * 21, search="x" * 1025, batch_definition_id="").problems() != []
    assert page_problems(-1, 501) and not page_problems(0, 500)
    assert [r["execution_id"] for r in page(rows, [F.col("enqueued_at").desc(), F.col("execution_id").asc()], -3, 2).collect()] == ["b", "c"]
    assert page(rows, [F.col("execution_id")], 0, -1).count() == 0


def test_item_policies(spark):
    items = spark.range(10_000).withColumnRenamed("id", "event_id")

    def work(row):
        if row["event_id"] % 20 == 19:
            raise ValueError("every twentieth")
        return int(row["event_id"])

    row = counts(process_items(items, work, "long", partitions=8)).first()
    assert (row["processed"], row["failed"]) == (9500, 500)
    with pytest.raises(Exception, match="every twentieth"):
        process_items(items, work, "long", "fail_fast").count()
    retried = process_items(items.limit(40), work, "long", "retry_then_continue", retries=2, delay=0.0).where("outcome = 'Failed'").collect()
    assert {r["attempts"] for r in retried} == {3} and {r["error"] for r in retried} == {"every twentieth"}
    assert process_items(items.limit(0), work, "long").count() == 0
    assert [workers(x, 4) for x in ("0", "7", "1000", "many", None)] == [1, 7, 128, 4, 4]


def test_event_log_folds(spark, tmp_path):
    log, t = EventLog(spark, str(tmp_path / "log")), datetime(2024, 1, 1)
    for i, (status, error) in enumerate([("Pending", None), ("Running", None), ("Retrying", "boom"), ("Running", None), ("Completed", None)]):
        log.append([{"execution_id": "e1", "job_name": "j", "batch_id": "b", "batch_step_id": "s", "status": status, "error": error, "at": t + timedelta(seconds=i)}])
    row = current_executions(log.events()).first()
    assert (row["status"], row["last_error"], row["attempts"]) == ("Completed", "boom", 2)
    assert row["started_at"] == t + timedelta(seconds=1) and row["completed_at"] == t + timedelta(seconds=4)
    streamed = feeds.drained(feeds.terminal_only(log.watch(), "at", "1 hour"), "ended", str(tmp_path / "c1"))
    assert [(r["execution_id"], r["status"]) for r in streamed.collect()] == [("e1", "Completed")]


def test_feeds_agree_with_batches(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(f"w{i % 3}", float(i), t + timedelta(milliseconds=97 * i)) for i in range(60)] + [("end", 0.0, t + timedelta(hours=5))]
    path = str(tmp_path / "beats")
    table = spark.createDataFrame(rows, "worker string, value double, at timestamp")
    table.write.parquet(path)
    stream = lambda: spark.readStream.schema(table.schema).parquet(path)
    for n, f in enumerate((lambda x: feeds.debounced(x, "worker", "at"), lambda x: feeds.quiet_bursts(x, "worker", "at", "1 second"))):
        want = {tuple(r) for r in f(table).where("worker <> 'end'").collect()}
        got = {tuple(r) for r in feeds.drained(f(stream()), f"feed{n}", str(tmp_path / f"c{n}")).where("worker <> 'end'").collect()}
        assert got == want and want
    once = feeds.drained(feeds.first_only(stream(), "worker", "at", "1 hour"), "once", str(tmp_path / "c9"))
    assert once.count() == 4


def test_requests_time_out(spark, tmp_path):
    t = datetime(2024, 1, 1)
    q = spark.createDataFrame([("a", t), ("b", t), ("z", t + timedelta(days=1))], "correlation_id string, at timestamp")
    p = spark.createDataFrame([("a", t + timedelta(seconds=5)), ("b", t + timedelta(hours=2)), ("x", t), ("z", t + timedelta(days=2))], "correlation_id string, at timestamp")
    q.write.parquet(str(tmp_path / "q"))
    p.write.parquet(str(tmp_path / "p"))
    streams = [spark.readStream.schema(q.schema).parquet(str(tmp_path / x)) for x in "qp"]
    got = feeds.drained(feeds.answered(*streams, "5 minutes"), "answers", str(tmp_path / "c")).collect()
    want = feeds.answered(q, p, "5 minutes").collect()
    as_dict = lambda rows: {r["correlation_id"]: r["answered_at"] for r in rows}
    assert as_dict(want) == {"a": t + timedelta(seconds=5), "b": None, "z": None}
    assert as_dict(got).items() <= as_dict(want).items() and "a" in as_dict(got)


def test_liveness_and_dead_letters(spark):
    t = datetime(2024, 1, 1)
    beats = spark.createDataFrame([("a", "Online", t), ("b", "Online", t - timedelta(seconds=46)), ("c", "Offline", t), ("d", "Online", t - timedelta(minutes=11)), ("a", "Offline", t - timedelta(seconds=9))], "worker_name string, status string, at timestamp")
    got = {r["worker_name"]: r["online"] for r in feeds.liveness(beats, F.lit(t)).collect()}
    assert got == {"a": True, "b": False, "c": False}
    good, bad = feeds.dead_letters(spark.createDataFrame([('{"n": 1}',), ("{oops",), (None,)], "body string"), "body", "n int")
    assert (good.count(), bad.count()) == (1, 2)


def fails(spark, params):
    raise RuntimeError("step fails")


def test_problems_and_steps():
    s = Step("a", fails)
    batch = Batch("x", (s, s, Parallel("g", (s,), "majority"), Decision("d", (Step("e", fails), Step("f", fails)))), "explode")
    assert len(problems(batch)) == 4 and step_count(batch) == 5
    undone = Batch("y", (Step("a", fails, undo=fails), Parallel("g", (Step("b", fails), Step("c", fails)))), after_failure=(Step("z", fails),))
    assert problems(undone) == [] and step_count(undone) == 5


def test_decision_status_of_all_statuses(spark):
    from ledgerloom.operators.rollups import decision_status

    cases = [(["Pending"], "Running"), (["Scheduled", "Completed"], "Running"), (["Completed", "Retrying"], "Running"), (["AwaitingApproval", "Skipped"], "Running"), (["Completed", "Cancelling"], "Cancelled"), (["Failed", "Cancelled"], "Failed"), (["Skipped", "Completed"], "Completed"), (["Skipped"], "Skipped")]
    rows = spark.createDataFrame([(i, s) for i, (own, _) in enumerate(cases) for s in own], "batch_id int, status string")
    assert {r["batch_id"]: r["status"] for r in decision_status(rows).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_event_log_audit_and_time_zones(spark, tmp_path):
    from datetime import timezone

    log, t = EventLog(spark, str(tmp_path / "log")), datetime(2024, 1, 1, 23, 30)
    for e, status, at in (("e1", "Pending", t), ("e1", "Completed", t + timedelta(seconds=1)), ("e2", "Running", t), ("e3", "Pending", t.replace(tzinfo=timezone(timedelta(hours=-5)))), ("e3", "Running", t + timedelta(days=1))):
        log.append([{"execution_id": e, "status": status, "at": at}])
    events = log.events()
    assert {(r["execution_id"], r["before"], r["status"]) for r in illegal_moves(events).collect()} == {("e1", "Pending", "Completed"), ("e2", None, "Running")}
    assert repeated_events(events).count() == 0 and repeated_events(events.union(events)).count() == 5
    shown = {tuple(r) for r in events.select("execution_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.col("day").cast("string")).collect()}
    assert ("e1", "2024-01-01 23:30:00", "2024-01-01") in shown and ("e3", "2024-01-02 04:30:00", "2024-01-02") in shown
