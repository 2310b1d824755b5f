"""Stateful streams against the same rules over tables."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ordered, progression
from ledgerloom.streaming import awaits, feeds

T0 = datetime(2024, 1, 1)


@pytest.fixture()
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_waits_end_by_time(rocks, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    waits = [("a", "1", at(0), at(10)), ("a", "2", at(6), at(16)), ("b", "3", at(0), at(10)), ("c", "4", at(1), at(3)), ("c", "5", at(1), at(30)), ("d", "6", at(2), at(4))]
    ends = [("a", "Completed", at(5)), ("a", "Failed", at(7)), ("c", "Failed", at(20)), ("z", "Completed", at(600))]
    w = rocks.createDataFrame(waits, "execution_id string, wait_id string, asked_at timestamp, due_at timestamp")
    e = rocks.createDataFrame(ends, "execution_id string, status string, at timestamp")
    columns = ["execution_id", "wait_id", "outcome", "status", "resolved_at"]
    want = {tuple(r) for r in progression.awaited(w, e).select(*columns).collect()}
    assert {r[1]: r[2] for r in want} == {"1": "ended", "2": "caught_up", "3": "timed_out", "4": "timed_out", "5": "ended", "6": "timed_out"}
    w.coalesce(1).write.parquet(str(tmp_path / "w"))
    for i, rows in enumerate((e, rocks.createDataFrame([("z", "Completed", at(900))], e.schema))):  # the last moves the watermark past all timers
        rows.coalesce(1).write.parquet(str(tmp_path / "e" / f"day={i}"))
    streams = rocks.readStream.schema(w.schema).parquet(str(tmp_path / "w")), rocks.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "e"))
    got = feeds.drained(awaits.awaited(*streams), "waits", str(tmp_path / "c")).select(*columns).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_recent_set_on_a_stream(rocks, tmp_path):
    rng = random.Random(6)
    rows = [(scope, i, str(rng.randrange(25)), T0 + timedelta(seconds=i)) for scope in "xy" for i in range(200)]
    df = rocks.createDataFrame(rows, "scope string, number long, id string, at timestamp")
    want = {(r["scope"], r["number"]): r["is_new"] for r in ordered.recently_seen(df, ["scope"], "id", ["at", "number"], F.lit(0), 10).collect()}
    for i in range(4):
        df.where(f"number div 50 = {i}").coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    stream = rocks.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    got = feeds.drained(awaits.recently_seen(stream, 10), "recent", str(tmp_path / "c")).collect()
    assert {(r["scope"], r["number"]): r["is_new"] for r in got} == want
