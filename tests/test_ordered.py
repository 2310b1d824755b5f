"""Rules that depend on order, against plain simulations of them."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ordered, progression
from ledgerloom.sources.shared import checkpointed

T0 = datetime(2024, 1, 1)


def sim_breaker(calls, trips, sampling, pause):
    """The rule, one call after the other."""
    seen, until, out = [], None, []
    for at, failed in calls:
        if until is not None and at < until:
            out.append(("open", False))
            continue
        state = "closed" if until is None else "half_open"
        seen = [x for x in seen if x[0] > at - sampling] + [(at, failed)]
        trip = failed and (state == "half_open" or (len(seen) >= trips and all(f for _, f in seen)))
        if trip or state == "half_open":
            seen = []
        until = at + pause if trip else None
        out.append((state, trip))
    return out


def test_breaker_refuses_while_open_and_tries_once(spark):
    calls = [(0, True), (1, True), (2, True), (3, True), (4, True), (5, False), (33, True), (40, True), (90, True), (130, False), (131, True)]
    rows = spark.createDataFrame([("s", i, T0 + timedelta(seconds=s), f) for i, (s, f) in enumerate(calls)], "service string, n int, at timestamp_ntz, failed boolean")
    got = {r["n"]: (r["state"], r["tripped"]) for r in ordered.breaker(rows, ["service"], "at", "n").collect()}
    assert [got[i][0] for i in range(11)] == ["closed"] * 5 + ["open"] * 2 + ["half_open"] * 3 + ["closed"]
    assert [i for i in range(11) if got[i][1]] == [4, 7, 8]


@pytest.mark.parametrize("share", [0.5, 0.9])
def test_breaker_in_segments_is_the_same_as_along_the_key(spark, share):
    rng, rows = random.Random(3), []
    for service in ("hot", "b", None):
        at = T0
        for i in range(700 if service == "hot" else 60):
            at += timedelta(seconds=rng.choice([0, 1, 2, 5, 9, 31, 100]))
            rows.append((service, i, at, rng.random() < share))
    df = spark.createDataFrame(rows, "service string, n int, at timestamp_ntz, failed boolean").repartition(4)
    got = {(r["service"], r["n"]): (r["state"], r["tripped"]) for r in ordered.breaker(df, ["service"], "at", "n", 3, timedelta(seconds=10), timedelta(seconds=30)).collect()}
    assert len(got) == len(rows)
    for service in ("hot", "b", None):
        own = [(at, f) for s, _, at, f in rows if s == service]
        assert [got[(service, i)] for i in range(len(own))] == sim_breaker(own, 3, timedelta(seconds=10), timedelta(seconds=30))


@pytest.mark.parametrize("capacity", [1, 7, 40])
@pytest.mark.parametrize("segments", [1, 13])
def test_recent_set_is_a_cache_by_last_use(spark, capacity, segments):
    rng = random.Random(capacity)
    rows = [(scope, i, rng.choice([rng.randrange(12), rng.randrange(60)])) for scope in ("x", None) for i in range(400)]
    df = spark.createDataFrame(rows, "scope string, n int, id int").repartition(4)
    cut = (F.col("n") * segments / 400).cast("int")
    got = {(r["scope"], r["n"]): r["is_new"] for r in ordered.recently_seen(df, ["scope"], "id", ["n"], cut, capacity).collect()}
    for scope in ("x", None):
        held = OrderedDict()
        for _, n, x in [r for r in rows if r[0] == scope]:
            assert got[(scope, n)] == (x not in held), (scope, n)
            held[x] = None
            held.move_to_end(x)
            if len(held) > capacity:
                held.popitem(last=False)


def test_compare_and_append(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("d", 1, at(10), at(0)), ("d", 2, at(20), at(5)), ("d", 3, at(30), at(20)), ("d", 4, at(30), at(29)), ("e", 5, at(1), None), ("d", 6, at(40), at(99))]
    df = spark.createDataFrame(rows, "id string, n int, at timestamp_ntz, read_at timestamp_ntz")
    got = {r["n"]: (r["store_version"], r["caller_version"], r["accepted"]) for r in ordered.compare_and_append(df, ["id"], "at", "read_at", "n").collect()}
    # The third read before the second's attempt, which did not count; the fourth read before the third was stored.
    assert got == {1: (1, 1, True), 2: (2, 1, False), 3: (2, 2, True), 4: (3, 2, False), 5: (1, 1, True), 6: (3, 3, True)}


def test_groups_are_decided_as_soon_as_can_be(spark):
    at = lambda s: T0 + timedelta(seconds=s) if s is not None else None
    groups = {
        (1, 0): [("a", "Completed", 1), ("b", "Completed", 3)], (2, 0): [("a", "Completed", 1), ("b", "Cancelled", 2)], (3, 0): [("a", "Failed", 1), ("b", "Running", None)],
        (4, 1): [("a", "Failed", 1), ("b", "Completed", 2), ("c", "Completed", 3)], (5, 1): [("a", "Failed", 1), ("b", "Skipped", 2)],
        (6, 2): [("a", "Completed", 3), ("b", "Failed", 1), ("c", "Completed", 2), ("d", "Failed", 9), ("e", "Completed", 8)], (7, 2): [("a", "Failed", 1), ("b", "Failed", 2), ("c", "Completed", 3)], (8, 2): [("a", "Completed", 1), ("b", "Running", None), ("c", "Failed", 2)],
    }
    rows = [(g, p, e, s, at(t)) for (g, p), own in groups.items() for e, s, t in own]
    got = progression.joined_in_order(spark.createDataFrame(rows, "batch_id int, join_policy int, execution_id string, status string, completed_at timestamp_ntz")).collect()
    outcome = {r["batch_id"]: r["outcome"] for r in got}
    assert outcome == {1: "succeeded", 2: "failed", 3: "open", 4: "succeeded", 5: "failed", 6: "succeeded", 7: "failed", 8: "open"}
    part = {(r["batch_id"], r["execution_id"]): r["part"] for r in got}
    assert [part[(4, e)] for e in "abc"] == ["lost", "won", "cancelled"]
    assert [part[(6, e)] for e in "abcde"] == ["won", "lost", "won", "cancelled", "won"]
    assert [part[(7, e)] for e in "abc"] == ["lost", "lost", "cancelled"]
    assert {r["batch_id"]: r["decided_at"] for r in got}[6] == at(8)


def test_chains_of_any_length(spark):
    rows = [(i, i - 1 if i % 100 else None, T0 + timedelta(hours=i)) for i in range(400)] + [(1000, 77777, T0)]
    df = spark.createDataFrame(rows, "id long, before long, at timestamp_ntz").repartition(4)
    got = {r["id"]: (r["root"], r["depth"], r["latest"]) for r in progression.chains(df, "id", "before", [F.col("at")], checkpointed).collect()}
    assert got == {i: (i // 100 * 100, i % 100, i // 100 * 100 + 99) for i in range(400)} | {1000: (1000, 0, 1000)}
    circle = spark.createDataFrame([(1, 2, T0), (2, 1, T0)], df.schema)
    with pytest.raises(ValueError, match="circle"):
        progression.chains(circle, "id", "before", [F.col("at")], checkpointed).count()


def test_only_rows_that_follow_another_go_through_the_rounds(spark):
    """Of 3,000 runs 64 are one chain; what the rounds write grows with the chain, not with the runs."""
    rows = [(i, i - 1 if 0 < i < 64 else None, T0) for i in range(3000)]
    written = []
    keep = lambda df: written.append(df.count()) or checkpointed(df)
    got = progression.chains(spark.createDataFrame(rows, "id long, before long, at timestamp_ntz"), "id", "before", [F.col("at")], keep)
    assert {tuple(r) for r in got.collect()} == {(i, 0, i, 63) if i < 64 else (i, i, 0, i) for i in range(3000)}
    assert len(written) > 3 and max(written) <= 64


def test_deliveries_die_after_five(spark):
    acks = [0, 0, 1, 0, 0, 0, 0, 0, 0, 1]
    df = spark.createDataFrame([("m", i, bool(a)) for i, a in enumerate(acks)], "m string, n int, ok boolean")
    got = {r["n"]: (r["life"], r["delivery"], r["outcome"]) for r in progression.deliveries(df, "m", ["n"], F.col("ok")).collect()}
    assert [got[i][1] for i in range(10)] == [1, 2, 3, 1, 2, 3, 4, 5, 1, 2] and [got[i][0] for i in range(10)] == [1, 1, 1, 2, 2, 2, 2, 2, 3, 3]
    assert got[7][2] == "dead" and got[2][2] == got[9][2] == "acknowledged"


def test_forwarded_maps(spark):
    rows = [(1, 1, "a", {"x": 1, "y": 1}), (1, 2, "a", {"x": 2}), (1, 2, "b", {"x": 3}), (1, 4, "a", {"z": 9})]
    outputs = spark.createDataFrame(rows, "batch_id int, step_order int, ordinal string, outputs map<string,int>")
    initial = spark.createDataFrame([(1, {"x": 0, "w": 5})], "batch_id int, outputs map<string,int>")
    held = progression.forwarded(outputs, initial)
    steps = spark.createDataFrame([(1, i) for i in range(1, 6)] + [(2, 1)], "batch_id int, step_order int")
    got = {(r["batch_id"], r["step_order"]): r["params"] for r in progression.parameters_of_steps(steps, held).collect()}
    assert got == {(1, 1): {"x": 0, "w": 5}, (1, 2): {"x": 1, "y": 1, "w": 5}, (1, 3): {"x": 3, "y": 1, "w": 5}, (1, 4): {"x": 3, "y": 1, "w": 5}, (1, 5): {"x": 3, "y": 1, "z": 9, "w": 5}, (2, 1): {}}


def test_empty_tables(spark):
    calls = spark.createDataFrame([], "service string, n int, at timestamp_ntz, failed boolean")
    assert ordered.breaker(calls, ["service"], "at", "n").count() == 0
    assert ordered.recently_seen(calls, ["service"], "n", ["at"], F.lit(1), 3).count() == 0
    links = spark.createDataFrame([], "id long, before long")
    assert progression.chains(links, "id", "before", [], checkpointed).count() == 0


def test_failure_routes(spark):
    runs = {  # policy, steps as (outcome, has_undo), number of failure steps
        "stop": (0, [("Completed", True), ("Failed", False), ("Completed", False)], 1),
        "go on": (1, [("Failed", False), ("Completed", False), ("Cancelled", False), ("Completed", False)], 1),
        "undo": (2, [("Completed", True), ("Completed", False), ("Completed", True), ("Failed", True), ("Completed", True)], 2),
        "nothing to undo": (2, [("Completed", False), ("Failed", True)], 0),
        "chain only": (2, [("Failed", True)], 1),
        "cancelled": (2, [("Completed", True), ("Cancelled", False)], 1),
        "fine": (2, [("Completed", True)], 1),
    }
    steps = [(r, i + 1, f"s{i + 1}", o, u, p) for r, (p, own, _) in runs.items() for i, (o, u) in enumerate(own)]
    fallen = [(r, i + 1, f"f{i + 1}") for r, (_, _, n) in runs.items() for i in range(n)]
    rows = progression.failure_route(spark.createDataFrame(steps, "run string, position int, step_id string, outcome string, has_undo boolean, policy int"), spark.createDataFrame(fallen, "run string, position int, step_id string")).collect()
    got = {r: [[f"{x['step_id']} {x['action']}" for x in sorted((x for x in rows if x["run"] == r and x["phase"] == phase), key=lambda x: x["position"])] for phase in ("main", "undo", "failure")] for r in runs}
    assert got["stop"] == [["s1 ran", "s2 failed", "s3 not reached"], [], []]
    assert got["go on"] == [["s1 failed", "s2 ran", "s3 cancelled", "s4 not reached"], [], []]
    assert got["undo"] == [["s1 ran", "s2 ran", "s3 ran", "s4 failed", "s5 not reached"], ["s3:comp undone", "s1:comp undone"], ["f1 ran", "f2 ran"]]
    assert got["nothing to undo"] == [["s1 ran", "s2 failed"], [], []] and got["chain only"] == [["s1 failed"], [], ["f1 ran"]]
    assert got["cancelled"][1:] == [[], []] and got["fine"] == [["s1 ran"], [], []]


def test_second_decisions_are_refused(spark):
    log = [("g", 0, False, "Approved"), ("g", 1, True, None), ("g", 2, False, "Approved"), ("g", 3, False, "Rejected"), ("g", 4, True, None), ("g", 5, False, "Rejected"), ("h", 6, False, "Approved")]
    got = {r["n"]: (r["result"], r["existing"]) for r in progression.recorded(spark.createDataFrame(log, "gate string, n int, saved boolean, outcome string"), "gate", ["n"]).collect()}
    assert got == {0: ("not_found", None), 2: ("recorded", None), 3: ("already_decided", "Approved"), 5: ("recorded", None), 6: ("not_found", None)}


def test_resumed_steps(spark):
    runs = spark.createDataFrame([(1, 1), (2, None)], "batch_id int, cursor int")
    rows = [(1, 1, 1, "Completed"), (1, 2, 2, "Failed"), (1, 2, 2, "Completed"), (1, 3, 3, "Skipped"), (1, 4, 4, "Failed"), (1, 5, 5, "Pending"), (1, 6, 6, "Running"), (2, 1, 1, "Running"), (3, 1, 1, "Completed")]
    executions = spark.createDataFrame(rows, "batch_id int, batch_step_id int, step_order int, status string")
    gates = [(1, 4, None, None, "a"), (1, 5, "Rejected", T0, "b"), (1, 5, "Approved", T0 + timedelta(1), "c"), (1, 5, None, None, "d")]
    got = progression.resumed_steps(runs, executions, spark.createDataFrame(gates, "batch_id int, batch_step_id int, outcome string, decided_at timestamp_ntz, approval_id string")).collect()
    assert {(r["batch_id"], r["batch_step_id"]): r["action"] for r in got} == {(1, 1): "behind", (1, 2): "reuse", (1, 3): "skip", (1, 4): "await", (1, 5): "follow Approved", (1, 6): "dispatch", (2, 1): "dispatch"}
