"""How runs went on: groups joined in the order in which children ended, forwarded outputs, chains of retries, redeliveries, awaits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.status import is_terminal

#: A message that was delivered so often without being acknowledged is dead.
DELIVERY_LIMIT = 5


def joined_in_order(children: DataFrame, group: str = "batch_id", policy: str = "join_policy") -> DataFrame:
    """Children of parallel groups with ``part`` and their group's ``outcome`` and ``decided_at``.

    ``children`` has the group's policy (0 all, 1 any, 2 majority), ``execution_id``, ``status`` and
    ``completed_at``. They end in the order of time and then id; those without a final status
    have not ended. Along that order the group is decided as soon as can be: any, by the first
    that is completed; majority, when more than half are or no longer can be; otherwise when
    all have ended. By then a child has ``won``, or ``lost``; later ones are ``cancelled``; in a
    group that is not decided they are ``open``. Outputs of those that won count. Unknown policies are as all.
    """
    ended = is_terminal(F.col("status")) & F.col("completed_at").isNotNull()
    rows = children.withColumn("_ended", ended)
    whole = Window.partitionBy(group)
    order = whole.orderBy(F.col("_ended").desc(), "completed_at", "execution_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done, bad = F.col("_ended") & (F.col("status") == "Completed"), F.col("_ended") & (F.col("status") != "Completed")
    rows = rows.select(
        "*", F.count(F.lit(1)).over(whole).alias("_n"), F.row_number().over(order).alias("_i"), F.count_if(done).over(so_far).alias("_done"), F.count_if(bad).over(so_far).alias("_bad"),
        F.coalesce(F.bool_or(F.col("_ended") & F.col("status").isin("Failed", "Cancelled")).over(so_far), F.lit(False)).alias("_failed"),
    )
    n, quorum, last = F.col("_n"), F.expr("_n div 2 + 1"), F.col("_i") == F.col("_n")
    verdict = (
        F.when(~F.col("_ended"), None)
        .when(F.col(policy) == 1, F.when(F.col("_done") >= 1, "succeeded").when(last, "failed"))
        .when(F.col(policy) == 2, F.when(F.col("_done") >= quorum, "succeeded").when(F.col("_bad") > n - quorum, "failed"))
        .otherwise(F.when(last, F.when(F.col("_failed"), "failed").otherwise("succeeded")))
    )
    rows = rows.withColumn("_verdict", verdict)
    first = F.min(F.when(F.col("_verdict").isNotNull(), F.struct("_i", "_verdict", "completed_at"))).over(whole)
    rows = rows.withColumn("_first", first)
    at = F.col("_first._i")
    part = F.when(at.isNull(), F.when(F.col("_ended"), F.when(done, "won").otherwise("lost")).otherwise("open")).when(F.col("_i") > at, "cancelled").when(done, "won").otherwise("lost")
    return rows.select(*children.columns, part.alias("part"), F.coalesce("_first._verdict", F.lit("open")).alias("outcome"), F.col("_first.completed_at").alias("decided_at"))


def forwarded(outputs: DataFrame, initial: DataFrame, run: str = "batch_id") -> DataFrame:
    """``run, key, value, from_step, until_step``: the value of a key that is forwarded to steps ``from_step`` to before ``until_step``.

    ``outputs`` has ``step_order``, ``ordinal`` (the order of a step's children) and ``outputs``, a map, of executions
    that are done; ``initial`` the map with which a run begins (persisted state, for one that goes on).
    Later steps overwrite keys of earlier ones, and of the children of a step the last does.
    What a step gives is seen from the next on. The rows grow with the outputs, not
    with outputs times steps; ``until_step`` is null for what holds to the end.
    """
    own = outputs.select(run, (F.col("step_order") + 1).alias("from_step"), "ordinal", F.explode("outputs").alias("key", "value"))
    first = initial.select(run, F.lit(None).cast("int").alias("from_step"), F.explode("outputs").alias("key", "value"))
    last = own.groupBy(run, "key", "from_step").agg(F.max_by("value", "ordinal").alias("value"))
    rows = last.unionByName(first.select(run, "key", "from_step", "value"))
    after = F.lead("from_step").over(Window.partitionBy(run, "key").orderBy(F.col("from_step").asc_nulls_first()))
    return rows.select(run, "key", "value", "from_step", after.alias("until_step"))


def parameters_of_steps(steps: DataFrame, held: DataFrame, run: str = "batch_id") -> DataFrame:
    """Each of the distinct ``run, step_order`` with ``params``, the map that is forwarded to it (empty if nothing is)."""
    at = F.col("step_order")
    reach = (F.col("from_step").isNull() | (F.col("from_step") <= at)) & (F.col("until_step").isNull() | (F.col("until_step") > at))
    pairs = steps.select(run, "step_order").distinct().join(held, run, "left")
    given = F.sort_array(F.collect_list(F.when(reach & F.col("key").isNotNull(), F.struct("key", "value"))))
    return pairs.groupBy(run, "step_order").agg(F.map_from_entries(given).alias("params"))


def chains(links: DataFrame, id_: str, before: str, order: list[Column], checkpoint) -> DataFrame:
    """``id_, root, depth, latest``: where a chain of retries began, how far each is from it, and the last one of the chain.

    Links double their reach each round (a row that knows the one 2^k before it learns that
    one's), so a chain of length n takes log2(n) joins. Only rows that follow another take part, and ``checkpoint`` cuts
    their lineage after each round; what follows nothing is its own root and is joined once, at the end.
    A ``before`` that is not there is itself the root's; rows without one are roots; circles end with an error.
    """
    every = links.select(F.col(id_).alias("id"), F.struct(*order, F.col(id_)).alias("_o"))
    known = links.select(F.col(id_).alias("at"))
    after = links.select(F.col(id_).alias("id"), F.col(before).alias("at")).where("at is not null and id is not null")
    start = checkpoint(after.join(known, "at", "left_semi"))
    follower = start.select(F.col("id").alias("at"), F.lit(True).alias("follows"))
    state = checkpoint(start.join(follower, "at", "left").select("id", "at", F.lit(1).cast("long").alias("depth"), F.col("follows").isNull().alias("done")))
    parts, rounds = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), state.count().bit_length() + 1
    while state.where("not done").limit(1).count():
        rounds -= 1
        if not rounds:  # no chain is longer than there are rows
            raise ValueError("links form a circle")
        above = state.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("depth").alias("depth2"), F.col("done").alias("done2"))
        moving = state.where("not done").join(above, "at").select("id", F.col("at2").alias("at"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done"))
        state = checkpoint(state.where("done").unionByName(moving).coalesce(parts))
    roots = state.select("at").distinct().select(F.col("at").alias("id"), "at", F.lit(0).cast("long").alias("depth"))
    members = checkpoint(state.select("id", "at", "depth").unionByName(roots).join(every, "id"))
    last = members.groupBy("at").agg(F.max_by("id", "_o").alias("latest"))
    placed = members.drop("_o").join(last, "at")
    return every.select("id").join(placed, "id", "left").select(F.col("id").alias(id_), F.coalesce("at", "id").alias("root"), F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.coalesce("latest", "id").alias("latest"))


def deliveries(log: DataFrame, message: str, order: list[str], acknowledged: Column, limit: int = DELIVERY_LIMIT) -> DataFrame:
    """An at-least-once log with the ``life`` of a message that a delivery belongs to, its ``delivery`` number and ``outcome``.

    An acknowledgement ends a life, and so does the delivery that is the ``limit``-th without one,
    which makes the message ``dead``; what comes after is the message sent anew. Gaps and islands:
    acknowledgements before a row tell the island, and its place there the delivery.
    """
    own = Window.partitionBy(message).orderBy(*order)
    rows = log.withColumn("_ok", F.coalesce(acknowledged, F.lit(False)))
    rows = rows.withColumn("_island", F.coalesce(F.count_if("_ok").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy(message, "_island").orderBy(*order)) - 1
    rows = rows.withColumn("_place", place).withColumn("delivery", (F.col("_place") % limit + 1).cast("int"))
    starts = F.when(F.col("delivery") == 1, 1).otherwise(0)
    outcome = F.when(F.col("_ok"), "acknowledged").when(F.col("delivery") == limit, "dead").otherwise("redelivered")
    return rows.select(*log.columns, F.sum(starts).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("life"), "delivery", outcome.alias("outcome"))


def awaited(waits: DataFrame, ends: DataFrame) -> DataFrame:
    """``waits`` with ``outcome``, ``status`` and ``resolved_at``.

    A wait has ``execution_id``, ``asked_at`` and ``due_at``; ``ends`` has ``execution_id``, ``status`` and ``at`` of final
    events, of which the first counts. An execution that had ended is caught up with at once; one
    that ends by the time due is ``ended``; else the wait is ``timed_out`` when it is due.
    """
    first = ends.groupBy("execution_id").agg(F.min(F.struct("at", "status")).alias("_end"))
    rows = waits.join(first, "execution_id", "left")
    at = F.col("_end.at")
    outcome = F.when(at <= F.col("asked_at"), "caught_up").when(at <= F.col("due_at"), "ended").otherwise("timed_out")
    resolved = F.when(at <= F.col("due_at"), F.greatest(at, F.col("asked_at"))).otherwise(F.col("due_at"))
    return rows.select(*waits.columns, outcome.alias("outcome"), F.when(at <= F.col("due_at"), F.col("_end.status")).alias("status"), resolved.alias("resolved_at"))


def recorded(log: DataFrame, gate: str, order: list[str]) -> DataFrame:
    """Decisions of a log with ``result`` and ``existing``, the outcome that stood.

    The log has ``saved`` (a row opens its gate, also anew) and else an ``outcome``. A gate that was never saved is
    ``not_found``; the first decision since it was saved is ``recorded``, and later ones are ``already_decided``.
    """
    own = Window.partitionBy(gate).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumn("_saves", F.count_if("saved").over(own))
    first = F.first(F.when(~F.col("saved"), F.struct("outcome", *order)), ignorenulls=True).over(Window.partitionBy(gate, "_saves").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    is_first = F.lit(True)
    for c in order:
        is_first &= F.col(f"_first.{c}") == F.col(c)
    result = F.when(F.col("_saves") == 0, "not_found").when(is_first, "recorded").otherwise("already_decided")
    found = rows.withColumn("_first", first).where(~F.col("saved"))
    return found.select(*log.columns, result.alias("result"), F.when(result == "already_decided", F.col("_first.outcome")).alias("existing"))


def resumed_steps(runs: DataFrame, executions: DataFrame, gates: DataFrame) -> DataFrame:
    """What a resumed run does with each of its steps: ``batch_id, batch_step_id, action``.

    Steps before the run's ``cursor`` are ``behind`` it. Of the others one that completed in any attempt is not run
    again, but its outputs forwarded (``reuse``); a skipped one is skipped; the outcome of a step's last decided
    gate is followed, and a pending one is awaited; all else is dispatched anew, failed and unfinished attempts too.
    """
    steps = executions.where("batch_step_id is not null").groupBy("batch_id", "batch_step_id").agg(
        F.min("step_order").alias("_order"), F.bool_or(F.col("status") == "Completed").alias("_done"), F.bool_or(F.col("status") == "Skipped").alias("_skipped")
    )
    state = gates.groupBy("batch_id", "batch_step_id").agg(F.max_by("outcome", F.when(F.col("outcome").isNotNull(), F.struct("decided_at", "approval_id"))).alias("_outcome"), F.bool_or(F.col("outcome").isNull()).alias("_pending"))
    rows = steps.join(runs.select("batch_id", "cursor"), "batch_id").join(state, ["batch_id", "batch_step_id"], "left")
    action = F.when(F.col("_order") <= F.coalesce("cursor", F.lit(0)), "behind").when(F.col("_done"), "reuse").when(F.col("_skipped"), "skip")
    action = action.when(F.col("_outcome").isNotNull(), F.concat(F.lit("follow "), "_outcome")).when(F.col("_pending"), "await").otherwise("dispatch")
    return rows.select("batch_id", "batch_step_id", action.alias("action"))


def start_index(policy: Column, step: Column, cursor: Column, steps: Column) -> Column:
    """The step at which a run begins again: its cursor (``Forward``), the first (``RestartAll``) or ``step`` (``RestartFrom``), within 0 to the number of steps."""
    asked = F.when(policy == "RestartFrom", F.coalesce(step, F.lit(0))).when(policy == "Forward", F.coalesce(cursor, F.lit(0))).otherwise(0)
    return F.least(F.greatest(asked, F.lit(0)), steps)


def failure_route(steps: DataFrame, failure_steps: DataFrame, run: str = "run") -> DataFrame:
    """What a run does with its steps: ``run, phase, position, step_id, action``.

    ``steps`` has ``position`` (from 1), ``step_id``, ``outcome``, ``has_undo`` and the run's ``policy`` (0 stop,
    1 continue, 2 compensate; others stop), ``failure_steps`` has ``position`` and ``step_id``. A failed step ends the
    main sequence unless the run continues, and a cancelled one always does. A run that compensates undoes
    what was done before, last first, and then runs its failure steps in order; with nothing to undo
    and no failure steps it just stops, and so does a cancelled run.
    """
    whole = Window.partitionBy(run)
    ends = (F.col("outcome") == "Cancelled") | ((F.col("outcome") == "Failed") & (F.col("policy") != 1))
    rows = steps.withColumn("_stop", F.min(F.when(ends, F.struct("position", "outcome"))).over(whole))
    at, before = F.col("_stop.position"), F.col("position") < F.col("_stop.position")
    chains_ = failure_steps.groupBy(run).agg(F.count(F.lit(1)).alias("_chain"))
    rows = rows.withColumn("_undo", F.coalesce(F.bool_or(before & F.col("has_undo")).over(whole), F.lit(False))).join(chains_, run, "left")
    rows = rows.withColumn("_back", F.coalesce((F.col("policy") == 2) & (F.col("_stop.outcome") == "Failed") & (F.col("_undo") | F.col("_chain").isNotNull()), F.lit(False)))
    action = F.when(F.col("position") > at, "not reached").when(F.col("outcome").isin("Failed", "Cancelled"), F.lower("outcome")).otherwise("ran")
    main = rows.select(run, F.lit("main").alias("phase"), "position", "step_id", action.alias("action"))
    last_first = F.row_number().over(Window.partitionBy(run).orderBy(F.col("position").desc()))
    undone = rows.where(F.col("_back") & before & F.col("has_undo")).select(run, F.lit("undo").alias("phase"), last_first.alias("position"), F.concat("step_id", F.lit(":comp")).alias("step_id"), F.lit("undone").alias("action"))
    back = rows.where("_back").select(run).distinct()
    fallen = failure_steps.join(back, run, "left_semi").select(run, F.lit("failure").alias("phase"), "position", "step_id", F.lit("ran").alias("action"))
    return main.unionByName(undone).unionByName(fallen)


def cross_service(steps: DataFrame, replies: DataFrame, key: list[str]) -> DataFrame:
    """Steps that another service runs, with ``shadow_status`` (of their row in this ledger), ``returned``, ``effect`` and ``outputs``.

    ``steps`` has ``nested`` (a child of a group) and ``due_at``, ``replies`` the final ``status``, ``replied_at`` and ``outputs``; of
    replies to one step the first counts. Without one by then the step has timed out, which is a failure. A
    step that was cancelled over there has failed in this ledger. A step of the sequence that did not complete
    throws; a child hands what came back, cancelled too, to its group's join. Outputs count if it completed.
    """
    first = replies.groupBy(*key).agg(F.min(F.struct("replied_at", "status", "outputs")).alias("_r"))
    rows = steps.join(first, key, "left")
    in_time = F.coalesce(F.col("_r.replied_at") <= F.col("due_at"), F.lit(False))
    returned = F.when(in_time, F.col("_r.status")).otherwise("Failed")
    failed = returned.isin("Failed", "Cancelled")
    effect = F.when(F.col("nested"), "joins").when(failed, "throws").otherwise("goes on")
    return rows.select(
        *steps.columns, F.when(returned == "Cancelled", "Failed").otherwise(returned).alias("shadow_status"), returned.alias("returned"), effect.alias("effect"),
        F.when(returned == "Completed", F.col("_r.outputs")).alias("outputs"), (~in_time).alias("timed_out"),
    )
