"""Rules that depend on order: folds along the rows of a key, and how a hot key's are cut into segments.

:func:`ordered_fold` streams the sorted rows of a key through a small state, so a key may have any number of rows in
bounded memory, but has one task. Where one key may be hot, its rows are cut into segments: what a segment does to any
state that it may begin with is found for all segments side by side, these functions are composed
along the key (short rows), and then the segments are folded from the states found.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator
from datetime import timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def ordered_fold(rows: DataFrame, keys: list[str], order: list[str], fresh: Callable[[dict], object], step: Callable[[object, dict], tuple], result: str, finish: Callable[[object, dict], tuple] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of each row (all, if not given) with what ``step`` returns for it, row by row along each key.

    ``fresh`` makes the state of a key from its first row, ``step`` changes it in place. With
    ``finish`` there is one row a key instead, the last one with what that returns of the state. A
    key's rows are sorted in one task and pass it in batches; the state alone is held.
    """
    keep = rows.columns if keep is None else keep
    added = T._parse_datatype_string(result)
    schema = T.StructType([*[rows.schema[c] for c in keep], *added.fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, last = None, None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[c] for c in keys)
                if state is None or own != key:
                    if finish and state is not None:
                        out.append([*(last[c] for c in keep), *finish(state, last)])
                    key, state = own, fresh(row)
                got = step(state, row)
                if not finish:
                    out.append([*(row[c] for c in keep), *got])
                last = row
            yield _batch(out, arrow)
        if finish and state is not None:
            yield _batch([[*(last[c] for c in keep), *finish(state, last)]], arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def _with(rows: DataFrame, more: DataFrame, on: list[str], column: str) -> DataFrame:
    """``rows`` with a column of the one row of ``more`` that has the same keys, null ones too."""
    a, b = rows.alias("a"), more.alias("b")
    same = F.lit(True)
    for c in on:
        same &= F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`"))
    return a.join(b, same).select("a.*", f"b.{column}")


class Breaker:
    """A breaker's state: what it has seen while closed, or until when it is open.

    Closed, it opens at a failure if the calls of the last ``sampling`` are ``trips`` or more
    and all failed. Open, it refuses calls, which then count for nothing; the first call after ``pause`` is let
    through, and closes it, or opens it for as long again.
    """

    def __init__(self, trips: int, sampling: timedelta, pause: timedelta, ready: bool = False):
        self.trips, self.sampling, self.pause = trips, sampling, pause
        self.open, self.until, self.seen, self.good = ready, None, deque(), 0

    def call(self, at, failed: bool) -> tuple[str, bool]:
        """The state in which the call finds it, and whether it opens it."""
        if self.open and self.until is not None and at < self.until:
            return "open", False
        if self.open:
            state, trips = "half_open", failed
            self.open = False
        else:
            state = "closed"
            while self.seen and self.seen[0][0] <= at - self.sampling:
                self.good -= not self.seen.popleft()[1]
            self.seen.append((at, failed))
            self.good += not failed
            trips = failed and not self.good and len(self.seen) >= self.trips
        if trips or state == "half_open":
            self.seen.clear()
            self.good = 0
        if trips:
            self.open, self.until = True, at + self.pause
        return state, trips


def breaker(calls: DataFrame, keys: list[str], at: str, number: str, trips: int = 5, sampling: timedelta = timedelta(seconds=30), pause: timedelta | None = None) -> DataFrame:
    """Calls (``keys``, ``at``, ``number`` and ``failed``) with the ``state`` they found and ``tripped``; refused ones found it open.

    A key is cut where it is silent for so long that whatever was seen is forgotten and an open breaker
    is ready to be tried. A segment so begins closed or ready, and what it makes of each is
    a function of two values: constant, identity or exchange. The state at its beginning is the last constant's
    value, exchanged as often as there were exchanges since. Rows of equal time are in order
    of ``number``; calls without a time are left out, null ``failed`` counts as good.
    """
    pause = pause or sampling
    span = int(max(sampling, pause) / timedelta(microseconds=1))
    rows = calls.where(F.col(at).isNotNull()).select(*keys, at, number, F.coalesce("failed", F.lit(False)).alias("failed"))
    rows = rows.withColumn("_span", F.floor(F.unix_micros(F.col(at).cast("timestamp")) / span))
    along = Window.partitionBy(*keys).orderBy("_span")
    spans = rows.select(*keys, "_span").distinct()
    begins = F.when(F.coalesce(F.lag("_span").over(along) < F.col("_span") - 1, F.lit(True)), F.col("_span"))
    spans = spans.withColumn("_begins", begins).withColumn("_segment", F.last("_begins", ignorenulls=True).over(along)).drop("_begins")
    cut = _with(rows, spans, [*keys, "_span"], "_segment").drop("_span")

    def both(state: list[Breaker], row: dict) -> tuple:
        for one in state:
            one.call(row[at], row["failed"])
        return ()

    ends = ordered_fold(
        cut, [*keys, "_segment"], [at, number], lambda _: [Breaker(trips, sampling, pause, ready) for ready in (False, True)], both, "closed boolean, ready boolean",
        finish=lambda state, _: tuple(one.open for one in state), keep=[*keys, "_segment"],
    )
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    constant, swaps = F.when(F.col("closed") == F.col("ready"), F.col("closed")), F.count_if(F.col("closed") & ~F.col("ready")).over(before)
    entries = ends.withColumn("_set", F.last(constant, ignorenulls=True).over(before)).withColumn("_swaps", F.coalesce(swaps, F.lit(0)))
    since = F.coalesce(F.last(F.when(constant.isNotNull(), F.col("_swaps")), ignorenulls=True).over(before), F.lit(0))
    entries = entries.withColumn("_entry", F.coalesce("_set", F.lit(False)) != ((F.col("_swaps") - since) % 2 == 1)).select(*keys, "_segment", "_entry")
    begun = _with(cut, entries, [*keys, "_segment"], "_entry")
    return ordered_fold(
        begun, [*keys, "_segment"], [at, number], lambda row: Breaker(trips, sampling, pause, row["_entry"]), lambda state, row: state.call(row[at], row["failed"]), "state string, tripped boolean",
        keep=[*keys, at, number, "failed"],
    )


def recently_seen(rows: DataFrame, scope: list[str], id_: str, order: list[str], segment: Column, capacity: int) -> DataFrame:
    """Rows with ``is_new``: whether a set of the ``capacity`` last used ids of the scope did not hold the row's id.

    Being found is being used, so an id is new again when that many others came since it
    came last. ``segment`` (ascending along the order) cuts a scope: the set at the beginning of a segment
    is what was used last before it, which the last uses within each earlier segment give.
    """
    cut = rows.withColumn("_segment", segment)
    last = cut.groupBy(*scope, "_segment", id_).agg(F.max(F.struct(*order)).alias("_last"))
    latest = Window.partitionBy(*scope, "_segment").orderBy(F.col("_last").desc())
    used = last.withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= capacity).drop("_n")

    class Recent(OrderedDict):
        def use(self, x) -> bool:
            new = x not in self
            self[x] = None
            self.move_to_end(x)
            if len(self) > capacity:
                self.popitem(last=False)
            return new

    class Along:
        """The set before each segment, given out when the segment begins."""

        def __init__(self):
            self.set, self.segment = Recent(), None

        def step(self, row: dict) -> tuple:
            begun = row["_segment"] != self.segment
            held = list(self.set) if begun else None
            self.segment = row["_segment"]
            self.set.use(row[id_])
            return (held,)

    kind = rows.schema[id_].dataType.simpleString()
    seeds = ordered_fold(used, scope, ["_segment", "_last"], lambda _: Along(), Along.step, f"_held array<{kind}>", keep=[*scope, "_segment"])
    seeds = seeds.select(*scope, "_segment", F.posexplode("_held").alias("_seed", id_))
    both = cut.withColumn("_seed", F.lit(None).cast("int")).unionByName(seeds, allowMissingColumns=True)
    both = both.withColumn("_own", F.col("_seed").isNull())
    found = ordered_fold(both, [*scope, "_segment"], ["_own", "_seed", *order], lambda _: Recent(), lambda state, row: (state.use(row[id_]),), "is_new boolean")
    return found.where("_own").select(*rows.columns, "is_new")


class Versions:
    """The times at which a record was changed; its version is their number and one."""

    def __init__(self):
        self.times: list = []

    def attempt(self, at, read_at) -> tuple[int, int, bool]:
        """The version that is stored and the one that was read, and whether the change counts."""
        stored, read = len(self.times) + 1, bisect_right(self.times, read_at) + 1
        if stored == read:
            self.times.append(at)
        return stored, read, stored == read


def compare_and_append(attempts: DataFrame, keys: list[str], at: str, read_at: str, number: str) -> DataFrame:
    """Attempts to change a record, with ``store_version``, ``caller_version`` and ``accepted``.

    Whoever changes a record names the version that was stored when they read it; the
    change counts, and makes the next version, if that is still the stored one. Attempts
    of one time are in order of ``number``; one that names no time of reading read at once.
    """
    rows = attempts.withColumn(read_at, F.least(F.coalesce(read_at, at), at))
    return ordered_fold(rows, keys, [at, number], lambda _: Versions(), lambda state, row: state.attempt(row[at], row[read_at]), "store_version long, caller_version long, accepted boolean")
