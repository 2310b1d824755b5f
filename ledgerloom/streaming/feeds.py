"""Change feeds as Structured Streaming: transformations of a stream (or of a table) of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounced(beats: DataFrame, key: str, at: str, late: str = "1 minute", slot: str = "250 milliseconds") -> DataFrame:
    """The last beat of each key in each slot of time."""
    last = beats.withWatermark(at, late).groupBy(key, F.window(at, slot).alias("slot")).agg(F.max_by("value", at).alias("value"), F.max(at).alias("at"))
    return last.select(key, F.col("slot.start").alias("slot"), "value", "at")


def quiet_bursts(requests: DataFrame, key: str, at: str, gap: str, late: str = "1 minute") -> DataFrame:
    """One row per burst, when nothing more came for ``gap``."""
    bursts = requests.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return bursts.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("due_at"), "n")


def first_only(messages: DataFrame, message_id: str, at: str, within: str) -> DataFrame:
    """Each message once, however often it comes within the time; state older than that goes."""
    return messages.withWatermark(at, within).dropDuplicatesWithinWatermark([message_id])


def terminal_only(events: DataFrame, at: str, within: str) -> DataFrame:
    """The first final event of each execution."""
    return first_only(events.where(F.col("status").isin("Completed", "Failed", "Cancelled", "Skipped")), "execution_id", at, within)


def answered(requests: DataFrame, replies: DataFrame, timeout: str, late: str = "1 minute") -> DataFrame:
    """Requests with their reply, or null when none with their ``correlation_id`` came in time.

    Both have ``correlation_id`` and ``at``; state on both sides is bounded by the timeout,
    late and unknown replies are dropped.
    """
    q = requests.withWatermark("at", late).alias("q")
    p = replies.withWatermark("at", late).alias("p")
    in_time = F.expr(f"p.correlation_id = q.correlation_id AND p.at >= q.at AND p.at <= q.at + interval {timeout}")
    return q.join(p, in_time, "left_outer").select("q.correlation_id", F.col("q.at").alias("asked_at"), F.col("p.at").alias("answered_at"))


def liveness(beats: DataFrame, now, online_for: str = "45 seconds", kept_for: str = "10 minutes", most: int = 1000) -> DataFrame:
    """Workers by their last beat: online up to and including ``online_for``, gone after ``kept_for``.

    ``beats`` has ``worker_name``, ``status`` and ``at``; at most the ``most`` latest are
    listed, by name.
    """
    last = beats.groupBy("worker_name").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("last_seen"))
    age = lambda text: F.col("last_seen") + F.expr(f"interval {text}")
    rows = last.where(now <= age(kept_for)).withColumn("online", (F.col("status") == "Online") & (now <= age(online_for)))
    return rows.orderBy(F.col("last_seen").desc(), "worker_name").limit(most).orderBy("worker_name")


def dead_letters(messages: DataFrame, body: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Messages that parse, and those that do not (or have no body), as two frames over one source; fields may all be null."""
    parsed = messages.withColumn("parsed", F.from_json(body, f"{schema}, _unread string", {"columnNameOfCorruptRecord": "_unread"}))
    bad = F.col("parsed").isNull() | F.col("parsed._unread").isNotNull()
    return parsed.where(~bad).withColumn("parsed", F.col("parsed").dropFields("_unread")), parsed.where(bad).drop("parsed")


def drained(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is into a table in memory; for tests and small reports."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
