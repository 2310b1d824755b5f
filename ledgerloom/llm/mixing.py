"""Mixing sources to target weights, on DataFrame functions alone.

Every document gets a hash-random key. The key space of a source is cut into ranges (the
key's leading hex digits), whose token counts are summed up on the map side; prefix sums
over the ranges of a source tell in which range its budget ends, and only that range is
sorted. So each source gets a *line*, the one place in its key order where it is cut, and
a document's share follows from comparing its own key with the line: neither texts nor
short rows are sorted or shuffled as a whole, and the heaviest source is no harder than
any other.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, sent, whole_text, word_count

#: Weights of the sources in code-point order, repeating; no document is taken more often than MAX_EPOCHS.
WEIGHTS, MAX_EPOCHS = (1, 2, 3), 3
#: A range of keys is to have about so many documents; it is named by 3 or more leading hex digits.
RANGE_ROWS, RANGE_DIGITS = 200_000, 3
_ZERO = "cast(0 as bigint)"


def random_key(doc_id: Column, seed: str = "mix") -> Column:
    """32 hex digits that depend on the id and the seed alone, so that reruns agree."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for each row of ``source, source_size``.

    Sources in code-point order, null last, weigh ``weights`` in turn and share all
    tokens. A target stops at ``max_epochs`` times its source's size and the excess is
    shared again by weight until none is above: the sources by (limit / weight) ascending
    are limited as long as the limit is at most their share of what is left, which whole
    numbers decide exactly. The table has one short row per source.
    """
    scale = 1
    for w in weights:
        scale *= w
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (((rank - 1) % len(weights)) + 1).cast("int")).cast("long")
    table = sizes.select("source", "source_size", weight.alias("w"), (F.col("source_size") * max_epochs).alias("cap"))
    ratio = F.col("cap") * (F.lit(scale).cast("long") / F.col("w")).cast("long")
    by_ratio = Window.orderBy(ratio, F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(1))
    table = table.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)).alias("w_left"),
    )
    table = table.withColumn("capped", F.col("cap") * F.col("w_left") <= (F.col("total") - F.col("before")) * F.col("w"))
    free = F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)
    w_free = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything)
    share = (free * F.col("w")).cast("double") / w_free.cast("double")
    return table.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def short_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``doc_id, source, size, key, hash`` of each row; texts are looked at once, here."""
    text = whole_text()
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"), random_key(F.col("doc_id"), seed).alias("key"), F.xxhash64(text).alias("hash"))
    return checkpointed(rows)


def source_lines(rows: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One short row per source: ``source, source_size, target, whole, line_key, line_size, line_hash, share``.

    Each document of the source is taken ``whole`` times, and once more if it stands
    before the line in the order of (key, size, hash); a document on the line gives
    ``share`` words more. Without a line the rest of the budget is 0. Rows that agree in
    all three (equal ids and texts) share what is left on the line evenly.

    Ranges, then the (key, size) pairs of one range, then the hashes of one pair are
    summed up, each on the map side first, so that ids that a third of all rows share
    (nulls) narrow down like others.
    """
    digits = max(RANGE_DIGITS, math.ceil(math.log(max(1, rows.count() / range_rows), 16)))
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    ranges = checkpointed(rows.groupBy("source", "range").agg(F.sum("size").alias("n")))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("n").alias("source_size")), weights, max_epochs)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as bigint) div source_size")).otherwise(F.expr(_ZERO))
    targets = targets.withColumn("whole", whole).withColumn("left", budget - F.col("whole") * F.col("source_size"))

    def cut(groups: DataFrame, order: list[str]) -> DataFrame:
        """Of each source's groups in order the one in which ``left`` ends; ``left`` is counted from its beginning."""
        along = Window.partitionBy("source").orderBy(*order)
        before = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.expr(_ZERO))
        return groups.withColumn("before", before).where("left > before and left <= before + n").withColumn("left", F.col("left") - F.col("before"))

    def within(found: DataFrame, columns: list[str]) -> DataFrame:
        """The rows that agree with ``found`` in the columns (null agrees with null), and ``left``."""
        found = checkpointed(found.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in columns], "left"))
        same = F.col("source").eqNullSafe(F.col("_source"))
        for c in columns:
            same &= F.col(c) == F.col(f"_{c}")
        return rows.join(sent(found), same)

    def matched(groups: DataFrame) -> DataFrame:
        t = targets.select(F.col("source").alias("_source"), "left")
        return groups.join(t, F.col("source").eqNullSafe(F.col("_source")))

    in_range = cut(matched(ranges), ["range"])
    pairs = within(in_range, ["range"]).groupBy("source", "key", "size").agg(F.sum("size").alias("n"), F.first("left").alias("left"))
    in_pair = cut(pairs, ["key", "size"])
    hashes = within(in_pair, ["key", "size"]).groupBy("source", "key", "size", "hash").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("left").alias("left"))
    lines = cut(hashes, ["hash"]).select(F.col("source").alias("_source"), F.col("key").alias("line_key"), F.col("size").alias("line_size"), F.col("hash").alias("line_hash"), F.expr("left div copies").alias("share"))
    return checkpointed(targets.drop("left").join(lines, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source"))


def _beside(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows with their source's line; the one short row per source is broadcast if there are few, which is checked."""
    return rows.join(sent(lines.withColumnRenamed("source", "_source")), F.col("source").cast("string").eqNullSafe(F.col("_source")))


def _triple(*columns: str | Column) -> Column:
    """Key, size and hash as one value that is compared from left to right."""
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in zip(columns, "ksh")])


def mix_plan(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", **options) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` is the number of its words in the mix, repeats counted: full epochs first,
    then the documents in key order until the source's budget (its target, rounded) is
    used up; the document on the line gives the words that are missing. Null text has no
    words, whole texts of any length count, and null source is a source of its own; rows
    with equal ids are ordered by size and hash of the text. An empty table gives an
    empty result, and other columns are not looked at.
    """
    rows = short_rows(docs, seed)
    at, line = _triple("key", "size", "hash"), _triple("line_key", "line_size", "line_hash")
    more = F.when(F.col("line_key").isNull() | (at > line), F.expr(_ZERO)).when(at < line, F.col("size")).otherwise(F.col("share"))
    return _beside(rows, source_lines(rows, weights, max_epochs, **options)).select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + more).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: rows of ``docs``, all columns, as often as they are taken.

    A document on its source's line comes once more with its first words only (joined by
    single spaces); documents of which nothing is taken, the null and empty ones among
    them, go. Texts of any length are handed on as they are, and rows that repeat are
    taken like others. An empty table gives an empty result. The documents are passed
    over once, beside one short row per source; only those on a line are counted again.
    """
    lines = source_lines(short_rows(docs, seed), weights, max_epochs, **options)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("source"), random_key(F.col("doc_id"), seed).alias("key"), whole_text().alias("_text"))
    at, line = _triple("key", word_count(F.col("_text")), F.xxhash64("_text")), _triple("line_key", "line_size", "line_hash")
    on_line = F.col("line_key").isNotNull() & (F.col("key") == F.col("line_key"))
    once = F.when(F.col("line_key").isNull() | (F.col("key") > F.col("line_key")), 0).when(F.col("key") < F.col("line_key"), 1).when(at > line, 0).otherwise(1)
    part = F.when(on_line & (at == line) & (F.col("share") < F.col("line_size")), F.col("share"))
    copies = F.when(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.col("whole") + once).otherwise(F.expr(_ZERO))
    rows = _beside(rows, lines).select("row", copies.cast("int").alias("copies"), part.alias("part")).where("copies > 0")
    rows = rows.select("row", "part", "copies", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    cut = (F.col("copy") == F.col("copies")) & F.col("part").isNotNull()
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    text = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("part").cast("int")), " ")).otherwise(F.col("row.text"))
    rows = rows.where(~cut | (F.col("part") > 0))
    return rows.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
