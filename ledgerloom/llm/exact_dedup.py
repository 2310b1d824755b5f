"""Exact deduplication of whole documents.

Texts are equal when they are identical once each run of white space is one space. Rows
are grouped by a 128-bit hash of that text *and its bytes*: the hash spreads and sorts the
groups, the byte comparison inside a hash group keeps colliding texts apart. Copies are
folded on the map side, so a text that a third of all rows share reaches the reducers
as one row a task, never as one huge group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import squeezed, whole_text


def hash128(text: Column) -> Column:
    """16 bytes that place a text in its group."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", content_hash: Callable[[Column], Column] = hash128) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``keep_id`` is the smallest id of the group, ``kept`` marks the row that has it.
    Null text counts as empty, texts of any length are compared whole. Rows that repeat both id and text are the same row: all of
    them carry the same flags. A null id is kept only in a group without any other id.
    An empty table gives an empty result; other columns of ``docs`` are not looked at.

    A member finds its group by hash and SHA-256, so that no text is shuffled a second
    time; ``content_hash`` may be weak (tests use a constant), as groups differ in bytes.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), squeezed(whole_text(text_column)).alias("_text"))
    rows = rows.withColumn("_hash", content_hash(F.col("_text")))
    groups = (
        rows.groupBy("_hash", "_text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("doc_id", "_hash", F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256"))
    return members.join(groups, ["_hash", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of equal texts the smallest id.

    The ids that go are found on hashes alone; the documents meet them once, in a left
    anti join on the id and its content hash. Rows that repeat the id and the text of the
    one that stays all stay. Nulls, empty and long texts are as in :func:`exact_groups`;
    an empty table gives an empty result.
    """
    flags = exact_groups(docs, id_column, text_column)
    gone = flags.where(~F.col("kept")).select(F.col("doc_id").alias("_gone_id"), F.col("text_sha256").alias("_gone_sha")).distinct()
    sha = F.sha2(squeezed(whole_text(text_column)).cast("binary"), 256)
    return docs.join(gone, F.col(id_column).eqNullSafe(F.col("_gone_id")) & (sha == F.col("_gone_sha")), "left_anti")
