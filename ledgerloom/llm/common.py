"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space and the words that every contract of this subpackage speaks of.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Runs of white space that are anything but one space.
_UNEVEN = r"\x20[\x20\x09-\x0D]+|[\x09-\x0D][\x20\x09-\x0D]*"
#: A side is broadcast if it has at most so many short rows, which is counted.
SENT_ROWS = 100_000
#: Inputs below so many bytes are dealt out before Python or long expressions work on them.
SMALL_INPUT = 32 << 20
#: Bytes of a batch of rows that is handed to Python.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one input table; nothing else is read."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))


def spread(df: DataFrame) -> DataFrame:
    """A small input in fewer parts than there are cores is dealt over all: a file of one row group would be one task.

    Larger inputs, and those in many parts, are left as they are.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < SMALL_INPUT and df.rdd.getNumPartitions() < cores else df


def whole_text(column: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text with each run of white space as one space; most words are followed by one and cost no match."""
    return F.regexp_replace(text, _UNEVEN, " ")


def word_count(text: Column) -> Column:
    """Number of words; 0 for an empty text."""
    line = F.trim(squeezed(text))
    inner = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", F.lit(0)).otherwise(inner + 1).cast("long")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents whose labels are never learnt from."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """``doc_id, y`` of the labels 0 and 1 that may be learnt from; of contradicting ones the larger counts."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``.

    A local session that names none (a test) gets a temporary one; on a cluster that is
    an error, as executors would not share it.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the rows to the shared checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """``df``, which reads a checkpoint or table; Spark is told to remove the shuffle files that nothing needs any more.

    Its cleaner acts when the driver collects garbage, which a long query may not do by
    itself; what Python has dropped is handed over to the JVM once a second.
    """
    gc.collect()
    time.sleep(1.2)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a table that was written to the shared folder and is not read any more."""
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session from now on hands rows to Python in batches of at most BATCH_BYTES (or one row)."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def sent(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df``, a checkpoint of short rows, to be broadcast if it has at most SENT_ROWS (``rows`` if known); else it is shuffled."""
    rows = df.limit(SENT_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if rows <= SENT_ROWS else df


def width(df: DataFrame) -> int:
    """Number of partitions for an explicit repartition: the session's own."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def with_text(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under numbered names, and the whole ``text``: no name can clash in Python."""
    return docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], whole_text().alias("text"))


def rows_of(docs: DataFrame) -> Column:
    """The numbered columns as a struct ``row`` with their own names."""
    return F.struct(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]).alias("row")
