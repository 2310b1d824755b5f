"""A corpus pipeline of five stages, each of which works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import new_folder, remove_folder, spread
from ledgerloom.llm.exact_dedup import drop_exact_copies
from ledgerloom.llm.minhash import drop_near_copies
from ledgerloom.llm.mixing import mixed_documents
from ledgerloom.llm.packing import pack
from ledgerloom.llm.quality_classifier import classify


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (operator 2) rejects go.

    Every row is judged by its whole text (null as empty) and stays or goes by itself, so
    repeated rows share their fate; without labels the score is a half and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return classify(docs, labels).where(F.col("predicted") == 1).select("row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays (operator 8).

    Null and empty texts are equal. Rows that repeat both id and text all stay or all go;
    a row without id stays only where no equal text has an id.
    """
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays (operator 1), by the same rules for ties, repeats and nulls."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights (operator 6).

    Documents may repeat; those without words go, and null is a source of its own.
    """
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a packed sequence (operator 7); every row is packed, also repeated ones and those without id or text."""
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: A network's scores and hashed candidate search are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what one returns is written and read again for the next, and then removed.

    Texts of any length and further columns, whatever they are called, pass through; an
    empty table gives an empty result.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    folder = new_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if i:
            remove_folder(spark, f"{folder}/{STAGES[i - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
