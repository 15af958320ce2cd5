"""A corpus cleaned in five stages, each written as Parquet in the shared folder and read again.

quality drops documents that the classifier rejects, line_dedup takes repeated three-line
passages out of the texts (and drops documents of which nothing is left), near_dedup keeps one document of each group of near copies,
decontaminate drops documents that hold benchmark passages, and mix samples what is left towards
the target marginals and adds its columns.

Every stage takes any documents table: other columns pass through, rows may be repeated, have a null
in any column, no text or very long ones, and an empty table gives no rows. The stages' docstrings
say what becomes of such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewfold.llm import decontam, linedup, mixing, quality, simhash
from viewfold.llm.common import discard, scratch, store, table


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row goes by its own text, whatever its id. Null and empty texts, and texts without a
    word, are rejected."""
    return quality.keep_good(docs)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text. A text of which lines went and no word is left goes; one that had
    none, null ones too, stays as it is. Rows without an id come after all others; rows under one
    id are one document, so that each keeps what the id has first."""
    cut = linedup.line_dedup(docs, count_col="__n").where((F.col("__n") == 0) | F.col("text").rlike("[^\\s]"))
    return cut.withColumn("n_chars", F.when(F.col("__n") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).drop("__n")


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: the one with the smallest id, rows without an id last, and of
    equal ids the first row. Null and empty texts are one group."""
    return simhash.keep_one(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row goes by its own text, whatever its id. Null and empty texts stay; an empty benchmark
    takes nothing."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null sources and languages are a value of their own; null and empty texts weigh one token. Rows
    that share an id, or have none, are drawn together."""
    return mixing.sample(docs).drop("sampled")


STAGES = [("quality", _quality), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("mix", _mix)]

#: The classifier and the fingerprints can't be put in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, one after another. What a stage stored on its way, and the output
    of the one before, is deleted once its own output is written."""
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch() as made:
            docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
            made.remove(docs)
        discard(old)
        old = docs
    return docs
