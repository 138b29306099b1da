"""A corpus from raw documents to packed training sequences.

Each stage is (name, function of (spark, docs, sf_dir)); what it returns is
written as Parquet and is the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skarn.llm import decontaminate, language, lines, ngrams, packing
from skarn.llm.common import materialize, table

#: Least probability of the predicted language.
CONFIDENT = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a language: those with letters and a prediction of
    CONFIDENT or more. Null and empty texts go; repeated rows and null ids stay."""
    known = language.predict(docs, language.fit(docs))
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= CONFIDENT)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of near-equal lines stays in the corpus; n_chars
    follows the text. A document of which nothing is left goes; null and empty
    texts and rows without an id stay as they are."""
    out = lines.dedup_lines(docs)
    out = out.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", chars).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: links are shingles of five words that
    agree to 0.8 or more. Documents without words or without an id stay."""
    return ngrams.one_per_group(docs, ngrams.NEAR_SHINGLE, ngrams.NEAR_NUMERATOR, ngrams.NEAR_DENOMINATOR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of a document with its sequence and place in it; null and
    empty texts are one piece of the end id, repeated rows are packed each."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]

#: MinHash, trained models and a genetic algorithm have no SQL form; the tests
#: hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
