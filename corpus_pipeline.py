"""The corpus pipeline: STAGES over ``documents``, each applying one operator to all that the stage before it kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import fmindex, jaccard, langid, pieces, pii
from ledgerloom.llm.common import held_out, read_table, shared_folder
from ledgerloom.llm.queries import tokenizer_path

#: SQL cannot express trained models and sampling; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that was learned, go."""
    model = langid.train(docs.filter(~held_out(F.col("doc_id"), 4, 2)))
    judged = langid.predict(docs, model)
    return judged.filter(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id stays."""
    return jaccard.deduplicate(docs, "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of which they are over half of the words goes."""
    found = fmindex.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", window=10, keep_spans=True)
    return _counted(fmindex.without_spans(docs, found, "doc_id", "text", most=0.5))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes the name of its kind in brackets."""
    return _counted(pii.redact(docs, "text"))


def sample_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document, as piece ids with their inclusion probabilities."""
    return pieces.encode(docs, "doc_id", "text", tokenizer_path(), k=2).withColumnRenamed("id", "doc_id")


def _counted(docs: DataFrame) -> DataFrame:
    """Texts have changed, so a column of their lengths is made anew."""
    return docs if "n_chars" not in docs.columns else docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("personal_data", redact_personal_data),
    ("sampled_pieces", sample_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each stage's rows are written as Parquet in the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
