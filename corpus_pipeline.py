"""A training-data pipeline over ``documents``: five stages, each one operator of ``tidewell.llm``.

Every stage works on all rows that the one before it kept, and its decisions
take effect: rejected documents and all but one of a group of near copies go,
personal data is replaced by its kind, sources are repeated to their weights,
and what is left is encoded.  All stages but the last return the columns of
``documents``.  Each stage's rows are written as Parquet to the shared folder
and read again, so a lost executor never repeats more than a stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import mixing, near_dups, pieces, pii, quality
from tidewell.llm.common import table, written
from tidewell.llm.registry import tokenizer_path
from tidewell.session import ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    ship(spark)
    return quality.quality_rules(docs, carry=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id."""
    ship(spark)
    return near_dups.one_of_each(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have the weights of the square roots of their sizes, in shuffled order."""
    mixed = mixing.mix_sources(docs)
    return mixed if "copy_no" in docs.columns else mixed.drop("copy_no")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (with the end id) of every row."""
    ship(spark)
    rows = pieces.encode_documents(docs, tokenizer_path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

#: SQL can express neither the trees of the personal-data stage nor the encoding.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
