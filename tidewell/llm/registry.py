"""The queries of the training-data operators and their DuckDB SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import lm, mixing, near_dups, pieces, pii, quality, substrings, toxicity, vectors, warc
from .common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts and verdict for every document."""
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-word passages of documents before it."""
    return substrings.remove_repeated(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """A file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, byte spans and decoded text of every document, as digests; ``spans_sha256`` is of all begins, then all ends, joined by spaces."""
    rows = pieces.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.element_at("ends", -1).cast("long").alias("n_bytes"),
        F.sha2(F.array_join(F.concat("begins", "ends").cast("array<string>"), " "), 256).alias("spans_sha256"),
    )


def op4_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents mixed to weights by the square root of their sources' sizes."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labels outside the held-out quarter."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    scored = toxicity.score_documents(docs, toxicity.train(docs, labels.where(~held)))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after a trip through Zstandard web archives."""
    rows = warc.archive_pages(table(spark, sf_dir, "pages"))
    own = F.col("record_type") == "response"
    return rows.select(
        "page_id",
        F.when(own, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and all spans."""
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)),
        F.sha2(pii.joined("base"), 256).alias("base_sha256"),
        pii.joined("spans").alias("spans"),
    )


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return vectors.vector_duplicates(table(spark, sf_dir, "embeddings"))


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document, learned outside the held-out seventh."""
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    rows = lm.score_documents(table(spark, sf_dir, "documents"), ~held, tokenizer_path("byte_bpe_multi_50k.tiktoken"))
    return rows.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality": op1_quality, "op2_substrings": op2_substrings, "op3_sentencepiece": op3_sentencepiece, "op4_near_dups": op4_near_dups, "op5_mixing": op5_mixing, "op6_toxicity": op6_toxicity, "op7_warc": op7_warc, "op8_pii": op8_pii, "op9_vectors": op9_vectors, "op10_lm": op10_lm}

ORACLES: dict[str, str] = {"op1_quality": quality.oracle(), "op2_substrings": substrings.ORACLE, "op5_mixing": mixing.oracle(), "op7_warc": warc.ORACLE, "op9_vectors": vectors.ORACLE}
