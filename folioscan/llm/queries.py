"""The operators' queries over the driver tables, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, itq_dedup, mixing, ngram_join, packing, pii, secret_scan, toxicity, warc
from ._shared import source


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = source(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.learn(docs, source(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(source(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = source(spark, sf_dir, "conversations")
    return chat.parse(chat.transcripts(turns), chat.learn(turns))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(source(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets_report(source(spark, sf_dir, "documents"), ("source", "doc_id"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.find_copies(source(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return itq_dedup.link_vectors(source(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(source(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(source(spark, sf_dir, "pages"))[0]


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_groups(source(spark, sf_dir, "documents"), 3, 90, 100).drop("row_key")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_toxicity, op2_pii, op3_chat, op4_mixing, op5_secrets, op6_exact_dedup, op7_embedding_dedup, op8_packing, op9_warc, op10_ngram_join)
}
