"""A corpus from raw documents to packed sequences: toxicity, exact copies, near copies, mixing, packing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from folioscan.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from folioscan.llm._shared import shared_dir, source, sweep, written
from folioscan.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables of the stage before, which its result was made of.
_spent: list[str] = []


def stage(f: Stage) -> Stage:
    """A stage begins by deleting the tables of the stage before: by then that one's result is written, as docs was read from it."""

    @wraps(f)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        sweep(spark, _spent)
        _spent.clear()
        before = {*written}
        out = f(spark, docs, sf_dir)
        _spent.extend(p for p in written if p not in before)
        return out

    return begin


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model learned from the labelled ones among them doesn't call toxic. Null and empty texts stay; repeated rows are judged alike."""
    return toxicity.reject_toxic(docs, toxicity.learn(docs, source(spark, sf_dir, "labels")))


@stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id; null and empty texts are equal, a null doc_id comes before all others, of repeated rows one stays."""
    return exact_dedup.drop_copies(docs)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by Jaccard >= 0.8 of five-word shingles the one with the smallest doc_id.

    Rows of the group that share that doc_id (they can only differ in text) stay as the first of them by row_key. Documents
    without words are in no group and stay.
    """
    return ngram_join.drop_near_copies(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times; those without words not at all."""
    return mixing.apply_mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their sequences and offsets, of every row of docs, repeated ones too."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Toxicity is learned and packing is a solved program; SQL has neither. tests/llm holds a brute-force version against run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again. Of no documents there are no pieces; columns beyond doc_id, text and source are carried along up to the last stage."""
    docs, at = source(spark, sf_dir, "documents"), f"{shared_dir(spark)}/folioscan/run-{uuid.uuid4().hex}"
    for i, (_, step) in enumerate(STAGES):
        step(spark, docs, sf_dir).write.parquet(f"{at}/{i}")
        docs = spark.read.parquet(f"{at}/{i}")
        if i:
            sweep(spark, [f"{at}/{i - 1}"])
    sweep(spark, _spent)
    _spent.clear()
    return docs
