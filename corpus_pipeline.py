"""A corpus from raw documents: five stages, each written as Parquet and read again by the next.

1. quality: documents that the ranker rejects go.
2. near_duplicates: one document of each group of near copies stays: operator 8's components and further candidates,
   checked exactly (five-word shingles, similarity 0.8).
3. secrets: spans of secrets are replaced in the text.
4. mix: rows in the order of a schedule that gives each source its share; each row once.
5. tokens: each text encoded and decoded; digests and counts per document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorfold.functions.arrow import bound_batches
from mirrorfold.llm import pfair, quality_ranker, secrets, sentencepiece_bpe, simhash_groups
from mirrorfold.llm.common import Scratch, materialized, table
from mirrorfold.llm.queries import piece_model_path

#: Sources share slots by the root of their number of documents.
MIX_WEIGHTS = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    ranker = quality_ranker.fit_ranker(docs, table(spark, sf_dir, "labels"))
    score, taken = "_score", {c.lower() for c in docs.columns}
    while score in taken:
        score += "_"
    return quality_ranker.score_documents(docs, ranker, score).where(F.col(score) >= quality_ranker.CUT).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return simhash_groups.one_of_each(docs)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair.interleaved(docs, MIX_WEIGHTS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return sentencepiece_bpe.round_trip(docs, piece_model_path(), keep=("doc_id", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_spans),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL can't express the fitted model and the tokenizer; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    former = Scratch(spark)
    for name, stage in STAGES[:-1]:
        kept = Scratch(spark)
        docs = materialized(stage(spark, docs, sf_dir), f"pipeline-{name}", kept)
        former.__exit__()  # what a stage read is no longer needed
        former = kept
    return STAGES[-1][1](spark, docs, sf_dir)
