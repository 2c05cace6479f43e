"""Queries of this package for the driver: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_tree, decision_list, license_scan, pfair, quality_ranker, secrets, sentencepiece_bpe, simhash, suffix_dedup, warc
from .common import Scratch, materialized, table
from .sql import oracle_sql as oracle_sql


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        path = warc.write_archives(table(spark, sf_dir, "pages"))
        scratch.paths.append(path)
        found = materialized(warc.read_records(spark, path, with_payload=False), "records", scratch)
        captures = warc.with_origins(spark, materialized(warc.assembled(found), "captures"))
    return captures.select(
        F.col("metadata.page_id").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        F.col("origin_page").alias("refers_to"),
    )


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ball_tree.integer_vectors(table(spark, sf_dir, "embeddings"))
    return ball_tree.top_k(vectors, F.col("vec_id") % 100 == 0)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair.scheduled(docs).select("doc_id", "source", F.col("_rank").alias("rank_in_source"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.round_trip(table(spark, sf_dir, "documents"), piece_model_path())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = materialized(quality_ranker.with_features(table(spark, sf_dir, "documents")), "features")
    scored = quality_ranker.score_features(found, quality_ranker.fit_features(found, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality_ranker.held_out().alias("held_out"), "score", (F.col("score") >= quality_ranker.CUT).cast("int").alias("predicted"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decision_list.judged(docs, decision_list.fit_rules(docs, table(spark, sf_dir, "labels")))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_top_k": op2_top_k,
        "op3_source_mix": op3_source_mix,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_secret_scan": op5_secret_scan,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_simhash": op8_simhash,
        "op9_quality_rules": op9_quality_rules,
        "op10_license_scan": op10_license_scan,
    }

