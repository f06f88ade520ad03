"""The operators' queries over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, classifier, html, media, mixing, pii, quality, secrets, sharding, simhash
from tessera.llm.common import read


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(read(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.token_digest(read(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_texts(read(spark, sf_dir, "pages"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(read(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(read(spark, sf_dir, "documents"))


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_simhash": op2_simhash,
    "op3_mixing": op3_mixing,
    "op4_bpe": op4_bpe,
    "op5_sharding": op5_sharding,
    "op6_html": op6_html,
    "op7_pii": op7_pii,
    "op8_quality": op8_quality,
    "op9_classifier": op9_classifier,
    "op10_media": op10_media,
}

ORACLE_SQL: dict[str, str] = {"op3_mixing": mixing.oracle_sql(), "op7_pii": pii.oracle_sql(), "op8_quality": quality.oracle_sql()}
