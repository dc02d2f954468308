"""One query for each operator, with production parameters over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, langid, media, mixing, ngram_join, packing, quality, sharding, suffixes
from .common import documents
from .oracles import ORACLES

TOKENIZER = "byte_bpe_50k.json"
RANKS = "byte_bpe_50k.tiktoken"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    marked = docs.select("doc_id", "text", langid.held_out().alias("held_out"))
    return langid.identify(marked, langid.fit(docs), ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.summaries(packing.pack(documents(spark, sf_dir), public_tokenizers.path(RANKS)))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.spans_of(suffixes.repeats(documents(spark, sf_dir)))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_copies(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(documents(spark, sf_dir))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "times")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_language, op3_fingerprint, op4_bpe, op5_packing, op6_suffixes, op7_sharding, op8_ngram_join, op9_media, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
