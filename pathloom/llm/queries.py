"""The corpus operators as queries over the driver's tables, and their DuckDB twins."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import sql
from .embedding_dedup import embedding_dedup
from .html_text import extract_text
from .language import language_id
from .licenses import license_scan
from .mixing import mix_sources
from .ngram_join import ngram_join
from .pieces import decode, encode
from .quality import quality_rules
from .reputation import url_filter
from .store import for_texts
from .toxicity import toxicity


#: The SentencePiece model of op5 and of the pipeline; it is read on the driver only.
PIECES = os.environ.get("PATHLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return for_texts(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(_table(spark, sf_dir, "embeddings"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(encode(_table(spark, sf_dir, "documents"), PIECES), PIECES, text_col="decoded")
    return decoded.withColumn("decoded_chars", F.length("decoded").cast("long")).drop("decoded")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents")).drop("clean_text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents")).drop("spans")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages")).withColumn("bad_rate", F.round("bad_rate", 6))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_ngram_jaccard_join, op3_license_scan, op4_mix_sources, op5_sentencepiece, op6_quality_rules, op7_toxicity, op8_html_text, op9_url_filter, op10_language_id)}


def oracle_sql() -> dict:
    return {"op2_ngram_jaccard_join": sql.NGRAM_JOIN, "op3_license_scan": sql.LICENSES, "op6_quality_rules": sql.QUALITY, "op9_url_filter": sql.REPUTATION}
