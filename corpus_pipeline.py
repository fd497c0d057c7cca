"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the rows that it keeps, with
the columns of ``documents``; the last returns tokens. Every stage works on all
rows that its predecessor kept.

Defined results, for all stages: a row whose text is null or empty has no known
language and goes in the first stage; very long texts are read whole; nulls in
other columns and further columns of any name pass unchanged; repeated rows are
each judged, until the third stage keeps one; an empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pathloom.llm import language, mixing, ngram_join, pieces, toxicity
from pathloom.llm.folds import fold
from pathloom.llm.queries import PIECES
from pathloom.llm.store import cut, drop, for_texts, free_name

#: A document whose n-gram ranks are further than this from every language is in none of them.
LEAST_CLOSENESS = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language. Those without a letter, or unlike all languages, go."""
    for_texts(spark)
    profiles = language.fit(docs.where(fold("doc_id", 5) != 0))
    judged = language.predict(docs, profiles, prefix="_own_")
    return judged.where((F.col("_own_lang_pred") != language.UNKNOWN) & (F.col("_own_closeness") >= LEAST_CLOSENESS)).select(docs.columns)


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    for_texts(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = toxicity.train_sample(docs, labels)
    scorer = toxicity.fit(sample)
    drop(sample)
    return toxicity.predict(docs, scorer, "text", prefix="_own_").where("_own_predicted = 0").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row, that with the smallest id (rows without an id come last, ties by text).

    Rows are told apart by id and text, not by id alone: different texts that share an id, or have none, are judged each
    by itself, and of rows equal in both one stays.
    """
    for_texts(spark)
    key, least = (free_name(docs, name) for name in ("row_key", "least_id"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text", F.lit(len(STAGES))))
    joined = ngram_join.ngram_join(keyed, id_col=key)
    rows = cut(keyed.groupBy(key).agg(F.min("doc_id").alias(least), F.count("*").alias("times")))
    members = cut(joined.select(key, "component_id").distinct().join(rows, key))
    first = members.groupBy("component_id").agg(F.min_by(key, F.struct(F.col(least).isNull(), least, key)).alias("first"))
    copies = members.join(first, "component_id").where(F.col(key) != F.col("first")).select(key)
    repeated = rows.where("times > 1").select(key)
    if repeated.isEmpty():
        return keyed.join(copies, key, "left_anti").select(docs.columns)
    kept = keyed.join(copies, key, "left_anti")
    alone = kept.join(repeated, key, "left_anti")
    return alone.unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key])).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    for_texts(spark)
    taken = mixing.mix_sources(docs, prefix="_own_").where("_own_taken > 0")
    times = F.sequence(F.lit(1), (F.col("_own_taken") / F.col("_own_size")).cast("int"))
    return taken.withColumn(free_name(taken, "copy"), F.explode(times)).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix."""
    for_texts(spark)
    return pieces.encode(docs, PIECES)


STAGES = [
    ("language ID", language_id),
    ("toxicity", remove_toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources", mix_sources),
    ("SentencePiece", tokenize),
]

#: Learned models and seeded hashes are not SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is deleted once the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        after = cut(stage(spark, docs, sf_dir))
        if before is not None:
            drop(before)
        docs = before = after
    return STAGES[-1][1](spark, docs, sf_dir)
