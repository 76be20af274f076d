"""A training-data pipeline over the documents table: STAGES in order, each a
(name, function) whose function takes (spark, docs, sf_dir) and returns a
DataFrame. Each result is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from media_analytics.llm import decontam, language, mixing, packing, simhash
from media_analytics.llm.common import new_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no learned language go; the model learns from ``docs``."""
    return language.known_language(docs, language.learn(docs, no_language=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them (0 to 3 times)."""
    return mixing.emit(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of all documents in packed blocks; a row per document read back from them."""
    import public_tokenizers

    # fewer kept pieces than op8: a worker's memory also holds what earlier stages loaded
    return packing.written(docs, public_tokenizers.path("word_bpe_49k.json"), kept=250_000)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix_sources", mix_sources),
    ("token_ids", token_ids),
]

# The stages fit models, link fingerprints and tokenize: beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents table; the last stage's result."""
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
