"""A training corpus from raw documents: each stage writes its documents for the next one.

``documents`` (doc_id, text, lang, source, n_chars) go through a quality
classifier, near deduplication, benchmark decontamination, mixing to target
weights, and sharding. Every stage takes all documents that the one before kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import decontam, mixing, neardup, quality, sharding
from topicloom.llm.common import unused
from topicloom.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: documents below even odds of good quality are rejected
QUALITY_LEAST = 0.5
SHARDS = 40


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    name = unused(docs, "score")
    return quality.score(docs, model, name, least=QUALITY_LEAST).drop(name)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest id."""
    return neardup.first_of_each(docs)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the ``benchmark`` occurs."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes its words."""
    return mixing.repeated(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every document of the mix."""
    return sharding.shard(docs, shards=SHARDS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good), ("near_dedup", distinct), ("decontaminate", unleaked), ("mix", mixed), ("shard", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


#: The first stages train a model and draw hashes, which SQL cannot express; tests/llm tests the pipeline against brute force.
ORACLE_SQL: str | None = None
