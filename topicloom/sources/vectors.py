"""Vectors kept by the content of their text, so that a grown corpus embeds new texts only."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.embed import Embedding
from ..operators.joins import salted_join
from ..session import materialize

SCHEMA = "digest binary, embedding array<float>, batch bigint"


class VectorStore:
    """A folder of ``digest, embedding, batch`` for one embedding; other embeddings or states have folders of their own.

    A text is known by its SHA-256, so copies are encoded once, and a text that
    comes back in a later corpus, under whatever id, is not encoded again.
    """

    def __init__(self, spark: SparkSession, path: str, embedding: Embedding):
        state = json.dumps(embedding.state(), sort_keys=True)
        self.spark, self.embedding = spark, embedding
        self.path = f"{path}/{hashlib.sha256(state.encode()).hexdigest()[:32]}"

    def table(self) -> DataFrame:
        """What is stored; empty before the first batch."""
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def add(self, texts: DataFrame, text_col: str = "text") -> None:
        """Encode and append the texts that the store does not hold.

        Digests are compared first; only texts that are new are shuffled, one
        of each. A batch that breaks off leaves nothing behind.
        """
        known = self.table()
        keyed = texts.select(_digest(text_col).alias("digest"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        fresh = keyed.select("digest").distinct().join(known.select("digest"), "digest", "left_anti")
        fresh = materialize(fresh)
        if fresh.isEmpty():
            return
        once = keyed.join(fresh, "digest", "left_semi").groupBy("digest").agg(F.first("text").alias("text"))
        number = (known.agg(F.max("batch")).first()[0] or 0) + 1
        made = self.embedding.transform(once, "digest", "text").withColumn("batch", F.lit(number).cast("long"))
        made.write.mode("append").parquet(self.path)

    def vectors(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id, embedding`` of all documents; texts that the store lacks are added first."""
        self.add(docs, text_col)
        keyed = docs.select(id_col, _digest(text_col).alias("digest"))
        return salted_join(keyed, self.table().select("digest", "embedding"), ["digest"], "inner", [id_col]).select(id_col, "embedding")

    def batches(self) -> DataFrame:
        """``batch, encoded``: how many texts each call of :meth:`add` encoded."""
        return self.table().groupBy("batch").agg(F.count(F.lit(1)).alias("encoded"))


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256))
