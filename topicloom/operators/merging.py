"""Merging and comparing models by their topic vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .joins import salted_join
from .similarity import similarities


def match_topics(earlier: DataFrame, later: DataFrame, min_similarity: float = 0.6) -> DataFrame:
    """``topic, merged_topic, similarity`` for the topics of a later model.

    A topic joins the most similar earlier topic if that reaches
    ``min_similarity``, else it gets the next free number. -1 stays -1.
    """
    known = earlier.filter(F.col("topic") != -1)
    fresh = later.filter(F.col("topic") != -1).select(F.col("topic").alias("_id"), "vector")
    best = similarities(fresh, known, "_id", "vector", top=1)
    base = known.agg(F.max("topic")).first()[0]
    base = -1 if base is None else base
    rows = fresh.select("_id").join(best, "_id", "left")
    joins = F.coalesce(F.col("similarity") >= min_similarity, F.lit(False))
    order = F.row_number().over(Window.partitionBy("_joins").orderBy("_id"))  # one row per topic
    numbered = rows.withColumn("_joins", joins).withColumn("_n", order)
    merged = F.when(F.col("_joins"), F.col("topic")).otherwise(F.col("_n") + base)
    out = numbered.select(F.col("_id").alias("topic"), merged.cast("int").alias("merged_topic"), "similarity")
    noise = later.filter(F.col("topic") == -1).select("topic", F.lit(-1).alias("merged_topic"), F.lit(None).cast("double").alias("similarity"))
    return out.unionByName(noise)


def added_vectors(vectors: DataFrame) -> DataFrame:
    """``topic, vector, n``: means of rows (topic, vector, n) by their counts."""
    weighted = vectors.select("topic", "n", F.transform(F.col("vector").cast("array<double>"), lambda x: x * F.col("n")).alias("_sum"))
    vec = vector_to_array(Summarizer.sum(array_to_vector("_sum")))
    sums = weighted.groupBy("topic").agg(F.sum("n").alias("n"), vec.alias("_sum"))
    return sums.select("topic", F.transform("_sum", lambda x: x / F.col("n")).alias("vector"), "n")


def merged_numbers(models: Sequence[DataFrame], min_similarity: float = 0.6) -> DataFrame:
    """``model, topic, merged_topic, similarity`` of topic vectors (topic, vector, n), merged in order.

    A merged topic's vector is the mean of its parts by their counts, so a
    later model meets the topic as it is after the earlier ones.
    """
    known = models[0].select("topic", "vector", "n")
    mapping = known.select(F.lit(0).alias("model"), "topic", F.col("topic").alias("merged_topic"), F.lit(None).cast("double").alias("similarity"))
    for i, more in enumerate(models[1:], start=1):
        match = materialize(match_topics(known, more, min_similarity))
        moved = more.join(match, "topic").select(F.col("merged_topic").alias("topic"), "vector", "n")  # one row per topic
        known = materialize(added_vectors(known.unionByName(moved)))
        mapping = mapping.unionByName(match.select(F.lit(i).alias("model"), "topic", "merged_topic", "similarity"))
    return materialize(mapping)


def merge_models(
    models: Sequence[tuple[DataFrame, DataFrame]], min_similarity: float = 0.6, id_col: str = "doc_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge ``(topic_vectors, assignments)`` in order.

    Returns vectors, assignments and the mapping ``model, topic, merged_topic,
    similarity``. Vectors without a count ``n`` weigh the same.
    """
    counted = [v if "n" in v.columns else v.withColumn("n", F.lit(1).cast("long")) for v, _ in models]
    mapping = merged_numbers(counted, min_similarity)
    of = lambda i: mapping.filter(F.col("model") == i).select("topic", "merged_topic")
    vectors = assigned = None
    for i, (_, rows) in enumerate(models):
        here = counted[i].join(of(i), "topic").select(F.col("merged_topic").alias("topic"), "vector", "n")
        moved = salted_join(rows.select(id_col, "topic"), of(i), ["topic"], "left", [id_col]).select(id_col, F.coalesce("merged_topic", F.lit(-1)).alias("topic"))
        vectors, assigned = (here, moved) if vectors is None else (vectors.unionByName(here), assigned.unionByName(moved))
    return materialize(added_vectors(vectors)), assigned, mapping


def compare_sizes(models: dict[str, DataFrame]) -> DataFrame:
    """``model, n_topics`` without the outlier topic."""
    out = None
    for name, vectors in models.items():
        part = vectors.filter(F.col("topic") != -1).agg(F.countDistinct("topic").alias("n_topics")).select(F.lit(name).alias("model"), "n_topics")
        out = part if out is None else out.unionByName(part)
    return out
