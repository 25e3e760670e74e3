"""Fit, apply, save and compare topic models. A model is a set of tables."""

from __future__ import annotations

import json
import logging
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Clustering, Modeling, to_json
from ..operators import clusterers, density, embed, explore, hierarchy, joins, merging, outliers, represent, similarity, terms, trends, units
from ..session import materialize
from ..sources import store

log = logging.getLogger(__name__)

TABLES = ("assignments", "topic_vectors", "weights", "words", "floors", "histogram", "aspects")
MANIFEST = "version string, number bigint, config string, id_col string, embedding string"


@dataclass(frozen=True)
class TopicModel:
    """``assignments``: id, topic, strength. ``topic_vectors``: topic, vector, n.
    ``weights``: topic, word, tf, f, idf, weight. ``words``: topic, rank, word,
    weight. ``floors``: topic, floor. ``histogram``: topic, bin, n (similarities
    to the own topic). ``aspects``: aspect, topic, rank, word, weight, with
    ``words`` as aspect Main. ``embedding`` makes vectors of new texts and phrases.

    Term counts, vectors with their ``n``, and histograms add up, see :func:`merge`.
    """

    assignments: DataFrame
    topic_vectors: DataFrame
    weights: DataFrame
    words: DataFrame
    floors: DataFrame
    histogram: DataFrame
    aspects: DataFrame
    config: Modeling
    id_col: str = "doc_id"
    embedding: embed.Embedding | None = None

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Topics of new documents; -1 below the topic's own floor."""
        real = self.topic_vectors.filter(F.col("topic") != -1)
        return similarity.assign(vectors, real, self.floors, self.id_col)

    def embed(self, texts: DataFrame, id_col: str | None = None, text_col: str = "text") -> DataFrame:
        """Vectors of texts, made as those that the model was fitted on."""
        if self.embedding is None:
            raise ValueError("the model has no embedding; fit it with one to search by texts")
        return self.embedding.transform(texts, id_col or self.id_col, text_col)

    def find_topics(self, phrases: DataFrame, n: int = 5) -> DataFrame:
        """``pos, topic, similarity``: the ``n`` topics most similar to each of ``phrases`` (pos, term)."""
        return explore.find_topics(self.embed(phrases, "pos", "term"), self.topic_vectors, n)

    def search(self, phrases: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
        """Hits of ``phrases`` (pos, term), and the terms of each topic, see :func:`explore.search_topics`."""
        vectors = self.embed(phrases, "pos", "term")
        return explore.search_topics(phrases.select("pos", "term").join(vectors, "pos"), self.topic_vectors, n)

    def probabilities(self, vectors: DataFrame) -> DataFrame:
        return similarity.probability_arrays(vectors, self.topic_vectors.filter(F.col("topic") != -1), self.id_col)

    def own_probability(self, vectors: DataFrame) -> DataFrame:
        """``id, topic, probability`` of the topic each document has."""
        own = F.get(F.col("probabilities"), (F.array_position("topics", F.col("topic")) - 1).cast("int"))
        joined = self.assignments.select(self.id_col, "topic").join(self.probabilities(vectors), self.id_col, "left")
        return joined.select(self.id_col, "topic", F.coalesce(own, F.lit(0.0)).alias("probability"))

    def hierarchy(self, linkage: str | None = None) -> DataFrame:
        return hierarchy.topic_hierarchy(self.topic_vectors, linkage or self.config.linkage)

    def info(self, representative: DataFrame | None = None) -> DataFrame:
        """Topic info, with a column of words for every aspect but the main one."""
        out = explore.topic_info(self.assignments, self.words, representative)
        for name in represent.aspect_steps(self.config.representation):
            if name != "Main":
                words = self.aspects.filter(F.col("aspect") == name)
                listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"])
                out = out.join(words.groupBy("topic").agg(listed.alias(name)), "topic", "left")
        return out

    def with_topics(self, assigned: DataFrame, docs: DataFrame, vectors: DataFrame) -> TopicModel:
        """The model after documents changed topics: words and vectors anew."""
        return describe(assigned, docs, vectors, self.config, self.id_col, embedding=self.embedding)

    def reduce_outliers(self, docs: DataFrame, strategy: str = "distributions", threshold: float | None = None) -> DataFrame:
        """``id, topic`` with outliers moved where their words fit."""
        words = {"ngram_range": self.config.ngram_range, "stop_words": self.config.stop_words}
        assigned = self.assignments.select(self.id_col, "topic")
        if strategy == "c-tf-idf":
            return outliers.reduce_by_terms(assigned, docs, self.weights, 0.1 if threshold is None else threshold, self.id_col, **words)
        if strategy == "distributions":
            return outliers.reduce_by_distribution(assigned, docs, self.weights, threshold or 0.0, self.id_col, **words)
        raise ValueError(f"unknown strategy {strategy!r}")

    def save(self, path: str) -> None:
        """Write a new version below ``path``; what was saved there before stays readable until it is complete.

        The manifest entry comes last, so a version that broke off is never
        loaded. A model may be saved to the folder that it was loaded from.
        """
        spark = self.assignments.sparkSession
        before = manifest(spark, path)
        number = 0 if before is None else (before.agg(F.max("number")).first()[0] or 0) + 1
        version = f"version-{number}-{uuid.uuid4().hex[:12]}"
        for name in TABLES:
            getattr(self, name).write.parquet(f"{path}/{version}/{name}")
        state = None if self.embedding is None else json.dumps(self.embedding.state())
        entry = spark.createDataFrame([(version, number, to_json(self.config), self.id_col, state)], MANIFEST)
        entry.coalesce(1).write.mode("append").json(f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The complete versions of a saved model; None if nothing was saved."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def load_model(spark: SparkSession, path: str) -> TopicModel:
    """The newest complete version of a saved model."""
    versions = manifest(spark, path)
    newest = None if versions is None else versions.orderBy(F.desc("number"), F.desc("version")).first()
    if newest is None:
        raise ValueError(f"no complete model in {path}")
    tables = {name: spark.read.parquet(f"{path}/{newest.version}/{name}") for name in TABLES}
    embedding = embed.embedding_of(json.loads(newest.embedding) if newest.embedding else None)
    return TopicModel(**tables, config=Modeling.from_dict(json.loads(newest.config)), id_col=newest.id_col, embedding=embedding)


def described(
    assigned: DataFrame, tf: DataFrame, topic_vectors: DataFrame, histogram: DataFrame, cfg: Modeling, id_col: str,
    embedding: embed.Embedding | None, words_of: Callable[[DataFrame], DataFrame] | None = None,
) -> TopicModel:
    """The model of its sums: term counts, vectors with counts, and similarity histograms.

    ``words_of`` makes the aspects from the weights; without it there are the heaviest words only.
    """
    weights, histogram = materialize(terms.ctfidf(tf)), materialize(histogram)
    floors = materialize(similarity.floors_of(histogram))
    plain = lambda: terms.top_words(weights, cfg.top_n_words).select(F.lit("Main").alias("aspect"), "topic", "rank", "word", "weight")
    aspects = materialize(plain() if words_of is None else words_of(weights))
    words = aspects.filter("aspect = 'Main'").drop("aspect")
    return TopicModel(assigned, topic_vectors, weights, words, floors, histogram, aspects, cfg, id_col, embedding)


def describe(
    assigned: DataFrame, docs: DataFrame, vectors: DataFrame, cfg: Modeling, id_col: str = "doc_id", text_col: str = "text",
    embedding: embed.Embedding | None = None,
) -> TopicModel:
    """The model of documents whose topics are known."""
    assigned = materialize(assigned)
    rows = docs.select(id_col, text_col).join(assigned.select(id_col, "topic"), id_col)
    tf = terms.term_counts(rows, "topic", text_col, cfg.ngram_range, cfg.stop_words, min_count=cfg.min_frequency)
    placed = materialize(vectors.select(id_col, "embedding").join(assigned.select(id_col, "topic"), id_col))  # read twice
    centres = materialize(similarity.mean_vectors(placed, "topic", count="n"))
    own = explore.own_similarity(placed.filter(F.col("topic") != -1), centres, id_col)

    def words_of(weights: DataFrame) -> DataFrame:
        candidates = terms.top_words(weights, represent.most_candidates(cfg.representation))
        of_words = represent.word_vectors(docs, vectors, candidates, id_col, text_col, "embedding", cfg.ngram_range, cfg.stop_words)
        return represent.aspects(cfg.representation, weights, centres, materialize(of_words), cfg.top_n_words)

    steps = words_of if represent.aspect_steps(cfg.representation) else None
    return described(assigned, tf, centres, similarity.similarity_histogram(own), cfg, id_col, embedding, steps)


def merge(models: Sequence[TopicModel], min_similarity: float = 0.6) -> tuple[TopicModel, DataFrame]:
    """One model of several over different documents, and ``model, topic, merged_topic, similarity``.

    A topic of a later model joins the most similar topic known so far, or
    becomes a new one. Term counts, vectors (by their counts) and similarity
    histograms are added, so words and vectors are those of a model described
    from all documents, if no model left out rare words. Floors come from the
    similarities to the topics as they were before merging. Aspects need the
    documents, so the merged model has its heaviest words only.
    """
    first = models[0]
    if any(m.id_col != first.id_col for m in models):
        raise ValueError("models to merge must have the same id column")
    vectors = [m.topic_vectors.select("topic", "vector", "n") for m in models]
    mapping = merging.merged_numbers(vectors, min_similarity)

    def moved(tables: Sequence[DataFrame], spread: str) -> DataFrame:
        numbered = [t.withColumn("model", F.lit(i)) for i, t in enumerate(tables)]
        rows = numbered[0]
        for t in numbered[1:]:
            rows = rows.unionByName(t)
        keyed = joins.salted_join(rows, mapping.select("model", "topic", "merged_topic"), ["model", "topic"], "inner", [spread])
        return keyed.drop("model", "topic").withColumnRenamed("merged_topic", "topic")

    tf = moved([m.weights.select("topic", "word", "tf") for m in models], "word").groupBy("topic", "word").agg(F.sum("tf").alias("tf"))
    bins = moved([m.histogram for m in models], "bin").groupBy("topic", "bin").agg(F.sum("n").alias("n"))
    centres = materialize(merging.added_vectors(moved(vectors, "n")))
    assigned = materialize(moved([m.assignments.select(first.id_col, "topic", "strength") for m in models], first.id_col))
    cfg = replace(first.config, representation=None)
    return described(assigned, tf, centres, bins, cfg, first.id_col, first.embedding), mapping


def fit_units(
    units_of_text: DataFrame, embedding: embed.Embedding, cfg: Modeling = Modeling(), labels: DataFrame | None = None
) -> tuple[TopicModel, DataFrame]:
    """A model whose documents are units (doc_id, unit_id, text), keyed by the struct ``unit``, and their vectors.

    ``labels`` (unit, cluster) skips clustering. :func:`unit_topics` and
    :func:`units.topic_shares` bring its topics back to the parent documents.
    """
    keyed = units.with_unit_key(units_of_text).select("unit", "text")
    vectors = materialize(embedding.transform(keyed, "unit"))
    return fit(keyed, vectors, cfg, "unit", labels=labels, embedding=embedding), vectors


def unit_topics(assigned: DataFrame, meta: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``doc_id, unit_id``, the topic and the parent's columns of every unit; ``meta`` is keyed by doc_id."""
    rows = assigned.select("unit.doc_id", "unit.unit_id", *[c for c in assigned.columns if c != "unit"])
    return joins.left_metadata(rows, meta, "doc_id", columns)


def fit(
    docs: DataFrame, vectors: DataFrame, cfg: Modeling = Modeling(), id_col: str = "doc_id", text_col: str = "text",
    labels: DataFrame | None = None, reduced: DataFrame | None = None, embedding: embed.Embedding | None = None,
    reducer: clusterers.Reducer | None = None, clusterer: clusterers.Clusterer | None = None,
) -> TopicModel:
    """Documents and vectors, joined by id, to a topic model.

    ``labels`` (id, cluster) skips clustering; ``reduced`` (id, reduced) skips
    the reduction. ``reducer`` and ``clusterer`` replace the principal
    components and the density clustering of the settings. Missing or surplus vectors raise. ``embedding`` made the
    vectors; the model keeps it to embed new texts and search phrases.
    """
    joins.require_complete(docs, vectors, id_col)
    if labels is None:
        if reduced is None:
            reduced = (reducer or clusterers.PrincipalComponents(cfg.n_components)).reduce(vectors.select(id_col, "embedding"), id_col)
        labels = (clusterer or clusterers.DensityParts(cfg.clustering)).cluster(reduced, id_col)
    elif "strength" not in labels.columns:
        labels = labels.withColumn("strength", F.lit(1.0))
    assigned = density.number_topics(labels, id_col, "cluster", cfg.min_topic_size).select(id_col, "topic", "strength")
    if cfg.nr_topics is not None:
        assigned = materialize(assigned)
        placed = vectors.select(id_col, "embedding").join(assigned, id_col)
        merges = materialize(hierarchy.topic_hierarchy(similarity.mean_vectors(placed, "topic"), cfg.linkage))
        assigned = hierarchy.reduce_topics(assigned, merges, cfg.nr_topics, id_col).select(id_col, "topic", "strength")
    return describe(assigned, docs, vectors, cfg, id_col, text_col, embedding)


def parameter_runs(reduced: DataFrame, grid: Sequence[Clustering], id_col: str = "doc_id") -> DataFrame:
    """``run, config, n_topics, noise_share, largest`` per setting; the vectors are reduced once, and settings share the steps that they agree in."""
    reduced, kept = materialize(reduced), {}
    out = None
    for i, cfg in enumerate(grid):
        found = density.density_clusters(reduced, id_col, "reduced", cfg, kept).groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
        noise = F.col("cluster") == -1
        run = found.agg(
            F.count_if(~noise).alias("n_topics"),
            (F.coalesce(F.sum(F.when(noise, F.col("_n"))), F.lit(0)) / F.sum("_n")).alias("noise_share"),
            F.coalesce(F.max(F.when(~noise, F.col("_n"))), F.lit(0)).alias("largest"),
        ).select(F.lit(i).alias("run"), F.lit(to_json(cfg)).alias("config"), "n_topics", "noise_share", "largest")
        out = run if out is None else out.unionByName(run)
    return out


def train(
    docs: DataFrame, vectors: DataFrame, output_dir: str, run_name: str, cfg: Modeling = Modeling(), id_col: str = "doc_id",
    text_col: str = "text", labels: DataFrame | None = None, reduced: DataFrame | None = None, embedding: embed.Embedding | None = None,
) -> TopicModel:
    """Fit, then save model, topic info, document info, probabilities and a run record.

    All other columns of ``docs`` are carried into the document info. If saving
    fails the model is returned all the same, and the failure is logged.
    """
    model = fit(docs, vectors, cfg, id_col, text_col, labels, reduced, embedding)
    try:
        spark = docs.sparkSession
        model.save(f"{output_dir}/models/{run_name}")
        placed = vectors.select(id_col, "embedding").join(model.assignments.select(id_col, "topic"), id_col).filter("topic <> -1")
        nearest = explore.representative_docs(placed, model.topic_vectors, 3, id_col)
        texts = nearest.join(docs.select(id_col, F.col(text_col).alias("document")), id_col).select("topic", "rank", "document")
        info = materialize(model.info(texts))
        info.write.mode("overwrite").parquet(f"{output_dir}/topic_info/{run_name}_topic_info")
        rows = explore.document_info(docs, model.assignments, info, id_col)
        rows.write.mode("overwrite").parquet(f"{output_dir}/topic_info/{run_name}_document_info")
        model.probabilities(vectors).write.mode("overwrite").parquet(f"{output_dir}/topic_info/{run_name}_probabilities")
        store.record_run(spark, f"{output_dir}/logs", run_name, cfg)
    except Exception:
        log.exception("run %s: the model is fitted, but saving its outputs failed", run_name)
    return model


def plots(
    model: TopicModel, docs: DataFrame | None = None, vectors: DataFrame | None = None, kinds: Sequence[str] | None = None,
    time_col: str | None = None, text_col: str = "text", nr_bins: int | None = None, per_topic: int | None = None,
) -> dict[str, DataFrame]:
    """The tables behind the plots of a model. The trend needs ``docs`` with a
    time column, the document map needs ``vectors``."""
    key = model.id_col
    assigned = model.assignments.select(key, "topic")
    words = {"ngram_range": model.config.ngram_range, "stop_words": model.config.stop_words}
    makers = {
        "topics": lambda: explore.topic_map(model.topic_vectors, assigned),
        "hierarchy": model.hierarchy,
        "barchart": lambda: explore.bar_data(model.weights.filter("topic <> -1"), assigned),
        "heatmap": lambda: similarity.topic_similarity(model.topic_vectors.filter("topic <> -1")),
    }
    if vectors is not None:
        layout = lambda: explore.layout_points(vectors.select(key, "embedding").join(assigned, key), key)
        makers["documents"] = lambda: explore.scatter_data(layout(), explore.topic_labels(model.words), per_topic, id_col=key)
    has_time = docs is not None and time_col is not None and time_col in docs.columns
    if has_time:
        rows = docs.select(key, text_col, time_col).join(assigned, key)
        makers["topics_over_time"] = lambda: trends.topics_over_time(rows, time_col, model.weights, nr_bins, text_col=text_col, **words)
    return explore.plot_tables(makers, kinds, has_time)
