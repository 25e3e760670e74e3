"""Topic tables, search, and the data behind the plots."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from . import similarity as S
from .embed import reduce_vectors
from .filters import drop_outliers, inside_box, topic_members, with_topic_label
from .sampling import sample_per_group, top_n
from .terms import representations, top_words

log = logging.getLogger(__name__)


def topic_words(words: DataFrame, topic: int | None = None) -> DataFrame:
    return words if topic is None else words.filter(F.col("topic") == topic)


def topic_frequency(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "topic")


def own_similarity(
    rows: DataFrame, topic_vectors: DataFrame, id_col: str = "doc_id", vector: str = "embedding", block_bytes: int = S.BLOCK_BYTES
) -> DataFrame:
    """``id, topic, similarity`` of each row to the topic it has; no shuffle."""
    slim = rows.select(id_col, F.col("topic").cast("int").alias("topic"), vector)
    kind = rows.schema[id_col].dataType.simpleString()
    parts = []
    for ids, m in S._blocks(topic_vectors, "topic", "vector", block_bytes):

        def score(batches, ids=np.array(ids, dtype=np.int64), m=m):
            import pyarrow as pa

            for batch in batches:
                topic = batch.column("topic").fill_null(np.iinfo(np.int32).min).to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(ids, topic), len(ids) - 1)  # ids come in order
                batch, at = batch.filter(pa.array(ids[at] == topic)), at[ids[at] == topic]
                if batch.num_rows:
                    own = np.einsum("ij,ij->i", S._matrix(batch.column(vector)), m[at])
                    yield pa.RecordBatch.from_arrays([batch.column(id_col), batch.column("topic"), pa.array(own)], [id_col, "topic", "similarity"])

        parts.append(slim.mapInArrow(score, f"`{id_col}` {kind}, topic int, similarity double"))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {kind}, topic int, similarity double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def representative_docs(rows: DataFrame, topic_vectors: DataFrame, n: int = 3, id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``topic, rank, id, similarity``: the documents closest to their topic."""
    own = own_similarity(rows, topic_vectors, id_col, vector)
    return top_n(own, "topic", [F.desc("similarity"), F.asc(id_col)], n, "rank").select("topic", F.col("rank").cast("long"), id_col, "similarity")


def topic_name(topic: Column, pairs: Column, n: int = 4) -> Column:
    return F.concat_ws("_", topic.cast("string"), F.slice(F.transform(pairs, lambda p: p["word"]), 1, n))


def topic_labels(words: DataFrame, n: int = 3) -> DataFrame:
    """``topic, label``: first words joined by ' - '."""
    r = representations(words)
    return r.select("topic", K.words_label(F.transform("pairs", lambda p: p["word"]), n).alias("label"))


def topic_info(assigned: DataFrame, words: DataFrame, representative: DataFrame | None = None) -> DataFrame:
    """``topic, count, name, representation[, representative_docs]``.

    ``representative`` is ``topic, rank, document``.
    """
    counts = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("count"))
    out = counts.join(representations(words), "topic", "left").withColumn("pairs", F.coalesce("pairs", F.expr("array()").cast("array<struct<word:string,weight:double>>")))
    out = out.select("topic", "count", topic_name(F.col("topic"), F.col("pairs")).alias("name"), F.transform("pairs", lambda p: p["word"]).alias("representation"))
    if representative is None:
        return out
    docs = representative.groupBy("topic").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "document"))), lambda s: s["document"]).alias("representative_docs"))
    return out.join(docs, "topic", "left")


def document_info(docs: DataFrame, assigned: DataFrame, info: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with topic, probability if known, topic name and representation."""
    from .joins import salted_join

    rows = docs.join(assigned, id_col)
    return salted_join(rows, info.select("topic", "name", "representation"), ["topic"], "left", [id_col])


def find_topics(terms: DataFrame, topic_vectors: DataFrame, n: int = 5) -> DataFrame:
    """``pos, topic, similarity``: topics most similar to each term's ``embedding``."""
    real = topic_vectors.filter(F.col("topic") != -1)
    return S.similarities(terms, real, "pos", "embedding", top=n)


def search_topics(terms: DataFrame, topic_vectors: DataFrame, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """Hits ``pos, term, topic, similarity``, and ``topic, terms`` in list order.

    A term listed twice appears twice.
    """
    hits = find_topics(terms, topic_vectors, n).join(terms.select("pos", "term"), "pos").select("pos", "term", "topic", "similarity")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "term"))), lambda s: s["term"])
    return hits, hits.groupBy("topic").agg(F.array_join(listed, ", ").alias("terms"))


def target_rows(info: DataFrame, topics: Sequence[int], columns: Sequence[str], id_col: str = "doc_id") -> DataFrame:
    return topic_members(info, topics, "topic", id_col).select(*columns)


def feature_means(rows: DataFrame, features: Sequence[str], words: DataFrame) -> DataFrame:
    """Mean of feature columns per topic, with the topic's words as text."""
    means = rows.groupBy("topic").agg(*[F.avg(c).alias(c) for c in features])
    text = representations(words).select("topic", K.words_with_weights(F.col("pairs")).alias("representations"))
    return means.join(text, "topic", "left").select("topic", "representations", *features)


# --- plot data ------------------------------------------------------------------

def topic_centroids(layout: DataFrame) -> DataFrame:
    return layout.groupBy("topic").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def label_positions(layout: DataFrame, words: DataFrame, max_topic: int | None = None) -> DataFrame:
    """Centroid and three-word label of all topics, or of those up to ``max_topic``."""
    chosen = layout if max_topic is None else layout.filter(F.col("topic") <= max_topic)
    return topic_centroids(chosen).join(topic_labels(words), "topic")


def topic_map(topic_vectors: DataFrame, assigned: DataFrame) -> DataFrame:
    """``topic, x, y, size``: topics on the plane of their first two components."""
    flat = reduce_vectors(topic_vectors.filter(F.col("topic") != -1), 2, "vector", name="_xy")
    sizes = assigned.groupBy("topic").agg(F.count(F.lit(1)).alias("size"))
    return flat.select("topic", F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y")).join(sizes, "topic")


def bar_data(weights: DataFrame, assigned: DataFrame, n_topics: int = 8, n_words: int = 5) -> DataFrame:
    """Top words and weights of the largest topics."""
    largest = drop_outliers(assigned).groupBy("topic").agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), "topic").limit(n_topics)
    return top_words(weights.join(largest, "topic", "left_semi"), n_words)


def layout_points(rows: DataFrame, id_col: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """``id, topic, x, y`` on the first two components."""
    flat = reduce_vectors(rows.select(id_col, "topic", vector), 2, vector, name="_xy")
    return flat.select(id_col, "topic", F.col("_xy")[0].alias("x"), F.col("_xy")[1].alias("y"))


def scatter_data(layout: DataFrame, labels: DataFrame, per_topic: int | None = None, bound: float | None = None, id_col: str = "doc_id") -> DataFrame:
    """Labelled points without outliers; optionally inside a box, and a sample per topic."""
    rows = drop_outliers(layout) if bound is None else inside_box(drop_outliers(layout), bound)
    if per_topic is not None:
        rows = sample_per_group(rows, "topic", id_col, per_topic)
    return with_topic_label(rows, labels, "topic", id_col)


PLOT_KINDS = ("topics", "hierarchy", "barchart", "heatmap", "documents", "topics_over_time")


def plot_tables(makers: dict[str, Callable[[], DataFrame]], kinds: Sequence[str] | None = None, has_time: bool = True) -> dict[str, DataFrame]:
    """The wanted tables. Unknown kinds, the trend without a time column, and
    a kind that fails are logged and left out; the others are made."""
    if kinds is not None and not isinstance(kinds, (list, tuple)):
        log.warning("kinds must be a list; using all")
        kinds = None
    out = {}
    for kind in kinds or PLOT_KINDS:
        if kind == "topics_over_time" and not has_time:
            log.warning("no time column: topics_over_time is left out")
        elif kind not in makers:
            log.warning("unknown plot kind %r is left out", kind)
        else:
            try:
                out[kind] = makers[kind]()
            except Exception:  # one failure must not stop the rest
                log.exception("plot data %r failed", kind)
    return out
