"""Vocabulary, topic-term counts and class-based TF-IDF.

Tokens are counted per (topic, word) before anything is joined: that is the
widest stage, and Spark combines it on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..session import materialize
from .joins import salted_join
from .sampling import top_n


def exploded(df: DataFrame, keys: Sequence[str], terms: Column) -> DataFrame:
    return df.select(*keys, F.explode(terms).alias("word"))


def vocabulary(
    df: DataFrame, text_col: str, min_count: int = 1, lowercase: bool = True, ngram_range: tuple[int, int] = (1, 1),
    stop_words: str | Sequence[str] | None = None,
) -> DataFrame:
    """``word, count`` of words seen at least ``min_count`` times.

    Tokens are lower-cased as in the term counts; ``lowercase=False`` keeps case.
    """
    words = exploded(df, [], K.terms(text_col, ngram_range, stop_words, lowercase))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= min_count)


def term_counts(
    df: DataFrame, topic_col: str, text_col: str, ngram_range: tuple[int, int] = (1, 1),
    stop_words: str | Sequence[str] | None = None, vocab: DataFrame | None = None, min_count: int = 1,
) -> DataFrame:
    """``topic, word, tf``; limited to a vocabulary if one is given."""
    words = exploded(df, [F.col(topic_col).alias("topic")], K.terms(text_col, ngram_range, stop_words))
    tf = words.groupBy("topic", "word").agg(F.count(F.lit(1)).alias("tf"))
    if vocab is not None:
        tf = tf.join(vocab.select("word").distinct(), "word", "left_semi").select("topic", "word", "tf")
    if min_count > 1:
        # the window holds one row per topic for a word
        total = F.sum("tf").over(Window.partitionBy("word"))
        tf = tf.withColumn("_n", total).filter(F.col("_n") >= min_count).drop("_n")
    return tf


def ctfidf(tf: DataFrame, normalize: bool = True) -> DataFrame:
    """``topic, word, tf, f, idf, weight`` with ``idf = ln(1 + A / f)``.

    ``f`` is the word's count over all topics and ``A`` the mean number of
    words per topic. ``normalize`` divides ``tf`` by the topic's words. The
    counts are written once, as they are read twice.
    """
    tf = materialize(tf)
    totals = tf.groupBy("topic").agg(F.sum("tf").alias("_words"))
    totals = totals.withColumn("_avg", F.avg("_words").over(Window.partitionBy(F.lit(1))))  # one row per topic
    with_f = tf.withColumn("f", F.sum("tf").over(Window.partitionBy("word")))  # one row per topic and word
    joined = salted_join(with_f, totals, ["topic"], "inner", ["word"])
    idf = F.log(1 + F.col("_avg") / F.col("f"))
    share = F.col("tf") / F.col("_words") if normalize else F.col("tf")
    return joined.select("topic", "word", "tf", "f", idf.alias("idf"), (share * idf).alias("weight"))


def top_words(weights: DataFrame, n: int = 10) -> DataFrame:
    """``topic, rank, word, weight``: the heaviest words of each topic."""
    ranked = top_n(weights.select("topic", "word", "weight"), "topic", [F.desc("weight"), F.asc("word")], n, "rank")
    return ranked.select("topic", F.col("rank").cast("long").alias("rank"), "word", "weight")


def representations(words: DataFrame) -> DataFrame:
    """``topic, pairs``: ranked words and weights as one array per topic."""
    rows = F.sort_array(F.collect_list(F.struct("rank", "word", "weight")))
    pairs = F.transform(rows, lambda r: F.struct(r["word"].alias("word"), r["weight"].alias("weight")))
    return words.groupBy("topic").agg(pairs.alias("pairs"))
