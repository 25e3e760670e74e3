"""Topics over time and across communities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..session import materialize
from .joins import salted_join
from .sampling import top_n, with_row_number
from .terms import ctfidf


def to_timestamp(column: str, df: DataFrame) -> Column:
    """Epoch seconds or any timestamp as a timestamp."""
    kind = df.schema[column].dataType.simpleString()
    return F.timestamp_seconds(column) if kind in ("int", "bigint", "double", "float") else F.col(column).cast("timestamp")


def with_time_bin(df: DataFrame, ts: str, nr_bins: int | None = None, every: str | None = None) -> DataFrame:
    """Add ``timestamp``: start of the row's equal-width bin, of its calendar window, or itself."""
    t = to_timestamp(ts, df)
    if every is not None:
        return df.withColumn("timestamp", F.window(t, every)["start"])
    if nr_bins is None:
        return df.withColumn("timestamp", t)
    if nr_bins < 1:
        raise ValueError("nr_bins must be positive")
    us = F.unix_micros(t)
    lo, hi = df.agg(F.min(us), F.max(us)).first()
    if lo is None or lo == hi:
        return df.withColumn("timestamp", t)
    width = hi - lo
    bin_ = F.least(F.lit(nr_bins - 1), F.floor((us - F.lit(lo)) * nr_bins / F.lit(width)))
    return df.withColumn("timestamp", F.timestamp_micros(F.lit(lo) + F.floor(bin_ * F.lit(width) / nr_bins).cast("long")))


def frequencies(binned: DataFrame, topic: str = "topic") -> DataFrame:
    return binned.groupBy(F.col(topic).alias("topic"), "timestamp").agg(F.count(F.lit(1)).alias("frequency"))


def bin_counts(
    docs: DataFrame, ts: str, nr_bins: int | None, every: str | None, text_col: str, topics: Sequence[int] | None = None, **words
) -> tuple[DataFrame, DataFrame]:
    """``topic, timestamp, frequency`` of all topics, and ``timestamp, topic, word, tf`` of all or the chosen ones, both written.

    Texts are read once, for the words only.
    """
    binned = with_time_bin(docs, ts, nr_bins, every)
    keys = ["timestamp", "topic"]
    found = (binned if topics is None else trend_of(binned, topics)).select(*keys, F.explode(K.terms(text_col, **words)).alias("word"))
    return materialize(frequencies(binned)), materialize(found.groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("tf")))


def with_chains(present: DataFrame) -> DataFrame:
    """``topic, timestamp, step, chain``: bins numbered in order, and stretches of bins without a gap for the topic."""
    steps = with_row_number(present.select("timestamp").distinct(), "timestamp", "step")
    placed = present.select("topic", "timestamp").distinct().join(steps, "timestamp")
    at = F.row_number().over(Window.partitionBy("topic").orderBy("step"))  # one row per bin
    return placed.withColumn("chain", F.col("step") - at)


def evolved(weights: DataFrame, present: DataFrame) -> DataFrame:
    """``timestamp, topic, word, weight``: every bin's weights averaged with those of the bin before, as averaged there.

    A word that a bin lacks counts as 0 in it. A topic without rows in the bin
    before starts anew. Weights stay sparse: a word's weights of a stretch of
    bins are one row, and only that row is walked from bin to bin.
    """
    chains = materialize(with_chains(present))
    ends = chains.groupBy("topic", "chain").agg(F.min("step").alias("_from"), F.max("step").alias("_to"))
    placed = salted_join(weights, chains, ["topic", "timestamp"], "inner", ["word"])
    held = F.map_from_entries(F.collect_list(F.struct("step", "weight"))).alias("_held")  # at most one entry per bin
    walked = salted_join(placed.groupBy("topic", "chain", "word").agg(F.min("step").alias("_first"), held), ends, ["topic", "chain"], "inner", ["word"])

    def average(acc, step):
        here = F.coalesce(F.try_element_at(F.col("_held"), step), F.lit(0.0))
        weight = F.when(step == F.col("_from"), here).otherwise((here + F.coalesce(F.try_element_at(acc, F.lit(-1))["weight"], F.lit(0.0))) / 2)
        return F.concat(acc, F.array(F.struct(step.alias("step"), weight.alias("weight"))))

    steps = F.sequence("_first", "_to")
    every = F.aggregate(steps, F.array().cast("array<struct<step: bigint, weight: double>>"), average)
    rows = walked.select("topic", "word", F.inline(every))
    times = chains.select("timestamp", "topic", "step")
    return salted_join(rows, times, ["topic", "step"], "inner", ["word"]).select("timestamp", "topic", "word", "weight")


def topics_over_time(
    docs: DataFrame, ts: str, weights: DataFrame | None = None, nr_bins: int | None = None, every: str | None = None, text_col: str = "text",
    n_words: int = 5, global_tuning: bool = True, ngram_range: tuple[int, int] = (1, 1), stop_words: str | Sequence[str] | None = None,
    evolution_tuning: bool = True, topics: Sequence[int] | None = None,
) -> DataFrame:
    """``topic, words, frequency, timestamp`` per topic and bin.

    Words are weighted by their share in the bin times the model's ``idf``,
    each topic-bin scaled to sum 1; ``global_tuning`` averages that with the
    topic's overall weights, scaled likewise, ``evolution_tuning`` with the bin
    before, see :func:`evolved`. Without ``weights`` they come from the same
    counts. ``topics`` chooses topics, before the words are weighted.
    """
    keys = ["timestamp", "topic"]
    early = topics if weights is not None else None
    frequency, tf = bin_counts(docs, ts, nr_bins, every, text_col, early, ngram_range=ngram_range, stop_words=stop_words)
    if weights is None:
        weights = materialize(ctfidf(tf.groupBy("topic", "word").agg(F.sum("tf").alias("tf"))))
    steps = frequency  # bins of all topics, also of those not chosen
    if topics is not None:
        frequency, tf, weights = trend_of(frequency, topics), trend_of(tf, topics), trend_of(weights, topics)
    known = weights.select("topic", "word", "idf", "weight")
    sums = known.groupBy("topic").agg(F.sum("weight").alias("_g"))
    overall = salted_join(known, sums, ["topic"], "inner", ["word"]).select("topic", "word", "idf", (F.col("weight") / F.col("_g")).alias("_overall"))
    local = materialize(tf.join(overall, ["topic", "word"]).withColumn("_x", F.col("tf") * F.col("idf")))  # read twice
    totals = local.groupBy(*keys).agg(F.sum("_x").alias("_sum"))
    scaled = salted_join(local, totals, keys, "inner", ["word"])
    share = F.col("_x") / F.col("_sum")
    weighted = scaled.select(*keys, "word", ((share + F.col("_overall")) / 2 if global_tuning else share).alias("weight"))
    if evolution_tuning:
        # sums of halves come in another order elsewhere; rounding keeps equal words equal
        weighted = evolved(weighted, steps).withColumn("weight", F.round("weight", 12))
    ranked = top_n(weighted, keys, [F.desc("weight"), F.asc("word")], n_words, "rank")
    listed = ranked.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "word"))), lambda s: s["word"]), ", ").alias("words"))
    return frequency.join(listed, keys, "left").select("topic", F.coalesce("words", F.lit("")).alias("words"), "frequency", "timestamp")


def trend_of(trend: DataFrame, topics: Sequence[int]) -> DataFrame:
    return trend.filter(F.col("topic").isin(list(topics)))


def prevalence(df: DataFrame, community: str, topic: str = "topic") -> DataFrame:
    """``community, topic, count, share``: share of the community's rows."""
    counts = df.groupBy(F.col(community).alias("community"), F.col(topic).alias("topic")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy("community"))  # one row per topic
    return counts.withColumn("share", F.col("count") / total)


def prevalence_table(shares: DataFrame, communities: Sequence[str]) -> DataFrame:
    """One row per topic, one share column per community."""
    return shares.groupBy("topic").pivot("community", list(communities)).agg(F.max("share")).na.fill(0.0)
