"""New topics for outlier documents, by their words.

Documents are dealt to blocks of a bounded number of characters. Every word of
a block meets its topic weights once, and the block's scores are sums of the
topic vectors of tokens, so a document crosses the network as one row of
tokens, however many windows and topics it has.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructType

from ..functions import tokens as K
from ..session import materialize
from .cleaning import with_computed
from .joins import salted_join

#: characters of the texts of a block
BLOCK_CHARS = 1 << 18
#: numbers (windows x topics) held at once
STRIP = 1 << 21


def _by_word(weights: DataFrame) -> DataFrame:
    """``word, idf, topics, parts``: unit-length topic weights, one row per word.

    The lists of a word have at most one entry per topic.
    """
    real = weights.filter(F.col("topic") != -1)
    norms = real.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_norm"))
    scaled = salted_join(real, norms, ["topic"], "inner", ["word"])
    entry = F.struct(F.col("topic").cast("int").alias("topic"), (F.col("weight") / F.col("_norm")).alias("w"))
    lists = scaled.groupBy("word").agg(F.max("idf").alias("idf"), F.collect_list(entry).alias("_e"))
    return lists.select("word", "idf", F.col("_e.topic").alias("topics"), F.col("_e.w").alias("parts"))


class _Words:
    """Topic weights of the words of a block, as rows of a sparse matrix."""

    def __init__(self, table: pa.Table):
        topics, parts = table["topics"].combine_chunks(), table["parts"].combine_chunks()
        self.words = table["word"].combine_chunks()
        self.idf = table["idf"].to_numpy()
        self.topics, self._column = np.unique(topics.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
        self._part = parts.flatten().to_numpy(zero_copy_only=False)
        self._end = np.concatenate([[0], np.cumsum(pc.list_value_length(topics).to_numpy(zero_copy_only=False))])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """Number of every word, -1 where no topic has it."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def _entries(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place in ``numbers``, column and weight of all entries of known words."""
        n = self._end[numbers + 1] - self._end[numbers]
        at = np.repeat(self._end[numbers] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(numbers)), n), self._column[at], self._part[at]

    def bag(self, numbers: np.ndarray) -> np.ndarray:
        """Cosine of a bag of words and every topic."""
        known, tf = np.unique(numbers[numbers >= 0], return_counts=True)
        x = tf * self.idf[known]
        row, column, part = self._entries(known)
        dots = np.bincount(column, weights=x[row] * part, minlength=len(self.topics))
        size = np.sqrt((x * x).sum())
        return dots / size if size > 0 else dots * 0

    def windows(self, levels: list[tuple[int, np.ndarray]], window: int, stride: int, least: float) -> np.ndarray:
        """Per topic, the sum of the cosines of all windows that reach ``least``.

        ``levels`` are the n-grams by n, in order. The weights are not
        negative and summed without differences, so a window without a word
        of a topic has exactly 0. The squared length of a window is a sum over
        pairs of equal words in it.
        """
        tokens = max((len(numbers) + n - 1 for n, numbers in levels if len(numbers)), default=0)
        width, total = min(window, tokens), np.zeros(len(self.topics))
        starts = np.arange(0, tokens - width + 1, stride) if tokens else np.arange(0)
        per = max(1, STRIP // (max(1, len(self.topics)) * stride))
        for part in (starts[i : i + per] for i in range(0, len(starts), per)):
            dots, squares = np.zeros((len(part), len(self.topics))), np.zeros(len(part))
            for n, numbers in levels:
                m = width - n + 1  # n-grams of a window
                if m < 1:
                    continue
                here, at = numbers[part[0] : part[-1] + m], part - part[0]
                idf = np.where(here >= 0, self.idf[here], 0.0)
                known = np.flatnonzero(here >= 0)
                row, column, weight = self._entries(here[known])
                vectors = np.zeros((len(here), len(self.topics)))
                vectors[known[row], column] = weight * idf[known[row]]
                for j in range(m):
                    dots += vectors[at + j]
                for lag in range(m):
                    equal = np.where(here[lag:] == here[: len(here) - lag], idf[: len(here) - lag] ** 2, 0.0)
                    squares += (1 if lag == 0 else 2) * sliding_window_view(equal, m - lag)[at].sum(axis=1)
            sizes = np.sqrt(squares)[:, None]
            close = np.divide(dots, sizes, out=np.zeros_like(dots), where=sizes > 0)
            total += np.where(close >= least, close, 0.0).sum(axis=0)
        return total


def _scores(
    docs: DataFrame, weights: DataFrame, id_col: str, text_col: str, ngram_range: tuple[int, int], stop_words: str | Sequence[str] | None,
    window: int | None = None, stride: int = 1, least: float = 0.0, best: bool = False,
) -> DataFrame:
    """``id, topic, similarity`` above 0, of whole documents or summed over token windows; with ``best`` the largest only.

    Equal scores go to the smaller topic. Null and empty texts have no row.
    """
    size = docs.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_CHARS))
    sizes = range(ngram_range[0], ngram_range[1] + 1)
    rows = with_computed(docs.select(id_col, text_col), "_t", K.terms(text_col, (1, 1), stop_words)).filter(F.size("_t") > 0)
    grams = F.array(*[K.ngrams(F.col("_t"), n, n) for n in sizes])
    dealt = materialize(rows.select(F.col(id_col).alias("_id"), F.pmod(F.xxhash64(id_col), F.lit(blocks)).alias("_block"), grams.alias("_grams")))
    held = dealt.select("_block", F.explode(F.flatten("_grams")).alias("word")).distinct()
    # a word has one row per block at most, a block thousands of words: no word is hot
    words = held.join(_by_word(weights), "word").withColumnRenamed("_block", "_of")
    kind = dealt.schema["_id"].dataType.simpleString()

    empty = to_arrow_schema(StructType().add("_id", dealt.schema["_id"].dataType).add("topic", IntegerType()).add("similarity", DoubleType())).empty_table()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, topics, scores = [], [], []
        if left.num_rows and right.num_rows:
            known, levels = _Words(right), left["_grams"].combine_chunks().flatten()
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(levels).to_numpy(zero_copy_only=False))])
            numbers = known.numbers(levels.flatten())
            for i in range(left.num_rows):
                a = i * len(sizes)
                if window is None:
                    found = known.bag(numbers[ends[a] : ends[a + len(sizes)]])
                else:
                    own = [(n, numbers[ends[a + j] : ends[a + j + 1]]) for j, n in enumerate(sizes)]
                    found = known.windows(own, window, stride, least)
                at = np.flatnonzero(found > 0)
                if best and len(at):
                    at = np.array([found.argmax()])
                rows.append(np.full(len(at), i))
                topics.append(known.topics[at])
                scores.append(found[at])
        if not rows:
            return empty
        ids = left["_id"].take(pa.array(np.concatenate(rows)))
        return pa.table({"_id": ids, "topic": pa.array(np.concatenate(topics), pa.int32()), "similarity": pa.array(np.concatenate(scores))})

    scored = dealt.groupBy("_block").cogroup(words.groupBy("_of")).applyInArrow(run, f"_id {kind}, topic int, similarity double")
    return scored.withColumnRenamed("_id", id_col)


def _reassign(assigned: DataFrame, best: DataFrame, id_col: str, least: float) -> DataFrame:
    """Outliers take their best topic if its score reaches ``least``."""
    usable = best.filter(F.col("similarity") >= least).select(id_col, F.col("topic").alias("_new"))
    joined = assigned.join(usable, id_col, "left")
    topic = F.when(F.col("topic") == -1, F.coalesce(F.col("_new"), F.lit(-1))).otherwise(F.col("topic"))
    return joined.withColumn("topic", topic.cast("int")).drop("_new")


def _outlier_texts(assigned: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(id_col, text_col).join(assigned.filter(F.col("topic") == -1).select(id_col), id_col, "left_semi")


def reduce_by_terms(
    assigned: DataFrame, docs: DataFrame, weights: DataFrame, threshold: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
    ngram_range: tuple[int, int] = (1, 1), stop_words: str | Sequence[str] | None = None,
) -> DataFrame:
    """Best topic by cosine of the document's and the topic's class TF-IDF."""
    texts = _outlier_texts(assigned, docs, id_col, text_col)
    return _reassign(assigned, _scores(texts, weights, id_col, text_col, ngram_range, stop_words, best=True), id_col, threshold)


def topic_distributions(
    docs: DataFrame, weights: DataFrame, min_similarity: float = 0.1, window: int = 4, stride: int = 1, id_col: str = "doc_id",
    text_col: str = "text", ngram_range: tuple[int, int] = (1, 1), stop_words: str | Sequence[str] | None = None,
) -> DataFrame:
    """``id, topic, score``: similarities of all token windows, summed per topic.

    A text shorter than the window is one window.
    """
    found = _scores(docs, weights, id_col, text_col, ngram_range, stop_words, window, stride, min_similarity)
    return found.withColumnRenamed("similarity", "score")


def reduce_by_distribution(
    assigned: DataFrame, docs: DataFrame, weights: DataFrame, threshold: float = 0.0, id_col: str = "doc_id", text_col: str = "text",
    ngram_range: tuple[int, int] = (1, 1), stop_words: str | Sequence[str] | None = None,
) -> DataFrame:
    """Best topic by the summed similarity of token windows that reach ``threshold``."""
    texts = _outlier_texts(assigned, docs, id_col, text_col)
    best = _scores(texts, weights, id_col, text_col, ngram_range, stop_words, 4, 1, threshold, best=True)
    return _reassign(assigned, best, id_col, 0.0)
