"""Tokens and n-grams as array columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Fixed value: runs of two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"


def stop_word_list(stop_words: str | Sequence[str] | None) -> list[str]:
    """A language name known to Spark ML, own words, or none."""
    if stop_words is None:
        return []
    if isinstance(stop_words, str):
        return StopWordsRemover.loadDefaultStopWords(stop_words)
    return list(stop_words)


def tokenize(c: Column | str, lowercase: bool = True) -> Column:
    c = col(c)
    return F.regexp_extract_all(F.lower(c) if lowercase else c, F.lit(TOKEN), F.lit(0))


def without_stop_words(tokens: Column, words: Sequence[str]) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(list(words))) if words else tokens


def ngrams(tokens: Column, lo: int = 1, hi: int = 1) -> Column:
    """All runs of ``lo`` to ``hi`` tokens, joined by a space."""

    def runs(n: int) -> Column:
        if n == 1:
            return tokens
        starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), " "))

    parts = [runs(n) for n in range(lo, hi + 1)]
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def terms(
    c: Column | str,
    ngram_range: tuple[int, int] = (1, 1),
    stop_words: str | Sequence[str] | None = None,
    lowercase: bool = True,
) -> Column:
    """Lower-cased tokens, stop words out, then n-grams."""
    tokens = without_stop_words(tokenize(c, lowercase), stop_word_list(stop_words))
    return tokens if tuple(ngram_range) == (1, 1) else once(tokens, lambda t: ngrams(t, *ngram_range))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is mentioned."""
    return F.transform(F.array(value), use)[0]


def words_label(words: Column, n: int = 3, sep: str = " - ") -> Column:
    return F.array_join(F.slice(words, 1, n), sep)


def words_with_weights(pairs: Column, decimals: int = 2) -> Column:
    """``word (0.00), word (0.00)`` from an array of ``struct<word, weight>``."""
    return F.array_join(F.transform(pairs, lambda p: F.format_string(f"%s (%.{decimals}f)", p["word"], p["weight"])), ", ")
