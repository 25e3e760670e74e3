"""Topic words re-ranked by vector similarity, made diverse, or chained as aspects."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions import vectors as V
from .joins import salted_join
from .similarity import mean_vectors
from .terms import top_words

log = logging.getLogger(__name__)
CANDIDATES = 100
DIVERSE_CANDIDATES = 30


def word_vectors(
    docs: DataFrame, vectors: DataFrame, words: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    vector: str = "embedding", ngram_range: tuple[int, int] = (1, 1), stop_words: str | Sequence[str] | None = None,
) -> DataFrame:
    """``word, vector``: mean vector of the documents that hold the word."""
    held = F.explode(F.array_distinct(K.terms(text_col, ngram_range, stop_words)))
    pairs = docs.select(id_col, held.alias("word"))
    wanted = salted_join(pairs, words.select("word").distinct(), ["word"], "left_semi", [id_col])
    return mean_vectors(wanted.join(vectors.select(id_col, vector), id_col), "word", vector)


def keywords_by_similarity(
    weights: DataFrame, topic_vectors: DataFrame, vectors_of_words: DataFrame, n: int = 10, candidates: int = CANDIDATES
) -> DataFrame:
    """The ``candidates`` heaviest words of each topic, re-ranked by cosine to the topic vector."""
    words = top_words(weights, candidates).select("topic", "word")
    scored = (
        words.join(vectors_of_words.withColumnRenamed("vector", "_w"), "word")
        .join(topic_vectors.select("topic", F.col("vector").alias("_t")), "topic")
        # words held by the same documents tie; rounding keeps the tie from the order of sums
        .select("topic", "word", F.round(V.cosine("_w", "_t"), 10).alias("weight"))
    )
    return top_words(scored, n)


def diverse_words(
    words: DataFrame, topic_vectors: DataFrame, vectors_of_words: DataFrame, diversity: float = 0.3, n: int = 10, candidates: int | None = None
) -> DataFrame:
    """Maximal marginal relevance over each topic's words, or its first ``candidates``.

    Chosen words keep their order and weight.
    """
    pool = (
        (words if candidates is None else words.filter(F.col("rank") <= candidates))
        .join(vectors_of_words.withColumnRenamed("vector", "_w"), "word")
        .join(topic_vectors.select("topic", F.col("vector").alias("_t")), "topic")
    )

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        w = np.array(pdf["_w"].tolist(), dtype=float)
        t = np.array(pdf["_t"].iloc[0], dtype=float)
        w /= np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-300)
        relevance = w @ (t / max(np.linalg.norm(t), 1e-300))
        alike = w @ w.T
        chosen = [int(relevance.argmax())]
        while len(chosen) < min(n, len(w)):
            score = (1 - diversity) * relevance - diversity * alike[:, chosen].max(axis=1)
            score[chosen] = -np.inf
            chosen.append(int(score.argmax()))
        out = pdf.iloc[sorted(chosen)][["topic", "word", "weight"]].copy()
        out["rank"] = np.arange(1, len(out) + 1)
        return out[["topic", "rank", "word", "weight"]]

    kind = words.schema["topic"].dataType.simpleString()
    return pool.groupBy("topic").applyInPandas(pick, f"topic {kind}, rank long, word string, weight double")


# Step names accepted in settings.
STEP_NAMES = {
    "KeyBERTInspired": "keywords",
    "keywords": "keywords",
    "MaximalMarginalRelevance": "diverse",
    "diverse": "diverse",
}


def _checked(definition: Any) -> tuple[str, dict] | None:
    if not isinstance(definition, dict) or "model_name" not in definition:
        log.warning("representation step %r is not a definition; skipped", definition)
        return None
    step = STEP_NAMES.get(definition["model_name"])
    if step is None:
        log.warning("unknown representation step %r; skipped", definition["model_name"])
        return None
    return step, dict(definition.get("params") or {})


def aspect_steps(config: Any) -> dict[str, list[tuple[str, dict]]]:
    """Aspect name -> chain of steps. Nothing valid gives the plain words only.

    One definition replaces the main words; in a list every item is an aspect,
    ``aspect_{i}`` if unnamed. An item's ``chain`` holds several definitions.
    """
    if config is None:
        return {}
    if isinstance(config, dict):
        step = _checked(config)
        return {"Main": [step]} if step else {}
    if not isinstance(config, list):
        log.warning("representation settings must be a dictionary or list; using plain words")
        return {}
    out = {}
    for i, item in enumerate(config):
        chain = item.get("chain") if isinstance(item, dict) else None
        steps = [s for s in map(_checked, chain or [item]) if s]
        if steps:
            out[item.get("aspect_name", f"aspect_{i}")] = steps
    return out


def most_candidates(config: Any) -> int:
    """Words per topic that need a vector for these settings."""
    steps = [(step, params) for chain in aspect_steps(config).values() for step, params in chain]
    default = {"keywords": CANDIDATES, "diverse": DIVERSE_CANDIDATES}
    return max([CANDIDATES, *(params.get("nr_candidate_words", default[step]) for step, params in steps)])


def aspects(
    config: Any, weights: DataFrame, topic_vectors: DataFrame, vectors_of_words: DataFrame, top_n_words: int = 10
) -> DataFrame:
    """``aspect, topic, rank, word, weight`` of the main words and every aspect."""
    chains = aspect_steps(config)
    tables = {} if "Main" in chains else {"Main": top_words(weights, top_n_words)}
    for name, steps in chains.items():
        words = None
        for step, params in steps:
            n = params.get("top_n_words", top_n_words)
            if step == "keywords":
                source = weights if words is None else words
                words = keywords_by_similarity(source, topic_vectors, vectors_of_words, n, params.get("nr_candidate_words", CANDIDATES))
            else:
                source = top_words(weights, params.get("nr_candidate_words", DIVERSE_CANDIDATES)) if words is None else words
                words = diverse_words(source, topic_vectors, vectors_of_words, params.get("diversity", 0.1), n)
        tables[name] = words
    out = None
    for name, words in tables.items():
        part = words.select(F.lit(name).alias("aspect"), "topic", "rank", "word", "weight")
        out = part if out is None else out.unionByName(part)
    return out
