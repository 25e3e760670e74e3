"""Text vectors, dimension reduction and power transform."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions import vectors as V

Encoder = Callable[[list[str]], np.ndarray]
#: words whose cells of the word-document matrix are counted and multiplied at once
CELLS = 1 << 16


def embed_texts(
    df: DataFrame, make_encoder: Callable[[], Encoder], id_col: str = "doc_id", text_col: str = "text", batch_size: int = 32
) -> DataFrame:
    """``id, embedding`` from a user's encoder; a null text is encoded as ''.

    ``make_encoder`` runs once per task and returns a function from a batch of
    texts to an array with one row per text. Ids may be of any type.
    """

    def run(batches):
        encode = None
        for batch in batches:
            if not batch.num_rows:
                continue
            encode = encode or make_encoder()
            yield _embedded(batch.column(id_col), _encoded(batch.column(text_col), encode, batch_size), id_col)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")


def _encoded(texts, encode: Encoder, batch_size: int) -> np.ndarray:
    """One row per text of an Arrow column, of which ``batch_size`` texts are Python strings at once."""
    slices = [texts.slice(i, batch_size) for i in range(0, len(texts), batch_size)]
    return np.vstack([np.asarray(encode(s.fill_null("").to_pylist()), dtype=np.float32) for s in slices])


def _embedded(ids, matrix: np.ndarray, id_col: str):
    """An Arrow batch of ids and the rows of a matrix."""
    import pyarrow as pa

    n, d = matrix.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * d), pa.array(matrix.astype(np.float32).ravel()))
    return pa.RecordBatch.from_arrays([ids, lists], [id_col, "embedding"])


def _weighted_signs(slots, idf: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Per row of an Arrow column of slots the sum of its sign rows, by count and IDF; as many rows at a time as have ``CELLS`` words."""
    words = slots.value_lengths().to_numpy()
    ends, out, start = np.cumsum(words), np.zeros((len(slots), signs.shape[1])), 0
    while start < len(slots):
        before = ends[start] - words[start]
        stop = max(start + 1, int(np.searchsorted(ends, before + CELLS, side="right")))
        row = np.repeat(np.arange(start, stop), words[start:stop])
        cell, tf = np.unique(row * len(idf) + slots.slice(start, stop - start).flatten().to_numpy(), return_counts=True)
        row, slot = np.divmod(cell, len(idf))
        for a in range(0, len(cell), CELLS):  # a row of more cells
            part = slice(a, a + CELLS)
            first = np.flatnonzero(np.diff(row[part], prepend=-1))
            out[row[part][first]] += np.add.reduceat((tf[part] * idf[slot[part]])[:, None] * signs[slot[part]], first)
        start = stop
    return out


@dataclass(frozen=True)
class HashedEmbedding:
    """Built-in embedding without a model: hashed TF, IDF, random signs, unit length.

    ``idf`` has ``n_features`` entries, whatever the size of the corpus.
    """

    idf: tuple[float, ...]
    dim: int = 64
    seed: int = 42
    stop_words: str | tuple[str, ...] | None = None

    @classmethod
    def fit(cls, df: DataFrame, text_col: str = "text", dim: int = 64, n_features: int = 1 << 14, seed: int = 42, stop_words=None):
        slots = _slots(text_col, n_features, stop_words)
        used = df.select(F.explode(F.array_distinct(slots)).alias("slot")).groupBy("slot").agg(F.count(F.lit(1)).alias("n"))
        idf = np.full(n_features, np.log(df.count() + 1.0))
        for slot, n in used.collect():  # at most n_features rows
            idf[slot] -= np.log(n + 1.0)
        return cls(tuple(idf), dim, seed, stop_words)

    def transform(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id, embedding``; a text without words gives the zero vector."""
        idf, dim, seed = np.array(self.idf), self.dim, self.seed

        def run(batches):
            signs = np.random.default_rng(seed).choice([-1.0, 1.0], size=(len(idf), dim))
            for batch in batches:
                out = _weighted_signs(batch.column("_slots"), idf, signs)
                size = np.linalg.norm(out, axis=1, keepdims=True)
                yield _embedded(batch.column(id_col), np.divide(out, size, out=np.zeros_like(out), where=size > 0), id_col)

        kind = df.schema[id_col].dataType.simpleString()
        words = df.select(id_col, _slots(text_col, len(idf), self.stop_words).alias("_slots"))
        return words.mapInArrow(run, f"`{id_col}` {kind}, embedding array<float>")

    def state(self) -> dict[str, Any]:
        return {"kind": "hashed", "idf": list(self.idf), "dim": self.dim, "seed": self.seed, "stop_words": self.stop_words}


#: encoders by name, for models that are saved and loaded
ENCODERS: dict[str, Callable[[], Encoder]] = {}


def register_encoder(name: str, make_encoder: Callable[[], Encoder]) -> None:
    """Name a user's encoder, so that a model can be saved with it and loaded in a session that registered it too."""
    if ENCODERS.get(name, make_encoder) is not make_encoder:
        raise ValueError(f"another encoder is registered as {name!r}")
    ENCODERS[name] = make_encoder


@dataclass(frozen=True)
class NamedEmbedding:
    """Vectors of a registered encoder."""

    name: str
    batch_size: int = 32

    def transform(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        if self.name not in ENCODERS:
            raise ValueError(f"no encoder is registered as {self.name!r}")
        return embed_texts(df, ENCODERS[self.name], id_col, text_col, self.batch_size)

    def state(self) -> dict[str, Any]:
        return {"kind": "named", "name": self.name, "batch_size": self.batch_size}


Embedding = HashedEmbedding | NamedEmbedding


def embedding_of(state: dict[str, Any] | None) -> Embedding | None:
    """The embedding of a saved state."""
    if state is None:
        return None
    values = {k: tuple(v) if isinstance(v, list) else v for k, v in state.items() if k != "kind"}
    kinds = {"hashed": HashedEmbedding, "named": NamedEmbedding}
    if state.get("kind") not in kinds:
        raise ValueError(f"unknown kind of embedding {state.get('kind')!r}")
    return kinds[state["kind"]](**values)


def _slots(text_col: str, n_features: int, stop_words) -> Column:
    words = K.terms(F.coalesce(F.col(text_col), F.lit("")), stop_words=stop_words)
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(n_features)).cast("int"))


def fit_pca(rows: DataFrame, k: int, vector: str = "embedding", unit: bool = True) -> PCAModel:
    """The driver sees the d x d covariance only."""
    source = V.unit(vector) if unit else F.col(vector).cast("array<double>")
    return PCA(k=k, inputCol="_in", outputCol="_out").fit(rows.select(array_to_vector(source).alias("_in")))


def apply_pca(rows: DataFrame, model: PCAModel, vector: str = "embedding", unit: bool = True, name: str = "reduced") -> DataFrame:
    """Add the reduced vector. The largest entry of a component counts as positive."""
    source = V.unit(vector) if unit else F.col(vector).cast("array<double>")
    pc = model.pc.toArray()
    signs = F.array(*[F.lit(float(s)) for s in np.where(pc[np.abs(pc).argmax(axis=0), np.arange(pc.shape[1])] < 0, -1.0, 1.0)])
    out = model.transform(rows.withColumn("_in", array_to_vector(source)))
    flipped = F.zip_with(vector_to_array("_out"), signs, lambda x, s: x * s)
    return out.withColumn(name, flipped).drop("_in", "_out")


def reduce_vectors(rows: DataFrame, k: int = 5, vector: str = "embedding", unit: bool = True, name: str = "reduced") -> DataFrame:
    """Unit length, then the first ``k`` principal components.

    Principal components are linear: they keep the broad structure of a
    non-linear layout but not its local neighbourhoods. Components that the
    data do not have (one row, or fewer dimensions than ``k``) are 0.
    """
    some = rows.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("d")).limit(2).collect()
    if len(some) < 2:
        return rows.withColumn(name, F.array_repeat(F.lit(0.0), k))
    have = min(k, some[0].d)
    out = apply_pca(rows, fit_pca(rows, have, vector, unit), vector, unit, name)
    return out if have == k else out.withColumn(name, F.concat(name, F.array_repeat(F.lit(0.0), k - have)))


# --- power transform ------------------------------------------------------------

def yeo_johnson(x: Column, lam: Column) -> Column:
    pos = F.when(F.abs(lam) > 1e-9, (F.pow(x + 1, lam) - 1) / lam).otherwise(F.log1p(x))
    two = 2 - lam
    neg = F.when(F.abs(two) > 1e-9, -(F.pow(1 - x, two) - 1) / two).otherwise(-F.log1p(-x))
    return F.when(x >= 0, pos).otherwise(neg)


def _yj(x: np.ndarray, lam: float) -> np.ndarray:
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = (np.power(x[pos] + 1, lam) - 1) / lam if abs(lam) > 1e-9 else np.log1p(x[pos])
    two = 2 - lam
    out[~pos] = -(np.power(1 - x[~pos], two) - 1) / two if abs(two) > 1e-9 else -np.log1p(-x[~pos])
    return out


def _likelihoods(rows: DataFrame, vector: str, grid: np.ndarray) -> DataFrame:
    """``dim, step, n, logs, mean, var``: partial sums per task, then one grouping.

    ``grid[d]`` holds the candidate exponents of dimension ``d``.
    """

    def partial(batches):
        total = None
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.array(pdf[vector].tolist(), dtype=np.float64)
            y = [[_yj(x[:, d], lam) for lam in grid[d]] for d in range(x.shape[1])]
            logs = (np.sign(x) * np.log1p(np.abs(x))).sum(axis=0)
            here = np.array([[(len(v), v.sum(), (v * v).sum(), logs[d]) for v in y[d]] for d in range(len(y))])
            total = here if total is None else total + here
        if total is not None:
            d, step = np.indices(total.shape[:2]).reshape(2, -1)
            yield pd.DataFrame({"dim": d, "step": step, **dict(zip(("n", "s", "ss", "logs"), total.reshape(-1, 4).T))})

    sums = rows.select(vector).mapInPandas(partial, "dim int, step int, n double, s double, ss double, logs double")
    table = sums.groupBy("dim", "step").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss", "logs")])
    mean = F.col("s") / F.col("n")
    return table.select("dim", "step", "n", "logs", mean.alias("mean"), F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-300)).alias("var"))


def fit_power(rows: DataFrame, vector: str = "embedding") -> list[tuple[float, float, float]]:
    """Per dimension ``(exponent, mean, deviation)``; a coarse grid, then two finer ones."""
    dim = rows.select(F.max(F.size(vector))).first()[0]
    grid = np.tile(np.arange(-2.0, 4.01, 0.25), (dim, 1))
    best: list[tuple[float, float, float]] = []
    for half in (0.25, 0.025, None):
        best = []
        for r in _likelihoods(rows, vector, grid).groupBy("dim").agg(
            F.max_by(F.struct("step", "n", "logs", "mean", "var"), F.expr("-n / 2 * ln(var)") + (F.element_at(
                F.array(*[F.array(*[F.lit(float(v)) for v in g]) for g in grid]), F.col("dim") + 1)[F.col("step")] - 1) * F.col("logs")).alias("b")
        ).orderBy("dim").collect():
            best.append((float(grid[r.dim][r.b.step]), r.b.mean, float(np.sqrt(r.b.var))))
        if half:
            grid = np.array([np.linspace(lam - half, lam + half, 21) for lam, _, _ in best])
    return best


def power_transform(rows: DataFrame, vector: str = "embedding", name: str = "scaled") -> DataFrame:
    """Yeo-Johnson per dimension with the likeliest exponent, then mean 0 and deviation 1."""
    fitted = fit_power(rows, vector)
    lam, mean, sd = [F.array(*[F.lit(float(v)) for v in col]) for col in zip(*fitted)]
    i = lambda a, k: F.element_at(a, k + 1)
    scaled = F.transform(
        F.col(vector).cast("array<double>"),
        lambda x, k: F.when(i(sd, k) > 1e-12, (yeo_johnson(x, i(lam, k)) - i(mean, k)) / i(sd, k)).otherwise(F.lit(0.0)),
    )
    return rows.withColumn(name, scaled)
