"""Exchangeable parts of a topic model: what reduces vectors, and what groups them.

A reducer turns ``id, embedding`` into ``id, reduced``; a clusterer turns that
into ``id, cluster, strength`` with -1 for noise, and may add ``shares``, the
responsibility of every cluster in order. Any object with these methods is a
part. Parts may not drop rows: a row whose vector is null is noise.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Clustering
from ..functions import vectors as V
from ..session import materialize
from . import density, embed


class Reducer(Protocol):
    def reduce(self, vectors: DataFrame, id_col: str) -> DataFrame: ...


class Clusterer(Protocol):
    def cluster(self, reduced: DataFrame, id_col: str) -> DataFrame: ...


@dataclass(frozen=True)
class PrincipalComponents:
    """Unit length, then the first ``n`` principal components."""

    n: int = 5

    def reduce(self, vectors: DataFrame, id_col: str) -> DataFrame:
        return embed.reduce_vectors(vectors.select(id_col, "embedding"), self.n).select(id_col, "reduced")


@dataclass(frozen=True)
class UnitVectors:
    """All coordinates, at length 1."""

    def reduce(self, vectors: DataFrame, id_col: str) -> DataFrame:
        return vectors.select(id_col, V.unit("embedding").alias("reduced"))


@dataclass(frozen=True)
class DensityParts:
    """Density clustering, see :mod:`.density`."""

    settings: Clustering = field(default_factory=Clustering)

    def cluster(self, reduced: DataFrame, id_col: str) -> DataFrame:
        return density.density_clusters(reduced, id_col, "reduced", self.settings)


def _split(reduced: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Staged rows to fit on, with a vector column ``_x``, and rows without a vector as noise."""
    rows = materialize(reduced.select(id_col, F.col("reduced").cast("array<double>").alias("_v")))
    noise = rows.filter(F.col("_v").isNull()).select(id_col, F.lit(-1).alias("cluster"), F.lit(0.0).alias("strength"))
    return rows.filter(F.col("_v").isNotNull()).select(id_col, array_to_vector("_v").alias("_x")), noise


@dataclass(frozen=True)
class BisectingParts:
    """At most ``k`` groups by repeated halving; ``strength`` is 1 / (1 + distance to the group's centre).

    No row is noise but one without a vector. Groups of fewer than
    ``min_size`` rows are not halved.
    """

    k: int = 8
    seed: int = 42
    min_size: float = 1.0

    def __post_init__(self) -> None:
        if self.k < 2:
            raise ValueError("k must be at least 2")

    def cluster(self, reduced: DataFrame, id_col: str) -> DataFrame:
        rows, noise = _split(reduced, id_col)
        if rows.isEmpty():
            return noise
        fitted = BisectingKMeans(k=self.k, seed=self.seed, minDivisibleClusterSize=self.min_size, featuresCol="_x", predictionCol="cluster").fit(rows)
        centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in fitted.clusterCenters()])  # k rows
        gap = F.zip_with(vector_to_array("_x"), F.get(centres, F.col("cluster")), lambda a, b: a - b)
        placed = fitted.transform(rows).select(id_col, "cluster", (1 / (1 + V.norm(gap))).alias("strength"))
        return placed.unionByName(noise)


@dataclass(frozen=True)
class MixtureParts:
    """A mixture of ``k`` Gaussians; ``shares`` are the responsibilities of its components.

    A row belongs to the component of the largest share (ties: the first),
    and is noise if that share is below ``least``. A row without a vector is
    noise and has no shares.
    """

    k: int = 8
    seed: int = 42
    least: float = 0.0
    rounds: int = 100

    def __post_init__(self) -> None:
        if self.k < 2:
            raise ValueError("k must be at least 2")
        if not 0 <= self.least <= 1:
            raise ValueError("least must be between 0 and 1")

    def fit(self, rows: DataFrame):
        return GaussianMixture(k=self.k, seed=self.seed, maxIter=self.rounds, featuresCol="_x", predictionCol="_p", probabilityCol="_shares").fit(rows)

    def cluster(self, reduced: DataFrame, id_col: str) -> DataFrame:
        return self.fit_cluster(reduced, id_col)[0]

    def fit_cluster(self, reduced: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame | None]:
        """The rows, and the parameters ``component, weight, mean, cov`` (column by column); None without rows."""
        rows, noise = _split(reduced, id_col)
        noise = noise.withColumn("shares", F.lit(None).cast("array<double>"))
        if rows.isEmpty():
            return noise, None
        fitted = self.fit(rows)
        shares = fitted.transform(rows).select(id_col, vector_to_array("_shares").alias("shares"))
        best = F.array_max("shares")
        cluster = F.when(best >= self.least, (F.array_position("shares", best) - 1).cast("int")).otherwise(F.lit(-1))
        strength = F.when(best >= self.least, best).otherwise(F.lit(0.0))
        placed = shares.select(id_col, cluster.alias("cluster"), strength.alias("strength"), "shares")
        return placed.unionByName(noise), _parameters(fitted)


def _parameters(fitted) -> DataFrame:
    """One row per component."""
    spark = fitted.gaussiansDF.sparkSession
    rows = [
        (i, float(w), [float(v) for v in r["mean"].toArray()], [float(v) for v in r["cov"].toArray().ravel(order="F")])
        for i, (w, r) in enumerate(zip(fitted.weights, fitted.gaussiansDF.collect()))  # k rows
    ]
    return spark.createDataFrame(rows, "component int, weight double, mean array<double>, cov array<double>")


def _added(shares: Column, places: Sequence[int]) -> Column:
    return F.aggregate(F.array(*[F.get(shares, F.lit(p)) for p in places]), F.lit(0.0), lambda a, x: a + x)


def topic_shares(placed: DataFrame, assigned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id, topics, probabilities``: the shares of a clusterer, by topic.

    Clusters that became one topic, as the small ones became -1, are added. A
    cluster that is the largest of no row belongs to -1. ``topics`` is
    ascending, the same in all rows; rows without shares are left out.
    """
    both = placed.filter(F.col("shares").isNotNull()).select(id_col, "cluster", "shares")
    mapping = both.join(assigned.select(id_col, "topic"), id_col).filter("cluster >= 0").groupBy("cluster").agg(F.min("topic").alias("topic"))
    topic_of = {r["cluster"]: r["topic"] for r in mapping.collect()}  # one row per cluster
    first = both.select(F.size("shares").alias("n")).first()
    places: dict[int, list[int]] = {}
    for cluster in range(first.n if first else 0):
        places.setdefault(topic_of.get(cluster, -1), []).append(cluster)
    topics = sorted(places)
    values = [_added(F.col("shares"), places[t]) for t in topics]
    empty = F.array().cast("array<double>")
    return both.select(
        id_col, F.array(*[F.lit(t) for t in topics]).cast("array<int>").alias("topics"), (F.array(*values) if values else empty).alias("probabilities")
    )
