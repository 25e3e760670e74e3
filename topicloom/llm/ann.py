"""Nearest neighbours by collision counting.

Every vector is scaled to unit length and projected on ``PROJECTIONS`` random
lines; each projection is kept as a sorted array. A query opens a window around
its own projection in each array and widens all windows together, level by
level (virtual rehashing: no level has hash tables of its own), by ``WIDER`` but
no wider than its nearest vectors found so far ask for. A vector that
lies in at least ``COLLISIONS`` of the windows is verified by its cosine. A
query stops when its windows are ``REACH`` times as wide as the distance of the
k-th verified vector: whatever is nearer than that has then very likely been
counted. Windows that hold everything end the search at the latest, so at
least k vectors are found if there are so many.

Vectors are dealt to blocks by a hash of the id and queries are sent to every
block in blocks of their own; a task holds one block of either. The best k of
each block are merged. All vectors are indexed; nothing is sampled.

Nulls: vectors that are null, zero, or hold null or non-finite components take
no part, nor do rows without id. Vectors are compared with those of the same
length only. Repeated rows count once; rows with a query's id are its own.
Ties go to the smaller id. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sampling import top_n

PROJECTIONS, COLLISIONS = 64, 46
FIRST, WIDER, REACH = 0.7, 1.4, 1.3
BLOCK, QUERIES = 2048, 2048
RESULT = "query_id bigint, vec_id bigint, score double"


def lines(dim: int, seed: int = 42) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, PROJECTIONS)).astype(np.float32)


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, verified: list[int] | None = None):
    """(query, vec_id, score) of the k best verified vectors of this block for each query.

    Only vectors above the collision threshold are verified, each once;
    ``verified`` collects how many of them a query had.
    """
    v_norm, q_norm = (np.sqrt((x * x).sum(axis=1)) for x in (vectors, queries))
    units, asked = vectors / v_norm[:, None], queries / q_norm[:, None]
    a = lines(vectors.shape[1])
    pv, pq = (units.astype(np.float32) @ a).T, (asked.astype(np.float32) @ a).T
    order = np.argsort(pv, axis=1)
    ordered = np.take_along_axis(pv, order, axis=1)
    n = len(ids)
    kind = np.uint16 if n < 1 << 16 else np.uint32
    ranks = np.empty_like(order, dtype=kind)  # place of each vector in each sorted array
    np.put_along_axis(ranks, order, np.arange(n, dtype=kind)[None, :], axis=1)
    spread = float(max(np.abs(pv).max(), np.abs(pq).max())) * 2
    out: list[tuple[int, int, float]] = []
    active, radius = np.arange(len(query_ids)), np.full(len(query_ids), FIRST)
    cosines = np.full((n, len(query_ids)), -np.inf)
    while len(active):
        counts = np.zeros((n, len(active)), np.uint8)
        for i in range(PROJECTIONS):
            centre = pq[i, active]
            low, high = np.searchsorted(ordered[i], centre - radius[active]), np.searchsorted(ordered[i], centre + radius[active], side="right")
            counts += (ranks[i][:, None] - low.astype(kind)) < (high - low).astype(kind)  # below the window the difference wraps round
        everything = radius[active] >= spread
        candidates = (counts >= np.where(everything, 0, COLLISIONS)) & (ids[:, None] != query_ids[active])
        scores = cosines[:, active]
        fresh = candidates & (scores == -np.inf)
        for j in np.flatnonzero(fresh.any(axis=0)).tolist():
            at = np.flatnonzero(fresh[:, j])
            scores[at, j] = units[at] @ asked[active[j]]
        cosines[:, active] = scores
        kth = np.partition(scores, n - k, axis=0)[n - k] if n >= k else np.full(len(active), -np.inf)
        reach = np.where(kth > -np.inf, REACH * np.sqrt(np.maximum(0, 2 - 2 * kth)), np.inf)
        done = everything | (radius[active] >= reach)
        if verified is not None:
            verified += np.isfinite(scores[:, done]).sum(axis=0).tolist()
        for j in np.flatnonzero(done).tolist():
            q = active[j]
            at = np.flatnonzero(candidates[:, j] & (scores[:, j] >= kth[j] - 1e-9))  # with near ties
            exact = (vectors[at] * queries[q]).sum(axis=1) / (v_norm[at] * q_norm[q])
            best = np.lexsort((ids[at], -exact))[:k]
            out += [(int(query_ids[q]), int(ids[at[x]]), float(exact[x])) for x in best]
        # wider windows, but no wider than the nearest found so far ask for
        radius[active] = np.minimum(radius[active] * WIDER, np.maximum(reach, radius[active]))
        active = active[~done]
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v and dim of the vectors that take part."""
    whole = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.filter("id IS NOT NULL AND v IS NOT NULL").filter(whole).dropDuplicates(["id", "v"]).withColumn("dim", F.size("v"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors of every query (``is_query``: of the column ``id``)."""
    rows = usable(vectors, id_col, vector_col)
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if(is_query)).first()
    n_blocks, n_parts = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERIES))
    block, part = F.pmod(F.xxhash64("id"), F.lit(n_blocks)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_parts))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    sent = rows.select("id", "v", "dim", F.lit(False).alias("asks"), block.alias("_block"), every(n_parts).alias("_part")).unionByName(
        rows.filter(is_query).select("id", "v", "dim", F.lit(True).alias("asks"), every(n_blocks).alias("_block"), part.alias("_part"))
    )

    def search(table):
        import pyarrow as pa

        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        dim = table.column("dim")[0].as_py()
        x = table.column("v").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dim)
        found = search_block(ids[~asks], x[~asks], ids[asks], x[asks], k) if asks.any() and not asks.all() else []
        columns = list(zip(*found)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = sent.groupBy("dim", "_block", "_part").applyInArrow(search, RESULT)
    return top_n(found, "query_id", [F.col("score").desc(), F.col("vec_id")], k, "rank").select("query_id", "rank", "vec_id", "score")
