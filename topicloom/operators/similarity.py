"""Similarity of rows to topics, as a matrix product per Arrow batch.

The topic matrix travels to the workers in blocks of at most
``BLOCK_BYTES``. There is one block for any usual model; beyond that the rows
are read once per block and results are combined, so nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .sampling import top_n, with_row_number

BLOCK_BYTES = 64 << 20
#: similarities held at once within a batch
STRIP = 1 << 22
FLOOR_BINS = 2000


def mean_vectors(rows: DataFrame, key: str, vector: str = "embedding", name: str = "vector", count: str | None = None) -> DataFrame:
    """Element-wise mean of the vectors of each key, combined on the map side; ``count`` names a column of their number."""
    vec = array_to_vector(F.col(vector).cast("array<double>"))
    number = [] if count is None else [F.count(F.lit(1)).alias(count)]
    return rows.groupBy(key).agg(vector_to_array(Summarizer.mean(vec)).alias(name), *number)


def _blocks(topics: DataFrame, topic_col: str, vector: str, block_bytes: int) -> Iterator[tuple[list, np.ndarray]]:
    """Topic ids and unit vectors, at most ``block_bytes`` at a time."""
    table = topics.select(F.col(topic_col).alias("topic"), F.col(vector).cast("array<double>").alias("vector"))
    size = table.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    per_block = max(1, block_bytes // (8 * max(1, size.d or 1)))
    if size.n <= per_block:
        parts = [table]
    else:
        numbered = with_row_number(table, "topic", "_rn")
        parts = [numbered.filter(F.floor(F.col("_rn") / per_block) == b) for b in range(-(-size.n // per_block))]
    for part in parts:
        rows = part.orderBy("topic").collect()
        if rows:
            m = np.array([r.vector for r in rows], dtype=np.float64)
            yield [r.topic for r in rows], _unit(m)


def _unit(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _matrix(column) -> np.ndarray:
    """Unit rows of an Arrow column of vectors."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(values.reshape(len(column), -1))


def _strips(batch, vector: str, m: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """First row and similarities of as many rows of a batch as ``STRIP`` numbers allow."""
    rows = max(1, STRIP // max(1, len(m)))
    for start in range(0, batch.num_rows, rows):
        yield start, _matrix(batch.column(vector).slice(start, rows)) @ m.T


def _first(sim: np.ndarray, k: int) -> np.ndarray:
    """Columns of the ``k`` largest numbers of each row, largest first, equal ones by column."""
    if k >= sim.shape[1]:
        return np.argsort(-sim, axis=1, kind="stable")
    least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
    out = np.empty((len(sim), k), dtype=np.int64)
    for i, row in enumerate(sim):  # few columns reach the k-th largest
        at = np.flatnonzero(row >= least[i])
        out[i] = at[np.argsort(-row[at], kind="stable")][:k]
    return out


def _type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def similarities(
    rows: DataFrame, topics: DataFrame, id_col: str = "doc_id", vector: str = "embedding",
    topic_col: str = "topic", topic_vector: str = "vector", top: int | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, topic, similarity`` (cosine) for the ``top`` most similar topics, or all.

    The best of each block of topics are chosen within the batch, and the
    blocks' lists are merged, so with ``top`` no row is made for any other
    pair. Ids may be of any type.
    """
    slim = rows.select(id_col, vector)
    schema = f"`{id_col}` {_type(rows, id_col)}, topic {_type(topics, topic_col)}, similarity double"
    kind = to_arrow_type(topics.schema[topic_col].dataType)
    parts = []
    for ids, m in _blocks(topics, topic_col, topic_vector, block_bytes):

        def score(batches, ids=ids, m=m):
            import pyarrow as pa

            names, k = pa.array(ids, kind), len(ids) if top is None else min(top, len(ids))
            for batch in batches:
                for start, sim in _strips(batch, vector, m):
                    best = np.tile(np.arange(k), (len(sim), 1)) if top is None else _first(sim, k)
                    own = batch.column(id_col).take(pa.array(np.repeat(np.arange(start, start + len(sim)), k)))
                    columns = [own, names.take(pa.array(best.ravel())), pa.array(np.take_along_axis(sim, best, axis=1).ravel())]
                    yield pa.RecordBatch.from_arrays(columns, [id_col, "topic", "similarity"])

        parts.append(slim.mapInArrow(score, schema))
    if not parts:
        return rows.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if top is not None and len(parts) > 1:
        out = top_n(out, id_col, [F.desc("similarity"), F.asc("topic")], top)
    return out


def topic_similarity(topics: DataFrame, others: DataFrame | None = None, topic_col: str = "topic", vector: str = "vector") -> DataFrame:
    """``topic, other, similarity`` of every topic to every topic (or to ``others``)."""
    left = topics.select(F.col(topic_col).alias("_a"), F.col(vector).alias("_v"))
    sims = similarities(left, topics if others is None else others, "_a", "_v", topic_col, vector)
    return sims.select(F.col("_a").alias("topic"), F.col("topic").alias("other"), "similarity")


def probability_arrays(
    rows: DataFrame, topics: DataFrame, id_col: str = "doc_id", vector: str = "embedding",
    topic_col: str = "topic", topic_vector: str = "vector", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, topics, probabilities``: similarities clipped at 0, scaled to sum 1, in topic order.

    One block of topics needs no shuffle.
    """
    blocks = list(_blocks(topics, topic_col, topic_vector, block_bytes))
    kind = _type(topics, topic_col)
    if len(blocks) != 1:
        sims = similarities(rows, topics, id_col, vector, topic_col, topic_vector, None, block_bytes)
        clipped = F.struct("topic", F.greatest(F.col("similarity"), F.lit(0.0)).alias("p"))
        listed = sims.groupBy(id_col).agg(F.sort_array(F.collect_list(clipped)).alias("_p"), F.sum(clipped["p"]).alias("_t"))  # one entry per topic
        share = F.transform("_p", lambda e: F.coalesce(e["p"] / F.nullif(F.col("_t"), F.lit(0.0)), F.lit(0.0)))
        return listed.select(id_col, F.col("_p.topic").alias("topics"), share.alias("probabilities"))
    ids, m = blocks[0]
    arrow_kind = to_arrow_type(topics.schema[topic_col].dataType)

    def score(batches):
        import pyarrow as pa

        names, n = pa.array(ids, arrow_kind), len(ids)
        for batch in batches:
            for start, sim in _strips(batch, vector, m):
                p = _shares(sim)[0]
                offsets = pa.array(np.arange(0, n * len(p) + 1, n, dtype=np.int32))
                every = pa.ListArray.from_arrays(offsets, names.take(pa.array(np.tile(np.arange(n), len(p)))))
                columns = [batch.column(id_col).slice(start, len(p)), every, pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "topics", "probabilities"])

    schema = f"`{id_col}` {_type(rows, id_col)}, topics array<{kind}>, probabilities array<double>"
    return rows.select(id_col, vector).mapInArrow(score, schema)


def _shares(sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarities clipped at 0 and scaled to sum 1, and the sums."""
    p = np.maximum(sim, 0.0)
    total = p.sum(axis=1, keepdims=True)
    return np.divide(p, total, out=np.zeros_like(p), where=total > 0), total


def top_probabilities(
    rows: DataFrame, topics: DataFrame, k: int | None, id_col: str = "doc_id", vector: str = "embedding",
    topic_col: str = "topic", topic_vector: str = "vector", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, rank, topic, probability`` of the ``k`` most probable topics, or all; probabilities count all topics.

    A block of topics gives each document one row: its best ``k`` similarities
    and the sum of all. Blocks are merged by id.
    """
    best = "array<struct<similarity: double, topic: {}>>".format(_type(topics, topic_col))
    schema = f"`{id_col}` {_type(rows, id_col)}, _best {best}, _total double"
    kind = to_arrow_type(topics.schema[topic_col].dataType)
    slim, parts = rows.select(id_col, vector), []
    for ids, m in _blocks(topics, topic_col, topic_vector, block_bytes):

        def score(batches, ids=ids, m=m):
            import pyarrow as pa

            names, n = pa.array(ids, kind), len(ids) if k is None else min(k, len(ids))
            for batch in batches:
                for start, sim in _strips(batch, vector, m):
                    sim = np.maximum(sim, 0.0)
                    chosen = _first(sim, n)
                    pairs = pa.StructArray.from_arrays([pa.array(np.take_along_axis(sim, chosen, axis=1).ravel()), names.take(pa.array(chosen.ravel()))], ["similarity", "topic"])
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(sim) + 1, n, dtype=np.int32)), pairs)
                    yield pa.RecordBatch.from_arrays([batch.column(id_col).slice(start, len(sim)), listed, pa.array(sim.sum(axis=1))], [id_col, "_best", "_total"])

        parts.append(slim.mapInArrow(score, schema))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"`{id_col}` {_type(rows, id_col)}, rank bigint, topic {_type(topics, topic_col)}, probability double")
    merged = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            merged = merged.unionByName(p)
        order = lambda x, y: F.when((x["similarity"] > y["similarity"]) | ((x["similarity"] == y["similarity"]) & (x["topic"] < y["topic"])), -1).otherwise(1)
        lists = F.array_sort(F.flatten(F.collect_list("_best")), order)  # k entries per block
        lists = lists if k is None else F.slice(lists, 1, k)
        merged = merged.groupBy(id_col).agg(lists.alias("_best"), F.sum("_total").alias("_total"))
    each = merged.select(id_col, "_total", F.posexplode("_best").alias("_at", "_e"))
    share = F.coalesce(F.col("_e.similarity") / F.nullif(F.col("_total"), F.lit(0.0)), F.lit(0.0))
    return each.select(id_col, (F.col("_at") + 1).cast("long").alias("rank"), F.col("_e.topic").alias("topic"), share.alias("probability"))


def similarity_histogram(assigned: DataFrame, bins: int = FLOOR_BINS) -> DataFrame:
    """``topic, bin, n``: similarities counted in ``bins`` steps per unit.

    A topic of any size is at most ``2 * bins`` rows, and histograms of
    several models add up.
    """
    counted = assigned.groupBy("topic", F.floor(F.col("similarity") * bins).alias("bin"))
    return counted.agg(F.count(F.lit(1)).alias("n"))


def floors_of(histogram: DataFrame, quantile: float = 0.05, bins: int = FLOOR_BINS) -> DataFrame:
    """``topic, floor``: lower edge of the bin that holds each topic's quantile."""
    running = F.sum("n").over(Window.partitionBy("topic").orderBy("bin"))
    total = F.sum("n").over(Window.partitionBy("topic"))
    reached = histogram.withColumn("_r", running).withColumn("_t", total).filter(F.col("_r") >= F.col("_t") * quantile)
    return reached.groupBy("topic").agg((F.min("bin") / bins).alias("floor"))


def similarity_floor(assigned: DataFrame, quantile: float = 0.05, bins: int = FLOOR_BINS) -> DataFrame:
    return floors_of(similarity_histogram(assigned, bins), quantile, bins)


def assign(
    rows: DataFrame, topics: DataFrame, floors: DataFrame | None = None, id_col: str = "doc_id",
    vector: str = "embedding", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``id, topic, similarity``: the most similar topic, or -1 below that topic's floor.

    ``floors`` has one row per topic.
    """
    if topics.isEmpty():  # nothing but outliers
        return rows.select(id_col, F.lit(-1).alias("topic"), F.lit(None).cast("double").alias("similarity"))
    best = similarities(rows, topics, id_col, vector, top=1, block_bytes=block_bytes)
    if floors is None:
        return best
    from .joins import salted_join

    joined = salted_join(best, floors, ["topic"], "left", [id_col])
    below = F.coalesce(F.col("similarity") < F.col("floor"), F.lit(False))
    return joined.select(id_col, F.when(below, F.lit(-1)).otherwise(F.col("topic")).alias("topic"), "similarity")
