"""Sharding by sampled splitters: shards of near equal bytes.

Records are ordered by a key (a hash of the text, then of id and text). A
sample of keys, drawn with chances proportional to the bytes behind a key,
gives quantile boundaries; records are dealt to the ranges between them, and a
range with too many bytes is subdivided. Exact byte and row sums of the parts
give every record its place in the whole order, and shards are equal stretches
of bytes of that order. Equal texts share a shard unless a boundary of shards falls
between them or their range holds too many bytes and is subdivided.

Nulls: a null text has no bytes and crc32 0; null ids are allowed. Repeated
rows are each given a slot; ties of the key go by the place of the row as read. An empty table gives an empty result. Shards of a
table with few records may stay empty. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, unit_interval

OVERHEAD = 16
KEY = ("_text", "_record")


def splitters(keyed: DataFrame, total: int, ranges: int, sample: int, seed: int) -> list[tuple[int, int]]:
    """Boundaries at the weighted quantiles of a size-weighted sample of keys.

    Sizes are summed by key first, so many equal records are one candidate.
    ``sample`` bounds the expected number of drawn keys, at any table size.
    """
    chance = F.col("bytes") * F.lit(sample / max(total, 1))
    drawn = (
        keyed.groupBy(*KEY).agg(F.sum("size").alias("bytes"))
        .withColumn("weight", F.greatest(chance, F.lit(1.0)))
        .filter(unit_interval(F.col(KEY[0]), F.col(KEY[1]), seed) < chance)
    )
    rows = sorted((r[0], r[1], r[2]) for r in drawn.select(*KEY, "weight").collect())  # about `sample` keys
    step = sum(r[2] for r in rows) / ranges
    out, run = [], 0.0
    for a, b, w in rows:
        if int((run + w) / step) > int(run / step):
            out.append((a, b))
        run += w
    return sorted(set(out))[: ranges - 1]


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or below the record's key, by halving steps over two literal arrays."""
    if not bounds:
        return F.lit(0)
    first, second = (F.lit(np.array(column, dtype=np.int64)) for column in zip(*bounds))

    def further(low: Column, step: Column) -> Column:
        a, b = F.get(first, low + step - 1), F.get(second, low + step - 1)  # null beyond the last boundary
        at_or_below = (a < F.col(KEY[0])) | ((a == F.col(KEY[0])) & (b <= F.col(KEY[1])))
        return F.when(at_or_below, low + step).otherwise(low)

    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), further)


def shard(
    docs: DataFrame, shards: int = 40, ranges: int = 256, sample: int = 4096, part_bytes: int = 64 << 20, seed: int = 42
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every record of ``docs`` (doc_id, text)."""
    keyed = stage(
        docs.select(
            "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
            F.xxhash64("text").alias(KEY[0]), F.xxhash64("doc_id", "text").alias(KEY[1]),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    total = keyed.agg(F.sum("size")).first()[0] or 0
    ranged = stage(keyed.withColumn("_range", range_of(splitters(keyed, total, ranges, sample, seed))))
    full = max(1, min(part_bytes, 2 * total // ranges))
    ways = ranged.groupBy("_range").agg(F.greatest(F.ceil(F.sum("size") / full), F.lit(1)).alias("_ways"))
    parts = (
        ranged.join(F.broadcast(ways), "_range")  # at most `ranges` rows
        .withColumn("_part", F.when(F.col("_ways") > 1, F.pmod(F.xxhash64(*KEY, "_row"), F.col("_ways"))).otherwise(0))
    )
    sums = parts.groupBy("_range", "_part").agg(F.sum("size").alias("_size"), F.count(F.lit(1)).alias("_rows"))
    in_range = Window.partitionBy("_range").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    over_ranges = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    by_range = sums.groupBy("_range").agg(F.sum("_size").alias("_s"), F.sum("_rows").alias("_n"))
    by_range = by_range.select("_range", *[F.coalesce(F.sum(c).over(over_ranges), F.lit(0)).alias(f"{c}0") for c in ("_s", "_n")])
    offsets = sums.select(
        "_range", "_part", *[F.coalesce(F.sum(c).over(in_range), F.lit(0)).alias(f"{c}1") for c in ("_size", "_rows")]
    ).join(F.broadcast(by_range), "_range")  # at most `ranges` rows
    offsets = offsets.select("_range", "_part", (F.col("_s0") + F.col("_size1")).alias("_bytes"), (F.col("_n0") + F.col("_rows1")).alias("_first"))
    within = Window.partitionBy("_range", "_part").orderBy(*KEY, "_row")
    placed = stage(
        parts.withColumn("_run", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_number", F.row_number().over(within) - 1)
        .join(offsets, ["_range", "_part"])
        .withColumn("_middle", F.col("_bytes") + F.col("_run") - F.col("size") / 2)
        .select(
            "doc_id", "size", "text_crc32", (F.col("_first") + F.col("_number")).alias("_place"),
            F.least(F.floor(F.col("_middle") * shards / max(total, 1)), F.lit(shards - 1)).cast("int").alias("shard"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_start"))
    return placed.join(F.broadcast(firsts), "shard").select(  # one row per shard
        "doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_start")).cast("long").alias("slot")
    )
