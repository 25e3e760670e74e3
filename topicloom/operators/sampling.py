"""Row numbers, halves, samples and top-n per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def top_n(df: DataFrame, group: Sequence[str] | str, order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each group.

    Spark trims every group to ``n`` rows on the map side before the shuffle,
    so a group that holds most of the rows sends few of them.
    """
    group = [group] if isinstance(group, str) else list(group)
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def sample_per_group(df: DataFrame, group: str, id_col: str, n: int = 200, seed: int = 42) -> DataFrame:
    """At most ``n`` random rows per group, repeatable for a seed."""
    return top_n(df, group, [F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)], n)


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), F.col(id_col)).limit(n)


def head(df: DataFrame, order: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def with_row_number(df: DataFrame, order: str, name: str = "row_number", start: int = 0) -> DataFrame:
    """Consecutive numbers by a unique order column, without a one-task window.

    The order column alone is range-partitioned and written once; per-part
    counts (one row per part) give each part its offset.
    """
    ids = materialize(df.select(order).repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ids.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    within = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    numbered = (
        ids.withColumn("_within", within)
        .join(F.broadcast(offsets), "_part")  # one row per shuffle partition
        .select(order, (F.col("_offset") + F.col("_within") - 1 + start).cast("long").alias(name))
    )
    return numbered if df.columns == [order] else df.join(numbered, order)


def ensure_id(df: DataFrame, name: str = "id") -> DataFrame:
    """The rows with an id column; if there is none, consecutive numbers from 0.

    Rows without an id have no order to repeat, so the numbers are written once.
    """
    if name in df.columns:
        return df
    seated = materialize(df.withColumn("_seat", F.monotonically_increasing_id()))
    return with_row_number(seated, "_seat", name).drop("_seat")


def split_halves(df: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """First floor(n/2) rows by the unique order column, and the rest."""
    numbered = with_row_number(df.select(order), order, "_rn")
    n = df.count()
    if n < 2:
        return df.limit(0), df
    cut = numbered.filter(F.col("_rn") == n // 2).first()[order]
    return df.filter(F.col(order) < F.lit(cut)), df.filter(F.col(order) >= F.lit(cut))
