"""Exact-copy handling. Groups of copies may be of any size.

Copies are found by a SHA-256 digest, so only 32 bytes per row take part in
grouping, and group results are aggregated before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import salted_join
from .sampling import top_n


def digest(column: str) -> Column:
    """Digest of a column's text; null has a digest of its own, as nulls are equal here."""
    return F.coalesce(F.unhex(F.sha2(F.col(column).cast("string"), 256)), F.lit(b""))


def dedupe_first(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """One row per distinct value: the first by ``order`` (unique)."""
    keyed = df.withColumn("_key", digest(column))
    return top_n(keyed, "_key", [F.col(c) for c in order], 1).drop("_key")


def flag_later_copies(df: DataFrame, key: str, id_col: str, among: Column, name: str = "is_copy") -> DataFrame:
    """Mark rows that repeat an earlier row's ``key`` (a digest), among the rows given.

    The first id of every key comes from a pre-aggregated grouping, and is
    joined back on the unique id, never on the key.
    """
    first = df.filter(among).groupBy(key).agg(F.min(id_col).alias(id_col)).select(id_col, F.lit(True).alias("_first"))
    flagged = df.join(first, id_col, "left")
    return flagged.withColumn(name, F.col("_first").isNull() & among).drop("_first")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(digest(column).alias("_key")).agg(F.count(F.lit(1)).alias("copies"))


def split_repeated(df: DataFrame, column: str, id_col: str, more_than: int = 2) -> tuple[DataFrame, DataFrame]:
    """Rows to keep, and all copies of values seen more than ``more_than`` times."""
    keyed = df.withColumn("_key", digest(column))
    repeated = value_counts(df, column).filter(F.col("copies") > more_than)
    kept = salted_join(keyed, repeated.select("_key"), ["_key"], "left_anti", [id_col])
    gone = salted_join(keyed, repeated, ["_key"], "inner", [id_col])
    return kept.drop("_key"), gone.drop("_key")
