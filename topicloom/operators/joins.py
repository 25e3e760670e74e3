"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    spread: Sequence[str] = (),
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join where ``left`` may have hot keys and ``right`` is keyed uniquely.

    Each left row draws a salt from a hash of its ``spread`` columns, each
    right row is repeated once per salt, so a hot key is shared by ``salts``
    tasks. The salt is a function of the row, hence stable under task retries.
    Valid for inner, left, left_semi and left_anti.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"salted_join does not support {how!r}")
    spread = list(spread) or [c for c in left.columns if c not in keys]
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return a.join(b, [*keys, "_salt"], how).drop("_salt")


def left_metadata(rows: DataFrame, meta: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (e.g. sentences) with the chosen columns of their parent; none are lost.

    A parent has few rows, so its key needs no salt; adaptive execution splits
    what skew there is.
    """
    if columns is not None:
        meta = meta.select(key, *[c for c in columns if c != key])
    return rows.join(meta, key, "left")


def anti_rows(all_rows: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """Rows of ``all_rows`` whose (unique) key is not among ``kept``."""
    return all_rows.join(kept.select(key), key, "left_anti")


def semi_rows(rows: DataFrame, wanted: DataFrame, key: str, spread: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is in a list of any length."""
    return salted_join(rows, wanted.select(key).distinct(), [key], "left_semi", spread)


def coverage(docs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """One row: keys on one side only, by key and not just by count."""
    there, absent = F.lit(1), F.lit(None).cast("int")
    both = docs.select(F.col(key).alias("_key"), there.alias("_d"), absent.alias("_v"))
    both = both.unionByName(vectors.select(F.col(key).alias("_key"), absent.alias("_d"), there.alias("_v")))
    each = both.groupBy("_key").agg(F.max("_d").alias("_d"), F.max("_v").alias("_v"))
    alone = lambda c: F.col(c).isNull() | F.col("_key").isNull()  # noqa: E731  a null key equals none
    return each.agg(
        F.count_if(F.col("_d").isNotNull() & alone("_v")).alias("docs_without_vector"),
        F.count_if(F.col("_v").isNotNull() & alone("_d")).alias("vectors_without_doc"),
    )


def require_complete(docs: DataFrame, vectors: DataFrame, key: str) -> None:
    """Raise when documents and vectors do not cover each other."""
    row = coverage(docs, vectors, key).first()
    if row.docs_without_vector or row.vectors_without_doc:
        raise ValueError(
            f"documents and vectors do not match: {row.docs_without_vector} documents without "
            f"vector, {row.vectors_without_doc} vectors without document"
        )


def side_by_side(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """Positional join by rank of each side's unique order column.

    A different number of rows is an error, never padding.
    """
    from .sampling import with_row_number

    a = with_row_number(left, left_order, "_pos")
    b = with_row_number(right, right_order, "_pos")
    n, m = a.count(), b.count()
    if n != m:
        raise ValueError(f"positional join needs equal row counts, got {n} and {m}")
    if left_order == right_order:
        b = b.drop(right_order)
    return a.join(b, "_pos").drop("_pos")
