"""Row filters, and the column choices that go with them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import text as T
from .joins import salted_join, semi_rows

OPERATORS = {
    "==": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "in": lambda c, v: c.isin(list(v)),
    "between": lambda c, v: c.between(*v),
    "contains": lambda c, v: c.contains(v),
}


def keep_existing(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    return df.select([c for c in wanted if c in df.columns])


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def comment_text(body: str = "body", null_as_empty: bool = False) -> Column:
    return F.coalesce(F.col(body), F.lit("")) if null_as_empty else F.col(body)


def submission_text(title: str = "title", selftext: str = "selftext", strip: bool = True) -> Column:
    joined = T.join_with_token([title, selftext])
    return T.strip_ws(joined) if strip else joined


def merged_text(columns: Sequence[str]) -> Column:
    """Non-null parts joined by a space and stripped."""
    return T.strip_ws(T.join_nonnull(columns))


def has_required(columns: Sequence[str]) -> Column:
    ok = F.lit(True)
    for c in columns:
        ok = ok & ~T.is_blank(F.col(c).cast("string"))
    return ok


def split_required(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with all required columns filled, and the removed ones."""
    ok = has_required(columns)
    return df.filter(ok), df.filter(~ok)


def drop_blank(df: DataFrame, column: str = "docs") -> DataFrame:
    return df.filter(~T.is_blank(column))


def length_ok(length: Column, lo: int | None, hi: int | None) -> Column:
    ok = F.lit(True)
    if lo is not None:
        ok = ok & (length >= lo)
    if hi is not None:
        ok = ok & (length <= hi)
    return ok


def word_count_filter(df: DataFrame, lo: int | None, hi: int | None, column: str = "docs") -> DataFrame:
    return df.withColumn("doc_len", T.word_count(column)).filter(length_ok(F.col("doc_len"), lo, hi))


def char_length_filter(df: DataFrame, column: str = "text", minimum: int = 10) -> DataFrame:
    return df.filter(F.char_length(column) >= minimum)


def score_ok(column: str | None, lo: float | None, hi: float | None) -> Column:
    """Inclusive bounds, either optional; a null score fails a given bound."""
    if not column or (lo is None and hi is None):
        return F.lit(True)
    return F.coalesce(length_ok(F.col(column), lo, hi), F.lit(False))


def score_range(df: DataFrame, column: str | None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    if not column or (lo is None and hi is None):
        return df
    return df.filter(length_ok(F.col(column), lo, hi))  # bare comparisons, so they reach the scan


def metadata_filter(df: DataFrame, conditions: Sequence[tuple[str, str, Any]]) -> DataFrame:
    """All of ``(column, operator, value)``; other operators raise."""
    for column, op, value in conditions:
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}, use one of {sorted(OPERATORS)}")
        if column not in df.columns:
            raise ValueError(f"no column {column!r}")
        df = df.filter(OPERATORS[op](F.col(column), value))
    return df


def is_placeholder(columns: Sequence[str]) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | T.contains_pattern(c, T.PLACEHOLDER)
    return hit


def drop_placeholders(df: DataFrame, columns: Sequence[str] = ("body", "title", "selftext")) -> DataFrame:
    return df.filter(~is_placeholder([c for c in columns if c in df.columns]))


def mentions_removal(column: str = "text") -> Column:
    return T.contains_pattern(column, T.PLACEHOLDER_LOOSE)


def topic_members(df: DataFrame, topics: Sequence[Any], topic_col: str = "topic", id_col: str = "doc_id") -> DataFrame:
    """Rows of the listed topics, of any number and of the column's type."""
    kind = T_.StructType([T_.StructField(topic_col, df.schema[topic_col].dataType)])
    wanted = df.sparkSession.createDataFrame([(t,) for t in topics], kind)
    return semi_rows(df, wanted, topic_col, [id_col])


def drop_outliers(df: DataFrame, topic_col: str = "topic") -> DataFrame:
    return df.filter(F.col(topic_col) != -1)


def only_outliers(df: DataFrame, topic_col: str = "topic") -> DataFrame:
    return df.filter(F.col(topic_col) == -1)


def inside_box(df: DataFrame, bound: float = 10.0, x: str = "x", y: str = "y") -> DataFrame:
    """Strictly inside the square of half-width ``bound``."""
    return df.filter((F.abs(F.col(x)) < bound) & (F.abs(F.col(y)) < bound))


def record_type(title: str = "title") -> Column:
    return F.when(F.col(title).isNull(), F.lit("comment")).otherwise(F.lit("submission"))


def with_topic_label(df: DataFrame, labels: DataFrame, topic_col: str = "topic", id_col: str = "doc_id") -> DataFrame:
    """Topic label per row from ``(topic, label)``; an unknown topic gives ``No Topic``."""
    joined = salted_join(df, labels.select(topic_col, "label"), [topic_col], "left", [id_col])
    return joined.withColumn("label", F.coalesce(F.col("label"), F.lit("No Topic")))


def date_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """``start <= column < end``; bare comparisons, so they reach the scan."""
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start).cast(df.schema[column].dataType))
    if end is not None:
        df = df.filter(F.col(column) < F.lit(end).cast(df.schema[column].dataType))
    return df


def arrange(df: DataFrame, first: Sequence[str], drop: Sequence[str] = (), as_string: Sequence[str] = ()) -> DataFrame:
    """Chosen columns first, the rest after; some dropped, some cast to string."""
    rest = [c for c in df.columns if c not in first and c not in drop]
    return df.select([F.col(c).cast("string").alias(c) if c in as_string else F.col(c) for c in [*first, *rest]])
