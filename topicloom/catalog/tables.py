"""The given tables, and registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS
from ..session import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"), "doc_id")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a zoned timestamp."""
    return table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def with_plane(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Adds x and y: the sums of the first and of the second half of the coordinates."""
    half = F.floor(F.size(column) / 2).cast("int")
    v = F.col(column).cast("array<double>")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, c: s + c)
    return df.withColumns({"x": total(F.slice(v, F.lit(1), half)), "y": total(F.slice(v, half + 1, F.size(column) - half))})


# SQL fragments shared by the oracles
SQL_X = "list_sum(CAST(embedding[1 : len(embedding) // 2] AS DOUBLE[]))"
SQL_Y = "list_sum(CAST(embedding[len(embedding) // 2 + 1 :] AS DOUBLE[]))"
SQL_WS = f"[{WS}]"
SQL_CHARS = """'[^a-zA-Z0-9\\s,.!?'':;"-]'"""
SQL_SPLIT = "\\x{1}"


def sql_collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '[{WS}]+', ' ', 'g'))"


def sql_clean(e: str = "text") -> str:
    """Markdown links, character filter, lower case, whitespace."""
    linkless = f"regexp_replace({e}, '\\[([^\\]]+)\\]\\([^\\)]+\\)', '\\1', 'g')"
    return sql_collapse(f"lower(regexp_replace({linkless}, {SQL_CHARS}, ' ', 'g'))")


def sql_nonblank(e: str) -> str:
    return f"coalesce(regexp_matches({e}, '[^{WS}]'), false)"


def sql_words(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, '[^{WS}]+')) AS BIGINT)"


def sql_strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"
