"""Stage tables, run records and reports."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..config import to_json
from ..functions import tokens as K
from ..operators.terms import representations

log = logging.getLogger(__name__)


def save_vectors(df: DataFrame, path: str, id_col: str = "doc_id", vector: str = "embedding") -> None:
    df.select(id_col, vector).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _readable(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        df = spark.read.parquet(path)
        df.limit(1).count()
        return df
    except AnalysisException:
        return None
    except Exception as e:
        log.warning("stage table %s cannot be read (%s); it is computed again", path, type(e).__name__)
        return None


def cached(spark: SparkSession, path: str, compute: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The stage table at ``path``; computed and written if missing, unreadable or forced."""
    found = None if force else _readable(spark, path)
    if found is None:
        compute().write.mode("overwrite").parquet(path)
        found = spark.read.parquet(path)
    return found


def effective_config(base: dict[str, Any] | None, **overrides: Any) -> dict[str, Any]:
    return {**(base or {}), **overrides}


def read_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON settings file on any file system; an empty file gives no settings."""
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0].value) if rows and rows[0].value.strip() else {}


def record_run(spark: SparkSession, path: str, run_name: str, config: Any, format: str = "json") -> None:
    """Append ``run_name, ts, config`` of a run. Formats: json or parquet."""
    if format not in ("json", "parquet"):
        raise ValueError(f"unsupported format {format!r}, use 'json' or 'parquet'")
    row = spark.createDataFrame([(run_name, to_json(config))], "run_name string, config string")
    row.select("run_name", F.current_timestamp().alias("ts"), "config").write.mode("append").format(format).save(path)


def write_report(sheets: dict[str, DataFrame], folder: str, format: str = "parquet") -> None:
    """One dataset per sheet below one report folder."""
    for name, df in sheets.items():
        writer = df.write.mode("overwrite").format(format)
        (writer.option("header", True).option("escape", '"') if format == "csv" else writer).save(f"{folder}/{name}")


def read_report(spark: SparkSession, folder: str, sheet: str, format: str = "parquet") -> DataFrame:
    reader = spark.read.format(format)
    if format == "csv":
        reader = reader.option("header", True).option("escape", '"').option("multiLine", True)
    return reader.load(f"{folder}/{sheet}")


def report_lines(words: DataFrame, frequency: DataFrame, info: DataFrame, representative: DataFrame) -> DataFrame:
    """``section, topic, ord, line`` of the text report; the first three give its order.

    ``representative`` is ``topic, rank, document``.
    """

    def section(number: int, title: str, body: DataFrame) -> DataFrame:
        head = body.sparkSession.range(1).select(F.lit(-2).alias("topic"), F.lit(0).alias("ord"), F.lit(f"{title}:").alias("line"))
        return head.unionByName(body.select(F.col("topic").cast("int"), F.col("ord").cast("int"), "line")).select(F.lit(number).alias("section"), "topic", "ord", "line")

    topic = F.col("topic").cast("string")
    listed = F.array_join(F.transform("pairs", lambda p: p["word"]), ", ")
    topics = representations(words).select("topic", F.lit(0).alias("ord"), F.concat(F.lit("Topic "), topic, F.lit(": "), listed).alias("line"))
    by_size = Window.partitionBy(F.lit(1)).orderBy(F.desc("count"), "topic")  # one row per topic
    counts = frequency.select(
        F.lit(0).alias("topic"), F.row_number().over(by_size).alias("ord"),
        F.concat(F.lit("Topic "), topic, F.lit(": "), F.col("count").cast("string"), F.lit(" entries")).alias("line"),
    )
    lines = F.concat(
        F.array(F.concat(F.lit("Topic "), topic), F.concat(F.lit(" - Name: "), "name"), F.lit(" - Representation:")),
        F.transform("representation", lambda w: F.concat(F.lit("   * "), w)),
    )
    details = info.select("topic", F.posexplode(lines).alias("ord", "line"))
    docs = representative.select("topic", F.col("rank").alias("ord"), F.concat(F.lit(" - "), "document").alias("line"))
    titles = representative.select("topic").distinct().select("topic", F.lit(0).alias("ord"), F.concat(F.lit("Topic "), topic, F.lit(" representative docs:")).alias("line"))
    return (
        section(1, "TOPICS", topics)
        .unionByName(section(2, "TOPIC FREQUENCY", counts))
        .unionByName(section(3, "TOPIC INFO", details))
        .unionByName(section(4, "REPRESENTATIVE DOCS", docs.unionByName(titles)))
    )


def search_lines(hits: DataFrame, words: DataFrame, representative: DataFrame) -> DataFrame:
    """``section, topic, ord, line``: hits per term, then details per topic in topic order."""
    title = hits.select("pos", "term").distinct().select(
        F.lit(1).alias("section"), F.col("pos").cast("int").alias("topic"), F.lit(0).alias("ord"),
        F.format_string("Searching for topics related to: '%s'", "term").alias("line"))
    order = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("similarity"), "topic"))
    found = hits.select(
        F.lit(1).alias("section"), F.col("pos").cast("int").alias("topic"), order.alias("ord"),
        F.format_string("Topic %d (Similarity: %.4f)", F.col("topic").cast("int"), "similarity").alias("line"))
    wanted = hits.select("topic").distinct()
    detail = representations(words.join(wanted, "topic", "left_semi")).select(
        F.lit(2).alias("section"), F.col("topic").cast("int").alias("topic"), F.lit(0).alias("ord"),
        F.format_string("Topic %d Details: %s", F.col("topic").cast("int"), K.words_with_weights(F.col("pairs"), 4)).alias("line"))
    docs = representative.join(wanted, "topic", "left_semi").select(
        F.lit(2).alias("section"), F.col("topic").cast("int").alias("topic"), F.col("rank").cast("int").alias("ord"), F.col("document").alias("line"))
    return title.unionByName(found).unionByName(detail).unionByName(docs)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("section", "topic", "ord").select("line").write.mode("overwrite").text(path)
