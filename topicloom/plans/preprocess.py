"""Raw rows to a processed corpus plus a removal log, as one flagged table.

Order of the rules is part of the result: required columns, empty after
cleaning, length, copies, score. A copy whose first occurrence fails the
score rule is therefore gone, even if it scores well itself.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Preprocessing
from ..functions import text as T
from ..operators.cleaning import clean_into, with_computed
from ..operators.dedupe import digest, flag_later_copies
from ..operators.filters import has_required, length_ok, score_ok
from ..operators.sampling import ensure_id
from ..session import materialize, scratch_path
from ..sources import files


def _reason(rules: list[tuple[Column, str, str]]) -> Column:
    """First failing rule as ``struct(stage, reason)``; null if all pass."""
    return F.coalesce(*[F.when(failed, F.struct(F.lit(s).alias("stage"), F.lit(r).alias("reason"))) for failed, s, r in rules])


def flag_rows(df: DataFrame, cfg: Preprocessing, hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Input columns + ``docs, doc_len, stage, reason``; ``reason`` is null for kept rows.

    ``hook`` is a dataset-specific DataFrame step that runs first.
    """
    if hook is not None:
        df = df.transform(hook)
    src, flt = cfg.source, cfg.filters
    carried = df.columns
    # text that fails the required rule is not cleaned at all
    raw = F.when(has_required(src.required_columns_for_docs_creation), T.join_with_token(src.text_source_columns, src.null_token))
    df = clean_into(df, raw, "_clean", cfg.cleaning, keep_null=True)
    length = T.word_count_collapsed("_clean")
    rules = [
        (F.col("_clean").isNull(), "required", "missing_required"),
        (F.col("_clean") == "", "cleaning", "empty_after_cleaning"),
    ]
    if flt.length_filter:
        lo, hi = flt.min_doc_length, flt.max_doc_length
        rules += [
            (~length_ok(F.col("_len"), lo, None), "length", "too_short"),
            (~length_ok(F.col("_len"), None, hi), "length", "too_long"),
        ]
    df = with_computed(df, "_len", length) if flt.length_filter else df
    df = df.withColumns({"docs": F.col("_clean"), "_why": _reason(rules)})
    if flt.duplicate_removal:
        # written once with its digest: the grouping then reads ids and digests
        # only, and no text is cleaned twice
        df = materialize(df.drop("_clean").withColumn("_key", digest(flt.column_for_duplicate_checking)))
        df = flag_later_copies(df, "_key", src.unique_id_column, F.col("_why").isNull(), "_copy")
        df = df.withColumn("_why", F.coalesce(F.col("_why"), _reason([(F.col("_copy"), "duplicate", "duplicate_text")])))
    if flt.score_filter:
        name, lo, hi = flt.score_column_for_filtering, flt.min_score_for_filtering, flt.max_score_for_filtering
        if name and (lo is not None or hi is not None):
            rules = [
                (F.col(name).isNull(), "score", "score_null"),
                (~score_ok(name, lo, hi), "score", "score_out_of_range"),
            ]
            df = df.withColumn("_why", F.coalesce(F.col("_why"), _reason(rules)))
    extra = [F.col("_len").alias("doc_len")] if flt.length_filter else []
    return df.select(*carried, "docs", *extra, F.col("_why.stage").alias("stage"), F.col("_why.reason").alias("reason"))


def kept_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("reason").isNull()).drop("stage", "reason")


def removed_rows(flagged: DataFrame) -> DataFrame:
    return flagged.filter(F.col("reason").isNotNull())


def write_flagged(flagged: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Write kept and removed rows in one pass; return both, read back."""
    spark = flagged.sparkSession
    part = F.when(F.col("reason").isNull(), "kept").otherwise("removed")
    flagged.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(path)
    table = spark.read.parquet(path)
    return kept_rows(table.filter("part = 'kept'")).drop("part"), table.filter("part = 'removed'").drop("part")


def survival_report(flagged: DataFrame, group: str) -> DataFrame:
    """Rows per group, stage and reason; kept rows have the reason ``kept``."""
    return flagged.groupBy(
        group, F.coalesce(F.col("stage"), F.lit("kept")).alias("stage"), F.coalesce(F.col("reason"), F.lit("kept")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("rows"))


def run(spark: SparkSession, config: dict[str, Any], hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A whole run by its nested settings: read, flag, write both outputs, return the kept rows.

    ``paths`` names ``raw_data_file`` (CSV, or a folder of Parquet files),
    ``processed_data_output_file`` and ``dropped_rows_output_file``. Outputs
    are CSV datasets; one without rows is not written.
    """
    cfg, paths = Preprocessing.from_dict(config), config["paths"]
    source = paths["raw_data_file"]
    if source.endswith(".csv"):
        parts = [r.path for r in files.list_files(spark, source).select("path").collect()]
        score = cfg.filters.score_column_for_filtering
        raw = files.read_csv(spark, parts, {**files.TYPES, **({score: "double"} if score else {})})
    else:
        raw = spark.read.parquet(source)
    raw = ensure_id(raw, cfg.source.unique_id_column)
    kept, removed = write_flagged(flag_rows(raw, cfg, hook), scratch_path(spark, "flagged"))
    for rows, name in ((kept, "processed_data_output_file"), (removed, "dropped_rows_output_file")):
        if paths.get(name) and not rows.isEmpty():
            files.write_csv(rows, paths[name])
    return kept
