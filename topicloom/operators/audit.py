"""Counts and descriptives of a corpus. Everything is one pre-aggregated pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .filters import is_placeholder, mentions_removal
from .joins import salted_join


def word_ranges(c: Column) -> dict[str, Column]:
    """Word-count ranges of the report."""
    return {
        "less_than_10": c < 10,
        "10_to_49": (c >= 10) & (c < 50),
        "50_to_99": (c >= 50) & (c < 100),
        "100_to_199": (c >= 100) & (c < 200),
        "200_or_more": c >= 200,
    }


def score_ranges(c: Column) -> dict[str, Column]:
    """Score ranges of the report; they overlap."""
    return {
        "less_than_0": c < 0,
        "equal_0": c == 0,
        "1_plus": c > 0,
        "5_plus": c >= 5,
        "10_plus": c >= 10,
        "20_plus": c >= 20,
    }


def _long(one_row: DataFrame, key: str, value: str) -> DataFrame:
    return one_row.unpivot([], one_row.columns, key, value)


def range_counts(df: DataFrame, ranges: dict[str, Column]) -> DataFrame:
    return _long(df.agg(*[F.count_if(cond).alias(name) for name, cond in ranges.items()]), "range", "count")


def group_means(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def histogram(df: DataFrame, value: str, bins: int = 50, group: str | None = None, id_col: str | None = None) -> DataFrame:
    """Equal-width bins between minimum and maximum: ``bin, bin_start, bin_end, count``.

    With ``group`` each group has its own range. Empty bins are not listed.
    """
    rows = df.filter(F.col(value).isNotNull())
    keys = [group] if group else []
    bounds = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    # values are put into bins where they are read: only counts of bins are shuffled,
    # and the rows themselves only if there are too many groups to broadcast
    if group:
        placed = salted_join(rows.select(group, value), bounds, keys, "inner", [value])
    else:
        ends = bounds.first()  # one row
        placed = rows.select(value, F.lit(ends["_lo"]).alias("_lo"), F.lit(ends["_hi"]).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) * bins / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))))
    )
    return (
        placed.withColumn("bin", place.cast("long"))
        .groupBy(*keys, "bin", "_lo", "_hi")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(
            *keys,
            "bin",
            (F.col("_lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("_lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            "count",
        )
    )


def density_curve(hist: DataFrame, group: str | None = None, points: int = 200) -> DataFrame:
    """Gaussian density over an even grid from a histogram's bins (Scott bandwidth)."""
    keys = [group] if group else ["_all"]
    h = hist if group else hist.withColumn("_all", F.lit(0))
    h = h.withColumn("_mid", (F.col("bin_start") + F.col("bin_end")) / 2)
    n = F.sum("count")
    mean = F.sum(F.col("count") * F.col("_mid")) / n
    var = F.sum(F.col("count") * F.col("_mid") * F.col("_mid")) / n - mean * mean
    stats = h.groupBy(*keys).agg(
        n.alias("_n"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("_sd"),
        F.min("bin_start").alias("_lo"), F.max("bin_end").alias("_hi"),
    ).filter(F.col("_sd") > 0)
    bw = F.col("_sd") * F.pow(F.col("_n"), F.lit(-0.2))
    grid = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    x = F.col("_lo") + F.col("point") * (F.col("_hi") - F.col("_lo")) / (points - 1)
    kernel = F.col("count") * F.exp(-0.5 * F.pow((F.col("x") - F.col("_mid")) / bw, F.lit(2)))
    out = (
        h.join(stats, keys)
        .withColumn("point", grid)
        .withColumn("x", x)
        .withColumn("_k", kernel / (F.col("_n") * bw * F.sqrt(F.lit(2 * 3.141592653589793))))
        .groupBy(*keys, "point", "x")
        .agg(F.sum("_k").alias("density"))
    )
    return out if group else out.drop("_all")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def quality_checks(df: DataFrame, column: str = "text") -> DataFrame:
    """Rows, texts that mention deletion, null texts and blank texts."""
    is_text = df.schema[column].dataType.simpleString() == "string"
    c = F.col(column)
    return _long(
        df.agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(mentions_removal(column)).alias("deleted_or_removed"),
            F.count_if(c.isNull()).alias("null_text"),
            F.count_if(c.isNull() if is_text else F.lit(True)).alias("non_string_text"),
            F.count_if(T.is_blank(c.cast("string"))).alias("blank_text"),
        ),
        "check",
        "count",
    )


def reconcile(original: DataFrame, kept: DataFrame, columns: Sequence[str], text: str = "text") -> DataFrame:
    """Did the placeholder rule remove what it should: one row of counts."""
    present = [c for c in columns if c in original.columns]
    a = original.agg(F.count(F.lit(1)).alias("original"), F.count_if(is_placeholder(present)).alias("identified"))
    b = kept.agg(F.count(F.lit(1)).alias("kept"), F.count_if(is_placeholder([text])).alias("missed"))
    one = F.lit(1).alias("_one")
    both = a.select("*", one).join(b.select("*", one), "_one")
    return both.select("original", "kept", "identified", "missed", (F.col("original") - F.col("identified")).alias("expected"))


def step_counts(removed: DataFrame) -> DataFrame:
    return removed.groupBy("stage", "reason").agg(F.count(F.lit(1)).alias("rows"))


def trimmed_reason(score: str | None, score_min: float | None, text: str | None, length_min: int | None) -> Column:
    """Why a row misses the score or length minimum; null if it does not.

    A null score is neither below nor above a bound; it has its own reason.
    """
    reason = F.lit(None).cast("string")
    checks = []
    if score and score_min is not None:
        checks += [(F.col(score).isNull(), "score_null"), (F.col(score) < score_min, "score_below")]
    if text and length_min is not None:
        checks += [(F.char_length(F.coalesce(F.col(text), F.lit(""))) < length_min, "too_short")]
    for cond, name in reversed(checks):
        reason = F.when(cond, F.lit(name)).otherwise(reason)
    return reason


def trimmed_rows(df: DataFrame, score: str | None, score_min: float | None, text: str | None, length_min: int | None) -> DataFrame:
    return df.withColumn("reason", trimmed_reason(score, score_min, text, length_min)).filter(F.col("reason").isNotNull())


def column_summary(df: DataFrame) -> DataFrame:
    """``column, type, non_null, rows`` for every column."""
    counts = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                    F.count(F.col(f"`{f.name}`")).alias("non_null"),
                    F.count(F.lit(1)).alias("rows"),
                )
                for f in df.schema
            ]
        ).alias("s")
    )
    return counts.select(F.explode("s").alias("s")).select("s.*")


def coordinate_bounds(df: DataFrame, x: str = "x", y: str = "y", margin: float = 1.0) -> DataFrame:
    return df.agg(
        (F.min(x) - margin).alias("x_lo"), (F.max(x) + margin).alias("x_hi"),
        (F.min(y) - margin).alias("y_lo"), (F.max(y) + margin).alias("y_hi"),
    )
