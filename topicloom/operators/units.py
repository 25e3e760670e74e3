"""Documents, paragraphs or sentences as rows ``doc_id, unit_id, unit_type, text``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# A full stop after these does not end a sentence.
ABBREVIATIONS = ("Dr", "Mr", "Mrs", "Ms", "Prof", "St", "Sr", "Jr", "vs", "etc", "e.g", "i.e", "cf", "al", "Fig", "No")


def _rows(df: DataFrame, id_col: str, pieces: Column, kind: str, carry: Sequence[str]) -> DataFrame:
    pieces = F.filter(F.transform(pieces, lambda p: T.strip_ws(p)), lambda p: p != "")
    return df.select(
        F.col(id_col).cast("string").alias("doc_id"), *carry, F.posexplode(pieces).alias("unit_id", "text")
    ).select("doc_id", *carry, F.col("unit_id").cast("long"), F.lit(kind).alias("unit_type"), "text")


def document_units(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    return df.select(
        F.col(id_col).cast("string").alias("doc_id"),
        *carry,
        F.lit(0).cast("long").alias("unit_id"),
        F.lit("document").alias("unit_type"),
        F.col(text_col).alias("text"),
    )


def sentence_units(
    df: DataFrame, id_col: str, text_col: str, abbreviations: Sequence[str] = ABBREVIATIONS, carry: Sequence[str] = ()
) -> DataFrame:
    """Split after ``.``, ``!`` or ``?`` and whitespace, except after an abbreviation."""
    pattern = "(?<=[.!?])"
    if abbreviations:
        words = "|".join(a.replace(".", r"\.") for a in abbreviations)
        pattern += rf"(?<!\b(?:{words})\.)"
    return _rows(df, id_col, F.split(F.col(text_col), f"{pattern}[{T.WS}]+"), "sentence", carry)


def paragraph_units(df: DataFrame, id_col: str, text_col: str, carry: Sequence[str] = ()) -> DataFrame:
    """Split at blank lines. Use on raw text: the cleaner removes line ends."""
    return _rows(df, id_col, F.split(F.col(text_col), r"\n\s*\n"), "paragraph", carry)


UNIT_TYPES = {"document": document_units, "sentence": sentence_units, "paragraph": paragraph_units}


def text_units(df: DataFrame, id_col: str, text_col: str, unit_type: str = "document") -> DataFrame:
    if unit_type not in UNIT_TYPES:
        raise ValueError(f"unknown unit type {unit_type!r}, use one of {sorted(UNIT_TYPES)}")
    return UNIT_TYPES[unit_type](df, id_col, text_col)


def with_unit_key(units: DataFrame) -> DataFrame:
    """Units with ``unit``, the key of a model over units: struct of doc_id and unit_id."""
    return units.withColumn("unit", F.struct("doc_id", "unit_id"))


def topic_shares(assigned: DataFrame, unit: str = "unit") -> DataFrame:
    """``doc_id, n_units, shares`` from the topics of units: shares is an array of (topic, n, share) by topic.

    Only topics that a document has are listed. Units are counted by document
    and topic before the shuffle, so a long document sends one row per topic.
    """
    counted = assigned.groupBy(F.col(f"{unit}.doc_id").alias("doc_id"), "topic").agg(F.count(F.lit(1)).alias("n"))
    listed = counted.groupBy("doc_id").agg(F.sum("n").alias("n_units"), F.sort_array(F.collect_list(F.struct("topic", "n"))).alias("_topics"))
    share = F.transform("_topics", lambda t: F.struct(t["topic"].alias("topic"), t["n"].alias("n"), (t["n"] / F.col("n_units")).alias("share")))
    return listed.select("doc_id", "n_units", share.alias("shares"))
