"""CSV files and folders in; CSV and Parquet out."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import text as T
from ..operators.filters import comment_text, keep_existing, submission_text
from ..operators.joins import salted_join

# Cells that mean "missing".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Column sets of the forum files, and of the combined corpus.
COMMENT_COLUMNS = ("id", "link_id", "author", "created_utc", "subreddit", "body", "score")
SUBMISSION_COLUMNS = ("id", "permalink", "author", "created_utc", "subreddit", "title", "selftext", "score")
COMBINED_COLUMNS = ("id", "link_id", "author", "created_utc", "subreddit", "score", "text")
TYPES = {"score": "double", "created_utc": "bigint"}
CSV_NAME = r"([^/]+\.csv)(?:/|$)"


def list_files(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """``path, name, extension, length``; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    dot = F.regexp_extract(name, r"(\.[^.]+)$", 1)
    return files.select("path", name.alias("name"), F.lower(dot).alias("extension"), "length")


def inventory(spark: SparkSession, folder: str, extensions: Sequence[str] | None = None) -> DataFrame:
    """All files of a tree, of the extensions wanted."""
    files = list_files(spark, folder, recursive=True)
    return files if extensions is None else files.filter(F.col("extension").isin([e.lower() for e in extensions]))


def duplicate_names(files: DataFrame) -> DataFrame:
    """Files sharing a name, with ``keep`` for the largest (first path wins a tie). Nothing is deleted."""
    largest = F.min(F.struct((-F.col("length")).alias("size"), "path")).alias("_best")
    groups = files.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), largest).filter(F.col("copies") > 1)
    joined = salted_join(files, groups, ["name"], "inner", ["path"])
    return joined.withColumn("keep", F.col("path") == F.col("_best.path")).drop("_best")


def with_nulls(df: DataFrame, tokens: Sequence[str] = NULL_TOKENS, drop_undecodable: bool = True) -> DataFrame:
    """Missing-value cells become null; marks of undecodable bytes are dropped."""

    def cell(name: str):
        c = F.col(f"`{name}`")
        c = F.when(~c.isin(list(tokens)), c)
        return F.regexp_replace(c, "�", "") if drop_undecodable else c

    return df.select([cell(f.name).alias(f.name) if f.dataType == StringType() else F.col(f"`{f.name}`") for f in df.schema])


def with_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast columns that exist; a cell that does not fit becomes null."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})


def header_of(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Column names in a file's first line; empty for an empty file."""
    line = spark.read.text(path).limit(1).collect()
    return tuple(next(csv.reader([line[0].value.lstrip("﻿")]))) if line and line[0].value else ()


def read_csv(
    spark: SparkSession, paths: str | Sequence[str], types: dict[str, str] | None = None, columns: Sequence[str] | None = None,
    multiline: bool = True, with_file: bool = False,
) -> DataFrame:
    """CSV files with header, pruned to ``columns`` that exist, missing cells null.

    Files are grouped by header, so differing column orders are read right.
    Quoted line ends (``multiline``) bind each file to one task; write the
    result as Parquet once and go on from there.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    with ThreadPool(min(16, len(paths))) as pool:
        headers = pool.map(lambda p: header_of(spark, p), paths)
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, header in zip(paths, headers):
        groups.setdefault(header, []).append(path)
    out = None
    for header, members in groups.items():
        if not header:
            continue
        schema = StructType([StructField(c, StringType()) for c in header])
        part = spark.read.schema(schema).csv(members, header=True, multiLine=multiline, quote='"', escape='"', enforceSchema=False)
        part = part.select("*", dataset_name(F.col("_metadata.file_path")).alias("source_file")) if with_file else part
        if columns is not None:
            part = keep_existing(part, [*columns, *(["source_file"] if with_file else [])])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no file with a header")
    return with_types(with_nulls(out), types or {})


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(
        path, header=True, quote='"', escape='"', emptyValue="", nullValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


# --- combining a folder ---------------------------------------------------------

def kind_of(name: str, case_sensitive: bool = False) -> str:
    return "comment" if "_comments" in (name if case_sensitive else name.lower()) else "submission"


def dataset_name(path: Column) -> Column:
    """The first part of a path that ends in ``.csv``: a file, or a folder of part files."""
    return F.regexp_extract(F.replace(path, F.lit("%20"), F.lit(" ")), CSV_NAME, 1)


def scan_folder(spark: SparkSession, folder: str, communities: Sequence[str]) -> list[tuple[str, str]]:
    """``(path, name)`` of CSV files whose name contains a community, any case.

    A folder of part files counts as one file of the folder's name.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).inputFiles()  # empty files too
    wanted = [c.lower() for c in communities]
    found = []
    for path in map(unquote, files):
        name = re.search(CSV_NAME, path)
        if name and any(w in name[1].lower() for w in wanted):
            found.append((path, name[1]))
    return sorted(found)


@dataclass
class Combined:
    rows: DataFrame
    manifest: DataFrame  # source_file, kind, status, rows


def combine_folder(
    spark: SparkSession, folder: str, communities: Sequence[str], comment_columns: Sequence[str] = COMMENT_COLUMNS,
    submission_columns: Sequence[str] = SUBMISSION_COLUMNS, final_columns: Sequence[str] = COMBINED_COLUMNS,
    require_selftext: bool = True, with_file: bool = False,
) -> Combined | None:
    """One corpus of all usable comment and submission files.

    A file that is empty, lacks a text column or has no valid row is skipped;
    the manifest says so. No usable file gives None.
    """
    found = scan_folder(spark, folder, communities)
    if not found:
        return None
    with ThreadPool(min(16, len(found))) as pool:
        headers = pool.map(lambda f: header_of(spark, f[0]), found)
    usable: dict[str, list[str]] = {"comment": [], "submission": []}
    status = []
    for (path, name), header in zip(found, headers):
        kind = kind_of(name)
        needed = {"body"} if kind == "comment" else {"title", "selftext"}
        state = "empty_file" if not header else "ok" if needed <= set(header) else "missing_column"
        status.append((name, kind, state))
        if state == "ok":
            usable[kind].append(path)
    if not any(usable.values()):
        return None
    parts = []
    if usable["comment"]:
        c = read_csv(spark, usable["comment"], TYPES, comment_columns, with_file=True)
        parts.append(c.withColumn("text", comment_text()))
    if usable["submission"]:
        s = read_csv(spark, usable["submission"], TYPES, submission_columns, with_file=True)
        if require_selftext:
            s = s.filter(~T.is_blank("selftext"))
        parts.append(s.withColumn("text", submission_text()))
    parts = [keep_existing(p, [*final_columns, "source_file"]) for p in parts]
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    rows = keep_existing(rows, [*final_columns, "source_file"])
    counts = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("_n"))
    table = spark.createDataFrame(sorted(set(status)), "source_file string, kind string, status string").join(counts, "source_file", "left")
    empty = (F.col("status") == "ok") & F.col("_n").isNull()
    manifest = table.select(
        "source_file", "kind", F.when(empty, F.lit("no_valid_rows")).otherwise(F.col("status")).alias("status"), F.coalesce("_n", F.lit(0)).alias("rows")
    )
    return Combined(rows if with_file else rows.drop("source_file"), manifest)
