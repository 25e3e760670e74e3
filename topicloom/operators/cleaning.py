"""The text cleaner: a fixed order of switched steps per profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Cleaning
from ..functions import text as T


def _before_unescape(c: Column, cfg: Cleaning) -> Column:
    if cfg.profile == "forum_v1":
        return T.blank_to_empty(c)
    c = T.repair_latin1(F.coalesce(c, F.lit("")))
    return T.strip_markdown_links(c) if cfg.markdown_removal else c


def _after_unescape(c: Column, cfg: Cleaning) -> Column:
    if cfg.profile == "forum_v1":
        c = T.remove_urls(c, any_case=True)
        c = T.straighten_quotes(c)
        c = T.filter_chars(c, T.CHAR_FILTER_KEEP_WS, "")
        c = T.remove_tags(c, across_lines=True)
        c = T.remove_entities(c, letters_only=True)
        return T.collapse_ws(c)
    if cfg.url_removal:
        c = T.remove_urls(c)
    if cfg.html_tag_removal:
        c = T.remove_tags(c)
    if cfg.quote_normalization:
        c = T.squeeze_quotes(c)
    if cfg.html_entity_removal:
        c = T.remove_entities(c)
    if cfg.char_filtering and cfg.char_filter_regex:
        c = T.filter_chars(c, cfg.char_filter_regex)
    if cfg.lowercase:
        c = F.lower(c)
    return T.collapse_ws(c)


def _unescapes(cfg: Cleaning) -> bool:
    return cfg.unescape or cfg.profile == "forum_v1"


def with_computed(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add an expensive column so that it is computed once per row.

    A plain ``withColumn`` is inlined into every later filter and projection
    that mentions it, which would run the whole regex chain again for each.
    A one-element ``explode`` keeps it in place.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(expr)).alias(name))


def clean_into(df: DataFrame, raw: Column, target: str, cfg: Cleaning = Cleaning(), keep_null: bool = False) -> DataFrame:
    """Add ``target``, the cleaned ``raw`` text; null gives '' or stays null.

    Unescaping mentions its input several times, so that input is computed
    in a column of its own.
    """
    before = _before_unescape(raw.cast("string"), cfg)
    if keep_null:
        before = F.when(raw.isNotNull(), before)
    if not _unescapes(cfg):
        return with_computed(df, target, _after_unescape(before, cfg))
    df = with_computed(df, "_unescaped", before)
    return with_computed(df, target, _after_unescape(T.unescape_html("_unescaped"), cfg)).drop("_unescaped")


def clean_column(df: DataFrame, source: str, target: str = "docs", cfg: Cleaning = Cleaning()) -> DataFrame:
    return clean_into(df, F.col(source), target, cfg)
