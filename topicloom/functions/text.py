"""String functions of the cleaner, as Column expressions.

Python's ``\\s`` covers more than Java's, so every pattern here spells the
whitespace set out. The same spelling is valid for RE2.
"""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Body of the character class equal to Python's str.isspace().
WS = r"\t-\r\x1c-\x20\x{85}\p{Z}"
NON_WS = f"[^{WS}]"

# Patterns of the cleaning steps.
MARKDOWN_LINK = r"\[([^\]]+)\]\([^\)]+\)"
URL = f"https?://{NON_WS}+|www\\.{NON_WS}+"
URL_ANY_CASE = f"(?i)http{NON_WS}+|www\\.{NON_WS}+"
TAG_IN_LINE = "(?d)<.*?>"  # (?d): the dot stops at \n only
TAG_ACROSS_LINES = "<[^>]*>"
QUOTE_RUN = '"+'
ENTITY = "&[a-zA-Z0-9#]+;"
ENTITY_LETTERS = "&[a-zA-Z]+;"
CHAR_FILTER = r"""[^a-zA-Z0-9\s,.!?':;"-]"""
CHAR_FILTER_KEEP_WS = f"""[^a-zA-Z0-9{WS},.!?':;"-]"""
CURLY_SINGLE = "â€™|‘|’"
CURLY_DOUBLE = "“|”"
PLACEHOLDER = r"\[deleted\]|\[removed\]|\[deleted by user\]|\[removed by user\]"
PLACEHOLDER_LOOSE = "deleted|removed"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repair_latin1(c: Column | str) -> Column:
    """UTF-8 bytes that were read as Latin-1 become the text they encode.

    Only a string of characters up to U+00FF that holds a multi-byte sequence
    can change; all others keep the value without being encoded.
    """
    c = col(c)
    candidate = (
        (F.octet_length(c) > F.char_length(c))
        & c.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]")
        & ~c.rlike(r"[^\x{00}-\x{FF}]")
    )
    decoded = F.try_validate_utf8(F.encode(c, "ISO-8859-1").cast("string"))
    return F.when(candidate, F.coalesce(decoded, c)).otherwise(c)


def strip_markdown_links(c: Column | str) -> Column:
    return F.regexp_replace(col(c), MARKDOWN_LINK, "$1")


#: texts of an Arrow batch that are Python strings at once
TEXTS = 64


@F.arrow_udf(StringType())
def _unescape(s: pa.Array) -> pa.Array:
    parts = []
    for i in range(0, len(s), TEXTS):
        parts.append(pa.array([t if t is None else html.unescape(t) for t in s.slice(i, TEXTS).to_pylist()], pa.string()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.string())


def unescape_html(c: Column | str) -> Column:
    """HTML unescape. Only texts that hold ``&`` travel to the Python worker."""
    c = col(c)
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def remove_urls(c: Column | str, any_case: bool = False) -> Column:
    return F.regexp_replace(col(c), URL_ANY_CASE if any_case else URL, "")


def remove_tags(c: Column | str, across_lines: bool = False) -> Column:
    return F.regexp_replace(col(c), TAG_ACROSS_LINES if across_lines else TAG_IN_LINE, "")


def squeeze_quotes(c: Column | str) -> Column:
    return F.regexp_replace(col(c), QUOTE_RUN, '"')


def remove_entities(c: Column | str, letters_only: bool = False) -> Column:
    return F.regexp_replace(col(c), ENTITY_LETTERS if letters_only else ENTITY, "")


def spelled_out(pattern: str) -> str:
    """A lone character class with its ASCII ranges written as single characters.

    The meaning is the same; Java looks single characters up in one table
    but tests ranges one after the other, three times as slow here.
    """
    if not re.fullmatch(r"\[\^?(?:[^\[\]\\&]|\\.)+\]", pattern):
        return pattern
    for short, chars in (
        ("a-z", string.ascii_lowercase), ("A-Z", string.ascii_uppercase), ("0-9", string.digits), (r"\s", r" \t\n\x0b\f\r"),
    ):
        pattern = pattern.replace(short, chars)
    return pattern


def filter_chars(c: Column | str, pattern: str = CHAR_FILTER, replacement: str = " ") -> Column:
    """Replace what ``pattern`` (Java syntax) matches."""
    return F.regexp_replace(col(c), spelled_out(pattern), replacement)


def straighten_quotes(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), CURLY_SINGLE, "'"), CURLY_DOUBLE, '"')


def collapse_ws(c: Column | str) -> Column:
    """Every whitespace run becomes one space; ends are stripped."""
    return F.trim(F.regexp_replace(col(c), f"[{WS}]+", " "))


def strip_ws(c: Column | str) -> Column:
    """Python's str.strip()."""
    return F.regexp_replace(col(c), f"^[{WS}]+|[{WS}]+$", "")


def is_blank(c: Column | str) -> Column:
    """True for null, empty and whitespace-only."""
    return ~F.coalesce(col(c).rlike(NON_WS), F.lit(False))


def blank_to_empty(c: Column | str) -> Column:
    c = col(c)
    return F.when(is_blank(c), F.lit("")).otherwise(c)


def word_count(c: Column | str) -> Column:
    """Number of whitespace-separated words; 0 for blank."""
    return F.regexp_count(col(c), F.lit(f"{NON_WS}+")).cast("long")


def word_count_collapsed(c: Column | str) -> Column:
    """As :func:`word_count` for text that :func:`collapse_ws` made."""
    c = col(c)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " "))).cast("long")


def contains_pattern(c: Column | str, pattern: str) -> Column:
    """Regex contains; null counts as no."""
    return F.coalesce(col(c).rlike(pattern), F.lit(False))


def preview(c: Column | str, n: int = 200) -> Column:
    return F.substring(col(c), 1, n)


def join_nonnull(cols: Iterable[str], sep: str = " ") -> Column:
    return F.concat_ws(sep, *[F.col(c).cast("string") for c in cols])


def join_with_token(cols: Iterable[str], null_token: str = "", sep: str = " ") -> Column:
    """Join columns; a null part is written as ``null_token`` and keeps its separator."""
    return F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(null_token)) for c in cols])
