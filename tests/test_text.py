"""Cleaner edge strings; expected values follow from the rules, worked out by hand."""

import html
import re

import pytest
from pyspark.sql import functions as F

from topicloom.config import Cleaning
from topicloom.functions import text as T
from topicloom.functions import tokens as K
from topicloom.operators.cleaning import clean_column


def one(spark, value, expr):
    df = spark.createDataFrame([(value,)], "t string")
    return df.select(expr(F.col("t")).alias("x")).first().x


def clean(spark, value, **settings):
    df = spark.createDataFrame([(value,)], "t string")
    return clean_column(df, "t", "docs", Cleaning(**settings)).first().docs


@pytest.mark.parametrize("raw, want", [
    ("Itâ\u0080\u0099s cafÃ©", "It’s café"), ("café", "café"), ("日本", "日本"),
    ("cafÃ© 日", "cafÃ© 日"), ("plain", "plain"), ("", ""), ("Â x", " x"),
])
def test_repair_latin1(spark, raw, want):
    assert one(spark, raw, T.repair_latin1) == want


def test_whitespace_like_python(spark):
    raw = " a b  c\u001cd\u0085e\t\n f　"
    assert one(spark, raw, T.collapse_ws) == re.sub(r"\s+", " ", raw).strip() == "a b c d e f"
    assert one(spark, raw, T.strip_ws) == raw.strip()
    assert one(spark, raw, T.word_count) == len(raw.split())


@pytest.mark.parametrize("raw, want", [("<a\rb> x", " x"), ("<c\nd>", "<c\nd>"), ("a<b>c</b>", "ac")])
def test_tags_stay_in_line(spark, raw, want):
    assert one(spark, raw, T.remove_tags) == want == re.sub(r"<.*?>", "", raw)


def test_tags_across_lines(spark):
    assert one(spark, "<c\nd>x", lambda c: T.remove_tags(c, True)) == "x"


def test_urls(spark):
    assert one(spark, "http://x.y/z tail www.a.b", T.remove_urls) == " tail "
    assert one(spark, "HTTP://X tail", T.remove_urls) == "HTTP://X tail"
    assert one(spark, "HTTP://X tail", lambda c: T.remove_urls(c, True)) == " tail"
    assert one(spark, "http://x y", T.remove_urls) == " y"


@pytest.mark.parametrize("raw, want", [("[t](u)", "t"), ("[a]b](c)", "[a]b](c)"), ("x [a b](http://c) y", "x a b y")])
def test_markdown_links(spark, raw, want):
    assert one(spark, raw, T.strip_markdown_links) == want == re.sub(r"\[([^\]]+)\]\([^\)]+\)", r"\1", raw)


@pytest.mark.parametrize("raw", ["a &amp; b", "&lt;b&gt; &notanentity; &#39;&#x41;", "no entity", "&amp;amp;", "&copy 1"])
def test_unescape(spark, raw):
    assert one(spark, raw, T.unescape_html) == html.unescape(raw)


def test_entities_and_quotes(spark):
    assert one(spark, "&amp; &#39; &x1; & y;", T.remove_entities) == "   & y;"
    assert one(spark, "&amp; &#39;", lambda c: T.remove_entities(c, True)) == " &#39;"
    assert one(spark, 'a""b"""', T.squeeze_quotes) == 'a"b"'
    assert one(spark, "‘a’ “b” donâ€™t", T.straighten_quotes) == "'a' \"b\" don't"


def test_spelled_out_class_means_the_same():
    for pattern in (T.CHAR_FILTER, "[^a-zA-Z0-9 ]", "[a-z]"):
        spelled = T.spelled_out(pattern)
        assert all(bool(re.fullmatch(pattern, chr(i), re.A)) == bool(re.fullmatch(spelled, chr(i), re.A)) for i in range(0x500) if i not in range(0x1C, 0x20))
    assert T.spelled_out("x[a-z]y") == "x[a-z]y"
    assert T.spelled_out("[a-z&&[^b]]") == "[a-z&&[^b]]"


def test_default_order(spark):
    raw = '[Link](http://a.b) &lt;b&gt;Bold&lt;/b&gt; ""Q"" see http://x.y/z  Ünï &zzz; END'
    got = clean(spark, raw, unescape=True, url_removal=True, html_tag_removal=True, quote_normalization=True,
                html_entity_removal=True, char_filtering=True, char_filter_regex=T.CHAR_FILTER, lowercase=True)
    assert got == 'link bold "q" see n end'


def test_null_blank_and_markdown_default(spark):
    assert clean(spark, None) == ""
    assert clean(spark, " \n ") == ""
    assert clean(spark, "[a](b)") == "a"
    assert clean(spark, "[a](b)", markdown_removal=False) == "[a](b)"


def test_char_filter_needs_a_pattern(spark):
    assert clean(spark, "a€b", char_filtering=True) == "a€b"


def test_forum_profile_order(spark):
    # the character filter runs before the tag step, so brackets are gone by then
    assert clean(spark, "&lt;b&gt;hi&lt;/b&gt; HTTP://x y’s z", profile="forum_v1") == "bhib y's z"


def test_default_profile_is_idempotent(spark):
    cfg = dict(url_removal=True, html_tag_removal=True, char_filtering=True, char_filter_regex=T.CHAR_FILTER, lowercase=True)
    once = clean(spark, "A  B\t<i>c</i> ñ www.x.y d", **cfg)
    assert clean(spark, once, **cfg) == once


@pytest.mark.parametrize("raw", ["Hello, wörld a bc d_e 12 x9", "", "a b c", "naïve—test ½½ ok"])
def test_tokens_like_python(spark, raw):
    assert one(spark, raw, lambda c: K.tokenize(c, False)) == re.findall(r"(?u)\b\w\w+\b", raw)


def test_ngrams(spark):
    grams = one(spark, "The cat and the dog sat", lambda c: K.terms(c, (1, 3), ("the", "and")))
    assert grams == ["cat", "dog", "sat", "cat dog", "dog sat", "cat dog sat"]
    assert one(spark, "one", lambda c: K.terms(c, (2, 2), None)) == []
    assert "the" not in one(spark, "the cat", lambda c: K.terms(c, (1, 1), "english"))


def test_bad_settings_raise():
    with pytest.raises(ValueError):
        Cleaning(profile="other")
    with pytest.raises(ValueError):
        Cleaning.from_dict({"apply_magic": True})
    assert Cleaning.from_dict({"clean_apply_lowercase": True, "apply_unescape": True}) == Cleaning(lowercase=True, unescape=True)


def test_a_batch_is_unescaped_some_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    batch = pa.array(["&amp;" + "x" * 10_000, None] * 1000)
    tracemalloc.start()
    out = T._unescape.func(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == ["&" + "x" * 10_000, None] * 1000 and peak < 4e6
