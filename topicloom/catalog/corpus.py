"""Queries of filters, cleaning, units, joins, audit and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Cleaning, DataSource, Filters, Preprocessing
from ..functions import text as T
from ..operators import audit, cleaning, dedupe, filters, joins, sampling, units
from ..plans import preprocess
from .tables import (
    SQL_WS, SQL_X, SQL_Y, documents, events, register, sql_clean, sql_collapse, sql_nonblank, sql_strip, sql_words, table, with_plane,
)

PAPERS = Cleaning(char_filtering=True, char_filter_regex=T.CHAR_FILTER, lowercase=True)
PAGES = Cleaning(
    unescape=False, url_removal=True, html_tag_removal=True, quote_normalization=True, html_entity_removal=True,
    char_filtering=True, char_filter_regex=T.CHAR_FILTER, lowercase=True,
)
SURVIVAL = Preprocessing(
    source=DataSource(("text",), "doc_id", ("text",)),
    cleaning=PAPERS,
    filters=Filters(length_filter=True, min_doc_length=50, max_doc_length=1000, duplicate_removal=True,
                    score_filter=True, score_column_for_filtering="n_chars", min_score_for_filtering=500),
)

SQL_FLAGGED = f"""
WITH c AS (SELECT *, {sql_clean()} AS docs, {sql_nonblank('text')} AS has_text FROM documents),
l AS (SELECT *, {sql_words('docs')} AS doc_len FROM c),
f AS (SELECT *, CASE WHEN NOT has_text THEN 'missing_required' WHEN docs = '' THEN 'empty_after_cleaning'
      WHEN doc_len < 50 THEN 'too_short' WHEN doc_len > 1000 THEN 'too_long' END AS r1 FROM l),
g AS (SELECT *, CASE WHEN r1 IS NULL THEN row_number() OVER (PARTITION BY r1 IS NULL, docs ORDER BY doc_id) END AS rn FROM f),
flagged AS (SELECT *, coalesce(r1, CASE WHEN rn > 1 THEN 'duplicate_text' END,
      CASE WHEN n_chars IS NULL THEN 'score_null' WHEN n_chars < 500 THEN 'score_out_of_range' END) AS reason FROM g),
staged AS (SELECT *, CASE reason WHEN 'missing_required' THEN 'required' WHEN 'empty_after_cleaning' THEN 'cleaning'
      WHEN 'too_short' THEN 'length' WHEN 'too_long' THEN 'length' WHEN 'duplicate_text' THEN 'duplicate'
      WHEN 'score_null' THEN 'score' WHEN 'score_out_of_range' THEN 'score' END AS stage FROM flagged)
"""


def flagged(spark: SparkSession, d: str) -> DataFrame:
    return preprocess.flag_rows(documents(spark, d), SURVIVAL)


@register("g19_survival_by_source", SQL_FLAGGED + """
SELECT source, coalesce(stage, 'kept') AS stage, coalesce(reason, 'kept') AS reason, count(*) AS rows
FROM staged GROUP BY ALL""")
def survival(spark, d):
    """How many documents survive cleaning, by source, and why the others go."""
    return preprocess.survival_report(flagged(spark, d), "source")


@register("g19_removal_log", SQL_FLAGGED + "SELECT doc_id, stage, reason FROM staged WHERE reason IS NOT NULL")
def removal_log(spark, d):
    return preprocess.removed_rows(flagged(spark, d)).select("doc_id", "stage", "reason")


@register("g15_step_counts", SQL_FLAGGED + "SELECT stage, reason, count(*) AS rows FROM staged WHERE reason IS NOT NULL GROUP BY ALL")
def step_counts(spark, d):
    return audit.step_counts(preprocess.removed_rows(flagged(spark, d)))


@register("g19_processed_corpus", SQL_FLAGGED + "SELECT doc_id, source, docs, doc_len FROM staged WHERE reason IS NULL")
def processed(spark, d):
    return preprocess.kept_rows(flagged(spark, d)).select("doc_id", "source", "docs", "doc_len")


# --- projections and predicates -------------------------------------------------

@register("p1_keep_existing", "SELECT doc_id, lang, source FROM documents")
def p1(spark, d):
    return filters.keep_existing(documents(spark, d), ["doc_id", "lang", "link_id", "source"])


@register("p2_rename", "SELECT doc_id, text AS docs FROM documents")
def p2(spark, d):
    return filters.rename(documents(spark, d).select("doc_id", "text"), {"text": "docs", "body": "text"})


def as_forum(spark: SparkSession, d: str) -> DataFrame:
    """Turns as posts: a user turn is a comment, any other a submission titled by its role."""
    user = F.col("role") == "user"
    return table(spark, d, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.when(user, F.col("text")).alias("body"),
        F.when(~user, F.col("role")).alias("title"),
        F.when(~user, F.col("text")).alias("selftext"),
        F.col("role"),
    )


SQL_FORUM = """WITH forum AS (SELECT concat_ws('-', conv_id, turn) AS id, role,
 CASE WHEN role = 'user' THEN text END AS body, CASE WHEN role <> 'user' THEN role END AS title,
 CASE WHEN role <> 'user' THEN text END AS selftext FROM conversations) """


@register("p3_comment_text", SQL_FORUM + "SELECT id, body AS text, coalesce(body, '') AS text_or_empty FROM forum")
def p3(spark, d):
    return as_forum(spark, d).select("id", filters.comment_text().alias("text"),
                                     filters.comment_text(null_as_empty=True).alias("text_or_empty"))


@register("p4_submission_text", SQL_FORUM + f"""SELECT id, {sql_strip("coalesce(title, '') || ' ' || coalesce(selftext, '')")} AS text,
 coalesce(title, '') || ' ' || coalesce(selftext, '') AS untrimmed FROM forum WHERE role <> 'user'""")
def p4(spark, d):
    rows = as_forum(spark, d).filter(F.col("role") != "user")
    return rows.select("id", filters.submission_text().alias("text"), filters.submission_text(strip=False).alias("untrimmed"))


@register("p5_docs_join", SQL_FORUM + """SELECT id, coalesce(title, '') || ' ' || coalesce(body, '') AS docs,
 coalesce(title, 'nan') || ' ' || coalesce(body, 'nan') AS docs_parity FROM forum""")
def p5(spark, d):
    return as_forum(spark, d).select("id", T.join_with_token(["title", "body"]).alias("docs"),
                                     T.join_with_token(["title", "body"], "nan").alias("docs_parity"))


@register("p6_merged_text", SQL_FORUM + f"SELECT id, {sql_strip(chr(39).join(['concat_ws(', ' ', ', title, selftext, body)']))} AS text FROM forum")
def p6(spark, d):
    return as_forum(spark, d).select("id", filters.merged_text(["title", "selftext", "body"]).alias("text"))


@register("p7_required", SQL_FORUM + f"SELECT id, {sql_nonblank('body')} AS kept FROM forum")
def p7(spark, d):
    kept, gone = filters.split_required(as_forum(spark, d), ["body"])
    return kept.select("id", F.lit(True).alias("kept")).union(gone.select("id", F.lit(False).alias("kept")))


@register("p8_drop_blank", f"WITH c AS (SELECT doc_id, {sql_clean()} AS docs FROM documents) SELECT doc_id FROM c WHERE docs <> ''")
def p8(spark, d):
    return filters.drop_blank(cleaning.clean_column(documents(spark, d), "text", "docs", PAPERS)).select("doc_id")


@register("p9_word_filter", f"""WITH c AS (SELECT doc_id, {sql_words('text')} AS doc_len FROM documents)
SELECT * FROM c WHERE doc_len BETWEEN 50 AND 400""")
def p9(spark, d):
    return filters.word_count_filter(documents(spark, d), 50, 400, "text").select("doc_id", "doc_len")


@register("p10_char_filter", "SELECT doc_id FROM documents WHERE length(text) >= 1000")
def p10(spark, d):
    return filters.char_length_filter(documents(spark, d), "text", 1000).select("doc_id")


@register("p11_score_range", "SELECT event_id, value FROM events WHERE value >= 5 AND value <= 100")
def p11(spark, d):
    return filters.score_range(table(spark, d, "events"), "value", 5, 100).select("event_id", "value")


@register("p12_metadata_filter", """SELECT event_id, user_id, event_type FROM events
WHERE value > 5 AND event_type IN ('click', 'view') AND user_id BETWEEN 10 AND 60""")
def p12(spark, d):
    where = [("value", ">", 5), ("event_type", "in", ["click", "view"]), ("user_id", "between", (10, 60))]
    return filters.metadata_filter(table(spark, d, "events"), where).select("event_id", "user_id", "event_type")


@register("p13_placeholders", SQL_FORUM + r""", t AS (SELECT id, CASE WHEN length(body) < 120 THEN '[deleted]' ELSE body END AS body,
 CASE WHEN length(selftext) < 120 THEN 'x [removed by user]' ELSE selftext END AS selftext FROM forum)
SELECT id FROM t WHERE NOT coalesce(regexp_matches(body, '\[(deleted|removed)( by user)?\]'), false)
 AND NOT coalesce(regexp_matches(selftext, '\[(deleted|removed)( by user)?\]'), false)""")
def p13(spark, d):
    posts = as_forum(spark, d).withColumns({
        "body": F.when(F.char_length("body") < 120, "[deleted]").otherwise(F.col("body")),
        "selftext": F.when(F.char_length("selftext") < 120, "x [removed by user]").otherwise(F.col("selftext")),
    })
    return filters.drop_placeholders(posts).select("id")


@register("p14_mentions_removal", "SELECT page_id, regexp_matches(html, 'deleted|removed') AS hit FROM pages")
def p14(spark, d):
    return table(spark, d, "pages").select("page_id", filters.mentions_removal("html").alias("hit"))


@register("p15_topic_members", "SELECT vec_id, label FROM embeddings WHERE label IN (1, 4, 7)")
def p15(spark, d):
    return filters.topic_members(table(spark, d, "embeddings").select("vec_id", "label"), [1, 4, 7], "label", "vec_id")


@register("p16_box", f"""WITH p AS (SELECT vec_id, label - 1 AS topic, {SQL_X} * 10 AS x, {SQL_Y} * 10 AS y FROM embeddings)
SELECT vec_id, topic FROM p WHERE topic <> -1 AND x > -10 AND x < 10 AND y > -10 AND y < 10""")
def p16(spark, d):
    pts = points(spark, d).withColumns({"x": F.col("x") * 10, "y": F.col("y") * 10})
    return filters.inside_box(filters.drop_outliers(pts)).select("vec_id", "topic")


def points(spark: SparkSession, d: str) -> DataFrame:
    return with_plane(table(spark, d, "embeddings")).select("vec_id", (F.col("label") - 1).alias("topic"), "x", "y")


@register("p17_type", SQL_FORUM + "SELECT id, CASE WHEN title IS NULL THEN 'comment' ELSE 'submission' END AS type FROM forum")
def p17(spark, d):
    return as_forum(spark, d).select("id", filters.record_type().alias("type"))


@register("p18_row_number", "SELECT url, CAST(row_number() OVER (ORDER BY page_id) - 1 AS BIGINT) AS row_id FROM pages")
def p18(spark, d):
    return sampling.with_row_number(table(spark, d, "pages").select("page_id", "url"), "page_id", "row_id").select("url", "row_id")


@register("p19_topic_label", """WITH l AS (SELECT DISTINCT label AS topic, 'topic ' || label AS label FROM embeddings WHERE label < 7)
SELECT vec_id, coalesce(l.label, 'No Topic') AS label FROM embeddings e LEFT JOIN l ON e.label = l.topic""")
def p19(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").alias("topic"))
    labels = rows.filter("topic < 7").select("topic").distinct().withColumn("label", F.concat(F.lit("topic "), F.col("topic")))
    return filters.with_topic_label(rows, labels, "topic", "vec_id").select("vec_id", "label")


@register("p20_arrange", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, source, text FROM documents")
def p20(spark, d):
    return filters.arrange(documents(spark, d), ["source", "doc_id"], ["lang", "n_chars"], ["doc_id"])


@register("p21_date_range", "SELECT event_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def p21(spark, d):
    return filters.date_range(table(spark, d, "events"), "ts", "2024-01-05", "2024-01-12").select("event_id", "event_type")


@register("p22_outliers", "SELECT vec_id FROM embeddings WHERE label = 0")
def p22(spark, d):
    return filters.only_outliers(points(spark, d)).select("vec_id")


# --- cleaner steps --------------------------------------------------------------

SQL_PAGE_LINK = r"regexp_replace(html, '\[([^\]]+)\]\([^\)]+\)', '\1', 'g')"


@register("c1_repair_latin1", "SELECT doc_id, text AS repaired FROM documents")
def c1(spark, d):
    """Text damaged on purpose (UTF-8 read as Latin-1) comes back as it was."""
    damaged = F.decode(F.encode(F.col("text"), "UTF-8"), "ISO-8859-1")
    return documents(spark, d).select("doc_id", T.repair_latin1(damaged).alias("repaired"))


@register("c2_markdown_links", r"""SELECT page_id, regexp_replace('see [' || replace(url, ']', '') || '](' || url || ') end', '\[([^\]]+)\]\([^\)]+\)', '\1', 'g') AS txt FROM pages""")
def c2(spark, d):
    link = F.concat(F.lit("see ["), F.replace(F.col("url"), F.lit("]"), F.lit("")), F.lit("]("), F.col("url"), F.lit(") end"))
    return table(spark, d, "pages").select("page_id", T.strip_markdown_links(link).alias("txt"))


SQL_ENTITIES = "html"
for _name, _char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"')):  # all that occur, but for &amp;
    SQL_ENTITIES = f"replace({SQL_ENTITIES}, '{_name}', '{_char}')"
SQL_ENTITIES = f"regexp_replace({SQL_ENTITIES}, '&amp;?', '&', 'g')"


@register("c3_unescape", f"SELECT page_id, {SQL_ENTITIES} AS txt FROM pages")
def c3(spark, d):
    return table(spark, d, "pages").select("page_id", T.unescape_html("html").alias("txt"))


@register("c4_urls", f"""SELECT page_id, regexp_replace('go ' || url || ' now', 'https?://[^{SQL_WS[1:-1]}]+|www\\.[^{SQL_WS[1:-1]}]+', '', 'g') AS txt,
 regexp_replace(upper(url) || ' now', '(?i)http[^{SQL_WS[1:-1]}]+|www\\.[^{SQL_WS[1:-1]}]+', '', 'g') AS txt_any_case FROM pages""")
def c4(spark, d):
    return table(spark, d, "pages").select(
        "page_id", T.remove_urls(F.concat(F.lit("go "), "url", F.lit(" now"))).alias("txt"),
        T.remove_urls(F.concat(F.upper("url"), F.lit(" now")), any_case=True).alias("txt_any_case"))


@register("c5_tags", "SELECT page_id, regexp_replace(html, '<[^\\n]*?>', '', 'g') AS txt, regexp_replace(html, '<[^>]*>', '', 'g') AS txt_across FROM pages")
def c5(spark, d):
    return table(spark, d, "pages").select("page_id", T.remove_tags("html").alias("txt"), T.remove_tags("html", True).alias("txt_across"))


@register("c6_quotes", "SELECT page_id, regexp_replace(html, '\"+', '\"', 'g') AS txt FROM pages")
def c6(spark, d):
    return table(spark, d, "pages").select("page_id", T.squeeze_quotes("html").alias("txt"))


@register("c7_entities", "SELECT page_id, regexp_replace(html, '&[a-zA-Z0-9#]+;', '', 'g') AS txt, regexp_replace(html, '&[a-zA-Z]+;', '', 'g') AS txt_letters FROM pages")
def c7(spark, d):
    return table(spark, d, "pages").select("page_id", T.remove_entities("html").alias("txt"), T.remove_entities("html", True).alias("txt_letters"))


@register("c8_char_filter", """SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g') AS txt, regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g') AS txt_deleted FROM documents""")
def c8(spark, d):
    return documents(spark, d).select("doc_id", T.filter_chars("text", "[^a-zA-Z0-9 ]").alias("txt"), T.filter_chars("text", "[^a-zA-Z0-9 ]", "").alias("txt_deleted"))


@register("c9_lowercase", "SELECT doc_id, lower(text) AS txt FROM documents")
def c9(spark, d):
    return documents(spark, d).select("doc_id", F.lower("text").alias("txt"))


@register("c10_whitespace", f"SELECT doc_id, {sql_collapse('text')} AS txt FROM documents")
def c10(spark, d):
    return documents(spark, d).select("doc_id", T.collapse_ws("text").alias("txt"))


@register("c8_c10_clean", f"SELECT doc_id, {sql_clean()} AS docs, {sql_words(sql_clean())} AS doc_len FROM documents")
def c8_c10(spark, d):
    cleaned = cleaning.clean_column(documents(spark, d), "text", "docs", PAPERS)
    return cleaned.select("doc_id", "docs", T.word_count_collapsed("docs").alias("doc_len"))


_page = f"regexp_replace({SQL_PAGE_LINK}, 'https?://[^{SQL_WS[1:-1]}]+|www\\.[^{SQL_WS[1:-1]}]+', '', 'g')"
_page = f"regexp_replace({_page}, '<[^\\n]*?>', '', 'g')"
_page = f"regexp_replace(regexp_replace({_page}, '\"+', '\"', 'g'), '&[a-zA-Z0-9#]+;', '', 'g')"
_page = f"regexp_replace({_page}, '[^a-zA-Z0-9\\s,.!?'':;\"-]', ' ', 'g')"


@register("c5_c7_html_clean", f"SELECT page_id, {sql_collapse('lower(' + _page + ')')} AS docs FROM pages")
def html_clean(spark, d):
    return cleaning.clean_column(table(spark, d, "pages"), "html", "docs", PAGES).select("page_id", "docs")


@register("c11_straight_quotes", """SELECT page_id, 'it''s "' || page_id || '"' AS txt FROM pages""")
def c11(spark, d):
    raw = F.concat(F.lit("it’s “"), F.col("page_id").cast("string"), F.lit("”"))
    return table(spark, d, "pages").select("page_id", T.straighten_quotes(raw).alias("txt"))


@register("c12_blank_to_empty", SQL_FORUM + f"SELECT id, CASE WHEN {sql_nonblank('body')} THEN body ELSE '' END AS txt FROM forum")
def c12(spark, d):
    return as_forum(spark, d).select("id", T.blank_to_empty("body").alias("txt"))


@register("c13_lengths", f"SELECT doc_id, {sql_strip('text')} AS txt, {sql_words('text')} AS words, CAST(length(text) AS BIGINT) AS chars FROM documents")
def c13(spark, d):
    return documents(spark, d).select("doc_id", T.strip_ws("text").alias("txt"), T.word_count("text").alias("words"),
                                      F.char_length("text").cast("long").alias("chars"))


@register("c14_contains", "SELECT doc_id, regexp_matches(text, '[0-9]{3}') AS hit FROM documents")
def c14(spark, d):
    return documents(spark, d).select("doc_id", T.contains_pattern("text", "[0-9]{3}").alias("hit"))


@register("c18_preview", "SELECT doc_id, text[1:200] AS txt FROM documents")
def c18(spark, d):
    return documents(spark, d).select("doc_id", T.preview("text").alias("txt"))


_v1 = SQL_ENTITIES
_v1 = f"regexp_replace({_v1}, '(?i)http[^{SQL_WS[1:-1]}]+|www\\.[^{SQL_WS[1:-1]}]+', '', 'g')"
_v1 = f"regexp_replace(regexp_replace({_v1}, 'â€™|‘|’', '''', 'g'), '“|”', '\"', 'g')"
_v1 = f"regexp_replace({_v1}, '[^a-zA-Z0-9{SQL_WS[1:-1]},.!?'':;\"-]', '', 'g')"


@register("c_forum_profile", f"SELECT page_id, {sql_collapse(_v1)} AS docs FROM pages")
def forum_profile(spark, d):
    return cleaning.clean_column(table(spark, d, "pages"), "html", "docs", Cleaning(profile="forum_v1")).select("page_id", "docs")


# --- units ----------------------------------------------------------------------

SQL_SENTENCES = f"string_split(regexp_replace(text, '([.!?]){SQL_WS}+', '\\1' || chr(1), 'g'), chr(1))"
SQL_PARAGRAPHS = "regexp_split_to_array(text, '\\n\\s*\\n')"


def sql_units(pieces: str, kind: str) -> str:
    return f"""WITH p AS (SELECT doc_id, list_filter(list_transform({pieces}, lambda x: {sql_strip('x')}), lambda x: x <> '') AS parts FROM documents),
u AS (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS unit_id FROM p)
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(unit_id AS BIGINT) AS unit_id, '{kind}' AS unit_type, text FROM u"""


@register("n1_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(0 AS BIGINT) AS unit_id, 'document' AS unit_type, text FROM documents")
def n1(spark, d):
    return units.text_units(documents(spark, d), "doc_id", "text")


@register("n2_sentences", sql_units(SQL_SENTENCES, "sentence"))
def n2(spark, d):
    return units.sentence_units(documents(spark, d), "doc_id", "text", abbreviations=())


@register("n3_paragraphs", sql_units(SQL_PARAGRAPHS, "paragraph"))
def n3(spark, d):
    return units.paragraph_units(documents(spark, d), "doc_id", "text")


# --- joins ----------------------------------------------------------------------

@register("j1_sentence_metadata", sql_units(SQL_SENTENCES, "sentence").replace(
    "SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(unit_id", "SELECT CAST(u.doc_id AS VARCHAR) AS doc_id, lang, source, quality, CAST(unit_id").replace(
    ", 'sentence' AS unit_type, text FROM u", " FROM u JOIN documents d ON u.doc_id = d.doc_id LEFT JOIN labels l ON u.doc_id = l.doc_id").replace(
    "CAST(unit_id AS BIGINT) AS unit_id", "CAST(unit_id AS BIGINT) AS unit_id"))
def j1(spark, d):
    rows = units.sentence_units(documents(spark, d), "doc_id", "text", (), ["lang", "source"]).drop("text", "unit_type")
    meta = table(spark, d, "labels").withColumn("doc_id", F.col("doc_id").cast("string"))
    return joins.left_metadata(rows, meta, "doc_id", ["quality"])


@register("j2_document_metadata", "SELECT d.doc_id, source, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j2(spark, d):
    return joins.left_metadata(documents(spark, d).select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@register("j3_side_by_side", """WITH a AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
b AS (SELECT doc_id AS other_id, n_chars, row_number() OVER (ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, source, other_id, n_chars FROM a JOIN b USING (rn)""")
def j3(spark, d):
    left = documents(spark, d).select("doc_id", "source")
    right = documents(spark, d).select(F.col("doc_id").alias("other_id"), "n_chars")
    return joins.side_by_side(left, right, "doc_id", "other_id")


@register("j4_attach_topics", "SELECT d.doc_id, source, quality AS topic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def j4(spark, d):
    topics = table(spark, d, "labels").select("doc_id", F.col("quality").alias("topic"))
    return documents(spark, d).select("doc_id", "source").join(topics, "doc_id")


@register("j5_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j5(spark, d):
    return joins.anti_rows(documents(spark, d).select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@register("j6_semi", "SELECT event_id FROM events WHERE user_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j6(spark, d):
    wanted = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("user_id"))
    return joins.semi_rows(table(spark, d, "events").select("event_id", "user_id"), wanted, "user_id", ["event_id"]).select("event_id")


@register("j8_coverage", """SELECT (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) AS docs_without_vector,
(SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS vectors_without_doc""")
def j8(spark, d):
    return joins.coverage(documents(spark, d), table(spark, d, "labels"), "doc_id")


# --- copies ---------------------------------------------------------------------

@register("g2_dedupe_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def g2(spark, d):
    return dedupe.dedupe_first(documents(spark, d), "text", ["doc_id"]).select("doc_id")


@register("g3_repeat_groups", """SELECT doc_id, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS copies FROM documents
QUALIFY count(*) OVER (PARTITION BY text) > 2""")
def g3(spark, d):
    return dedupe.split_repeated(documents(spark, d), "text", "doc_id", 2)[1].select("doc_id", "copies")


@register("g3_without_repeats", "SELECT doc_id FROM documents QUALIFY count(*) OVER (PARTITION BY text) <= 2")
def g3_kept(spark, d):
    return dedupe.split_repeated(documents(spark, d), "text", "doc_id", 2)[0].select("doc_id")


@register("g4_trimmed", """SELECT event_id, CASE WHEN value IS NULL THEN 'score_null' WHEN value < 5 THEN 'score_below'
WHEN length(coalesce(props, '')) < 9 THEN 'too_short' END AS reason FROM events WHERE value IS NULL OR value < 5 OR length(coalesce(props, '')) < 9""")
def g4(spark, d):
    return audit.trimmed_rows(table(spark, d, "events"), "value", 5, "props", 9).select("event_id", "reason")


# --- audit ----------------------------------------------------------------------

def _sql_ranges(conditions: list[tuple[str, str]], source: str) -> str:
    parts = [f"SELECT '{name}' AS range, count(*) FILTER (WHERE {cond}) AS count FROM {source}" for name, cond in conditions]
    return " UNION ALL ".join(parts)


@register("g5_word_ranges", f"WITH w AS (SELECT {sql_words('text')} AS n FROM documents) " + _sql_ranges([
    ("less_than_10", "n < 10"), ("10_to_49", "n BETWEEN 10 AND 49"), ("50_to_99", "n BETWEEN 50 AND 99"),
    ("100_to_199", "n BETWEEN 100 AND 199"), ("200_or_more", "n >= 200")], "w"))
def g5(spark, d):
    words = cleaning.with_computed(documents(spark, d).select("text"), "n", T.word_count("text"))
    return audit.range_counts(words, audit.word_ranges(F.col("n")))


@register("g6_score_ranges", _sql_ranges([
    ("less_than_0", "value < 0"), ("equal_0", "value = 0"), ("1_plus", "value > 0"), ("5_plus", "value >= 5"),
    ("10_plus", "value >= 10"), ("20_plus", "value >= 20")], "events"))
def g6(spark, d):
    return audit.range_counts(table(spark, d, "events"), audit.score_ranges(F.col("value")))


@register("g7_group_means", f"""SELECT source, round(avg(n_chars), 6) AS mean_n_chars, round(avg({sql_words('text')}), 6) AS mean_words FROM documents GROUP BY source""")
def g7(spark, d):
    rows = documents(spark, d).select("source", "n_chars", T.word_count("text").alias("words"))
    means = audit.group_means(rows, "source", ["n_chars", "words"])
    return means.select("source", F.round("mean_n_chars", 6).alias("mean_n_chars"), F.round("mean_words", 6).alias("mean_words"))


_SQL_BIN = "CASE WHEN hi = lo THEN 0 ELSE least(49, floor((value - lo) * 50 / (hi - lo))) END"


@register("g10_histogram", f"""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
c AS (SELECT CAST({_SQL_BIN} AS BIGINT) AS bin, lo, hi, count(*) AS count FROM events, b GROUP BY ALL)
SELECT bin, round(lo + bin * (hi - lo) / 50, 6) AS bin_start, round(lo + (bin + 1) * (hi - lo) / 50, 6) AS bin_end, count FROM c""")
def g10(spark, d):
    h = audit.histogram(table(spark, d, "events").select("value", "event_id"), "value")
    return h.select("bin", F.round("bin_start", 6).alias("bin_start"), F.round("bin_end", 6).alias("bin_end"), "count")


@register("g10_histogram_by_group", f"""WITH b AS (SELECT event_type, min(value) AS lo, max(value) AS hi FROM events GROUP BY ALL)
SELECT event_type, CAST({_SQL_BIN} AS BIGINT) AS bin, count(*) AS count FROM events JOIN b USING (event_type) GROUP BY ALL""")
def g10_groups(spark, d):
    h = audit.histogram(table(spark, d, "events").select("value", "event_type", "event_id"), "value", group="event_type")
    return h.select("event_type", "bin", "count")


@register("g10_density_curve", f"""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
h AS (SELECT CAST({_SQL_BIN} AS BIGINT) AS bin, lo, hi, CAST(count(*) AS DOUBLE) AS n FROM events, b GROUP BY ALL),
m AS (SELECT *, lo + (bin + 0.5) * (hi - lo) / 50 AS mid FROM h),
s AS (SELECT sum(n) AS total, sqrt(sum(n * mid * mid) / sum(n) - (sum(n * mid) / sum(n)) * (sum(n * mid) / sum(n))) AS sd,
  min(lo + bin * (hi - lo) / 50) AS a, max(lo + (bin + 1) * (hi - lo) / 50) AS z FROM m),
g AS (SELECT CAST(i AS BIGINT) AS point, a + i * (z - a) / 199 AS x, total, sd * pow(total, -0.2) AS bw FROM s, range(200) t(i))
SELECT point, round(x, 6) AS x, round(sum(n * exp(-0.5 * pow((x - mid) / bw, 2)) / (total * bw * sqrt(2 * pi()))), 6) AS density FROM m, g GROUP BY point, x""")
def g10_curve(spark, d):
    h = audit.histogram(table(spark, d, "events").select("value", "event_id"), "value")
    c = audit.density_curve(h)
    return c.select(F.col("point").cast("long").alias("point"), F.round("x", 6).alias("x"), F.round("density", 6).alias("density"))


@register("g12_distinct", "SELECT DISTINCT source FROM documents")
def g12(spark, d):
    return audit.distinct_values(documents(spark, d), "source")


@register("g13_quality_checks", f"""SELECT 'rows' AS "check", count(*) AS count FROM documents
UNION ALL SELECT 'deleted_or_removed', count(*) FILTER (WHERE regexp_matches(text, 'deleted|removed')) FROM documents
UNION ALL SELECT 'null_text', count(*) FILTER (WHERE text IS NULL) FROM documents
UNION ALL SELECT 'non_string_text', count(*) FILTER (WHERE text IS NULL) FROM documents
UNION ALL SELECT 'blank_text', count(*) FILTER (WHERE NOT {sql_nonblank('text')}) FROM documents""")
def g13(spark, d):
    return audit.quality_checks(documents(spark, d))


@register("g14_reconcile", SQL_FORUM + r""", t AS (SELECT id, CASE WHEN length(body) < 120 THEN '[deleted]' ELSE body END AS body, title, selftext FROM forum),
k AS (SELECT coalesce(body, selftext) AS text FROM t WHERE body IS NULL OR body <> '[deleted]')
SELECT (SELECT count(*) FROM t) AS original, (SELECT count(*) FROM k) AS kept,
(SELECT count(*) FROM t WHERE body = '[deleted]') AS identified,
(SELECT count(*) FROM k WHERE regexp_matches(text, '\[(deleted|removed)( by user)?\]')) AS missed,
(SELECT count(*) FROM t WHERE body IS NULL OR body <> '[deleted]') AS expected""")
def g14(spark, d):
    posts = as_forum(spark, d).withColumn("body", F.when(F.char_length("body") < 120, "[deleted]").otherwise(F.col("body")))
    kept = filters.drop_placeholders(posts).withColumn("text", F.coalesce("body", "selftext"))
    return audit.reconcile(posts, kept, ["body", "title", "selftext"])


@register("g16_column_summary", """SELECT 'doc_id' AS "column", 'bigint' AS type, count(doc_id) AS non_null, count(*) AS rows FROM documents
UNION ALL SELECT 'text', 'string', count(text), count(*) FROM documents UNION ALL SELECT 'lang', 'string', count(lang), count(*) FROM documents
UNION ALL SELECT 'source', 'string', count(source), count(*) FROM documents UNION ALL SELECT 'n_chars', 'bigint', count(n_chars), count(*) FROM documents""")
def g16(spark, d):
    return audit.column_summary(documents(spark, d))


@register("g17_bounds", f"""SELECT round(min({SQL_X}) - 1, 6) AS x_lo, round(max({SQL_X}) + 1, 6) AS x_hi,
round(min({SQL_Y}) - 1, 6) AS y_lo, round(max({SQL_Y}) + 1, 6) AS y_hi FROM embeddings""")
def g17(spark, d):
    b = audit.coordinate_bounds(points(spark, d))
    return b.select([F.round(c, 6).alias(c) for c in b.columns])


# --- sampling, order, union -----------------------------------------------------

@register("w1_sample_per_group")
def w1(spark, d):
    return sampling.sample_per_group(documents(spark, d).select("doc_id", "source"), "source", "doc_id", 200)


@register("w1_sample_sizes", "SELECT source, least(count(*), 20) AS n FROM documents GROUP BY source")
def w1_sizes(spark, d):
    rows = sampling.sample_per_group(documents(spark, d).select("doc_id", "source"), "source", "doc_id", 20)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("w2_top_per_group", """SELECT source, doc_id, n_chars FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 5""")
def w2(spark, d):
    return sampling.top_n(documents(spark, d).select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.asc("doc_id")], 5)


@register("o1_sorted", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY source")
def o1(spark, d):
    return documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


@register("o2_head", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 5")
def o2(spark, d):
    return sampling.head(documents(spark, d).select("doc_id", "source"), ["doc_id"], 5)


@register("o3_sample")
def o3(spark, d):
    return sampling.sample_rows(documents(spark, d).select("doc_id", "source"), "doc_id", 100)


@register("o4_halves", """SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= (SELECT count(*) // 2 FROM documents) THEN 1 ELSE 2 END AS half FROM documents""")
def o4(spark, d):
    a, b = sampling.split_halves(documents(spark, d).select("doc_id"), "doc_id")
    return a.withColumn("half", F.lit(1)).union(b.withColumn("half", F.lit(2)))


@register("u1_union", SQL_FORUM + """SELECT id, role, body, NULL AS title FROM forum WHERE role = 'user'
UNION ALL SELECT id, role, NULL, title FROM forum WHERE role <> 'user'""")
def u1(spark, d):
    posts = as_forum(spark, d)
    comments = posts.filter("role = 'user'").select("id", "role", "body")
    return comments.unionByName(posts.filter("role <> 'user'").select("role", "id", "title"), allowMissingColumns=True)


@register("u2_union_of_groups", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def u2(spark, d):
    """Per-group pieces are one grouped query, so no union is left."""
    means = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return means.select("event_type", "n", F.round("m", 6).alias("mean_value"))


@register("u3_topics_without_noise", "SELECT DISTINCT label - 1 AS topic FROM embeddings WHERE label <> 0")
def u3(spark, d):
    return audit.distinct_values(filters.drop_outliers(points(spark, d)), "topic")
