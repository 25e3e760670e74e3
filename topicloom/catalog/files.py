"""Queries of sources, sinks and hooks. Files are derived from the given tables."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..config import Clustering, Preprocessing, to_json
from ..operators import audit, explore, terms
from ..plans import preprocess
from ..session import scratch_path
from ..sources import files, store
from ..sources.vectors import VectorStore
from .corpus import SURVIVAL
from .tables import documents, register, sql_clean, sql_nonblank, sql_strip, sql_words, table
from .topics import LETTER_VECTORS, SQL_SOURCE_TOPIC, by_source, search_phrases, source_model, sql_ctfidf, sql_letters, words_of


def forum_files(spark: SparkSession, d: str) -> str:
    """A folder of forum files: one of comments, one of submissions with its
    columns in another order, one without text column, one of no community."""
    c = table(spark, d, "conversations")
    base = {
        "id": F.concat_ws("-", "conv_id", "turn"), "link_id": F.col("conv_id").cast("string"), "author": F.col("role"),
        "created_utc": F.lit(1700000000) + F.col("turn"), "subreddit": F.lit("talk"), "score": F.col("turn").cast("double"),
    }
    rows = c.withColumns(base)
    folder = scratch_path(spark, "forum")
    user = rows.filter("role = 'user'")
    other = rows.filter("role <> 'user'")
    files.write_csv(user.select(*base, F.col("text").alias("body")), f"{folder}/Talk_comments.csv")
    files.write_csv(other.select("score", "id", "author", F.col("role").alias("title"), F.col("text").alias("selftext"),
                                 F.col("link_id").alias("permalink"), "created_utc", "subreddit"), f"{folder}/talk_submissions.csv")
    files.write_csv(user.select("id", "author"), f"{folder}/talkative_comments.csv")
    files.write_csv(user.select("id", F.col("text").alias("body")), f"{folder}/other_comments.csv")
    return folder


_SQL_POSTS = "concat_ws('-', conv_id, turn) AS id, CAST(turn AS DOUBLE) AS score"


@register("s1_read_csv", f"SELECT {_SQL_POSTS}, nullif(text, '') AS body FROM conversations WHERE role = 'user'")
def s1(spark, d):
    """Quoted line ends and quotes survive; missing cells are null; types are cast."""
    path = f"{forum_files(spark, d)}/Talk_comments.csv"
    found = [r.path for r in files.list_files(spark, path).select("path").collect()]
    return files.read_csv(spark, found, files.TYPES).select("id", "score", "body")


@register("s2_scan_folder", "SELECT DISTINCT name FROM (SELECT CASE WHEN role = 'user' THEN unnest(['Talk_comments.csv', 'talkative_comments.csv']) ELSE 'talk_submissions.csv' END AS name FROM conversations)")
def s2(spark, d):
    found = files.scan_folder(spark, forum_files(spark, d), ["TALK"])
    return spark.createDataFrame(sorted({(name,) for _, name in found}), "name string")


@register("s3_file_kinds", """SELECT kind, count(*) AS rows FROM (SELECT CASE WHEN role = 'user' THEN 'comment' ELSE 'submission' END AS kind FROM conversations
WHERE role = 'user' OR """ + sql_nonblank("text") + ") GROUP BY kind")
def s3(spark, d):
    found = files.combine_folder(spark, forum_files(spark, d), ["talk"], with_file=True)
    kind = F.when(F.contains("source_file", F.lit("_comments")), "comment").otherwise("submission")
    return found.rows.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("rows"))


@register("s4_pruned_read", "SELECT doc_id, source FROM documents")
def s4(spark, d):
    return documents(spark, d).select("doc_id", "source")


@register("s5_manifest", f"""SELECT 'Talk_comments.csv' AS source_file, 'comment' AS kind, 'ok' AS status, count(*) AS rows FROM conversations WHERE role = 'user'
UNION ALL SELECT 'talk_submissions.csv', 'submission', 'ok', count(*) FROM conversations WHERE role <> 'user' AND {sql_nonblank('text')}
UNION ALL SELECT 'talkative_comments.csv', 'comment', 'missing_column', 0""")
def s5(spark, d):
    return files.combine_folder(spark, forum_files(spark, d), ["talk"]).manifest


@register("u1_combined_corpus", f"""SELECT {_SQL_POSTS}, CASE WHEN role = 'user' THEN CAST(conv_id AS VARCHAR) END AS link_id, role AS author, 1700000000 + turn AS created_utc,
'talk' AS subreddit, CASE WHEN role = 'user' THEN nullif(text, '') ELSE {sql_strip("role || ' ' || text")} END AS text
FROM conversations WHERE role = 'user' OR {sql_nonblank('text')}""")
def u1(spark, d):
    return files.combine_folder(spark, forum_files(spark, d), ["talk"]).rows


@register("s6_write_csv", f"SELECT doc_id, {sql_clean()} AS docs FROM documents WHERE {sql_clean()} <> ''")
def s6(spark, d):
    flagged = preprocess.flag_rows(documents(spark, d), Preprocessing.from_dict({
        "data_source": {"text_source_columns": ["text"], "unique_id_column": "doc_id", "required_columns_for_docs_creation": []},
        "preprocessing": {"cleaning": {"apply_char_filtering": True, "char_filter_regex": "[^a-zA-Z0-9\\s,.!?':;\\\"-]", "apply_lowercase": True}, "filters": {}},
    }))
    path = scratch_path(spark, "processed")
    files.write_csv(preprocess.kept_rows(flagged).select("doc_id", "docs"), path)
    found = [r.path for r in files.list_files(spark, path).select("path").collect()]
    return files.read_csv(spark, found, {"doc_id": "bigint"})


_SQL_MEANS = f"SELECT source, round(avg(n_chars), 6) AS mean_n_chars, round(avg({sql_words('text')}), 6) AS mean_words FROM documents GROUP BY source"


@register("s7_report_sheets", _SQL_MEANS)
def s7(spark, d):
    folder = scratch_path(spark, "report")
    rows = documents(spark, d).select("source", "n_chars", files.T.word_count("text").alias("words"))
    means = audit.group_means(rows, "source", ["n_chars", "words"])
    store.write_report({"means": means, "lengths": audit.range_counts(rows, audit.word_ranges(F.col("words")))}, folder)
    sheet = store.read_report(spark, folder, "means")
    return sheet.select("source", F.round("mean_n_chars", 6).alias("mean_n_chars"), F.round("mean_words", 6).alias("mean_words"))


@register("s8_read_sheet", f"WITH w AS (SELECT {sql_words('text')} AS n FROM documents) SELECT '200_or_more' AS range, CAST(count(*) FILTER (WHERE n >= 200) AS VARCHAR) AS count FROM w")
def s8(spark, d):
    folder = scratch_path(spark, "report")
    rows = documents(spark, d).select(files.T.word_count("text").alias("words"))
    store.write_report({"lengths": audit.range_counts(rows, audit.word_ranges(F.col("words")))}, folder, "csv")
    return store.read_report(spark, folder, "lengths", "csv").filter("range = '200_or_more'")


@register("s9_vectors", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square FROM embeddings")
def s9(spark, d):
    path = scratch_path(spark, "vectors")
    store.save_vectors(table(spark, d, "embeddings"), path, "vec_id")
    e = F.col("embedding").cast("array<double>")
    square = F.aggregate(F.transform(e, lambda x: x * x), F.lit(0.0), lambda a, x: a + x)
    return store.load_vectors(spark, path).select("vec_id", F.round(square, 6).alias("square"))


@register("s11_run_record", "SELECT 'run-' || source AS run_name, count(*) AS records FROM documents WHERE source IN ('src1', 'src2') GROUP BY source HAVING count(*) > 0".replace("count(*) AS records", "CAST(1 AS BIGINT) AS records"))
def s11(spark, d):
    path = scratch_path(spark, "runs")
    for r in documents(spark, d).filter(F.col("source").isin("src1", "src2")).select("source").distinct().collect():
        store.record_run(spark, path, f"run-{r.source}", Clustering(15, 5))
    runs = spark.read.schema("run_name string, ts timestamp, config string").json(path)
    return runs.filter(F.col("config") == to_json(Clustering(15, 5))).groupBy("run_name").agg(F.count(F.lit(1)).alias("records"))


@register("s12_cached", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def s12(spark, d):
    """The second call finds the table and does not compute."""
    path = scratch_path(spark, "cache")
    count = documents(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    store.cached(spark, path, lambda: count)
    return store.cached(spark, path, lambda: count.limit(0))


def grown_store(spark, d) -> tuple[VectorStore, object]:
    """A store that first met the even documents, then all."""
    docs = documents(spark, d).select("doc_id", "text")
    kept = VectorStore(spark, scratch_path(spark, "vectors"), LETTER_VECTORS)
    kept.add(docs.filter("doc_id % 2 = 0"))
    return kept, docs


@register("s12_incremental_vectors", """WITH t AS (SELECT text, min(doc_id % 2) AS half FROM documents GROUP BY text)
SELECT CAST(half + 1 AS BIGINT) AS batch, count(*) AS encoded FROM t GROUP BY half""")
def s12_incremental(spark, d):
    """After documents were added only their new texts are encoded."""
    kept, docs = grown_store(spark, d)
    kept.add(docs)
    kept.add(docs.limit(0))
    kept.add(docs)
    return kept.batches()


@register("e1_stored_vectors", f"""WITH v AS (SELECT doc_id, {sql_letters()} AS v FROM documents)
SELECT doc_id, array_to_string(list_transform(v, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ' ') AS counts FROM v""")
def e1_stored(spark, d):
    kept, docs = grown_store(spark, d)
    counts = F.transform("embedding", lambda x: x.cast("bigint").cast("string"))
    return kept.vectors(docs).select("doc_id", F.array_join(counts, " ").alias("counts"))


@register("s13_text_report", f"""WITH {sql_ctfidf(SQL_SOURCE_TOPIC)}, n AS (SELECT topic, count(*) AS count FROM docs GROUP BY topic),
rd AS (SELECT topic, doc_id, text, row_number() OVER (PARTITION BY topic ORDER BY n_chars DESC, doc_id) AS rank FROM docs QUALIFY rank <= 3),
h AS (SELECT unnest([1, 2, 3, 4]) AS section, -2 AS topic, 0 AS ord, unnest(['TOPICS:', 'TOPIC FREQUENCY:', 'TOPIC INFO:', 'REPRESENTATIVE DOCS:']) AS line),
i AS (SELECT topic, topic || '_' || string_agg(word, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name FROM tw GROUP BY topic)
SELECT * FROM h
UNION ALL SELECT 1, topic, 0, 'Topic ' || topic || ': ' || string_agg(word, ', ' ORDER BY rank) FROM tw GROUP BY topic
UNION ALL SELECT 2, 0, row_number() OVER (ORDER BY count DESC, topic), 'Topic ' || topic || ': ' || count || ' entries' FROM n
UNION ALL SELECT 3, topic, 0, 'Topic ' || topic FROM i UNION ALL SELECT 3, topic, 1, ' - Name: ' || name FROM i
UNION ALL SELECT 3, topic, 2, ' - Representation:' FROM i UNION ALL SELECT 3, topic, rank + 2, '   * ' || word FROM tw
UNION ALL SELECT 4, topic, 0, 'Topic ' || topic || ' representative docs:' FROM i UNION ALL SELECT 4, topic, rank, ' - ' || text FROM rd""")
def s13(spark, d):
    """The longest documents of a source stand for it."""
    rows = by_source(spark, d)
    words = words_of(rows)
    from ..operators.sampling import top_n

    longest = top_n(rows.select("topic", "doc_id", "n_chars", "text"), "topic", [F.desc("n_chars"), F.asc("doc_id")], 3, "rank")
    docs = longest.select("topic", "rank", F.col("text").alias("document"))
    return store.report_lines(words, explore.topic_frequency(rows), explore.topic_info(rows, words), docs)


@register("s13_search_report")
def search_report(spark, d):
    """Whole phrases searched in a model of all documents, with its words and representative documents."""
    model = source_model(spark, d)
    hits, _ = model.search(search_phrases(spark, d), 5)
    rows = documents(spark, d).select("doc_id", F.col("text").alias("document"))
    placed = LETTER_VECTORS.transform(rows, text_col="document").join(model.assignments.select("doc_id", "topic"), "doc_id")
    own = explore.representative_docs(placed, model.topic_vectors, 3)
    docs = own.join(rows, "doc_id").select("topic", "rank", "document")
    lines = store.search_lines(hits, model.words, docs)
    path = scratch_path(spark, "search")
    store.write_lines(lines, path)
    return spark.read.text(path)


@register("f2_dataset_hook", f"SELECT doc_id, {sql_clean()} AS docs FROM documents WHERE lang = 'en' AND {sql_clean()} <> ''")
def f2(spark, d):
    """A dataset-specific step runs before all rules."""
    cfg = Preprocessing(SURVIVAL.source, SURVIVAL.cleaning)
    flagged = preprocess.flag_rows(documents(spark, d), cfg, hook=lambda df: df.filter("lang = 'en'"))
    return preprocess.kept_rows(flagged).select("doc_id", "docs")


@register("f5_pluggable_words", f"WITH {sql_ctfidf(SQL_SOURCE_TOPIC)} SELECT topic, count(*) AS words FROM cw WHERE length(word) >= 5 GROUP BY topic")
def f5(spark, d):
    """A user's vocabulary table in place of the built-in choice."""
    rows = by_source(spark, d)
    long_words = terms.vocabulary(rows, "text").filter(F.char_length("word") >= 5)
    return terms.term_counts(rows, "topic", "text", vocab=long_words).groupBy("topic").agg(F.count(F.lit(1)).alias("words"))
