"""Queries of terms, topic models, exploration and plot data.

Topics are given by a table column (source, language or vector label), so
that every step can be checked in SQL without a clustering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Clustering, Modeling
from ..functions import tokens as K
from ..operators import clusterers, density, embed, explore, hierarchy, merging, outliers, represent, similarity, terms, trends, units
from ..plans import modeling
from ..session import materialize, scratch_path
from .corpus import SQL_PARAGRAPHS, SQL_SENTENCES, sql_units
from .tables import SQL_X, SQL_Y, documents, events, register, table, with_plane

SQL_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
SQL_SOURCE_TOPIC = "CAST(substr(source, 4) AS INTEGER)"
SQL_LANG_TOPIC = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'es' THEN 2 ELSE 3 END"


def by_source(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).withColumn("topic", F.substring("source", 4, 9).cast("int"))


def by_language(spark: SparkSession, d: str) -> DataFrame:
    lang = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).when(F.col("lang") == "es", 2).otherwise(3)
    return documents(spark, d).withColumn("topic", lang)


def with_noise(spark: SparkSession, d: str) -> DataFrame:
    """Languages as topics; one source counts as outliers."""
    return by_language(spark, d).withColumn("topic", F.when(F.col("source") == "src0", F.lit(-1)).otherwise(F.col("topic")))


SQL_NOISE_TOPIC = f"CASE WHEN source = 'src0' THEN -1 ELSE {SQL_LANG_TOPIC} END"


def sql_ctfidf(topic: str, rows: str = "documents") -> str:
    """CTEs up to ``ct(topic, word, tf, f, idf, raw, weight)``."""
    return f"""docs AS (SELECT *, {topic} AS topic FROM {rows}),
w AS (SELECT topic, unnest({SQL_TOKENS}) AS word FROM docs),
tf AS (SELECT topic, word, count(*) AS tf FROM w GROUP BY ALL),
tot AS (SELECT topic, CAST(sum(tf) AS BIGINT) AS words FROM tf GROUP BY topic),
ct AS (SELECT tf.topic, tf.word, tf.tf, CAST(sum(tf.tf) OVER (PARTITION BY tf.word) AS BIGINT) AS f,
 ln(1 + (SELECT avg(words) FROM tot) / sum(tf.tf) OVER (PARTITION BY tf.word)) AS idf, tot.words FROM tf JOIN tot USING (topic)),
cw AS (SELECT topic, word, tf, f, idf, tf * idf AS raw, tf / words * idf AS weight FROM ct),
tw AS (SELECT topic, word, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank FROM cw QUALIFY rank <= 10)"""


def weights_of(rows: DataFrame) -> DataFrame:
    return terms.ctfidf(terms.term_counts(rows, "topic", "text"))


def words_of(rows: DataFrame) -> DataFrame:
    return terms.top_words(weights_of(rows), 10)


# --- tokens and terms -----------------------------------------------------------

@register("c15_tokens", f"SELECT doc_id, array_to_string({SQL_TOKENS}, '|') AS tokens FROM documents")
def c15(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(K.tokenize("text"), "|").alias("tokens"))


@register("c16_ngrams", f"""WITH t AS (SELECT doc_id, list_filter({SQL_TOKENS}, lambda x: x NOT IN ('the', 'and', 'der', 'de', 'la')) AS t FROM documents)
SELECT doc_id, array_to_string(t || list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1]), '|') AS grams FROM t""")
def c16(spark, d):
    grams = K.terms("text", (1, 2), ("the", "and", "der", "de", "la"))
    return documents(spark, d).select("doc_id", F.array_join(grams, "|").alias("grams"))


@register("c17_word_labels", f"""WITH {sql_ctfidf(SQL_SOURCE_TOPIC)}
SELECT topic, string_agg(word, ' - ' ORDER BY rank) FILTER (WHERE rank <= 3) AS label,
string_agg(word || ' (' || printf('%.2f', weight) || ')', ', ' ORDER BY rank) AS weighted FROM tw GROUP BY topic""")
def c17(spark, d):
    r = terms.representations(words_of(by_source(spark, d)))
    return r.select("topic", K.words_label(F.transform("pairs", lambda p: p["word"])).alias("label"), K.words_with_weights(F.col("pairs")).alias("weighted"))


@register("g1_vocab", f"WITH w AS (SELECT unnest({SQL_TOKENS}) AS word FROM documents) SELECT word, count(*) AS count FROM w GROUP BY word HAVING count(*) >= 30")
def g1(spark, d):
    return terms.vocabulary(documents(spark, d), "text", 30)


@register("g1_vocab_case_kept", f"WITH w AS (SELECT unnest({SQL_TOKENS.replace('lower(text)', 'text')}) AS word FROM documents) SELECT word, count(*) AS count FROM w GROUP BY word HAVING count(*) >= 30")
def g1_case(spark, d):
    return terms.vocabulary(documents(spark, d), "text", 30, lowercase=False)


@register("m4_count_vectorizer", f"""WITH {sql_ctfidf(SQL_SOURCE_TOPIC)} SELECT topic, word, tf FROM cw WHERE f >= 30""")
def m4(spark, d):
    rows = by_source(spark, d)
    return terms.term_counts(rows, "topic", "text", vocab=terms.vocabulary(rows, "text", 30))


@register("m5_ctfidf", f"WITH {sql_ctfidf(SQL_SOURCE_TOPIC)} SELECT topic, word, tf, f, round(raw, 6) AS weight FROM cw")
def m5(spark, d):
    c = terms.ctfidf(terms.term_counts(by_source(spark, d), "topic", "text"), normalize=False)
    return c.select("topic", "word", "tf", "f", F.round("weight", 6).alias("weight"))


@register("m5_ctfidf_normalized", f"WITH {sql_ctfidf(SQL_SOURCE_TOPIC)} SELECT topic, word, round(idf, 6) AS idf, round(weight, 9) AS weight FROM cw")
def m5_l1(spark, d):
    return weights_of(by_source(spark, d)).select("topic", "word", F.round("idf", 6).alias("idf"), F.round("weight", 9).alias("weight"))


@register("m6_top_words", f"WITH {sql_ctfidf(SQL_SOURCE_TOPIC)} SELECT topic, rank, word, round(weight, 9) AS weight FROM tw")
def m6(spark, d):
    return words_of(by_source(spark, d)).select("topic", "rank", "word", F.round("weight", 9).alias("weight"))


# --- topics from labels, vectors ------------------------------------------------

@register("m2_given_clusters", """WITH s AS (SELECT lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY lang),
r AS (SELECT lang, row_number() OVER (ORDER BY n DESC, first) - 1 AS topic FROM s) SELECT doc_id, topic FROM documents JOIN r USING (lang)""")
def m2(spark, d):
    rows = documents(spark, d).select("doc_id", F.col("lang").alias("cluster"))
    return density.number_topics(rows).select("doc_id", "topic")


@register("m3_topic_ids", """WITH s AS (SELECT label, count(*) AS n, min(vec_id) AS first FROM embeddings WHERE label <> 0 GROUP BY label),
r AS (SELECT label, row_number() OVER (ORDER BY n DESC, first) - 1 AS topic FROM s) SELECT vec_id, coalesce(topic, -1) AS topic FROM embeddings LEFT JOIN r USING (label)""")
def m3(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", (F.col("label") - 1).alias("cluster"))
    return density.number_topics(rows, "vec_id").select("vec_id", "topic")


@register("m11_min_topic_size", """WITH s AS (SELECT source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY source HAVING count(*) >= (SELECT avg(c) FROM (SELECT count(*) AS c FROM documents GROUP BY source))),
r AS (SELECT source, row_number() OVER (ORDER BY n DESC, first) - 1 AS topic FROM s) SELECT doc_id, coalesce(topic, -1) AS topic FROM documents LEFT JOIN r USING (source)""")
def m11(spark, d):
    rows = documents(spark, d).select("doc_id", F.col("source").alias("cluster"))
    mean = rows.groupBy("cluster").count().agg(F.ceil(F.avg("count"))).first()[0]
    return density.number_topics(rows, min_topic_size=mean).select("doc_id", "topic")


SQL_VECTORS = """dims AS (SELECT label AS topic, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
means AS (SELECT topic, dim, avg(v) AS v FROM dims GROUP BY ALL),
tv AS (SELECT topic, list(v ORDER BY dim) AS vector FROM means GROUP BY topic),
sims AS (SELECT vec_id, label, t.topic, list_cosine_similarity(embedding::DOUBLE[], vector) AS similarity FROM embeddings, tv t)"""


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").withColumnRenamed("label", "topic")


def centres(spark: SparkSession, d: str) -> DataFrame:
    return similarity.mean_vectors(vectors(spark, d), "topic")


@register("m25_topic_vectors", f"WITH {SQL_VECTORS} SELECT topic, CAST(dim AS BIGINT) AS dim, round(v, 6) AS value FROM means")
def m25(spark, d):
    c = centres(spark, d).select("topic", F.posexplode("vector").alias("dim", "v"))
    return c.select("topic", (F.col("dim") + 1).cast("long").alias("dim"), F.round("v", 6).alias("value"))


@register("j7_topic_similarity", f"WITH {SQL_VECTORS} SELECT vec_id, topic, round(similarity, 6) AS similarity FROM sims")
def j7(spark, d):
    """Every vector with every topic."""
    s = similarity.similarities(table(spark, d, "embeddings"), centres(spark, d), "vec_id")
    return s.select("vec_id", "topic", F.round("similarity", 6).alias("similarity"))


@register("m10_probabilities", f"""WITH {SQL_VECTORS}, p AS (SELECT vec_id, topic, similarity, greatest(similarity, 0) AS p FROM sims),
q AS (SELECT vec_id, topic, p, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM p)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, topic) AS rank, topic, round(q, 6) AS probability FROM q""")
def m10(spark, d):
    """All topics of every vector, the most probable first."""
    p = similarity.top_probabilities(table(spark, d, "embeddings"), centres(spark, d), None, "vec_id")
    return p.select("vec_id", "rank", "topic", F.round("probability", 6).alias("probability"))


@register("m10_probability_arrays", f"""WITH {SQL_VECTORS}, p AS (SELECT vec_id, topic, greatest(similarity, 0) AS p FROM sims),
q AS (SELECT vec_id, topic, p / sum(p) OVER (PARTITION BY vec_id) AS q FROM p)
SELECT vec_id, string_agg(printf('%.4f', q), ' ' ORDER BY topic) AS probabilities FROM q GROUP BY vec_id""")
def m10_arrays(spark, d):
    p = similarity.probability_arrays(table(spark, d, "embeddings"), centres(spark, d), "vec_id")
    text = F.array_join(F.transform("probabilities", lambda x: F.format_string("%.4f", x)), " ")
    return p.select("vec_id", text.alias("probabilities"))


@register("m14_assign", f"""WITH {SQL_VECTORS},
h AS (SELECT topic, floor(similarity * 2000) AS b, count(*) AS n FROM sims WHERE topic = label GROUP BY ALL),
r AS (SELECT topic, b, sum(n) OVER (PARTITION BY topic ORDER BY b) AS r, sum(n) OVER (PARTITION BY topic) AS t FROM h),
fl AS (SELECT topic, min(b) / 2000 AS floor FROM r WHERE r >= t * 0.05 GROUP BY topic),
best AS (SELECT vec_id, topic, similarity FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, topic) = 1)
SELECT vec_id, CASE WHEN similarity < floor THEN -1 ELSE topic END AS topic, round(similarity, 6) AS similarity FROM best JOIN fl USING (topic)""")
def m14(spark, d):
    own = explore.own_similarity(vectors(spark, d), centres(spark, d), "vec_id")
    out = similarity.assign(table(spark, d, "embeddings"), centres(spark, d), similarity.similarity_floor(own), "vec_id")
    return out.select("vec_id", "topic", F.round("similarity", 6).alias("similarity"))


# --- representation -------------------------------------------------------------

LETTERS = "aeinorst"


def count_letters(texts):
    """A stand-in for a user's encoder that SQL can follow: how often some letters occur."""
    import numpy as np

    return np.array([[t.count(c) for c in LETTERS] for t in texts], dtype=np.float32)


def letter_encoder():
    return count_letters


embed.register_encoder("letters", letter_encoder)
LETTER_VECTORS = embed.NamedEmbedding("letters")


def sql_letters(e: str = "text") -> str:
    return "[" + ", ".join(f"CAST(length({e}) - length(replace({e}, '{c}', '')) AS DOUBLE)" for c in LETTERS) + "]"


def docs_with_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents by language, and their letter vectors."""
    docs = by_language(spark, d)
    return docs, LETTER_VECTORS.transform(docs)


SQL_DOC_VECTORS = f"""dv AS (SELECT *, {sql_letters()} AS embedding FROM documents),
{sql_ctfidf(SQL_LANG_TOPIC, 'dv')},
cand AS (SELECT topic, word FROM cw QUALIFY row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) <= 100),
dims AS (SELECT doc_id, topic, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM docs),
tm AS (SELECT topic, dim, avg(v) AS v FROM dims GROUP BY ALL),
tv AS (SELECT topic, list(v ORDER BY dim) AS vector FROM tm GROUP BY topic),
held AS (SELECT DISTINCT doc_id, unnest({SQL_TOKENS}) AS word FROM docs),
wm AS (SELECT word, dim, avg(v) AS v FROM (SELECT * FROM held SEMI JOIN cand USING (word)) JOIN dims USING (doc_id) GROUP BY ALL),
wv AS (SELECT word, list(v ORDER BY dim) AS wvec FROM wm GROUP BY word),
ks AS (SELECT topic, word, round(list_cosine_similarity(wvec, vector), 10) AS sim FROM cand JOIN wv USING (word) JOIN tv USING (topic))"""


def representation_inputs(spark: SparkSession, d: str, config=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs, v = docs_with_vectors(spark, d)
    docs = docs.select("doc_id", "topic", "text")
    w, v = materialize(weights_of(docs)), materialize(v)
    tv = similarity.mean_vectors(v.join(docs.select("doc_id", "topic"), "doc_id"), "topic")
    wv = represent.word_vectors(docs, v, terms.top_words(w, represent.most_candidates(config)))
    return w, materialize(tv), materialize(wv)


@register("m7_keywords", f"""WITH {SQL_DOC_VECTORS} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, word) AS rank, word, round(sim, 6) AS weight
FROM ks QUALIFY rank <= 10""")
def m7(spark, d):
    out = represent.keywords_by_similarity(*representation_inputs(spark, d))
    return out.select("topic", "rank", "word", F.round("weight", 6).alias("weight"))


@register("m8_mmr")
def m8(spark, d):
    w, tv, wv = representation_inputs(spark, d)
    return represent.diverse_words(terms.top_words(w, 30), tv, wv, 0.3)


@register("m9_aspects")
def m9(spark, d):
    steps = [
        {"model_name": "keywords", "params": {"top_n_words": 10}},
        {"aspect_name": "varied", "chain": [{"model_name": "keywords", "params": {"top_n_words": 20}},
                                            {"model_name": "diverse", "params": {"diversity": 0.3}}]},
    ]
    return represent.aspects(steps, *representation_inputs(spark, d, steps))


@register("m9_main_and_keywords", f"""WITH {SQL_DOC_VECTORS},
kr AS (SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, word) AS rank, word, sim FROM ks QUALIFY rank <= 10)
SELECT 'Main' AS aspect, topic, rank, word, round(weight, 6) AS weight FROM tw
UNION ALL SELECT 'aspect_0', topic, rank, word, round(sim, 6) FROM kr""")
def m9_keywords(spark, d):
    out = represent.aspects([{"model_name": "keywords"}], *representation_inputs(spark, d))
    return out.withColumn("weight", F.round("weight", 6))


#: settings as files of other tools have them
TRAINING = {
    "reduction_params": {"n_components": 4, "n_neighbors": 15, "metric": "cosine"},
    "clustering_params": {"min_cluster_size": 20, "cluster_selection_method": "leaf"},
    "vectorizer_params": {"ngram_range": [1, 1], "stop_words": None, "min_df": 2},
    "model_params": {"top_n_words": 8, "min_topic_size": 1, "verbose": True},
    "representation_params": [{"model_name": "KeyBERTInspired", "aspect_name": "near", "params": {"top_n_words": 6, "nr_candidate_words": 40}}],
}


_SQL_TRAINED = f"""WITH r AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) - 1 AS numbered FROM documents GROUP BY lang),
dv AS (SELECT d.*, numbered, {sql_letters()} AS embedding FROM documents d JOIN r USING (lang)),
docs AS (SELECT *, numbered AS topic FROM dv),
w AS (SELECT topic, unnest({SQL_TOKENS}) AS word FROM docs),
tf AS (SELECT topic, word, count(*) AS tf FROM w GROUP BY topic, word QUALIFY sum(count(*)) OVER (PARTITION BY word) >= 2),
tot AS (SELECT topic, CAST(sum(tf) AS BIGINT) AS words FROM tf GROUP BY topic),
ct AS (SELECT tf.topic, tf.word, tf.tf, ln(1 + (SELECT avg(words) FROM tot) / sum(tf.tf) OVER (PARTITION BY tf.word)) AS idf, tot.words FROM tf JOIN tot USING (topic)),
cw AS (SELECT topic, word, tf / words * idf AS weight FROM ct),
cand AS (SELECT topic, word, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank FROM cw QUALIFY rank <= 40),
dims AS (SELECT doc_id, topic, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim FROM docs),
tv AS (SELECT topic, list(v ORDER BY dim) AS vector FROM (SELECT topic, dim, avg(v) AS v FROM dims GROUP BY ALL) GROUP BY topic),
held AS (SELECT DISTINCT doc_id, unnest({SQL_TOKENS}) AS word FROM docs),
wv AS (SELECT word, list(v ORDER BY dim) AS wvec FROM (SELECT word, dim, avg(v) AS v FROM (SELECT * FROM held SEMI JOIN cand USING (word)) JOIN dims USING (doc_id) GROUP BY ALL) GROUP BY word),
ks AS (SELECT topic, word, round(list_cosine_similarity(wvec, vector), 10) AS sim FROM cand JOIN wv USING (word) JOIN tv USING (topic)),
nr AS (SELECT topic, word, sim, row_number() OVER (PARTITION BY topic ORDER BY sim DESC, word) AS rank FROM ks QUALIFY rank <= 6)"""


def trained(spark: SparkSession, d: str) -> modeling.TopicModel:
    docs, v = docs_with_vectors(spark, d)
    labels = docs.select("doc_id", F.col("lang").alias("cluster"))
    return modeling.fit(docs.select("doc_id", "text"), materialize(v), Modeling.from_dict(TRAINING), labels=labels, embedding=LETTER_VECTORS)


@register("m13_training_settings", _SQL_TRAINED + """ SELECT 'Main' AS aspect, topic, rank, word, round(weight, 6) AS weight FROM cand WHERE rank <= 8
UNION ALL SELECT 'near', topic, rank, word, round(sim, 6) FROM nr""")
def m13(spark, d):
    """A model trained by component settings, with a representation step, saved and loaded: its words and aspects."""
    path = scratch_path(spark, "trained")
    trained(spark, d).save(path)
    return modeling.load_model(spark, path).aspects.withColumn("weight", F.round("weight", 6))


@register("q3_topic_info_aspects", _SQL_TRAINED + """, n AS (SELECT topic, count(*) AS count FROM docs GROUP BY topic),
m AS (SELECT topic, string_agg(word, ', ' ORDER BY rank) AS representation, topic || '_' || string_agg(word, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name FROM cand WHERE rank <= 8 GROUP BY topic),
o AS (SELECT topic, string_agg(word, ', ' ORDER BY rank) AS near FROM nr GROUP BY topic)
SELECT topic, count, name, representation, near FROM n JOIN m USING (topic) JOIN o USING (topic)""")
def q3_aspects(spark, d):
    """Topic info of a trained model, with a column of words per aspect."""
    info = trained(spark, d).info()
    return info.withColumns({c: F.array_join(c, ", ") for c in ("representation", "near")})


# --- outliers -------------------------------------------------------------------

SQL_WORD_SIDE = f"""{sql_ctfidf(SQL_NOISE_TOPIC)},
nrm AS (SELECT topic, sqrt(sum(weight * weight)) AS norm FROM cw WHERE topic <> -1 GROUP BY topic),
tu AS (SELECT topic, word, idf, weight / norm AS u FROM cw JOIN nrm USING (topic)),
bw AS (SELECT word, max(idf) AS idf FROM tu GROUP BY word)"""


@register("m15_outliers_by_terms", f"""WITH {SQL_WORD_SIDE},
oc AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest({SQL_TOKENS}) AS word FROM docs WHERE topic = -1) GROUP BY ALL),
nb AS (SELECT doc_id, sqrt(sum((oc.tf * idf) * (oc.tf * idf))) AS norm FROM oc JOIN bw USING (word) GROUP BY doc_id),
dots AS (SELECT doc_id, topic, sum(oc.tf * idf * u) AS dot FROM oc JOIN tu USING (word) GROUP BY ALL),
best AS (SELECT doc_id, topic, dot / norm AS s FROM dots JOIN nb USING (doc_id) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY dot / norm DESC, topic) = 1)
SELECT docs.doc_id, CASE WHEN docs.topic <> -1 THEN docs.topic WHEN s >= 0.1 THEN best.topic ELSE -1 END AS topic FROM docs LEFT JOIN best USING (doc_id)""")
def m15(spark, d):
    rows = with_noise(spark, d)
    return outliers.reduce_by_terms(rows.select("doc_id", "topic"), rows, materialize(weights_of(rows)), 0.1).select("doc_id", "topic")


@register("m16_outliers_by_distribution", f"""WITH {SQL_WORD_SIDE},
tk AS (SELECT doc_id, {SQL_TOKENS} AS t FROM docs WHERE topic = -1),
wn AS (SELECT doc_id, unnest(range(1, greatest(len(t) - 3, 1) + 1)) AS win, t FROM tk WHERE len(t) > 0),
wt AS (SELECT doc_id, win, unnest(t[win:win + 3]) AS word FROM wn),
oc AS (SELECT doc_id, win, word, count(*) AS tf FROM wt GROUP BY ALL),
nb AS (SELECT doc_id, win, sqrt(sum((oc.tf * idf) * (oc.tf * idf))) AS norm FROM oc JOIN bw USING (word) GROUP BY ALL),
dots AS (SELECT doc_id, win, topic, sum(oc.tf * idf * u) AS dot FROM oc JOIN tu USING (word) GROUP BY ALL),
sc AS (SELECT doc_id, topic, sum(dot / norm) AS s FROM dots JOIN nb USING (doc_id, win) WHERE norm > 0 GROUP BY ALL),
best AS (SELECT doc_id, topic, s FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, topic) = 1)
SELECT docs.doc_id, CASE WHEN docs.topic <> -1 THEN docs.topic WHEN s > 0 THEN best.topic ELSE -1 END AS topic FROM docs LEFT JOIN best USING (doc_id)""")
def m16(spark, d):
    rows = with_noise(spark, d)
    return outliers.reduce_by_distribution(rows.select("doc_id", "topic"), rows, materialize(weights_of(rows))).select("doc_id", "topic")


@register("m19_updated_words", f"""WITH re AS (SELECT *, CASE WHEN source = 'src0' THEN 0 ELSE {SQL_LANG_TOPIC} END AS new_topic FROM documents),
{sql_ctfidf('new_topic', 're')} SELECT topic, rank, word, round(weight, 9) AS weight FROM tw""")
def m19(spark, d):
    """Words after all outliers moved to topic 0."""
    moved = with_noise(spark, d).withColumn("topic", F.when(F.col("topic") == -1, 0).otherwise(F.col("topic")))
    return words_of(moved).select("topic", "rank", "word", F.round("weight", 9).alias("weight"))


# --- hierarchy ------------------------------------------------------------------

@register("m17_hierarchy")
def m17(spark, d):
    return hierarchy.topic_hierarchy(centres(spark, d), "ward")


@register("f3_linkages")
def f3(spark, d):
    """First and last merge distance under each linkage."""
    c, out = centres(spark, d), None
    for name in hierarchy.LINKAGES:
        part = hierarchy.topic_hierarchy(c, name).agg(F.min("distance").alias("first"), F.max("distance").alias("last")).select(F.lit(name).alias("linkage"), "first", "last")
        out = part if out is None else out.unionByName(part)
    return out


@register("m18_topic_tree")
def m18(spark, d):
    """Tree of the languages: labels and vectors come from the same documents."""
    docs, v = docs_with_vectors(spark, d)
    means = similarity.mean_vectors(v.join(docs.select("doc_id", "topic"), "doc_id"), "topic")
    return hierarchy.topic_tree(hierarchy.topic_hierarchy(means, "average"), explore.topic_labels(words_of(docs)))


@register("m12_reduced_topics")
def m12(spark, d):
    rows = vectors(spark, d).select("vec_id", "topic")
    return hierarchy.reduce_topics(rows, hierarchy.topic_hierarchy(centres(spark, d), "average"), 4, "vec_id").select("vec_id", "topic")


# --- time and communities -------------------------------------------------------

@register("m20_event_trend", """WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events)
SELECT event_type AS topic, make_timestamp(CAST(lo + floor(least(9, floor((epoch_us(ts) - lo) * 10 / (hi - lo))) * (hi - lo) / 10) AS BIGINT)) AS timestamp,
count(*) AS frequency FROM events, b GROUP BY ALL""")
def m20(spark, d):
    rows = trends.with_time_bin(events(spark, d), "ts", 10)
    return trends.frequencies(rows, "event_type").select("topic", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "frequency")


@register("m20_weekly_trend", """SELECT event_type AS topic, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-01') AS timestamp, count(*) AS frequency FROM events GROUP BY ALL""")
def m20_week(spark, d):
    rows = trends.with_time_bin(events(spark, d), "ts", every="7 days")
    return trends.frequencies(rows, "event_type").select("topic", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "frequency")


def dated(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a topic and the time of the event of the same number."""
    when = events(spark, d).select(F.col("event_id").alias("doc_id"), "ts")
    return by_language(spark, d).select("doc_id", "topic", "text").join(when, "doc_id")


_SQL_TREND = f"""WITH dt AS (SELECT d.*, e.ts FROM documents d JOIN events e ON d.doc_id = e.event_id),
{sql_ctfidf(SQL_LANG_TOPIC, 'dt')},
b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM dt),
bd AS (SELECT docs.*, CAST(lo + floor(least(4, floor((epoch_us(ts) - lo) * 5 / (hi - lo))) * (hi - lo) / 5) AS BIGINT) AS us FROM docs, b),
fr AS (SELECT topic, us, count(*) AS frequency FROM bd GROUP BY ALL),
lt AS (SELECT topic, us, word, count(*) AS tf FROM (SELECT topic, us, unnest({SQL_TOKENS}) AS word FROM bd) GROUP BY ALL),
lx AS (SELECT l.topic, us, word, l.tf * c.idf AS x, c.weight / sum(c.weight) OVER (PARTITION BY l.topic, us) AS unused FROM lt l JOIN cw c USING (topic, word)),
ov AS (SELECT topic, word, weight / sum(weight) OVER (PARTITION BY topic) AS o FROM cw),
sc AS (SELECT lx.topic, us, word, (x / sum(x) OVER (PARTITION BY lx.topic, us) + o) / 2 AS weight FROM lx JOIN ov USING (topic, word)),
nb AS (SELECT us, row_number() OVER (ORDER BY us) AS b FROM (SELECT DISTINCT us FROM bd)),
ch AS (SELECT topic, us, b, b - row_number() OVER (PARTITION BY topic ORDER BY b) AS chain FROM (SELECT DISTINCT topic, us FROM bd) JOIN nb USING (us)),
st AS (SELECT *, min(b) OVER (PARTITION BY topic, chain) AS b0 FROM ch),
ev AS (SELECT x.topic, x.us, word, round(sum(weight * pow(0.5, x.b - y.b + CASE WHEN y.b = y.b0 THEN 0 ELSE 1 END)), 12) AS weight
 FROM st x JOIN st y ON x.topic = y.topic AND x.chain = y.chain AND y.b <= x.b JOIN sc ON sc.topic = y.topic AND sc.us = y.us GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY topic, us ORDER BY weight DESC, word) AS rank FROM {{weights}} QUALIFY rank <= 5),
wl AS (SELECT topic, us, string_agg(word, ', ' ORDER BY rank) AS words FROM rk GROUP BY ALL)
SELECT topic, words, frequency, make_timestamp(us) AS timestamp FROM fr JOIN wl USING (topic, us)"""


def trend(spark: SparkSession, d: str, **settings) -> DataFrame:
    out = trends.topics_over_time(dated(spark, d), "ts", nr_bins=5, **settings)
    return out.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@register("m20_topics_over_time", _SQL_TREND.replace("{weights}", "ev"))
def m20_words(spark, d):
    return trend(spark, d)


@register("m20_without_evolution", _SQL_TREND.replace("{weights}", "sc"))
def m20_plain(spark, d):
    return trend(spark, d, evolution_tuning=False)


@register("m21_chosen_trend", _SQL_TREND.replace("{weights}", "ev") + " WHERE topic IN (0, 2)")
def m21(spark, d):
    return trend(spark, d, topics=[0, 2])


_SQL_SHARE = f"""WITH c AS (SELECT source AS community, {SQL_LANG_TOPIC} AS topic, count(*) AS count FROM documents GROUP BY ALL),
s AS (SELECT *, round(count / sum(count) OVER (PARTITION BY community), 6) AS share FROM c) """


@register("g18_prevalence", _SQL_SHARE + "SELECT * FROM s")
def g18(spark, d):
    p = trends.prevalence(by_language(spark, d), "source")
    return p.withColumn("share", F.round("share", 6))


@register("g18_prevalence_table", _SQL_SHARE + """SELECT topic, coalesce(max(share) FILTER (WHERE community = 'src1'), 0.0)::DOUBLE AS src1,
coalesce(max(share) FILTER (WHERE community = 'src2'), 0.0)::DOUBLE AS src2 FROM s GROUP BY topic""")
def g18_table(spark, d):
    p = trends.prevalence(by_language(spark, d), "source").withColumn("share", F.round("share", 6))
    return trends.prevalence_table(p, ["src1", "src2"])


# --- merging --------------------------------------------------------------------

PLAIN = Modeling(min_topic_size=1, stop_words=None)


def halves(spark: SparkSession, d: str) -> list[modeling.TopicModel]:
    """Two models: even documents by language, odd ones by source."""
    docs, v = docs_with_vectors(spark, d)
    rows = docs.select("doc_id", "text", "topic", F.substring("source", 4, 9).cast("int").alias("other"))
    v = materialize(v)
    out = []
    for half, topic in ((0, "topic"), (1, "other")):
        part = materialize(rows.filter(F.col("doc_id") % 2 == half).select("doc_id", F.col(topic).alias("topic"), "text"))
        assigned = part.select("doc_id", "topic", F.lit(1.0).alias("strength"))
        out.append(modeling.describe(assigned, part, v, PLAIN, embedding=LETTER_VECTORS))
    return out


_SQL_MERGE = f"""WITH dv AS (SELECT doc_id, doc_id % 2 AS half, {SQL_LANG_TOPIC} AS a, {SQL_SOURCE_TOPIC} AS b, unnest({sql_letters()}) AS v, generate_subscripts({sql_letters()}, 1) AS dim FROM documents),
va AS (SELECT a, list(v ORDER BY dim) AS vec FROM (SELECT a, dim, avg(v) AS v FROM dv WHERE half = 0 GROUP BY ALL) GROUP BY a),
vb AS (SELECT b, list(v ORDER BY dim) AS vec FROM (SELECT b, dim, avg(v) AS v FROM dv WHERE half = 1 GROUP BY ALL) GROUP BY b),
best AS (SELECT b, a, list_cosine_similarity(vb.vec, va.vec) AS s FROM vb, va QUALIFY row_number() OVER (PARTITION BY b ORDER BY s DESC, a) = 1),
m AS (SELECT b AS topic, CASE WHEN s >= 0.99 THEN a ELSE (SELECT max(a) FROM va) + row_number() OVER (PARTITION BY s >= 0.99 ORDER BY b) END AS merged, s FROM best),
mp AS (SELECT 0 AS model, a AS topic, CAST(a AS BIGINT) AS merged_topic, CAST(NULL AS DOUBLE) AS similarity FROM va
 UNION ALL SELECT 1, topic, CAST(merged AS BIGINT), round(s, 6) FROM m),
asg AS (SELECT *, doc_id % 2 AS model, CASE doc_id % 2 WHEN 0 THEN {SQL_LANG_TOPIC} ELSE {SQL_SOURCE_TOPIC} END AS topic FROM documents),
joined AS (SELECT asg.* EXCLUDE (topic, model), merged_topic FROM asg JOIN mp USING (model, topic))"""


@register("m22_merge_mapping", _SQL_MERGE + " SELECT * FROM mp")
def m22(spark, d):
    _, mapping = modeling.merge(halves(spark, d), 0.99)
    return mapping.select("model", "topic", F.col("merged_topic").cast("long").alias("merged_topic"), F.round("similarity", 6).alias("similarity"))


@register("m22_merged_assignments", _SQL_MERGE + " SELECT merged_topic AS topic, count(*) AS n FROM joined GROUP BY merged_topic")
def m22_rows(spark, d):
    merged, _ = modeling.merge(halves(spark, d), 0.99)
    return merged.assignments.groupBy(F.col("topic").cast("long").alias("topic")).agg(F.count(F.lit(1)).alias("n"))


@register("m22_merged_model", f"""{_SQL_MERGE}, {sql_ctfidf("merged_topic", "joined")}, n AS (SELECT topic, count(*) AS count FROM docs GROUP BY topic),
mv AS (SELECT topic, sqrt(sum(v * v)) AS length FROM (SELECT merged_topic AS topic, dim, avg(v) AS v FROM joined JOIN dv USING (doc_id) GROUP BY ALL) GROUP BY topic)
SELECT topic, count, string_agg(word, ', ' ORDER BY rank) AS words, round(length, 6) AS length FROM n JOIN tw USING (topic) JOIN mv USING (topic) GROUP BY ALL""")
def m22_model(spark, d):
    """Counts, words and lengths of the vectors of a merged model that was saved and loaded: those of all documents together."""
    merged, _ = modeling.merge(halves(spark, d), 0.99)
    path = scratch_path(spark, "merged")
    merged.save(path)
    model = modeling.load_model(spark, path)
    lengths = model.topic_vectors.select("topic", F.round(embed.V.norm("vector"), 6).alias("length"))
    return model.info().join(lengths, "topic").select(F.col("topic").cast("long").alias("topic"), "count", F.array_join("representation", ", ").alias("words"), "length")


@register("m23_compare_models", _SQL_MERGE + " SELECT 'first' AS model, count(*) AS n_topics FROM va UNION ALL SELECT 'second', count(*) FROM vb UNION ALL SELECT 'merged', count(DISTINCT merged_topic) FROM mp")
def m23(spark, d):
    models = halves(spark, d)
    merged, _ = modeling.merge(models, 0.99)
    return merging.compare_sizes({"first": models[0].topic_vectors, "second": models[1].topic_vectors, "merged": merged.topic_vectors})


# --- models of units ------------------------------------------------------------

def unit_model(spark: SparkSession, d: str, make) -> tuple[modeling.TopicModel, DataFrame]:
    """A model of units by the language of their documents, and the topics it gives all of them."""
    parts = materialize(make(documents(spark, d).select("doc_id", "text", "lang")))
    labels = units.with_unit_key(parts).select("unit", F.col("lang").alias("cluster"))
    model, vectors = modeling.fit_units(parts, LETTER_VECTORS, PLAIN, labels)
    return model, model.transform(vectors)


def sql_unit_topics(pieces: str) -> str:
    """CTEs up to ``ut(doc_id, unit_id, topic)``."""
    return f"""WITH un AS ({sql_units(pieces, "unit")}),
ul AS (SELECT un.*, lang, {sql_letters("un.text")} AS vec FROM un JOIN documents d ON un.doc_id = CAST(d.doc_id AS VARCHAR)),
r AS (SELECT lang, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) - 1 AS topic FROM ul GROUP BY lang),
uv AS (SELECT doc_id, unit_id, topic AS own, vec FROM ul JOIN r USING (lang)),
dims AS (SELECT own AS topic, unnest(vec) AS v, generate_subscripts(vec, 1) AS dim FROM uv),
tv AS (SELECT topic, list(v ORDER BY dim) AS vector FROM (SELECT topic, dim, avg(v) AS v FROM dims GROUP BY ALL) GROUP BY topic),
sims AS (SELECT doc_id, unit_id, own, t.topic, CASE WHEN list_sum(vec) = 0 THEN 0.0 ELSE list_cosine_similarity(vec, vector) END AS similarity FROM uv, tv t),
h AS (SELECT topic, floor(similarity * 2000) AS b, count(*) AS n FROM sims WHERE topic = own GROUP BY ALL),
rr AS (SELECT topic, b, sum(n) OVER (PARTITION BY topic ORDER BY b) AS r, sum(n) OVER (PARTITION BY topic) AS t FROM h),
fl AS (SELECT topic, min(b) / 2000 AS floor FROM rr WHERE r >= t * 0.05 GROUP BY topic),
best AS (SELECT doc_id, unit_id, topic, similarity FROM sims QUALIFY row_number() OVER (PARTITION BY doc_id, unit_id ORDER BY similarity DESC, topic) = 1),
ut AS (SELECT doc_id, unit_id, CASE WHEN similarity < floor THEN -1 ELSE topic END AS topic FROM best JOIN fl USING (topic))"""


SQL_SHARES = """ SELECT doc_id, CAST(sum(count(*)) OVER (PARTITION BY doc_id) AS BIGINT) AS n_units, topic, count(*) AS n,
round(count(*) / sum(count(*)) OVER (PARTITION BY doc_id), 9) AS share FROM ut GROUP BY doc_id, topic"""


def shares(assigned: DataFrame) -> DataFrame:
    each = units.topic_shares(assigned).select("doc_id", "n_units", F.explode("shares").alias("s"))
    return each.select("doc_id", "n_units", "s.topic", "s.n", F.round("s.share", 9).alias("share"))


def sentences(docs: DataFrame) -> DataFrame:
    return units.sentence_units(docs, "doc_id", "text", (), ["lang"])


@register("n2_sentence_topic_shares", sql_unit_topics(SQL_SENTENCES) + SQL_SHARES)
def n2_shares(spark, d):
    """Sentences of all documents, their topics, and the shares of topics per document."""
    return shares(unit_model(spark, d, sentences)[1])


@register("n3_paragraph_topic_shares", sql_unit_topics(SQL_PARAGRAPHS) + SQL_SHARES)
def n3_shares(spark, d):
    return shares(unit_model(spark, d, lambda docs: units.paragraph_units(docs, "doc_id", "text", ["lang"]))[1])


@register("j1_sentence_topics", sql_unit_topics(SQL_SENTENCES) + """ SELECT ut.doc_id, unit_id, topic, source, quality FROM ut
JOIN documents d ON ut.doc_id = CAST(d.doc_id AS VARCHAR) LEFT JOIN labels l ON ut.doc_id = CAST(l.doc_id AS VARCHAR)""")
def j1_topics(spark, d):
    """The topic of every sentence beside the columns of its document."""
    meta = documents(spark, d).join(table(spark, d, "labels"), "doc_id", "left").withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = modeling.unit_topics(unit_model(spark, d, sentences)[1], meta, ["source", "quality"])
    return rows.select("doc_id", "unit_id", "topic", "source", "quality")


@register("n2_sentence_topic_info", sql_unit_topics(SQL_SENTENCES) + f""", {sql_ctfidf("own_topic", "(SELECT ul.text, r.topic AS own_topic FROM ul JOIN r USING (lang))")},
n AS (SELECT topic, count(*) AS count FROM docs GROUP BY topic)
SELECT topic, count, string_agg(word, ', ' ORDER BY rank) AS words FROM n JOIN tw USING (topic) GROUP BY ALL""")
def n2_info(spark, d):
    """Topic info of a model whose documents are sentences."""
    info = unit_model(spark, d, sentences)[0].info()
    return info.select("topic", "count", F.array_join("representation", ", ").alias("words"))


# --- embedding, reduction, clustering -------------------------------------------

@register("e1_embed")
def e1(spark, d):
    docs = documents(spark, d)
    return embed.HashedEmbedding.fit(docs).transform(docs)


@register("e1_unit_length", f"SELECT doc_id, CASE WHEN len({SQL_TOKENS}) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM documents")
def e1_length(spark, d):
    docs = documents(spark, d)
    size = embed.V.norm(F.col("embedding"))
    return embed.HashedEmbedding.fit(docs).transform(docs).select("doc_id", F.round(size, 4).alias("length"))


def encode_shape(texts):
    """A stand-in for a user's encoder: lengths, spaces, line ends."""
    import numpy as np

    return np.array([[len(t), t.count(" "), t.count("\n"), 1.0] for t in texts])


@register("e1_user_encoder", """SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces,
CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS line_ends FROM documents""")
def e1_user(spark, d):
    out = embed.embed_texts(documents(spark, d), lambda: encode_shape)
    e = F.col("embedding")
    return out.select("doc_id", e[0].cast("double").alias("chars"), e[1].cast("double").alias("spaces"), e[2].cast("double").alias("line_ends"))


@register("e3_reduce")
def e3(spark, d):
    return embed.reduce_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"), 5).select("vec_id", "reduced")


@register("e4_precomputed_reduction")
def e4(spark, d):
    """Clustering on a given reduction of all coordinates."""
    rows = materialize(embed.reduce_vectors(table(spark, d, "embeddings").select("vec_id", "embedding"), 5).select("vec_id", "reduced"))
    return density.density_clusters(rows, "vec_id", "reduced", Clustering(15, 5))


@register("e5_power_transform")
def e5(spark, d):
    return embed.power_transform(table(spark, d, "embeddings").select("vec_id", "embedding")).select("vec_id", "scaled")


@register("e5_standardized", "SELECT CAST(d AS INTEGER) AS dim, 0.0::DOUBLE AS mean, 1.0::DOUBLE AS deviation FROM (SELECT DISTINCT generate_subscripts(embedding, 1) - 1 AS d FROM embeddings)")
def e5_moments(spark, d):
    scaled = embed.power_transform(table(spark, d, "embeddings").select("vec_id", "embedding"))
    rows = scaled.select(F.posexplode("scaled").alias("dim", "v")).groupBy("dim").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return rows.select("dim", (F.round("m", 4) + 0.0).alias("mean"), F.round("s", 4).alias("deviation"))


@register("m1_density")
def m1(spark, d):
    docs = documents(spark, d)
    v = materialize(embed.HashedEmbedding.fit(docs).transform(docs))
    return density.density_clusters(embed.reduce_vectors(v, 5), "doc_id", "reduced", Clustering(15, 10))


@register("m1_planted", """WITH f AS (SELECT o_orderpriority, dense_rank() OVER (ORDER BY min(o_orderkey)) - 1 AS cluster FROM orders GROUP BY o_orderpriority)
SELECT o_orderkey, cluster FROM orders JOIN f USING (o_orderpriority)""")
def m1_planted(spark, d):
    """Orders as points scattered over one square per priority: the squares are found again."""
    orders = table(spark, d, "orders")
    square = F.pmod(F.ascii("o_orderpriority"), F.lit(8)) * 100.0
    spot = [F.pmod(F.col("o_orderkey") * F.sqrt(F.lit(float(n))), F.lit(1.0)) for n in (2, 3)]
    points = orders.select("o_orderkey", F.array(square + spot[0], spot[1]).alias("reduced"))
    found = density.density_clusters(points, "o_orderkey", "reduced", Clustering(15, 5))
    return found.select("o_orderkey", F.col("cluster").cast("long").alias("cluster"))


@register("m24_parameter_runs")
def m24(spark, d):
    docs = documents(spark, d)
    v = materialize(embed.HashedEmbedding.fit(docs).transform(docs))  # read three times
    reduced = embed.reduce_vectors(v, 3).select("doc_id", "reduced")
    grid = [Clustering(15, 5, "eom"), Clustering(15, 5, "leaf"), Clustering(30, 10, "leaf"), Clustering(15, 5, "eom", 0.5)]
    return modeling.parameter_runs(reduced, grid)


def reduced_documents(spark: SparkSession, d: str, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, their vectors, and ``n`` principal components of these."""
    docs = documents(spark, d).select("doc_id", "text")
    v = materialize(embed.HashedEmbedding.fit(docs).transform(docs))
    return docs, v, materialize(clusterers.PrincipalComponents(n).reduce(v, "doc_id"))


@register("m2_mixture_shares")
def m2_shares(spark, d):
    """Topics by a mixture of Gaussians, with the responsibilities as probabilities by topic."""
    _, _, reduced = reduced_documents(spark, d, 3)
    placed = materialize(clusterers.MixtureParts(6).cluster(reduced, "doc_id"))
    assigned = density.number_topics(placed.drop("shares"), min_topic_size=10).select("doc_id", "topic")
    return clusterers.topic_shares(placed, assigned).join(assigned, "doc_id")


@register("m2_bisecting_topic_info")
def m2_info(spark, d):
    """A model whose clusterer is repeated halving: its topic info."""
    docs, v, reduced = reduced_documents(spark, d, 5)
    return modeling.fit(docs, v, Modeling(stop_words=None), reduced=reduced, clusterer=clusterers.BisectingParts(8)).info()


def fitted(spark: SparkSession, d: str) -> tuple[modeling.TopicModel, DataFrame, DataFrame]:
    docs = documents(spark, d).select("doc_id", "text")
    v = materialize(embed.HashedEmbedding.fit(docs).transform(docs))
    cfg = Modeling(clustering=Clustering(15, 10), stop_words=None)
    return modeling.fit(docs, v, cfg), docs, v


@register("m_fit_topic_info")
def fit_info(spark, d):
    return fitted(spark, d)[0].info()


@register("s10_model_round_trip")
def s10(spark, d):
    """A saved and loaded model assigns all documents."""
    model, _, v = fitted(spark, d)
    path = scratch_path(spark, "model")
    model.save(path)
    return modeling.load_model(spark, path).transform(v)


# --- exploration ----------------------------------------------------------------

@register("q1_topics", f"WITH {sql_ctfidf(SQL_SOURCE_TOPIC)} SELECT topic, rank, word FROM tw WHERE topic = 3")
def q1(spark, d):
    return explore.topic_words(words_of(by_source(spark, d)), 3).select("topic", "rank", "word")


@register("q2_topic_frequency", f"SELECT {SQL_SOURCE_TOPIC} AS topic, count(*) AS count FROM documents GROUP BY ALL")
def q2(spark, d):
    return explore.topic_frequency(by_source(spark, d))


@register("q3_topic_info", f"""WITH {sql_ctfidf(SQL_SOURCE_TOPIC)}, n AS (SELECT topic, count(*) AS count FROM docs GROUP BY topic)
SELECT topic, count, topic || '_' || string_agg(word, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name,
string_agg(word, ', ' ORDER BY rank) AS representation FROM n JOIN tw USING (topic) GROUP BY topic, count""")
def q3(spark, d):
    rows = by_source(spark, d)
    info = explore.topic_info(rows, words_of(rows))
    return info.withColumn("representation", F.array_join("representation", ", "))


@register("q4_representative_docs", f"""WITH {SQL_VECTORS} SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY similarity DESC, vec_id) AS rank, vec_id, round(similarity, 6) AS similarity
FROM sims WHERE topic = label QUALIFY rank <= 3""")
def q4(spark, d):
    r = explore.representative_docs(vectors(spark, d), centres(spark, d), 3, "vec_id")
    return r.withColumn("similarity", F.round("similarity", 6))


@register("q5_document_info", f"""WITH {sql_ctfidf(SQL_SOURCE_TOPIC)}, i AS (SELECT topic, topic || '_' || string_agg(word, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS name FROM tw GROUP BY topic)
SELECT doc_id, lang, topic, name FROM docs JOIN i USING (topic)""")
def q5(spark, d):
    rows = by_source(spark, d)
    info = explore.topic_info(rows, words_of(rows))
    return explore.document_info(rows.select("doc_id", "lang"), rows.select("doc_id", "topic"), info).select("doc_id", "lang", "topic", "name")


def source_model(spark: SparkSession, d: str) -> modeling.TopicModel:
    """A model of all documents by source, with the embedding that made its vectors."""
    docs = documents(spark, d).select("doc_id", "text", "source")
    labels = docs.select("doc_id", F.col("source").alias("cluster"))
    return modeling.fit(docs, materialize(LETTER_VECTORS.transform(docs)), PLAIN, labels=labels, embedding=LETTER_VECTORS)


def search_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Search phrases: the whole benchmark texts."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("pos"), F.col("text").alias("term"))


SQL_HITS = f"""WITH r AS (SELECT source, row_number() OVER (ORDER BY count(*) DESC, min(doc_id)) - 1 AS topic FROM documents GROUP BY source),
dims AS (SELECT topic, unnest({sql_letters()}) AS v, generate_subscripts({sql_letters()}, 1) AS dim FROM documents JOIN r USING (source)),
tv AS (SELECT topic, list(v ORDER BY dim) AS vector FROM (SELECT topic, dim, avg(v) AS v FROM dims GROUP BY ALL) GROUP BY topic),
hits AS (SELECT item_id AS pos, text AS term, topic, CASE WHEN list_sum({sql_letters()}) = 0 THEN 0.0 ELSE list_cosine_similarity({sql_letters()}, vector) END AS similarity FROM benchmark, tv
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, topic) <= 5) """


@register("q6_find_topics", SQL_HITS + "SELECT pos, topic, round(similarity, 6) AS similarity FROM hits")
def q6(spark, d):
    """Whole phrases, embedded by the embedding of a model that was saved and loaded."""
    path = scratch_path(spark, "search")
    source_model(spark, d).save(path)
    out = modeling.load_model(spark, path).find_topics(search_phrases(spark, d), 5)
    return out.select("pos", "topic", F.round("similarity", 6).alias("similarity"))


@register("q7_batch_search", SQL_HITS + "SELECT pos, term, topic, round(similarity, 6) AS similarity FROM hits")
def q7(spark, d):
    hits, _ = source_model(spark, d).search(search_phrases(spark, d), 5)
    return hits.withColumn("similarity", F.round("similarity", 6))


@register("g11_terms_per_topic", SQL_HITS + "SELECT topic, string_agg(term, ', ' ORDER BY pos) AS terms FROM hits GROUP BY topic")
def g11(spark, d):
    return source_model(spark, d).search(search_phrases(spark, d), 5)[1]


@register("q8_target_rows", f"SELECT doc_id, lang, {SQL_SOURCE_TOPIC} AS topic FROM documents WHERE {SQL_SOURCE_TOPIC} IN (2, 5, 7)")
def q8(spark, d):
    return explore.target_rows(by_source(spark, d), [2, 5, 7], ["doc_id", "lang", "topic"])


@register("g8_feature_means", f"""WITH {sql_ctfidf(SQL_SOURCE_TOPIC)},
f AS (SELECT topic, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM docs JOIN labels USING (doc_id) GROUP BY topic),
r AS (SELECT topic, string_agg(word || ' (' || printf('%.2f', weight) || ')', ', ' ORDER BY rank) AS representations FROM tw GROUP BY topic)
SELECT topic, representations, quality, toxic FROM f JOIN r USING (topic)""")
def g8(spark, d):
    rows = by_source(spark, d)
    featured = rows.select("doc_id", "topic").join(table(spark, d, "labels"), "doc_id")
    m = explore.feature_means(featured, ["quality", "toxic"], words_of(rows))
    return m.select("topic", "representations", F.round("quality", 6).alias("quality"), F.round("toxic", 6).alias("toxic"))


# --- plot data ------------------------------------------------------------------

def plane(spark: SparkSession, d: str) -> DataFrame:
    return with_plane(vectors(spark, d)).select("vec_id", "topic", "x", "y")


@register("g9_centroids", f"SELECT label AS topic, round(avg({SQL_X}), 6) AS x, round(avg({SQL_Y}), 6) AS y FROM embeddings GROUP BY label")
def g9(spark, d):
    return explore.topic_centroids(plane(spark, d)).select("topic", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@register("v1_topic_map")
def v1(spark, d):
    return explore.topic_map(centres(spark, d), vectors(spark, d))


@register("v2_hierarchy_data")
def v2(spark, d):
    return hierarchy.topic_hierarchy(centres(spark, d), "average")


@register("v3_bar_data", f"""WITH {sql_ctfidf(SQL_SOURCE_TOPIC)}, big AS (SELECT topic FROM docs GROUP BY topic ORDER BY count(*) DESC, topic LIMIT 8)
SELECT topic, rank, word, round(weight, 9) AS weight FROM tw SEMI JOIN big USING (topic) WHERE rank <= 5""")
def v3(spark, d):
    rows = by_source(spark, d)
    return explore.bar_data(weights_of(rows), rows).withColumn("weight", F.round("weight", 9))


@register("v4_heatmap", f"WITH {SQL_VECTORS} SELECT a.topic, b.topic AS other, round(list_cosine_similarity(a.vector, b.vector), 6) AS similarity FROM tv a, tv b")
def v4(spark, d):
    return similarity.topic_similarity(centres(spark, d)).withColumn("similarity", F.round("similarity", 6))


@register("v5_scatter_data")
def v5(spark, d):
    labels = explore.topic_labels(words_of(by_source(spark, d)))
    return explore.scatter_data(explore.layout_points(vectors(spark, d), "vec_id"), labels, 200, id_col="vec_id")


@register("v6_label_positions", f"""WITH {sql_ctfidf(SQL_SOURCE_TOPIC)}, l AS (SELECT topic, string_agg(word, ' - ' ORDER BY rank) AS label FROM tw WHERE rank <= 3 GROUP BY topic),
c AS (SELECT label AS topic, round(avg({SQL_X}), 6) AS x, round(avg({SQL_Y}), 6) AS y FROM embeddings GROUP BY label)
SELECT topic, x, y, l.label FROM c JOIN l USING (topic)""")
def v6(spark, d):
    p = explore.label_positions(plane(spark, d), words_of(by_source(spark, d)))
    return p.select("topic", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "label")


@register("v7_trend_data", _SQL_TREND.replace("{weights}", "ev") + " WHERE topic <> -1")
def v7(spark, d):
    return trend(spark, d).filter("topic <> -1")


@register("v8_plot_kinds", f"""WITH {SQL_VECTORS} SELECT 'barchart' AS kind, count(*) AS rows FROM (SELECT DISTINCT label FROM embeddings)
UNION ALL SELECT 'heatmap', count(*) FROM tv a, tv b""")
def v8(spark, d):
    """Wanted kinds only: an unknown one and the trend without time are left out."""
    c = centres(spark, d)
    makers = {"heatmap": lambda: similarity.topic_similarity(c), "barchart": lambda: c, "topics_over_time": lambda: c}
    made = explore.plot_tables(makers, ["barchart", "heatmap", "globe", "topics_over_time"], has_time=False)
    out = None
    for kind, df in made.items():
        part = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(kind).alias("kind"), "rows")
        out = part if out is None else out.unionByName(part)
    return out
