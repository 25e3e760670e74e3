"""Terms, models and exploration on small data with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.config import Clustering, Modeling
from topicloom.operators import embed, explore, hierarchy, merging, outliers, represent, similarity, terms, trends
from topicloom.plans import modeling
from topicloom.sources import store

TEXTS = [
    (0, 0, "apple pear apple"), (1, 0, "apple plum"), (2, 0, "pear plum apple"), (3, 0, "fruit apple"), (4, 0, "pear fruit"), (5, 0, "plum"),
    (6, 1, "car bus"), (7, 1, "car train car"), (8, 1, "bus train"), (9, 1, "car fruit"), (10, 1, "train"), (11, 1, "bus car"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, topic int, text string").cache()


@pytest.fixture(scope="module")
def weights(docs):
    return terms.ctfidf(terms.term_counts(docs, "topic", "text")).cache()


def test_ctfidf_by_hand(weights):
    got = {(r.topic, r.word): (r.tf, r.f, r.idf, r.weight) for r in weights.collect()}
    # topic 0 has 13 words, topic 1 has 12: A = 12.5
    for key, tf, f, words in (((0, "apple"), 5, 5, 13), ((0, "fruit"), 2, 3, 13), ((1, "fruit"), 1, 3, 12), ((1, "car"), 5, 5, 12)):
        idf = math.log(1 + 12.5 / f)
        assert got[key][:2] == (tf, f) and got[key][2] == pytest.approx(idf) and got[key][3] == pytest.approx(tf / words * idf)


def test_words_and_vocabulary(docs, weights):
    top = {(r.topic, r["rank"]): r.word for r in terms.top_words(weights, 2).collect()}
    assert top == {(0, 1): "apple", (0, 2): "pear", (1, 1): "car", (1, 2): "bus"}
    assert {(r.word, r["count"]) for r in terms.vocabulary(docs, "text", 4).collect()} == {("apple", 5), ("car", 5)}
    vocab = terms.vocabulary(docs, "text", 4)
    assert {r.word for r in terms.term_counts(docs, "topic", "text", vocab=vocab).collect()} == {"apple", "car"}
    assert {r.word for r in terms.term_counts(docs, "topic", "text", min_count=4).collect()} == {"apple", "car"}


def test_outliers_by_terms_and_windows(spark, weights):
    new = spark.createDataFrame([(20, "apple plum and pear"), (21, "bus"), (22, "unknown words"), (23, "car")], "doc_id long, text string")
    assigned = spark.createDataFrame([(20, -1), (21, -1), (22, -1), (23, 0)], "doc_id long, topic int")
    for got in (outliers.reduce_by_terms(assigned, new, weights, 0.1), outliers.reduce_by_distribution(assigned, new, weights)):
        assert {r.doc_id: r.topic for r in got.collect()} == {20: 0, 21: 1, 22: -1, 23: 0}
    strict = outliers.reduce_by_terms(assigned, new, weights, 0.99)
    assert {r.doc_id: r.topic for r in strict.collect()}[20] == -1


def unit_rows(spark, x, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, embedding array<double>")


def planted(spark, n=40, seed=0):
    rng = np.random.default_rng(seed)
    base = np.eye(8)[[0, 2, 5]]
    x = np.vstack([rng.normal(b, 0.05, (n, 8)) for b in base])
    words = ["apple pear plum fruit", "car bus train road", "dog cat bird fish"]
    texts = spark.createDataFrame([(i, words[i // n]) for i in range(3 * n)], "doc_id long, text string")
    return texts, unit_rows(spark, x), x


@pytest.fixture(scope="module")
def model(spark):
    texts, vectors, _ = planted(spark)
    return modeling.fit(texts, vectors, Modeling(n_components=3, clustering=Clustering(10, 4), stop_words=None)), texts, vectors


def test_fit_finds_the_planted_topics(spark, model, tmp_path):
    m, texts, vectors = model
    got = m.assignments.join(texts, "doc_id").filter("topic >= 0")
    assert got.count() >= 115 and got.groupBy("topic").agg(F.countDistinct("text").alias("n")).filter("n > 1").count() == 0
    assert m.assignments.filter("topic >= 0").select("topic").distinct().count() == 3
    m.save(str(tmp_path / "m"))
    loaded = modeling.load_model(spark, str(tmp_path / "m"))
    a = {(r.doc_id, r.topic) for r in m.transform(vectors).collect()}
    assert a == {(r.doc_id, r.topic) for r in loaded.transform(vectors).collect()} and loaded.config == m.config
    far = unit_rows(spark, [[0, 0, 0, 0, 0, 0, 0, 1.0]])
    assert loaded.transform(far).first().topic == -1
    p = m.probabilities(vectors).select(F.aggregate("probabilities", F.lit(0.0), lambda s, v: s + v).alias("s"))
    assert p.filter(F.abs(F.col("s") - 1) > 1e-9).count() == 0
    assert m.own_probability(vectors).filter("topic >= 0 and probability < 0.5").count() == 0
    assert m.hierarchy().count() == 2


def test_train_saves_all_outputs_and_plots(spark, tmp_path, caplog):
    texts, vectors, _ = planted(spark, 15)
    docs = texts.withColumn("created", F.lit(1700000000) + F.col("doc_id") * 1000).withColumn("author", F.lit("x"))
    cfg = Modeling(n_components=3, clustering=Clustering(8, 3), stop_words=None, min_topic_size=2)
    m = modeling.train(docs, vectors, str(tmp_path), "r1", cfg)
    read = lambda name: spark.read.parquet(str(tmp_path / "topic_info" / f"r1_{name}"))
    assert read("document_info").count() == 45 and {"author", "name", "topic"} <= set(read("document_info").columns)
    assert read("topic_info").filter("topic >= 0 and size(representative_docs) = 3").count() == 3
    assert read("probabilities").count() == 45 and spark.read.json(str(tmp_path / "logs")).first().run_name == "r1"
    made = modeling.plots(m, docs, vectors, time_col="created", nr_bins=3)
    assert set(made) == set(explore.PLOT_KINDS) and all(df.count() for df in made.values())
    assert made["topics_over_time"].agg(F.sum("frequency")).first()[0] == 45
    assert set(modeling.plots(m, kinds=["heatmap", "documents"])) == {"heatmap"}
    again = modeling.train(docs, vectors, "/proc/nowhere", "r2", cfg)
    assert again.assignments.count() == 45 and "saving its outputs failed" in caplog.text


def test_given_labels_and_fewer_topics(spark):
    texts, vectors, _ = planted(spark)
    labels = texts.select("doc_id", F.col("text").alias("cluster"))
    m = modeling.fit(texts, vectors, Modeling(nr_topics=2, stop_words=None), labels=labels)
    sizes = {r.topic: r["count"] for r in explore.topic_frequency(m.assignments).collect()}
    assert sizes == {0: 80, 1: 40}
    info = {r.topic: r for r in m.info().collect()}
    assert info[1]["name"].startswith("1_") and info[1]["count"] == 40 and len(info[1].representation) == 4


def test_a_model_of_outliers_only(spark):
    texts, vectors, _ = planted(spark, 4)
    m = modeling.fit(texts, vectors, Modeling(n_components=2, clustering=Clustering(50, 5), stop_words=None))
    assert {r.topic for r in m.assignments.collect()} == {-1}
    assert {r.topic for r in m.transform(vectors).collect()} == {-1} and m.transform(vectors).count() == 12
    assert m.info().count() == 1


def test_missing_vectors_raise(spark):
    texts, vectors, _ = planted(spark, 5)
    with pytest.raises(ValueError):
        modeling.fit(texts, vectors.filter("doc_id > 0"))


def test_reduce_outliers_then_update(spark, model):
    m, texts, vectors = model
    lost = m.assignments.withColumn("topic", F.when(F.col("doc_id") % 10 == 0, -1).otherwise(F.col("topic")))
    m2 = m.with_topics(lost, texts, vectors)
    back = m2.reduce_outliers(texts, "c-tf-idf", 0.1)
    assert back.filter("topic = -1").count() == 0
    assert m2.reduce_outliers(texts).filter("topic = -1").count() == 0
    with pytest.raises(ValueError):
        m2.reduce_outliers(texts, "magic")


def test_similarity_blocks_give_the_same(spark):
    _, vectors, x = planted(spark)
    topics = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(np.random.default_rng(1).normal(size=(7, 8)))], "topic int, vector array<double>")
    one = similarity.similarities(vectors, topics).toPandas().sort_values(["doc_id", "topic"])
    many = similarity.similarities(vectors, topics, block_bytes=2 * 8 * 8).toPandas().sort_values(["doc_id", "topic"])
    assert len(one) == len(many) == 840 and np.allclose(one["similarity"], many["similarity"])
    a = similarity.assign(vectors, topics).toPandas().sort_values("doc_id")
    b = similarity.assign(vectors, topics, block_bytes=2 * 8 * 8).toPandas().sort_values("doc_id")
    assert (a["topic"].to_numpy() == b["topic"].to_numpy()).all()
    p = similarity.probability_arrays(vectors, topics, block_bytes=64).toPandas().sort_values("doc_id")
    q = similarity.probability_arrays(vectors, topics).toPandas().sort_values("doc_id")
    assert np.allclose(np.array(p["probabilities"].tolist()), np.array(q["probabilities"].tolist()))


def test_zero_vector_has_no_similarity(spark):
    topics = spark.createDataFrame([(0, [1.0, 0.0])], "topic int, vector array<double>")
    assert similarity.similarities(unit_rows(spark, [[0, 0]]), topics).first().similarity == 0.0


def naive_linkage(x, method):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, sets, out = 1 - x @ x.T, [[i] for i in range(len(x))], []
    between = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(sets) > 1:
        w, i, j = min((between(d[np.ix_(a, b)]), i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j)
        out.append((round(float(w), 9), tuple(sorted(sets[i] + sets[j]))))
        sets = [s for k, s in enumerate(sets) if k not in (i, j)] + [sets[i] + sets[j]]
    return out


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_hierarchy_against_naive(spark, method):
    x = np.random.default_rng(7).normal(size=(9, 5))
    tv = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(-1, [0.0] * 5)], "topic int, vector array<double>")
    got = [(round(r.distance, 9), tuple(r.topics)) for r in hierarchy.topic_hierarchy(tv, method).orderBy("step").collect()]
    assert got == naive_linkage(x, method)


def test_hierarchy_cut_and_tree(spark):
    x = [[1, 0, 0], [1, 0.1, 0], [0, 1, 0], [0, 1, 0.3]]
    tv = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "topic int, vector array<double>")
    merges = hierarchy.topic_hierarchy(tv, "ward")
    assert {(r.topic, r.group) for r in hierarchy.cut_to(merges, 2).collect()} == {(0, 4), (1, 4), (2, 5), (3, 5)}
    assert {(r.topic, r.group) for r in hierarchy.cut_to(merges, 9).collect()} == {(i, i) for i in range(4)}
    labels = spark.createDataFrame([(i, f"L{i}") for i in range(4)], "topic int, label string")
    lines = [r.line for r in hierarchy.topic_tree(merges, labels).orderBy("ord").collect()]
    assert len(lines) == 7 and lines[0] == "L0 + L1 + L2 + L3" and sum("■──" in line for line in lines) == 4
    with pytest.raises(ValueError):
        hierarchy.topic_hierarchy(tv, "median")


def test_mmr_by_hand(spark):
    words = spark.createDataFrame([(0, 1, "a", 0.9), (0, 2, "b", 0.8), (0, 3, "c", 0.7)], "topic int, rank long, word string, weight double")
    wv = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.99, 0.05]), ("c", [0.6, 0.8])], "word string, vector array<double>")
    tv = spark.createDataFrame([(0, [1.0, 0.2])], "topic int, vector array<double>")
    pick = lambda d: [r.word for r in represent.diverse_words(words, tv, wv, d, 2).orderBy("rank").collect()]
    assert pick(0.0) == ["a", "b"] and pick(0.7) == ["b", "c"]
    best = represent.keywords_by_similarity(words, tv, wv, 1).first()
    assert best.word == "b"


def test_no_hidden_bound_on_words(spark):
    words = spark.createDataFrame([(0, i + 1, f"w{i}", 1.0 / (i + 1)) for i in range(40)], "topic int, rank long, word string, weight double")
    wv = spark.createDataFrame([(f"w{i}", [1.0, float(i)]) for i in range(40)], "word string, vector array<double>")
    tv = spark.createDataFrame([(0, [1.0, 0.2])], "topic int, vector array<double>")
    assert represent.diverse_words(words, tv, wv, 0.3, 40).count() == 40
    chain = [{"chain": [{"model_name": "keywords", "params": {"top_n_words": 40}}, {"model_name": "diverse", "params": {"top_n_words": 40}}]}]
    assert represent.aspects(chain, words.drop("rank"), tv, wv).filter("aspect = 'aspect_0'").count() == 40
    assert represent.most_candidates([{"model_name": "keywords", "params": {"nr_candidate_words": 250}}]) == 250


def test_layout_of_few_topics(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0, 3.0])], "topic int, vector array<double>")
    rows = spark.createDataFrame([(1, 0)], "doc_id long, topic int")
    assert [(r.x, r.y, r.size) for r in explore.topic_map(one, rows).collect()] == [(0.0, 0.0, 1)]
    thin = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "id long, embedding array<double>")
    assert all(len(r.reduced) == 5 and r.reduced[2:] == [0.0] * 3 for r in embed.reduce_vectors(thin, 5).collect())
    layout = spark.createDataFrame([(0, 60.0, -30.0), (70, 1.0, 2.0)], "topic int, x double, y double")
    words = spark.createDataFrame([(t, 1, "a", 1.0) for t in (0, 70)], "topic int, rank long, word string, weight double")
    assert explore.label_positions(layout, words).count() == 2


def test_aspect_settings(caplog):
    assert represent.aspect_steps(None) == {} and represent.aspect_steps({"model_name": "Nope"}) == {} and represent.aspect_steps(3) == {}
    got = represent.aspect_steps([{"model_name": "KeyBERTInspired"}, {"bad": 1}, {"model_name": "MaximalMarginalRelevance", "aspect_name": "x", "params": {"diversity": 0.2}}])
    assert got == {"aspect_0": [("keywords", {})], "x": [("diverse", {"diversity": 0.2})]} and "skipped" in caplog.text


def test_merge(spark):
    tv = lambda rows: spark.createDataFrame(rows, "topic int, vector array<double>")
    rows = lambda ids, t: spark.createDataFrame([(i, t) for i in ids], "doc_id long, topic int")
    first = tv([(0, [1.0, 0.0, 0.0]), (-1, [1.0, 1.0, 1.0])]), rows(range(5), 0)
    second = tv([(0, [0.0, 1.0, 0.0]), (1, [0.9, 0.1, 0.0]), (-1, [0.0, 0.0, 1.0])]), rows(range(5, 9), 0).union(rows([9], 1)).union(rows([10], -1))
    vectors, assigned, mapping = merging.merge_models([first, second], 0.6)
    assert {(r.topic, r.merged_topic) for r in mapping.filter("model = 1").collect()} == {(0, 1), (1, 0), (-1, -1)}
    assert {r.topic: r["count"] for r in assigned.groupBy("topic").count().collect()} == {0: 6, 1: 4, -1: 1}
    assert vectors.filter("topic >= 0").count() == 2


def test_power_transform_reaches_the_likeliest_exponent(spark):
    x = np.random.default_rng(0).gamma(2.0, 1.0, (400, 2)) - [0.0, 1.5]
    df = unit_rows(spark, x)
    fitted = embed.fit_power(df)
    for d in range(2):
        grid = np.arange(-2, 4, 0.01)
        logs = (np.sign(x[:, d]) * np.log1p(np.abs(x[:, d]))).sum()
        like = [-len(x) / 2 * np.log(embed._yj(x[:, d], g).var()) + (g - 1) * logs for g in grid]
        assert abs(fitted[d][0] - grid[int(np.argmax(like))]) < 0.02
    scaled = np.array(embed.power_transform(df).toPandas()["scaled"].tolist())
    assert np.allclose(scaled.mean(0), 0, atol=1e-6) and np.allclose(scaled.std(0), 1, atol=1e-6)


def test_reduction_equals_numpy(spark):
    x = np.random.default_rng(3).normal(size=(60, 6)) * [5, 3, 1, 1, 1, 1]
    got = np.array(embed.reduce_vectors(unit_rows(spark, x), 2).orderBy("doc_id").toPandas()["reduced"].tolist())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    w = np.linalg.eigh(np.cov(u.T))[1][:, ::-1][:, :2]
    w *= np.sign(w[np.abs(w).argmax(0), [0, 1]])
    assert np.allclose(got, u @ w, atol=1e-8)


def test_hashed_embedding(spark):
    texts = spark.createDataFrame([(0, "cat dog fish"), (1, "fish dog cat"), (2, "tax law court"), (3, None), (4, "")], "doc_id long, text string")
    e = embed.HashedEmbedding.fit(texts, dim=32)
    v = {r.doc_id: np.array(r.embedding) for r in e.transform(texts.repartition(3)).collect()}
    assert np.allclose(v[0], v[1]) and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[3].any() and v[0] @ v[2] < 0.7


def test_encoder_batches(spark):
    texts = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(100)], "doc_id long, text string").coalesce(1)
    seen = embed.embed_texts(texts, lambda: (lambda batch: np.array([[len(t), len(batch)] for t in batch])), batch_size=32)
    got = {r.doc_id: r.embedding for r in seen.collect()}
    assert embed.embed_texts(texts.limit(0), lambda: (lambda batch: np.zeros((len(batch), 2)))).collect() == []
    assert len(got) == 100 and got[3][0] == 0 and got[50][0] == 50 and max(v[1] for v in got.values()) == 32


def test_trend_bins(spark, docs, weights):
    dated = docs.withColumn("created", F.lit(1700000000) + F.col("doc_id") * 100)
    out = trends.topics_over_time(dated, "created", weights, nr_bins=2).collect()
    assert {(r.topic, r.frequency) for r in out} == {(0, 6), (1, 6)} and len({r.timestamp for r in out}) == 2
    assert [r.words.split(", ")[0] for r in sorted(out, key=lambda r: r.topic)] == ["apple", "car"]
    assert trends.topics_over_time(dated, "created", weights).count() == 12
    assert trends.topics_over_time(dated, "created", weights, every="1 day").count() == 2


def test_evolution_averages_with_the_bin_before(spark):
    rng = np.random.default_rng(4)
    present = [(t, b) for t in range(3) for b in range(9) if rng.random() < 0.7]
    rows = [(b, t, w, float(rng.random())) for t, b in present for w in "abcdef" if rng.random() < 0.5]
    bins = sorted({b for _, b in present})
    expected, before = {}, {}
    for b in bins:
        now = {}
        for t in (t for t, x in present if x == b):
            own = {w: v for x, u, w, v in rows if (x, u) == (b, t)}
            now[t] = own if t not in before else {w: (own.get(w, 0) + before[t].get(w, 0)) / 2 for w in own.keys() | before[t].keys()}
            expected.update({(b, t, w): v for w, v in now[t].items()})
        before = now
    weights = spark.createDataFrame(rows, "timestamp long, topic int, word string, weight double")
    got = trends.evolved(weights, spark.createDataFrame([(b, t) for t, b in present], "timestamp long, topic int")).collect()
    assert {(r.timestamp, r.topic, r.word) for r in got} == expected.keys() and len(got) == len(expected)
    assert all(r.weight == pytest.approx(expected[r.timestamp, r.topic, r.word]) for r in got)


def test_chosen_topics_keep_their_bins(spark, docs, weights):
    dated = docs.withColumn("created", F.lit(1700000000) + F.col("doc_id") * 100)
    for w in (weights, None):
        every = trends.topics_over_time(dated, "created", w, nr_bins=4).filter("topic = 1")
        assert sorted(map(tuple, trends.topics_over_time(dated, "created", w, nr_bins=4, topics=[1]).collect())) == sorted(map(tuple, every.collect()))


def test_search_keeps_repeated_terms(spark):
    tv = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (-1, [1.0, 1.0])], "topic int, vector array<double>")
    found = spark.createDataFrame([(0, "Trust", [1.0, 0.1]), (1, "Safety", [0.1, 1.0]), (2, "Trust", [1.0, 0.1])], "pos int, term string, embedding array<double>")
    hits, listed = explore.search_topics(found, tv, 1)
    assert {(r.pos, r.topic) for r in hits.collect()} == {(0, 0), (1, 1), (2, 0)}
    assert {r.topic: r.terms for r in listed.collect()} == {0: "Trust, Trust", 1: "Safety"}


def test_plot_kinds(caplog):
    makers = {"topics": lambda: 1, "heatmap": lambda: 1 / 0, "topics_over_time": lambda: 2}
    assert explore.plot_tables(makers, ["topics", "heatmap", "globe", "topics_over_time"], has_time=False) == {"topics": 1}
    assert "globe" in caplog.text and "heatmap" in caplog.text
    assert set(explore.plot_tables(makers, "topics")) == {"topics", "topics_over_time"}


def test_report_order(spark, docs, weights, tmp_path):
    words = terms.top_words(weights, 2)
    rep = spark.createDataFrame([(0, 1, "apple apple"), (1, 1, "car")], "topic int, rank int, document string")
    lines = store.report_lines(words, explore.topic_frequency(docs), explore.topic_info(docs, words), rep)
    store.write_lines(lines.repartition(5), str(tmp_path / "r"))
    text = [r.line for r in lines.orderBy("section", "topic", "ord").collect()]
    assert text[:6] == ["TOPICS:", "Topic 0: apple, pear", "Topic 1: car, bus", "TOPIC FREQUENCY:", "Topic 0: 6 entries", "Topic 1: 6 entries"]
    assert text[6:12] == ["TOPIC INFO:", "Topic 0", " - Name: 0_apple_pear", " - Representation:", "   * apple", "   * pear"]
    assert spark.read.text(str(tmp_path / "r")).count() == len(text)


def test_parameter_runs(spark):
    _, vectors, x = planted(spark)
    runs = modeling.parameter_runs(vectors.withColumnRenamed("embedding", "reduced"), [Clustering(10, 4), Clustering(30, 4, "leaf")])
    assert {(r.run, r.n_topics) for r in runs.collect()} == {(0, 3), (1, 3)}


def test_modeling_settings():
    for bad in ({"n_components": 0}, {"ngram_range": [2, 1]}, {"nr_topics": 0}, {"clustering": 3}):
        with pytest.raises(ValueError):
            Modeling.from_dict(bad)
    assert Modeling.from_dict({"clustering": {"min_cluster_size": 30}, "ngram_range": [1, 2]}).clustering.min_cluster_size == 30
