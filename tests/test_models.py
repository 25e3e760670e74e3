"""Models of units, search by texts, saved versions and merged models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom import catalog
from topicloom.config import Modeling
from topicloom.operators import embed, similarity, units
from topicloom.plans import modeling

PLAIN = Modeling(min_topic_size=1, stop_words=None)
FRUIT, ROAD = ["apple pear plum", "pear apple fruit", "plum fruit apple"], ["car bus train", "bus road car", "train road bus"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, (FRUIT if i % 2 else ROAD)[i % 3], i % 2) for i in range(24)]
    return spark.createDataFrame(rows, "doc_id long, text string, cluster int").cache()


@pytest.fixture(scope="module")
def model(corpus):
    e = embed.HashedEmbedding.fit(corpus, dim=32)
    return modeling.fit(corpus, e.transform(corpus), PLAIN, labels=corpus.select("doc_id", "cluster"), embedding=e)


def brute_vector(e, text):
    """The hashed embedding, word by word."""
    signs = np.random.default_rng(e.seed).choice([-1.0, 1.0], size=(len(e.idf), e.dim))
    out = np.zeros(e.dim)
    for slot in text:
        out += e.idf[slot] * signs[slot]
    size = np.linalg.norm(out)
    return out / size if size else out


def test_embedding_equals_a_loop_over_words(spark):
    texts = ["apple pear apple", None, "", "pear", "a long text " * 30, "apple unknown words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    e = embed.HashedEmbedding.fit(df, dim=16, n_features=64)
    got = {r.doc_id: r.embedding for r in e.transform(df).collect()}
    for r in df.select("doc_id", embed._slots("text", 64, None).alias("s")).collect():
        assert np.allclose(got[r.doc_id], brute_vector(e, r.s), atol=1e-6)


def test_phrases_are_searched_with_the_models_embedding(spark, model, tmp_path):
    phrases = spark.createDataFrame([(0, "plum and apple"), (1, "a bus on the road"), (2, "plum and apple"), (3, None)], "pos long, term string")
    model.save(str(tmp_path / "m"))
    loaded = modeling.load_model(spark, str(tmp_path / "m"))
    assert loaded.embedding == model.embedding
    centre = {r.topic: np.array(r.vector) for r in model.topic_vectors.collect()}
    slots = phrases.select("pos", embed._slots("term", len(model.embedding.idf), None).alias("s")).collect()
    expected = {}
    for r in slots:
        v = brute_vector(model.embedding, r.s)
        expected.update({(r.pos, t): v @ c / np.linalg.norm(c) for t, c in centre.items()})
    got = {(r.pos, r.topic): r.similarity for r in loaded.find_topics(phrases, 5).collect()}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k], abs=1e-6) for k in got)
    hits, listed = loaded.search(phrases, 1)
    best = {r.pos: r.topic for r in hits.collect()}
    assert best[0] == best[2] != best[1] and hits.count() == 4
    fruit = {r.topic: r.terms for r in listed.collect()}[best[0]]
    assert fruit.startswith("plum and apple, plum and apple")


def test_a_model_without_embedding_does_not_search(spark, corpus):
    bare = modeling.fit(corpus, embed.HashedEmbedding.fit(corpus).transform(corpus), PLAIN, labels=corpus.select("doc_id", "cluster"))
    with pytest.raises(ValueError, match="no embedding"):
        bare.find_topics(spark.createDataFrame([(0, "x")], "pos long, term string"))


def test_named_encoders(spark, corpus, tmp_path):
    def make_lengths():
        return lambda batch: np.array([[len(t), 1.0] for t in batch])

    named = embed.NamedEmbedding("lengths of tests")
    with pytest.raises(ValueError, match="no encoder is registered as 'lengths of tests'"):
        named.transform(corpus)
    embed.register_encoder("lengths of tests", make_lengths)
    embed.register_encoder("lengths of tests", make_lengths)
    with pytest.raises(ValueError, match="another encoder"):
        embed.register_encoder("lengths of tests", lambda: None)
    m = modeling.fit(corpus, named.transform(corpus), PLAIN, labels=corpus.select("doc_id", "cluster"), embedding=named)
    m.save(str(tmp_path / "m"))
    assert modeling.load_model(spark, str(tmp_path / "m")).embedding == named
    with pytest.raises(ValueError, match="unknown kind"):
        embed.embedding_of({"kind": "other"})


def test_a_broken_save_leaves_the_old_model(spark, model, tmp_path):
    path = str(tmp_path / "m")
    with pytest.raises(ValueError, match="no complete model"):
        modeling.load_model(spark, path)
    model.save(path)
    broken = modeling.TopicModel(**{**model.__dict__, "words": model.words.withColumn("rank", F.raise_error(F.lit("disk full")))})
    with pytest.raises(Exception, match="disk full"):
        broken.save(path)
    assert modeling.load_model(spark, path).info().count() == 2
    loaded = modeling.load_model(spark, path)
    smaller = modeling.TopicModel(**{**loaded.__dict__, "words": loaded.words.filter("rank = 1")})
    smaller.save(path)  # to the folder that it was read from
    again = modeling.load_model(spark, path)
    assert again.words.count() == 2 and again.assignments.count() == 24 and modeling.manifest(spark, path).count() == 2


def rows_of(df, digits=9):
    round_ = lambda x: round(x, digits) if isinstance(x, float) else tuple(map(round_, x)) if isinstance(x, list) else x
    return sorted((tuple(round_(v) for v in r) for r in df.collect()), key=repr)


def test_a_merged_model_is_that_of_all_documents(spark, corpus, tmp_path):
    e = embed.HashedEmbedding.fit(corpus, dim=32)
    v = e.transform(corpus)
    numbered = corpus.select("doc_id", "text", F.col("cluster").alias("topic"))
    parts = []
    for half in (0, 1):
        docs = numbered.filter((F.col("doc_id") > 11).cast("int") == half).withColumn("topic", F.when(F.lit(half == 1), 1 - F.col("topic")).otherwise(F.col("topic")))
        parts.append(modeling.describe(docs.select("doc_id", "topic", F.lit(1.0).alias("strength")), docs, v, PLAIN, embedding=e))
    merged, mapping = modeling.merge(parts, 0.6)
    assert {(r.model, r.topic, r.merged_topic) for r in mapping.collect()} == {(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)}
    whole = modeling.describe(numbered.select("doc_id", "topic", F.lit(1.0).alias("strength")), numbered, v, PLAIN, embedding=e)
    for table in ("assignments", "weights", "words"):
        assert rows_of(getattr(merged, table).select(getattr(whole, table).columns)) == rows_of(getattr(whole, table))
    assert rows_of(merged.topic_vectors.select("topic", "vector", "n"), 6) == rows_of(whole.topic_vectors.select("topic", "vector", "n"), 6)
    assert rows_of(merged.info()) == rows_of(whole.info())
    merged.save(str(tmp_path / "m"))
    loaded = modeling.load_model(spark, str(tmp_path / "m"))
    assert {(r.doc_id, r.topic) for r in loaded.transform(v).filter("topic >= 0").collect()} <= {(r.doc_id, r.topic) for r in numbered.collect()}
    assert loaded.transform(v).filter("topic >= 0").count() >= 20
    strict, mapping = modeling.merge(parts, 1.1)  # nothing is as similar as that
    assert strict.topic_vectors.count() == 4 and {r.merged_topic for r in mapping.filter("model = 1").collect()} == {2, 3}


def test_a_model_of_sentences(spark):
    texts = [(1, "Apple pear plum. Car bus train! Pear apple fruit."), (2, "Bus road car."), (3, ""), (4, "Plum fruit apple? Train road bus. Bus bus bus. Car.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    parts = units.sentence_units(docs, "doc_id", "text")
    keyed = units.with_unit_key(parts)
    labels = keyed.select("unit", F.when(F.lower("text").rlike("apple"), "fruit").otherwise("road").alias("cluster"))
    model, vectors = modeling.fit_units(parts, embed.HashedEmbedding.fit(parts, dim=64), PLAIN, labels)
    topics = {(r.unit.doc_id, r.unit.unit_id): r.topic for r in model.assignments.collect()}
    assert topics == {("1", 0): 1, ("1", 1): 0, ("1", 2): 1, ("2", 0): 0, ("4", 0): 1, ("4", 1): 0, ("4", 2): 0, ("4", 3): 0}
    got = {r.doc_id: (r.n_units, [(s.topic, s.n, s.share) for s in r.shares]) for r in units.topic_shares(model.assignments).collect()}
    assert got == {"1": (3, [(0, 1, 1 / 3), (1, 2, 2 / 3)]), "2": (1, [(0, 1, 1.0)]), "4": (4, [(0, 3, 0.75), (1, 1, 0.25)])}
    assert model.info().agg(F.sum("count")).first()[0] == 8
    new = model.transform(vectors).filter("topic <> -1")
    assert all(topics[r.unit.doc_id, r.unit.unit_id] == r.topic for r in new.collect())
    meta = spark.createDataFrame([("1", "x"), ("4", "y")], "doc_id string, author string")
    rows = modeling.unit_topics(model.assignments, meta, ["author"]).collect()
    assert {(r.doc_id, r.author) for r in rows} == {("1", "x"), ("2", None), ("4", "y")} and len(rows) == 8
    ids = model.probabilities(vectors).select("unit.doc_id").distinct().count()
    assert ids == 3 and model.own_probability(vectors).count() == 8


@pytest.mark.parametrize("block_bytes", [1 << 20, 3 * 8 * 4, 1])
def test_top_lists_of_all_blocks(spark, block_bytes, monkeypatch):
    rng = np.random.default_rng(3)
    x, t = rng.normal(size=(50, 4)), np.vstack([rng.normal(size=(9, 4)), np.zeros((1, 4))])
    t[4] = t[2]  # a tie
    rows = spark.createDataFrame([((str(i), i), [float(v) for v in r]) for i, r in enumerate(x)], "unit struct<a: string, b: long>, embedding array<double>")
    topics = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(t)], "topic int, vector array<double>")
    size = lambda m: np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    sim = (x / size(x)) @ (t / size(t)).T
    got = similarity.similarities(rows, topics, "unit", top=3, block_bytes=block_bytes).collect()
    order = {i: sorted(range(10), key=lambda j: (-round(sim[i, j], 12), j)) for i in range(50)}
    assert {(r.unit.b, r.topic) for r in got} == {(i, j) for i in order for j in order[i][:3]} and len(got) == 150
    share = np.maximum(sim, 0) / np.maximum(sim, 0).sum(axis=1, keepdims=True)
    got = similarity.top_probabilities(rows, topics, 2, "unit", block_bytes=block_bytes).collect()
    best = {i: sorted(range(10), key=lambda j: (-round(share[i, j], 12), j))[:2] for i in range(50)}
    assert {(r.unit.b, r["rank"], r.topic) for r in got} == {(i, k + 1, j) for i in best for k, j in enumerate(best[i])}
    assert all(r.probability == pytest.approx(share[r.unit.b, r.topic]) for r in got)


def test_only_new_texts_are_encoded(spark, tmp_path):
    from topicloom.sources.vectors import VectorStore

    first = spark.createDataFrame([(i, f"text {i % 3}") for i in range(9)] + [(9, None), (10, "")], "doc_id long, text string")
    more = first.union(spark.createDataFrame([(20, "text 1"), (21, "new"), (22, "new")], "doc_id long, text string"))
    e = embed.HashedEmbedding.fit(more, dim=8)
    store = VectorStore(spark, str(tmp_path), e)
    assert store.table().count() == 0 and store.vectors(first).count() == 11
    got = {r.doc_id: r.embedding for r in store.vectors(more).collect()}
    assert got == {r.doc_id: r.embedding for r in e.transform(more).collect()} and len(got) == 14
    assert {(r.batch, r.encoded) for r in store.batches().collect()} == {(1, 4), (2, 1)}
    other = VectorStore(spark, str(tmp_path), embed.HashedEmbedding(e.idf, 4))
    assert other.table().count() == 0 and VectorStore(spark, str(tmp_path), e).table().count() == 5


def test_component_settings(caplog):
    cfg = Modeling.from_dict({
        "reduction_params": {"n_components": 7, "metric": "cosine"}, "cluster_params": {"min_cluster_size": 30, "cluster_selection_method": "leaf", "cluster_selection_epsilon": 0.5},
        "vectorizer_params": {"ngram_range": [1, 2], "stop_words": ["a"], "min_df": 4}, "model_params": {"top_n_words": 3, "nr_topics": 9, "language": "english"},
        "other_params": None, "representation_params": {"model_name": "KeyBERTInspired"}, "linkage": "single",
    })
    assert (cfg.n_components, cfg.ngram_range, cfg.stop_words, cfg.min_frequency, cfg.top_n_words, cfg.nr_topics, cfg.linkage) == (7, (1, 2), ("a",), 4, 3, 9, "single")
    assert (cfg.clustering.min_cluster_size, cfg.clustering.selection, cfg.clustering.epsilon) == (30, "leaf", 0.5) and cfg.representation == {"model_name": "KeyBERTInspired"}
    assert "reduction_params.metric has no part" in caplog.text
    for bad, name in (
        ({"cluster_params": {"min_clutser_size": 3}}, "cluster_params.min_clutser_size"), ({"clustering": {"min_clutser_size": 3}}, "clustering.min_clutser_size"),
        ({"n_component": 3}, "'n_component'"), ({"cluster_params": [3]}, "cluster_params must be a dictionary"), ({"clustering": 3}, "clustering must be"),
    ):
        with pytest.raises(ValueError, match=name):
            Modeling.from_dict(bad)


def test_training_with_representation_steps(spark, corpus, tmp_path):
    e = embed.HashedEmbedding.fit(corpus, dim=32)
    steps = [{"model_name": "MaximalMarginalRelevance", "aspect_name": "varied", "params": {"diversity": 0.9, "top_n_words": 2}}, {"model_name": "KeyBERTInspired"}]
    cfg = Modeling(min_topic_size=1, stop_words=None, top_n_words=4, representation=steps)
    m = modeling.fit(corpus, e.transform(corpus), cfg, labels=corpus.select("doc_id", "cluster"), embedding=e)
    m.save(str(tmp_path / "m"))
    loaded = modeling.load_model(spark, str(tmp_path / "m"))
    assert loaded.config == m.config and rows_of(loaded.aspects) == rows_of(m.aspects)
    assert {r.aspect: r.n for r in m.aspects.groupBy("aspect").agg(F.count("word").alias("n")).collect()} == {"Main": 8, "varied": 4, "aspect_1": 8}
    info = loaded.info().collect()
    assert all(len(r.varied) == 2 and len(r.aspect_1) == 4 and set(r.varied) <= set(r.representation) for r in info) and len(info) == 2
    main = modeling.fit(corpus, e.transform(corpus), Modeling(min_topic_size=1, stop_words=None, top_n_words=3, representation={"model_name": "KeyBERTInspired"}), labels=corpus.select("doc_id", "cluster"))
    assert {r.aspect for r in main.aspects.collect()} == {"Main"} and rows_of(main.words.select("topic", "rank", "word")) == rows_of(m.aspects.filter("aspect = 'aspect_1' AND rank <= 3").select("topic", "rank", "word"))


def test_every_vector_meets_every_topic(spark, tmp_path):
    rows = [(i, [float(np.cos(i * (j + 1))) for j in range(6)], i % 8) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = catalog.queries()["j7_topic_similarity"](spark, str(tmp_path)).select("vec_id", "topic").collect()
    assert len(got) == len(set(got)) == 24 * 8


def test_probabilities_of_all_topics_sum_to_one(spark, tmp_path):
    rows = [(i, [float(np.cos(i * (j + 1))) for j in range(6)], i % 8) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    out = catalog.queries()["m10_probabilities"](spark, str(tmp_path)).groupBy("vec_id")
    got = out.agg(F.sort_array(F.collect_list("rank")).alias("ranks"), F.sum("probability").alias("total")).collect()
    assert len(got) == 24 and all(r.ranks == list(range(1, 9)) and abs(r.total - 1) < 1e-5 for r in got)


def test_a_batch_is_encoded_some_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    batch = pa.array(["x" * 10_000, None] * 1000)
    tracemalloc.start()
    out = embed._encoded(batch, lambda texts: [[len(t)] for t in texts], 32)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.ravel().tolist() == [10_000, 0] * 1000 and peak < 4e6


def test_words_of_a_batch_are_counted_some_rows_at_a_time():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(1)
    lengths = [0, 3000, 100_000, 0, *[4000] * 300]
    flat = rng.integers(64, size=sum(lengths)).astype(np.int32)
    batch = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat))
    idf, signs = rng.random(64), rng.choice([-1.0, 1.0], size=(64, 4))
    tracemalloc.start()
    out = embed._weighted_signs(batch, idf, signs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expected = [(np.bincount(np.array(r.as_py(), dtype=int), minlength=64) * idf) @ signs for r in batch]
    assert np.allclose(out, expected) and peak < 12e6
