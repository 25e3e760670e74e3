"""Exchangeable parts of a model, the topic hierarchy's steps, and window scores."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.config import Modeling
from topicloom.operators import audit, clusterers, density, hierarchy, outliers, terms
from topicloom.plans import modeling


def rows(spark, x, column="reduced"):
    return spark.createDataFrame([(i, None if r is None else [float(v) for v in r]) for i, r in enumerate(x)], f"doc_id long, {column} array<double>")


def blobs(n=60):
    rng = np.random.default_rng(5)
    return np.vstack([rng.normal(c, 0.6, (n, 2)) for c in ((0, 0), (6, 0), (0, 7))])


def test_responsibilities_follow_from_the_parameters(spark):
    x = blobs()
    placed, parameters = clusterers.MixtureParts(3).fit_cluster(rows(spark, [*x, None]), "doc_id")
    got = {r.doc_id: r for r in placed.collect()}
    assert got[len(x)].cluster == -1 and got[len(x)].shares is None and got[len(x)].strength == 0
    con = duckdb.connect()
    con.register("p", parameters.toPandas())
    con.register("x", rows(spark, x).toPandas())
    want = con.execute("""WITH d AS (SELECT doc_id, component, weight, reduced[1] - mean[1] AS u, reduced[2] - mean[2] AS v, cov[1] AS a, cov[2] AS b, cov[4] AS c FROM x, p),
        e AS (SELECT doc_id, component, weight * exp(-0.5 * (c * u * u - 2 * b * u * v + a * v * v) / (a * c - b * b)) / (2 * pi() * sqrt(a * c - b * b)) AS f FROM d)
        SELECT doc_id, list(f / total ORDER BY component) FROM (SELECT *, sum(f) OVER (PARTITION BY doc_id) AS total FROM e) GROUP BY doc_id""").fetchall()
    for i, shares in want:
        assert got[i].shares == pytest.approx(shares, abs=1e-6) and got[i].cluster == int(np.argmax(shares))
    assert sorted(len({got[i].cluster for i in range(a, a + 60)}) for a in (0, 60, 120)) == [1, 1, 1]


def test_shares_by_topic(spark):
    placed = spark.createDataFrame([(0, 0, 0.7, [0.7, 0.2, 0.1]), (1, 0, 0.6, [0.6, 0.1, 0.3]), (2, 1, 0.9, [0.05, 0.9, 0.05]), (3, -1, 0.0, None)],
                                   "doc_id long, cluster int, strength double, shares array<double>")
    assigned = density.number_topics(placed.drop("shares"), min_topic_size=2)
    got = {r.doc_id: (r.topics, r.probabilities) for r in clusterers.topic_shares(placed, assigned).collect()}
    assert set(got) == {0, 1, 2} and got[0][0] == [-1, 0]
    assert got[0][1] == pytest.approx([0.3, 0.7]) and got[2][1] == pytest.approx([0.95, 0.05])
    assert clusterers.topic_shares(placed.limit(0), assigned).count() == 0


def test_halving_finds_the_blobs_and_no_rows_is_no_error(spark):
    x = blobs()
    got = {r.doc_id: (r.cluster, r.strength) for r in clusterers.BisectingParts(3).cluster(rows(spark, [*x, None]), "doc_id").collect()}
    assert len({frozenset(got[i][0] for i in range(a, a + 60)) for a in (0, 60, 120)}) == 3 and got[len(x)] == (-1, 0.0)
    centre = {c: np.mean([x[i] for i in range(len(x)) if got[i][0] == c], axis=0) for c in range(3)}
    assert got[7][1] == pytest.approx(1 / (1 + np.linalg.norm(x[7] - centre[got[7][0]])))
    for part in (clusterers.BisectingParts(2), clusterers.MixtureParts(2)):
        assert part.cluster(rows(spark, []), "doc_id").count() == 0
    for bad in (lambda: clusterers.BisectingParts(1), lambda: clusterers.MixtureParts(1), lambda: clusterers.MixtureParts(2, least=1.5)):
        with pytest.raises(ValueError):
            bad()


def test_fit_takes_any_parts(spark):
    class Halves:
        def cluster(self, reduced, id_col):
            return reduced.select(id_col, (F.col("reduced")[0] > 0).cast("int").alias("cluster"), F.lit(1.0).alias("strength"))

    x = [[1.0, 0.2], [2.0, 0.1], [-1.0, 0.3], [-3.0, 0.1], [-2.0, 0.5]]
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["red wine", "red cup", "blue sea", "blue sky", "blue bird"])], "doc_id long, text string")
    model = modeling.fit(docs, rows(spark, x, "embedding"), Modeling(min_topic_size=1), reducer=clusterers.UnitVectors(), clusterer=Halves())
    assert {r.doc_id: r.topic for r in model.assignments.collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


def test_ward_against_the_update_formula(spark):
    x = np.random.default_rng(11).normal(size=(14, 4))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, size, sets, want = 1 - unit @ unit.T, np.ones(14), {i: [i] for i in range(14)}, []
    while len(sets) > 1:
        w, a, b = min((d[i, j], i, j) for i in sets for j in sets if i < j)
        for k in sets:
            if k not in (a, b):
                d[a, k] = d[k, a] = np.sqrt(((size[a] + size[k]) * d[a, k] ** 2 + (size[b] + size[k]) * d[b, k] ** 2 - size[k] * w * w) / (size[a] + size[b] + size[k]))
        sets[a] = sorted(sets[a] + sets.pop(b))
        size[a] += size[b]
        want.append((round(float(w), 8), sets[a]))
    vectors = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "topic int, vector array<double>")
    merges = hierarchy.topic_hierarchy(vectors, "ward").orderBy("step").collect()
    assert [(round(r.distance, 8), r.topics) for r in merges] == want
    known = {i: [i] for i in range(14)} | {r.parent_id: r.topics for r in merges}
    assert all(sorted(known[r.left_id] + known[r.right_id]) == r.topics and min(known[r.left_id]) < min(known[r.right_id]) for r in merges)
    assert hierarchy.topic_hierarchy(vectors.limit(1)).count() == 0


def test_windows_of_token_sums_equal_plain_ones(spark, monkeypatch):
    docs = spark.createDataFrame([(0, "aa bb aa cc dd aa"), (1, "cc dd cc ee bb bb aa"), (2, "ee ee")], "doc_id long, text string")
    weights = terms.ctfidf(terms.term_counts(docs.withColumn("topic", F.col("doc_id").cast("int") % 2), "topic", "text", (1, 2), None))
    table = {(r.topic, r.word): (r.weight, r.idf) for r in weights.collect()}
    norm = {t: np.sqrt(sum(w * w for (s, _), (w, _) in table.items() if s == t)) for t in (0, 1)}
    new = ["aa bb aa zz cc dd", "bb", "", None, "zz zz zz zz zz", "aa aa aa aa bb ee ee cc dd"]
    frame = spark.createDataFrame(list(enumerate(new)), "doc_id long, text string")
    monkeypatch.setattr(outliers, "STRIP", 4)
    for window, stride, least in ((4, 1, 0.1), (3, 2, 0.0), (20, 1, 0.0)):
        want = {}
        for i, text in enumerate(new):
            t = (text or "").split()
            for s in range(0, max(len(t) - window, 0) + 1, stride) if t else []:
                part = t[s : s + window]
                bag = part + [f"{a} {b}" for a, b in zip(part, part[1:])]
                tf = {w: bag.count(w) for w in bag if any((k, w) in table for k in norm)}
                idf = {w: next(table[k, w][1] for k in norm if (k, w) in table) for w in tf}
                length = np.sqrt(sum((n * idf[w]) ** 2 for w, n in tf.items()))
                for k in norm:
                    score = sum(n * idf[w] * table[k, w][0] / norm[k] for w, n in tf.items() if (k, w) in table) / length if length else 0
                    if score > 0 and score >= least:
                        want[i, k] = want.get((i, k), 0) + score
        got = {(r.doc_id, r.topic): r.score for r in outliers.topic_distributions(frame, weights, least, window, stride, ngram_range=(1, 2)).collect()}
        assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_histogram_without_rows_and_with_one_value(spark):
    one = spark.createDataFrame([(2.0,), (2.0,), (None,)], "v double")
    assert [(r.bin, r["count"]) for r in audit.histogram(one, "v").collect()] == [(0, 2)]
    assert audit.histogram(one.limit(0), "v").count() == 0
