"""Decontamination, near duplicates and the quality classifier, against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F
from topicloom.llm import common, components, decontam, neardup, quality

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_overlaps(docs, bench, window=10):
    out = []
    items = [(i, words(t)) for i, t in bench]
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, b in items:
            n = min(len(b), window)
            grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
            for k in range(len(w) - n + 1 if n else 0):
                if tuple(w[k : k + n]) in grams:
                    hit.update(range(k, k + n))
                    if item is not None:
                        ids.add(str(item))
        out.append((doc_id, len(w), len(hit), ",".join(sorted(ids)), bool(hit)))
    return Counter(out)


def vocabulary(seed, n=40):
    rng = random.Random(seed)
    return lambda k: " ".join(rng.choice([f"w{i}" for i in range(n)] + ["Été", "x9"]) for _ in range(k))


@pytest.mark.parametrize("n_words", [3, 40])
def test_decontamination(spark, n_words):
    text = vocabulary(n_words, n_words)
    bench = [(i, text(k)) for i, k in enumerate([10, 11, 25, 40, 9, 5, 2, 14])] + [(20, None), (21, ""), (None, text(12)), (3, text(30))]
    bench += [bench[2], (22, bench[2][1]), (23, bench[0][1].upper())]
    some = [b[1] for b in bench if b[1]]
    docs = [(i, f"{text(7)} {some[i % len(some)]}, {text(i)}!") for i in range(30)] + [(40 + i, text(60)) for i in range(5)]
    docs += [(50, None), (51, ""), (None, some[0]), (52, "..."), (53, " ".join(some[2].split()[:9])), (54, text(9000) + " " + some[3])]
    docs += [docs[0], docs[1], (0, "another text under a used id")]
    frame = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id long, text string, n_words int, class string")
    items = spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, h int")
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontam.overlaps(frame, items).collect())
    assert got == brute_overlaps(docs, bench)
    kept = decontam.clean(frame, items)
    assert kept.columns == frame.columns
    clean = Counter(d for d in docs if not next(iter(brute_overlaps([d], bench)))[4])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == clean


def test_decontamination_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [(r.doc_id, r.n_hit) for r in decontam.overlaps(docs, items).collect()] == [(1, 0)]
    assert decontam.overlaps(docs.limit(0), spark.createDataFrame([(1, "a")], items.schema)).collect() == []


def test_full_bitmap_changes_nothing(spark):
    text = vocabulary(1)
    bench = [(i, text(20)) for i in range(30)]
    docs = [(i, text(5) + " " + bench[i][1]) for i in range(30)]
    a, b = (spark.createDataFrame(x, f"{k} long, text string") for x, k in ((docs, "doc_id"), (bench, "item_id")))
    got = Counter((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in decontam.overlaps(a, b, max_bits=64).collect())
    assert got == brute_overlaps(docs, bench)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(rng.randrange(1000, 1060), rng.randrange(1000, 1060)) for _ in range(40)]
    edges = [e for e in edges if e[0] != e[1]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


def changed(text, rng, k):
    w = text.split()
    for i in rng.sample(range(len(w)), k):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(f"t{rng.randrange(3000)}" for _ in range(n))
    passage = text(60)
    base = [text(200) for _ in range(12)]
    docs = [(i, t) for i, t in enumerate(base)]
    docs += [(100 + i, changed(t, rng, 2)) for i, t in enumerate(base)]  # near copies
    docs += [(200 + i, t.upper() + " !") for i, t in enumerate(base[:4])]  # equal words
    docs += [(300 + i, f"{text(120)} {passage} {text(120)}") for i in range(40)]  # a shared passage
    docs += [(400 + i, changed(base[0], rng, 1)) for i in range(60)]  # a large group
    docs += [(500, None), (501, None), (502, ""), (503, ""), (504, "hi"), (505, "Hi."), (506, "one two"), (507, text(9000)), (None, base[5])]
    docs += [(3, base[3])] * 2 + [(508, None)] * 3
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, class_id int, marks string")
    got = neardup.near_duplicates(frame).collect()
    assert Counter(r.doc_id for r in got) == Counter(d[0] for d in docs)
    found = {r.doc_id: r.class_id for r in got}
    for i in range(12):
        assert found[i] == found[100 + i] == i
    assert all(found[200 + i] == i for i in range(4)) and all(found[400 + i] == 0 for i in range(60))
    assert all(found[300 + i] == 300 + i for i in range(40))
    assert (found[500], found[501], found[503], found[505], found[506], found[507], found[None]) == (500, 501, 502, 504, 506, 507, 5)
    sizes = {r.doc_id: r.class_size for r in got}
    assert sizes[0] == 63 and sizes[3] == 5 and sizes[500] == 1
    kept = neardup.first_of_each(frame)
    assert kept.columns == frame.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(found.values())) + Counter({508: 2})  # null texts are no copies
    assert neardup.near_duplicates(frame.limit(0)).collect() == []


def test_marked_rows_miss_none(spark, monkeypatch):
    keys = spark.range(-500, 500, 3).selectExpr("xxhash64(id) AS k")
    rows = spark.range(-500, 500).selectExpr("id", "xxhash64(id) AS _own", "'x' AS _key").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS _own, 'x' AS _key"))
    for words in (common.MARK_WORDS, 4):
        monkeypatch.setattr(common, "MARK_WORDS", words)
        got = common.marked(rows, F.col("_own"), keys)
        assert got.columns == [*rows.columns, "_maybe"]
        found = {r.id: r._maybe for r in got.collect()}
        assert len(found) == 1001 and found[None] is False and all(found[i] for i in range(-500, 500, 3))
        assert words == 4 or sum(found.values()) < 340
    assert not any(r._maybe for r in common.marked(rows, F.col("_own"), keys.limit(0)).collect())


def test_agreement_estimates_similarity():
    rng = random.Random(1)
    base = " ".join(f"t{rng.randrange(900)}" for _ in range(400))
    pairs = [(base, changed(base, rng, k)) for k in (1, 4, 8, 16, 30)]
    df = rng_counts(base)
    idf = neardup.inverse_frequencies(df, 50)
    draws = neardup.Draws()
    for a, b in pairs:
        texts = [a.encode(), b.encode()]
        marks = draws.sample(*neardup.shingles(neardup.Words(texts), idf), 2)
        true = neardup.similarities(texts, idf)[0, 1]
        assert abs((marks[0] == marks[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / neardup.SAMPLES) + 0.02
    assert neardup.similarities([b"a b c d e f", b"A b c d e f!"], idf)[0, 1] == pytest.approx(1)


@pytest.mark.parametrize("weight", [1 + i / 100 for i in range(101)])
def test_a_similarity_of_exactly_four_fifths_is_a_link(weight):
    idf = np.full(1 << neardup.BUCKET_BITS, weight)
    shared = " ".join(f"w{i}" for i in range(12))  # eight shingles, and one more of either text
    assert neardup.links([f"{shared} left".encode(), f"{shared} right".encode()], idf).tolist() == [[0, 1]]
    assert neardup.links([f"{shared} left".encode(), f"{shared} right side".encode()], idf).tolist() == []


def test_similarities_of_a_block():
    rng = random.Random(2)
    base = " ".join(f"t{rng.randrange(30)}" for _ in range(150))
    texts = [changed(base, rng, k % 9) + (" " + base[:200]) * (k % 3) for k in range(20)] + ["", "a b", "a b"]
    idf = neardup.inverse_frequencies(rng_counts(base), 50)
    sets = []
    for t in texts:
        w, v = words(t), Counter()
        values = idf[neardup.word_buckets(neardup.Words([t.encode()]))]
        n = min(5, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            v[tuple(w[k : k + n])] += float(np.round(values[k : k + n].mean(), 4))
        sets.append(v)
    got = neardup.similarities([t.encode() for t in texts], idf, columns=37)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i == j:
                continue
            union = sum((a | b).values())
            assert got[i, j] == pytest.approx(sum((a & b).values()) / union if union else 0, abs=1e-5)


def rng_counts(text):
    df = np.ones(1 << neardup.BUCKET_BITS, np.int64)
    df[neardup.word_buckets(neardup.Words([text.encode()]))[::3]] = 40
    return df


def brute_statistics(text):
    """A few of the statistics, word by word."""
    w = words(text)
    pairs = list(zip(w, w[1:]))
    lines = [x for x in (text or "").split("\n") if x]
    return {
        "log_words": np.log1p(len(w)), "distinct_words": len(set(w)) / max(len(w), 1), "distinct_pairs": len(set(pairs)) / max(len(pairs), 1),
        "same_as_last": sum(a == b for a, b in pairs) / max(len(w), 1), "bars_per_word": (text or "").count("|") / max(len(w), 1),
        "repeated_lines": 1 - len(set(lines)) / max(len(lines), 1), "log_bytes": np.log1p(len((text or "").encode())),
    }


def test_statistics():
    texts = ["", "a a a b", "One line.\nOne line.\nother", "x | y | z", "É é É\n\n\n", "word " * 5000, "\n", "...", "Tail"]
    got = quality.statistics([t.encode() for t in texts])
    for row, t in zip(got, texts):
        for name, value in brute_statistics(t).items():
            assert row[quality.NAMES.index(name)] == pytest.approx(value, abs=1e-4), (t, name)
    alone = np.concatenate([quality.statistics([t.encode()]) for t in texts])
    assert np.allclose(alone, got)
    assert quality.statistics([]).shape == (0, len(quality.NAMES))


def test_trees_walk_like_a_plain_loop():
    rng = np.random.default_rng(0)
    x = rng.random((400, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit(x, y, trees=20, depth=3)
    got = model.score(x)
    assert ((got > 0.5) == (y == 1)).mean() > 0.97
    for i in range(0, 400, 37):
        margin = model.base
        for t in range(20):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(x[i, model.feature[t, node]] > model.threshold[t, node])
            margin += model.leaf[t, node - 7]
        assert got[i] == pytest.approx(1 / (1 + np.exp(-margin)))
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert quality.fit(x, np.ones(400)).score(x).min() > 0.9


def test_quality_edges(spark):
    good = [(i, f"A plain sentence number {i} with several different words in it.") for i in range(60)]
    bad = [(100 + i, "SHOUT!! " * (5 + i % 7)) for i in range(60)]
    odd = [(200, None), (201, ""), (None, "no id"), (202, "x" * 200_000), good[0], good[0]]
    docs = spark.createDataFrame([(*d, "s") for d in good + bad + odd], "doc_id long, text string, score string")
    labels = [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (5, None), (999, 0), (0, 1)]
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    scored = quality.score(docs, model)
    assert scored.columns == ["doc_id", "text", "score"]
    rows = scored.collect()
    assert len(rows) == len(good + bad + odd) and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.score for r in rows}
    assert min(by[i] for i, _ in good) > 0.7 > 0.3 > max(by[i] for i, _ in bad)
    assert by[200] == by[201]
    kept = quality.score(docs, model, least=0.5).collect()
    assert {r.doc_id for r in kept} >= {i for i, _ in good} and not {r.doc_id for r in kept} & {i for i, _ in bad}
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []
