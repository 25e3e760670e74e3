"""Density clustering against planted clusters and a brute-force hierarchy."""

import numpy as np
import pytest

from topicloom.config import Clustering
from topicloom.operators import density


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "doc_id long, v array<double>")


def clusters(spark, x, cfg):
    out = density.density_clusters(frame(spark, x), "doc_id", "v", cfg).toPandas().sort_values("doc_id")
    return out["cluster"].to_numpy(), out["strength"].to_numpy()


def groups(labels):
    return {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels) - {-1}}


def blobs(seed=1):
    rng = np.random.default_rng(seed)
    centres = np.array([[0] * 8, [10] * 8, [-10] * 4 + [10] * 4])
    return np.vstack([rng.normal(c, 1, (100, 8)) for c in centres] + [rng.uniform(-30, 30, (30, 8))])


def brute_force(x, cfg):
    """The hierarchy by its definition: drop the longest edges of the complete graph level by level."""
    n, k = len(x), cfg.min_samples
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, min(k, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    reach = 2.0 ** (np.ceil(np.log2(np.maximum(reach, 1e-12)) * cfg.resolution - 1e-9) / cfg.resolution)

    def components(members, below):
        members, out = set(members), []
        while members:
            seen, todo = set(), [members.pop()]
            while todo:
                i = todo.pop()
                seen.add(i)
                near = {j for j in members if reach[i, j] < below}
                members -= near
                todo += near
            out.append(sorted(seen))
        return out

    def grow(members, birth):
        """``(members, stability, children)`` of the cluster ``members`` born at density ``birth``."""
        start, stability, current = members, 0.0, members
        while True:
            levels = np.unique([reach[i, j] for i in current for j in current if i < j])
            split = next((w, parts) for w in levels[::-1] if len(parts := components(current, w)) > 1)
            w, parts = split
            big = [p for p in parts if len(p) >= cfg.min_cluster_size]
            gone = len(current) - sum(map(len, big)) if len(big) == 1 else len(current)
            stability += gone * (1 / w - birth)
            if len(big) != 1:
                return start, stability, [grow(p, 1 / w) for p in big]
            current = big[0]

    def best(node, root=False):
        members, stability, kids = node
        below = [best(c) for c in kids]
        total = sum(b[0] for b in below)
        if root or (kids and stability < total):
            return total, [m for b in below for m in b[1]]
        return stability, [members]

    def leaves(node, root=False):
        if not node[2]:
            return [] if root else [node[0]]
        return [m for c in node[2] for m in leaves(c)]

    tree = grow(list(range(n)), 0.0)
    return {frozenset(m) for m in (best(tree, True)[1] if cfg.selection == "eom" else leaves(tree, True))}


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_planted_blobs(spark, selection):
    labels, strength = clusters(spark, blobs(), Clustering(20, 5, selection))
    found = [set(labels[a:a + 100]) for a in (0, 100, 200)]
    assert all(len(f) == 1 for f in found) and len(set.union(*found)) == 3
    assert (labels[300:] == -1).sum() >= 20
    assert (strength[labels == -1] == 0).all() and (strength[labels >= 0] > 0).all() and strength.max() <= 1


@pytest.mark.parametrize("selection, seed", [("eom", 0), ("leaf", 0), ("eom", 3), ("leaf", 5)])
def test_equals_brute_force(spark, selection, seed):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, s, (14, 2)) for c, s in (((0, 0), 0.4), ((3, 0), 0.3), ((3, 2), 0.5), ((8, 8), 1.0))] + [rng.uniform(-3, 10, (8, 2))])
    cfg = Clustering(6, 3, selection)
    assert groups(clusters(spark, x, cfg)[0]) == brute_force(x, cfg)


@pytest.mark.parametrize("selection", ["eom", "leaf"])
def test_leaves_of_any_size_find_the_same_blobs(spark, selection):
    x = blobs(2)
    whole = groups(clusters(spark, x, Clustering(20, 5, selection))[0])
    parted = groups(clusters(spark, x, Clustering(20, 5, selection, leaf_size=60))[0])
    assert len(parted) == len(whole) == 3
    for a in whole:
        assert max(len(a & b) / len(a | b) for b in parted) >= 0.9


def test_copies_of_all_points_make_the_same_clusters(spark):
    x = blobs(3)
    once = clusters(spark, x, Clustering(20, 5, "eom"))[0]
    often = clusters(spark, np.tile(x, (7, 1)), Clustering(140, 41, "eom"))[0]
    assert all((often[i * len(x):(i + 1) * len(x)] == once).all() for i in range(7))


def test_copies_in_leaves(spark):
    x = blobs(3)
    cfg = {"selection": "leaf", "leaf_size": 80}
    once = clusters(spark, x, Clustering(20, 5, **cfg))[0]
    often = clusters(spark, np.tile(x, (3, 1)), Clustering(60, 17, **cfg))[0]
    assert all((often[i * len(x):(i + 1) * len(x)] == once).all() for i in range(3))


def test_null_vectors_are_noise(spark):
    x = blobs()
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None)]
    out = density.density_clusters(spark.createDataFrame(rows, "doc_id long, v array<double>"), "doc_id", "v", Clustering(20, 5))
    got = {r.doc_id: (r.cluster, r.strength) for r in out.collect()}
    assert len(got) == len(rows) and got[1000] == (-1, 0.0)


def test_a_hot_point_is_one_cell(spark):
    x = np.vstack([np.zeros((300, 2)), np.random.default_rng(0).normal(20, 1, (60, 2)), np.random.default_rng(1).normal(-20, 1, (60, 2))])
    labels, _ = clusters(spark, x, Clustering(20, 5))
    assert len(set(labels[:300])) == 1 and labels[0] >= 0 and len(groups(labels)) == 3


def test_epsilon_merges_close_clusters(spark):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.2, (30, 2)) for c in ((0, 0), (2, 0), (20, 20))])
    assert len(groups(clusters(spark, x, Clustering(10, 3, "leaf"))[0])) == 3
    merged = groups(clusters(spark, x, Clustering(10, 3, "leaf", epsilon=3.0))[0])
    assert len(merged) == 2 and max(map(len, merged)) == 60


def test_too_little_data_is_noise(spark):
    assert set(clusters(spark, np.zeros((5, 2)), Clustering(10, 3))[0]) == {-1}
    assert density.density_clusters(frame(spark, []), "doc_id", "v").count() == 0


def test_topic_numbers(spark):
    rows = [(i, 5) for i in range(3)] + [(i, 2) for i in range(3, 9)] + [(i, 7) for i in range(9, 12)] + [(12, -1), (13, 9)]
    df = spark.createDataFrame(rows, "doc_id long, cluster int")
    got = {r.doc_id: r.topic for r in density.number_topics(df, min_topic_size=2).collect()}
    assert [got[i] for i in (3, 0, 9, 12, 13)] == [0, 1, 2, -1, -1]


def test_bad_settings():
    for bad in ({"min_cluster_size": 1}, {"min_samples": 0}, {"selection": "x"}, {"epsilon": -1.0}, {"trees": 0}):
        with pytest.raises(ValueError):
            Clustering(**bad)


@pytest.mark.parametrize("rest", [0, 6])
def test_one_row_per_point_tells_the_components_of_all_levels(spark, monkeypatch, rest):
    monkeypatch.setattr(density, "REST", rest)
    rng = np.random.default_rng(7)
    n, levels = 40, 5
    edges = sorted({(min(a, b), max(a, b)): int(rng.integers(levels)) for a, b in rng.integers(n, size=(60, 2)).tolist() if a != b}.items())
    df = spark.createDataFrame([(a, b, lvl) for (a, b), lvl in edges], "a long, b long, level int")
    forest = {r.node: (r.level, r.label) for r in density._forest(df, levels).collect()}
    assert len(forest) <= n - 1
    for level in range(levels):
        near = list(range(n))
        for _ in range(n):
            for (a, b), lvl in edges:
                if lvl <= level:
                    near[a] = near[b] = min(near[a], near[b])
        for node in range(n):
            at = node
            while at in forest and forest[at][0] <= level:
                at = forest[at][1]
            assert at == near[node]


def test_topic_numbers_are_brought_to_many_rows_without_a_shuffle(spark):
    rows = spark.range(3_000_000).selectExpr("id AS doc_id", "CAST(id % 5 AS int) AS cluster")
    plan = density.number_topics(rows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


@pytest.mark.parametrize("block, rest, smallest", [(7, 0, 1), (7, 6, 1), (7, 1 << 16, 4), (1 << 16, 0, 4)])
def test_blocks_name_the_components_of_all_levels(spark, monkeypatch, block, rest, smallest):
    monkeypatch.setattr(density, "BLOCK", block)
    monkeypatch.setattr(density, "REST", rest)
    rng = np.random.default_rng(11)
    n, levels = 50, 6
    others = ((np.arange(n) + rng.integers(1, 9, n)) % n).tolist()
    edges = [(min(a, b), max(a, b), int(rng.integers(levels))) for a, b in enumerate(others) if rng.random() < 0.9]
    edges += edges[:5]  # found by several trees
    points = spark.createDataFrame([(i, 1) for i in range(n)], "pid long, n long")
    rows = density._segments(points, spark.createDataFrame(edges, "a long, b long, level int"), len(edges), n, levels, smallest).collect()
    for level in range(-1, levels):
        near = list(range(n))
        for _ in range(n):
            for a, b, at in edges:
                if at <= level:
                    near[a] = near[b] = min(near[a], near[b])
        name = {r.node: r.label for r in rows if r.start <= level < r.end}
        large = [i for i in range(n) if near.count(near[i]) >= smallest]
        assert set(large) <= set(name)
        assert len({(near[i], name[i]) for i in large}) == len({near[i] for i in large}) == len({name[i] for i in large})
    assert all(r.n == 1 for r in rows)


@pytest.mark.parametrize("dim", [1, 2, 5, 20])
def test_neighbours_by_boxes_are_exact(dim):
    x = np.random.default_rng(dim).normal(size=(300, dim))
    d, to = density._nearest(x, 6)
    whole = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(whole, np.inf)
    assert np.allclose(np.sort(d, axis=1), np.sort(whole, axis=1)[:, :6]) and np.allclose(whole[np.arange(300)[:, None], to], d)


def test_stages_do_not_grow_with_the_levels(spark, monkeypatch):
    staged, real = [], density.materialize
    monkeypatch.setattr(density, "materialize", lambda df: staged.append(1) or real(df))
    monkeypatch.setattr(density, "REST", 50)
    x = np.concatenate([np.random.default_rng(9).normal(c, s, 60) for c, s in ((0, 1), (30, 3), (100, 0.1), (150, 9))])[:, None]
    assert len(groups(clusters(spark, x, Clustering(5, 2))[0])) > 3
    assert len(staged) < 40


@pytest.mark.parametrize("setting, value", [("LEAVES", 1), ("BLOCK", 50), ("HOT", 2)])
def test_blobs_over_cells_blocks_and_hot_copies(spark, monkeypatch, setting, value):
    x = np.vstack([blobs(2), blobs(2)[:40]])
    cfg = Clustering(20, 5, "leaf", leaf_size=60)
    once = clusters(spark, x, cfg)[0]
    monkeypatch.setattr(density, setting, value)
    again = clusters(spark, x, cfg)[0]
    assert len(groups(again)) == 3 and (again[330:] == again[:40]).all()
    if setting == "LEAVES":  # other cuts
        assert all(any(len(a & b) / len(a | b) >= 0.9 for b in groups(once)) for a in groups(again))
    else:
        assert (again == once).all()


def test_rows_of_a_point_may_come_in_several_batches(spark):
    x, cfg = blobs(5), Clustering(20, 5, leaf_size=90)
    whole = clusters(spark, x, cfg)[0]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert (clusters(spark, x, cfg)[0] == whole).all()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_vectors_with_a_missing_coordinate_are_far_from_all(spark):
    x = blobs(6)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000 + i, [None, *[float(v) for v in r[1:]]]) for i, r in enumerate(x[:20])]
    got = {i: c for i, c, _ in density.density_clusters(spark.createDataFrame(rows + odd, "doc_id long, v array<double>"), "doc_id", "v", Clustering(20, 5)).collect()}
    assert [got[i] for i in range(len(x))] == clusters(spark, x, Clustering(20, 5))[0].tolist()
    assert {got[1000 + i] for i in range(20)} == {-1}


def test_settings_share_the_steps_that_they_agree_in(spark, monkeypatch):
    staged, real = [], density.materialize
    monkeypatch.setattr(density, "materialize", lambda df: staged.append(1) or real(df))
    grid = [Clustering(20, 5, "eom"), Clustering(20, 5, "leaf"), Clustering(30, 5, "leaf"), Clustering(20, 5, "eom", 0.5)]
    from topicloom.plans import modeling

    runs = {r.run: r for r in modeling.parameter_runs(frame(spark, blobs(1)).withColumnRenamed("v", "reduced"), grid).collect()}
    assert len(staged) < 50
    for i, cfg in enumerate(grid):
        labels = clusters(spark, blobs(1), cfg)[0]
        assert (runs[i].n_topics, runs[i].largest) == (len(groups(labels)), max(map(len, groups(labels))))
        assert runs[i].noise_share == pytest.approx((labels == -1).mean())
