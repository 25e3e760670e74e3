"""Density clustering with noise, in joins over staged tables.

The hierarchy of the mutual-reachability graph (Campello et al. 2013), its
distances rounded up to steps of ``2 ** (1 / resolution)``, by one way at
every size; neither points, edges nor clusters meet in one task, but for the last ``REST`` edges of a graph:

* equal points become one point of their number; near points get near numbers, by cells of a grid cut at quantiles (Z-order);
* ``trees`` random projection trees cut the points at quantiles into leaves of
  at most about ``leaf_size``, the last cuts within the task of a cell of ``LEAVES`` leaves; within the leaves of a tree neighbours and
  spanning trees are exact, and what a cut of one tree parts another joins.
  Points that fit into one leaf get the exact hierarchy;
* the distance to the ``min_samples``-th neighbour is taken over all leaves of
  a point, and the spanning trees of all leaves make one graph;
* the components of that graph at every step of distance are the hierarchy. Blocks of near points contract on their own
  what no edge to another block can change, and what is left of all blocks goes on as a smaller graph.
  Every point keeps the steps at which its component gets another name; a component of less than ``min_cluster_size`` points is not followed;
* a cluster is a path of components from where its parent divides. Its
  stability is a sum over its points, and the choice of clusters goes from
  clusters without children upwards, one staged round per height.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Clustering
from ..session import materialize
from .joins import SALTS, salted_join
from .sampling import with_row_number

#: a node of a projection tree is cut into at most FAN parts, at most DEPTH times
FAN, DEPTH = 16, 14
SEED = 42
#: distances below are not told apart
TINY = 1e-12
#: numbers per block of differences
CHUNK = 4_000_000
#: leaves of a cell that one task cuts, at most
LEAVES = 32
#: binary digits of the cells that number the points; points of a block
BITS, BLOCK = 12, 1 << 16
#: copies of a vector from which its rows are shared by several tasks
HOT = 10_000
#: edges of a graph that is left to one task, at most
REST = 1 << 16


def _ways(depth: int, trees: int, dim: int) -> np.ndarray:
    """The random direction of every tree at this depth."""
    return np.random.default_rng([SEED, depth]).normal(size=(trees, dim))


def _projections(tree: str, depth: int, trees: int, dim: int) -> Column:
    """``_v`` along the random direction of its tree at this depth."""
    ways = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in _ways(depth, trees, dim)])
    return F.aggregate(F.zip_with("_v", F.element_at(ways, F.col(tree) + 1), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _zone(points: DataFrame, dim: int) -> Column:
    """Number of the cell of a point in a grid cut at quantiles; near cells mostly have near numbers."""
    used = min(dim, BITS)
    if not used:
        return F.lit(0)
    each = BITS // used
    parts = [i / 2**each for i in range(1, 2**each)]
    cuts = points.agg(*[F.percentile_approx(F.get("_v", F.lit(i)), parts, 1000) for i in range(used)]).first()
    digits, below = [], lambda value: lambda c: c < value
    for i, row in enumerate(cuts):
        known = F.array(*[F.lit(float(c)) for c in row or []]).cast("array<double>")
        digits.append(F.size(F.filter(known, below(F.get("_v", F.lit(i))))))
    bits = [F.shiftleft(F.shiftright(digit, at).bitwiseAND(1), at * used + i) for at in range(each) for i, digit in enumerate(digits)]
    return reduce(Column.__add__, bits)


def _cells(points: DataFrame, n: int, dim: int, cfg: Clustering) -> DataFrame:
    """``pid, _v, n`` with ``tree, depth, cell``: cells of at most about ``LEAVES`` leaves, cut ``depth`` times."""
    rows = points.select("pid", "_v", "n")
    if n <= cfg.leaf_size:  # all trees would be this leaf
        return rows.withColumns({"tree": F.lit(0), "depth": F.lit(0), "cell": F.lit(0).cast("long")})
    most = LEAVES * cfg.leaf_size
    trees = F.explode(F.sequence(F.lit(0), F.lit(cfg.trees - 1)))
    rows = rows.withColumn("tree", trees).withColumns({"depth": F.lit(0), "cell": F.lit(0).cast("long")})
    parts = [i / FAN for i in range(1, FAN)]
    for depth in range(DEPTH if n > most else 0):
        rows = materialize(rows.withColumn("_p", _projections("tree", depth, cfg.trees, dim)))
        sizes = rows.filter(F.col("depth") == depth).groupBy("tree", "cell").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_p", parts, 1000).alias("_cuts"))
        full = materialize(sizes.filter(F.col("_n") > most))
        if full.isEmpty():
            break
        ways = F.least(F.pow(F.lit(2.0), F.ceil(F.log2(F.col("_n") / cfg.leaf_size))), F.lit(float(FAN))).cast("int")
        cuts = full.select("tree", "cell", "_cuts", ways.alias("_ways"))
        rank = F.size(F.filter("_cuts", lambda c: c < F.col("_p")))
        child = F.floor(F.coalesce(rank * F.col("_ways") / FAN, F.lit(0)))
        rows = salted_join(rows, cuts, ["tree", "cell"], "left", ["pid"]).withColumn("cell", F.col("cell") * FAN + child)
        rows = rows.select("pid", "_v", "n", "tree", F.when(F.col("_ways").isNull(), F.col("depth")).otherwise(depth + 1).alias("depth"), "cell")
    return rows.drop("_p")


def _vectors(table: pa.Table) -> np.ndarray:
    return table["_v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(table), -1)


def _parts(x: np.ndarray, tree: int, depth: int, cfg: Clustering) -> list[np.ndarray]:
    """The rows of every leaf of a cell that was cut ``depth`` times, but for those of which a coordinate is missing: they are far from all."""
    todo, leaves = [(np.flatnonzero(np.isfinite(x).all(axis=1)), depth)], []
    while todo:
        at, depth = todo.pop()
        if len(at) <= cfg.leaf_size or depth >= DEPTH:
            leaves.append(at)
            continue
        p = sum(x[at, j] * c for j, c in enumerate(_ways(depth, cfg.trees, x.shape[1])[tree]))
        ways = min(FAN, 2 ** int(np.ceil(np.log2(len(at) / cfg.leaf_size))))
        child = np.searchsorted(np.quantile(p, [i / ways for i in range(1, ways)], method="inverted_cdf"), p)
        todo += [(at[child == i], depth + 1) for i in range(ways) if (child == i).any()]
    return leaves


def _squares(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Squared distance of every row of ``y`` to every row of ``x``; a few coordinates are added one by one, without a block of differences."""
    if 0 < x.shape[1] < 16:
        return sum((y[:, None, j] - x[None, :, j]) ** 2 for j in range(x.shape[1]))
    return ((y[:, None] - x[None]) ** 2).sum(axis=2)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """A list per row, that of ``ends[i]`` to before ``ends[i + 1]``."""
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values))


NEAR = "tree int, depth int, cell long, pid long, _v array<double>, n long, d array<double>, to array<long>, w array<long>"


def _boxes(x: np.ndarray, most: int = 48) -> list[np.ndarray]:
    """The points in groups of at most ``most``, halved at the median of their widest coordinate."""
    todo, boxes = [np.arange(len(x))], []
    while todo:
        at = todo.pop()
        if len(at) <= most or not x.shape[1]:
            boxes.append(at)
            continue
        y = x[at]
        at = at[np.argpartition(y[:, np.argmax(y.max(axis=0) - y.min(axis=0))], len(at) // 2)]
        todo += [at[:len(at) // 2], at[len(at) // 2:]]
    return boxes


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distance and number of the ``k`` nearest others of every point.

    The points of a box meet the boxes that are not farther than the ``k``-th neighbour within it.
    """
    d, to, boxes = np.empty((len(x), k)), np.empty((len(x), k), dtype=int), _boxes(x) if k else []
    if not boxes:
        return d, to
    low, high = (np.array([f(x[at], axis=0) for at in boxes]) for f in (np.min, np.max))
    for mine, at in enumerate(boxes):
        y, there = x[at], None
        if len(boxes) > 1 and len(at) > k:
            own = _squares(y, y)
            far = np.partition(own, k, axis=1)[:, k].max()  # the first is the point itself
            gap = (np.maximum(0.0, np.maximum(low - high[mine], low[mine] - high)) ** 2).sum(axis=1)
            there = np.concatenate([boxes[i] for i in np.flatnonzero(gap <= far * (1 + 1e-9))])
        there = np.arange(len(x)) if there is None else there
        z, step = x[there], max(1, CHUNK // 16 // max(1, len(there) * max(1, x.shape[1])))
        for start in range(0, len(at), step):
            some = at[start:start + step]
            square = _squares(y[start:start + step], z)
            square[there[None] == some[:, None]] = np.inf
            best = np.argpartition(square, k - 1, axis=1)[:, :k]
            d[some], to[some] = np.sqrt(np.take_along_axis(square, best, axis=1)), there[best]
    return d, to


NEAR = "tree int, depth int, cell long, pid long, _v array<double>, n long, d array<double>, to array<long>, w array<long>"


def _neighbours(min_samples: int, cfg: Clustering):
    """The nearest ``min_samples`` other points of every point of a leaf, in the leaves of a cell."""

    def run(table: pa.Table) -> pa.Table:
        x, names, weights = _vectors(table), table["pid"].to_numpy(), table["n"].to_numpy()
        order = _parts(x, table["tree"][0].as_py(), table["depth"][0].as_py(), cfg)
        known = [_nearest(x[rows], min(min_samples, len(rows) - 1)) for rows in order]
        far = np.flatnonzero(~np.isfinite(x).all(axis=1))
        order, known = [*order, far], [*known, (np.empty((len(far), 0)), np.empty((len(far), 0), dtype=int))]
        d, to = np.concatenate([d.ravel() for d, _ in known]), np.concatenate([rows[to].ravel() for rows, (_, to) in zip(order, known)])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.full(*d.shape) for d, _ in known]))])
        table = table.select(["tree", "depth", "cell", "pid", "_v", "n"]).take(np.concatenate(order))
        for name, values in (("d", d), ("to", names[to]), ("w", weights[to])):
            table = table.append_column(name, _lists(values, ends))
        return table

    return run


def _cored(table: pa.Table, min_samples: int) -> pa.RecordBatch:
    """Rows of whole points, point by point, with ``core``."""
    pid, own = table["pid"].to_numpy(), table["n"].to_numpy()
    point = np.cumsum(np.diff(pid, prepend=pid[0] - 1) != 0) - 1
    first = np.flatnonzero(np.diff(point, prepend=-1))
    lists = [table[c].combine_chunks() for c in ("d", "to", "w")]
    of = np.repeat(point, lists[0].value_lengths().to_numpy())
    d, to, w = [values.flatten().to_numpy() for values in lists]
    order = np.lexsort((to, d, of))
    of, d, to, w = of[order], d[order], to[order], w[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (to[1:] != to[:-1]) | (d[1:] != d[:-1])  # found by several trees
    of, d, w = of[new], d[new], w[new]
    starts = np.searchsorted(of, np.arange(len(first)))
    sums = np.concatenate([[0], np.cumsum(w)])
    before = own[first][of] + sums[:-1] - sums[starts][of]
    taken = np.bincount(of[before <= min_samples], minlength=len(first))
    core = np.zeros(len(first))
    core[taken > 0] = d[(starts + taken - 1)[taken > 0]]
    kept = table.select(["tree", "depth", "cell", "pid", "_v", "n"]).append_column("core", pa.array(core[point]))
    return kept.combine_chunks().to_batches()[0]


def _cores(min_samples: int):
    """Distance at which a point has ``min_samples`` others, its copies first; that of the farthest known if there are fewer.

    The rows of a point follow each other, but may go on in the next batch.
    """

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            pid = table["pid"].to_numpy()
            whole = int(np.searchsorted(pid, pid[-1]))
            if whole:
                yield _cored(table.slice(0, whole), min_samples)
            held = table.slice(whole)
        if held is not None:
            yield _cored(held, min_samples)

    return run


def _spanning_tree(cfg: Clustering):
    """Prim's trees of the leaves of a cell under mutual reachability: ``a, b`` and the step of their distance."""

    def leaf(x: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, ...]:
        n, here = len(x), np.arange(len(x))
        x, core, best, parent = x.T.copy(), core ** 2, np.full(n, np.inf), np.zeros(n, dtype=int)
        a, b, length, at = np.zeros(max(n - 1, 0), dtype=int), np.zeros(max(n - 1, 0), dtype=int), np.full(max(n - 1, 0), np.inf), 0
        for i in range(n - 1):
            if i % 64 == 0:  # those in the tree go
                kept = np.isfinite(core)
                kept[at] = True
                at = int(np.count_nonzero(kept[:at]))
                x, core, best, parent, here = x[:, kept].copy(), core[kept], best[kept], parent[kept], here[kept]
                d, part, closer = np.empty(len(here)), np.empty(len(here)), np.empty(len(here), dtype=bool)
            np.subtract(x[0], x[0, at], out=d) if len(x) else d.fill(0.0)
            np.multiply(d, d, out=d)
            for row in x[1:]:
                np.subtract(row, row[at], out=part)
                np.multiply(part, part, out=part)
                np.add(d, part, out=d)
            np.maximum(d, core[at], out=d)
            core[at] = best[at] = np.inf
            np.maximum(d, core, out=d)
            np.less(d, best, out=closer)
            np.copyto(best, d, where=closer)
            np.copyto(parent, here[at], where=closer)
            at = int(best.argmin())
            a[i], b[i], length[i] = parent[at], here[at], best[at]
            if length[i] == np.inf:  # too far to tell
                break
        known = np.isfinite(length)
        return a[known], b[known], np.sqrt(length[known])

    def run(table: pa.Table) -> pa.Table:
        x, core, names, found = _vectors(table), table["core"].to_numpy(), table["pid"].to_numpy(), []
        for rows in _parts(x, table["tree"][0].as_py(), table["depth"][0].as_py(), cfg):
            a, b, length = leaf(x[rows], core[rows])
            a, b = names[rows[a]], names[rows[b]]
            steps = np.ceil(np.log2(np.maximum(length, TINY)) * cfg.resolution - 1e-9).astype(np.int32)
            found.append((np.minimum(a, b), np.maximum(a, b), steps))
        return pa.table({c: np.concatenate([f[i] for f in found]) for i, c in enumerate(("a", "b", "step"))})

    return run


def _merges(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of :func:`_forest` of a graph that fits into one task."""
    pdf = pdf.sort_values("level")
    names, ends = np.unique(pdf[["a", "b"]].to_numpy(), return_inverse=True)
    up, out = list(range(len(names))), []

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    levels, ends = pdf["level"].to_numpy(), ends.reshape(-1, 2)
    for level in np.unique(levels):
        lost = []
        for a, b in ends[slice(*np.searchsorted(levels, [level, level + 1]))].tolist():
            lo, hi = sorted((root(a), root(b)))
            if lo < hi:
                up[hi] = lo
                lost.append(hi)
        out += [(level, names[i], names[root(i)]) for i in lost]
    return pd.DataFrame(out, columns=["level", "node", "label"])


def _renamed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the components of their ends, those within a component left out."""
    for end in ("a", "b"):
        to = labels.select("sub", F.col("node").alias(end), F.col("label").alias("_to"))
        edges = edges.join(to, ["sub", end], "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return edges.filter("a <> b")


def _components(edges: DataFrame) -> DataFrame:
    """``sub, node, label``: the smallest node of the component, of every node that is not it, in each graph ``sub``.

    Each round ties every node to its smallest neighbour, if that is smaller,
    follows the ties to their ends, and goes on with the edges between these ends; the last ``REST``
    edges are one task's. Joins run between written tables, whose skewed partitions Spark splits.
    """
    edges, found = materialize(edges.select("sub", "a", "b")), []
    while (number := edges.count()) > REST:
        both = edges.select("sub", F.col("a").alias("node"), F.col("b").alias("to"))
        both = both.unionByName(edges.select("sub", F.col("b").alias("node"), F.col("a").alias("to")))
        ties = materialize(both.groupBy("sub", "node").agg(F.min("to").alias("label")).filter("label < node"))
        moving = True
        while moving:
            ahead = ties.select("sub", F.col("node").alias("label"), F.col("label").alias("_next"))
            moved = ties.join(ahead, ["sub", "label"], "left")
            moved = materialize(moved.select("sub", "node", F.coalesce("_next", "label").alias("label"), F.col("_next").isNotNull().alias("_moved")))
            ties, moving = moved.drop("_moved"), not moved.filter("_moved").isEmpty()
        found.append(ties)
        left = _renamed(edges, ties).select("sub", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = materialize(left.distinct())
    schema = "sub int, node long, label long"
    if number:
        rest = edges.withColumn("level", F.lit(0)).groupBy("sub")
        found.append(materialize(rest.applyInPandas(lambda key, pdf: _merges(pdf).assign(sub=key[0])[["sub", "node", "label"]], schema)))
    if not found:
        return edges.select("sub", F.col("a").alias("node"), F.col("b").alias("label"))
    labels = found[-1]
    for ties in reversed(found[:-1]):
        ends = labels.select("sub", F.col("node").alias("label"), F.col("label").alias("_to"))
        further = ties.join(ends, ["sub", "label"], "left").select("sub", "node", F.coalesce("_to", "label").alias("label"))
        labels = further.unionByName(labels)
    return materialize(labels)


def _forest(edges: DataFrame, levels: int) -> DataFrame:
    """``level, node, label``: at which level a component ceases to be named by ``node``, and the name it gets.

    A component is named by its smallest point, so there is one row per point,
    however many levels there are. The levels are halved: the components of the lower
    half are the nodes of the graph of the upper half, and both halves go on at the
    same time, until a graph is one level or fits into one task.
    """
    span = 1 << (levels - 1).bit_length()
    rows, done = edges.withColumn("sub", F.lit(0)), []
    while True:
        few = [r["sub"] for r in rows.groupBy("sub").count().filter(F.col("count") <= REST).collect()]  # one row per level at most
        if few:
            done.append(rows.filter(F.col("sub").isin(few)).groupBy("sub").applyInPandas(_merges, "level int, node long, label long"))
            rows = rows.filter(~F.col("sub").isin(few))
        if rows.isEmpty():
            break
        if span == 1:
            done.append(_components(rows).select(F.col("sub").alias("level"), "node", "label"))
            break
        span //= 2
        low, high = rows.filter(F.col("level") < F.col("sub") + span), rows.filter(F.col("level") >= F.col("sub") + span)
        high = _renamed(high, _components(low)).groupBy((F.col("sub") + span).alias("sub"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rows = materialize(low.unionByName(high.agg(F.min("level").alias("level"))))
    return materialize(reduce(DataFrame.unionByName, done))


CONTRACTED = "node long, n long, root long, joined int, up array<struct<level:int,label:long>>, total long, a long, b long, level int, side int"
UPS = "array<struct<level:int,label:long>>"
UP = pa.list_(pa.struct([("level", pa.int32()), ("label", pa.int64())]))


def _contract(width: int, smallest: int):
    """What the edges within a block of ``width`` points tell of its components, whatever the edges to other blocks do.

    A component whose lightest edge stays in the block, ties included, goes into the one at the other end. Of the others,
    edges that close a circle are left out. Rows of points have ``root``, the point that they end in, the level ``joined`` at which they
    are named by it, and their names before, but for those of less than ``smallest`` points; rows with ``level`` are edges that are left, with
    ``root`` and ``side`` if the other end is in another block.
    """

    def run(key, points: pa.Table, edges: pa.Table) -> pa.Table:
        order = np.argsort(points["pid"].to_numpy())
        pid, n = points["pid"].to_numpy()[order], points["n"].to_numpy()[order]
        table = np.unique(np.stack([edges[c].to_numpy().astype(np.int64) for c in ("level", "a", "b")], axis=1), axis=0)
        block = key[0].as_py()
        level, in_a, in_b = table[:, 0], table[:, 1] // width == block, table[:, 2] // width == block
        ends = np.searchsorted(pid, table[:, 1:])
        never = int(level.max(initial=0)) + 1
        out = np.full(len(pid), never)
        for mine, other, side in ((in_a, in_b, 0), (in_b, in_a, 1)):
            np.minimum.at(out, ends[mine & ~other, side], level[mine & ~other])
        own = in_a & in_b
        into, when, merged, left = [-1] * len(pid), [never] * len(pid), [], []
        up, linked, out, size = list(range(len(pid))), list(range(len(pid))), out.tolist(), n.tolist()

        def root(tree: list[int], i: int) -> int:
            while tree[i] != i:
                tree[i] = i = tree[tree[i]]
            return i

        for at, (u, v) in zip(level[own].tolist(), ends[own].tolist()):
            u, v = root(up, u), root(up, v)
            if u == v:
                continue
            if out[u] < at and out[v] < at:
                s, t = root(linked, u), root(linked, v)
                if s != t:
                    linked[s] = t
                    left.append((u, v, at))
                continue
            if out[v] >= at and (out[u] < at or size[v] < size[u]):
                u, v = v, u
            up[u] = linked[u] = into[u] = v
            when[u] = at
            size[v] += size[u]
            out[v] = min(out[u], out[v])
            merged.append(u)
        joined, names = [-1] * len(pid), [()] * len(pid)
        roots = list(range(len(pid)))
        for u in reversed(merged):
            v = into[u]
            while when[v] == when[u]:
                v = into[v]
            if into[v] < 0:
                roots[u], joined[u] = v, when[u]
            else:
                roots[u], joined[u] = roots[v], joined[v]
                names[u] = ((when[u], v), *names[v]) if size[v] >= smallest else names[v]
        names = [((-1, u), *rest) if into[u] >= 0 and size[u] >= smallest else rest for u, rest in enumerate(names)]
        flat = np.array([name for rest in names for name in rest], dtype=np.int64).reshape(-1, 2)
        lengths = np.concatenate([[0], np.cumsum([len(rest) for rest in names], dtype=np.int64)])
        named = pa.StructArray.from_arrays([pa.array(flat[:, 0].astype(np.int32)), pa.array(pid[flat[:, 1]])], fields=list(UP.value_type))
        roots = np.array(roots, dtype=np.int64)
        rows = {"node": pid, "n": n, "root": pid[roots], "joined": np.array(joined, dtype=np.int32), "up": _lists(named, lengths), "total": np.array(size, dtype=np.int64)}
        left = np.array(left, dtype=np.int64).reshape(-1, 3)
        edges = [{"a": pid[left[:, 0]], "b": pid[left[:, 1]], "level": left[:, 2].astype(np.int32)}]
        for mine, other, side in ((in_a, in_b, 0), (in_b, in_a, 1)):
            there = table[mine & ~other]
            at = pid[roots[ends[mine & ~other, side]]]
            edges.append({"a": there[:, 1], "b": there[:, 2], "level": there[:, 0].astype(np.int32), "root": at, "side": np.full(len(at), side, dtype=np.int32)})
        schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("root", pa.int64()), ("joined", pa.int32()), ("up", UP), ("total", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("level", pa.int32()), ("side", pa.int32())])
        whole = [pa.table({f.name: part[f.name] if f.name in part else pa.nulls(len(next(iter(part.values()))), f.type) for f in schema}, schema=schema) for part in (rows, *edges)]
        return pa.concat_tables(whole).combine_chunks()

    return run


def _lines(nodes: DataFrame, forest: DataFrame) -> DataFrame:
    """``node, up``: the names of a node's component from its own on, and the levels from which it has them."""
    lines, done = forest.select("node", F.array(F.struct("level", "label")).alias("up")), None
    while True:  # lists of names double
        last = lines.withColumn("_last", F.element_at("up", -1)["label"])
        known = lines if done is None else lines.unionByName(done)
        longer = last.join(known.select(F.col("node").alias("_last"), F.col("up").alias("_more")), "_last", "left")
        longer = materialize(longer.select("node", F.when(F.col("_more").isNull(), F.col("up")).otherwise(F.concat("up", "_more")).alias("up"), F.col("_more").isNotNull().alias("_open")))
        closed, lines = longer.filter("NOT _open").drop("_open"), longer.filter("_open").drop("_open")
        done = closed if done is None else done.unionByName(closed)
        if lines.isEmpty():
            break
    own = F.array(F.struct(F.lit(-1).alias("level"), F.col("node").alias("label")))
    return nodes.join(done, "node", "left").select("node", F.when(F.col("up").isNull(), own).otherwise(F.concat(own, "up")).alias("up"))


def _segments(points: DataFrame, edges: DataFrame, number: int, n: int, levels: int, smallest: int) -> DataFrame:
    """``node, n, label, start, end, next``: a point's component is named ``label`` from one level to before another, -1 being no edges.

    Blocks of near points are contracted, then wider blocks of what is left, as long as that is at most half; the last ``REST`` edges
    are one block, and :func:`_forest` does what blocks do not. Names of components that end with less than ``smallest`` points are left out.
    """
    rounds, width, before = [], BLOCK, None
    while before is None or number and (number <= before / 2 or width >= n):
        block = lambda c: F.floor(F.col(c) / width)
        dealt = edges.withColumn("block", F.explode(F.array_distinct(F.array(block("a"), block("b")))))
        sides = points.withColumn("block", block("pid")).groupBy("block").cogroup(dealt.groupBy("block"))
        done = materialize(sides.applyInArrow(_contract(width, smallest), CONTRACTED))
        rounds.append(done.filter("node IS NOT NULL").select("node", "n", "root", "joined", "up"))
        points = done.filter("node = root").select(F.col("node").alias("pid"), F.col("total").alias("n"))
        ends = [F.max(F.when(F.col("side") == i, F.col("root"))).alias(c) for i, c in enumerate("ab")]
        across = done.filter("side IS NOT NULL").groupBy(F.col("a").alias("_a"), F.col("b").alias("_b")).agg(*ends, F.min("level").alias("level"))
        rest = done.filter("side IS NULL AND level IS NOT NULL").select("a", "b", "level").unionByName(across.select("a", "b", "level"))
        rest = rest.filter("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("level").alias("level"))
        edges, before = materialize(rest), number
        number, size = edges.count(), points.count()
        few = number <= REST and size <= 2 * BLOCK
        width = n if few else max(2 * width, BLOCK * n // max(1, size))  # as many points of this round as a block had first
    nodes = points.select(F.col("pid").alias("node"))
    if number:
        lines = _lines(nodes, _forest(edges, levels))
    else:
        lines = nodes.select("node", F.array(F.struct(F.lit(-1).alias("level"), F.col("node").alias("label"))).alias("up"))
    for done in reversed(rounds):
        rows = done.join(lines.select(F.col("node").alias("root"), F.col("up").alias("_up")), "root")
        past = F.filter("_up", lambda x: x["level"] <= F.col("joined"))
        now = F.when(F.size(past) > 0, F.array(F.struct(F.col("joined").alias("level"), F.element_at(past, -1)["label"].alias("label")))).otherwise(F.array().cast(UPS))
        lines = rows.select("node", "n", F.concat("up", now, F.filter("_up", lambda x: x["level"] > F.col("joined"))).alias("up"))
    each = lines.select("node", "n", "up", F.posexplode("up").alias("_at", "_e"))
    after = F.get("up", F.col("_at") + 1)
    each = each.select("node", "n", F.col("_e.label").alias("label"), F.col("_e.level").alias("start"), F.coalesce(after["level"], F.lit(levels)).alias("end"), after["label"].alias("next"))
    return materialize(each)


def _stays(points: DataFrame, segments: DataFrame, steps: list[int], cfg: Clustering) -> DataFrame:
    """``node, cluster, parent, born, birth, n, leaves``: which clusters a point is in, from ``birth`` to what density.

    A cluster is named by its first component (level, point that names it).
    """
    top = len(steps) - 1
    upwards = Window.partitionBy("label").orderBy("start")  # one row per step of distance
    grown = segments.groupBy("label", "start").agg(F.sum("n").alias("_n")).withColumn("_size", F.sum("_n").over(upwards))
    large = grown.filter(F.col("_size") >= cfg.min_cluster_size).groupBy("label").agg(F.min("start").alias("since"))
    ends = segments.filter("node = label AND next IS NOT NULL").select("label", F.col("end").alias("_end"), F.col("next").alias("_up"))
    large = materialize(large.join(ends, "label", "left"))
    kids = large.filter("since < _end")
    merged = kids.groupBy("_up", "_end").agg(F.count(F.lit(1)).alias("_kids")).join(large.select(F.col("label").alias("_up"), "since"), "_up")
    merged = materialize(merged.withColumn("_own", F.col("since") < F.col("_end")))
    divided = merged.filter(F.col("_kids") + F.col("_own").cast("int") > 1)
    born = kids.join(divided.select("_up", "_end"), ["_up", "_end"]).select("label", (F.col("_end") - 1).alias("level"))
    born = born.unionByName(divided.filter("_own").select(F.col("_up").alias("label"), (F.col("_end") - 1).alias("level")))
    last = large.filter("_end IS NULL")
    if last.count() > 1:
        born = born.unionByName(last.select("label", F.lit(top).alias("level")))
    marks = large.select("label", "since").join(born.groupBy("label").agg(F.collect_list("level").alias("_born")), "label", "left")
    inside = salted_join(segments, marks, ["label"], "inner", ["node"]).filter(F.col("end") > F.col("since"))
    inside = inside.withColumn("_low", F.greatest("start", "since"))
    names = F.transform(F.filter(F.coalesce("_born", F.array().cast("array<int>")), lambda b: (b >= F.col("_low")) & (b < F.col("end"))), lambda b: F.struct(b.alias("level"), F.col("label").alias("label")))
    lines = inside.select("node", "n", "_low", names.alias("_names")).groupBy("node").agg(
        F.first("n").alias("n"), F.min("_low").alias("_low"), F.sort_array(F.flatten(F.collect_list("_names")), False).alias("_names")
    )
    stays = lines.select("node", "n", "_low", "_names", F.posexplode("_names").alias("_at", "cluster"))
    stays = stays.select(
        "node", "n", "cluster", F.col("cluster.level").alias("born"), F.when(F.col("_at") > 0, F.get("_names", F.col("_at") - 1)).alias("parent"),
        F.coalesce(F.get("_names", F.col("_at") + 1)["level"] + 1, F.col("_low")).alias("_out"),
    )
    density = [2.0 ** (-s / cfg.resolution) for s in steps]
    at = lambda level: F.element_at(F.array(*[F.lit(v) for v in density]), level + 1)
    birth = F.when(F.col("born") < top, at(F.least(F.col("born"), F.lit(top - 1)) + 1)).otherwise(0.0) if top else F.lit(0.0)
    own = points.filter("n > 1").select(F.col("pid").alias("node"), F.col("core").alias("_core"))
    stays = stays.withColumn("birth", birth).join(own, "node", "left")
    alone = F.greatest(1.0 / F.greatest("_core", F.lit(TINY)), "birth")
    return stays.withColumn("leaves", F.when(F.col("_out") < 0, alone).otherwise(at(F.greatest("_out", F.lit(0))))).drop("_core", "_out")


CLUSTER = "struct<level:int,label:bigint>"


def _best(table: pa.Table) -> pa.Table:
    """The rows of :func:`_choose` of clusters that fit into one task."""
    known = {(r["cluster"]["level"], r["cluster"]["label"]): r for r in table.to_pylist()}
    below = dict.fromkeys(known)
    for name in sorted(known):  # a parent is born at a higher level
        r = known[name]
        r["wins"] = below[name] is None or r["stability"] >= below[name]
        if r["parent"] is not None:
            up = r["parent"]["level"], r["parent"]["label"]
            below[up] = (below[up] or 0.0) + (r["stability"] if r["wins"] else below[name])
    return pa.table({"cluster": table["cluster"], "wins": pa.array([known[c["level"], c["label"]]["wins"] for c in table["cluster"].to_pylist()])})


def _choose(clusters: DataFrame, selection: str) -> DataFrame:
    """``cluster, wins``: has no children, or is as stable as the best of its descendants together."""
    if selection != "leaf" and clusters.count() <= REST:
        return clusters.select("cluster", "parent", "stability", F.lit(0).alias("all")).groupBy("all").applyInArrow(_best, f"cluster {CLUSTER}, wins boolean")
    parents = clusters.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.count(F.lit(1)).alias("_kids"))
    rows = materialize(clusters.join(parents, "cluster", "left"))
    fields = ["cluster", "parent", "total", "wins"]
    leaves = rows.filter("_kids IS NULL").select("cluster", "parent", F.col("stability").alias("total"), F.lit(True).alias("wins"))
    if selection == "leaf":
        return leaves.select("cluster", "wins")
    known, number = materialize(leaves.select(fields)), rows.count()
    open_ = rows.filter("_kids IS NOT NULL")
    while known.count() < number:
        below = known.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.sum("total").alias("_below"), F.count(F.lit(1)).alias("_done"))
        ready = open_.join(below, "cluster").filter("_done = _kids").join(known.select("cluster"), "cluster", "left_anti")
        won = F.col("stability") >= F.col("_below")
        now = ready.select("cluster", "parent", F.greatest("stability", "_below").alias("total"), won.alias("wins"))
        known = materialize(known.unionByName(now.select(fields)))
    return known.select("cluster", "wins")


def _final(clusters: DataFrame, stays: DataFrame, wins: DataFrame, epsilon: float) -> DataFrame:
    """``cluster`` of those chosen: winners below no other; those born below distance ``epsilon`` become the ancestor born above it."""
    facts = clusters.select("cluster", "birth").join(wins, "cluster", "left").select("cluster", "birth", F.coalesce("wins", F.lit(False)).alias("wins"))
    lines = stays.select(F.col("node").alias("_node"), F.col("cluster").alias("_above"), F.col("born").alias("_born"))
    winners = facts.filter("wins").select("cluster", F.col("cluster.label").alias("_node"), F.col("cluster.level").alias("_level"))
    ways = winners.join(lines, "_node").filter("_born >= _level").select("cluster", "_above", "_born")
    of = facts.select(F.col("cluster").alias("_above"), F.col("birth").alias("_birth"), F.col("wins").alias("_wins"))
    fits = F.col("_birth") * epsilon <= 1.0
    target = F.coalesce(F.min_by("_above", F.when(fits, F.col("_born"))), F.max_by("_above", "_born"))
    chosen = ways.join(of, "_above").groupBy("cluster").agg(F.count_if("_wins").alias("_winners"), target.alias("target"))
    return chosen.filter("_winners = 1").select(F.col("target").alias("cluster")).distinct()


def _once(kept: dict, key: tuple, make: Callable):
    if key not in kept:
        kept[key] = make()
    return kept[key]


def _graph(points: DataFrame, n: int, dim: int, cfg: Clustering, kept: dict) -> tuple[DataFrame, DataFrame, list[int], int]:
    """Points with ``core``, edges ``a, b, level`` of the spanning trees of all leaves, the steps of the levels, and the number of edges."""
    min_samples = cfg.min_samples or cfg.min_cluster_size
    cells = _once(kept, ("cells", cfg.leaf_size, cfg.trees), lambda: _cells(points, n, dim, cfg))
    near = cells.groupBy("tree", "depth", "cell").applyInArrow(_neighbours(min_samples, cfg), NEAR)
    by_point = near.repartition("pid").sortWithinPartitions("pid")
    rows = materialize(by_point.mapInArrow(_cores(min_samples), "tree int, depth int, cell long, pid long, _v array<double>, n long, core double"))
    edges = materialize(rows.groupBy("tree", "depth", "cell").applyInArrow(_spanning_tree(cfg), "a long, b long, step int"))
    sizes = edges.groupBy("step").count().orderBy("step").collect()  # some tens: they are logarithms
    steps = [r.step for r in sizes]
    level = F.array_position(F.array(*[F.lit(s) for s in steps]).cast("array<int>"), F.col("step")) - 1
    return rows.filter("tree = 0").select("pid", "n", "core"), edges.select("a", "b", level.cast("int").alias("level")), steps, sum(r["count"] for r in sizes)


def _hierarchy(points: DataFrame, n: int, dim: int, cfg: Clustering, kept: dict) -> tuple[DataFrame, DataFrame] | None:
    """Stays of the points, see :func:`_stays`, and ``cluster, parent, birth, stability``; None without edges."""
    key = (cfg.min_samples or cfg.min_cluster_size, cfg.leaf_size, cfg.trees, cfg.resolution)
    cored, edges, steps, number = _once(kept, ("graph", *key), lambda: _graph(points, n, dim, cfg, kept))
    if not steps:
        return None
    segments = _segments(cored.select("pid", "n"), edges, number, n, len(steps), cfg.min_cluster_size)
    stays = materialize(_stays(cored, segments, steps, cfg))
    gain = F.sum(F.col("n") * (F.col("leaves") - F.col("birth")))
    return stays, materialize(stays.groupBy("cluster").agg(F.first("parent").alias("parent"), F.first("birth").alias("birth"), gain.alias("stability")))


def _labels(points: DataFrame, n: int, dim: int, cfg: Clustering, kept: dict) -> DataFrame | None:
    """``_v, n, cluster, strength`` of the points that are no noise; None if there are no clusters."""
    key = (cfg.min_samples or cfg.min_cluster_size, cfg.min_cluster_size, cfg.leaf_size, cfg.trees, cfg.resolution)
    known = _once(kept, ("hierarchy", *key), lambda: _hierarchy(points, n, dim, cfg, kept))
    if known is None:
        return None
    stays, clusters = known
    chosen = materialize(_final(clusters, stays, _choose(clusters, cfg.selection), cfg.epsilon))
    if chosen.isEmpty():
        return None
    inside = salted_join(stays, chosen.withColumn("_in", F.lit(True)), ["cluster"], "left", ["node"])
    owner, last = F.max_by("cluster", F.when(F.col("_in"), F.col("born"))), F.min_by("leaves", "born")
    owned = inside.groupBy(F.col("node").alias("pid")).agg(owner.alias("owner"), last.alias("leaves")).filter("owner IS NOT NULL")
    owned = materialize(points.join(owned, "pid"))
    tops = owned.groupBy("owner").agg(F.min("_first").alias("first"), F.max("leaves").alias("top"))
    named = with_row_number(tops.select(F.struct("first", "owner", "top").alias("_order")), "_order", "cluster")
    named = materialize(named.select("_order.owner", "_order.top", F.col("cluster").cast("int").alias("cluster")))
    found = salted_join(owned, named, ["owner"], "inner", ["pid"])
    return found.select("_v", "n", "cluster", (F.col("leaves") / F.col("top")).alias("strength"))


def _points(points: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, DataFrame | None, DataFrame | None, int, int]:
    """Rows ``id, _v``, the different vectors ``pid, _v, n`` with their smallest id ``_first``, those of many rows, how many they are, and their length."""
    rows = materialize(points.select(id_col, F.col(vector).cast("array<double>").alias("_v")))  # read several times
    same = rows.filter("_v IS NOT NULL").groupBy("_v").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("_first"))
    same = materialize(same)
    first = same.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_v")).alias("dim")).first()
    if not first.n:
        return rows, None, None, 0, 0
    order = F.struct(_zone(same, first.dim).alias("_zone"), "_first", "_v", "n").alias("_order")
    numbered = with_row_number(same.filter("_first IS NOT NULL").select(order), "_order", "pid")
    hot = same.filter(F.col("n") >= HOT).select("_v", F.lit(SALTS).alias("_salts"))  # few; only their rows are dealt to several tasks
    return rows, materialize(numbered.select("pid", "_order._v", "_order.n", "_order._first")), materialize(hot), first.n, first.dim


def density_clusters(points: DataFrame, id_col: str = "doc_id", vector: str = "reduced", cfg: Clustering = Clustering(), kept: dict | None = None) -> DataFrame:
    """``id, cluster, strength``; noise, and a row without a vector, is cluster -1 with strength 0.

    Clusters are numbered by their smallest id. ``kept`` takes the staged tables that other settings can share;
    give the same one only with the same points.
    """
    kept = {} if kept is None else kept
    rows, named, hot, n, dim = _once(kept, ("points",), lambda: _points(points, id_col, vector))
    found = None if named is None else _labels(named, n, dim, cfg, kept)
    if found is None:
        return rows.select(id_col, F.lit(-1).alias("cluster"), F.lit(0.0).alias("strength"))
    salt = F.pmod(F.xxhash64(id_col), F.coalesce("_salts", F.lit(1))).cast("int")
    dealt = rows.join(hot, "_v", "left").withColumn("_salt", salt)
    placed = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(F.col("n") >= HOT, SALTS - 1).otherwise(0))))
    joined = dealt.join(placed.drop("n"), ["_v", "_salt"], "left")
    return joined.select(id_col, F.coalesce("cluster", F.lit(-1)).alias("cluster"), F.coalesce("strength", F.lit(0.0)).alias("strength"))


def number_topics(assigned: DataFrame, id_col: str = "doc_id", cluster: str = "cluster", min_topic_size: int = 1) -> DataFrame:
    """Add ``topic``: 0, 1, ... by falling size, then smallest id; small clusters and noise are -1.

    Also the route for given clusters: any label column works, null is noise.
    """
    from .joins import salted_join

    c = F.col(cluster)
    noise = c.isNull() if assigned.schema[cluster].dataType.simpleString() == "string" else c.isNull() | (c == -1)
    sizes = assigned.filter(~noise).groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"), F.min(id_col).alias("_id"))
    by_size = Window.partitionBy(F.lit(1)).orderBy(F.desc("_n"), "_id")  # one row per cluster
    numbers = sizes.filter(F.col("_n") >= min_topic_size).select(cluster, (F.row_number().over(by_size) - 1).alias("topic"))
    joined = salted_join(assigned, materialize(numbers), [cluster], "left", [id_col])  # few written rows do not shuffle the others
    return joined.withColumn("topic", F.coalesce(F.col("topic"), F.lit(-1)))
