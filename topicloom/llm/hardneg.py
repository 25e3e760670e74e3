"""Hard negatives by an inverted multi-index with certified windows.

Vectors are split into two halves. Each half has a codebook of ``CODEWORDS``
centres, fitted on at most ``SAMPLE`` vectors; all vectors are placed in the cell
of their two nearest centres, and every centre knows its radius, the largest
distance of a vector placed with it. For an anchor a half-score of a centre is
the product with the centre plus the anchor's length times the radius: no vector
there scores more. The multi-sequence heap visits cells by falling sums of the
two half-scores. A search is certified, and stops, when what it has found cannot
be beaten by the bound of the next cell; so results are exact whatever the
codebooks are, and the sample decides only how many cells are visited.

An anchor first finds its positives, its best rows of the same label. Each
positive gives a window of scores, and the search for its negatives visits cells
whose bounds reach into the window: not those that lie below the best found, nor
those whose least possible score lies above the window.

Cells are packed in blocks of at most ``BLOCK`` rows. A search takes two steps:
the first cells of every anchor's order, holding ``FIRST`` rows, then every cell
whose bound is not certified away by what these gave. In a step each block goes
to one task and the anchors that visit it stream past in batches, so anchors are
sent only to cells that they visit, a crowded cell is many blocks, and a task
holds one block. Blocks send on the best few rows of each anchor and window.

Components are whole numbers and scores exact integers (a hundred times a score
must fit in 64 bits). Nulls: rows whose id,
label or vector is null, or with a null or non-finite component, take no part.
Vectors are compared with those of the same length only. Repeated rows count
once; rows with an anchor's id are its own. Ties of scores go to the smaller id.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..operators.sampling import top_n
from .common import stage

CODEWORDS, SAMPLE, ROUNDS = 8, 4096, 8
BLOCK, FIRST = 8192, 8192
#: anchors multiplied with a block at once
ANCHORS = 256
EXACT = float(1 << 53)
LARGEST = (1 << 63) - 1
CELL = ["dim", "c1", "c2"]
PLACED = "id bigint, label bigint, v array<bigint>, dim int, c1 int, c2 int, r1 double, r2 double"
BLOCKS = "dim int, c1 int, c2 int, sub bigint, ids binary, labels binary, matrix binary"
FOUND = "anchor bigint, rank int, vec_id bigint, score bigint"


def usable(vectors: DataFrame) -> DataFrame:
    """id, label, v (whole numbers) and dim of the rows that take part."""
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v")
    finite = F.forall("v", lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    rows = rows.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").filter(finite)
    return rows.select("id", "label", F.col("v").cast("array<bigint>").alias("v")).withColumn("dim", F.size("v"))


# index


def half_codebook(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` centres by Lloyd's rounds."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        own = nearest_centre(x, centres)[0]
        for c in range(len(centres)):
            if (own == c).any():
                centres[c] = x[own == c].mean(axis=0)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the nearest centre of every row."""
    own = np.argmin((centres * centres).sum(axis=1) - 2 * (x @ centres.T), axis=1)
    return own, np.sqrt(((x - centres[own]) ** 2).sum(axis=1))


def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    middle = x.shape[1] // 2
    return x[:, :middle], x[:, middle:]


def codebooks(rows: DataFrame, codewords: int = CODEWORDS, sample: int = SAMPLE, seed: int = 42) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Two codebooks for every length of vectors in a sample of ``sample`` rows; vectors of other lengths have one centre, zero."""
    drawn = rows.select("dim", "v", F.xxhash64("id", F.lit(seed)).alias("_draw")).orderBy("_draw").limit(sample).toArrow()
    dims = drawn.column("dim").to_numpy()
    out = {}
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        x = drawn.column("v").take(at).combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(at), dim)
        out[dim] = tuple(half_codebook(h, codewords, seed + i) for i, h in enumerate(halves(x)))
    return out


def matrices(batch, name: str = "v"):
    """(dim, places, matrix) of the vectors of an Arrow batch."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, batch.column(name).take(at).flatten().to_numpy().astype(np.int64).reshape(len(at), dim)


def in_cells(rows: DataFrame, books) -> DataFrame:
    """Rows with their two centres and the distances to them."""

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            centre, away = np.zeros((2, batch.num_rows), np.int32), np.zeros((2, batch.num_rows))
            for dim, at, x in matrices(batch):
                for i, h in enumerate(halves(x.astype(np.float64))):
                    if dim in books.value:
                        centre[i, at], away[i, at] = nearest_centre(h, books.value[dim][i])
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["id", "label", "v", "dim"]).columns, *(pa.array(c) for c in (*centre, *away))], ["id", "label", "v", "dim", "c1", "c2", "r1", "r2"]
            )

    return rows.select("id", "label", "v", "dim").mapInArrow(place, PLACED)


def packed(cells: DataFrame, ways: DataFrame) -> DataFrame:
    """One row per block: the distinct rows of a part of a cell, by id."""

    def pack(table):
        import pyarrow as pa

        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        dim = table.column("dim")[0].as_py()
        x = table.column("v").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(len(ids), dim)
        x = np.concatenate([ids[:, None], labels[:, None], x], axis=1)
        x = x[np.lexsort(x.T[::-1])]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
        x = x[new]
        m = x[:, 2:]
        small = not m.size or np.abs(m).max() < 1 << 31
        cell = [pa.array([table.column(c)[0].as_py()], t) for c, t in (("dim", pa.int32()), ("c1", pa.int32()), ("c2", pa.int32()), ("sub", pa.int64()))]
        raw = [x[:, 0].tobytes(), x[:, 1].tobytes(), m.astype(np.int32 if small else np.int64).tobytes()]
        return pa.table([*cell, *(pa.array([r], pa.binary()) for r in raw)], names=[*CELL, "sub", "ids", "labels", "matrix"])

    keyed = cells.join(ways, CELL).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("ways")))
    return keyed.select("id", "label", "v", *CELL, "sub").groupBy(*CELL, "sub").applyInArrow(pack, BLOCKS)


class Index:
    """Blocks by cell, codebooks with radii, and rows by cell. All but the blocks is bounded by the codebooks."""

    def __init__(self, rows: DataFrame, codewords: int, sample: int, block: int):
        context = rows.sparkSession.sparkContext
        self.books = codebooks(rows, codewords, sample)
        cells = stage(in_cells(rows, context.broadcast(self.books)))
        self.ways = stage(cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.max("r1").alias("r1"), F.max("r2").alias("r2")).withColumn("ways", F.ceil(F.col("n") / block)))
        known = self.ways.filter(F.col("dim").isin(list(self.books))).collect()  # cells of the codebooks
        self.radii = {d: tuple(np.zeros(len(b)) for b in two) for d, two in self.books.items()}
        self.counts = {d: np.zeros([len(b) for b in two], np.int64) for d, two in self.books.items()}
        for r in known:
            self.counts[r.dim][r.c1, r.c2] = r.n
            for radius, c, far in zip(self.radii[r.dim], (r.c1, r.c2), (r.r1, r.r2)):
                radius[c] = max(radius[c], far)
        self.blocks = stage(packed(cells, self.ways.select(*CELL, "ways")))
        self.n_blocks = self.ways.agg(F.sum("ways")).first()[0] or 0

    def bounds(self):
        return self.books, self.radii, self.counts


# search


def multi_sequence(u1: np.ndarray, u2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs by falling sum, by a heap over the two sorted sequences."""
    o1, o2 = np.argsort(-u1, kind="stable"), np.argsort(-u2, kind="stable")
    heap, seen = [(-(u1[o1[0]] + u2[o2[0]]), 0, 0)], {(0, 0)}
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(o1[i]), int(o2[j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(o1) and b < len(o2) and (a, b) not in seen:
                seen.add((a, b))
                heapq.heappush(heap, (-(u1[o1[a]] + u2[o2[b]]), a, b))


def half_scores(a: np.ndarray, books, radii) -> list[tuple[np.ndarray, np.ndarray]]:
    """Least and greatest product of each half of the anchor with the vectors of every centre, with room for rounding."""
    out = []
    for h, centres, radius in zip(halves(a[None, :].astype(np.float64)), books, radii):
        length = np.sqrt((h * h).sum())
        middle, room = centres @ h[0], length * radius
        room = room + 1e-9 * (1 + length * (np.sqrt((centres * centres).sum(axis=1)) + radius))
        out.append((middle - room, middle + room))
    return out


def visits(a: np.ndarray, windows: list[tuple[int, int]], needs: list[int] | None, bounds, first: int) -> list[tuple[int, int]]:
    """Cells that an anchor visits: at first (``needs`` None) or, of the rest, those that may hold what beats ``needs`` in a window."""
    books, radii, counts = bounds
    (low1, high1), (low2, high2) = half_scores(a, books, radii)
    out, held = [], 0
    for high, i, j in multi_sequence(high1, high2):
        if high < min(w[0] for w in windows):
            break
        low = low1[i] + low2[j]
        if not counts[i, j] or low > max(w[1] for w in windows):
            continue
        begins = held < first
        held += counts[i, j]
        if needs is None:
            if not begins:
                break
            out.append((i, j))
        elif not begins:
            if high < min(needs):
                break  # certified: every window holds better than any cell to come
            if any(high >= need and low <= w[1] for need, w in zip(needs, windows)):
                out.append((i, j))
    return out


def planned(anchors: DataFrame, bounds, first: int, later: bool) -> DataFrame:
    """Anchors by the cells that they visit in this step."""
    schema = StructType([*anchors.schema.fields, StructField("c1", IntegerType()), StructField("c2", IntegerType())])

    def plan(batches):
        import pyarrow as pa

        books, radii, counts = bounds.value
        for batch in batches:
            rows, c1, c2 = [], [], []
            windows = batch.column("windows").to_pylist()
            vectors = {}
            for _, at, x in matrices(batch):
                vectors.update(zip(at.tolist(), x))
            for r, (dim, ws) in enumerate(zip(batch.column("dim").to_pylist(), windows)):
                if not ws:
                    continue
                if dim in books:
                    needs = [w["need"] for w in ws] if later else None
                    cells = visits(vectors[r], [(w["low"], w["high"]) for w in ws], needs, (books[dim], radii[dim], counts[dim]), first)
                else:
                    cells = [] if later else [(0, 0)]
                rows += [r] * len(cells)
                c1 += [c[0] for c in cells]
                c2 += [c[1] for c in cells]
            taken = pa.Table.from_batches([batch]).take(pa.array(rows, pa.int64())).combine_chunks()
            for out in taken.append_column("c1", pa.array(c1, pa.int32())).append_column("c2", pa.array(c2, pa.int32())).to_batches(max_chunksize=4096):
                yield out

    return anchors.mapInArrow(plan, schema)


def best(scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """For every row of ``scores`` the places of its k best allowed columns, ties to the smaller id."""
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    n = scores.shape[1]
    least = np.partition(masked, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), np.iinfo(np.int64).min)
    for r in np.flatnonzero(allowed.any(axis=1)).tolist():
        at = np.flatnonzero(allowed[r] & (scores[r] >= least[r]))
        at = at[np.lexsort((ids[at], -scores[r][at]))]
        yield r, at[np.sort(np.unique(ids[at], return_index=True)[1])][:k] if len(at) > len(np.unique(ids[at])) else at[:k]


def products(a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two matrices."""
    if not a.shape[1]:
        return np.zeros((len(a), len(m)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(m).max()) * a.shape[1] < EXACT:
        return (a.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ m.astype(object).T).astype(np.int64)


def searched(index: Index, visiting: DataFrame, k: int, same_label: bool) -> DataFrame:
    """(anchor, rank, vec_id, score): the k best rows of the visited cells for every anchor and window."""
    none = lambda t: F.lit(None).cast(t)
    blocks = index.blocks.select(*CELL, "sub", F.lit(False).alias("asks"), "ids", "labels", "matrix", *(none(t).alias(c) for c, t in (("anchor", "bigint"), ("id", "bigint"), ("label", "bigint"), ("v", "array<bigint>"))), none(visiting.schema["windows"].dataType).alias("windows"))
    asking = visiting.join(index.ways.select(*CELL, "ways"), CELL).withColumn("sub", F.explode(F.expr("sequence(0L, ways - 1)")))
    asking = asking.select(*CELL, "sub", F.lit(True).alias("asks"), *(none("binary").alias(c) for c in ("ids", "labels", "matrix")), "anchor", "id", "label", "v", "windows")
    parts = max(1, min(index.n_blocks, max(index.n_blocks // 4, 2 * index.blocks.sparkSession.sparkContext.defaultParallelism)))
    key = [*CELL, "sub"]
    met = blocks.unionByName(asking).repartition(parts, *key).sortWithinPartitions(*key, "asks")

    def search(batches):
        import pyarrow as pa

        ids = labels = matrix = None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((~asks[1:]) | (~asks[:-1])) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(cuts, cuts[1:]):
                if not asks[a]:  # a block begins; its anchors follow, in this batch or in later ones
                    ids, labels = (np.frombuffer(batch.column(c)[a].as_buffer(), np.int64) for c in ("ids", "labels"))
                    raw = batch.column("matrix")[a].as_buffer()
                    matrix = np.frombuffer(raw, np.int32 if raw.size < 8 * len(ids) * batch.column("dim")[a].as_py() else np.int64).reshape(len(ids), -1)
                    continue
                for start in range(a, b, ANCHORS):
                    some = batch.slice(start, min(ANCHORS, b - start))
                    own = some.column("id").to_numpy()
                    x = some.column("v").flatten().to_numpy().reshape(len(own), -1)
                    scores = products(x, matrix)
                    alike = labels[None, :] == some.column("label").to_numpy()[:, None]
                    other = (alike if same_label else ~alike) & (ids[None, :] != own[:, None])
                    windows, out = some.column("windows").to_pylist(), []
                    for w in range(max(map(len, windows))):
                        low, high = (np.array([ws[w][c] if w < len(ws) else empty for ws in windows], np.int64) for c, empty in (("low", LARGEST), ("high", -LARGEST)))
                        for r, at in best(scores, other & (scores >= low[:, None]) & (scores <= high[:, None]), ids, k):
                            anchor, rank = some.column("anchor")[r].as_py(), windows[r][w]["rank"]
                            out += [(anchor, rank, i, s) for i, s in zip(ids[at].tolist(), scores[r][at].tolist())]
                    columns = list(zip(*out)) or [(), (), (), ()]
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["anchor", "rank", "vec_id", "score"])

    return ranked(met.mapInArrow(search, FOUND), k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    return top_n(found, ["anchor", "rank"], [F.col("score").desc(), F.col("vec_id")], k)


def certified(index: Index, anchors: DataFrame, k: int, same_label: bool, bounds, first: int) -> DataFrame:
    """The k best rows in every window of every anchor, over all cells that may hold them."""
    begun = stage(searched(index, planned(anchors, bounds, first, False), k, same_label))
    kth = begun.groupBy("anchor", "rank").agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_least"))
    window = F.explode("windows").alias("w")
    needs = anchors.select("anchor", window).select("anchor", "w.*").drop("need").join(kth, ["anchor", "rank"], "left")
    need = F.when(F.col("_n") >= k, F.greatest("_least", "low")).otherwise(F.col("low")).alias("need")
    needs = needs.groupBy("anchor").agg(F.collect_list(F.struct("rank", "low", "high", need)).alias("windows"))
    later = stage(anchors.drop("windows").join(needs, "anchor").select(anchors.columns))
    rest = searched(index, planned(later, bounds, first, True), k, same_label)
    return stage(ranked(begun.unionByName(rest), k))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, least_percent: int = 50, most_percent: int = 95,
    codewords: int = CODEWORDS, sample: int = SAMPLE, block: int = BLOCK, first: int = FIRST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for ``vectors`` (id, label, v).

    For every anchor (``is_anchor``: of the column ``id``) and each of its best
    ``positives`` rows of the same label: the best ``negatives`` rows of other
    labels whose score is ``least_percent`` to ``most_percent`` of the positive's.
    """
    rows = stage(usable(vectors))
    index = Index(rows, codewords, sample, block)
    bounds = rows.sparkSession.sparkContext.broadcast(index.bounds())  # two codebooks by length of vectors
    anchors = rows.filter(is_anchor).select(F.xxhash64("id", "label", "v").alias("anchor"), "id", "label", "v", "dim").dropDuplicates(["anchor"])
    everything = F.array(F.struct(F.lit(0).alias("rank"), F.lit(-LARGEST).alias("low"), F.lit(LARGEST).alias("high"), F.lit(-LARGEST).alias("need")))
    asking = stage(anchors.withColumn("windows", everything))
    found = certified(index, asking, positives, True, bounds, first)
    numbered = top_n(found.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "anchor", [F.col("positive_score").desc(), F.col("positive_id")], positives, "rank")
    least, most = F.lit(least_percent) * F.col("positive_score"), F.lit(most_percent) * F.col("positive_score")
    whole = lambda x, plus, minus: F.when(x >= 0, F.call_function("div", x + plus, F.lit(100))).otherwise(F.call_function("div", x - minus, F.lit(100)))
    low, high = whole(least, 99, 0), whole(most, 0, 99)  # rounded up, rounded down
    pairs = stage(numbered.withColumns({"low": low, "high": high}))
    open_ = pairs.filter("low <= high").groupBy("anchor").agg(F.collect_list(F.struct("rank", "low", "high", F.col("low").alias("need"))).alias("windows"))
    hard = certified(index, stage(asking.drop("windows").join(open_, "anchor").select(asking.columns)), negatives, False, bounds, first)
    named = top_n(hard.withColumnRenamed("rank", "_pair"), ["anchor", "_pair"], [F.col("score").desc(), F.col("vec_id")], negatives, "rank")
    given = pairs.select("anchor", F.col("rank").alias("_pair"), "positive_id", "positive_score").join(asking.select("anchor", F.col("id").alias("anchor_id")), "anchor")
    return named.join(given, ["anchor", "_pair"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
