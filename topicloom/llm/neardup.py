"""Near duplicates by consistent weighted sampling of TF-IDF shingles.

A document is its five-word shingles (all its words if fewer), weighted by
count times the mean inverse document frequency of the words. Document
frequencies are counted over all documents, in ``2**BUCKET_BITS`` buckets of
hashed words, so the table that travels to the tasks has a fixed size. Each of
``SAMPLES`` draws of improved consistent weighted sampling picks a shingle with
a level of its weight; two documents agree in a draw with the chance of their
weighted Jaccard similarity. Draws are banded; documents that agree in a whole
band are candidates; those whose draws agree often enough are verified by the
weighted Jaccard similarity of their whole texts, and links of 0.8 or more are
closed into classes.

Documents of equal words are one content from the start. In a band bucket every
content is compared with the bucket's smallest one by their draws; where a
bucket then still holds several groups, their draws are compared in blocks. The
pairs that agree often enough span candidate groups. Within a candidate group
all similarities are computed exactly, in blocks, in matrix products; a task
sends on only as many links as join the same contents. So no candidate is left
out, and a large group of copies is spread over many tasks.

Nulls: a null text is a class of its own; texts without words are copies if they
are equal. The class id is the smallest doc_id of the class (null if no member
has one). Repeated rows are members like others. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, in_runs, marked, mixed, stage, utf8
from .components import components

SHINGLE = 5
#: least similarity of a link, as a fraction: whole weights are compared exactly
LEAST = (4, 5)
#: weights are whole multiples of 1 / SCALE
SCALE = 10_000
BANDS, ROWS = 14, 4
SAMPLES = BANDS * ROWS
#: candidates agree in at least this share of their draws (3.6 standard deviations below 0.8)
SCREEN = 0.6
BUCKET_BITS = 18
POOL_BITS = 16
#: contents of one block; two blocks meet in a task
BLOCK = 256


def word_buckets(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents by bucket of hashed words, over all documents, and their number."""

    def count(batches):
        import pyarrow as pa

        totals, n = np.zeros(1 << BUCKET_BITS, np.int64), 0
        for run in in_runs(batches):
            words = Words(utf8(run.column("text")))
            once = np.unique((words.doc.astype(np.int64) << BUCKET_BITS) | word_buckets(words))
            totals += np.bincount(once & ((1 << BUCKET_BITS) - 1), minlength=1 << BUCKET_BITS)
            n += run.num_rows
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at], pa.int32()), pa.array([n, *totals[at]], pa.int64())], ["bucket", "n"])

    found = docs.select("text").mapInArrow(count, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # 2**BUCKET_BITS rows
    at, n = found.column("bucket").to_numpy(), found.column("n").to_numpy()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    """From 1 (in every document) to 2 (in none), on the scale of the logarithm."""
    return 1 + np.log((n + 1) / (np.minimum(df, n) + 1)) / np.log(n + 2)


def shingles(words: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of the distinct shingles, ordered by document and hash. Weights are whole, in units of 1 / ``SCALE``."""
    values = idf[word_buckets(words)]
    sums = np.concatenate([[0.0], np.cumsum(values)])
    docs, hashes, weights = [], [], []
    for n in range(1, SHINGLE + 1):
        if n == SHINGLE:
            at = words.gram_starts(n)
        else:
            at = words.first[:-1][words.counts == n]
        docs.append(words.doc[at])
        hashes.append(words.grams(n)[at])
        weights.append((sums[at + n] - sums[at]) / n)
    doc, h, w = np.concatenate(docs), np.concatenate(hashes), np.concatenate(weights)
    order = np.lexsort((h, doc)) if len(words.counts) >= 1 << 16 else np.argsort((doc.astype(np.uint64) << np.uint64(48)) | (h >> np.uint64(16)))
    doc, h, w = doc[order], h[order], w[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    return doc[at], h[at], times * np.round(w[at] * SCALE)


class Draws:
    """The random numbers of consistent weighted sampling, by a table: a hash of draw and shingle picks the entry."""

    def __init__(self, seed: int = 42):
        rng = np.random.default_rng(seed)
        n = 1 << POOL_BITS
        self.r = rng.gamma(2.0, 1.0, n).astype(np.float32)
        self.r = np.maximum(self.r, np.float32(1e-3))
        self.shift = rng.random(n).astype(np.float32)
        self.c = (np.log(rng.gamma(2.0, 1.0, n)) - self.r).astype(np.float32)
        self.odd = rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, doc: np.ndarray, h: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        """(n, SAMPLES) 32-bit marks of the drawn shingle and weight level; rows of documents without shingles are 0."""
        out = np.zeros((n, SAMPLES), np.uint32)
        if not len(h):
            return out
        log_w = np.round(np.log(w / SCALE), 4).astype(np.float32)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        own, lengths = doc[starts], np.diff(np.append(starts, len(doc)))
        with np.errstate(over="ignore"):
            for k in range(SAMPLES):
                at = ((h * self.odd[k]) >> np.uint64(64 - POOL_BITS)).astype(np.int64)
                r, b = self.r[at], self.shift[at]
                level = np.floor(log_w / r + b)
                value = self.c[at] - r * (level - b)
                least = np.minimum.reduceat(value, starts)
                hit = np.flatnonzero(value == np.repeat(least, lengths))
                first = hit[np.flatnonzero(np.diff(doc[hit], prepend=-1))]
                out[own, k] = (mixed(h[first] + level[first].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) >> np.uint64(32)).astype(np.uint32)
        return out


def band_keys(marks: np.ndarray) -> np.ndarray:
    """(n, BANDS) 64-bit keys."""
    with np.errstate(over="ignore"):
        keys = np.zeros((len(marks), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + marks[:, i::ROWS].astype(np.uint64))
    return keys


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, doc_key, content (null for null texts), marks and bands (null without words)."""

    def sign(batches):
        import pyarrow as pa

        draws = Draws()
        for run in in_runs(batches):
            texts = utf8(run.column("text"))
            words = Words(texts)
            marks = draws.sample(*shingles(words, idf.value), len(texts))
            bands = band_keys(marks).view(np.int64)
            marks = marks.astype(np.uint8)  # a byte of each tells two draws apart well enough to screen pairs
            null = run.column("text").is_null().to_pylist()
            content = []
            raw = words.data.tobytes()
            for i, t in enumerate(texts):
                a, b = words.first[i], words.first[i + 1]
                if null[i]:
                    content.append(None)
                elif a == b:
                    content.append(hashlib.md5(b"\0" + t).digest())
                else:
                    content.append(hashlib.md5(b" ".join(word_bytes(raw, words, a, b))).digest())
            empty = (words.counts == 0).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    run.column("doc_id"), run.column("doc_key"), pa.array(content, pa.binary()),
                    pa.array([None if e else m.tobytes() for e, m in zip(empty, marks)], pa.binary()),
                    pa.array([None if e else b for e, b in zip(empty, bands)], pa.list_(pa.int64())),
                ],
                ["doc_id", "doc_key", "content", "marks", "bands"],
            )

    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"doc_id {kind}, doc_key bigint, content binary, marks binary, bands array<bigint>")


def word_bytes(raw: bytes, words: Words, a: int, b: int) -> list[bytes]:
    return [raw[i:j] for i, j in zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())]


def mark_rows(column) -> np.ndarray:
    """One row of short marks per content."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, SAMPLES)


def contracted(pairs: DataFrame) -> DataFrame:
    """Fewer pairs (a, b) that join the same contents: each b with its smallest a, and its other a with that one.

    A content has at most one partner for each band.
    """
    ordered = pairs.groupBy("b").agg(F.min("a").alias("_least"), F.collect_set("a").alias("_all"))
    return ordered.select(F.col("_least").alias("a"), F.explode(F.array_append("_all", F.col("b"))).alias("b")).filter("a <> b").distinct()


def screened(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """Pairs (a, b) whose draws agree often enough."""
    marks = contents.select("content", "marks")
    both = (
        pairs.join(marks.withColumnsRenamed({"content": "a", "marks": "_ma"}), "a")
        .join(marks.withColumnsRenamed({"content": "b", "marks": "_mb"}), "b")
    )

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                share = (mark_rows(batch.column("_ma")) == mark_rows(batch.column("_mb"))).mean(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(share >= SCREEN))

    return both.select("a", "b", "_ma", "_mb").mapInArrow(keep, "a binary, b binary")


def overlaps(texts: list[bytes], idf: np.ndarray, columns: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Common weight and weight of the union of all pairs of a block of texts, as whole numbers.

    Shingles of one weight wherever they occur are counted by matrix products,
    the others by minima; ``columns`` shingles at a time. Weights are whole and
    sums stay below 2**53, so nothing is rounded.
    """
    n = len(texts)
    doc, h, w = shingles(Words(texts), idf)
    total = np.bincount(doc, weights=w, minlength=n)
    _, at, times = np.unique(h, return_inverse=True, return_counts=True)
    shared = times[at] > 1
    doc, at, w = doc[shared], at[shared], w[shared]
    _, at = np.unique(at, return_inverse=True)
    width = int(at.max()) + 1 if len(at) else 0
    low, high = np.full(width, np.inf), np.zeros(width)
    np.minimum.at(low, at, w)
    np.maximum.at(high, at, w)
    common = np.zeros((n, n))
    for alike in (True, False):
        chosen = np.flatnonzero((low == high) == alike)
        place = np.full(width, -1)
        place[chosen] = np.arange(len(chosen))
        for start in range(0, len(chosen), columns):
            here = (place[at] >= start) & (place[at] < start + columns)
            m = np.zeros((n, min(columns, len(chosen) - start)))
            m[doc[here], place[at[here]] - start] = 1 if alike else w[here]
            if alike:
                common += (m * low[chosen[start : start + columns]]) @ m.T
            else:
                for i in range(n):
                    common[i] += np.minimum(m, m[i]).sum(axis=1)
    return common, total[:, None] + total[None, :] - common


def similarities(texts: list[bytes], idf: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs of a block of texts."""
    common, both = overlaps(texts, idf, columns)
    return np.divide(common, both, out=np.zeros(common.shape), where=both > 0)


def links(texts: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Pairs (i, j), i < j, of a similarity of ``LEAST`` or more."""
    common, both = overlaps(texts, idf)
    return np.argwhere(np.triu((common > 0) & (LEAST[1] * common >= LEAST[0] * both), 1))


def forest(linked: np.ndarray, parent: dict[int, int]) -> list[tuple[int, int]]:
    """Of the pairs (i, j) those that join two trees of ``parent``, which is updated."""

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in linked.tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[b] = a
            out.append((i, j))
    return out


def in_blocks(rows: DataFrame, group: str, payload: list[str]) -> DataFrame:
    """Rows of groups, sent to the cells in which a group's blocks meet in pairs.

    Groups of up to ``BLOCK`` rows are one block; several share a cell. A larger
    group has rows / BLOCK blocks and a cell for each pair of them.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    sizes = stage(sizes.select(group, F.ceil(F.col("_n") / BLOCK).alias("_blocks"), "_n"))
    cells = max(1, (sizes.agg(F.sum("_n")).first()[0] or 0) // BLOCK)
    own = F.pmod(F.xxhash64("content"), F.col("_blocks"))
    placed = rows.join(sizes, group).withColumn("_own", own).withColumn("_other", F.explode(F.expr("sequence(0L, _blocks - 1)")))
    placed = placed.withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
    cell = F.when(F.col("_blocks") > 1, F.xxhash64(group, "_lo", "_hi")).otherwise(F.pmod(F.xxhash64(group), F.lit(cells)))
    return placed.select(cell.alias("_cell"), group, "_lo", "_hi", "_own", "content", *payload)


def within_cells(placed: DataFrame, group: str, pairs_of) -> DataFrame:
    """(a, b): the links that ``pairs_of`` (arrays of one group and pair of blocks) finds, as few as join the same contents."""

    def compare(table):
        import pyarrow as pa

        rows: dict[tuple, list[int]] = {}
        keys = zip(table.column(group).to_pylist(), table.column("_lo").to_pylist(), table.column("_hi").to_pylist())
        for i, key in enumerate(keys):
            rows.setdefault(key, []).append(i)
        content = table.column("content").to_pylist()
        out = []
        for at in rows.values():
            if len(at) > 1:
                found = pairs_of(table.take(pa.array(at)))
                out += [(content[at[i]], content[at[j]]) for i, j in found]
        a, b = zip(*out) if out else ((), ())
        return pa.table([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return placed.groupBy("_cell").applyInArrow(compare, "a binary, b binary")


def across(members: DataFrame, contents: DataFrame, labels: DataFrame) -> DataFrame | None:
    """Pairs of one bucket but different candidate groups whose draws agree often enough; None if there are none."""
    labelled = stage(members.join(labels.withColumnRenamed("node", "content"), "content", "left").withColumn("label", F.coalesce("label", "content")))
    several = stage(
        labelled.groupBy("band").agg(F.min("label").alias("_x"), F.max("label").alias("_y"), F.count(F.lit(1)).alias("_m")).filter("_x <> _y AND _m > 2").select("band")
    )
    if several.isEmpty():
        return None
    rows = labelled.select("band", "content", "label").join(several, "band").join(contents.select("content", "marks"), "content")

    def pairs_of(table):
        marks = mark_rows(table.column("marks"))
        _, label = np.unique(np.array(table.column("label").to_pylist(), dtype=object), return_inverse=True)
        parent: dict[int, int] = {}
        out = []
        first = {}
        for i, x in enumerate(label.tolist()):
            parent[i] = first.setdefault(x, i)
        for i in range(len(marks)):
            ok = np.flatnonzero((label[i + 1 :] != label[i]) & ((marks[i + 1 :] == marks[i]).mean(axis=1) >= SCREEN)) + i + 1
            out += forest(np.stack([np.full(len(ok), i), ok], axis=1), parent)
        return out

    found = stage(within_cells(in_blocks(stage(rows), "band", ["label", "marks"]), "band", pairs_of).distinct())
    return None if found.isEmpty() else found


def linked(candidates: DataFrame, contents: DataFrame, docs: DataFrame, idf) -> DataFrame:
    """Links of a similarity of ``LEAST`` or more within the candidate groups (node, label), from whole texts."""
    keys = stage(candidates.withColumnsRenamed({"node": "content", "label": "group"}).join(contents.select("content", "doc_key"), "content"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    texts = marked(texts, F.col("doc_key"), keys.select("doc_key")).filter("_maybe")  # texts of no candidate group stay where they are
    texts = stage(texts.groupBy("doc_key").agg(F.first("text").alias("text")).join(keys, "doc_key").select("content", "group", "text"))

    def pairs_of(table):
        return forest(links(utf8(table.column("text")), idf.value), {})

    return stage(within_cells(in_blocks(texts, "group", ["text"]), "group", pairs_of).distinct())


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed rows of ``docs`` (doc_id, text), and (content, label, class_id, class_size) of the contents with copies or links."""
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(*document_frequencies(docs)))  # 2**BUCKET_BITS numbers
    rows = stage(signatures(docs, idf))
    contents = stage(
        rows.filter("content IS NOT NULL").groupBy("content")
        .agg(F.first("marks").alias("marks"), F.first("bands").alias("bands"), F.min("doc_key").alias("doc_key"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    )
    banded = contents.select("content", F.explode("bands").alias("band"))
    buckets = stage(banded.groupBy("band").agg(F.min("content").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    members = stage(banded.join(buckets, "band").select("band", "content", "leader"))
    star = members.filter("content <> leader").select(F.col("leader").alias("a"), F.col("content").alias("b")).distinct()
    candidates = stage(contracted(screened(stage(star), contents)))
    groups = components(candidates)
    more = across(members, contents, groups)
    if more is not None:
        groups = components(candidates.unionByName(more))
    labels = components(linked(groups, contents, docs, idf))
    found = contents.join(labels, contents["content"] == labels["node"], "left").filter("node IS NOT NULL OR copies > 1")
    found = stage(found.select("content", F.coalesce("label", "content").alias("label"), "first_id", "copies"))
    sums = stage(found.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("copies").alias("class_size")))
    return rows, stage(found.join(sums, "label").select("content", "label", "class_id", "class_size"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and class_size of every document."""
    rows, found = classes(docs)
    return rows.join(found, "content", "left").select(
        "doc_id", F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size")
    )


def first_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class, that of the smallest id, with all columns."""
    rows, found = classes(docs)
    members = stage(rows.join(found, "content").select("label", F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")))
    own = F.struct(F.col("_id").isNull().alias("x"), F.col("_id").alias("_id"), F.col("_key").alias("_key"))
    first = members.groupBy("label").agg(F.min(own).alias("_first")).select("_first._id", "_first._key")
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_own"), F.struct("*").alias("_whole"))  # names of other columns cannot clash
    flagged = marked(keyed, F.col("_own"), members.select("_key"))
    several = flagged.filter("_maybe")
    same = (F.col("_own") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    once = several.join(stage(first), same).dropDuplicates(["_own", "_id"])  # equal rows: one stays
    alone = flagged.filter("NOT _maybe").unionByName(several.join(members, same, "left_anti"))
    return alone.select("_whole.*").unionAll(once.select("_whole.*"))
