"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a text (byte classes, words, repeated words and lines) are taken
from whole runs of texts with array operations. Trees are grown level by level
on binned statistics and stored as flat arrays of complete binary trees, so
that a batch walks all trees at once in numpy.

The model is fitted on at most about ``sample`` labelled rows, drawn by a hash
of the id; every document is scored from its whole text.

Nulls: a null text counts as empty; labels without id or quality are ignored;
several labels of one id are averaged and rounded. Documents without id are
scored like others. Repeated rows are scored alike. Without labelled rows every
score is 0.5. An empty table gives an empty result. Other columns are kept; a
column named as the score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, in_runs, mixed, unit_interval, utf8

#: byte classes whose shares are statistics
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t\r", "line": b"\n",
           "stop": b".", "comma": b",;:", "shout": b"!?", "bar": b"|", "mark": b"#$%&*+=<>@^~_\\/", "quote": b"\"'`", "bracket": b"()[]{}-"}
NAMES = ["log_bytes", "log_words", "log_lines", *CLASSES, "wide", "other", "word_bytes", "words_per_line", "stops_per_word", "bars_per_word",
         "shouts_per_word", "marks_per_word", "distinct_words", "distinct_pairs", "same_as_last", "repeated_lines"]
CODES = np.full(256, len(CLASSES) + 1, dtype=np.int64)
CODES[128:] = len(CLASSES)
for _i, _chars in enumerate(CLASSES.values()):
    CODES[np.frombuffer(_chars, np.uint8)] = _i


def distinct_per(group: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values in each group."""
    with np.errstate(over="ignore"):
        keys = mixed(values ^ (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(keys, return_index=True)
    return np.bincount(group[at], minlength=n)


def statistics(texts: list[bytes]) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    n = len(texts)
    if not n:
        return np.zeros((0, len(NAMES)), np.float32)
    words = Words(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    sizes = np.fromiter((len(t) for t in texts), np.int64, n)
    doc_of = np.repeat(np.arange(n), sizes + 1)
    k = len(CLASSES) + 2
    classes = np.bincount(doc_of * k + CODES[raw], minlength=n * k).reshape(n, k).astype(float)
    names = list(CLASSES)
    classes[:, names.index("line")] -= 1  # the joint behind every text
    count, size = np.maximum(words.counts, 1), np.maximum(sizes, 1)
    lines = classes[:, names.index("line")] + 1
    ends = np.flatnonzero(raw == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    line_doc = doc_of[ends]
    filled = ends > starts
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hashes, dtype=np.uint64)])
        a, b = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
        line_hash = (run[b] - run[a]) * np.uint64(3) + (ends - starts).astype(np.uint64)
    n_lines = np.bincount(line_doc[filled], minlength=n)
    same = np.zeros(n)
    if len(words.hashes) > 1:
        hit = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
        same = np.bincount(words.doc[1:][hit], minlength=n)
    pairs = words.gram_starts(2)
    n_pairs = np.bincount(words.doc[pairs], minlength=n)
    per_word = lambda name: classes[:, names.index(name)] / count
    columns = [
        np.log1p(sizes), np.log1p(words.counts), np.log1p(lines), *(classes / size[:, None]).T,
        np.bincount(words.doc, weights=words.ends - words.starts, minlength=n) / count, words.counts / lines,
        per_word("stop"), per_word("bar"), per_word("shout"), per_word("mark"),
        distinct_per(words.doc, words.hashes, n) / count,
        distinct_per(words.doc[pairs], words.grams(2)[pairs], n) / np.maximum(n_pairs, 1),
        same / count, 1 - distinct_per(line_doc[filled], line_hash[filled], n) / np.maximum(n_lines, 1),
    ]
    return np.stack(columns, axis=1).astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees of one depth, as arrays of shape (trees, nodes)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        n_trees, inner = self.feature.shape
        at = np.zeros((len(x), n_trees), dtype=np.int64)
        trees, rows = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
        for _ in range((inner + 1).bit_length() - 1):
            at = 2 * at + 1 + (x[rows, self.feature[trees, at]] > self.threshold[trees, at])
        margin = self.base + self.leaf[trees, at - inner].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Logistic boosting; a split takes the best gain over all statistics and bins of each node."""
    inner = 2**depth - 1
    none = Trees(np.zeros((0, inner), int), np.zeros((0, inner), np.float32), np.zeros((0, inner + 1)), 0.0)
    if not len(y):
        return none
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], axis=1)
    feature = np.zeros((trees, inner), dtype=np.int64)
    threshold = np.full((trees, inner), np.inf, dtype=np.float32)  # an unsplit node sends all to the left
    leaf = np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    offsets = np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            cells = ((node - first)[:, None] * (width * bins) + offsets + binned).ravel()
            sums = [np.bincount(cells, np.repeat(v, width), nodes * width * bins).reshape(nodes, width, bins).cumsum(axis=2) for v in (g, h)]
            total_g, total_h = sums[0][:, :, -1:], sums[1][:, :, -1:]
            left_g, left_h = sums
            right_g, right_h = total_g - left_g, total_h - left_h
            gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
            gain[(left_h < least) | (right_h < least)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            for i, cell in enumerate(best):
                j, b = divmod(int(cell), bins)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    feature[t, first + i], threshold[t, first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = -rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + l2)
        margin += leaf[t][at]
    return Trees(feature, threshold, leaf, base)


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, seed: int = 42) -> Trees:
    """Fit on about ``sample`` labelled documents at most. ``labels``: doc_id, quality."""
    marked = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.round(F.avg("quality")).cast("double").alias("_label"))
    share = sample / max(marked.count(), 1)
    if share < 1:
        marked = marked.filter(unit_interval(F.col("doc_id"), seed) < share)
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "_label")  # `sample` rows

    def measure(batches):
        import pyarrow as pa

        for run in in_runs(batches):
            x = statistics(utf8(run.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float32())), run.column("_label")], ["x", "y"])

    found = rows.mapInArrow(measure, "x array<float>, y double").toArrow().combine_chunks()  # `sample` rows
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, len(NAMES))
    y = found.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # rows arrive in any order; the model should not depend on it
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Trees, name: str = "score", least: float | None = None) -> DataFrame:
    """All columns and the score of every document; with ``least`` only those that reach it."""
    kept = docs.drop(name)
    schema = kept.withColumn(name, F.lit(0.0)).schema

    def rate(batches):
        import pyarrow as pa

        for run in in_runs(batches):
            s = model.score(statistics(utf8(run.column("text"))))
            out = pa.RecordBatch.from_arrays([*run.columns, pa.array(s, pa.float64())], [*run.schema.names, name])
            yield out if least is None else out.filter(pa.array(s >= least))

    return kept.mapInArrow(rate, schema)
