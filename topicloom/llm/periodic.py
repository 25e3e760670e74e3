"""Periodic runs of words, proposed by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) of at least ``max(min_words, min_repeats * q)`` words that no
neighbouring word extends keeping period q.

For every power of two L the dictionary names the factors of L words of a
document: equal names are equal factors. Names of 2L words come from pairs of
names of L words, and a factor that occurs once in its document leaves the
dictionary, as no longer one can occur twice. Each position knows the successor
of its factor. Successors at most 2L away are kept, and consecutive positions
with equally distant successors form arithmetic progressions, which propose that
distance as a period. A proposal is extended to both sides as far as the period
holds; stretches found more than once keep their smallest period.

Nothing is lost: in a run of period q the factors of the first power of two
L >= q recur exactly q words later (a nearer recurrence would give the run a
smaller period), so at least ``length - q - L + 1`` positions in a row propose q.
Shorter progressions cannot come from a run and are not extended.

Documents are handled whole and alone, many in one batch; there is no shuffle.
A document needs memory in proportion to its words.

Nulls: a null text has no words; null ids are kept. Texts without words have no
runs and an empty collapsed text. Repeated rows are each answered. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_runs, utf8

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
RUN = "struct<start: bigint, length: bigint, period: bigint>"


def split_words(texts: list[bytes]):
    """The words of the texts as one Arrow array, and how many each text has."""
    import pyarrow as pa

    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = ~SPACE[data]
    edges = np.diff(inside)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    stops = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    counts = np.diff(np.searchsorted(starts, stops), prepend=0)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    kept = data[inside[1:].astype(bool)]
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, counts


def recurring(at: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the positions ``at`` (ascending) those whose key occurs again: position, name, and distance of the next equal key (0: none)."""
    order = np.argsort(keys, kind="stable")
    key, place = keys[order], at[order]
    same = key[1:] == key[:-1]
    names = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(key) else np.zeros(0, np.int64)
    step = np.zeros(len(key), np.int64)
    step[:-1][same] = (place[1:] - place[:-1])[same]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    place, names, step = place[again], names[again], step[again]
    back = np.argsort(place)
    return place[back], names[back], step[back]


def proposals(word: np.ndarray, doc: np.ndarray, min_words: int, min_repeats: int):
    """(position, period) pairs of arithmetic progressions long enough for a run, over all lengths."""
    size = 1
    at, name, step = recurring(np.arange(len(word)), doc * (int(word.max()) + 1 if len(word) else 1) + word)
    while len(at):
        near = (step > 0) & (step <= 2 * size)
        head = near.copy()  # positions that begin a progression
        head[1:] &= ~((at[1:] == at[:-1] + 1) & (step[1:] == step[:-1]) & near[:-1])
        first = np.flatnonzero(head)
        progression = np.cumsum(head) - 1
        held = np.bincount(progression[near], minlength=len(first)) if len(first) else np.zeros(0, np.int64)
        period = step[first]
        enough = held >= np.maximum(min_words, min_repeats * period) - period - size + 1
        yield at[first[enough]], period[enough]
        partner = np.minimum(np.searchsorted(at, at + size), len(at) - 1)
        whole = at[partner] == at + size
        pair = name[whole] * (int(name.max()) + 1) + name[partner[whole]]
        at, name, step = recurring(at[whole], pair)
        size *= 2


def find_runs(word: np.ndarray, counts: np.ndarray, min_words: int = 24, min_repeats: int = 3) -> np.ndarray:
    """Rows (document, start, length, period), ordered, of the runs of documents whose word numbers follow each other in ``word``."""
    first = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), counts)
    asked: dict[tuple[int, int], list[np.ndarray]] = {}
    for at, period in proposals(word.astype(np.int64), doc, min_words, min_repeats):
        key = np.stack([doc[at], period], axis=1)
        pairs, where = np.unique(key, axis=0, return_inverse=True)
        for i, (d, p) in enumerate(pairs.tolist()):
            asked.setdefault((d, p), []).append(at[where.ravel() == i])
    found: dict[tuple[int, int, int], int] = {}
    for (d, p), places in sorted(asked.items()):
        a, b = int(first[d]), int(first[d + 1])
        breaks = np.concatenate([[-1], np.flatnonzero(word[a : b - p] != word[a + p : b]), [b - a - p]])
        right = np.unique(np.searchsorted(breaks, np.unique(np.concatenate(places)) - a))
        for low, high in zip(breaks[right - 1].tolist(), breaks[right].tolist()):
            start, length = low + 1, high - low - 1 + p
            if length >= max(min_words, min_repeats * p):
                found.setdefault((d, start, length), p)  # periods come in ascending order: the smallest stays
    rows = sorted((d, s, n, p) for (d, s, n), p in found.items())
    return np.array([(d, s, n, p) for d, s, n, p in sorted(rows, key=lambda r: (r[0], r[1], r[3]))], dtype=np.int64).reshape(-1, 4)


def runs(docs: DataFrame, min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed text of every row of ``docs`` (doc_id, text).

    ``collapsed`` joins by one space the words that lie in no run after its first period.
    """
    if min_repeats < 3:
        raise ValueError("progressions prove periods that occur three times or more")

    def search(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for part in in_runs(batches):
            words, counts = split_words(utf8(part.column("text")))
            found = find_runs(words.dictionary_encode().indices.to_numpy(), counts, min_words, min_repeats)
            first = np.concatenate([[0], np.cumsum(counts)])
            covered = np.zeros(len(words) + 1, np.int64)
            begin = first[found[:, 0]] + found[:, 1]
            np.add.at(covered, begin + found[:, 3], 1)
            np.add.at(covered, begin + found[:, 2], -1)
            kept = np.cumsum(covered[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(kept)])[first].astype(np.int32)
            texts = pc.binary_join(pa.ListArray.from_arrays(left, words.filter(pa.array(kept))), b" ")
            cuts = np.searchsorted(found[:, 0], np.arange(part.num_rows + 1)).astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in (1, 2, 3)], fields=list(kind))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(cuts, structs), texts.cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(search, f"doc_id {kind}, n_words bigint, runs array<{RUN}>, collapsed string")
