"""What the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ODD = np.uint64(0x9E3779B97F4A7C15)
ODD_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: bytes of words: digits, letters (both cases) and whatever is not ASCII
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[48:58] = WORD_BYTES[65:91] = WORD_BYTES[97:123] = WORD_BYTES[128:] = True
#: 64-bit words of the bitmap of :func:`marked`
MARK_WORDS = 1 << 18
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stage(df: DataFrame) -> DataFrame:
    """A written table in the shared folder, so that lost executors cost no recomputation."""
    return materialize(df)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def unit_interval(*columns: Column | int | str) -> Column:
    """A repeatable draw in [0, 1) from the hash of the columns."""
    hashed = F.xxhash64(*[F.lit(c) if isinstance(c, (int, str)) else c for c in columns])
    return F.shiftrightunsigned(hashed, 11).cast("double") / F.lit(float(1 << 53))


def marked(rows: DataFrame, key: Column, wanted: DataFrame, name: str = "_maybe") -> DataFrame:
    """``rows`` with a flag that is true for all whose ``key`` (long) is in the one column of ``wanted``, and for some others.

    The keys of ``wanted`` set bits in at most ``MARK_WORDS`` 64-bit words, so
    what is broadcast has a fixed size; the more keys, the more rows are
    flagged without need.
    """
    split = lambda k: (F.pmod(k, F.lit(MARK_WORDS)).cast("int"), F.pmod(F.shiftrightunsigned(k, 32), F.lit(64)).cast("int"))
    word, bit = split(F.col(wanted.columns[0]))
    words = wanted.select(word.alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_bits"))
    word, bit = split(key)
    keyed = rows.withColumns({"_word": word, "_bit": bit}).join(F.broadcast(words), "_word", "left")
    return keyed.withColumn(name, F.expr("coalesce(shiftright(_bits, _bit) & 1L, 0L) = 1L")).drop("_word", "_bit", "_bits")


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: spreads every input bit over the word."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


class Words:
    """The lower-cased words of a run of texts, found and hashed as whole arrays.

    ``starts``/``ends`` are byte positions in ``data`` (the joined texts),
    ``doc`` the index of the text of each word, ``hashes`` a 64-bit hash of its
    bytes. Nothing is done per word in Python.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = LOWER[np.frombuffer(joined, dtype=np.uint8)]
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[1:] = WORD_BYTES[self.data]
        edges = np.diff(inside)
        self.starts = np.flatnonzero(edges == 1)
        self.ends = np.flatnonzero(edges == -1)
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        stops = np.cumsum(lengths)
        self.doc = np.searchsorted(stops, self.starts, side="right")
        self.counts = np.bincount(self.doc, minlength=len(texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.hashes = self._hashes()

    def _hashes(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            n = len(self.data)
            scaled = (self.data.astype(np.uint64) + np.uint64(1)) * powers(ODD, n)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scaled, dtype=np.uint64)])
            value = (sums[self.ends] - sums[self.starts]) * powers(ODD_INVERSE, n)[self.starts]
        return mixed(value + (self.ends - self.starts).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each position; only positions of :meth:`gram_starts` are whole."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            out = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                out = (out + self.hashes[i : n - k + 1 + i]) * ODD
        return mixed(out)

    def gram_starts(self, k: int) -> np.ndarray:
        """Positions from which k words lie in one text."""
        n = len(self.hashes) - k + 1
        return np.flatnonzero(self.doc[:n] == self.doc[k - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def text(self, i: int, j: int) -> list[str]:
        """Words i to j, as strings."""
        raw = self.data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(self.starts[i:j], self.ends[i:j])]


def utf8(column) -> list[bytes]:
    """The texts of an Arrow column as bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast("binary").to_pylist()]


def in_runs(batches, size: int = 4 << 20, text: str = "text"):
    """Arrow batches cut so that each run holds about ``size`` bytes of text (one text at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        run = (np.cumsum(lengths) // size).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
