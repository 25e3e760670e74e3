"""Benchmark decontamination by winnowing.

Both sides are cut into words (lower-cased A-Z, digits and non-ASCII
characters). Of every ``window - gram + 1`` consecutive gram hashes the
smallest is a fingerprint, so two texts that share ``window`` consecutive words
share a fingerprint inside them. Fingerprints of documents that a bitmap of the
benchmark's fingerprints may hold are joined with these, each side carrying the
words around its gram; a joined pair is extended to both sides as long as the
words agree, and counts if at least ``window`` words do. Comparison is of words,
not of hashes. An item of fewer words is one window of its own length, and the
grams of that length stand for themselves.

The bitmap has at most ``max_bits`` bits, whatever the benchmark's size; it only
spares rows. Items of equal words are one class until the end.

Nulls: null and empty texts have no words and hit nothing; items without id hit
words but are not counted or listed; documents without id are kept. Repeated
document rows each get a result, repeated items count once by id. Empty tables
give empty results or no hits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, in_runs, stage, utf8

WINDOW, GRAM = 10, 5
FOUND = "array<struct<h:bigint,n:int,pos:int,lead:int,words:array<string>>>"


def winnowed(words: Words, window: int, gram: int) -> np.ndarray:
    """Positions of the fingerprints: the smallest gram hash (last of equals) of each window."""
    span = window - gram + 1
    hashes = words.grams(gram)
    begins = words.gram_starts(window)
    if not len(begins):
        return begins
    best, least = begins.copy(), hashes[begins].copy()
    for i in range(1, span):
        here = hashes[begins + i]
        better = here <= least
        best[better], least[better] = begins[better] + i, here[better]
    return np.unique(best)


def fingerprints(words: Words, window: int, gram: int, lengths: list[int]):
    """(length, positions, hashes): winnowed grams, and all grams of each short length."""
    at = winnowed(words, window, gram)
    yield window, at, words.grams(gram)[at]
    for n in lengths:
        at = words.gram_starts(n)
        yield n, at, words.grams(n)[at]


def surroundings(words: Words, at: int, n: int, window: int, gram: int) -> tuple[int, list[str]]:
    """Words that can lie in one window with the gram, and how many of them stand before it."""
    if n < window:
        return 0, words.text(at, at + n)
    doc = words.doc[at]
    a, b = max(int(words.first[doc]), at - (window - gram)), min(int(words.first[doc + 1]), at + window)
    return at - a, words.text(a, b)


def item_prints(bench: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(class, h, n, lead, words) of the item classes, and their (class, item_id)."""
    schema = f"item_id {bench.schema['item_id'].dataType.simpleString()}, class string, prints {FOUND}"

    def measure(batches):
        import hashlib

        import pyarrow as pa

        for run in in_runs(batches):
            words = Words(utf8(run.column("text")))
            prints: list[list] = [[] for _ in range(run.num_rows)]
            short = sorted({int(c) for c in words.counts if 0 < c < window})
            for n, at, hashes in fingerprints(words, window, gram, short):
                for p, h in zip(at.tolist(), hashes.view(np.int64).tolist()):
                    doc = words.doc[p]
                    if n == window or words.counts[doc] == n:
                        lead, around = surroundings(words, p, n, window, gram)
                        prints[doc].append({"h": h, "n": n, "pos": p - int(words.first[doc]), "lead": lead, "words": around})
            classes = [hashlib.sha256(" ".join(words.text(a, b)).encode()).hexdigest() for a, b in zip(words.first, words.first[1:])]
            yield pa.RecordBatch.from_arrays([run.column("item_id"), pa.array(classes), pa.array(prints, prints_type())], ["item_id", "class", "prints"])

    items = stage(bench.select("item_id", "text").mapInArrow(measure, schema).filter(F.size("prints") > 0))
    classes = items.groupBy("class").agg(F.first("prints").alias("prints"))  # equal words, equal prints
    prints = stage(classes.select("class", F.explode("prints").alias("p")).select("class", "p.h", "p.n", F.col("p.lead").alias("item_lead"), F.col("p.words").alias("item_words")))
    return prints, stage(items.filter("item_id IS NOT NULL").select("class", "item_id").distinct())


def prints_type():
    import pyarrow as pa

    return pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("lead", pa.int32()), ("words", pa.list_(pa.string()))]))


def bitmap(prints: DataFrame, max_bits: int) -> np.ndarray:
    """One bit for each fingerprint's last bits, in a power of two of at most ``max_bits`` bits."""
    count = prints.count()
    bits = min(max_bits, 1 << max(16, int(np.ceil(np.log2(max(count, 1) * 4096)))))
    words = (
        prints.select(F.expr(f"h & {bits - 1}L").alias("_bit")).groupBy(F.shiftright("_bit", 6).alias("_at"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(_bit % 64 AS INT))")).alias("_word")).collect()  # at most max_bits / 64 rows
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    for r in words:
        out[r[0]] = r[1]
    return out.view(np.uint64)


def matches(docs: DataFrame, prints: DataFrame, window: int, gram: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Word counts of the rows, and (row, class, first, end): their words inside an occurring window."""
    spark = docs.sparkSession
    short = [r[0] for r in prints.filter(F.col("n") < window).select("n").distinct().collect()]  # lengths below `window`
    held = spark.sparkContext.broadcast(bitmap(prints, max_bits))

    def measure(batches):
        import pyarrow as pa

        filled = held.value
        mask = np.uint64(len(filled) * 64 - 1)
        for run in in_runs(batches):
            words = Words(utf8(run.column("text")))
            found: list[list] = [[] for _ in range(run.num_rows)]
            for n, at, hashes in fingerprints(words, window, gram, short):
                bit = hashes & mask
                hit = (filled[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                for p, h in zip(at[hit].tolist(), hashes[hit].view(np.int64).tolist()):
                    doc = words.doc[p]
                    lead, around = surroundings(words, p, n, window, gram)
                    found[doc].append({"h": h, "n": n, "pos": p - int(words.first[doc]), "lead": lead, "words": around})
            yield pa.RecordBatch.from_arrays(
                [run.column("doc_id"), run.column("doc_key"), pa.array(words.counts, pa.int64()), pa.array(found, prints_type())],
                ["doc_id", "doc_key", "n_words", "found"],
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, doc_key bigint, n_words bigint, found {FOUND}"
    measured = docs.select("doc_id", doc_key().alias("doc_key"), "text").mapInArrow(measure, schema)
    rows = stage(measured.withColumn("_row", F.monotonically_increasing_id()))
    pairs = rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*").join(prints, ["h", "n"])

    def extend(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                a, b, n = r["words"], r["item_words"], r["n"]
                if n < window:
                    if a == b:
                        out.append((r["_row"], r["class"], r["pos"], r["pos"] + n))
                    continue
                i, j = r["lead"], r["item_lead"]
                if a[i : i + gram] != b[j : j + gram]:
                    continue
                left, right = 0, gram
                while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
                    left += 1
                while right < min(len(a) - i, len(b) - j) and a[i + right] == b[j + right]:
                    right += 1
                if left + right >= window:
                    out.append((r["_row"], r["class"], r["pos"] - left, r["pos"] + right))
            columns = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()))], ["_row", "class", "first", "end"])

    return rows, pairs.mapInArrow(extend, "_row bigint, class string, first int, end int")


def doc_key():
    """Tells apart rows of one id with different texts."""
    return F.xxhash64("doc_id", "text")


def overlaps(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM, max_bits: int = 1 << 27) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, words hit, the spans hit, and the ids of the occurring items of ``bench`` (item_id, text)."""
    prints, members = item_prints(bench, window, gram)
    rows, found = matches(docs, prints, window, gram, max_bits)
    found = stage(found.distinct())
    spans = found.groupBy("_row").agg(F.array_sort(F.collect_set(F.struct("first", "end"))).alias("_spans"))
    merged = F.aggregate(
        "_spans", F.array().cast("array<struct<first:int,end:int>>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["first"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.try_element_at(acc, F.lit(-1))["first"].alias("first"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], s["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    hit = spans.select("_row", merged.alias("spans"))
    hit = hit.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["first"]))
    items = (
        found.select("_row", "class").distinct().join(members, "class").groupBy("_row")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    return (
        rows.drop("found").join(hit, "_row", "left").join(items, "_row", "left")
        .select(
            "doc_id", "doc_key", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "spans",
            F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        )
        .withColumn("contaminated", F.col("n_hit") > 0)
    )


def clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The documents that no benchmark window occurs in, with all their columns."""
    hit = overlaps(docs, bench, window, gram).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).distinct()
    keyed = docs.select("doc_id", doc_key().alias("_own"), F.struct("*").alias("_whole"))  # names of other columns cannot clash
    return keyed.join(stage(hit), (F.col("_own") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti").select("_whole.*")
