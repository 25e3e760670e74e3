"""Mixing sources to target weights: fixed-length blocks, drawn into output shards.

Every source's words are packed into one stream, cut into blocks of
``block_words``. A source's target fixes how many block slots it gets; slots
are dealt to output shards by a random order of all slots, so the counts of a
shard follow the multinomial law of the targets, given that every source meets
its own total. The slots of a source run through pseudorandom permutations of
its block numbers (one per pass over the source), and blocks join slots by
(source, block). The last slot of a source may take only the first words of its
block, so that a source gives its target to the word.

Nulls: a null text has size 0; a null source is a source of its own and comes
last; null ids are kept. Repeated rows each stand for themselves. Documents
without words get 0. No row is lost, and an empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sampling import with_row_number
from .common import stage, unit_interval

WORD = r"[^\x20\x09-\x0D]+"
#: documents per packing bucket: the rows of a source are numbered bucket by bucket
BUCKET_ROWS = 512
#: slots that one row stands for until they are spread over tasks
CHUNK = 4096
ROUNDS = 24


@dataclass
class Mix:
    """``sources``: sizes, weights, targets; ``slots``: the plan, one row per block slot of the output; ``taken``: words by document."""

    sources: DataFrame
    slots: DataFrame
    taken: DataFrame


def permuted(x: Column, n: Column, seed: Column, forward: bool = True) -> Column:
    """A pseudorandom permutation of 0..n-1 (swap-or-not rounds), or its inverse."""
    order = range(ROUNDS) if forward else reversed(range(ROUNDS))

    def swap(acc: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(seed, i), n) - acc, n)
        high = F.greatest(acc, partner)
        return F.when(F.xxhash64(seed, i, high) % 2 == 0, partner).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(i) for i in order]), x.cast("long"), swap)


def targets(sized: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """One row per source: rank, weight, size and the words it should give.

    Sources rank by code point, null last, and take the weights in turn.
    A target that would pass ``cap`` times its source's size stops there and
    the others share the rest by weight, until none is above.
    """
    sums = sized.groupBy("_key").agg(F.min("source").alias("source"), F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = with_row_number(stage(sums), "_key", "rank")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stage(ranked.withColumn("weight", turn))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, most = F.col("weight").cast("double"), F.col("source_size") * F.lit(cap)
    unit, capped_before = None, -1
    while True:
        capped = F.lit(False) if unit is None else share * F.lit(unit) > most
        row = sources.agg(F.count_if(capped), F.sum(F.when(capped, most).otherwise(0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if unit is not None and row[0] == capped_before:
            break
        capped_before, unit = row[0], float(total - (row[1] or 0)) / float(row[2]) if row[2] else 0.0
    return sources.withColumn("target", F.when(share * F.lit(unit) > most, most.cast("double")).otherwise(share * F.lit(unit)))


def slot_counts(sources: DataFrame, block_words: int, cap: int, seed: int) -> DataFrame:
    """Per source: blocks, whole passes, words beyond them, and the slots that these need."""
    size, n = F.col("source_size"), F.col("n_blocks")
    out = (
        sources.filter("source_size > 0")
        .withColumn("n_blocks", F.ceil(size / block_words))
        .withColumn("tail", size - (n - 1) * block_words)
        .withColumn("quota", F.least(F.round("target").cast("long"), size * cap))
        .withColumn("passes", F.expr("quota div source_size"))
        .withColumn("rest", F.col("quota") - F.col("passes") * size)
        .withColumn("tail_at", permuted(n - 1, n, F.xxhash64("rank", "passes", F.lit(seed)), forward=False))
    )
    rest, at = F.col("rest"), F.col("tail_at")
    plain = F.ceil(rest / block_words)
    with_tail = F.greatest(at + 1, F.ceil((rest + block_words - F.col("tail")) / block_words))
    return out.withColumn("rest_slots", F.when(plain <= at, plain).otherwise(with_tail)).withColumn(
        "n_slots", F.col("passes") * n + F.col("rest_slots")
    )


def planned_slots(counted: DataFrame, block_words: int, shard_blocks: int, seed: int) -> DataFrame:
    """One row per slot of the output: its shard and place, its source's block, and how many of that block's first words it takes."""
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = stage(counted.withColumn("slots_before", F.coalesce(F.sum("n_slots").over(before), F.lit(0))))
    total = placed.agg(F.sum("n_slots")).first()[0] or 0
    chunks = (
        placed.filter("n_slots > 0")
        .withColumn("_chunk", F.explode(F.expr(f"sequence(0L, (n_slots - 1) div {CHUNK})")))
        .repartition("rank", "_chunk")
    )
    slots = chunks.withColumn("slot", F.explode(F.expr(f"sequence(_chunk * {CHUNK}L, least(_chunk * {CHUNK}L + {CHUNK - 1}, n_slots - 1))")))
    j = F.col("slot")
    slots = (
        slots.withColumn("pass", F.expr("slot div n_blocks"))
        .withColumn("_in", F.expr("slot % n_blocks"))
        .withColumn("block", permuted(F.col("_in"), F.col("n_blocks"), F.xxhash64("rank", "pass", F.lit(seed))))
        .withColumn("length", F.when(F.col("block") == F.col("n_blocks") - 1, F.col("tail")).otherwise(F.lit(block_words)))
        .withColumn("_before", F.col("_in") * block_words - F.when(F.col("_in") > F.col("tail_at"), F.lit(block_words) - F.col("tail")).otherwise(0))
        .withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("length")).otherwise(F.least(F.col("length"), F.col("rest") - F.col("_before"))))
        .withColumn("_at", permuted(F.col("slots_before") + j, F.lit(max(total, 1)).cast("long"), F.lit(seed).cast("long")))
    )
    return slots.select(
        F.expr(f"_at div {shard_blocks}").alias("out_shard"), F.expr(f"_at % {shard_blocks}").alias("out_slot"),
        "rank", "block", "length", F.col("words").cast("long").alias("words"),
    )


def shard_counts(slots: DataFrame) -> DataFrame:
    """Blocks by output shard and source rank."""
    return slots.groupBy("out_shard", "rank").agg(F.count(F.lit(1)).alias("blocks"), F.sum("words").alias("words"))


def packed(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with words, each with its place ``start`` in its source's stream of words.

    Rows are numbered in buckets by a hash, and the buckets of a source by
    their sums, so a source with a third of all rows is not one task.
    """
    docs = (
        sized.filter("size > 0")
        .join(sources.select("_key", "rank", "source_size", "target", "n_docs"), "_key")
        .withColumn("_bucket", F.expr(f"pmod(_hash, greatest(n_docs div {BUCKET_ROWS}, 1))"))
    )
    before = Window.partitionBy("rank").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = docs.groupBy("rank", "_bucket").agg(F.sum("size").alias("_size")).withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    within = Window.partitionBy("rank", "_bucket").orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        docs.withColumn("_run", F.sum("size").over(within))
        .join(offsets.drop("_size"), ["rank", "_bucket"])
        .withColumn("start", F.col("_offset") + F.col("_run") - F.col("size"))
        .select("doc_id", F.col("_hash").alias("doc_key"), "size", "rank", "source_size", "target", "start")
    )


def doc_key(seed: int) -> Column:
    return F.xxhash64("doc_id", "text", F.lit(seed))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, block_words: int = 1024, shard_blocks: int = 256, seed: int = 42
) -> Mix:
    """Mix ``docs`` (doc_id, text, source); see the module text."""
    source = F.col("source").cast("string")
    sized = stage(
        docs.select(
            "doc_id", source.alias("source"),
            F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)).alias("_key"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            doc_key(seed).alias("_hash"),
        )
    )
    sources = stage(targets(sized, weights, cap))
    slots = planned_slots(slot_counts(sources, block_words, cap, seed), block_words, shard_blocks, seed)
    blocks = slots.groupBy("rank", "block").agg(
        F.count_if(F.col("words") == F.col("length")).alias("_times"),
        F.coalesce(F.max(F.when(F.col("words") < F.col("length"), F.col("words"))), F.lit(0)).alias("_cut"),
    )
    pieces = (
        packed(sized, sources)
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block_words}, (start + size - 1) div {block_words})")))
        .withColumn("_lo", F.greatest(F.col("start") - F.col("block") * block_words, F.lit(0)))
        .withColumn("_hi", F.least(F.col("start") + F.col("size") - F.col("block") * block_words, F.lit(block_words)))
    )
    words = (F.col("_hi") - F.col("_lo")) * F.coalesce("_times", F.lit(0)) + F.greatest(F.least("_hi", F.coalesce("_cut", F.lit(0))) - F.col("_lo"), F.lit(0))
    with_words = (
        pieces.join(blocks, ["rank", "block"], "left")
        .groupBy("rank", "start", "doc_id", "doc_key", "size", "source_size", "target")
        .agg(F.sum(words).alias("taken"))
    )
    columns = ["doc_id", "size", "source_size", "target", "taken", "doc_key"]
    without = sized.withColumnRenamed("_hash", "doc_key").filter("size = 0").join(sources.select("_key", "source_size", "target"), "_key").withColumn("taken", F.lit(0).cast("long"))
    return Mix(sources, slots, with_words.select(columns).unionByName(without.select(columns)))


def repeated(docs: DataFrame, seed: int = 42, **settings) -> DataFrame:
    """The mix in whole documents, with all columns of ``docs``.

    A document stands in it as often as its words are taken on average, a
    fraction being rounded by a repeatable draw. Documents without words stay once.
    """
    taken = mix(docs, seed=seed, **settings).taken
    share = taken.groupBy("doc_id", "doc_key").agg(F.avg(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(1.0)).alias("_share"))
    times = stage(
        share.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), F.floor(F.col("_share") + unit_interval(F.col("doc_key"), seed)).cast("int").alias("_times"))
        .filter("_times > 0")
    )
    keyed = docs.select("doc_id", doc_key(seed).alias("_own"), F.struct("*").alias("_whole"))  # names of other columns cannot clash
    joined = keyed.join(times, (F.col("_own") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_whole.*")
