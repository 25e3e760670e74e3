"""Chat formatting by rotating the perspective of a dialogue with several parties.

For every participant (every role but ``system``) the dialogue is rendered once
with that speaker as the assistant and all others as named users; only the
assistant's contents count for the loss, as character spans of the text.

Long dialogues are rendered in segments of ``segment_turns`` consecutive turn
numbers, so that no text or task grows without bound. A segment with more than
``segment_rows`` rows (repeated or null turn numbers) is rendered in parts of so
many consecutive rows. The segments and parts of a dialogue, joined in order,
are its whole text; spans count from the start of their part.

Nulls: a null text is an empty turn; a null or empty role is an unnamed user
and no participant; null turn numbers form a last segment of their own (null);
rows without conv_id are one dialogue with a null id. Rows with equal turn
numbers are ordered by role and text. A dialogue without participants (system
turns only, say) has no rendering. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
TURN = ["conv_id", "segment", "_turn", "speaker", "body"]


def header(speaker: Column, participant: Column) -> Column:
    """The head line of a turn as seen by ``participant``."""
    role = (
        F.when(speaker == participant, "assistant")
        .when(speaker == SYSTEM, SYSTEM)
        .when(speaker == "", "user")
        .otherwise(F.concat(F.lit("user name="), speaker))
    )
    return F.concat(F.lit(START), role, F.lit("\n"))


def render(turns: Column, participant: Column) -> tuple[Column, Column]:
    """Text and loss spans of an ordered array of (speaker, body)."""
    pieces = F.transform(turns, lambda t: F.concat(header(t["speaker"], participant), t["body"], F.lit(END + "\n")))
    ends = F.aggregate(
        pieces, F.array(F.lit(0)), lambda acc, piece: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(piece)))
    )
    spans = F.filter(
        F.zip_with(
            turns, F.slice(ends, 1, F.greatest(F.size(turns), F.lit(1))),
            lambda t, at: F.when(
                t["speaker"] == participant,
                F.struct(
                    (at + F.length(header(t["speaker"], participant))).alias("start"),
                    (at + F.length(header(t["speaker"], participant)) + F.length(t["body"])).alias("end"),
                ),
            ),
        ),
        lambda s: s.isNotNull(),
    )
    return F.array_join(pieces, ""), spans


def in_parts(rows: DataFrame, segment_rows: int) -> DataFrame:
    """Rows of crowded segments with their part, equal rows of a part as one row with ``times``.

    Equal rows are counted first; what is left is ranged by its order, and sums
    by range give every row its place in its segment.
    """
    key = ["_group", F.col("_turn").isNull(), "_turn", "speaker", "body"]
    counted = rows.groupBy("_group", *TURN).agg(F.count(F.lit(1)).alias("_n"))
    ranged = stage(counted.repartitionByRange(*key).withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_group", "_range").agg(F.sum("_n").alias("_sum"))
    offsets = sums.select("_group", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_group", "_range").orderBy(*key[1:]).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("_run", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(offsets, ["_group", "_range"])
    placed = placed.withColumn("_first", F.col("_offset") + F.col("_run")).withColumn("_last", F.col("_first") + F.col("_n") - 1)
    parts = placed.withColumn("part", F.explode(F.expr(f"sequence(_first div {segment_rows}, _last div {segment_rows})")))
    times = F.least(F.col("_last") + 1, (F.col("part") + 1) * segment_rows) - F.greatest(F.col("_first"), F.col("part") * segment_rows)
    return parts.select(*TURN, F.col("part").cast("long").alias("part"), times.cast("long").alias("times"))


def rotate(turns: DataFrame, segment_turns: int = 1024, segment_rows: int = 4096) -> DataFrame:
    """conv_id, segment, part, participant, n_turns, text and spans for all participants of ``turns`` (conv_id, turn, role, text)."""
    rows = turns.select(
        "conv_id", F.floor(F.col("turn") / segment_turns).alias("segment"), F.col("turn").alias("_turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("speaker"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("body"),
    ).withColumn("_group", F.xxhash64("conv_id", "segment"))
    crowded = stage(rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > segment_rows).select("_group"))
    usual = rows.join(crowded, "_group", "left_anti").select(*TURN, F.lit(0).cast("long").alias("part"), F.lit(1).cast("long").alias("times"))
    dealt = usual.unionByName(in_parts(rows.join(crowded, "_group", "left_semi"), segment_rows))
    order = F.struct(F.col("_turn").isNull().alias("a"), F.col("_turn").alias("b"), "speaker", "body", "times")
    ordered = F.array_sort(F.collect_list(order))
    segments = dealt.groupBy("conv_id", "segment", "part").agg(F.flatten(F.transform(ordered, lambda t: F.array_repeat(t, t["times"].cast("int")))).alias("turns"))
    named = (F.col("speaker") != "") & (F.col("speaker") != SYSTEM)
    people = rows.filter(named).groupBy("conv_id", "speaker").agg(F.lit(1).alias("_one")).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("participant"))
    text, spans = render(F.col("turns"), F.col("participant"))
    return segments.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "segment", "part", "participant", F.size("turns").cast("long").alias("n_turns"), text.alias("text"), spans.alias("spans")
    )
