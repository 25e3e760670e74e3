"""Topic hierarchy, its tree, and reduction to fewer topics.

Topics that are each other's nearest merge, all such pairs of a round at once:
the four linkages never bring a merged pair closer to a third topic, so these
are the merges that one nearest pair after the other would give. The distance
of two groups follows from sums, minima or maxima over their pairs of topics,
which add up when groups merge. So a round is two groupings of the staged
table of pairs, and neither topics nor distances meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .sampling import with_row_number
from .similarity import similarities

LINKAGES = ("single", "complete", "average", "ward")
MERGES = "step int, parent_id int, topics array<int>, left_id int, right_id int, distance double"
#: what is known of a group: topics in it, its inner squared distances, height of its last merge
STATE = ("n", "within", "height")


def _distance(linkage: str) -> Column:
    """Distance of groups a and b from the value ``v`` of their pairs of topics."""
    n, m = F.col("a_n"), F.col("b_n")
    if linkage in ("single", "complete"):
        d = F.col("v")
    elif linkage == "average":
        d = F.col("v") / (n * m)
    else:  # variance criterion: mean square between the groups less those within
        d = F.sqrt(F.greatest(2 * n * m / (n + m) * (F.col("v") / (n * m) - F.col("a_within") / (n * n) - F.col("b_within") / (m * m)), F.lit(0.0)))
    return F.greatest(d, F.col("a_height"), F.col("b_height"))  # rounding must not put a merge below its parts


def _pairs(real: DataFrame, linkage: str) -> DataFrame:
    """``a, b, v``, the state of both, and ``d``, for all a < b."""
    close = similarities(real.withColumnRenamed("topic", "a"), real, "a", "vector").filter("a < topic")
    d = F.greatest(1 - F.col("similarity"), F.lit(0.0))
    rows = close.select("a", F.col("topic").alias("b"), (d * d if linkage == "ward" else d).alias("v"))
    start = {f"{side}_{name}": F.lit(1.0 if name == "n" else 0.0) for side in "ab" for name in STATE}
    return rows.withColumns(start).withColumn("d", _distance(linkage))


def _mutual(pairs: DataFrame) -> DataFrame:
    """Pairs that are the nearest of both; equal distances go to the smaller names."""
    fields = ["d", "a", "b", "v", *[f"{side}_{name}" for side in "ab" for name in STATE]]
    sides = pairs.select(F.explode(F.array("a", "b")).alias("x"), F.struct(*fields).alias("p"))
    nearest = sides.groupBy("x").agg(F.min("p").alias("p"))
    both = nearest.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("_times"), F.first("p").alias("p")).filter("_times = 2")
    return both.select("p.*")


def _after(pairs: DataFrame, merged: DataFrame, linkage: str) -> DataFrame:
    """The table of pairs when ``merged`` are groups, named by their smaller part."""
    state = [(F.col("a_n") + F.col("b_n")).alias("n"), (F.col("a_within") + F.col("b_within") + F.col("v")).alias("within"), F.col("d").alias("height")]
    moved = merged.select(F.explode(F.array("a", "b")).alias("_from"), F.col("a").alias("_to"), *state)
    for side in "ab":
        joined = pairs.join(moved.withColumnRenamed("_from", side), side, "left")
        pairs = joined.withColumns({
            f"_{side}": F.coalesce("_to", side), **{f"{side}_{name}": F.coalesce(name, f"{side}_{name}") for name in STATE}
        }).drop("_to", *STATE)
    turned = F.col("_a") > F.col("_b")
    names = {"a": F.least("_a", "_b"), "b": F.greatest("_a", "_b")}
    parts = {f"{x}_{name}": F.when(turned, F.col(f"{y}_{name}")).otherwise(F.col(f"{x}_{name}")) for x, y in ("ab", "ba") for name in STATE}
    rows = pairs.filter("_a <> _b").select(*[c.alias(k) for k, c in (names | parts).items()], "v")
    value = {"single": F.min, "complete": F.max}.get(linkage, F.sum)("v")
    # the state of a group is the same in all its rows
    out = rows.groupBy("a", "b").agg(value.alias("v"), *[F.max(name).alias(name) for name in parts])
    return out.withColumn("d", _distance(linkage))


def topic_hierarchy(topic_vectors: DataFrame, linkage: str = "ward") -> DataFrame:
    """Merge steps of all topics but -1, by cosine distance of their vectors.

    Steps are numbered by distance; at equal distances parts come before the
    whole, then smaller topics. One topic, or none, has no steps.
    """
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage!r}, use one of {LINKAGES}")
    spark = topic_vectors.sparkSession
    real = topic_vectors.filter(F.col("topic") != -1).select(F.col("topic").cast("int").alias("topic"), F.col("vector").cast("array<double>").alias("vector"))
    real = materialize(real)
    left, rounds = real.count(), []
    if left < 2:
        return spark.createDataFrame([], MERGES)
    pairs = materialize(_pairs(real, linkage))
    while left > 1:
        merged = materialize(_mutual(pairs))
        left -= merged.count()
        rounds.append(merged.select(F.lit(len(rounds)).alias("round"), "a", "b", F.col("d").alias("distance")))
        if left > 1:
            pairs = materialize(_after(pairs, merged, linkage))
    steps = rounds[0]
    for r in rounds[1:]:
        steps = steps.unionByName(r)
    base = real.agg(F.max("topic")).first()[0] + 1
    ordered = with_row_number(steps.withColumn("_at", F.struct("distance", "round", "a")), "_at", "step").drop("_at")
    ordered = materialize(ordered.withColumns({"step": F.col("step").cast("int"), "parent_id": (F.col("step") + base).cast("int")}))
    earlier = F.lag("parent_id").over(Window.partitionBy("a").orderBy("round"))  # the merges of one name
    last = ordered.groupBy("a").agg(F.max_by("parent_id", "round").alias("_last")).withColumnRenamed("a", "b")
    tree = ordered.withColumn("left_id", F.coalesce(earlier, "a")).join(last, "b", "left").withColumn("right_id", F.coalesce("_last", "b"))
    tree = materialize(tree.select("step", "parent_id", "left_id", "right_id", "distance"))
    topics = _ancestors(tree).filter(F.col("node") < base).groupBy(F.col("above").alias("parent_id")).agg(F.sort_array(F.collect_list("node")).alias("topics"))
    return tree.join(topics, "parent_id").select("step", "parent_id", "topics", "left_id", "right_id", "distance")


def _ancestors(merges: DataFrame) -> DataFrame:
    """``node, above, hops`` of every node and each one above it, in steps that double."""
    found = merges.select(F.explode(F.array("left_id", "right_id")).alias("node"), F.col("parent_id").alias("above"), F.lit(1).alias("hops"))
    found, reach = materialize(found), 1
    while True:
        ends = found.filter(F.col("hops") == reach).select("node", F.col("above").alias("_via"))
        on = found.select(F.col("node").alias("_via"), "above", (F.col("hops") + reach).alias("hops"))
        more = materialize(ends.join(on, "_via").select("node", "above", "hops"))
        if more.isEmpty():
            return found
        found, reach = found.unionByName(more), 2 * reach


def cut_to(merges: DataFrame, nr_topics: int) -> DataFrame:
    """``topic, group``: where each topic is when ``nr_topics`` groups are left."""
    last = merges.agg(F.max("step")).first()[0]
    n = 0 if last is None else last + 2
    early = merges.filter(F.col("step") < n - nr_topics)
    groups = early.select("step", "parent_id", F.explode("topics").alias("topic")).groupBy("topic").agg(F.max_by("parent_id", "step").alias("group"))
    every = merges.filter(F.col("step") == last).select(F.explode("topics").alias("topic"))
    return every.join(groups, "topic", "left").select("topic", F.coalesce("group", "topic").alias("group"))


def reduce_topics(assigned: DataFrame, merges: DataFrame, nr_topics: int, id_col: str = "doc_id") -> DataFrame:
    """Assignments after merging down to ``nr_topics``; numbered by size again."""
    from .density import number_topics
    from .joins import salted_join

    joined = salted_join(assigned, cut_to(merges, nr_topics), ["topic"], "left", [id_col])
    merged = joined.withColumn("_c", F.when(F.col("topic") == -1, F.lit(-1)).otherwise(F.coalesce(F.col("group"), F.col("topic"))))
    return number_topics(merged.drop("topic", "group"), id_col, "_c").drop("_c")


def topic_tree(merges: DataFrame, labels: DataFrame) -> DataFrame:
    """``ord, depth, node, label, line`` in display order, closest child first.

    ``labels`` is ``topic, label``; an inner node is labelled by its topics'
    labels, a topic without a label by nothing. Every node's way from its root
    is a text of 0 (first child) and 1 (second), which gives order and indent.
    """
    merges = materialize(merges.select("parent_id", "left_id", "right_id", "distance"))
    named = materialize(labels.filter(F.col("topic") != -1).select(F.col("topic").cast("int").alias("node"), "label"))
    height = merges.select(F.col("parent_id").alias("node"), F.col("distance").alias("_height"))
    child = merges.select("parent_id", F.posexplode(F.array("left_id", "right_id")).alias("_side", "node"))
    child = child.join(height, "node", "left").withColumn("_height", F.coalesce("_height", F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy("parent_id").orderBy("_height", "node")) - 1  # two rows each
    sides = materialize(child.select("node", "parent_id", F.col("_side").cast("string").alias("_lr"), place.cast("string").alias("_turn")))

    above = _ancestors(merges)
    # the turn into each node above that is no root itself, then the own one
    turns = above.join(sides.select(F.col("node").alias("above"), "_turn", "_lr"), "above", "left")
    own = sides.select("node", F.lit(0).alias("hops"), "_turn", "_lr", F.col("node").alias("above"))
    steps = turns.select("node", "hops", "_turn", "_lr", "above").unionByName(own)
    by_hops = F.reverse(F.sort_array(F.collect_list(F.struct("hops", "above", "_turn", "_lr"))))  # root first
    ways = steps.groupBy("node").agg(by_hops.alias("_w"))
    joined = lambda part: F.array_join(F.transform("_w", lambda s: s[part]), "")  # noqa: E731  (nothing for the root)
    ways = ways.select("node", F.col("_w")[0]["above"].alias("root"), joined("_turn").alias("way"), joined("_lr").alias("_lr"))
    every = merges.select(F.col("parent_id").alias("node")).unionByName(named.select("node")).unionByName(sides.select("node")).distinct()
    ways = every.join(ways, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.coalesce("way", F.lit("")).alias("way"), F.coalesce("_lr", F.lit("")).alias("_lr"))
    ways = materialize(ways.join(named, "node", "left").join(height, "node", "left"))

    leaf = F.col("_height").isNull()
    leaves = ways.filter(leaf).select("node", "_lr", F.coalesce("label", F.lit("")).alias("label"))
    parts = above.join(leaves, "node").groupBy(F.col("above").alias("node")).agg(F.sort_array(F.collect_list(F.struct("_lr", "label"))).alias("_l"))
    texts = parts.select("node", F.array_join(F.col("_l.label"), " + ").alias("_text"))
    rows = ways.join(texts, "node", "left").withColumn("label", F.when(leaf, F.coalesce("label", F.lit(""))).otherwise(F.col("_text")))
    depth = F.length("way")
    over = F.expr("substring(way, 1, greatest(length(way) - 1, 0))")  # the children of a root stand without indent
    indent = F.replace(F.replace(over, F.lit("0"), F.lit("│  ")), F.lit("1"), F.lit("   "))
    mark = F.when(depth == 0, "").when(F.col("way").endswith("1"), "└─").otherwise("├─")
    tail = F.when(leaf, F.concat(F.lit("■──"), "label", F.lit(" ── Topic: "), F.col("node").cast("string"))).otherwise(F.col("label"))
    drawn = rows.select(F.struct("root", "way").alias("_at"), depth.alias("depth"), "node", "label", F.concat(indent, mark, tail).alias("line"))
    return with_row_number(drawn, "_at", "ord").select(F.col("ord").cast("int").alias("ord"), "depth", "node", "label", "line")
