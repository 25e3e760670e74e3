"""Filters, copies, units, joins, sampling and the preprocessing plan."""

import pytest
from pyspark.sql import functions as F

from topicloom.config import Cleaning, DataSource, Filters, Preprocessing
from topicloom.operators import audit, dedupe, filters, joins, sampling, units
from topicloom.plans import preprocess


def plan(**flt):
    return Preprocessing(DataSource(("title", "text"), "id", ("text",)), Cleaning(lowercase=True), Filters(**flt))


ROWS = [
    (1, "T", "same words here", 1.0), (2, "t", "same words here", 9.0), (3, None, "other words here now", 7.0),
    (4, "t", None, 9.0), (5, "t", "   ", 9.0), (6, "t", "", 9.0), (7, "t", "x", 9.0), (8, "t", "no score at all", None),
    (9, "t", "one two three four five six", 9.0),
]
SCHEMA = "id long, title string, text string, score double"


def reasons(flagged):
    return {r.id: r.reason for r in flagged.select("id", "reason").collect()}


def test_rules_in_order(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    cfg = plan(length_filter=True, min_doc_length=3, max_doc_length=6, duplicate_removal=True,
               score_filter=True, score_column_for_filtering="score", min_score_for_filtering=5)
    flagged = preprocess.flag_rows(df, cfg)
    assert reasons(flagged) == {
        1: "score_out_of_range",  # the first copy fails the score,
        2: "duplicate_text",  # so the well-scored later copy is gone too
        3: None, 4: "missing_required", 5: "missing_required", 6: "missing_required",
        7: "too_short", 8: "score_null", 9: "too_long",
    }
    kept, gone = preprocess.kept_rows(flagged), preprocess.removed_rows(flagged)
    assert kept.count() + gone.count() == len(ROWS)
    assert {(r.stage, r.rows) for r in audit.step_counts(gone).groupBy("stage").agg(F.sum("rows").alias("rows")).collect()} == {
        ("required", 3), ("length", 2), ("duplicate", 1), ("score", 2)}


def test_length_bounds_are_inclusive_and_null_means_none(spark):
    df = spark.createDataFrame([(i, "t", " ".join(["w"] * n), 1.0) for i, n in enumerate([1, 2, 3, 4, 5])], SCHEMA)
    cfg = plan(length_filter=True, min_doc_length=3, max_doc_length=5)  # the title is one word
    assert reasons(preprocess.flag_rows(df, cfg)) == {0: "too_short", 1: None, 2: None, 3: None, 4: "too_long"}
    assert set(reasons(preprocess.flag_rows(df, plan(length_filter=True, max_doc_length=None))).values()) == {None}


def test_null_token(spark):
    df = spark.createDataFrame([(1, None, "x", 1.0)], SCHEMA)
    assert preprocess.flag_rows(df, plan()).first().docs == "x"
    parity = Preprocessing(DataSource(("title", "text"), "id", ("text",), "nan"), Cleaning())
    assert preprocess.flag_rows(df, parity).first().docs == "nan x"


def test_partition_order_does_not_matter(spark):
    df = spark.createDataFrame(ROWS * 1, SCHEMA)
    cfg = plan(duplicate_removal=True)
    want = reasons(preprocess.flag_rows(df, cfg))
    for n in (1, 7):
        assert reasons(preprocess.flag_rows(df.repartition(n).orderBy(F.desc("id")), cfg)) == want


def test_write_flagged(spark, tmp_path):
    flagged = preprocess.flag_rows(spark.createDataFrame(ROWS, SCHEMA), plan(duplicate_removal=True))
    kept, gone = preprocess.write_flagged(flagged, str(tmp_path / "out"))
    assert {r.id for r in gone.collect()} == {2, 4, 5, 6} and kept.count() == 5 and "reason" not in kept.columns


def test_config_from_nested_dictionary():
    cfg = Preprocessing.from_dict({
        "paths": {}, "data_source": {"text_source_columns": ["title", "abstract"], "unique_id_column": "corpusId",
                                     "required_columns_for_docs_creation": ["abstract"], "data_type_specific_df_processing": None},
        "preprocessing": {"cleaning": {"apply_unescape": True}, "filters": {"apply_length_filter": True, "min_doc_length": 50}}})
    assert cfg.cleaning.unescape and cfg.filters.length_filter and cfg.source.unique_id_column == "corpusId"


def test_copies_with_a_hot_text(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"t{i // 2}") for i in range(600)]
    df = spark.createDataFrame(rows, "id long, text string")
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert {r.id for r in dedupe.dedupe_first(df, "text", ["id"]).collect()} == set(first.values())
    kept, gone = dedupe.split_repeated(df, "text", "id", 2)
    assert {r.id for r in gone.collect()} == {i for i, t in rows if t == "hot"} and kept.count() == 400
    assert {r.copies for r in gone.collect()} == {200}


def test_repeats_keep_pairs_and_nulls_are_equal(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "b"), (6, None), (7, None)], "id long, text string")
    kept, gone = dedupe.split_repeated(df, "text", "id", 2)
    assert sorted(r.id for r in gone.collect()) == [3, 4, 5] and kept.count() == 4
    assert dedupe.dedupe_first(df, "text", ["id"]).count() == 3


def test_trimmed_has_a_reason_for_null_scores(spark):
    df = spark.createDataFrame([(1, 1.0, "long enough text"), (2, None, "long enough text"), (3, 9.0, "short"), (4, 9.0, "long enough text")], "id long, score double, text string")
    got = {r.id: r.reason for r in audit.trimmed_rows(df, "score", 5, "text", 10).collect()}
    assert got == {1: "score_below", 2: "score_null", 3: "too_short"}


def test_filters_that_do_nothing_or_raise(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "id long, score double")
    assert filters.score_range(df, None, 1).count() == 2 and filters.score_range(df, "score").count() == 2
    assert filters.score_range(df, "score", 1).count() == 1
    with pytest.raises(ValueError):
        filters.metadata_filter(df, [("score", "~", 1)])
    with pytest.raises(ValueError):
        filters.metadata_filter(df, [("nope", "==", 1)])
    many = list(range(1500))
    rows = spark.createDataFrame([(i, i % 2000) for i in range(4000)], "doc_id long, topic int")
    assert filters.topic_members(rows, many).count() == 3000
    named = rows.withColumn("topic", F.concat(F.lit("t"), "topic"))
    assert filters.topic_members(named, [f"t{i}" for i in range(1001)]).count() == 2002
    assert filters.topic_members(named, ["t1", "t1", "none"]).count() == 2 and filters.topic_members(named, []).count() == 0


def test_units(spark):
    df = spark.createDataFrame([(7, "Dr. Who came.  He left! Why? e.g. this.\n\n\n \nNext part"), (8, ""), (9, None)], "id long, text string")
    got = [(r.doc_id, r.unit_id, r.text) for r in units.sentence_units(df, "id", "text").collect()]
    assert got == [("7", 0, "Dr. Who came."), ("7", 1, "He left!"), ("7", 2, "Why?"), ("7", 3, "e.g. this."), ("7", 4, "Next part")]
    assert [r.text for r in units.paragraph_units(df, "id", "text").collect()] == ["Dr. Who came.  He left! Why? e.g. this.", "Next part"]
    assert units.text_units(df, "id", "text").count() == 3
    with pytest.raises(ValueError):
        units.text_units(df, "id", "text", "chapter")


def test_salted_join_equals_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(900)], "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k999", 3)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(tuple, joins.salted_join(left, right, ["k"], how, ["id"]).select("id").collect()))
        assert a == sorted(map(tuple, left.join(right, "k", how).select("id").collect()))
    with pytest.raises(ValueError):
        joins.salted_join(left, right, ["k"], "full")


def test_positional_join(spark):
    a = spark.createDataFrame([(5, "a"), (9, "b"), (7, "c")], "i long, x string")
    b = spark.createDataFrame([(1, "p"), (2, "q"), (3, "r")], "j long, y string")
    assert sorted((r.x, r.y) for r in joins.side_by_side(a, b, "i", "j").collect()) == [("a", "p"), ("b", "r"), ("c", "q")]
    with pytest.raises(ValueError):
        joins.side_by_side(a, b.limit(2), "i", "j")


def test_complete_vectors_are_required(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    joins.require_complete(docs, docs, "doc_id")
    with pytest.raises(ValueError, match="1 documents without"):
        joins.require_complete(docs, docs.filter("doc_id = 1"), "doc_id")


def test_row_numbers_halves_and_samples(spark):
    df = spark.range(0, 2001, 2, 9).withColumnRenamed("id", "k").withColumn("g", F.when(F.col("k") < 1500, 0).otherwise(1))
    numbered = sampling.with_row_number(df, "k", "n", 1)
    assert numbered.filter("n != k / 2 + 1").count() == 0 and numbered.count() == 1001
    a, b = sampling.split_halves(df, "k")
    assert (a.count(), b.count()) == (500, 501) and a.agg(F.max("k")).first()[0] < b.agg(F.min("k")).first()[0]
    s = sampling.sample_per_group(df, "g", "k", 200)
    assert {r.g: r["count"] for r in s.groupBy("g").count().collect()} == {0: 200, 1: 200}
    again = sampling.sample_per_group(df.repartition(3), "g", "k", 200)
    assert {r.k for r in s.collect()} == {r.k for r in again.collect()}
    assert {r.k for r in s.collect()} != {r.k for r in sampling.sample_per_group(df, "g", "k", 200, seed=1).collect()}


def test_top_n_is_trimmed_before_the_shuffle(spark):
    df = spark.range(100).withColumn("g", F.col("id") % 2)
    text = sampling.top_n(df, "g", [F.desc("id")], 3)._jdf.queryExecution().executedPlan().toString()
    assert text.count("WindowGroupLimit") == 2


def test_histogram_of_equal_values(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id long, v double")
    assert [(r.bin, r["count"]) for r in audit.histogram(df, "v").collect()] == [(0, 2)]
