"""CSV rules, folders, stage tables, run records, streams."""

import pytest
from pyspark.sql import functions as F

from topicloom import streaming
from topicloom.config import Cleaning
from topicloom.plans import preprocess
from topicloom.sources import files, store


def put(path, text, encoding="utf-8"):
    path.write_bytes(text if isinstance(text, bytes) else text.encode(encoding))
    return str(path)


def test_cells(spark, tmp_path):
    p = put(tmp_path / "a.csv", b'id,body,score\n1,"two\nlines, ""q""",3\n2,None,x\n3,NA,\n4,nan,1.5\n5,,2\n6,bad\xffbyte,7\n7,null,8\n')
    rows = {r.id: r for r in files.read_csv(spark, p, files.TYPES).collect()}
    assert rows["1"].body == 'two\nlines, "q"' and rows["1"].score == 3.0
    assert all(rows[i].body is None for i in "23457") and rows["2"].score is None and rows["3"].score is None
    assert rows["6"].body == "badbyte"


def test_header_order_may_differ(spark, tmp_path):
    a, b = put(tmp_path / "a.csv", "id,body,score\n1,x,7\n"), put(tmp_path / "b.csv", "score,id,body,extra\n8,2,y,z\n")
    got = {(r.id, r.body, r.score) for r in files.read_csv(spark, [a, b], files.TYPES, ["id", "body", "score"]).collect()}
    assert got == {("1", "x", 7.0), ("2", "y", 8.0)}


def test_combine_folder(spark, tmp_path):
    put(tmp_path / "rpg_comments.csv", "id,link_id,author,created_utc,subreddit,body,score\nc1,l,a,10,rpg,hello,1\nc2,l,a,11,rpg,,2\n")
    put(tmp_path / "rpghorrorstories_submissions.csv", "id,permalink,author,created_utc,subreddit,title,selftext,score\ns1,p,a,12,h,T,body,3\ns2,p,a,13,h,T2,  ,4\n")
    put(tmp_path / "rpg_empty.csv", "")
    put(tmp_path / "rpg_blank_submissions.csv", "id,title,selftext\ns9,T,\n")
    put(tmp_path / "RPG_bad_comments.csv", "id,author\n1,2\n")
    put(tmp_path / "other.csv", "id,title,selftext\nq,T,x\n")
    put(tmp_path / "rpg.txt", "x")
    found = files.combine_folder(spark, str(tmp_path), ["rpg"])
    assert found.rows.columns == list(files.COMBINED_COLUMNS)
    assert {(r.id, r.text, r.link_id) for r in found.rows.collect()} == {("c1", "hello", "l"), ("c2", None, "l"), ("s1", "T body", None)}
    assert {(r.source_file, r.kind, r.status, r.rows) for r in found.manifest.collect()} == {
        ("rpg_comments.csv", "comment", "ok", 2), ("rpghorrorstories_submissions.csv", "submission", "ok", 1), ("rpg_empty.csv", "submission", "empty_file", 0),
        ("rpg_blank_submissions.csv", "submission", "no_valid_rows", 0), ("RPG_bad_comments.csv", "comment", "missing_column", 0)}
    titles = files.combine_folder(spark, str(tmp_path), ["rpg"], require_selftext=False)
    assert titles.rows.filter("id = 's2'").first().text == "T2"
    assert files.combine_folder(spark, str(tmp_path), ["nothing"]) is None


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, ' a "b", c\nd '), (2, None)], "id long, text string")
    files.write_csv(df, str(tmp_path / "out.csv"))
    found = [r.path for r in files.list_files(spark, str(tmp_path / "out.csv")).collect()]
    assert {(r.id, r.text) for r in files.read_csv(spark, found).collect()} == {("1", ' a "b", c\nd '), ("2", None)}


def test_duplicate_names(spark, tmp_path):
    for folder, size in (("a", 3), ("b", 9), ("c", 9)):
        (tmp_path / folder).mkdir()
        put(tmp_path / folder / "x.txt", "y" * size)
    put(tmp_path / "a" / "single.txt", "z")
    got = {(r.path.split("/")[-2], r.keep) for r in files.duplicate_names(files.inventory(spark, str(tmp_path), [".TXT"])).collect()}
    assert got == {("a", False), ("b", True), ("c", False)}


def test_inventory(spark, tmp_path):
    for name in ("a.txt", "b.TXT", "c.csv"):
        put(tmp_path / name, "y")
    found = files.inventory(spark, str(tmp_path), [".txt"])
    assert {"path", "name", "extension", "length"} <= set(found.columns)
    assert {(r.name, r.length) for r in found.collect()} >= {("a.txt", 1)} and "c.csv" not in {r.name for r in found.collect()}


def test_cached(spark, tmp_path):
    path, calls = str(tmp_path / "t"), []

    def compute(n):
        calls.append(n)
        return spark.range(n)

    assert store.cached(spark, path, lambda: compute(3)).count() == 3
    assert store.cached(spark, path, lambda: compute(4)).count() == 3
    assert store.cached(spark, path, lambda: compute(5), force=True).count() == 5 and calls == [3, 5]


def test_run_record_and_config(spark, tmp_path):
    path = str(tmp_path / "runs")
    store.record_run(spark, path, "a", {"k": 1})
    store.record_run(spark, path, "b", store.effective_config({"k": 1}, k=2))
    assert {(r.run_name, r.config) for r in spark.read.json(path).collect()} == {("a", '{"k": 1}'), ("b", '{"k": 2}')}
    with pytest.raises(ValueError):
        store.record_run(spark, path, "c", {}, format="ini")
    assert store.read_config(spark, put(tmp_path / "c.json", '{"a": {"b": 1}}')) == {"a": {"b": 1}}


def test_run_by_settings(spark, tmp_path):
    put(tmp_path / "raw.csv", 'title,selftext,score\nT,one two three,6\nT,one two three,9\nT,,9\nT,"four, five six",1\n,seven eight nine,5\n')
    config = {
        "paths": {"raw_data_file": str(tmp_path / "raw.csv"), "processed_data_output_file": str(tmp_path / "kept.csv"),
                  "dropped_rows_output_file": str(tmp_path / "gone.csv")},
        "data_source": {"text_source_columns": ["title", "selftext"], "unique_id_column": "id", "required_columns_for_docs_creation": ["selftext"]},
        "preprocessing": {"cleaning": {"apply_lowercase": True}, "filters": {
            "apply_length_filter": True, "min_doc_length": 3, "max_doc_length": None, "apply_duplicate_removal": True,
            "apply_score_filter": True, "score_column_for_filtering": "score", "min_score_for_filtering": 5}}}
    kept = preprocess.run(spark, config)
    assert sorted((r.id, r.docs, r.doc_len) for r in kept.collect()) == [(0, "t one two three", 4), (4, "seven eight nine", 3)]
    parts = [r.path for r in files.list_files(spark, str(tmp_path / "gone.csv")).collect()]
    assert {(r.id, r.reason) for r in files.read_csv(spark, parts).collect()} == {("1", "duplicate_text"), ("2", "missing_required"), ("3", "score_out_of_range")}
    assert (tmp_path / "kept.csv").exists()


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"Text <b>{i}</b> ") for i in range(20)] + [(99, "  ")], "id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    cfg = Cleaning(html_tag_removal=True, lowercase=True)
    streaming.write_stream(streaming.clean_stream(stream, "text", "docs", cfg), str(tmp_path / "out")).awaitTermination()
    got = {(r.id, r.docs) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(i, f"text {i}") for i in range(20)}
