"""The registered queries at the smallest tables: against their SQL, or against plain Python; and the pipeline stage by stage."""

import os
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import compare
import corpus_pipeline
import pytest
from test_llm_text import brute_overlaps
from topicloom.llm import queries
from topicloom.session import materialize

FOLDER = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def rows_of(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    got = compare.spark_result(queries.QUERIES[name](spark, FOLDER))
    assert compare.difference(got, compare.duck_result(compare.duck(FOLDER), queries.ORACLES[name])) is None


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_sizes_and_shards(spark):
    docs = rows_of(spark, "documents")
    taken = queries.QUERIES["op2_mixing"](spark, FOLDER).collect()
    assert Counter((r.doc_id, r.size) for r in taken) == Counter((d.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))) for d in docs)
    assert abs(sum(r.taken for r in taken) - sum(r.size for r in taken)) <= len({d.source for d in docs})
    placed = queries.QUERIES["op3_sharding"](spark, FOLDER).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in placed) == Counter((d.doc_id, len((d.text or "").encode()) + 16, zlib.crc32((d.text or "").encode())) for d in docs)
    assert all(0 <= r.shard < 40 and r.law == "bytes" and r.grown_shard is None for r in placed)


def jaccard_classes(docs):
    """Smallest id of each class by plain five-word shingles, links of 0.85 and up, and pairs that must stay apart."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    sets, where = {}, defaultdict(list)
    for d in docs:
        w = word.findall((d.text or "").lower())
        sets[d.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        for s in sets[d.doc_id]:
            where[s].append(d.doc_id)
    shared = Counter((a, b) for ids in where.values() for a in ids for b in ids if a < b)
    return {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items()}


def test_near_duplicates_of_documents(spark):
    docs = rows_of(spark, "documents")
    found = {r.doc_id: r.class_id for r in queries.QUERIES["op5_neardup"](spark, FOLDER).collect()}
    assert set(found) == {d.doc_id for d in docs}
    for (a, b), j in jaccard_classes(docs).items():
        if j >= 0.85:
            assert found[a] == found[b]


def test_quality_of_held_out(spark):
    labels = {r.doc_id: r.quality for r in rows_of(spark, "labels")}
    rows = queries.QUERIES["op8_quality"](spark, FOLDER).collect()
    assert len(rows) == len(rows_of(spark, "documents"))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in held) >= 0.85 * len(held)


def test_recall_of_neighbours(spark):
    from test_llm_files import brute_nearest

    rows = [(r.vec_id, r.embedding) for r in rows_of(spark, "embeddings")]
    expected = brute_nearest(rows, 5)
    got = defaultdict(set)
    for r in queries.QUERIES["op9_ann"](spark, FOLDER).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len(got[q] & {j for _, j in found}) for q, found in expected.items()) >= 0.9 * sum(map(len, expected.values()))


def test_archives_and_texts_of_pages(spark):
    from test_llm_files import brute_records

    pages = rows_of(spark, "pages")
    got = queries.QUERIES["op6_warc"](spark, FOLDER).collect()
    assert Counter(map(tuple, got)) == brute_records([(p.page_id, p.url, p.html) for p in pages])
    texts = {r.page_id: r.text for r in queries.QUERIES["op10_html"](spark, FOLDER).collect()}
    for p in pages:
        assert texts[p.page_id].split() == article_words(p.html)


def article_words(source):
    """The words of the article element, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.parts = 0, []

        def handle_starttag(self, tag, attrs):
            self.depth += tag == "article"
            self.parts.append(" ")

        def handle_endtag(self, tag):
            self.depth -= tag == "article"
            self.parts.append(" ")

        def handle_data(self, data):
            if self.depth:
                self.parts.append(data)

    reader = Reader()
    reader.feed(source)
    reader.close()
    return "".join(reader.parts).split()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    bench = [(b.item_id, b.text) for b in rows_of(spark, "benchmark")]
    labels = {r.doc_id: r.quality for r in rows_of(spark, "labels")}
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], FOLDER)))
    before, good, distinct, clean, mixed, shards = ([r for r in d.collect()] for d in kept)
    assert all(d.columns == docs.columns for d in kept[:-1])
    ids = lambda rows: {r.doc_id for r in rows}
    assert all(labels[i] == 0 for i in labels if i not in ids(good)) and ids(good) < ids(before)
    near = jaccard_classes(good)
    assert not [p for p, j in near.items() if j >= 0.85 and set(p) <= ids(distinct)]
    gone = ids(good) - ids(distinct)
    assert gone and all(any(j >= 0.7 and x in p for p, j in near.items()) for x in gone)
    hit = {r[0] for r in brute_overlaps([(r.doc_id, r.text) for r in distinct], bench) if r[4]}
    assert ids(clean) == ids(distinct) - hit
    assert ids(mixed) <= ids(clean) and max(Counter(r.doc_id for r in mixed).values()) <= 3
    assert Counter(r.doc_id for r in shards) == Counter(r.doc_id for r in mixed)
    assert Counter(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == Counter(map(tuple, shards))
