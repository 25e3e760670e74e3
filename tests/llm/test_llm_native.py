"""Mixing, sharding, chat formatting and URL filters on small tables, against plain Python."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from topicloom.llm import chat, mixing, sharding, urls

DOC = "doc_id long, text string, source string, size int, shard string, _hash int"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with columns whose names clash with computed ones."""
    return spark.createDataFrame([(*r, 7, "x", 1) for r in rows], DOC)


ROWS = (
    [(i, " ".join(["word"] * (i % 17 + 1)), f"s{i % 4}") for i in range(80)]
    + [(100, None, "s0"), (101, "", "s1"), (102, " \t\n", None), (103, "a b c", None), (None, "no id here", "s2")]
    + [(200, "same row twice", "s3")] * 2
    + [(300, "w " * 3000, "big"), (301, "é\u00a0ü x", "Ünïcode")]
)


def words(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water(sizes, cap=3):
    """Targets by repeated resharing; sizes by source."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        unit = (total - sum(fixed.values())) / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * unit > cap * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * unit for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_meets_targets_and_caps(spark):
    mix = mixing.mix(docs(spark, ROWS), block_words=16, shard_blocks=8)
    got = mix.taken.collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, words(t)) for i, t, _ in ROWS)
    sizes = defaultdict(int)
    for _, t, s in ROWS:
        sizes[s] += words(t)
    expected = water(sizes)
    source_of = {(i, words(t)): s for i, t, s in ROWS}
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(expected[s])
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, target in expected.items():
        assert abs(taken[s] - target) <= 1
    again = mixing.mix(docs(spark, ROWS[::-1]).repartition(7), block_words=16, shard_blocks=8).taken.collect()
    assert Counter((r.doc_id, r.size, r.taken) for r in again) == Counter((r.doc_id, r.size, r.taken) for r in got)


def test_mix_plan_fills_shards(spark):
    mix = mixing.mix(docs(spark, ROWS), block_words=16, shard_blocks=8)
    slots = mix.slots.collect()
    places = sorted(r.out_shard * 8 + r.out_slot for r in slots)
    assert places == list(range(len(slots)))
    counts = mixing.shard_counts(mix.slots).collect()
    assert sum(r.blocks for r in counts) == len(slots)
    passes = Counter((r["rank"], r.block) for r in slots)
    assert max(passes.values()) <= 3


@pytest.mark.parametrize("n", [1, 2, 7, 64, 1001])
def test_permutation(spark, n):
    from pyspark.sql import functions as F

    rows = spark.range(n).select("id", mixing.permuted(F.col("id"), F.lit(n), F.lit(5).cast("long")).alias("p"))
    back = rows.select("id", "p", mixing.permuted(F.col("p"), F.lit(n), F.lit(5).cast("long"), forward=False).alias("b")).collect()
    assert sorted(r.p for r in back) == list(range(n)) and all(r.b == r.id for r in back)


def test_mix_empty(spark):
    assert mixing.mix(docs(spark, [])).taken.collect() == []
    assert [(r.doc_id, r.taken) for r in mixing.mix(docs(spark, [(1, None, None)])).taken.collect()] == [(1, 0)]
    assert mixing.repeated(docs(spark, [])).columns == docs(spark, []).columns


CLASHING = ["_key", "_id", "_own", "_maybe", "_times", "_score", "score", "_copy", "_word", "_bits", "_whole", "_row", "label", "content", "class", "_label"]


def test_columns_with_names_of_our_own_stay(spark, tmp_path):
    import corpus_pipeline
    from topicloom.llm import decontam, neardup, quality

    rows = [(i, f"some words number {i} " * 9, f"s{i % 3}") for i in range(30)] + [(50, "some words number 3 " * 9, "s0"), (51, None, None)]
    frame = docs(spark, rows).selectExpr("doc_id", "text", "source", *[f"concat('{c}', doc_id) AS {c}" for c in CLASHING])
    bench = spark.createDataFrame([(1, "number 7 some words number 7 some words number 7")], "item_id long, text string")
    spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for kept in (
        corpus_pipeline.good(spark, frame, str(tmp_path)), neardup.first_of_each(frame), decontam.clean(frame, bench), mixing.repeated(frame),
        quality.score(frame, quality.fit(np.zeros((0, len(quality.NAMES))), np.zeros(0)), "p").drop("p"),
    ):
        assert kept.columns == frame.columns
        found = kept.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in CLASHING)


def test_repeated_documents(spark):
    got = mixing.repeated(docs(spark, ROWS), block_words=16)
    assert got.columns == docs(spark, []).columns
    times = Counter(r.doc_id for r in got.collect())
    assert times[102] == 1 and max(v for k, v in times.items() if k != 200) <= 3


@pytest.mark.parametrize("rows", [ROWS, [(1, "only", "s")], [(5, "same", "s")] * 500, [(i, "copy of one text", "s") for i in range(400)]])
def test_shards_of_bytes(spark, rows):
    got = sharding.shard(docs(spark, rows), shards=5, ranges=16, sample=64).collect()
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for k in range(5):
        assert abs(sum(r.size for r in by[k]) - total / 5) <= largest


def test_shards_empty(spark):
    assert sharding.shard(docs(spark, [])).collect() == []


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "hello"), (1, 3, "ann", None), (1, 3, "bob", "tie"),
    (2, 0, None, "who"), (2, None, "cat", "late"), (2, 1, "", "unnamed"), (None, 0, "dan", "lost"), (3, 0, "system", "alone"),
    (4, 0, "ann", "x" * 50_000), (4, 1, "bob", "twice"), (4, 1, "bob", "twice"), (5, 3000, "eve", "far"), (5, 2, "eve", "near"),
]


def brute_chat(turns):
    groups, people = defaultdict(list), defaultdict(set)
    for conv, turn, role, text in turns:
        groups[conv, None if turn is None else turn // 1024].append((turn is None, turn or 0, role or "", text or ""))
        if role not in (None, "", "system"):
            people[conv].add(role)
    out = set()
    for (conv, segment), items in groups.items():
        for who in people[conv]:
            text, spans = "", []
            for *_, role, body in sorted(items):
                name = "assistant" if role == who else "system" if role == "system" else f"user name={role}" if role else "user"
                text += f"<|im_start|>{name}\n"
                if role == who:
                    spans.append((len(text), len(text) + len(body)))
                text += f"{body}<|im_end|>\n"
            out.add((conv, segment, who, len(items), text, tuple(spans)))
    return out


def test_chat_rotates(spark):
    rows = spark.createDataFrame([(*t, "extra", 1) for t in TURNS], "conv_id long, turn long, role string, text string, participant string, part int")
    got = chat.rotate(rows).collect()
    assert {(r.conv_id, r.segment, r.participant, r.n_turns, r.text, tuple((s.start, s.end) for s in r.spans)) for r in got} == brute_chat(TURNS)
    assert len(got) == len(brute_chat(TURNS))
    assert chat.rotate(rows.limit(0)).collect() == []


def test_chat_spreads_crowded_turns(spark):
    rows = spark.createDataFrame([(1, 0, "ann", f"t{i}") for i in range(300)], "conv_id long, turn long, role string, text string")
    got = chat.rotate(rows, segment_rows=64).collect()
    assert len(got) == 5 and [r.n_turns for r in sorted(got, key=lambda r: r.part)] == [64, 64, 64, 64, 44]
    assert Counter(t for r in got for t in r.text.split("\n") if t.startswith("t")) == Counter(f"t{i}<|im_end|>" for i in range(300))


def test_parts_joined_are_the_dialogue(spark):
    turns = [(1, i // 7, f"p{i % 3}", f"text {i * 37 % 911}") for i in range(1500)] + [(1, None, "p1", "again")] * 700 + [(2, 1, "ann", "alone")]
    rows = spark.createDataFrame([turns[i * 1009 % len(turns)] for i in range(len(turns))], "conv_id long, turn long, role string, text string").repartition(5)
    parts = defaultdict(list)
    for r in chat.rotate(rows, segment_rows=128).collect():
        assert r.n_turns <= 128
        assert all(r.text[s.start : s.end].startswith(("text", "again", "alone")) and r.text[: s.start].endswith("assistant\n") for s in r.spans)
        parts[r.conv_id, r.segment, r.participant].append((r.part, r.text))
    joined = {(*k, "".join(t for _, t in sorted(v))) for k, v in parts.items()}
    assert joined == {(c, s, who, text) for c, s, who, _, text, _ in brute_chat(turns)}
    assert all(sorted(p for p, _ in v) == list(range(len(v))) for v in parts.values())


RULES = [("net", "/", "block"), ("Example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block"), (None, "/", "block"), ("both.de", "/", "allow"), ("both.de", "/", "block")]
URLS = ["http://a.net", "http://a.net/", "https://EXAMPLE.net/en/x?y#z", "http://x.example.net/en/", "http://example.net/de", "http://example.com/de/a", "http://notexample.com/de/a",
        "ftp://b.org/fr/", "http://b.org/frx", None, "", "no scheme", "://", "http://net/", "http://net?q=/", "http://a.b.c.d.e.net//", "http://both.de/x", "http://" + "a." * 3000 + "net/" + "p" * 9000, "x://example.net/en/#://"]


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best, verdict = None, "allow"
    for h, p, v in RULES:
        h = h and h.lower()
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            if best is None or (h.count("."), len(p)) > (best[0].count("."), len(best[1])) or (h, p) == best and v == "block":
                best, verdict = (h, p), v
    return host, path, best and "".join(best), verdict


def test_urls(spark):
    rows = spark.createDataFrame([(i, u, "r", "v") for i, u in enumerate(URLS * 2)], "page_id long, url string, rule string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(rows, rules).collect()}
    assert got == {i: brute_url(u) for i, u in enumerate(URLS * 2)}
    assert urls.judge(rows.limit(0), rules).collect() == []
    assert {r.verdict for r in urls.judge(rows, rules.limit(0)).collect()} == {"allow"}


def test_a_list_too_large_raises(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(urls, "MAX_BITS", 256)
    corpus = spark.range(3000).select(F.array(F.concat(F.lit("k"), "id")).alias("_keys"))
    with pytest.raises(ValueError, match="keys need a filter"):
        urls.Cascade(spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key")), corpus, "_keys")


def test_levels_that_pass_too_many_are_built_again(spark):
    from pyspark.sql import functions as F

    corpus = spark.range(3000).select(F.array(F.concat(F.lit("k"), "id")).alias("_keys"), "id")
    cascade = urls.Cascade(spark.range(1000).select(F.concat(F.lit("k"), "id").alias("key")), corpus, "_keys", bits_per_key=0.2)
    assert len(cascade.levels) < 14 and max(level.bits for level in cascade.levels[1:]) >= 1024
    found = cascade.attach(corpus, "_w").filter(cascade.contains("_w", F.element_at("_keys", 1))).select("id").collect()
    assert sorted(r.id for r in found) == list(range(1000))


def test_cascade_is_exact_for_many_keys(spark):
    from pyspark.sql import functions as F

    corpus = spark.range(5000).select(F.array(F.concat(F.lit("k"), "id")).alias("_keys"), "id")
    listed = spark.range(0, 5000, 7).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urls.Cascade(listed, corpus, "_keys", bits_per_key=2.0)
    assert len(cascade.levels) > 2
    found = cascade.attach(corpus, "_w").filter(cascade.contains("_w", F.element_at("_keys", 1))).select("id").collect()
    assert sorted(r.id for r in found) == list(range(0, 5000, 7))
