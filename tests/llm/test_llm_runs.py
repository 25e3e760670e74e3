"""Periodic runs, token id files and hard negatives on small tables, against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from topicloom.llm import hardneg, periodic, tokenids

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=24, repeats=3):
    """All runs by trying every period."""
    n, out = len(words), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, repeats * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def looped_words(doc_id, words):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n or doc_id is None:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def random_text(rng):
    out = []
    for _ in range(rng.randrange(1, 8)):
        kind = rng.random()
        if kind < 0.5:
            unit = [rng.choice("abcd") for _ in range(rng.randrange(1, 14))]
            out += (unit * rng.randrange(1, 12))[: rng.randrange(1, 60)]
        elif kind < 0.8:
            out += [rng.choice("ab") for _ in range(rng.randrange(1, 40))]
        else:
            out += [f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 60))]
    return out


@pytest.mark.parametrize("least, repeats", [(24, 3), (6, 3), (10, 4)])
def test_runs_equal_all_periods(least, repeats):
    rng = random.Random(least)
    texts = [random_text(rng) for _ in range(150)] + [[], ["x"] * 100, ["x", "y"] * 60 + ["x"], list("abc" * 40 + "abd" * 40)]
    words, counts = periodic.split_words([" ".join(t).encode() for t in texts])
    found = periodic.find_runs(words.dictionary_encode().indices.to_numpy(), counts, least, repeats)
    by_doc = defaultdict(list)
    for d, s, n, p in found.tolist():
        by_doc[d].append((s, n, p))
    for d, t in enumerate(texts):
        assert by_doc[d] == brute_runs(t, least, repeats)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\té \x1c", max_size=120), max_size=6))
def test_runs_of_any_text(texts):
    words, counts = periodic.split_words([t.encode() for t in texts])
    assert [w.decode() for w in words.to_pylist()] == [w for t in texts for w in WORD.findall(t)]
    assert counts.tolist() == [len(WORD.findall(t)) for t in texts]
    found = periodic.find_runs(words.dictionary_encode().indices.to_numpy(), counts, 4, 3)
    assert [tuple(r[1:]) for r in found.tolist()] == [r for t in texts for r in brute_runs(WORD.findall(t), 4)]


DOC = "doc_id long, text string, runs int, collapsed string, word int"


def test_runs_of_documents(spark):
    rng = random.Random(5)
    texts = [(i, " \n".join(random_text(rng))) for i in range(60)] + [(100, None), (101, ""), (102, " \t"), (None, "a b " * 20), (103, "é ü " * 30)]
    texts += [(104, "same " * 40)] * 2 + [(105, "long " + "u v w x y z " * 40_000)]
    frame = spark.createDataFrame([(*t, 1, "x", 2) for t in texts], DOC).repartition(3)
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic.runs(frame).collect())
    short = [(i, WORD.findall(t or "")) for i, t in texts if i != 105]
    expected = Counter((i, len(w), tuple(brute_runs(w)), brute_collapsed(w, brute_runs(w))) for i, w in short)
    expected[(105, 240_001, ((1, 240_000, 6),), "long u v w x y z")] += 1
    assert got == expected
    assert periodic.runs(frame.limit(0)).collect() == []


def brute_run_row(doc_id, text):
    words = looped_words(doc_id, WORD.findall(text or ""))
    runs = brute_runs(words)
    s, n, p = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, sha(listed), sha(brute_collapsed(words, runs))


def test_query_of_runs(spark, tmp_path):
    from topicloom.llm import queries

    rng = random.Random(9)
    texts = [(i, " ".join(random_text(rng)) if i % 3 else " ".join(f"w{rng.randrange(99)}" for _ in range(i))) for i in range(300)] + [(300, None), (None, "x " * 30), (301, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_run_row(*t) for t in texts)


# token ids


def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.text(" \n\tabZ.,'9é 　日ß!<|>s", max_size=80)), max_size=8))
def test_pieces_encode_like_whole_texts(texts):
    texts += ["don't, 's.it's\n\n x\ny ", " a,b <|endoftext|> c.d"][: len(texts) % 3]
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    model, in_pieces = tokenids.tokenizer(tokenizer_path())
    ids, counts = tokenids.encode([t.encode() for t in texts], tokenizer_path())
    whole = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert in_pieces and counts.tolist() == [len(w) for w in whole] and ids.tolist() == [x for w in whole for x in w]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70), st.integers(0, 50_000), st.integers(0, 2**32 - 1)), min_size=1, max_size=400), st.sampled_from([0.1, 0.5, 0.95, 1.0]))
def test_blocks_round_trip(values, percentile):
    ids = np.array(values, np.uint32)
    blocks = tokenids.encode_blocks(np.stack([ids, ids[::-1]]), percentile)
    assert tokenids.decode_blocks(b"".join(blocks)).tolist() == values + values[::-1]
    head = tokenids.HEAD.unpack_from(blocks[0])
    assert tokenids.block_length(head) == len(blocks[0]) and head[4] <= (1 - percentile) * len(values) + 1


TEXTS = [(i, f"Some words of document {i}, " * (i % 40)) for i in range(-20, 120)] + [(500, None), (501, ""), (None, "no id"), (None, "no id"), (502, "same"), (502, "other")]
TEXTS += [(503, "日本語 é  text\n\n  spaces   <|im_end|> " * 20_000)]


def brute_tokens(texts):
    model, _ = tokenids.tokenizer(tokenizer_path())
    return Counter((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids) for i, ids in ((i, (*model.encode(t or "", add_special_tokens=False).ids, 2)) for i, t in texts))


@pytest.mark.parametrize("file_docs, part_bytes", [(1 << 20, 32 << 20), (30, 2000)])
def test_token_files_round_trip(spark, tmp_path, file_docs, part_bytes):
    frame = spark.createDataFrame([(*t, 1, "x") for t in TEXTS], "doc_id long, text string, _part int, file string").repartition(4)
    files = tokenids.write(frame, f"file://{tmp_path}", tokenizer_path(), file_docs=file_docs, part_bytes=part_bytes)
    rows = tokenids.read(files).collect()
    number = lambda x: None if x is None else int(x)
    assert Counter((number(r.doc_id), r.n_tokens, r.ids_crc32, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == brute_tokens(TEXTS)
    rows = sorted(rows, key=lambda r: r.start)
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    ids = [number(r.doc_id) for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert files.filter("n_docs > 30").count() == 0 or file_docs > 30
    for f in files.collect():
        part = np.concatenate([np.frombuffer(r.ids, "<u4") for r in rows if f.first_id <= r.start < f.first_id + f.n_ids])
        for a, b in ((0, 5), (1000, 1030), (f.n_ids - 3, f.n_ids + 9), (7, 7), (0, f.n_ids)):
            assert tokenids.read_slice(f.file, a, b).tolist() == part[max(a, 0) : b].tolist()


def test_no_documents_no_files(spark, tmp_path):
    files = tokenids.write(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}", tokenizer_path())
    assert files.count() == 0 and tokenids.read(files).collect() == []


def test_a_damaged_index_raises(tmp_path):
    writer = tokenids.Writer(f"file://{tmp_path}", 0.95)
    writer.add(np.arange(5000, dtype=np.uint32), np.array([4000, 1000]), [b"1", None])
    file, n_docs, n_ids, size = writer.close()
    path = file.removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    assert (n_docs, n_ids, size) == (2, 5000, len(raw)) and raw[:8] == tokenids.MAGIC
    raw[-tokenids.TRAILER.size - 3] ^= 1
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        tokenids.Reader(file)


# hard negatives


def brute_negatives(rows, positives=5, negatives=3, least=50, most=95):
    """rows of (id, label, v) that take part, each once."""
    out = []
    for i, label, v in rows:
        if i % 50:
            continue
        score = {(j, lab, w): sum(a * b for a, b in zip(v, w)) for j, lab, w in rows if j != i and len(w) == len(v)}
        order = sorted(score, key=lambda r: (-score[r], r[0]))
        for p in [r for r in order if r[1] == label][:positives]:
            hard = [r for r in order if r[1] != label and least * score[p] <= 100 * score[r] <= most * score[p]][:negatives]
            out += [(i, p[0], k + 1, r[0], score[p], score[r]) for k, r in enumerate(hard)]
    return Counter(out)


def clusters(n, dim, seed, wide=40):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (6, dim))
    v = centres[rng.integers(0, 6, n)] + rng.integers(-wide, wide + 1, (n, dim))
    return [(i, int(x), tuple(map(int, w))) for i, (x, w) in enumerate(zip(rng.integers(0, 4, n), v))]


@pytest.mark.parametrize("codewords, block, first", [(8, 8192, 8192), (4, 64, 1), (1, 10, 50)])
def test_negatives_equal_all_products(spark, codewords, block, first):
    rows = clusters(600, 8, codewords) + [(1000 + i, i % 3, (5, -3, 7)) for i in range(60)] + [(2000, 1, ()), (2050, 1, ())]
    more = [(3000, None, [1] * 8), (3050, 1, None), (3051, 1, [1, None] * 4), (3052, 1, [float("nan")] * 8), (None, 1, [9] * 8)] + [rows[50], rows[7]]
    frame = spark.createDataFrame([(i, lab, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, lab, v in rows + more], "id long, label int, v array<double>, anchor int, c1 int")
    got = hardneg.mine(frame, hardneg.F.col("id") % 50 == 0, codewords=codewords, block=block, first=first).collect()
    assert Counter(map(tuple, got)) == brute_negatives(rows)


def test_large_components_are_exact(spark):
    rows = [(i, lab, tuple(x * 2**19 + i % 3 for x in v)) for i, lab, v in clusters(120, 4, 3, 3)]
    frame = spark.createDataFrame([(i, lab, list(v)) for i, lab, v in rows], "id long, label int, v array<long>")
    assert Counter(map(tuple, hardneg.mine(frame, hardneg.F.col("id") % 50 == 0).collect())) == brute_negatives(rows)


def test_certified_searches_skip_cells():
    rows = clusters(3000, 16, 1, wide=5)
    x = np.array([r[2] for r in rows], np.float64)
    books = tuple(hardneg.half_codebook(h, 6, i) for i, h in enumerate(hardneg.halves(x)))
    places = [hardneg.nearest_centre(h, b) for h, b in zip(hardneg.halves(x), books)]
    radii = tuple(np.array([p[1][p[0] == c].max(initial=0) for c in range(len(b))]) for p, b in zip(places, books))
    counts = np.zeros((len(books[0]), len(books[1])), np.int64)
    np.add.at(counts, (places[0][0], places[1][0]), 1)
    a = np.array(rows[0][2])
    best = np.sort(x @ a)[-6]
    cells = hardneg.visits(a, [(-hardneg.LARGEST, hardneg.LARGEST)], [int(best)], (books, radii, counts), 1)
    seen = sum(counts[c] for c in cells)
    assert seen < len(rows) / 2
    everywhere = hardneg.visits(a, [(-hardneg.LARGEST, hardneg.LARGEST)], [-hardneg.LARGEST], (books, radii, counts), 0)
    assert len(everywhere) == np.count_nonzero(counts)
    highs = [h for h, _, _ in hardneg.multi_sequence(np.array([3.0, 1.0, 2.0]), np.array([0.5, 7.0]))]
    assert highs == sorted(highs, reverse=True) and len(highs) == 6


def test_no_vectors_no_negatives(spark):
    assert hardneg.mine(spark.createDataFrame([], "id long, label int, v array<double>"), hardneg.F.col("id") % 50 == 0).collect() == []
