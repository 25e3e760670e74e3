"""Archives, nearest neighbours and page texts on small tables, against plain Python."""

import base64
import hashlib
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest

from topicloom.llm import ann, html, warc

PAGES = (
    [(i, f"http://h{i % 3}.net/{i}", f"<html><body><p>page {i} {'text ' * (i % 9)}</p></body></html>") for i in range(40)]
    + [(100 + i, "http://copy.net/", "<p>the same payload</p>") for i in range(9)] + [(100, "http://copy.net/", "<p>the same payload</p>")]
    + [(200, None, None), (201, "", ""), (202, "x\r\ny", "line\r\n\r\nends\r\n"), (None, "u", "<p>no id</p>"), (None, "u", "<p>no id</p>")]
    + [(203, "u", "é" * 300_000), (None, "u", "<p>the same payload</p>"), (-5, "neg", "minus")]
)


def brute_records(pages, least=0):
    first, out = {}, []
    for i, _, h in pages:
        raw = (h or "").encode()
        if len(raw) >= least and i is not None:
            first[raw] = min(i, first.get(raw, i))
    for i, _, h in pages:
        raw = (h or "").encode()
        revisit = raw in first and i != first[raw] and len(raw) >= least
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first[raw] if revisit else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 10])
def test_archives_round_trip(spark, tmp_path, least):
    frame = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, archive int").repartition(3)
    archives = warc.write(frame, f"file://{tmp_path}", train_bytes=2000, archive_bytes=20_000, least_bytes=least)
    rows = warc.read(archives).collect()
    number = lambda x: None if x is None else int(x)
    assert Counter((number(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, number(r.refers_to)) for r in rows) == brute_records(PAGES, least)
    html_of = {i: (h or "").encode() for i, _, h in PAGES}
    assert all(bytes(r.payload) == html_of[number(r.page_id)] for r in rows if r.record_type == "response" and r.page_id is not None)
    assert sum(r.n_records for r in archives.collect()) == len(PAGES)
    assert {r.url for r in rows} >= {"x%0D%0Ay", None}


def test_archive_has_a_leading_dictionary(tmp_path):
    import zstandard

    writer = warc.Writer(f"file://{tmp_path}", 4096, 20_000, 3)
    records = [warc.record(str(i), "http://a.net/", f"<html><p>some text that all share, number {i}</p></html>".encode() * 4, None) for i in range(120)]
    for r in records:
        writer.add(r)
    name, n, size = writer.close()
    raw = (tmp_path / name).read_bytes()
    magic, length = struct.unpack("<II", raw[:8])
    assert (n, size, magic) == (120, len(raw), 0x184D2A5D)
    dictionary = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + length])
    assert struct.unpack("<I", dictionary[:4])[0] == 0xEC30A437
    with open(tmp_path / name, "rb") as f:
        assert list(warc.records_of(f)) == records
    with open(tmp_path / name, "rb") as f:
        cut = tmp_path / "cut"
        cut.write_bytes(f.read()[:-7])
    with pytest.raises(ValueError), open(cut, "rb") as f:
        list(warc.records_of(f))


def test_archives_of_nothing(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(frame, f"file://{tmp_path}")).collect() == []
    few = spark.createDataFrame([(1, "u", "h")], frame.schema)
    assert [r.record_type for r in warc.read(warc.write(few, f"file://{tmp_path}")).collect()] == ["response"]


def brute_nearest(vectors, k):
    rows = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            rows.setdefault((i, tuple(v)), np.array(v, float))
    out = defaultdict(list)
    for (i, _), v in rows.items():
        if i % 50 == 0:
            for (j, _), u in rows.items():
                if j != i and len(u) == len(v):
                    out[i].append((-float((u * v).sum() / (np.sqrt((u * u).sum()) * np.sqrt((v * v).sum()))), j))
    return {i: sorted(found)[:k] for i, found in out.items()}


def test_nearest(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(3)
    vectors = [(i, rng.standard_normal(16).round(3).tolist()) for i in range(900)]
    vectors += [(1000 + i, vectors[50][1]) for i in range(12)]  # ties
    vectors += [(2000 + i, (np.array(vectors[100][1]) * 2 + rng.standard_normal(16) * 0.01).tolist()) for i in range(8)]
    odd = [(3000, None), (3050, [0.0] * 16), (3100, [float("nan")] * 16), (3150, [None] * 16), (3200, [float("inf")] + [1.0] * 15), (None, vectors[0][1]), (3250, [1.0, 2.0]), (3300, []), (3350, [1.0, 2.1])]
    rows = vectors + odd + vectors[:60]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")
    got = defaultdict(list)
    for r in ann.nearest(frame, F.col("id") % 50 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    expected = brute_nearest(rows, 5)
    assert set(got) == set(expected)
    hits = total = 0
    for q, found in got.items():
        found.sort()
        assert [x[0] for x in found] == list(range(1, len(expected[q]) + 1))
        hits += len({x[1] for x in found} & {j for _, j in expected[q]})
        total += len(expected[q])
        scores = dict((j, -s) for s, j in brute_nearest(rows, 10**6)[q])
        assert all(s == pytest.approx(scores[j], abs=1e-12) for _, j, s in found)
    assert hits / total > 0.95
    assert [x[1] for x in got[50]] == [1000, 1001, 1002, 1003, 1004]
    assert {x[1] for x in got[100]} <= set(range(2000, 2008))
    assert got[3250] and got[3250][0][1] == 3350
    assert ann.nearest(frame.limit(0), F.col("id") % 50 == 0).collect() == []


CASES = {
    "plain   words": "plain words",
    "": "",
    "<nav>only a menu</nav>": "",
    "<body><article><h1>T &amp; U</h1><p>a&nbsp;&nbsp;b<p>c<br>d <b>e</b>f</article><footer>x</footer>": "T & U\na b\nc d ef",
    "<article><p>one</p><script>var a='</p>';</script><style>p{}</style><!-- <p>no</p> --><p>two</p></article>": "one\ntwo",
    "<body><header><h1>Site</h1></header><main><h1>Title</h1><form><p>join us</p></form><ul><li>a<li>b</ul><div class='comments'><p>hm</p></div></main>": "Title\na\nb",
    "<article><div class='share-bar'>s</div><p>x</p><aside>y</aside><section id='comment-list'><p>z</p></section></article>": "x",
    "<div class='wrap with-sidebar'><div class='left-sidebar'>s</div><article>kept</article></div>": "kept",
    "<p>cut off<div": "cut off",
    "<p>1 < 2</p><p title='a>b'>q</p>": "1 < 2\nq",
    "<article><table><tr><td>a<td>b<tr><td>c</table></article>": "a\nb\nc",
    "<article><p>x</p><p hidden>y</p><p style='display:none'>z</p></article>": "x",
    "<article>A<article class='comment'>B</article>C</article>": "A\nC",
}


@pytest.mark.parametrize("source", list(CASES))
def test_main_text(source):
    assert html.main_text(source) == CASES[source]


def test_density_finds_the_article_without_hints():
    links = "".join(f"<li><a href='/{i}'>some linked words {i}</a></li>" for i in range(30))
    body = "".join(f"<p>A paragraph with a good number of plain words in it, number {i}.</p>" for i in range(6))
    page = f"<body><div><ul>{links}</ul></div><div><h1>Head</h1><div>{body}</div></div><div><ul>{links}</ul></div></body>"
    got = html.main_text(page).split("\n")
    assert got == ["Head", *(f"A paragraph with a good number of plain words in it, number {i}." for i in range(6))]


def paragraphs(name, n=10, size=500):
    return [(f"{name}{i} " + "plain words " * size)[:size].strip() for i in range(n)]


@pytest.mark.parametrize("tags", [("main", "article"), ("div", "div"), ("main", "section"), ("div", "article")])
@pytest.mark.parametrize("second", [500, 300])
def test_density_chooses_on_every_page(tags, second):
    outer, inner = tags
    a, b = paragraphs("a"), paragraphs("b", 5, second)
    links = "".join(f"<li><a href='/{i}'>some linked words {i}</a></li>" for i in range(30))
    part = lambda texts: f"<{inner}>{''.join(f'<p>{x}</p>' for x in texts)}</{inner}>"
    text = f"<{outer}><h1>Head</h1>{part(a)}{part(b)}</{outer}>"
    assert html.main_text(f"<body>{text}</body>").split("\n") == ["Head", *a, *b]
    assert html.main_text(f"<body><nav>{links}</nav>{text}<div><ul>{links}</ul></div></body>").split("\n") == ["Head", *a, *b]


def test_a_small_article_does_not_hide_the_text_around_it():
    a = paragraphs("a")
    body = "".join(f"<p>{x}</p>" for x in a)
    for tag in ("article", "div"):
        assert html.main_text(f"<body><{tag}><a href='/x'>teaser</a></{tag}><div>{body}</div></body>").split("\n") == a


WORDY = ["related-work", "search-algorithms", "social-impact", "header-files", "ad-hoc-networks"]


@pytest.mark.parametrize("tag, name", [("article", n) for n in [*WORDY, "comments", "header"]] + [("div", n) for n in WORDY])
def test_words_in_ids_of_sections_and_headings_lose_nothing(name, tag):
    a, b = paragraphs("a"), paragraphs("b", 3)
    section = lambda i, texts: f"<section id='{i}'><h2 id='{i}'>Head of {i}</h2>{''.join(f'<p>{x}</p>' for x in texts)}</section>"
    page = f"<body><{tag}><h1>Head</h1>{section('first', a)}{section(name, b)}</{tag}></body>"
    assert html.main_text(page).split("\n") == ["Head", "Head of first", *a, f"Head of {name}", *b]


@pytest.mark.parametrize("name", ["header-fixed", "header", "content-widget", "sidebar", "page_comments"])
def test_a_named_wrapper_does_not_empty_the_page(name):
    a = paragraphs("a")
    body = "".join(f"<p>{x}</p>" for x in a)
    links = "".join(f"<li><a href='/{i}'>some linked words {i}</a></li>" for i in range(30))
    for page in (f"<body><div class='{name}'>{body}</div></body>", f"<body><form id='{name}'><div>{body}</div><div class='left-{name}'><ul>{links}</ul></div></form></body>"):
        assert html.main_text(page).split("\n") == a
    assert html.main_text(f"<body><div class='{name}'>a</div><div class='{name}'>b</div></body>") == "a\nb"


FOUR = "".join(f"<p>{'A reader says a lot of plain words. ' * 12}{i}</p>" for i in range(4))
ONE = f"<p>{'We keep small files on your machine to know you again. ' * 8}</p>"


@pytest.mark.parametrize("leak", [
    f"<section id='comments'>{FOUR}</section>", f"<section id='comments'><h2>Comments</h2>{FOUR}</section>", f"<div class='reader comments'>{FOUR}</div>".replace("reader ", ""),
    f"<div class='cookie-notice'>{ONE}</div>", f"<div id='cookie-notice'>{ONE}</div>", f"<div class='footer'>{ONE}</div>", f"<div class='ad'>{ONE}</div>", f"<form>{ONE}</form>",
])
@pytest.mark.parametrize("n", [1, 10])
@pytest.mark.parametrize("before", [True, False])
def test_named_parts_beside_an_article_do_not_leak(leak, n, before):
    a = paragraphs("a", n, 300)
    article = f"<article><h1>Head</h1>{''.join(f'<p>{x}</p>' for x in a)}</article>"
    for page in (f"<body>{leak}{article}</body>", f"<body><div>{article}{leak}</div></body>")[:: 1 if before else -1]:
        assert html.main_text(page).split("\n") == ["Head", *a]
    wide = article.replace("article", "div")
    if n == 10:
        assert html.main_text(f"<body>{wide}{leak}</body>").split("\n") == ["Head", *a]


def test_named_parts_of_code_stay():
    a, code = paragraphs("a"), "<p>x = 1 <code><span class='comment'># a note that says what the line does</span></code> and more plain words</p>"
    page = f"<article>{''.join(f'<p>{x}</p>' for x in a)}{code}</article>"
    assert html.main_text(page).split("\n") == [*a, "x = 1 # a note that says what the line does and more plain words"]


@pytest.mark.parametrize("name", ["ad", "share-bar", "left sidebar", "site_comments"])
def test_names_decide_beside_the_text(name):
    a = paragraphs("a")
    body = "".join(f"<p>{x}</p>" for x in a)
    junk = "<div class='%s'>%s</div>"
    links = "".join(f"<a href='/{i}'>some linked words {i}</a> " for i in range(60))
    for inner in ("A few plain words.", links):
        assert html.main_text(f"<body><div>{body}{junk % (name, inner)}</div></body>").split("\n") == a


def test_long_and_odd_pages_end_soon():
    assert html.main_text("<div>" * 20_000 + "deep") == "deep"
    assert len(html.main_text("<article>" + "<p>x" * 50_000)) == 99_999
    assert html.main_text("<a" * 100_000) == ""
    assert html.main_text("<b x=\"" * 30_000 + ">") is not None


def test_extract(spark):
    rows = [(i, f"u{i}", s) for i, s in enumerate(CASES)] + [(None, None, None), (0, "u0", "plain   words")]
    frame = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = Counter((r.page_id, r.url, r.text, r.n_chars) for r in html.extract(frame).collect())
    assert got == Counter((i, u, CASES.get(s, ""), len(CASES.get(s, ""))) for i, u, s in rows)
    assert html.extract(frame.limit(0)).collect() == []


@pytest.mark.parametrize("kind, least, most", [("no structure", 0.95, 0.75), ("clusters", 0.95, 0.05)])
def test_only_colliding_vectors_are_verified(kind, least, most):
    rng = np.random.default_rng(8)
    n = 2000
    x = rng.standard_normal((n, 64))
    if kind == "clusters":
        x = rng.standard_normal((40, 64))[rng.integers(0, 40, n)] + 0.3 * x
    ids, asked = np.arange(n), np.arange(0, n, 50)
    verified = []
    found = ann.search_block(ids, x, ids[asked], x[asked], 5, verified)
    expected = brute_nearest(list(zip(ids.tolist(), x)), 5)
    got = defaultdict(set)
    for q, i, _ in found:
        got[q].add(i)
    assert sum(len(got[q] & {j for _, j in e}) for q, e in expected.items()) >= least * sum(map(len, expected.values()))
    assert len(verified) == len(asked) and np.mean(verified) <= most * n
