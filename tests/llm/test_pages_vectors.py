"""Main text of pages, and nearest neighbours."""

import numpy as np
import pytest

from gridloom.llm import html, vectors


def test_blocks_of_one_page():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</ul></nav>"
        "<div class='content'><h1>A &amp;  title</h1><p>First\n line<b>bold</b> &eacute;.<p>Second<br>line</div>"
        "<div class='sidebar'>Side</div><form>Mail <input></form><script>if (a < b) {}</script><section id=comments><p>Reader</p></section>"
        "<footer>Foot</footer></body></html>"
    )
    assert html.main_text(html.blocks(page)) == ["A & title", "First linebold é.", "Second line"]


@pytest.mark.parametrize("page", ["", "   ", "<", "<div", "<!-- open", "</p></div>", "<p title='a>b'", "&#x110000; &bogus;", "<script>never closed"])
def test_broken_pages(page):
    html.blocks(page)


def test_templates_go_and_articles_stay(spark):
    body = lambda k: f"<div class=wrap><p>Article {k} says something of its own {k * 7}.</p></div>"
    rows = [(k, f"http://a.example/{k}", f"<body><div>Find us in town</div>{body(k)}<div><span>Call now</span></div></body>") for k in range(12)]
    rows += [(100 + k, f"http://b.example/{k}", f"<body>{body(3)}<div>Only here {k}</div></body>") for k in range(3)]
    rows += [(200 + k, "http://c.example/", f"<body>{body(5)}</body>") for k in range(9)]  # copies of one article are no template
    rows += [(300, None, None), (301, "http://a.example/x", "")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as row", "'x' as host", "2 as n_chars")
    got = {r.page_id: r for r in html.extract(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[k].text == f"Article {k} says something of its own {k * 7}." for k in range(12))
    assert got[101].text == "Article 3 says something of its own 21.\nOnly here 1"
    assert got[204].text == "Article 5 says something of its own 35."
    assert got[300].text == got[301].text == "" and got[300].n_chars == 0
    assert all(r.n_chars == len(r.text) for r in got.values())


def brute(ids, matrix, queries, k):
    out = {}
    for q in queries:
        scores = np.cumsum(matrix * matrix[q], axis=1)[:, -1]
        order = [i for i in np.lexsort((ids, -scores)) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def test_nearest_neighbours(spark, sf):
    frame = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [r for r in frame.collect() if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)]
    ids, matrix = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute(ids, matrix, np.flatnonzero(ids % 20 == 0), 20)
    got = {}
    for r in vectors.query(spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score, r["rank"]))
    assert set(got) == set(want)
    hits = sum(len({v for v, _, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.92 * sum(map(len, want.values()))
    score = {(int(ids[q]), int(i)): float(s) for q in np.flatnonzero(ids % 20 == 0) for i, s in zip(ids, np.cumsum(matrix * matrix[q], axis=1)[:, -1])}
    for q, found in got.items():
        assert [r for _, _, r in found] == list(range(1, 21)) and all(s == score[q, v] for v, s, _ in found)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("clusters", [0, 200])
def test_recall_against_brute_force(spark, clusters):
    """20,000 vectors without any structure, and in clusters."""
    rng = np.random.default_rng(4)
    matrix = rng.standard_normal((20_000, 32))
    if clusters:
        matrix += 2 * rng.standard_normal((clusters, 32))[rng.integers(0, clusters, len(matrix))]
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(matrix.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in vectors.search(frame).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = np.arange(0, len(matrix), 20)
    scores = matrix[asked] @ matrix.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, 20, axis=1)[:, :20]
    assert sum(len(got[int(q)] & set(b.tolist())) for q, b in zip(asked, best)) >= 0.92 * best.size


def test_segments_are_the_sorted_arrays(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3_000, 8))
    frame = spark.createDataFrame([(k, x, 0.5) for k, x in enumerate(v.tolist())], "node long, v array<double>, rest double")
    segments = vectors.build(frame, 60_000)  # as if larger: many segments
    made = vectors.strings(v, np.full(len(v), 0.5))
    by_tree = {}
    for r in segments.orderBy("segment").collect():
        by_tree.setdefault(r.tree, []).append(np.frombuffer(r.strings, "<u4"))
        nodes = np.frombuffer(r.nodes, "<i8")
        assert (made[r.tree, nodes] == by_tree[r.tree][-1]).all()
    assert len(by_tree) == vectors.TREES and max(map(len, by_tree.values())) > 1
    for tree, parts in by_tree.items():
        assert (np.concatenate(parts) == np.sort(made[tree])).all()
    # counts at each level against the arrays, and the segments that a range meets
    bounds = vectors.Bounds(segments)
    asked = spark.createDataFrame([(0, v[0].tolist()), (1, v[1].tolist())], "q long, v array<double>")
    met = {r.q: r.met for r in vectors.met_counts(asked, segments, spark.sparkContext.broadcast(bounds)).collect()}
    own = vectors.strings(v[:2], np.zeros(2))
    for q in (0, 1):
        for bits in (0, 6, 12, 32):
            true = sum(int(((made[t] ^ own[t, q]) >> np.uint32(32 - bits) == 0).sum()) if bits else len(v) for t in range(vectors.TREES))
            assert abs(met[q][bits] - true) <= (0 if bits in (0, 32) else 0.3 * true + 60)


def test_odd_vectors(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [float("nan"), 1.0]), (4, [0.0, 0.0]), (5, None), (None, [1.0, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1.0, 2.0, 3.0]), (40, [float("inf"), 1.0]), (7, [1.0, 0.0]), (1, [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as segment", "3 as score")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in vectors.search(frame).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 7, 1.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'title="hidden gems"', 'data-id="menu"', "class='no-sidebar content'", 'class="has-footer with-nav"', "data-role=navigation", 'id="social-science"'])
def test_wrappers_that_only_look_dropped(attrs):
    assert html.main_text(html.blocks(f"<div {attrs}><p>An article.</p></div>")) == ["An article."]


@pytest.mark.parametrize("tag", ["div hidden", "div aria-hidden=true", 'div class="x left-sidebar"', "div id='comments-area'", "div title='a' class=nav", 'p class="advert"', "section role=navigation"])
def test_elements_that_are_dropped(tag):
    assert html.main_text(html.blocks(f"<{tag}>Gone</{tag.split()[0]}><p>An article.</p>")) == ["An article."]


def test_paragraphs_on_every_page_go(spark):
    rows = [(k, f"http://a.example/{k}", f"<body><p>Closed on Sundays.<div><p>Story {k} of its own.</p></div></body>") for k in range(8)]
    rows += [(100 + k, f"http://b.example/{k}", f"<article><p>Closed on Sundays.</p><p>Story {k} of its own.</p></article>") for k in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} of its own." for k in range(8)} | {100 + k: f"Closed on Sundays.\nStory {k} of its own." for k in range(8)}


def test_templates_of_sections_of_a_large_host(spark):
    rows = [(k, f"http://a.example/{k}", f"<body><div>Section {k % 100} menu</div><div><p>Story {k} of its own.</p></div></body>") for k in range(600)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 600 and all(r.text == f"Story {r.page_id} of its own." for r in got)


@pytest.mark.parametrize("page", [
    "<div class='layout has-sidebar'><p>Main text</p></div>", "<article class='post comments-open'>Main text</article>", "<div class='no-comments'>Main text</div>",
    "<div class=sidebar><p>Main text</p></div>", "<body><h2 class=banner>Main text</h2></body>", "<p>Main <span class=ad>Buy</span>text</p>",
])
def test_named_wrappers_of_the_whole_text_stay(page):
    assert html.main_text(html.blocks(page)) == ["Main text"]


def test_a_teaser_is_not_the_article():
    page = "<h1>Own heading</h1><div>The page's own body is longer than its teaser.</div><article>More news</article>"
    assert html.main_text(html.blocks(page)) == ["Own heading", "The page's own body is longer than its teaser.", "More news"]


def test_templates_against_brute_force(spark, sf):
    """Per-host counts of subtrees by hand, and the same text whichever way templates reach the pages."""
    frame = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    parsed = {r.page_id: html.blocks(r.html or "", html.host_of(r.url)) for r in frame.collect()}
    on = {}
    for found in parsed.values():
        for h in {h for _, hashes, _, _ in found for h in hashes}:
            on.setdefault(h, set()).add("\n".join(html.main_text(found)))
    gone = {h for h, pages in on.items() if len(pages) >= html.MIN_PAGES}
    pages = html.parse(frame).withColumn("row", html.F.monotonically_increasing_id())
    assert {r["hash"] for r in html.templates(pages).collect()} == gone and gone
    want = {k: "\n".join(html.main_text(found, gone)) for k, found in parsed.items()}
    assert sum(not gone.isdisjoint(hashes) for found in parsed.values() for _, hashes, _, _ in found) > 0
    assert {r.page_id: r.text for r in html.extract(frame).collect()} == want
    assert {r.page_id: r.text for r in html.extract(frame, broadcast_hashes=0).collect()} == want
