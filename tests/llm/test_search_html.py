import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from joinscout.llm import balltree, html_text


@pytest.mark.parametrize("k", [1, 20])
def test_top_k_against_brute_force(spark, k, monkeypatch):
    monkeypatch.setattr(balltree, "LEAF", 8)
    rng = np.random.default_rng(k)
    x = rng.normal(size=(300, 6)).astype(np.float32)
    x[100:180] = x[100]  # one common vector: ties go to the smaller id
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (None, [1.0] * 6), (1020, [1.0, None, 2.0]), (1040, [math.nan] * 6), (1060, [math.inf] * 6), (1080, [])]
    df = spark.createDataFrame(rows, "id long, e array<float>").select("id", balltree.quantised(F.col("e")).alias("v"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in balltree.top_k(spark, df, df.where("id % 20 = 0"), k, shard=64, block=4).collect())
    v = {i: np.floor(64 * np.array(e, np.float64)).astype(int) for i, e in rows[:300]} | {1080: np.zeros(6, int)}
    want = []
    for q in (i for i in v if i % 20 == 0):
        best = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want)


def test_fewer_than_k_and_none(spark):
    df = spark.createDataFrame([(0, [1]), (20, [2])], "id long, v array<long>")
    assert sorted(map(tuple, balltree.top_k(spark, df, df, 5).collect())) == [(0, 1, 20, 2), (20, 1, 0, 2)]
    assert balltree.top_k(spark, df.limit(0), df.limit(0), 5).count() == 0


def test_shards_that_can_hold_no_better_score_are_not_opened(spark):
    rng = np.random.default_rng(3)
    heart = rng.normal(size=(16, 4)) * 3000
    v = (heart[rng.integers(0, 16, 2000)] + rng.normal(size=(2000, 4)) * 20).astype(np.int64)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<long>")
    out = balltree.top_k(spark, df, df.where("id % 20 = 0"), 3, shard=100, block=8, report=True).collect()
    want = {q: sorted((-int(v[q] @ v[c]), c) for c in range(2000) if c != q)[:3] for q in range(0, 2000, 20)}
    got: dict = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got == want and np.mean([r.shards for r in out]) < 10  # of more than 20


def test_vectors_of_other_lengths_and_ids_that_repeat(spark):
    rows = [(0, [1, 2]), (0, [5]), (20, [1, 1, 9]), (7, []), (8, [3, 3, 3])]
    df = spark.createDataFrame(rows, "id long, v array<long>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in balltree.top_k(spark, df, df.where("id % 20 = 0"), 3, shard=2).collect())
    wide = [(i, v + [0] * (3 - len(v))) for i, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = []
    for i, v in wide:
        if i % 20 == 0:
            best = sorted((-dot(v, w), j) for j, w in wide if j != i)[:3]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    assert got == sorted(want)


def test_pruning_skips_leaves():
    rng = np.random.default_rng(0)
    v = (rng.normal(size=(2000, 4)) * 40).astype(np.int64)
    s = balltree.Search(np.arange(5) * 20, v[:100:20], 5)
    s.over(balltree.BallTree(np.arange(2000), v))
    assert s.seen < 5 * 2000


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><header>Site</header><div class="cookie-notice">We use</div>
<article><h1>Head &amp; line</h1><p>One&nbsp; two<br>three <b>bold<p>Second &lt;p&gt; &copy<div class="ad">Buy</div><ul><li>item</ul>
<section id="comments"><p>me too</p></section><form><p>mail</p></form><p class="lead">Last</p></article>
<aside>Side</aside><footer>&copy; x</footer></body></html>"""


def text_of(page, neighbour=None):
    return html_text.main_text(html_text.lines_of(page), html_text.lines_of(neighbour) if neighbour else None)[0]


def test_main_text():
    assert text_of(PAGE) == "Head & line\nOne two three bold\nSecond <p> ©\nitem\nLast"
    assert text_of(None) == "" == text_of("") and text_of("plain text") == "plain text"


def test_names_of_elements():
    page = '<main class="content-with-sidebar"><div class="article-header"><h1>A</h1></div><p class="ad-slot">x</p><div id="post_comments"><p>y</p></div><p class="loaded">B</p></main><div class="site-header">z</div>'
    assert text_of(page) == "A\nB"


def test_cut_pages():
    assert text_of("<article><p>One &am") == "One &am" and text_of("<article><p>One &amp") == "One &" and text_of("<article><p>One</p><p cla") == "One"
    assert text_of("<article><p>One<!-- two") == "One" and text_of("<article><p>a<script>var x") == "a"


def test_differencing_without_structure():
    a, b = "<div>Top</div><div>Mine</div><div>End</div>", "<div>Top</div><div>Yours</div><div>End</div>"
    assert text_of(a, b) == "Mine" and text_of(a) == "Top\nMine\nEnd"
    copies = "<article><p>Same</p></article><div>Foot</div>"
    assert text_of(copies, copies) == "Same"


def test_longest_common_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (list(map(str, rng.integers(0, 4, rng.integers(0, 12)))) for _ in range(2))
        d = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        got = html_text.shared_lines(a, b)
        kept, at = [a[i] for i in sorted(got)], 0
        for x in kept:
            at = b.index(x, at) + 1
        assert len(got) == d[-1, -1]


def test_extract(spark):
    rows = [(1, "http://H.example/a/1", PAGE, 0), (2, "http://h.example/a/2", PAGE, 0), (3, None, None, 0), (4, "nonsense", "", 0), (1, "http://H.example/a/1", PAGE, 0)]
    out = html_text.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string, text int")).orderBy("page_id").collect()
    assert [(r.page_id, r.n_chars) for r in out] == [(1, len(text_of(PAGE)))] * 2 + [(2, len(text_of(PAGE))), (3, 0), (4, 0)]
    assert out[0].url == "http://H.example/a/1" and all(r.n_chars == len(r.text) for r in out)


def test_copies_without_an_article_keep_their_text(spark):
    def page(*lines):
        return "<body>" + "".join(f"<p>{x}</p>" for x in ("Top of the site", *lines, "All rights of the site")) + "</body>"

    def story(x, n=12):
        return [f"Sentence {i} of story {x} has words of its own {x * (i + 1)}" for i in range(n)]

    a, b = page(*story("a")), page(*story("b"))
    near = page(*story("a"), "Seen 3 times")
    rows = [(1, "http://h/x/a", a), (1, "http://h/x/a", a), (2, "http://h/x/a?utm_source=m", a), (3, "http://h/x/a?s=2", near), (4, "http://h/x/b", b)]
    rows += [(5, "http://alone/a", a), (6, "http://alone/a?u=1", a), (7, "http://plain/a", "plain text of a page"), (7, "http://plain/a", "plain text of a page"), (8, None, a), (9, None, b)]
    out = html_text.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()
    by = {}
    for r in out:
        by.setdefault(r.page_id, set()).add(r.text)
    whole = lambda x: "\n".join(["Top of the site", *story(x), "All rights of the site"])
    assert len(out) == len(rows) and by[7] == {"plain text of a page"} and by[5] == by[6] == by[8] == {whole("a")} and by[9] == {whole("b")}
    # pages at the edge of a range partition may have no neighbour, but never lose their own lines
    for i, x in ((1, "a"), (2, "a"), (3, "a"), (4, "b")):
        assert all("\n".join(story(x)) in text for text in by[i])


def test_copies_are_differenced_with_the_next_page():
    def lines(x):
        return html_text.lines_of("<p>Top of the site</p>" + "".join(f"<p>Sentence {i} of story {x}, which is long enough</p>" for i in range(9)))

    assert html_text.copies(lines("a"), lines("a")) and not html_text.copies(lines("a"), lines("b"))
    text, n = html_text.main_text(lines("a"), [lines("a"), lines("b")])
    assert n == 1 and text.startswith("Sentence 0 of story a") and html_text.main_text(lines("a"), [lines("a")])[1] == 0
