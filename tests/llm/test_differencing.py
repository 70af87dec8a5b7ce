"""Main text of all pages of several hosts against a plain version, on different partitionings, with and without articles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from joinscout.llm import html_text as H


def lcs(a, b):
    """Lengths by the plain table; indexes in a of one longest common subsequence aren't unique, so only their number is compared."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
    return d[-1][-1]


def pages_of(rng, article):
    rows = []
    for h in range(3):
        menu = [f"Menu {h} {i}" for i in range(4)]
        story = None
        for i in range((30, 1, 90)[h]):
            if story is None or rng.random() > 0.15:
                story = [f"Host {h} sentence {rng.randint(0, 10**6)} of its own, {'long ' * rng.randint(1, 9)}" for _ in range(rng.randint(3, 9))]
            top = "".join(f"<div>{x}</div>" for x in menu if rng.random() < 0.8)
            body = "".join(f"<p>{x}</p>" for x in story)
            html = f"<body>{top}<{article}>{body}</{article}><div>Foot {h}</div></body>"
            rows.append((len(rows), f"http://host{h}.x/a{rng.randint(0, 3)}/p{rng.randint(0, 60)}?q={i}", html, "path"))
    rows += [(r[0], r[1], r[2], r[3]) for r in rows[:5]] + [(900, None, rows[0][2], ""), (901, "http://host0.x/", None, "")]
    return rows


def plain(rows, structure):
    hosts = {}
    for i, url, page, _ in rows:
        m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)([^?#]*)", url or "")
        if m:
            kept = hosts.setdefault(m[1].lower(), {})
            kept[page or ""] = min(kept.get(page or "", (m[2], i)), (m[2], i))
    out = {}
    for i, url, page, _ in rows:
        lines = H.lines_of(page)
        host = next((h for h in hosts if url and url.startswith(f"http://{h}/")), None)
        near = []
        if host:
            order = sorted(hosts[host].items(), key=lambda x: x[1][0])
            at = next(k for k, x in enumerate(order) if x[0] == (page or ""))
            path = order[at][1][0].strip("/").split("/")
            near = sorted((-H._nearness(x[1][0].strip("/").split("/"), path), abs(k - at), k > at, k) for k, x in enumerate(order) if k != at and abs(k - at) <= H.REACH)
            near = [H.lines_of(order[k][0]) for *_, k in near]
        main = structure and H._has_main(lines)
        side = (lambda ls: [x for x in ls if not x.main]) if structure else (lambda ls: ls)
        own = side(lines)
        shared, met = set(), 0
        for other in near:
            found = H.shared_lines([x.text for x in own], [x.text for x in side(other)])
            assert len(found) == lcs([x.text for x in own], [x.text for x in side(other)])
            if not main:
                counted = [k for k, x in enumerate(own) if not structure or not x.boilerplate]
                total = sum(len(own[k].text) for k in counted)
                if total and sum(len(own[k].text) for k in counted if k not in found) < H.LEFT * total:
                    continue
                met += 1
            shared |= found
            if structure and not main and met >= H.NEAREST:
                break
        gone = {id(own[k]) for k in shared}
        text = [x.text for x in lines if (not structure or not x.boilerplate) and (x.main if main else id(x) not in gone)]
        out[i, url] = ("\n".join(text), len(shared))
    return out


@pytest.mark.parametrize(("article", "structure"), [("article", True), ("div", True), ("article", False)])
def test_against_a_plain_version(spark, article, structure):
    rows = pages_of(random.Random(6), article)
    # pages of one path are put in order by a hash that a plain version can't see
    seen, unique = set(), []
    for r in rows:
        place = (r[1] or "").split("?")[0]
        if (place, r[2]) in seen or place not in {p for p, _ in seen} or not r[1]:
            unique.append(r)
            seen.add((place, r[2]))
    df = spark.createDataFrame(unique, "page_id long, url string, html string, path string").withColumn("lines", F.lit("x"))
    want = plain(unique, structure)
    for n in (3, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        got = H.extract(spark, df.repartition(n), structure).collect()
        assert len(got) == len(unique)
        for r in got:
            assert (r.text, r.n_shared) == want[r.page_id, r.url] and r.n_chars == len(r.text)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if not structure:
        assert any(r.n_shared for r in got)


@pytest.mark.parametrize("n", [H.PAGES * 2 + 40, H.PAGES])
def test_blocks_and_halos(spark, n):
    """A host of more pages than a block, with pages that share a line only across the border; and a full last block, whose next one has no pages of its own."""
    rows = [(i, f"http://big.x/p{i:05}", f"<p>Own {i} line of this page alone, and no other</p><p>pair {i // 2}</p>") for i in range(n)]
    got = {r.page_id: (r.text, r.n_shared) for r in H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), nearest=2).collect()}
    assert all(got[i] == (f"Own {i} line of this page alone, and no other", 1) for i in range(n))


def test_empty_and_odd_pages(spark):
    schema = "page_id long, url string, html string"
    assert H.extract(spark, spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "http://h/a", None), (2, "http://h/b", ""), (3, "http://h/c", "<p>x" * 20_000), (None, None, "<p>y</p>"), (4, "http://h/d", "<p>x</p>")]
    got = {r.page_id: r for r in H.extract(spark, spark.createDataFrame(rows, schema)).collect()}
    assert got[1].text == got[2].text == "" and got[None].text == "y" and got[3].n_chars in (20_000 * 2 - 1, 20_000 * 2 - 3, 19_999 * 2 - 1)


@pytest.mark.parametrize("nearest", [1, 2])
def test_long_runs_of_near_copies_find_a_page_beyond_reach(spark, nearest):
    """Pages without an article, all (nearly) copies of each other but for two at the one end and one at the other, more than a block away."""
    n = 2 * H.PAGES + 150
    story = "".join(f"<p>Sentence {i} of the story that all of these pages tell, word for word</p>" for i in range(9))
    page = lambda own: f"<body><div>Site name</div><div>Motto of the site</div>{own}</body>"
    rows = [(i, f"http://run.x/p{i:05}", page(f"{story}<p>no {i}</p>")) for i in range(n)]
    rows[0], rows[1], rows[-1] = ((i, rows[i][1], page(f"<p>{'Something else altogether ' * 9}{i}</p>").replace("Motto of the site", motto)) for i, motto in ((0, "Motto of the site"), (1, "no"), (n - 1, "no")))
    got = {r.page_id: r.text for r in H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5), nearest=nearest).collect()}
    near = lambda i: sorted((abs(k - i), k > i, k) for k in (0, 1, n - 1))[:nearest]
    for i in range(2, n - 1):
        lines = got[i].split("\n")
        assert "Site name" not in lines and lines[-1] == f"no {i}" and len(lines) == 10 + (not any(k == 0 for *_, k in near(i)))
