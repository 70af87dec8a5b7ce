"""Main text of web pages by differencing with the pages of the nearest URLs.

Pages go in order of host and URL path. Each is compared with the REACH pages before and after it on its host, nearest path first, and lines (blocks) that a longest
common subsequence has in both pages are shared by the site's template. Pages of the same html on a host are one page, at the first of their paths.

Differencing alone takes too much and too little: copies of one article share all of its lines, and menus may
differ on every page. So the page's own structure goes beside it: lines in an article or main element, but not in one of its
boilerplate parts, stay though they are shared; lines in boilerplate elements go; of lines outside an article those of pages that have one go, and those
of pages without stay unless they are shared with one of the NEAREST pages that aren't (nearly) copies of them. Where all pages within REACH are copies, the
search goes on over the rest of the host, nearest first, to blocks ever farther off, as far as pages ask for them.

Only hashes and lengths of lines are put in order and compared. Pages are numbered within their host and compared in blocks of PAGES, to which REACH pages either
side are given as well, so a hot host is many tasks, a run of copies takes no more memory than other pages, and results don't depend on where partitions fall.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .merkle import numbered

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes")
_END_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _RAW}
#: Elements that aren't main text whatever they hold.
BOILERPLATE = frozenset("head nav header footer aside form menu dialog button select fieldset svg canvas audio video object map".split())
MAIN = frozenset(("article", "main"))
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_WORDS = re.compile(r"[a-z]+")
#: Words in class, id or role that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disclaimer disqus footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar topbar widget".split()
)


@dataclass
class Line:
    text: str
    main: bool
    boilerplate: bool


def _marks(attributes: str) -> set[str]:
    """The first and last words of each name in class, id and role, but of names that only tell what else there is (with-sidebar)."""
    out = set()
    for key, *value in _ATTRIBUTE.findall(attributes):
        if key.lower() in ("class", "id", "role", "itemprop"):
            for name in "".join(value).lower().split():
                words = _WORDS.findall(name)
                if words and not {"with", "has", "no", "without"} & set(words):
                    out |= {words[0], words[-1], "".join(words)}
    return out


def lines_of(page: str | None) -> list[Line]:
    """The non-empty text blocks of a page in order, white space as one space, with what its elements say of them."""
    page = page or ""
    out: list[Line] = []
    stack: list[tuple[str, bool, bool]] = []  # element, within main, within boilerplate
    held: list[str] = []
    main = boiler = False

    def end_block():
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                out.append(Line(text, main, boiler))

    def leave(depth: int):
        nonlocal main, boiler
        end_block()
        del stack[depth:]
        main, boiler = stack[-1][1:] if stack else (False, False)

    at = 0
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            held.append(page[at:])
            break
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if not page[m.end() - 1] == ">" and at == len(page):
            break  # a tag that the page's end cuts off
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    leave(depth)
                    break
            else:
                if name in BLOCKS:
                    end_block()
            continue
        if name in _RAW:
            end = _END_RAW[name].search(page, at)
            at = end.end() if end else len(page)
            if name == "title":
                end_block()
            continue
        if name == "br":
            held.append(" ")
        if name in BLOCKS:
            for depth in range(len(stack) - 1, -1, -1):  # a block ends an open paragraph
                if stack[depth][0] == "p":
                    leave(depth)
                    break
                if stack[depth][0] in ("article", "main", "section", "div", "body", "td", "li"):
                    break
            end_block()
        if name in _VOID or m[3].rstrip().endswith("/"):
            continue
        if name in BLOCKS or name in BOILERPLATE:
            marked = _marks(m[3]) if "=" in m[3] else set()
            if main:
                marked.discard("header")  # an article's own heading
            own = name in BOILERPLATE and not (name == "header" and main) or bool(marked & MARKS) and name not in ("html", "body", "article", "main")
            if name not in BLOCKS:
                end_block()
            stack.append((name, main or name in MAIN or "articlebody" in marked, boiler or own))
            main, boiler = stack[-1][1:]
    end_block()
    return out


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Indexes in a of a longest common subsequence of lines (Hunt and Szymanski)."""
    places: dict[str, list[int]] = {}
    for j, line in enumerate(b):
        places.setdefault(line, []).append(j)
    ends: list[int] = []
    links: list[tuple] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    out, link = set(), links[-1] if links else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


#: A page is (nearly) a copy where less than this part of its text would be left.
LEFT = 0.1
#: Pages before and after a page that it is compared with; how many of them count for a page without an article, of which they decide what stays.
REACH, NEAREST = 64, 1
#: Pages of a block.
PAGES = 512


def _outside(lines: list[Line]) -> list[str]:
    return [x.text for x in lines if not x.main]


def _has_main(lines: list[Line]) -> bool:
    return any(x.main and not x.boilerplate for x in lines)


def _shares_all(lines: list[Line], neighbour: list[Line]) -> bool:
    """Whether a page without an article has (nearly) all of its text from the neighbour."""
    if _has_main(lines):
        return False
    own, places = _outside(lines), [i for i, x in enumerate(x for x in lines if not x.main) if not x.boilerplate]
    shared = shared_lines(own, _outside(neighbour))
    left, total = sum(len(own[i]) for i in places if i not in shared), sum(len(own[i]) for i in places)
    return total > 0 and left < LEFT * total


def copies(a: list[Line], b: list[Line]) -> bool:
    """Whether two pages without an article are (nearly) the same."""
    if _has_main(a) or _has_main(b):
        return False
    return a == b or _shares_all(a, b) and _shares_all(b, a)


def shared_with(tokens: list, sizes: list[int], counted: list[int], neighbours, has_main: bool, nearest: int = NEAREST) -> tuple[set[int], int]:
    """Indexes of tokens (lines, or hashes of them) that a longest common subsequence with one of the neighbours has, nearest first; and how many that aren't copies were met.

    A page without an article isn't compared with (nearly) a copy of itself, by the sizes of its `counted` lines, and only with the first `nearest` others. A neighbour that
    has none of the lines that are still unshared adds nothing and is passed over.
    """
    shared: set[int] = set()
    total = sum(sizes[i] for i in counted)
    met = 0
    for other in neighbours:
        if has_main and not any(i not in shared and t in other for i, t in enumerate(tokens)):
            continue
        found = shared_lines(tokens, other)
        if not has_main:
            if total > 0 and sum(sizes[i] for i in counted if i not in found) < LEFT * total:
                continue
            met += 1
        shared |= found
        if len(shared) == len(tokens) or not has_main and met >= nearest:
            break
    return shared, met


def main_text(lines: list[Line], neighbours: list[Line] | list[list[Line]] | None) -> tuple[str, int]:
    """The main text, one line a block, and how many lines outside an article the neighbours share (nearest first; see shared_with)."""
    some = [] if neighbours is None else neighbours if neighbours and isinstance(neighbours[0], list) else [neighbours]
    has_main = _has_main(lines)
    outside = [i for i, x in enumerate(lines) if not x.main]
    own = [lines[i].text for i in outside]
    counted = [k for k, i in enumerate(outside) if not lines[i].boilerplate]
    shared = {outside[k] for k in shared_with(own, [len(t) for t in own], counted, [_outside(x) for x in some], has_main)[0]}
    kept = [x.text for i, x in enumerate(lines) if not x.boilerplate and (x.main if has_main else i not in shared)]
    return "\n".join(kept), len(shared)


def _nearness(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


#: Of a line: in an article, in a boilerplate element.
_MAIN, _BOILER = 1, 2


def _parsed(batches):
    """(page_id, url, host, path, key, other, html) to the lines of each page and what its elements say of them."""
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            lines = [lines_of(page) for page in part.column(6).to_pylist()]
            texts = pa.array([[x.text for x in page] for page in lines], pa.list_(pa.string()))
            flags = pa.array([[_MAIN * x.main + _BOILER * x.boilerplate for x in page] for page in lines], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(6)], texts, flags], names=["page_id", "url", "host", "path", "key", "other", "lines", "flags"])


def _tokens(r: dict, structure: bool) -> tuple[list[int], list, list[int], list[int]]:
    """Of a page's row: the indexes of its lines outside an article, their hashes and sizes, and places among them of lines that count as text."""
    outside = [i for i, f in enumerate(r["flags"]) if not structure or not f & _MAIN]
    counted = [k for k, i in enumerate(outside) if not structure or not r["flags"][i] & _BOILER]
    return outside, [r["h"][i] for i in outside], [r["sizes"][i] for i in outside], counted


def _differenced(structure: bool, nearest: int):
    """A block's own pages to the lines that they share with pages near them, and how many more pages that aren't copies they need."""

    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        pages = []
        for r in rows:
            main = any(f == _MAIN for f in r["flags"])
            pages.append((r["path"].strip("/").split("/"), *_tokens(r, structure), main and structure))
        keys, others, found, need = [], [], [], []
        for k, r in enumerate(rows):
            if r["halo"]:
                continue
            path, outside, tokens, sizes, counted, has_main = pages[k]
            near = [(-_nearness(pages[j][0], path), abs(rows[j]["pos"] - r["pos"]), j > k, j) for j in range(max(0, k - REACH), min(len(rows), k + REACH + 1)) if j != k]
            # without structure every page is compared with all of them, but not with copies
            shared, met = shared_with(tokens, sizes, counted, (pages[j][2] for *_, j in sorted(near)), has_main, nearest if structure else len(near))
            keys.append(r["key"])
            others.append(r["other"])
            found.append(sorted(outside[i] for i in shared))
            need.append(max(nearest - met, 0) if structure and not has_main and any(sizes[i] for i in counted) and len(shared) < len(tokens) else 0)
        names = {"host": pa.array([rows[0]["grp"]] * len(keys), pa.string()), "key": pa.array(keys, pa.int64()), "other": pa.array(others, pa.int64())}
        return pa.table(names | {"shared": pa.array(found, pa.list_(pa.int32())), "need": pa.array(need, pa.int32())})

    return run


def _farther(near: int, far: int):
    """Pages that ask (`need` above 0) and those of one block to the first `need` of the block that aren't copies, at a distance above `near` and up to `far`."""

    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["pos"])
        block = [(r["pos"], _tokens(r, True)[1]) for r in rows if not r["need"]]
        out = []
        for r in rows:
            if not r["need"]:
                continue
            outside, tokens, sizes, counted = _tokens(r, True)
            own, total, known, hits = set(tokens), sum(sizes[i] for i in counted), {}, []
            for distance, after, other in sorted((abs(p - r["pos"]), p > r["pos"], k) for k, (p, _) in enumerate(block) if near < abs(p - r["pos"]) <= far):
                lines = tuple(t for t in block[other][1] if t in own)  # no others can be shared
                if lines not in known:
                    found = shared_lines(tokens, lines)
                    known[lines] = None if sum(sizes[i] for i in counted if i not in found) < LEFT * total else sorted(outside[i] for i in found)
                if known[lines] is not None:
                    hits.append({"distance": distance, "after": after, "lines": known[lines]})
                    if len(hits) == r["need"]:
                        break
            if hits:
                out.append({"host": r["grp"], "key": r["key"], "other": r["other"], "hits": hits})
        hit = pa.list_(pa.struct([("distance", pa.int64()), ("after", pa.bool_()), ("lines", pa.list_(pa.int32()))]))
        return pa.Table.from_pylist(out, pa.schema([("host", pa.string()), ("key", pa.int64()), ("other", pa.int64()), ("hits", hit)]))

    return run


def _searched_on(scratch: Scratch, placed: DataFrame, found: DataFrame) -> DataFrame:
    """found(host, key, other, shared), where pages that still need others have searched their host to its end.

    A round goes twice as far as the one before. Pages that ask, by blocks, meet one block of others in a task, so a task holds two blocks at most.
    """
    page = placed.withColumn("block", F.floor(F.col("pos") / PAGES)).select(F.col("grp").alias("host"), "key", "other", "pos", "n", "block", "h", "sizes", "flags")
    more = lambda near: (F.col("need") > 0) & ((F.col("pos") > near) | (F.col("pos") + near < F.col("n") - 1))
    ids = ["host", "key", "other"]
    asking = scratch.save(found.where("need > 0").join(page, ids).where(more(REACH)), "asking")
    if asking.isEmpty():
        return found.select(*ids, "shared")
    done = [found.join(asking.select(*ids), ids, "left_anti").select(*ids, "shared")]
    near, far = REACH, PAGES
    while True:
        last = F.floor((F.col("n") - 1) / PAGES)
        blocks = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
        at = lambda p: F.floor(p / PAGES)
        left = F.when(F.col("pos") > near, blocks(at(F.greatest(F.col("pos") - far, F.lit(0))), at(F.col("pos") - near - 1)))  # noqa: B023
        right = F.when(F.col("pos") + near < F.col("n") - 1, blocks(at(F.col("pos") + near + 1), F.least(at(F.col("pos") + far), last)))  # noqa: B023
        none = F.array().cast("array<bigint>")
        asked = asking.withColumn("to", F.explode(F.array_union(F.coalesce(left, none), F.coalesce(right, none))))
        columns = ["pos", "key", "other", "h", "sizes", "flags"]
        asked = asked.select(F.col("host").alias("grp"), F.col("block").alias("from"), "to", *columns, "need")
        met = asked.select("grp", "from", "to").distinct().join(page.withColumnRenamed("block", "to").withColumnRenamed("host", "grp"), ["grp", "to"])
        pairs = asked.unionByName(met.select("grp", "from", "to", *columns, F.lit(0).alias("need")))
        hits = pairs.groupBy("grp", "from", "to").applyInArrow(_farther(near, far), "host string, key long, other long, hits array<struct<distance:long,after:boolean,lines:array<int>>>")
        hits = hits.groupBy(*ids).agg(F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"))  # at most `need` a block
        taken = F.slice(F.coalesce("hits", F.array().cast("array<struct<distance:bigint,after:boolean,lines:array<int>>>")), F.lit(1), F.col("need"))
        went = asking.join(hits, ids, "left").withColumn("taken", taken)
        went = went.withColumn("shared", F.array_distinct(F.concat("shared", F.flatten(F.transform("taken", lambda x: x["lines"]))))).withColumn("need", F.col("need") - F.size("taken"))
        went = scratch.save(went.drop("hits", "taken"), "asking")
        done.append(went.where(~more(far)).select(*ids, "shared"))
        asking = went.where(more(far))
        if asking.isEmpty():
            return reduce(DataFrame.unionByName, done)
        near, far = far, 2 * far


def shared_of(spark: SparkSession, parsed: DataFrame, structure: bool = True, nearest: int = NEAREST) -> DataFrame:
    """(host, key, other, shared): the lines of each html of a host that pages near it share. Without `structure` all lines are compared, else those outside an article."""
    scratch = Scratch(spark, "pages")
    narrow = F.struct("path", "page_id", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"), F.transform("lines", lambda x: F.length(x)).alias("sizes"), "flags")
    once = parsed.where(F.col("host") != "").groupBy("host", "key", "other").agg(F.min(narrow).alias("p")).select(F.col("host").alias("grp"), "key", "other", "p.*").drop("page_id")
    placed = numbered(scratch, once, ["path", "key", "other"])
    block, at = F.floor(F.col("pos") / PAGES), F.col("pos") % PAGES
    copies_to = [F.struct(block.alias("block"), F.lit(False).alias("halo")), F.when((at < REACH) & (block > 0), F.struct((block - 1).alias("block"), F.lit(True).alias("halo"))), F.when(at >= PAGES - REACH, F.struct((block + 1).alias("block"), F.lit(True).alias("halo")))]
    dealt = placed.withColumn("to", F.explode(F.filter(F.array(*copies_to), lambda x: x.isNotNull()))).select("grp", "key", "other", "path", "h", "sizes", "flags", "pos", "to.block", "to.halo")
    found = dealt.groupBy("grp", "block").applyInArrow(_differenced(structure, nearest), "host string, key long, other long, shared array<int>, need int")
    return _searched_on(scratch, placed, scratch.save(found, "shared"))


def extract(spark: SparkSession, pages: DataFrame, structure: bool = True, nearest: int = NEAREST) -> DataFrame:
    """page_id, url, text, n_chars (code points), n_shared (lines that pages near it share) and n_marked (others that their elements let go) of every page.

    Null and empty html have the empty text. Pages without a URL, and those whose html is the only one of their host, have no neighbour, and nothing of them counts as shared.
    Repeated rows are extracted each. Without `structure` differencing alone decides. Other columns aren't read.
    """
    address = F.coalesce(F.col("url"), F.lit(""))
    page = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url",
        F.lower(F.regexp_extract(address, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"),
        F.xxhash64(page).alias("key"), F.xxhash64(F.lit(1), page).alias("other"), page.alias("html"),
    )
    parsed = rows.mapInArrow(_parsed, "page_id long, url string, host string, path string, key long, other long, lines array<string>, flags array<int>")
    found = shared_of(spark, parsed, structure, nearest)
    has_main = F.lit(structure) & F.exists("flags", lambda f: f == _MAIN)
    # lines that can't stay whatever is shared go before rows move
    text = F.transform("lines", lambda x, i: F.when(~F.lit(structure) | (F.get("flags", i).bitwiseAND(_BOILER) == 0) & (~F.col("has_main") | (F.get("flags", i).bitwiseAND(_MAIN) > 0)), x))
    light = parsed.withColumn("has_main", has_main).select("page_id", "url", "host", "key", "other", "has_main", text.alias("lines"))
    joined = light.join(found.hint("merge"), ["host", "key", "other"], "left")  # found grows with the pages
    joined = joined.withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))
    stays = lambda x, i: F.when(F.col("has_main") | ~F.array_contains("shared", i), x)
    kept = F.filter(F.transform("lines", stays), lambda x: x.isNotNull())
    out = joined.select("page_id", "url", F.array_join(kept, "\n").alias("text"), F.size("shared").cast("long").alias("n_shared"), (F.size("lines") - F.size(kept)).cast("long").alias("gone"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", F.greatest(F.col("gone") - F.col("n_shared"), F.lit(0)).alias("n_marked"))
