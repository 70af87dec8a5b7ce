"""Licence scans: a positional index of the templates' rare words, lookup by a file's own licence words, and key phrases verified in place.

A template is a sequence of words with mandatory key phrases at fixed places in it. Words' inverse document frequencies are of all
documents. The index lists a template under the highest-IDF words of its key phrases, with their places. A file's licence words, rarest
first, are looked up; where a template's words stand in the file gives start positions, one list a word, and the intersection of the
lists leaves the starts at which the words stand in their relative places. There the key phrases are compared word by word. As key
phrases are mandatory, no place is lost by going through their rarest words.

Everything is an expression over the row of a document, so nothing is shuffled but the counts of words. All of it is DataFrame functions.

Defined results: null and empty texts have no words, no label, score 0; the score is the largest share, by IDF, of a found template's words that
stand in place (1 for a whole one). Rows that repeat are rows of their own; other columns are ignored.
"""

from __future__ import annotations

import re
from math import floor, log
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: What stands between words, once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Licence texts (label, text with key phrases in braces).
TEMPLATES = (
    ("agpl", "{gnu affero general public license}"),
    ("apache", "{apache license} version 2 0"),
    ("apache", "{licensed under the apache license} version 2 0 the license you may not use this file except in compliance with the license"),
    ("artistic", "{the artistic license} 2 0"),
    ("boost", "{boost software license} version 1 0"),
    ("bsd", "{bsd} 3 clause {license}"),
    ("bsd", "{bsd license}"),
    ("bsd", "{redistribution and use in source and binary forms} with or without modification {are permitted provided that}"),
    ("cc-by-nc", "{cc by nc} 4 0"),
    ("cc-by-nc", "creative commons {attribution noncommercial}"),
    ("cc-by-nd", "{cc by nd} 4 0"),
    ("cc-by-sa", "{cc by sa} 4 0"),
    ("cc-by-sa", "creative commons {attribution sharealike}"),
    ("cc0", "{cc0} 1 0 universal"),
    ("eclipse", "{eclipse public license}"),
    ("gpl", "{gnu general public license} version 3"),
    ("gpl", "{gnu gpl}"),
    ("isc", "{isc license}"),
    ("isc", "{permission to use copy modify and} or {distribute this software for any purpose} with or without fee is hereby granted"),
    ("lgpl", "{gnu lesser general public license}"),
    ("lgpl", "{gnu library general public license}"),
    ("mit", "released under the {mit license}"),
    ("mit", "{spdx license identifier mit}"),
    ("mit", "{permission is hereby granted free of charge to any person obtaining a copy of this software} and associated documentation files"),
    ("mpl", "{mozilla public license} version 2 0"),
    ("proprietary", "{proprietary and confidential}"),
    ("public-domain", "{released into the public domain}"),
    ("unlicense", "{free and unencumbered software} released into the public domain"),
    ("zlib", "{provided as is without any express or implied warranty} in no event will the authors be held liable"),
)

#: Index words of a template at most.
RARE = 4


class Template(NamedTuple):
    label: str
    words: tuple[str, ...]
    #: (place, words) of each key phrase.
    phrases: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool = False


def template(label: str, text: str, base: bool = False) -> Template:
    """A template of a text in lower-case words, with its key phrases in braces."""
    words, phrases = [], []
    for part in re.findall(r"\{[^}]*\}|[^{}]+", text):
        some = part.strip("{}").split()
        if part.startswith("{"):
            phrases.append((len(words), tuple(some)))
        words += some
    if not phrases or any(re.search(NOT_WORD, w) for w in words):
        raise ValueError(f"template {text!r} needs a key phrase and words that a file can have")
    return Template(label, tuple(words), tuple(phrases), base)


def templates() -> list[Template]:
    return [*(template(label, f"{{{text}}}", True) for text, label in BASE.items()), *(template(label, text) for label, text in TEMPLATES)]


def words_of(text: Column) -> Column:
    """Cut between words, which takes half the time of matching words; no text stands before the first or after the last separator."""
    plain = F.length(text) == F.octet_length(text)  # of ASCII alone, for which lower() is the same and faster
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(ascii_lower(text)), NOT_WORD), "")


def idf(docs: DataFrame, known: list[Template], text_col: str = "text") -> dict[str, int]:
    """floor(1000 ln((2N + 2) / (2 df + 1))), 1 at least, of each word of the templates, over all documents; the driver gets a number a template's word."""
    vocabulary = sorted({w for t in known for w in t.words})
    found = docs.select(F.explode(F.array_intersect(words_of(F.col(text_col)), _array(vocabulary))).alias("word"))
    df = {r.word: r["count"] for r in found.groupBy("word").count().collect()}
    n = docs.count()
    return {w: max(1, floor(1000 * log((2.0 * n + 2) / (2 * df.get(w, 0) + 1)))) for w in vocabulary}


class Posting(NamedTuple):
    template: int
    #: Highest-IDF words of the key phrases with one place each, rarest first.
    rare: tuple[tuple[str, int], ...]


def index(known: list[Template], weights: dict[str, int]) -> list[Posting]:
    """The templates' postings: words by falling IDF (then by letters), each with its first place in the key phrases."""
    out = []
    for i, t in enumerate(known):
        places: dict[str, int] = {}
        for at, phrase in t.phrases:
            for j, w in enumerate(phrase):
                places.setdefault(w, at + j)
        out.append(Posting(i, tuple(sorted(places.items(), key=lambda x: (-weights[x[0]], x[0]))[:RARE])))
    return out


def _words(words) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in words) + ")"


def _array(words) -> Column:
    return F.expr(_words(words))


def starts_of(t: Template, p: Posting) -> Column:
    """Starts (from 0, of the template's first word) at which the index words are in their relative places and all key phrases stand."""
    lists = [f"transform(filter(places, x -> x.w = '{w}'), x -> x.i - {at})" for w, at in p.rare]
    met = lists[0]
    for other in lists[1:]:
        met = f"array_intersect({met}, {other})"
    stands = [f"s + {t.phrases[0][0]} >= 0", *[f"slice(words, greatest(s + {at + 1}, 1), {len(phrase)}) = {_words(phrase)}" for at, phrase in t.phrases]]
    return F.expr(f"CASE WHEN array_contains(present, '{p.rare[0][0]}') THEN filter(array_distinct({met}), s -> {' AND '.join(stands)}) ELSE CAST(array() AS array<int>) END")


def share(t: Template, weights: dict[str, int], starts: str) -> Column:
    """Largest share by IDF of the template's words that are in place at a start; 0 without one."""
    got = [f"CASE WHEN try_element_at(words, nullif(greatest(s + {at + 1}, 0), 0)) = '{w}' THEN {weights[w]}L ELSE 0L END" for at, w in enumerate(t.words)]
    return F.expr(f"coalesce(array_max(transform({starts}, s -> ({' + '.join(got)}) / {sum(weights[w] for w in t.words)}L)), 0.0D)")


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """(id, n_words, base_starts, n_base, first_word, last_word, base_labels, labels, score) of every document; labels are sorted arrays."""
    known = known if known is not None else templates()
    weights = idf(docs, known, text_col)
    postings = index(known, weights)
    rarest = sorted({p.rare[0][0] for p in postings}, key=lambda w: (-weights[w], w))
    rows = docs.select(F.col(id_col), words_of(F.col(text_col)).alias("words"))
    # the file's words that are the rarest of a template, highest IDF first; a file without any has no template
    rows = rows.withColumn("present", F.array_intersect(_array(rarest), F.col("words")))
    wanted = F.array_distinct(F.flatten(F.array(*[F.when(F.array_contains("present", p.rare[0][0]), _array(w for w, _ in p.rare)).otherwise(F.array().cast("array<string>")) for p in postings])))
    rows = rows.withColumn("wanted", F.when(F.size("present") > 0, wanted))
    numbered = F.transform("words", lambda w, i: F.when(F.array_contains("wanted", w), F.struct(w.alias("w"), i.alias("i"))))
    nothing = F.array().cast("array<struct<w:string,i:int>>")
    rows = rows.withColumn("places", F.when(F.size("present") > 0, F.filter(numbered, lambda x: x.isNotNull())).otherwise(nothing))
    rows = rows.withColumns({f"s{i}": starts_of(t, p) for i, (t, p) in enumerate(zip(known, postings, strict=True))})
    every = [(t, F.col(f"s{i}")) for i, t in enumerate(known)]
    score = F.greatest(*[share(t, weights, f"s{i}") for i, t in enumerate(known)])
    base = [(t, s) for t, s in every if t.base]
    first, last = F.array_min(F.concat(*[s for _, s in base])), F.array_max(F.concat(*[s for _, s in base]))

    def labels(some) -> Column:
        found = F.array(*[F.when(F.size(s) > 0, F.lit(t.label)) for t, s in some])
        return F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull())))

    return rows.select(
        id_col, F.size("words").cast("long").alias("n_words"), F.array_sort(F.concat(*[s for _, s in base])).alias("base_starts"), sum([F.size(s) for _, s in base], F.lit(0)).cast("long").alias("n_base"),
        first.cast("long").alias("first_word"), last.cast("long").alias("last_word"), labels(base).alias("base_labels"), labels(every).alias("labels"), score.alias("score"),
    )


def oracle() -> str:
    """The same by joining all words of all documents with all words of the templates and grouping by start."""
    known = templates()
    words, needed = [], []
    for i, t in enumerate(known):
        must = {at + j for at, p in t.phrases for j in range(len(p))}
        words += [f"({i}, {j}, '{w}', {str(j in must).lower()})" for j, w in enumerate(t.words)]
        needed.append(f"({i}, '{t.label}', {str(t.base).lower()}, {len(must)}, {len(t.words)}, {t.phrases[0][0]})")
    return f"""
    WITH t(t, label, base, n_must, n_all, first) AS (VALUES {", ".join(needed)}),
    tw(t, rel, w, must) AS (VALUES {", ".join(words)}),
    d AS (SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    x AS (SELECT uid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS i FROM d),
    f AS (SELECT w, greatest(floor(1000 * ln((2 * (SELECT count(*) FROM documents) + 2)::DOUBLE / (2 * (SELECT count(DISTINCT uid) FROM x WHERE x.w = v.w) + 1)::DOUBLE))::BIGINT, 1) AS idf FROM (SELECT DISTINCT w FROM tw) v),
    total AS (SELECT t, sum(idf) AS total FROM tw JOIN f USING (w) GROUP BY t),
    m AS (SELECT uid, t, i - rel AS s, count(*) FILTER (must) AS n_must, sum(idf) AS got FROM x JOIN tw USING (w) JOIN f USING (w) GROUP BY ALL),
    found AS (SELECT m.uid, m.t, m.s, t.label, t.base, m.got::DOUBLE / total.total::DOUBLE AS part FROM m JOIN t ON m.t = t.t AND m.n_must = t.n_must JOIN total ON m.t = total.t),
    g AS (SELECT uid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word,
      list_sort(list_distinct(list(label) FILTER (base))) AS base_labels, list_sort(list_distinct(list(label))) AS labels, max(part) AS score FROM found GROUP BY uid)
    SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
      coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
    FROM d LEFT JOIN g ON d.uid = g.uid
    """
