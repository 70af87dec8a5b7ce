"""The queries opN_<name> over the whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balltree, exact_dedup, html_text, lexical, license_scan, line_dedup, merkle, mixing, ngram_join, packing, quality, sstable, toxicity
from .common import read
from .tokens import default_tokenizer

WORD = line_dedup.WORD

#: Mixing: target weights of languages (others 1) and the seed; sources and domains of a level weigh the same.
LANGUAGE_WEIGHT = {"en": 5, "de": 2, "fr": 2, "es": 1}
MIX = {"fraction": 0.6, "max_epochs": 2, "seed": 11}


def tree() -> dict:
    """Domain, language and source of a document: a domain is four neighbouring source numbers."""
    number = F.regexp_extract(F.col("source"), r"(\d+)$", 1).try_cast("int")
    domain = F.coalesce(F.concat(F.lit("d"), (number - number % 4).cast("string")), F.lit("other"))
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def weights() -> dict:
    lang = F.lit(1)
    for name, weight in LANGUAGE_WEIGHT.items():
        lang = F.when(F.col("lang") == name, F.lit(weight)).otherwise(lang)
    return {"domain": F.lit(1), "lang": lang, "source": F.lit(1)}


def words() -> object:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(spark, read(spark, sf_dir, "documents"), default_tokenizer(), 2048, 0)
    digests = packed.pieces.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(packed.placements, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.lit(packed.sequences).alias("sequences"), F.lit(packed.bound).alias("lower_bound"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), balltree.quantised(F.col("embedding")).alias("v"))
    return balltree.top_k(spark, vectors, vectors.where("id % 20 = 0"), 20)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark, read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(spark, read(spark, sf_dir, "documents"))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(spark, read(spark, sf_dir, "documents"), default_tokenizer(), 1)
    return sstable.read_shards(spark, manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(spark, read(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicate_lines(spark, read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", F.coalesce("text", F.lit("")).alias("text"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix(spark, docs, tree(), weights(), words(), **MIX).select("doc_id", "lang", "source", "epoch")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), 10).withColumnRenamed("id", "doc_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(spark, read(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(spark, read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


OP6_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def _op10_sql() -> str:
    lang = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LANGUAGE_WEIGHT.items()) + " ELSE 1 END"

    def level(name: str, path: str, parent: str, above: str, weight: str) -> str:
        on = " AND ".join(f"s.{c} = p.{c}" for c in parent.split(", ")) if parent else "true"
        by = f"PARTITION BY {parent}" if parent else ""
        return f"""
        {name}_n AS (SELECT {path}, sum(supply) AS supply, CAST({weight} AS DOUBLE) AS weight FROM leaf GROUP BY {path}),
        {name}_c AS (SELECT s.*, p.budget, (p.budget - coalesce(sum(supply) OVER (PARTITION BY {("s." + parent.replace(", ", ", s.")) if parent else "1"} ORDER BY supply / weight, s.{name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(weight) OVER (PARTITION BY {("s." + parent.replace(", ", ", s.")) if parent else "1"} ORDER BY supply / weight, s.{name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS candidate
               FROM {name}_n s JOIN {above} p ON {on}),
        {name}_b AS (SELECT {path}, round(greatest(0, least(supply, max(candidate) OVER ({by}) * weight)), 6) AS budget FROM {name}_c)"""

    return f"""
    WITH u AS (
      SELECT doc_id, lang AS lang0, source AS source0, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             coalesce('d' || (TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) - TRY_CAST(regexp_extract(source, '(\\d+)$', 1) AS INT) % 4)::VARCHAR, 'other') AS domain,
             len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n
      FROM documents),
    leaf AS (SELECT domain, lang, source, sum(n) AS tokens, sum(n)::DOUBLE * {MIX["max_epochs"]} AS supply FROM u GROUP BY ALL),
    root AS (SELECT floor(sum(tokens) * {MIX["fraction"]})::DOUBLE AS budget FROM leaf),
    {level("domain", "domain", "", "root", "1")},
    {level("lang", "domain, lang", "domain", "domain_b", lang)},
    {level("source", "domain, lang, source", "domain, lang", "lang_b", "1")},
    plan AS (
      SELECT leaf.domain, leaf.lang, leaf.source, tokens, floor(b.budget + 0.001)::BIGINT AS budget
      FROM leaf JOIN source_b b ON leaf.domain = b.domain AND leaf.lang = b.lang AND leaf.source = b.source),
    ends AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest FROM plan),
    placed AS (
      SELECT u.*, whole, rest, ('0x' || substr(md5('{MIX["seed"]}:' || whole::VARCHAR || ':' || doc_id::VARCHAR), 1, 12))::BIGINT AS place
      FROM u JOIN ends e ON u.domain = e.domain AND u.lang = e.lang AND u.source = e.source),
    taken AS (
      SELECT *, whole + CASE WHEN rest > 0 AND sum(n) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id, n) <= rest THEN 1 ELSE 0 END AS copies FROM placed)
    SELECT doc_id, lang0 AS lang, source0 AS source, unnest(range(0, copies::BIGINT)) AS epoch FROM taken WHERE copies > 0
    """


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_top_k": op3_top_k,
    "op4_quality": op4_quality,
    "op5_main_text": op5_main_text,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_token_shards": op7_token_shards,
    "op8_ngram_join": op8_ngram_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_source_mixing": op10_source_mixing,
    "op11_ranked_search": op11_ranked_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_license_scan": op13_license_scan,
}


def oracle_sql() -> dict[str, str]:
    return {"op3_top_k": OP3_SQL, "op6_exact_dedup": OP6_SQL, "op8_ngram_join": ngram_join.oracle(), "op9_line_dedup": line_dedup.oracle(), "op10_source_mixing": _op10_sql()} | {
        "op11_ranked_search": lexical.oracle(),
        "op12_merkle_manifest": merkle.oracle(),
        "op13_license_scan": license_scan.oracle(),
    }
