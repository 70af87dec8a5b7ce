"""The corpus pipeline: quality, exact and near copies, mixing, packing, each stage on what the one before kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from joinscout.llm import exact_dedup, mixing, ngram_join, packing, quality, queries
from joinscout.llm.common import Scratch, read
from joinscout.llm.tokens import default_tokenizer

#: The mixture takes four fifths of the tokens that are left, no document twice.
MIX = {"fraction": 0.8, "max_epochs": 1, "seed": 11}
CAPACITY = 2048
#: Words that the encoder caches, half of its default: its workers have gone through the other stages before.
WORDS = 200_000


_finished: list[Scratch] = []


def staged(f):
    """A stage is called when the one before it has been written, so the working tables of that one are deleted first."""

    @functools.wraps(f)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _finished:
            _finished.pop().drop()
        before = len(Scratch.made)
        out = f(spark, docs, sf_dir)
        _finished.extend(Scratch.made[before:])
        return out

    return stage


@staged
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.keep_good(spark, docs, read(spark, sf_dir, "labels"))


@staged
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest id of each text."""
    return exact_dedup.deduplicate(spark, docs)


@staged
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of similar texts."""
    return ngram_join.keep_one(spark, docs)


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights of domains, languages and sources take."""
    return mixing.mix(spark, docs, queries.tree(), queries.weights(), queries.words(), **MIX).drop("epoch")


@staged
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences."""
    packed = packing.pack_documents(spark, docs, default_tokenizer(), CAPACITY, 0, WORDS)
    digests = packed.pieces.select("uid", "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return digests.join(packed.placements, "uid").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack),
]

#: Tokenizing and packing can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
