"""The corpus pipeline: every stage works on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgauge.llm import bpe, exact_dedup, jaccard, mixing, quality, queries
from firmgauge.llm.common import located, on_files, sent, stored, table, without_rows

#: Nearly all tokens are taken once: a source loses documents only where its weight asks for less than it has.
MIX = mixing.Mix(budget=0.95, epochs=1, weights={"lang": {"en": 4.0, "de": 1.0, "fr": 1.0, "es": 1.0}})


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns in ``row``, beside those that stages work on: new columns can't clash."""
    return docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang", "source")


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality(packed(docs), keep=["row"]).where("kept").select("row.*")


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.exact_dedup(docs)


def apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, the one with the smallest id.

    Rows of one id go together; a row without an id stays.
    """
    found = stored(jaccard.near_duplicates(docs).where("id <> component_id").select(F.col("id").alias("doc_id")).distinct(), "near")
    return docs.join(sent(found), "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the budgets of domain, language and source take; with one epoch each at most once."""
    placed, file, row = located(on_files(docs))
    # Only the places of the documents go through the operator, not their texts.
    narrow = placed.select(F.struct(file, row).alias("row"), "doc_id", "text", "lang", "source")
    taken = mixing.mix_documents(queries.with_domain(narrow), ["domain", "lang", "source"], MIX, keep=["row"])
    return without_rows(placed, taken.where("copies = 0").select("row.*"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every text, and the number of them."""
    lines = bpe.read_lines(public_tokenizers.path(queries.RANKS))
    keep = [c for c in docs.columns if c.lower() not in ("ids", "n_tokens")]
    ids = bpe.encode(docs, lines, public_tokenizers.PATTERN, keep=keep, apart_at_spaces=True)
    return ids.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality", good), ("exact", distinct), ("near", apart), ("mix", mixed), ("bpe", encode)]
#: The stages can't be told in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
