"""Documents to packed sequences: five stages, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgtide.llm import common, mixing, packing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rules reject.

    Null and empty texts have too few words and go; very long ones are judged
    whole; columns stay as they are, whatever their names; a null lang is a stratum of
    its own; repeated rows and null ids are judged each on its own; an empty table
    stays empty.  Without enough labels only the base rules reject.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: that with the smallest id,
    null last; of several texts with that id the one with the smallest hash, and of
    repeated rows one.  Null and empty texts are alike; very long ones are read
    whole; columns stay as they are; an empty table stays empty.
    """
    return simhash.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; keeps every row, null and empty texts and
    repeated rows as they are.  Very long texts are searched whole; n_chars follows
    the text and other columns stay; an empty table stays empty.
    """
    return pii.redact_table(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents as the mix does, repeats as rows of their own.

    A null source is one of its own; texts without words are never taken; very long
    texts may be cut between words; ties in the apportionment go by name; other
    columns stay; an empty table stays empty.
    """
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 2048 tokens.

    A null or empty text is the end id alone; very long texts are cut into pieces;
    other columns are left out; repeated rows and null ids are packed
    each on its own; an empty table gives an empty result.
    """
    return packing.op1_packing(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("redact_pii", redact_pii),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SimHash links, redaction parsers and subword ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are written and reread; what a stage wrote on the way is
    removed after it, and its predecessor's rows after the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = common.made()
    for name, stage in STAGES:
        docs = common.cut(stage(spark, docs, sf_dir), name)
        common.sweep(spark, [*before, common.made()[-1]])
    return docs
