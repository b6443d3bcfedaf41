"""Corpus pipeline over ``documents``: toxicity, quality rules, near-dedup, suffix dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the
last return the columns of ``documents``. There is no SQL counterpart: tests compare the stages
with brute-force versions.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from codelattice.llm import packing, rule_cascade, simhash_vptree, suffix_merge, toxicity
from codelattice.llm.common import read_table, staged


#: Words of the shortest passage whose repeats are cut. It has a byte and a space for each word at least.
PASSAGE_WORDS = 51


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar accepts; labels of the table train it."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base test and the rule cascade."""
    return rule_cascade.reject(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return simhash_vptree.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of over 50 words, or of 400 bytes or more, that occur again (whole characters only)."""
    return suffix_merge.remove_repeats(docs, length=2 * PASSAGE_WORDS - 1, least_words=PASSAGE_WORDS)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fixed windows of ids; one row per piece."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", packing.crc_of("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", reject_toxic),
    ("quality rules", apply_rules),
    ("SimHash near-dedup", one_of_each_group),
    ("suffix-array dedup", cut_repeats),
    ("packing", pack_documents),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        docs = staged(stage(spark, docs, sf_dir), f"stage_{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
