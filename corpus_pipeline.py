"""The corpus pipeline: quality rules, near-duplicate join, benchmark decontamination, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
documents. Nulls in any column, empty texts, repeated rows and extra columns pass as the operators define them: a row with a
null doc_id can be rejected by the rules, but is never a duplicate or contaminated."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastertables.llm import bpe, decontaminate, jaccard, quality
from rastertables.llm.common import materialize, table


#: Near duplicates share this percentage of their shingles of so many words; op5's contract has its own figures.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the newest policy rejects."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), "text")
    return quality.apply_policy(quality.ledger(rows), quality.POLICIES[-1], "_kept").where("_kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that hang together by links, the one with the smallest doc_id, once. Rows that share a doc_id stay where
    their texts differ and no smaller doc_id has a near copy."""
    kept = jaccard.join(docs, percent=NEAR_PERCENT, words=NEAR_WORDS).where("component_id = doc_id").select(F.col("doc_id").alias("_id"))
    one = docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi")
    marks = {"_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")}   # Equal rows without shuffling by whole texts
    return one.withColumns(marks).dropDuplicates(["doc_id", *marks]).drop(*marks).unionAll(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("bpe_encoding", encoding)]
#: SQL cannot merge byte pairs; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
