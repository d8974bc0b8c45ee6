"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of documents. ``docs`` is a stored table, so a row's number
in reading order names it within a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from logloom.llm.common import read_table, rows_numbered, write_once
from logloom.llm.exact_dedup import exact_dedup
from logloom.llm.packing import bm25_pack
from logloom.llm.quality import quality_scores
from logloom.llm.secret_scan import redact_secrets
from logloom.llm.simhash import simhash_components


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose probability of the top grade is below the operator's bound."""
    plain = docs.toDF(*[f"c{i}" if c in ("expected_grade", "p_top", "kept") else c for i, c in enumerate(docs.columns)])
    scored = quality_scores(plain, read_table(spark, sf_dir, "labels"))
    return scored.where("kept").select(*plain.columns).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one row stays."""
    return rows_numbered(docs, exact_dedup(docs).where("kept").select("rid"))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row with the smallest doc_id stays."""
    return rows_numbered(docs, simhash_components(docs).where("rid = keep_rid").select("rid"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a sequence, with its token ids."""
    return bm25_pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("simhash", simhash), ("secrets", secrets), ("packing", packing)]

# Scores, signatures and tokens have no DuckDB equivalent; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_once(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
