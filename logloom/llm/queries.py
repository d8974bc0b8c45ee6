"""The registered queries: each applies one operator, with its production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from logloom.llm.common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


@query("op9_exact_dedup", """
with t as (select doc_id, length(coalesce(text, '')) as chars,
             regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as body from documents),
g as (select body, count(*) as group_size, arg_min(doc_id, (-chars, doc_id)) as keep_id from t group by body)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.body) as text_sha256
from t join g on t.body = g.body
""")
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.exact_dedup import exact_dedup

    out = exact_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.simhash import simhash_components

    out = simhash_components(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "fingerprint", "component_id")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logloom.llm.packing import bm25_pack

    return bm25_pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.quality import quality_scores

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_scores(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "expected_grade", "p_top", "kept")


@query("op5_secrets")
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.secret_scan import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents"))


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.licenses import scan_licenses

    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logloom.llm.pieces import encode_nbest

    return encode_nbest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from logloom.llm.line_dedup import line_dedup

    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_blocks", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_nearest")
def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.suffix_dedup import suffix_dedup

    return suffix_dedup(read_table(spark, sf_dir, "documents"), with_kept=False)


@query("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.spelling import spelling_groups

    return spelling_groups(read_table(spark, sf_dir, "documents"))


@query("op12_token_counts")
def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from logloom.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op13_importance")
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logloom.llm.importance import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
