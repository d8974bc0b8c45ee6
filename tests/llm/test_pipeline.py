"""The pipeline stage by stage against what each stage has to keep."""

import re

import pytest

import corpus_pipeline
from logloom.llm.common import write_once
from logloom.llm.secret_scan import MARK, scan_secrets

SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = write_once(stage(spark, docs, SF_CHECK), f"test-{name}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stage_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "simhash", "secrets", "packing"]
    for df in stages[1:5]:
        assert df.columns == stages[0].columns


def test_quality_keeps_clean_documents(spark, stages):
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{SF_CHECK}/labels.parquet").collect()}
    kept = texts(stages[1])
    clean = [d in kept for d, g in labels.items() if g == (1, 0)]
    poor = [d in kept for d, g in labels.items() if g != (1, 0)]
    assert sum(clean) / len(clean) >= 0.98 and sum(poor) / len(poor) <= 0.1


def test_copies_go(stages):
    before, after = texts(stages[1]), texts(stages[2])
    squeeze = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert {squeeze(t) for t in before.values()} == {squeeze(t) for t in after.values()}
    assert len({squeeze(t) for t in after.values()}) == len(after)
    assert texts(stages[3]).items() <= after.items() and len(texts(stages[3])) < len(after)


def test_secrets_are_replaced(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert before.keys() == after.keys()
    changed = [d for d in before if before[d] != after[d]]
    assert changed and all(MARK in after[d] for d in changed)
    assert scan_secrets(stages[4]).where("spans <> ''").count() == 0


def test_every_document_is_packed(stages):
    sizes = {r.doc_id: r.n for r in stages[5].groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    whole = {r.doc_id: r.doc_tokens for r in stages[5].select("doc_id", "doc_tokens").distinct().collect()}
    assert sizes == whole and sizes.keys() == texts(stages[4]).keys()


def test_awkward_documents_pass(spark, awkward, no_documents):
    for docs in (awkward, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = write_once(stage(spark, docs, SF_CHECK), f"awkward-{name}")
            assert name == "packing" or docs.columns == before
