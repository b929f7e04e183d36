"""The pipeline's stages, each held against what its operator says of its input."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from replyloom.llm.common import cut_lineage
from replyloom.llm.credentials import base_spans

from .conftest import SMALL
from .test_fingerprints import brute_fingerprint, brute_groups
from .test_tokens import check_packing


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("found", F.lit("own")).withColumn("toxicity", F.lit("own"))
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SMALL)))
    return out


def ids(df):
    return {r[0] for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.schema == stages[0].schema


def test_filters_keep_most(stages):
    n = [df.count() for df in stages[:3]]
    assert n[0] >= n[1] >= 0.8 * n[0] and n[1] >= n[2] >= 0.95 * n[1]


def test_one_document_of_each_group_stays(stages):
    rows = stages[2].select("doc_id", "text").orderBy("doc_id").collect()
    group = brute_groups([brute_fingerprint(r["text"]) for r in rows], 4)
    firsts = {}
    for g, r in zip(group, rows):
        firsts.setdefault(g, r["doc_id"])
    assert ids(stages[3]) == set(firsts.values()) and stages[3].count() == len(firsts)


def test_secrets_are_gone(stages):
    before = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    after = {r["doc_id"]: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    for doc_id, text in before.items():
        if not base_spans(text):
            assert after[doc_id]["text"] == text
        assert not [s for s in base_spans(after[doc_id]["text"])]
        assert after[doc_id]["n_chars"] == len(after[doc_id]["text"])
    assert any(re.search(r"\[SECRET\]", r["text"]) for r in after.values()) == any(map(base_spans, before.values()))


def test_packing_holds_what_is_left(stages):
    check_packing(stages[4], stages[5].collect(), (64, 128, 256, 512, 1024))


def test_run_and_registration(spark, stages):
    queries = entry.queries()
    assert queries["pipeline"] is corpus_pipeline.run
    assert sorted(n for n in queries if n.startswith("op") and n[2].isdigit()) == sorted(
        ["op1_syncmers", "op2_packing", "op3_credentials", "op4_ngram_lm", "op5_toxicity", "op6_language", "op7_token_counts", "op8_simhash",
         "op9_block_topk", "op10_chunk_bpe", "op11_whitening", "op12_phrases", "op13_piece_words"])
    rows = corpus_pipeline.run(spark, SMALL).collect()
    expected = Counter((r["doc_id"], r["doc_tokens"]) for r in stages[5].select("doc_id", "doc_tokens").distinct().collect())
    assert Counter({(r["doc_id"], r["doc_tokens"]) for r in rows}) == expected


def test_odd_and_empty_tables(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = cut_lineage(stage(spark, docs, SMALL))
            assert found.columns == docs.columns and found.count() <= docs.count()
        assert corpus_pipeline.packing(spark, docs, SMALL).count() >= docs.count()
