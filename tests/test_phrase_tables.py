"""Phrase tables against lexicons, in one shard and in many."""

import random

import pytest
from pyspark.sql import functions as F

from replyloom.functions import lexicon as lx
from replyloom.operators import phrase_tables as pt

PHRASES = {
    "b": ["refund", "fund", "re fund", "fund", "", "é"],
    "a": ["late", "too late", "late ", "字字", "x y z"],
    "c": ["fun", "never there"],
}
TEXTS = ["Too late for a REFUND", "re fund é", "", None, "字字字 fun", "x y z x y z late", "nothing", "late " * 5000]


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(3)
    pieces = ["fund", "re", " ", "late", "too ", "é", "字", "x", " y", " z", "fun", "  "]
    more = ["".join(rnd.choices(pieces, k=rnd.randint(0, 25))) for _ in range(150)]
    return spark.createDataFrame(
        [(i, t, "mine", 0) for i, t in enumerate([*TEXTS, *more])], "id int, text string, class string, single int")


def rows(phrases):
    return [(name, order, p, i) for order, (name, ps) in enumerate(phrases.items()) for i, p in enumerate(ps)]


def same(ours, theirs):
    assert ours.columns == theirs.columns
    assert sorted(ours.collect(), key=lambda r: r["id"]) == sorted(theirs.collect(), key=lambda r: r["id"])


@pytest.mark.parametrize("shard, empty", [(2_000_000, False), (90, True)])
def test_equals_a_lexicon(spark, texts, shard, empty):
    phrases = {k: [p for p in ps if p or empty] for k, ps in PHRASES.items()}
    lexicon = lx.Lexicon(phrases)
    listed = spark.createDataFrame(
        [*rows(phrases), (None, 1, "late", 0), ("a", 1, None, 0)],
        "class string, class_ord int, phrase string, phrase_ord int")
    table = pt.PhraseTable(listed, shard)
    assert (table.shards > 2) == (shard == 90)
    same(pt.match_phrases(texts, "text", table), lx.match_lexicon(texts, "text", lexicon).withColumn(
        "classes", F.coalesce("classes", F.array().cast("array<string>"))))
    same(pt.label_by_phrases(texts, "text", table), lx.label_weakly(texts, "text", lexicon))
    same(pt.add_phrase_candidate(texts, "text", table), lx.add_candidate(texts, "text", lexicon))
    same(pt.rank_phrase_candidates(texts, "text", table), lx.rank_candidates(texts, "text", lexicon))
    same(pt.infer_phrase_class(texts, "text", table), lx.infer_class(texts, "text", lexicon))


def test_empty_tables(spark, texts):
    none = pt.PhraseTable(spark.createDataFrame([], "class string, class_ord int, phrase string"))
    assert none.shards == 0
    found = pt.add_phrase_candidate(texts, "text", none).select("candidate_intent", "keyword_score").distinct()
    assert [tuple(r) for r in found.collect()] == [("other", 0)]
    some = pt.PhraseTable(spark.createDataFrame([("a", 0, "x")], "class string, class_ord int, phrase string"))
    assert pt.match_phrases(texts.limit(0), "text", some).count() == 0


def test_plan_has_no_join_and_no_shuffle_of_texts(spark, texts):
    listed = spark.range(120_000).select(
        F.lit("many").alias("class"), F.lit(0).alias("class_ord"), F.concat(F.lit("word "), "id").alias("phrase"))
    found = pt.add_phrase_candidate(texts, "text", pt.PhraseTable(listed))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_many_phrases_take_no_pass_for_each_shard(spark, texts):
    """Runs that begin and end inside words, as often as listed, in a table of hundreds of shards."""
    listed = spark.range(3_000).select(
        F.lit("many").alias("class"), F.lit(0).alias("class_ord"), F.concat(F.lit("o late "), "id").alias("phrase"))
    extra = spark.createDataFrame(
        [("a", 1, p) for p in ["o late f", "o late f", "e fund", "e fund é", "late  ", " ", "", "字字 f"]],
        "class string, class_ord int, phrase string")
    table = pt.PhraseTable(listed.unionByName(extra), 300)
    assert table.shards > 300
    before = spark.sparkContext._jsc.sc().dagScheduler().nextJobId()
    hits = pt.rank_phrase_candidates(texts, "text", table)
    assert spark.sparkContext._jsc.sc().dagScheduler().nextJobId() - before < 60
    lexicon = lx.Lexicon({"a": [r["phrase"] for r in extra.collect()]})
    same(hits, lx.rank_candidates(texts, "text", lexicon))
