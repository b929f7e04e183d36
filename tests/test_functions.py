"""Text, lexicon, routing and prompt expressions on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions import lexicon as lx
from replyloom.functions import prompts
from replyloom.functions import text as tx
from replyloom.functions.routing import route
from replyloom.operators.aggregates import discovery_tokens, top_ngrams


def one(spark, expression, *values, schema="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {schema}")
    return [r[0] for r in rows.orderBy("i").select(expression).collect()]


def test_strip_knows_unicode_spaces(spark):
    values = ["  a b ", " x ", "\t\n", "", None]
    assert one(spark, tx.strip("c"), *values) == [v if v is None else v.strip() for v in values]
    assert one(spark, tx.is_blank("c"), *values) == [False, False, True, True, True]
    assert one(spark, tx.blank_to_null("c"), *values) == ["a b", "x", None, None, None]


def test_normalisers(spark):
    assert one(spark, tx.normalize_text("c"), " Hello\n\tWORLD  x ") == ["hello world x"]
    text = "@Élan see https://a.b/c?d=1 www.x.y Don't pay 99 euros!!"
    assert one(spark, tx.normalize_for_discovery("c"), text) == ["see don't pay euros"]
    clean = tx.normalize_for_discovery("c")
    assert one(spark, tx.tokens(clean), text) == [["see", "don't", "pay", "euros"]]


def test_ngrams(spark):
    words = F.split("c", " ")
    assert one(spark, tx.ngrams(words, 2), "a b c", "a") == [["a b", "b c"], []]
    assert one(spark, tx.ngrams(words, 3), "a b c", "a b") == [["a b c"], []]


def test_top_ngrams_ties_in_term_order(spark):
    rows = spark.createDataFrame([("zebra apple zebra apple",), ("mango",)], "text string")
    found = top_ngrams(discovery_tokens(rows), [1, 2], 2).orderBy("size", F.desc("n"), "term").collect()
    assert [tuple(r) for r in found] == [
        (1, "apple", 2), (1, "zebra", 2), (2, "zebra apple", 2), (2, "apple zebra", 1)]


def test_created_at(spark):
    values = ["Tue Oct 31 22:10:47 +0000 2017", "Tue Oct 31 22:10:47 +0200 2017", "junk",
              "Tue Foo 31 22:10:47 +0000 2017", None]
    day = datetime.datetime(2017, 10, 31, 22, 10, 47)
    text = F.date_format(tx.parse_created_at("c"), "yyyy-MM-dd HH:mm:ss")
    assert one(spark, text, *values) == [
        str(day), str(day - datetime.timedelta(hours=2)), None, None, None]


def test_reply_ids(spark):
    assert one(spark, tx.parse_reply_ids("c"), " 1, ,x2,3 ", "", None) == [[1, 3], [], []]
    assert one(spark, tx.parse_tweet_id("c"), "12", "12.0", " 7 ", "x", None) == [12, 12, 7, None, None]


def test_booleans(spark):
    values = ["TRUE ", "1", "Yes", "y", "false", "0", "no", "n", "maybe", "", None]
    assert one(spark, tx.normalize_bool("c"), *values) == [True] * 3 + [False] * 8
    assert one(spark, tx.normalize_bool("c", True), *values) == [True] * 4 + [False] * 7
    assert one(spark, tx.strict_bool("c"), *values) == [True] * 4 + [False] * 4 + [None] * 3
    assert one(spark, tx.normalize_bool("c"), True, False, None, schema="boolean") == [True, False, False]


def test_numbers(spark):
    assert one(spark, tx.to_number("c"), "65", " 6.5 ", "n/a", "", "nan", None) == [65, 6.5] + [None] * 4


def test_clean_response(spark):
    values = ['  Response: "Hello there" ', "assistant :hi", '"', '""', "plain", "RESPONSE:x\ny"]
    assert one(spark, tx.clean_response("c"), *values) == ["Hello there", "hi", '"', "", "plain", "x\ny"]


def test_json(spark):
    values = ['{"a": 1}', 'text {"a":\n1} more', "none", "{broken}", '```json\n{"a": 1}\n```']
    assert one(spark, tx.extract_json("c"), *values) == [
        values[0], '{"a":\n1}', None, None, '{"a": 1}']
    assert one(spark, tx.extract_json_error("c"), *values) == [
        None, None, "No JSON object found.", "Invalid JSON", None]
    assert one(spark, tx.unfence_json("c"), "```\nabc\n```", values[4], "x") == ["abc", '{"a": 1}', "x"]


LEX = lx.Lexicon({"a": ["late", "lost box"], "b": ["refund", "late fee"], "c": ["call me"]})


def labels(spark, function, *texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r["out"] for r in function(rows, "text", LEX, out="out", **options).orderBy("i").collect()]


def test_weak_label_needs_exactly_one_class(spark):
    found = labels(spark, lx.label_weakly, "My  LATE\nparcel", "late refund", "hello thanks", "hello",
                   other_phrases=["thanks"])
    assert found == ["a", None, "other", None]
    assert labels(spark, lx.match_lexicon, "late fee", "x") == [["a", "b"], []]


def test_default_label_phrases_shared_by_two_classes_never_label(spark):
    rows = spark.createDataFrame([("it is not working",), ("where is my package",)], "text string")
    found = lx.label_weakly(rows, "text", lx.Lexicon(fixed.LABEL_PHRASES)).collect()
    assert [r["intent"] for r in found] == [None, "delivery_problem"]


def test_candidate_ties_follow_lexicon_order(spark):
    rows = spark.createDataFrame([("refund late",), ("refund late fee",), ("hm",)], "text string")
    found = lx.add_candidate(rows, "text", LEX).collect()
    assert [(r["candidate_intent"], r["keyword_score"]) for r in found] == [("a", 1), ("b", 2), ("other", 0)]
    ranked = lx.rank_candidates(rows, "text", LEX).collect()
    assert [[tuple(c) for c in r["candidates"]] for r in ranked] == [
        [("a", 1), ("b", 1)], [("b", 2), ("a", 1)], [("other", 0)]]


def test_infer_class_weighs_phrases(spark):
    assert labels(spark, lx.infer_class, "lost box refund", "late refund", "nothing") == ["a", "a", "unknown"]
    assert labels(spark, lx.infer_class, "call me late") == ["c"]


def test_lexicon_from_table(spark):
    table = spark.createDataFrame(
        [("b", 1, "y", 0), ("a", 0, "x2", 1), ("a", 0, "x1", 0)],
        "class string, class_ord int, phrase string, phrase_ord int")
    assert lx.Lexicon.from_frame(table).phrases == {"a": ["x1", "x2"], "b": ["y"]}
    with pytest.raises(ValueError):
        lx.Lexicon.from_frame(spark.range(10_001).selectExpr(
            "'a' as class", "0 as class_ord", "string(id) as phrase", "int(id) as phrase_ord"))


def test_override(spark):
    expression = lx.override_class(tx.normalize_text("c"))
    assert one(spark, expression, "My ACCOUNT  was hacked", "hacked toaster", "identity   theft", "hi") == [
        "account_access", None, "account_access", None]


RULE_CASES = [
    ("This is fraud and I contacted support", "x", 0.9, 0.9, "high_risk", True),
    ("a scam!", "x", 0.9, 0.9, "high_risk", True),
    ("he scammed a firm", "x", 0.9, 0.9, "auto", False),
    ("I contacted support", "x", 0.9, 0.9, "prior_support", True),
    ("told you 3 times", "x", 0.9, 0.9, "repeat_signal", True),
    ("two attempts made", "x", 0.9, 0.9, "repeated_attempt", True),
    ("cashback since monday", "x", 0.9, 0.9, "cashback", True),
    ("where is the refund, still nothing", "x", 0.9, 0.9, "financial", True),
    ("parcel delivery for weeks", "x", 0.9, 0.9, "persistent", True),
    ("please dm me", "x", 0.9, 0.9, "private", True),
    ("thanks a lot", "other", 0.1, 0.1, "other_positive", False),
    ("hm", "other", 0.1, 0.1, "other_unmapped", True),
    ("hm", "other", 0.9, 0.1, "other_plain", False),
    ("hm", "x", 0.1, 0.1, "low_both", True),
    ("hm", "x", 0.6, 0.1, "weak_evidence", True),
    ("hm", "x", 0.1, 0.55, "auto", False),
    ("hm", "x", 0.6, None, "weak_evidence", True),
]


def test_routing_rules(spark):
    rows = spark.createDataFrame(
        [(i, *c[:4]) for i, c in enumerate(RULE_CASES)],
        "i int, customer_message string, intent string, confidence double, sim double")
    found = route(rows, similarity="sim").orderBy("i").collect()
    assert [(r["decision"]["rule"], r["decision"]["escalate"]) for r in found] == [c[4:] for c in RULE_CASES]
    assert "'fraud'" in found[0]["decision"]["reason"] and "'scam'" in found[1]["decision"]["reason"]
    assert found[13]["decision"]["reason"] == (
        "Low classifier confidence (0.10) and weak historical evidence (similarity 0.10).")
    assert found[14]["decision"]["reason"] == (
        "Historical evidence is weak (similarity 0.10 below threshold 0.55).")


def test_routing_takes_similarity_from_evidence(spark):
    rows = spark.createDataFrame(
        [(0, "hm", "x", 0.9, [(0.8,), (0.1,)]), (1, "hm", "x", 0.9, []), (2, "hm", "x", 0.9, None)],
        "i int, customer_message string, intent string, confidence double, "
        "evidence array<struct<similarity:double>>")
    found = route(rows, evidence="evidence").orderBy("i").collect()
    assert [r["decision"]["rule"] for r in found] == ["auto", "weak_evidence", "weak_evidence"]


def test_prompt_skips_blank_pairs_and_keeps_numbers(spark):
    pair = "array<struct<customer_message:string,historical_response:string,similarity:double>>"
    rows = spark.createDataFrame(
        [("hi", [(" q1 ", "a1", 0.5), ("q2", " ", 0.4), ("q3", "a3", 0.12345), ("q4", "a4", 0.1)])],
        f"m string, e {pair}")
    block = rows.select(prompts.evidence_block(F.col("e"))).first()[0]
    assert block == ("Example 1:\nCustomer: q1\nHistorical support response: a1\n\n"
                     "Example 3:\nCustomer: q3\nHistorical support response: a3")
    reply = rows.select(prompts.reply_prompt(F.col("m"), F.lit("x"), F.col("e"), "{message}|{intent}|{evidence} "))
    assert reply.first()[0] == f"hi|x|{block}"
    score = rows.select(prompts.score_prompt(F.col("m"), F.col("e"), F.lit("r"), "{evidence}")).first()[0]
    assert score.count("\n\n---\n\n") == 3 and "0.123" in score


def test_label_prompt_tells_the_former_error(spark):
    rows = spark.createDataFrame([("m1", None), ("m2", "bad key")], "m string, e string")
    first, second = [r[0] for r in rows.select(
        prompts.label_prompt(F.col("m"), F.lit("a"), {"a": "first", "b": "second"}, F.col("e"))).collect()]
    assert "- a: first\n- b: second" in first and "could not be used" not in first
    assert "bad key" in second


def test_fixed_values_are_consistent():
    assert set(fixed.LABEL_PHRASES) | {"other"} == set(fixed.INTENTS)
    assert sum(fixed.CLASS_QUOTAS.values()) == 200 and set(fixed.CLASS_QUOTAS) == set(fixed.INTENTS)
