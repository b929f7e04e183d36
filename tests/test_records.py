"""Annotation life cycle, corpus, metrics, sources, inference and models on small frames."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.operators import annotations as an
from replyloom.operators import cells, corpus, features, metrics, retrieval, sampling
from replyloom.operators.inference import annotate_with_retry, complete, generate_replies
from replyloom.operators.messages import blind_sheet
from replyloom.operators.models import TextClassifier, cross_validate
from replyloom.plans import jobs
from replyloom.schema import require_columns, require_rows, with_missing_columns
from replyloom.sources import tables


def test_accept_suggestions(spark):
    rows = spark.createDataFrame(
        [(1, "a", "True", "", "", ""), (2, "b", "false", "c", "true", "mine"), (3, " ", "", None, "", "")],
        "tweet_id int, ai_intent string, ai_escalation string, gold_intent string, "
        "expected_escalation string, annotation_notes string")
    done = an.accept_suggestions(rows)
    got = {r["tweet_id"]: r for r in done.collect()}
    assert (got[1]["gold_intent"], got[1]["expected_escalation"], got[1]["annotation_notes"]) == (
        "a", "true", fixed.BULK_NOTE)
    assert (got[2]["gold_intent"], got[2]["annotation_notes"]) == ("c", "mine")
    assert tuple(an.acceptance_counts(done).first()) == (1, 2, 2, 3)
    with pytest.raises(ValueError, match="ai_intent"):
        an.accept_suggestions(rows.drop("ai_intent"))


def checked(spark, *raws, candidate="other"):
    rows = spark.createDataFrame([(i, candidate, r) for i, r in enumerate(raws)],
                                 "i int, candidate_intent string, raw string")
    return an.validate_annotations(rows).orderBy("i").collect()


def answer(**changes):
    fields = {"intent": "other", "escalation": False, "confidence": 90, "reason": "x", **changes}
    return json.dumps({k: v for k, v in fields.items() if v is not ...})


def test_validate_annotations(spark):
    good, text, low, truncated = checked(
        spark, answer(), "So: " + answer(escalation="Yes", confidence="65") + " ok",
        answer(intent=" product_issue ", confidence=65), answer(confidence=69.9))
    assert (good["error"], good["intent"], good["escalation"], good["confidence"]) == (None, "other", False, 90)
    assert (text["escalation"], text["confidence"], text["low_confidence"]) == (True, 65, True)
    assert low["disagrees_with_candidate"] and low["low_confidence"]
    assert truncated["confidence"] == 69
    errors = [r["error"] for r in checked(
        spark, answer(intent="bad"), answer(reason=..., intent=...), answer(confidence=101),
        answer(confidence="ten"), answer(escalation="maybe"), answer(escalation=1), answer(reason=" "),
        "[1, 2]", "none", "{broken}", answer(confidence=-1), answer(confidence=None))]
    assert errors == [
        "Invalid intent: bad", "Missing keys: intent, reason", "confidence must be between 0 and 100.",
        "confidence must be an integer.", "escalation must be a boolean.", "escalation must be a boolean.",
        "reason must be non-empty.", "Response must be a JSON object.", "No JSON object found.",
        "Invalid JSON", "confidence must be between 0 and 100.", "confidence must be an integer."]


def test_validate_judgements(spark):
    def raw(**changes):
        scores = {d: 3 for d in fixed.SCORE_DIMENSIONS} | {"reason": "r"} | changes
        return json.dumps({k: v for k, v in scores.items() if v is not ...})

    rows = spark.createDataFrame(
        [(0, raw()), (1, "```json\n" + raw(style=5) + "\n```"), (2, raw(safety=...)), (3, raw(safety=6)),
         (4, raw(safety=2.5)), (5, raw(safety="3")), (6, "x")], "i int, raw string")
    got = an.validate_judgements(rows).orderBy("i").collect()
    assert [r["error"] for r in got] == [
        None, None, "Judge response missing required field: safety"] + [
        "Judge score 'safety' must be an integer from 1 to 5."] * 3 + ["Invalid JSON"]
    assert got[1]["style"] == 5 and got[3]["style"] is None


def sheet(spark):
    rows = spark.createDataFrame([(1, "m", "a"), (2, "m", "a"), (3, "m", "a")],
                                 "tweet_id int, customer_message string, candidate_intent string")
    return an.ensure_annotation_columns(rows).withColumns({
        "annotation_status": F.when(F.col("tweet_id") == 1, "human_reviewed").otherwise("")})


def test_predictions_keep_reviewed_status(spark):
    new = spark.createDataFrame(
        [(1, "b", True, 60, "r", "s", True, True, None), (2, "a", False, 90, "r", "s", False, False, None),
         (3, None, None, None, None, None, None, None, "boom")],
        "tweet_id int, intent string, escalation boolean, confidence int, reason string, source string, "
        "disagrees_with_candidate boolean, low_confidence boolean, error string")
    got = {r["tweet_id"]: r for r in an.merge_predictions(sheet(spark), new).collect()}
    assert (got[1]["annotation_status"], got[1]["ai_intent"], got[1]["ai_escalation"]) == ("human_reviewed", "b", "true")
    assert (got[2]["annotation_status"], got[2]["ai_confidence"]) == ("ai_suggested", "90")
    assert (got[3]["annotation_status"], got[3]["ai_reason"], got[3]["ai_intent"]) == ("ai_failed", "boom", "")
    merged = an.merge_predictions(sheet(spark), new)
    assert sorted(r["tweet_id"] for r in an.pending_rows(merged).collect()) == [3]
    assert an.pending_rows(merged, 2, force=True).count() == 2
    assert an.next_unreviewed(merged).first()["tweet_id"] == 2


def test_holdouts_leave_no_overlap_and_pairs_need_text(spark):
    flat = spark.createDataFrame(
        [("x", 0, 1, True, "q1"), ("x", 1, 2, False, "a1"), ("x", 2, 3, True, "q2"), ("x", 3, 4, False, " "),
         ("y", 0, 5, True, "q3"), ("y", 1, 6, False, "a3"), ("y", 2, 7, False, "a4"), ("y", 3, 8, True, "q4")],
        "conversation_id string, pos bigint, tweet_id bigint, inbound boolean, text string")
    pairs = corpus.resolution_pairs(flat).collect()
    assert sorted((r["customer_tweet_id"], r["agent_tweet_id"]) for r in pairs) == [(1, 2), (5, 6)]
    golden = spark.createDataFrame([(" 3",), ("99",)], "tweet_id string")
    kept = corpus.holdout_conversations(flat, golden)
    assert {r["conversation_id"] for r in kept.collect()} == {"y"}
    assert corpus.golden_conversations(flat, golden).count() == 1
    rows = corpus.holdout_rows(flat, golden)
    assert rows.count() == 7 and rows.where("tweet_id = 3").isEmpty()


def test_top_k_over_many_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(120, 8))
    vectors[60:90] = vectors[0]
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    queries = rows.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    pool = rows.select(F.col("id").alias("corpus_id"), F.col("v").alias("vector"))
    scores = np.round(vectors @ vectors.T, 9)
    for exclude in (False, True):
        expected = set()
        for q in range(120):
            order = sorted(range(120), key=lambda c, q=q: (-scores[q, c], c))
            order = [c for c in order if not (exclude and c == q)][:4]
            expected |= {(q, c, r + 1) for r, c in enumerate(order)}
        for way in ({"scan_queries": 0, "block_rows": 16}, {"scan_queries": 0}, {}):
            got = retrieval.top_k(queries, pool.repartition(3), 4, exclude, **way).collect()
            assert {(r["query_id"], r["corpus_id"], r["rank"]) for r in got} == expected
    assert retrieval.top_k(queries.limit(1), pool.limit(3), 10).count() == 3
    assert retrieval.top_k(queries.limit(0), pool, 4).count() == 0
    assert retrieval.top_k(queries, pool.limit(0), 4).count() == 0


def test_top_k_visits_cells_that_can_win_only(spark):
    """Clustered vectors, a third of them and of the queries in one direction; ids are strings."""
    rng = np.random.default_rng(1)
    middles = rng.normal(size=(40, 12))
    corpus = np.vstack([middles[rng.integers(0, 40, 1200)] + 0.05 * rng.normal(size=(1200, 12)),
                        middles[0] + 0.02 * rng.normal(size=(600, 12)), np.zeros((1, 12))])
    asked = np.vstack([corpus[rng.integers(0, 1800, 200)] + 0.02 * rng.normal(size=(200, 12)), np.repeat(corpus[:1], 100, axis=0)])
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    corpus, asked = unit(corpus), unit(asked)
    pool = spark.createDataFrame([(f"c{i:04d}", v.tolist()) for i, v in enumerate(corpus)] + [("none", None)],
                                 "corpus_id string, vector array<double>")
    queries = spark.createDataFrame([(f"c{i:04d}", v.tolist()) for i, v in enumerate(asked)], "query_id string, vector array<double>")
    scores = np.round(asked @ corpus.T, 9)
    for exclude in (False, True):
        found = cells.top_in_cells(queries, pool.dropna(), 3, exclude, part_rows=50, part_queries=20)
        ranked = retrieval.top_k(queries, pool, 3, exclude, block_rows=50).collect()
        expected = set()
        for q in range(300):
            order = [c for c in np.lexsort((np.arange(1801), -scores[q])).tolist() if not (exclude and c == q)][:3]
            expected |= {(f"c{q:04d}", f"c{c:04d}", r + 1) for r, c in enumerate(order)}
        assert {(r["query_id"], r["corpus_id"], r["rank"]) for r in ranked} == expected
        best = {q: sorted(((-s, c) for s, c in rows))[:3] for q, rows in _by_query(found).items()}
        assert {(q, c) for q, rows in best.items() for _, c in rows} == {(q, c) for q, c, _ in expected}
    known = cells.find_cells(pool.dropna(), 50)
    visits = cells.route(queries, known, 3, False).count()
    assert known.rows.sum() == 1801 and known.parts.sum() >= 1801 / 50
    # of all pairs of a query and a part, few are left: most cells can't hold one of the best
    assert visits < 0.35 * 300 * known.parts.sum()


def test_a_query_travels_once_for_each_part(spark):
    """Vectors without clusters, in many small cells: the rows sent are bounded by the parts, not by the cells."""
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(900, 24))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    pool = spark.createDataFrame(rows, "corpus_id bigint, vector array<double>")
    queries = spark.createDataFrame(rows[:200], "query_id bigint, vector array<double>")
    known = cells.find_cells(pool, 300)
    assert len(known.centres) == 30 and 3 <= known.all_parts <= 6
    sent = cells.route(queries, known, 3, False)
    assert sent.count() == sent.select("query_id", "part").distinct().count() <= 200 * known.all_parts
    best = cells.best_of(np.arange(900), np.arange(900), vectors, np.arange(200), vectors[:200], 3, False)
    assert (best[1].reshape(200, 3) == np.argsort(-np.round(vectors[:200] @ vectors.T, 9), axis=1, kind="stable")[:, :3]).all()


def test_each_copy_of_a_part_has_a_task(spark):
    """By a hash of part and copy some tasks held several of them, and others none."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 16))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    pool = spark.createDataFrame(rows, "corpus_id bigint, vector array<double>")
    queries = spark.createDataFrame(rows, "query_id bigint, vector array<double>")
    found = cells.top_in_cells(queries, pool, 2, True, part_rows=100, part_queries=80)
    held = found.groupBy(F.spark_partition_id().alias("task")).count().collect()
    # four to seven parts, five copies of each
    assert 20 <= found.rdd.getNumPartitions() == len(held) <= 35
    assert max(r["count"] for r in held) <= 2 * 2 * 80


def test_answers_leave_other_columns_in_arrow(spark):
    rows = spark.range(1_000).select("id", F.concat(F.lit("p"), "id").alias("prompt"), F.array(F.struct("id")).alias("nested"))

    def shout(prompt):
        return prompt.upper()

    answered = complete(rows.coalesce(1), "prompt", [("one", "m", shout)])
    assert "MapInPandas" not in answered._jdf.queryExecution().executedPlan().toString()
    got = answered.where("answer = upper(prompt) and nested[0].id = id and error is null and provider = 'one'")
    assert got.count() == 1_000


def _by_query(found):
    rows = {}
    for r in found.collect():
        rows.setdefault(r["query_id"], []).append((r["similarity"], r["corpus_id"]))
    return rows


def test_top_k_shuffles_the_corpus_once(spark):
    rows = spark.range(3000).select("id", F.array(*[F.cos(F.col("id") * i) for i in range(1, 9)]).alias("v"))
    unit = retrieval.normalize_vectors(rows, "v")
    queries = unit.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    plan = retrieval.top_k(queries, unit.select(F.col("id").alias("corpus_id"), F.col("v").alias("vector")), 3, block_rows=200)
    text = plan._jdf.queryExecution().executedPlan().toString()
    # one exchange brings corpus rows and queries together, one ranks what was found; none multiplies the corpus
    assert text.count("Exchange hashpartitioning") == 2 and "Generate" not in text and "Join" not in text


def test_retrieval_metrics_count_unanswered_queries(spark):
    ranked = spark.createDataFrame(
        [(1, 1, "b"), (1, 2, "a"), (2, 1, "unknown"), (2, 2, "c")], "query_id int, rank int, inferred string")
    gold = spark.createDataFrame([(1, " A "), (2, "x"), (3, "a"), (4, "")], "query_id int, gold string")
    row = retrieval.retrieval_metrics(ranked, gold, "unknown").first()
    assert (row["examples"], row["recall_at_1"], row["examples_with_unknown"]) == (3, 0.0, 1)
    assert row["recall_at_3"] == pytest.approx(1 / 3) and row["mrr"] == pytest.approx(1 / 6)


def test_metrics_with_a_class_never_predicted(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "b"), ("c", "c")], "t string, p string")
    row = metrics.classification_metrics(rows, "t", "p").first()
    assert (row["accuracy"], row["macro_f1"]) == (0.5, round((2 / 3 + 0 + 2 / 3) / 3, 4))
    assert row["weighted_f1"] == round(2 / 3, 4)
    given = metrics.classification_metrics(rows, "t", "p", labels=["a", "c", "d"]).first()
    assert given["macro_f1"] == round((4 / 3) / 3, 4)
    report = {r["label"]: r["support"] for r in metrics.per_class_report(rows, "t", "p", ["a", "d"]).collect()}
    assert report == {"a": 2, "d": 0}


def test_binary_metrics_without_positives(spark):
    rows = spark.createDataFrame([(False, False), (True, False)], "t boolean, p boolean")
    row = metrics.binary_metrics(rows, "t", "p").first()
    assert (row["precision"], row["recall"], row["f1"], row["false_auto_handle_rate"]) == (0, 0, 0, 0.5)


def test_kappa_uses_places_not_scores(spark):
    human, judge = [1, 1, 5, 5, 2, None], [1, 5, 5, 2, 2, 3]
    rows = spark.createDataFrame(list(zip(range(6), human, judge, strict=True)), "id int, s_human int, s_judge int")
    got = metrics.weighted_kappa(rows, ["s"]).first()["quadratic_weighted_kappa"]
    place = {1: 0, 2: 1, 5: 2}
    i = np.array([place[x] for x in human[:5]])
    j = np.array([place[x] for x in judge[:5]])
    expected = 1 - ((i - j) ** 2).mean() / ((i[:, None] - j[None, :]) ** 2).mean()
    assert got == pytest.approx(expected)


def test_leading_terms_are_those_of_a_whole_sort(spark):
    rng = np.random.default_rng(3)
    terms = sorted({"".join(rng.choice(list("abcé漢"), rng.integers(1, 7))) for _ in range(3000)})
    rows = [(t, int(n)) for t, n in zip(terms, rng.zipf(1.6, len(terms)).clip(1, 40))]
    table = spark.createDataFrame(rows, "term string, total long").repartition(3).persist()
    order = sorted(rows, key=lambda r: (-r[1], r[0].encode()))
    for n in (1, 7, 300, len(rows) - 500, len(rows) - 1, len(rows), len(rows) + 5):
        found = features.leading_terms(table, n, small=20)
        assert {tuple(r) for r in found.collect()} == set(order[:n])
        assert "TakeOrdered" not in found._jdf.queryExecution().executedPlan().toString()
    table.unpersist()


def test_vectors_without_row_functions(spark):
    rows = spark.createDataFrame([(1, "the cat the cat the dog"), (2, ""), (3, None), (4, "the dog")], "id int, t string").repartition(2)
    model = features.Tfidf(["cat", "dog", "the", "the cat"], [1.5, 1.2, 1.0, 2.0], features.CLASSIFIER)
    found = model.transform(rows, "t", "v")
    assert "EvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    vectors = {r["id"]: r["v"].toArray() for r in found.collect()}
    raw = np.array([(1 + np.log(2)) * 1.5, 1.2, 1 + np.log(3), (1 + np.log(2)) * 2.0])
    assert vectors[1] == pytest.approx(raw / np.linalg.norm(raw))
    assert vectors[4] == pytest.approx(np.array([0, 1.2, 1.0, 0]) / np.hypot(1.2, 1.0))
    assert not vectors[2].any() and not vectors[3].any()


def test_top_two(spark):
    rows = spark.createDataFrame([(0, [0.2, 0.5, 0.3]), (1, [0.5, 0.5, 0.0])], "i int, p array<double>")
    got = sampling.top_two(rows, "p", ["a", "b", "c"]).orderBy("i").collect()
    assert [(r["predicted_intent"], r["second_intent"]) for r in got] == [("b", "c"), ("b", "a")]
    assert got[0]["confidence_margin"] == pytest.approx(0.2)


def test_schema_checks(spark):
    rows = spark.range(3)
    with pytest.raises(ValueError, match="x, y"):
        require_columns(rows, ["x", "id", "y"])
    require_rows(rows, exactly=3)
    for n in (2, 4):
        with pytest.raises(ValueError, match=f"exactly {n}"):
            require_rows(rows, exactly=n)
    with pytest.raises(ValueError):
        require_rows(rows.limit(0))
    assert with_missing_columns(rows, ["id", "z"], "").columns == ["id", "z"]
    with pytest.raises(ValueError):
        blind_sheet(rows)


def test_tweet_csv(spark, tmp_path):
    path = tmp_path / "tweets.csv"
    path.write_text(
        "tweet_id,author_id,inbound,created_at,text,response_tweet_id,in_response_to_tweet_id\n"
        '1,c1,True,Tue Oct 31 22:10:47 +0000 2017,"two\nlines, ""quoted""","2,3",\n'
        "2,Brand,False,junk,plain,,1.0\n")
    raw = tables.read_tweets(spark, str(path), ["tweet_id", "text"], 1)
    assert raw.columns == ["tweet_id", "text"] and raw.count() == 1
    table = tables.convert_tweets(spark, str(path), str(tmp_path / "t"))
    rows = {r["tweet_id"]: r for r in table.collect()}
    assert rows[1]["text"] == 'two\nlines, "quoted"' and rows[1]["response_tweet_id"] == "2,3"
    assert rows[2]["in_response_to_tweet_id"] == 1 and rows[2]["created_at"] is None


def test_conversation_json_round_trip(spark, tmp_path):
    nested = spark.createDataFrame(
        [("b_1", "c", [(1, "c", True, "x", "hé"), (2, "b", False, None, "yo")], 2)],
        tables.CONVERSATIONS)
    tables.write_conversations(nested, str(tmp_path / "c"))
    (tmp_path / "c" / "extra.json").write_text("\n\n")
    back = tables.read_conversations(spark, str(tmp_path / "c"))
    assert back.collect() == nested.collect()
    flat = tables.flat_conversations(back)
    assert [r["pos"] for r in flat.orderBy("pos").collect()] == [0, 1]
    table = flat.select("tweet_id", "text")
    tables.write_table(table, str(tmp_path / "csv"))
    assert sorted(tables.read_table(spark, str(tmp_path / "csv"), "tweet_id bigint, text string").collect()) == sorted(
        table.collect())


def test_report_and_examples(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", "a", "b", 0.5, True, False, "r", "resp", None)], tables.EVALUATED)
    tables.write_report(spark, {"examples": rows, "counts": spark.range(2)}, str(tmp_path / "r"))
    back = tables.read_examples(spark, str(tmp_path / "r"))
    assert back.first()["customer_message"] == "m" and back.count() == 1
    text = json.loads(spark.read.text(str(tmp_path / "r")).first()[0])
    assert sorted(x["id"] for x in text["counts"]) == [0, 1]


def test_long_sections_are_tables_beside_the_report(spark, tmp_path):
    path = str(tmp_path / "r")
    long = spark.range(25_000).withColumn("note", F.concat(F.lit("n"), "id"))
    empty = spark.createDataFrame([], "id bigint")
    tables.write_report(spark, {"examples": long, "few": spark.range(3), "none": empty}, path)
    back = tables.read_section(spark, path, "examples", "id bigint, note string, missing int")
    assert back.count() == 25_000 and back.where("note = concat('n', id) AND missing IS NULL").count() == 25_000
    assert sorted(r["id"] for r in tables.read_section(spark, path + "/", "few", "id bigint").collect()) == [0, 1, 2]
    assert tables.read_section(spark, path, "none", "id bigint").count() == 0
    assert tables.read_section(spark, path, "absent", "id bigint").count() == 0
    head = json.loads(spark.read.text(path).first()[0])
    assert head["tables"] == {"examples": "examples"} and "examples" not in head
    tables.write_report(spark, {"examples": spark.range(2)}, path)
    assert tables.read_section(spark, path, "examples", "id bigint").count() == 2
    with pytest.raises(ValueError):
        tables.write_report(spark, {"tables": empty}, path)


def test_providers_fall_back_in_order(spark):
    def good(p):
        return f"Response: {p}"

    def bad(p):
        raise RuntimeError("down")

    rows = spark.createDataFrame([("hi",)], "prompt string")

    def ask(*providers):
        named = [(f"p{i}", f"m{i}", f) for i, f in enumerate(providers)]
        r = generate_replies(rows, "prompt", named).first()
        return r["response"], r["provider"], r["error"]

    assert ask(good, bad) == ("hi", "p0", None)
    assert ask(bad, good) == ("hi", "p1", None)
    assert ask(lambda p: "  ", good) == ("hi", "p1", None)
    assert ask(bad, lambda p: None) == (None, None, "All providers failed: p0: down; p1: empty answer")


def test_retry_feeds_the_error_back(spark):
    def model(prompt):
        if "give up" in prompt:
            return "{}"
        return answer(intent="a") if "Missing keys" in prompt else "{}"

    rows = spark.createDataFrame([(1, "hello", "a"), (2, "give up", "a")],
                                 "tweet_id int, customer_message string, candidate_intent string")
    got = {r["tweet_id"]: r for r in annotate_with_retry(rows, model, "stub", {"a": "x"}, max_retries=2).collect()}
    assert (got[1]["intent"], got[1]["retry_count"], got[1]["source"]) == ("a", 1, "stub")
    assert got[2]["intent"] is None and got[2]["error"].startswith("Could not get valid annotation after 2 retries")


TEXTS = [(i, f"{w} {x} thing", label) for i, (w, x, label) in enumerate(
    (w, x, label) for label, ws in (("ship", ["parcel", "delivery"]), ("pay", ["refund", "card"]), ("tech", ["app", "login"]))
    for w in ws for x in ["late", "today", "please", "again"])]


def training(spark):
    return spark.createDataFrame(TEXTS, "tweet_id int, text string, intent string")


def test_tfidf_vectors_equal_the_table_form(spark):
    rows = training(spark)
    for settings in (features.TfidfSettings(min_df=2, max_features=12), features.BASELINE):
        fitted = features.Tfidf.fit(rows, "text", settings)
        vectors = fitted.transform(rows, "text").collect()
        listed = features.add_terms(rows, "text", sizes=settings.sizes)
        table = features.tfidf_weights(
            listed, "tweet_id", "terms", settings.min_df, settings.max_features, settings.sublinear).collect()
        expected = {(r["tweet_id"], r["term"]): r["weight"] for r in table}
        got = {(r["tweet_id"], fitted.words[i]): v for r in vectors
               for i, v in zip(r["tfidf"].indices, r["tfidf"].values, strict=True)}
        assert got.keys() == expected.keys()
        assert all(got[k] == pytest.approx(expected[k]) for k in got)


def test_accents(spark):
    row = spark.range(1).select(features.drop_accents(F.lit("Éçole ñandú ａｂｃ é")).alias("t")).first()
    assert row["t"] == "Ecole nandu abc e"


def test_classifier_fit_predict_save_load(spark, tmp_path):
    rows = training(spark)
    model = TextClassifier(features.TfidfSettings(min_df=1), max_iter=50).fit(rows)
    scored = model.predict(rows).collect()
    assert all(r["predicted_intent"] == r["intent"] for r in scored)
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in scored)
    odd = spark.createDataFrame([(1, "my account was hacked")], "tweet_id int, text string")
    r = model.predict(odd).first()
    assert (r["predicted_intent"], r["confidence"], sum(r["probabilities"])) == ("account_access", 1.0, 0.0)
    model.save(str(tmp_path / "m"))
    again = TextClassifier.load(str(tmp_path / "m")).predict(rows).collect()
    key = {r["tweet_id"]: r["confidence"] for r in scored}
    assert all(r["confidence"] == pytest.approx(key[r["tweet_id"]]) for r in again)
    with pytest.raises(FileNotFoundError):
        TextClassifier.load(str(tmp_path / "nothing"))
    spark.range(1).write.parquet(str(tmp_path / "odd" / "settings"))
    with pytest.raises(TypeError):
        TextClassifier.load(str(tmp_path / "odd"))


def test_classifier_checks_its_input(spark):
    rows = training(spark)
    with pytest.raises(ValueError, match="no row"):
        TextClassifier().fit(rows.limit(0))
    with pytest.raises(ValueError, match="one class"):
        TextClassifier().fit(rows.where("intent = 'pay'"))
    with pytest.raises(RuntimeError):
        TextClassifier().predict(rows)


def test_cross_validation_predicts_every_row_once(spark):
    rows = training(spark)
    got = cross_validate(rows, lambda: TextClassifier(features.BASELINE, max_iter=5), "text", "intent", 2)
    assert sorted(r["tweet_id"] for r in got.select("tweet_id").collect()) == list(range(len(TEXTS)))


def test_handle_messages(spark):
    rows = training(spark)
    model = TextClassifier(features.BASELINE, max_iter=30).fit(rows)
    pairs = spark.createDataFrame(
        [("c1", 100, 101, "late parcel", "It is on its way", [1.0, 0.0]),
         ("c2", 200, 201, "card refund", "Refunded", [0.0, 1.0])],
        "conversation_id string, customer_tweet_id bigint, agent_tweet_id bigint, customer_message string, "
        "historical_response string, embedding array<double>")
    asked = spark.createDataFrame(
        [(1, "parcel late thing", [1.0, 0.0]), (2, " ", [0.0, 1.0]), (3, "hacked parcel", [0.6, 0.8])],
        "tweet_id bigint, customer_message string, embedding array<double>")
    got = {r["tweet_id"]: r for r in jobs.handle_messages(
        asked, model, pairs, [("p", "m", lambda p: "ok")]).collect()}
    assert set(got) == {1, 3}
    assert got[1]["intent"] == "ship" and got[1]["response"] == "ok" and not got[1]["escalate"]
    assert [e["similarity"] for e in got[1]["evidence"]] == [1.0, 0.0]
    assert got[3]["escalate"] and "'hacked'" in got[3]["escalation_reason"]
    with pytest.raises(ValueError):
        jobs.handle_messages(asked, model, pairs.limit(0), [])


def test_golden_set_job(spark):
    nested = spark.createDataFrame(
        [(f"b_{i}", "c", [(i, "c", True, None, "late parcel" if i % 2 else "refund please")], 1) for i in range(40)],
        tables.CONVERSATIONS)
    from replyloom.functions.lexicon import Lexicon

    candidates = jobs.build_candidates(nested, Lexicon({"ship": ["late"], "pay": ["refund"]}), 10)
    assert candidates.count() == 20
    golden = jobs.build_golden_set(candidates, {"ship": 4, "pay": 3})
    assert sorted(r["shuffle_pos"] for r in golden.collect()) == list(range(1, 8))
    assert {r["gold_intent"] for r in golden.collect()} == {""}


def test_review_without_evidence(spark):
    class Fixed:
        """Says "pay" with a confidence that falls with the id."""

        def predict(self, df, text):
            return df.withColumns({"predicted_intent": F.lit("pay"), "confidence": 1.0 - F.col("tweet_id") / 10})

    rows = spark.createDataFrame(
        [(1, "my card was charged", "pay", "yes"), (2, "where is it", "ship", "no"), (3, " ", "pay", "no"), (4, "hello", None, "no")],
        "tweet_id long, customer_message string, gold_intent string, expected_escalation string")
    report = jobs.evaluate_without_evidence(rows, Fixed())
    assert {r["value"]: r["n"] for r in report["predicted_classes"].collect()} == {"pay": 2}
    assert {r["value"]: r["n"] for r in report["actual_classes"].collect()} == {"pay": 1, "ship": 1}
    assert report["intent"].first()["accuracy"] == 0.5
    # weak evidence sends every message to a person
    escalation = report["escalation"].first()
    assert (escalation["accuracy"], escalation["recall"]) == (0.5, 1.0)


def test_folds_are_fitted_at_the_same_time(spark):
    from threading import Barrier

    meeting = Barrier(3)

    class Waits:
        def fit(self, df, text, label):
            meeting.wait(30)
            return self

        def predict(self, df, text, override):
            return df.withColumn("predicted_intent", F.lit("a"))

    rows = spark.range(12).select(F.col("id").alias("tweet_id"), F.lit("x").alias("text"), F.lit("a").alias("intent"))
    scored = cross_validate(rows, Waits, "text", "intent", 3)
    assert sorted(r["tweet_id"] for r in scored.collect()) == list(range(12))
