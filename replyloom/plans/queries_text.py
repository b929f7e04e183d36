"""Text functions, lexicons, routing and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyloom import fixed_values as fixed
from replyloom.functions import lexicon as lx
from replyloom.functions import prompts, routing
from replyloom.functions import text as tx
from replyloom.operators import aggregates
from replyloom.operators import phrase_tables as pt
from replyloom.operators.spread import with_neighbours
from replyloom.plans import jobs, views
from replyloom.plans.oracle import norm, quoted, strip
from replyloom.plans.registry import query


@query("norm_text", f"SELECT tweet_id, {norm('text')} AS clean FROM messages")
def _(spark, d):
    return views.messages(spark, d).select("tweet_id", tx.normalize_text("text", True).alias("clean"))


@query("norm_discovery", f"""
    SELECT doc_id, {strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+|www\.\S+', ' ', 'g'), '@\w+', ' ', 'g'), '\d+', ' ', 'g'), '[^a-z''\s]', ' ', 'g'), '\s+', ' ', 'g')")} AS clean
    FROM documents""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", tx.normalize_for_discovery("text", True).alias("clean"))


@query("tokens", "SELECT tweet_id, array_to_string(tokens, ' ') AS tokens FROM tokenized WHERE len(tokens) > 0")
def _(spark, d):
    tokenized = aggregates.discovery_tokens(views.messages(spark, d), ascii_only=True)
    return tokenized.select("tweet_id", F.array_join("tokens", " ").alias("tokens"))


@query("ngrams", """
    SELECT tweet_id,
           array_to_string(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]), ',') AS bigrams,
           array_to_string(list_transform(range(1, len(tokens) - 1),
             lambda i: tokens[i] || ' ' || tokens[i + 1] || ' ' || tokens[i + 2]), ',') AS trigrams
    FROM tokenized WHERE len(tokens) > 0""")
def _(spark, d):
    tokenized = aggregates.discovery_tokens(views.messages(spark, d), ascii_only=True)
    return tokenized.select(
        "tweet_id", F.array_join(tx.ngrams("tokens", 2), ",").alias("bigrams"),
        F.array_join(tx.ngrams("tokens", 3), ",").alias("trigrams"))


@query("parse_created_at", """
    SELECT tweet_id, CAST(epoch(try_strptime(raw, '%a %b %d %H:%M:%S %z %Y')) AS BIGINT) AS seconds
    FROM (SELECT tweet_id, CASE tweet_id % 7 WHEN 0 THEN 'not a date' WHEN 1 THEN NULL
                 ELSE strftime(created_at, '%a %b %d %H:%M:%S +0000 %Y') END AS raw FROM reply_tree)""")
def _(spark, d):
    rows = views.reply_tree(spark, d)
    written = F.date_format("created_at", "EEE MMM dd HH:mm:ss '+0000' yyyy")
    raw = F.when(F.col("tweet_id") % 7 == 0, F.lit("not a date")).when(
        F.col("tweet_id") % 7 != 1, written)
    return rows.select("tweet_id", raw.alias("raw")).select(
        "tweet_id", tx.parse_created_at("raw").cast("bigint").alias("seconds"))


@query("parse_reply_ids", """
    SELECT tweet_id, array_to_string(list_filter(list_transform(string_split(raw, ','),
             lambda p: trim(p)), lambda p: regexp_full_match(p, '[0-9]+')), ',') AS ids
    FROM (SELECT tweet_id, ' ' || coalesce(response_tweet_id, '') || ' ,, x' || tweet_id || ' , ' || tweet_id AS raw
          FROM reply_tree)""")
def _(spark, d):
    raw = F.concat(F.lit(" "), F.coalesce("response_tweet_id", F.lit("")), F.lit(" ,, x"),
                   F.col("tweet_id").cast("string"), F.lit(" , "), F.col("tweet_id").cast("string"))
    return views.reply_tree(spark, d).select(
        "tweet_id", F.array_join(tx.parse_reply_ids(raw).cast("array<string>"), ",").alias("ids"))


@query("norm_bool", f"""
    SELECT tweet_id, coalesce(lower({strip('ai_escalation')}) IN ('true', '1', 'yes'), false) AS ai,
           coalesce(lower({strip('expected_escalation')}) IN ('true', '1', 'yes', 'y'), false) AS expected
    FROM annotated""")
def _(spark, d):
    return views.annotated(spark, d).select(
        "tweet_id", tx.normalize_bool("ai_escalation").alias("ai"),
        tx.normalize_bool("expected_escalation", accept_y=True).alias("expected"))


@query("strict_bool", f"""
    SELECT tweet_id, CASE WHEN lower({strip('expected_escalation')}) IN ('true', 'yes', 'y', '1') THEN 'true'
           WHEN lower({strip('expected_escalation')}) IN ('false', 'no', 'n', '0') THEN 'false'
           ELSE 'error' END AS parsed FROM annotated""")
def _(spark, d):
    parsed = tx.strict_bool("expected_escalation").cast("string")
    return views.annotated(spark, d).select("tweet_id", F.coalesce(parsed, F.lit("error")).alias("parsed"))


@query("bool_text", "SELECT tweet_id, CASE WHEN inbound THEN 'true' ELSE 'false' END AS inbound FROM tweets")
def _(spark, d):
    return views.tweets(spark, d).select("tweet_id", tx.bool_text("inbound").alias("inbound"))


@query("num_coerce", "SELECT tweet_id, try_cast(ai_confidence AS DOUBLE) AS confidence FROM annotated")
def _(spark, d):
    return views.annotated(spark, d).select("tweet_id", tx.to_number("ai_confidence").alias("confidence"))


@query("blank_to_null", f"""
    SELECT tweet_id, nullif({strip('gold_intent')}, '') AS gold, coalesce(gold_intent, '') AS filled
    FROM annotated""")
def _(spark, d):
    return views.annotated(spark, d).select(
        "tweet_id", tx.blank_to_null("gold_intent").alias("gold"),
        tx.null_to_blank("gold_intent").alias("filled"))


DRAFT = """
    SELECT tweet_id, CASE tweet_id % 5 WHEN 0 THEN 'Response: ' || text
           WHEN 1 THEN '"' || text || '"' WHEN 2 THEN ' ASSISTANT :  "' || text || ' "' ELSE text END AS draft
    FROM turns"""


@query("clean_response", f"""
    SELECT tweet_id, CASE WHEN length(bare) >= 2 AND bare LIKE '"%' AND bare LIKE '%"'
           THEN {strip('substr(bare, 2, length(bare) - 2)')} ELSE bare END AS reply
    FROM (SELECT tweet_id, regexp_replace({strip('draft')}, '(?i)^(assistant|response)\\s*:\\s*', '') AS bare
          FROM ({DRAFT}))""")
def _(spark, d):
    k = F.col("tweet_id") % 5
    draft = (
        F.when(k == 0, F.concat(F.lit("Response: "), "text"))
        .when(k == 1, F.concat(F.lit('"'), "text", F.lit('"')))
        .when(k == 2, F.concat(F.lit(' ASSISTANT :  "'), "text", F.lit(' "')))
        .otherwise(F.col("text")))
    return views.tweets(spark, d).select("tweet_id", tx.clean_response(draft).alias("reply"))


@query("json_extract", r"""
    SELECT tweet_id, CASE WHEN json_valid(raw) THEN raw
             WHEN json_valid(regexp_extract(raw, '(?s)\{.*\}', 0)) THEN regexp_extract(raw, '(?s)\{.*\}', 0) END AS found
    FROM raw_answers""")
def _(spark, d):
    return views.raw_answers(spark, d).select("tweet_id", tx.extract_json("raw").alias("found"))


@query("json_unfence", r"""
    SELECT tweet_id, CASE WHEN regexp_extract(bare, '(?s)\{.*\}', 0) <> '' THEN regexp_extract(bare, '(?s)\{.*\}', 0)
           ELSE bare END AS found
    FROM (SELECT tweet_id, CASE WHEN raw LIKE '```%'
                 THEN regexp_replace(regexp_replace(raw, '(?i)^```(?:json)?\s*', ''), '\s*```$', '') ELSE raw END AS bare
          FROM raw_answers)""")
def _(spark, d):
    return views.raw_answers(spark, d).select("tweet_id", tx.unfence_json("raw").alias("found"))


# --- lexicons -----------------------------------------------------------------------------------

@query("lexicon_match", f"""
    SELECT tweet_id, class, phrase FROM messages JOIN lexicon ON contains({norm('text')}, phrase)""")
def _(spark, d):
    rows = views.messages(spark, d).withColumn("_norm", tx.normalize_text("text", True))
    hits = [
        F.when(F.contains(F.col("_norm"), F.lit(p)),
               F.struct(F.lit(c).alias("class"), F.lit(p).alias("phrase")))
        for c, words in views.LEXICON.phrases.items() for p in words
    ]
    return rows.select(
        "tweet_id", F.inline(F.filter(F.array(*hits), lambda h: h.isNotNull())))


@query("matching_classes", """
    SELECT m.tweet_id, coalesce(string_agg(class, ',' ORDER BY class_ord), '') AS classes
    FROM messages m LEFT JOIN matches USING (tweet_id) GROUP BY 1""")
def _(spark, d):
    matched = lx.match_lexicon(views.messages(spark, d), "text", views.LEXICON, ascii_only=True)
    return matched.select("tweet_id", F.array_join("classes", ",").alias("classes"))


@query("weak_label", "SELECT tweet_id, intent FROM weak_labels")
def _(spark, d):
    return lx.label_weakly(views.messages(spark, d), "text", views.LEXICON, views.OTHER_PHRASES,
                           ascii_only=True).select("tweet_id", "intent")


@query("keyword_score", "SELECT tweet_id, class, score FROM class_scores")
def _(spark, d):
    rows = views.messages(spark, d).withColumn("_lower", F.lower("text"))
    scores = F.filter(views.LEXICON.scores(F.col("_lower")), lambda s: s["score"] > 0)
    return rows.select("tweet_id", F.inline(scores)).select(
        "tweet_id", "class", F.col("score").cast("bigint").alias("score"))


@query("candidate_class", "SELECT tweet_id, candidate_intent, keyword_score FROM candidates")
def _(spark, d):
    return views.scored(spark, d).select(
        "tweet_id", "candidate_intent", F.col("keyword_score").cast("bigint").alias("keyword_score"))


@query("ranked_candidates", """
    SELECT m.tweet_id, coalesce(string_agg(class || ':' || score, ',' ORDER BY score DESC, class_ord), 'other:0') AS ranked
    FROM messages m LEFT JOIN class_scores USING (tweet_id) GROUP BY 1""")
def _(spark, d):
    ranked = lx.rank_candidates(views.messages(spark, d), "text", views.LEXICON)
    text = F.transform("candidates", lambda c: F.concat(c["class"], F.lit(":"), c["score"].cast("string")))
    return ranked.select("tweet_id", F.array_join(text, ",").alias("ranked"))


@query("infer_class", "SELECT doc_id, inferred FROM doc_classes")
def _(spark, d):
    return views.documents_with_class(spark, d).select("doc_id", "inferred")


@query("override_class", f"""
    SELECT tweet_id, CASE WHEN ((contains(t, 'che') OR contains(t, 'ion')) AND contains(t, 'ent'))
             OR contains(t, 'the and') OR contains(t, 'heit') THEN 'fixed' ELSE 'model' END AS picked
    FROM (SELECT tweet_id, {norm('text')} AS t FROM messages)""")
def _(spark, d):
    fixed_class = lx.override_class(
        tx.normalize_text("text", True), ["che", "ion"], ["ent"], ["the and", "heit"], "fixed")
    return views.messages(spark, d).select(
        "tweet_id", F.coalesce(fixed_class, F.lit("model")).alias("picked"))


# --- routing ------------------------------------------------------------------------------------

@query("repeat_signal", """
    SELECT doc_id, regexp_matches(lower(text), '\\b\\d+\\s+(documents?|times|a)\\b') AS repeated FROM documents""")
def _(spark, d):
    docs = views.table(spark, d, "documents")
    return docs.select("doc_id", routing.has_repeat_signal(
        F.lower("text"), ["documents?", "times", "a"]).alias("repeated"))


def _any(column: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(p)})" for p in phrases) + ")"


A, B = ["tion", "heit", "ción"], ["the ", "die ", "que "]


@query("cooccur_signal", f"""
    SELECT tweet_id, {_any('lower(text)', A)} AND {_any('lower(text)', B)} AS both FROM messages""")
def _(spark, d):
    return views.messages(spark, d).select(
        "tweet_id", routing.co_occurs(F.lower("text"), A, B).alias("both"))


SHORT = ["of", "the", "heit", "entre"]


@query("short_phrase_match", """
    SELECT tweet_id, CASE WHEN regexp_matches(t, '(^|[^\\pL\\pN_])of($|[^\\pL\\pN_])') THEN 'of'
           WHEN regexp_matches(t, '(^|[^\\pL\\pN_])the($|[^\\pL\\pN_])') THEN 'the'
           WHEN regexp_matches(t, '(^|[^\\pL\\pN_])heit($|[^\\pL\\pN_])') THEN 'heit'
           WHEN contains(t, 'entre') THEN 'entre' ELSE '' END AS phrase
    FROM (SELECT tweet_id, lower(text) AS t FROM messages)""")
def _(spark, d):
    return views.messages(spark, d).select("tweet_id", F.coalesce(
        routing.first_phrase(F.lower("text"), SHORT), F.lit("")).alias("phrase"))


RULES = routing.RoutingRules(
    high_risk=("ing of", "was"), prior_support=("ung die", "ation "), repeat_words=("a", "the"),
    repeated_attempt=("heit und",), cashback=("que le",), financial=("ción",), unresolved=("los",),
    persistence=("eur",), operational=("ment",), private_support=("wh",), positive=("in",),
)
CASCADE = [
    ("contains(m, 'ing of')", True, "high_risk"),
    ("regexp_matches(m, '(^|[^\\pL\\pN_])was($|[^\\pL\\pN_])')", True, "high_risk"),
    (_any("m", RULES.prior_support), True, "prior_support"),
    (r"regexp_matches(m, '\b\d+\s+(a|the)\b')", True, "repeat_signal"),
    (_any("m", RULES.repeated_attempt), True, "repeated_attempt"),
    (_any("m", RULES.cashback), True, "cashback"),
    (f"{_any('m', RULES.financial)} AND {_any('m', RULES.unresolved)}", True, "financial"),
    (f"{_any('m', RULES.persistence)} AND {_any('m', RULES.operational)}", True, "persistent"),
    (_any("m", RULES.private_support), True, "private"),
    (f"intent = 'other' AND {_any('m', RULES.positive)}", False, "other_positive"),
    ("intent = 'other' AND confidence < 0.6 AND sim < 0.55", True, "other_unmapped"),
    ("intent = 'other'", False, "other_plain"),
    ("confidence < 0.6 AND sim < 0.55", True, "low_both"),
    ("sim < 0.55", True, "weak_evidence"),
    ("true", False, "auto"),
]
REASON = {
    "low_both": "'Low classifier confidence (' || printf('%.2f', confidence) || "
                "') and weak historical evidence (similarity ' || printf('%.2f', sim) || ').'",
    "weak_evidence": "'Historical evidence is weak (similarity ' || printf('%.2f', sim) || "
                     "' below threshold 0.55).'",
}


def _cascade(kind: str) -> str:
    cases = []
    for number, (condition, escalate, rule) in enumerate(CASCADE):
        if kind == "escalate":
            value = str(escalate).lower()
        elif kind == "rule":
            value = quoted(rule)
        elif rule == "high_risk":
            value = quoted(fixed.ROUTING_REASONS[rule] % RULES.high_risk[number])
        else:
            value = REASON.get(rule) or quoted(fixed.ROUTING_REASONS[rule])
        cases.append(f"WHEN {condition} THEN {value}")
    return "CASE " + " ".join(cases) + f" END AS {kind}"


@query("route_decision", f"""
    SELECT tweet_id, {_cascade('escalate')}, {_cascade('rule')}, {_cascade('reason')}
    FROM (SELECT *, lower(customer_message) AS m, coalesce(top_similarity, 0.0) AS sim FROM routing_input)""")
def _(spark, d):
    routed = routing.route(views.routing_input(spark, d), similarity="top_similarity", rules=RULES)
    return routed.select("tweet_id", "decision.*")


@query("route_defaults", """
    SELECT tweet_id, CASE WHEN intent = 'other' THEN confidence < 0.6 AND sim < 0.55 ELSE sim < 0.55 END AS escalate
    FROM (SELECT *, coalesce(top_similarity, 0.0) AS sim FROM routing_input)""")
def _(spark, d):
    routed = routing.route(views.routing_input(spark, d), similarity="top_similarity")
    return routed.select("tweet_id", "decision.escalate")


# --- prompts ------------------------------------------------------------------------------------

def _evidence(spark, d):
    """Turns with the pairs before and after them as evidence."""
    rows = with_neighbours(views.tweets(spark, d), "conv_id", "turn", ["text"], "after_", "before_")

    def pair(message, response, similarity):
        return F.struct(
            F.col(message).alias("customer_message"), F.col(response).alias("historical_response"),
            F.lit(similarity).alias("similarity"))

    return rows.withColumn("evidence", F.array(
        pair("text", "after_text", 0.9126), pair("before_text", "text", 0.5), pair("text", "text", 0.25)))


def _filled(template: str, **values: str) -> str:
    out = quoted(template)
    for name, value in values.items():
        out = out.replace("{" + name + "}", f"' || coalesce({value}, '') || '")
    return strip(f"({out})")


def _pair_sql(n: int, message: str, response: str) -> str:
    m, r = strip(message), strip(response)
    return (f"CASE WHEN coalesce({m}, '') <> '' AND coalesce({r}, '') <> '' THEN 'Example {n}:' || chr(10) "
            f"|| 'Customer: ' || {m} || chr(10) || 'Historical support response: ' || {r} END")


@query("grounded_prompt", f"""
    SELECT tweet_id, {_filled(prompts.REPLY_TEMPLATE, message='text', intent='author_id', evidence='block')} AS prompt
    FROM (SELECT *, concat_ws(chr(10) || chr(10), {_pair_sql(1, 'text', 'after_text')},
          {_pair_sql(2, 'before_text', 'text')}, {_pair_sql(3, 'text', 'text')}) AS block FROM tweets)""")
def _(spark, d):
    rows = _evidence(spark, d)
    return rows.select("tweet_id", prompts.reply_prompt(
        F.col("text"), F.col("author_id"), F.col("evidence")).alias("prompt"))


def _item_sql(message: str, response: str, similarity: str) -> str:
    return (f"'Historical customer message:' || chr(10) || coalesce({message}, '') || chr(10) || chr(10) || "
            f"'Historical support response:' || chr(10) || coalesce({response}, '') || chr(10) || chr(10) || "
            f"'Similarity:' || chr(10) || '{similarity}'")


JUDGE_PROMPTS = f"""
    SELECT tweet_id, {_filled(prompts.SCORE_TEMPLATE, message='text', evidence='block', response='author_id')} AS prompt
    FROM (SELECT *, {_item_sql('text', 'after_text', '0.913')} || chr(10) || chr(10) || '---' || chr(10) || chr(10)
          || {_item_sql('before_text', 'text', '0.500')} || chr(10) || chr(10) || '---' || chr(10) || chr(10)
          || {_item_sql('text', 'text', '0.250')} AS block FROM tweets)"""


@query("judge_prompt", JUDGE_PROMPTS)
def _(spark, d):
    rows = _evidence(spark, d)
    return rows.select("tweet_id", prompts.score_prompt(
        F.col("text"), F.col("evidence"), F.col("author_id")).alias("prompt"))


def _judge():
    """A stand-in that scores by the length of its prompt, leaves a field out, or is not there."""

    def judge(prompt: str) -> str:
        n = len(prompt)
        if n % 3 == 0:
            raise RuntimeError("busy")
        scores = f'"grounding": {1 + n % 5}, "resolution_correctness": 2, "relevance": 3, "safety": {1 + n % 4}, "style": 5, "overall": 3'
        return "Scores: {" + scores + (', "reason": "fine"}' if n % 3 == 1 else "}")

    return [("one", "model-1", judge)]


@query("judge_run", f"""
    SELECT tweet_id, CASE n % 3 WHEN 0 THEN 'All providers failed: one: busy'
                                WHEN 2 THEN 'Judge response missing required field: reason' END AS error,
           CASE WHEN n % 3 = 1 THEN 1 + n % 5 END AS grounding, CASE WHEN n % 3 = 1 THEN 1 + n % 4 END AS safety,
           CASE WHEN n % 3 = 1 THEN 'fine' END AS reason
    FROM (SELECT tweet_id, length(prompt) AS n FROM ({JUDGE_PROMPTS}))""")
def _(spark, d):
    report = jobs.judge_examples(_evidence(spark, d), _judge(), "text", "author_id")
    return report["judgements"].select("tweet_id", "error", "grounding", "safety", "reason")


TAXONOMY = {"c_en": "first kind", "c_de": "second kind", "other": "all else"}
BULLETS = "\n".join(f"- {k}: {v}" for k, v in TAXONOMY.items())
RETRY = quoted(prompts.RETRY_TEMPLATE).replace("{error}", "' || problem || '")


@query("annotation_prompt", f"""
    SELECT tweet_id, {_filled(prompts.LABEL_TEMPLATE, taxonomy=quoted(BULLETS), candidate='candidate_intent',
                              message='text', retry='retry')} AS prompt
    FROM (SELECT *, CASE WHEN problem IS NULL THEN '' ELSE {RETRY} END AS retry
          FROM (SELECT *, CASE WHEN tweet_id % 2 = 1 THEN 'wrong ' || tweet_id END AS problem FROM candidates))""")
def _(spark, d):
    problem = F.when(F.col("tweet_id") % 2 == 1, F.concat(F.lit("wrong "), F.col("tweet_id").cast("string")))
    return views.scored(spark, d).select("tweet_id", prompts.label_prompt(
        F.col("text"), F.col("candidate_intent"), TAXONOMY, problem).alias("prompt"))


#: Every run of two to four words of a turn as a phrase; its class goes by its length.
_RUNS = """
    words AS (SELECT string_split(lower(text), ' ') AS w FROM conversations WHERE text IS NOT NULL),
    runs AS (
        SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS phrase
        FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (VALUES (2), (3), (4)) AS s(n))),
    listed AS (SELECT phrase, length(phrase) % 23 AS class_ord FROM runs)"""


def _phrase_table(spark, d):
    turns = views.table(spark, d, "conversations").select(F.split(F.lower("text"), " ").alias("w"))
    runs = turns.select(F.explode(F.concat(*[tx.ngrams("w", n) for n in (2, 3, 4)])).alias("phrase")).distinct()
    order = F.length("phrase") % 23
    return pt.PhraseTable(runs.select(F.concat(F.lit("c"), order).alias("class"), order.alias("class_ord"), "phrase"))


@query("phrase_table_scores", f"""
    WITH {_RUNS}
    SELECT tweet_id, 'c' || class_ord AS class, count(*) AS score
    FROM messages JOIN listed ON contains(lower(text), phrase) GROUP BY ALL""")
def _(spark, d):
    """All classes of each message by a list of all runs of words, 128,000 phrases at sf0.01."""
    found = pt.rank_phrase_candidates(views.messages(spark, d), "text", _phrase_table(spark, d))
    return found.select("tweet_id", F.inline("candidates")).where(F.col("score") > 0).withColumn("score", F.col("score").cast("bigint"))


@query("phrase_table_candidates", f"""
    WITH {_RUNS}, found AS (
        SELECT tweet_id, class_ord, count(*) AS n FROM messages JOIN listed ON contains(lower(text), phrase) GROUP BY ALL)
    SELECT tweet_id, coalesce('c' || class_ord, 'other') AS class, coalesce(n, 0) AS score
    FROM messages LEFT JOIN (
        SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY n DESC, class_ord) = 1) USING (tweet_id)""")
def _(spark, d):
    """The class of each message whose phrases it holds most of, by the same list."""
    found = pt.add_phrase_candidate(views.messages(spark, d), "text", _phrase_table(spark, d), "class", "score")
    return found.select("tweet_id", "class", F.col("score").cast("bigint").alias("score"))
