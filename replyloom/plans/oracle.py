"""The views of ``views.py`` in ANSI-style SQL, to check each query against another engine."""

from __future__ import annotations

import re

from replyloom import fixed_values as fixed
from replyloom.plans import views as v


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lexicon_rows() -> str:
    rows = [
        f"({quoted(name)}, {i}, {quoted(phrase)}, {j})"
        for i, (name, phrases) in enumerate(v.LEXICON.phrases.items())
        for j, phrase in enumerate(phrases)
    ]
    return ", ".join(rows)


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(column: str) -> str:
    return STRIP.format(column)


def norm(column: str) -> str:
    return strip(rf"regexp_replace(lower({column}), '\s+', ' ', 'g')")


def hash_order(key: str, seed: str = fixed.SEED) -> str:
    return f"md5('{seed}:' || CAST({key} AS VARCHAR)), {key}"


VIEWS: dict[str, str] = {
    "turns": """
        SELECT conv_id, turn, conv_id * 1000 + turn AS tweet_id,
               CASE WHEN role = 'user' THEN 'cust_' || conv_id ELSE 'brand' END AS author_id,
               role = 'user' AS inbound, text
        FROM conversations WHERE role <> 'system'""",
    "tweets": """
        SELECT t.*, lag(tweet_id) OVER w AS in_response_to_tweet_id,
               CAST(lead(tweet_id) OVER w AS VARCHAR) AS response_tweet_id, lag(text) OVER w AS before_text,
               lead(text) OVER w AS after_text, lead(inbound) OVER w AS after_inbound
        FROM turns t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "gappy": """
        SELECT t.*, lead(text) OVER w AS after_text, lead(inbound) OVER w AS after_inbound,
               CAST(lead(tweet_id) OVER w AS VARCHAR) AS response_tweet_id
        FROM turns t WHERE turn % 3 <> 0 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "messages": """
        SELECT conv_id * 1000 + turn AS tweet_id, conv_id, turn, text
        FROM conversations WHERE role = 'user'""",
    "reply_tree": """
        SELECT event_id + 1 AS tweet_id,
               CASE WHEN event_type IN ('view', 'click') THEN 'brand'
                    ELSE 'cust_' || (user_id % 7) END AS author_id,
               event_type NOT IN ('view', 'click') AS inbound, ts AS created_at,
               event_type || ' ' || props AS text,
               CASE WHEN 2 * event_id + 3 <= last THEN (2 * event_id + 2) || ',' || (2 * event_id + 3)
                    WHEN 2 * event_id + 2 <= last THEN CAST(2 * event_id + 2 AS VARCHAR) END
                 AS response_tweet_id,
               CASE WHEN event_id > 0 THEN (event_id + 1) // 2 END AS in_response_to_tweet_id
        FROM events, (SELECT max(event_id) + 1 AS last FROM events)""",
    "reply_tree_multi": """
        SELECT tweet_id, CASE WHEN inbound THEN author_id ELSE 'brand_' || event_type END AS author_id,
               inbound, r.created_at, r.text, response_tweet_id, in_response_to_tweet_id
        FROM reply_tree r JOIN events e ON e.event_id + 1 = r.tweet_id""",
    "multi_links": """
        SELECT tweet_id, in_response_to_tweet_id AS other_id, inbound FROM reply_tree_multi
        WHERE in_response_to_tweet_id IS NOT NULL
        UNION ALL
        SELECT tweet_id, CAST(unnest(string_split(response_tweet_id, ',')) AS BIGINT), inbound
        FROM reply_tree_multi WHERE response_tweet_id IS NOT NULL""",
    "multi_assoc": """
        SELECT DISTINCT l.tweet_id, o.author_id AS brand, l.inbound
        FROM multi_links l JOIN reply_tree_multi o ON o.tweet_id = l.other_id AND NOT o.inbound""",
    "lexicon": "SELECT * FROM (VALUES " + _lexicon_rows() + ") AS x(class, class_ord, phrase, phrase_ord)",
    "matches": f"""
        SELECT tweet_id, class, class_ord FROM messages
        JOIN lexicon ON contains({norm('text')}, phrase) GROUP BY ALL""",
    "class_scores": """
        SELECT tweet_id, class, class_ord, count(*) AS score FROM messages
        JOIN lexicon ON contains(lower(text), phrase) GROUP BY ALL""",
    "candidates": """
        SELECT m.*, coalesce(b.class, 'other') AS candidate_intent, coalesce(b.score, 0) AS keyword_score
        FROM messages m LEFT JOIN (
            SELECT tweet_id, class, score FROM class_scores
            QUALIFY row_number() OVER (PARTITION BY tweet_id ORDER BY score DESC, class_ord) = 1
        ) b USING (tweet_id)""",
    "golden": f"""
        SELECT * FROM candidates
        QUALIFY row_number() OVER (PARTITION BY candidate_intent ORDER BY {hash_order('tweet_id')}) <= 5""",
    "weak_labels": f"""
        SELECT m.tweet_id, m.text,
               CASE WHEN h.n = 1 THEN h.one
                    WHEN h.n IS NULL AND ({' OR '.join(f"contains({norm('m.text')}, {quoted(p)})" for p in v.OTHER_PHRASES)})
                    THEN 'other' END AS intent
        FROM messages m LEFT JOIN (
            SELECT tweet_id, count(*) AS n, min(class) AS one FROM matches GROUP BY tweet_id
        ) h USING (tweet_id)""",
    "annotated": f"""
        SELECT tweet_id, CAST(conv_id AS VARCHAR) AS conversation_id, text AS customer_message,
               turn + 1 AS turn_count, candidate_intent, conv_id * 7 + turn AS k,
               CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN candidate_intent WHEN 2 THEN 'c_en'
                    WHEN 3 THEN ' ' || candidate_intent ELSE 'other' END AS ai_intent,
               CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN 'true' WHEN 2 THEN 'False' WHEN 3 THEN 'yes'
                    WHEN 4 THEN '0' END AS ai_escalation,
               CASE k % 11 WHEN 0 THEN 'n/a' WHEN 5 THEN '' ELSE CAST(k * 37 % 101 AS VARCHAR) END
                 AS ai_confidence,
               'r' || (k % 3) AS ai_reason, 'stub' AS ai_source,
               CASE k % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE '' END AS ai_disagrees_with_candidate,
               CASE k % 2 WHEN 0 THEN 'true' ELSE 'False' END AS ai_low_confidence,
               CASE (k // 2) % 4 WHEN 0 THEN '' WHEN 1 THEN 'human_reviewed'
                    WHEN 2 THEN 'ai_bulk_accepted' ELSE 'ai_suggested' END AS annotation_status,
               CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN candidate_intent WHEN 2 THEN 'c_de' END AS gold_intent,
               CASE k % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '' WHEN 3 THEN 'TRUE '
                    WHEN 4 THEN 'no' WHEN 5 THEN '1' END AS expected_escalation,
               CASE k % 9 WHEN 0 THEN {quoted(fixed.BULK_NOTE)} WHEN 1 THEN 'checked by hand' ELSE '' END
                 AS annotation_notes
        FROM candidates""",
    "raw_answers": """
        SELECT tweet_id, k, candidate_intent, customer_message,
               CASE k % 11
                 WHEN 0 THEN '{"intent": "' || candidate_intent || '", "escalation": false, "confidence": ' || (k % 101) || ', "reason": "about ' || conversation_id || '"}'
                 WHEN 1 THEN 'Here it is: {"intent": "c_de", "escalation": "yes", "confidence": "65", "reason": " ok "} done'
                 WHEN 2 THEN '```json' || chr(10) || '{"intent": "other", "escalation": true, "confidence": 99.7, "reason": "x"}' || chr(10) || '```'
                 WHEN 3 THEN '{"intent": "other", "confidence": 5}'
                 WHEN 4 THEN '{"intent": "nonsense", "escalation": true, "confidence": 50, "reason": "x"}'
                 WHEN 5 THEN '{"intent": "other", "escalation": true, "confidence": 101, "reason": "x"}'
                 WHEN 6 THEN 'no answer'
                 WHEN 7 THEN '{"intent": "other", "escalation": "maybe", "confidence": 50, "reason": "x"}'
                 WHEN 8 THEN '{"intent": "other", "escalation": 1, "confidence": "fifty", "reason": "x"}'
                 WHEN 9 THEN '{"intent": "c_en", "escalation": "N", "confidence": "6x", "reason": "x"}'
                 ELSE '{"intent": "c_fr", "escalation": "0", "confidence": 70, "reason": "  "}' END AS raw
        FROM annotated""",
    "raw_judgements": """
        SELECT tweet_id, k,
               CASE k % 6
                 WHEN 0 THEN '{"grounding": ' || (1 + k % 5) || ', "resolution_correctness": 2, "relevance": 3, "safety": 4, "style": 5, "overall": ' || (1 + k % 4) || ', "reason": "fine"}'
                 WHEN 1 THEN '```json' || chr(10) || '{"grounding": 1, "resolution_correctness": ' || (1 + k % 5) || ', "relevance": 1, "safety": 1, "style": 1, "overall": 1, "reason": "bad"}' || chr(10) || '```'
                 WHEN 2 THEN '{"grounding": 1, "resolution_correctness": 2, "relevance": 3, "safety": 4, "style": 5, "reason": "x"}'
                 WHEN 3 THEN '{"grounding": 1, "resolution_correctness": 2, "relevance": 7, "safety": 4, "style": 5, "overall": 3, "reason": "x"}'
                 WHEN 4 THEN 'Scores: {"grounding": 4, "resolution_correctness": 4, "relevance": 4, "safety": 4, "style": 4, "overall": 4, "reason": "ok"} end'
                 ELSE '{"grounding": 1, "resolution_correctness": 2.5, "relevance": 3, "safety": 4, "style": 5, "overall": 3, "reason": "x"}' END AS raw
        FROM annotated""",
    "doc_scores": """
        SELECT doc_id, class, class_ord, sum(CASE WHEN contains(phrase, ' ') THEN 2 ELSE 1 END) AS score
        FROM documents JOIN lexicon ON contains(lower(text), phrase) GROUP BY ALL""",
    "doc_classes": """
        SELECT d.doc_id, d.text, d.lang, coalesce(b.class, 'unknown') AS inferred
        FROM documents d LEFT JOIN (
            SELECT doc_id, class FROM doc_scores
            QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, class_ord) = 1
        ) b USING (doc_id)""",
    "preds": """
        SELECT d.doc_id, d.text AS customer_message, 'c_' || d.lang AS gold_intent,
               d.inferred AS predicted_intent,
               (d.doc_id * 37 % 101) / 100.0::DOUBLE AS confidence,
               (d.doc_id * 37 % 101) / 200.0::DOUBLE AS confidence_margin,
               l.toxic = 1 AS expected_escalation, l.quality = 0 AS predicted_escalation
        FROM doc_classes d JOIN labels l USING (doc_id)""",
    "ratings": "SELECT doc_id, "
    + ", ".join(
        f"1 + (doc_id + {d}) % 5 AS {name}_human, "
        f"CASE WHEN doc_id % 13 <> 0 THEN 1 + (doc_id * 7 + doc_id // 3 + {d}) % 5 END AS {name}_judge"
        for d, name in enumerate(fixed.SCORE_DIMENSIONS)
    )
    + " FROM labels",
    "neighbours": """
        SELECT q.vec_id AS query_id, c.vec_id AS corpus_id,
               round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS similarity
        FROM embeddings q, embeddings c""",
    "tokenized": r"""
        SELECT tweet_id, conv_id, list_filter(
                 regexp_extract_all(
                   regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text),
                     'https?://\S+|www\.\S+', ' ', 'g'), '@\w+', ' ', 'g'), '\d+', ' ', 'g'),
                     '[^a-z''\s]', ' ', 'g'),
                   '[a-z][a-z'']+'),
                 lambda w: len(w) > 2 AND NOT list_contains([""" + ", ".join(
        quoted(w) for w in fixed.STOPWORDS
    ) + """], w)) AS tokens
        FROM messages""",
    "seeds": """
        SELECT DISTINCT s.tweet_id AS seed, s.author_id AS customer
        FROM (SELECT tweet_id, author_id, CAST(unnest(string_split(response_tweet_id, ',')) AS BIGINT) AS reply
              FROM reply_tree WHERE inbound AND response_tweet_id IS NOT NULL) s
        JOIN reply_tree b ON b.tweet_id = s.reply AND lower(b.author_id) = 'brand'""",
    "back_walk": """
        SELECT seed, customer, seed AS cur, 0 AS off FROM seeds
        UNION ALL
        SELECT w.seed, w.customer, p.tweet_id, w.off + 1
        FROM back_walk w JOIN reply_tree c ON c.tweet_id = w.cur
        JOIN reply_tree p ON p.tweet_id = c.in_response_to_tweet_id
        WHERE p.author_id = 'brand' OR p.author_id = w.customer""",
    "seed_roots": """
        SELECT seed, customer, max(off) AS depth, arg_max(cur, off) AS root
        FROM back_walk GROUP BY seed, customer""",
    "next_hop": """
        SELECT c.tweet_id AS cur, k.author_id AS by, k.tweet_id AS nxt, c.author_id = 'brand' AS at_brand
        FROM reply_tree c JOIN reply_tree k ON k.in_response_to_tweet_id = c.tweet_id
        WHERE c.author_id = 'brand' OR k.author_id = 'brand'
        QUALIFY row_number() OVER (PARTITION BY c.tweet_id, k.author_id ORDER BY k.created_at, k.tweet_id) = 1""",
    "fore_walk": """
        SELECT DISTINCT root, customer, root AS cur, 0 AS off FROM seed_roots
        UNION ALL
        SELECT w.root, w.customer, n.nxt, w.off + 1
        FROM fore_walk w JOIN next_hop n ON n.cur = w.cur
         AND n.by = CASE WHEN n.at_brand THEN w.customer ELSE 'brand' END""",
    "winners": """
        SELECT r.* FROM seed_roots r
        WHERE r.depth > 0 OR EXISTS (SELECT 1 FROM fore_walk f WHERE f.root = r.root
                                     AND f.customer = r.customer AND f.off > 0)
        QUALIFY row_number() OVER (PARTITION BY root ORDER BY seed) = 1""",
    "thread_rows": """
        SELECT root, customer, tweet_id, min(place) AS place FROM (
            SELECT w.root, w.customer, b.cur AS tweet_id, w.depth - b.off AS place
            FROM winners w JOIN back_walk b ON b.seed = w.seed
            UNION ALL
            SELECT w.root, w.customer, f.cur, w.depth + f.off
            FROM winners w JOIN fore_walk f ON f.root = w.root AND f.customer = w.customer AND f.off > 0
        ) GROUP BY ALL""",
    "thread_messages": """
        SELECT 'brand_' || t.root AS conversation_id, t.customer AS customer_id,
               row_number() OVER (PARTITION BY t.root ORDER BY t.place) - 1 AS pos, t.tweet_id,
               r.author_id, r.inbound, r.text
        FROM thread_rows t JOIN reply_tree r USING (tweet_id)""",
    "connected": """
        SELECT c.brand, r.* FROM (
            SELECT tweet_id, author_id AS brand FROM reply_tree_multi WHERE NOT inbound
            UNION SELECT tweet_id, brand FROM multi_assoc) c JOIN reply_tree_multi r USING (tweet_id)""",
    "brand_seeds": """
        SELECT DISTINCT x.brand, x.tweet_id AS seed, x.author_id AS customer FROM
            (SELECT brand, tweet_id, author_id, CAST(unnest(string_split(response_tweet_id, ',')) AS BIGINT) AS reply
             FROM connected WHERE inbound AND response_tweet_id IS NOT NULL) x
        JOIN connected b ON b.brand = x.brand AND b.tweet_id = x.reply AND b.author_id = b.brand""",
    "brand_back": """
        SELECT brand, seed, customer, seed AS cur, 0 AS off FROM brand_seeds
        UNION ALL
        SELECT w.brand, w.seed, w.customer, p.tweet_id, w.off + 1 FROM brand_back w
        JOIN connected c ON c.brand = w.brand AND c.tweet_id = w.cur
        JOIN connected p ON p.brand = w.brand AND p.tweet_id = c.in_response_to_tweet_id
        WHERE p.author_id = w.brand OR p.author_id = w.customer""",
    "brand_roots": """
        SELECT brand, seed, customer, max(off) AS depth, arg_max(cur, off) AS root FROM brand_back GROUP BY ALL""",
    "brand_next": """
        SELECT c.brand, c.tweet_id AS cur, k.author_id AS by, k.tweet_id AS nxt, c.author_id = c.brand AS at_brand
        FROM connected c JOIN connected k ON k.brand = c.brand AND k.in_response_to_tweet_id = c.tweet_id
        WHERE c.author_id = c.brand OR k.author_id = c.brand
        QUALIFY row_number() OVER (PARTITION BY c.brand, c.tweet_id, k.author_id
                                   ORDER BY k.created_at, k.tweet_id) = 1""",
    "brand_fore": """
        SELECT DISTINCT brand, root, customer, root AS cur, 0 AS off FROM brand_roots
        UNION ALL
        SELECT w.brand, w.root, w.customer, n.nxt, w.off + 1 FROM brand_fore w JOIN brand_next n
        ON n.brand = w.brand AND n.cur = w.cur AND n.by = CASE WHEN n.at_brand THEN w.customer ELSE w.brand END""",
    "brand_winners": """
        SELECT r.* FROM brand_roots r
        WHERE r.depth > 0 OR EXISTS (SELECT 1 FROM brand_fore f WHERE f.brand = r.brand AND f.root = r.root
                                     AND f.customer = r.customer AND f.off > 0)
        QUALIFY row_number() OVER (PARTITION BY brand, root ORDER BY seed) = 1""",
    "brand_threads": """
        SELECT brand, root, customer, cur AS tweet_id, min(place) AS place FROM (
            SELECT w.brand, w.root, w.customer, b.cur, w.depth - b.off AS place
            FROM brand_winners w JOIN brand_back b ON b.brand = w.brand AND b.seed = w.seed
            UNION ALL
            SELECT w.brand, w.root, w.customer, f.cur, w.depth + f.off FROM brand_winners w
            JOIN brand_fore f ON f.brand = w.brand AND f.root = w.root AND f.customer = w.customer
             AND f.off > 0) GROUP BY ALL""",
    "routing_input": """
        SELECT tweet_id, text AS customer_message, candidate_intent AS intent, conv_id * 7 + turn AS k,
               (k * 37 % 101) / 100.0::DOUBLE AS confidence,
               CASE WHEN k % 9 <> 0 THEN (k * 53 % 101) / 100.0::DOUBLE END AS top_similarity
        FROM candidates""",
    "terms": r"""
        SELECT tweet_id, unnest(regexp_extract_all(lower(text), '[0-9A-Za-z_]{2,}')) AS term FROM messages
        UNION ALL
        SELECT tweet_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))
        FROM (SELECT tweet_id, regexp_extract_all(lower(text), '[0-9A-Za-z_]{2,}') AS w FROM messages)""",
}


def with_views(body: str) -> str:
    """Put the views the statement needs in front of it."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        text = pending.pop()
        for name, definition in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                pending.append(definition)
    if body.lstrip().upper().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    parts = [f"{name} AS ({definition})" for name, definition in VIEWS.items() if name in needed]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
