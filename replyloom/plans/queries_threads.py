"""Brands, reply links and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from replyloom.operators import brands
from replyloom.operators import threads as th
from replyloom.operators.messages import flatten_messages
from replyloom.plans import views
from replyloom.plans.jobs import build_corpus, extract_conversations
from replyloom.plans.queries_rows import PAIRS
from replyloom.plans.registry import query
from replyloom.session import cut_lineage

BRANDS = ["brand_view", "brand_click", "brand_none"]

@query("brand_connected", """
    SELECT brand, tweet_id, author_id, inbound FROM connected WHERE brand = 'brand_view'""")
def _(spark, d):
    connected = brands.connected_rows(views.reply_tree_multi(spark, d), ["brand_view"])
    return connected.select("brand", "tweet_id", "author_id", "inbound")


@query("brand_assoc", "SELECT tweet_id, brand FROM multi_assoc WHERE inbound")
def _(spark, d):
    return brands.linked_brands(views.reply_tree_multi(spark, d))


VOLUME = """
    SELECT o.brand, coalesce(i.n, 0) AS inbound, o.n AS outbound, coalesce(i.n, 0) + o.n AS total
    FROM (SELECT author_id AS brand, count(*) AS n FROM reply_tree_multi WHERE NOT inbound GROUP BY 1) o
    LEFT JOIN (SELECT brand, count(*) AS n FROM multi_assoc WHERE inbound GROUP BY 1) i USING (brand)"""


@query("brand_volume", VOLUME)
def _(spark, d):
    return brands.brand_volume(views.reply_tree_multi(spark, d))


@query("top_brands", VOLUME + " ORDER BY inbound DESC, outbound DESC, brand LIMIT 20")
def _(spark, d):
    return brands.top_brands(brands.brand_volume(views.reply_tree_multi(spark, d)))


@query("reply_edges", """
    SELECT p.tweet_id AS parent, c.tweet_id AS child FROM reply_tree c
    JOIN reply_tree p ON p.tweet_id = c.in_response_to_tweet_id""")
def _(spark, d):
    return th.Threads(views.reply_tree(spark, d), "brand").reply_edges()


@query("parent_customer", """
    SELECT c.tweet_id, CASE WHEN p.author_id <> 'brand' THEN p.author_id END AS customer FROM reply_tree c
    LEFT JOIN reply_tree p ON p.tweet_id = c.in_response_to_tweet_id""")
def _(spark, d):
    return th.Threads(views.reply_tree(spark, d), "brand").parent_customers()


@query("thread_seeds", "SELECT seed, customer FROM seeds")
def _(spark, d):
    return th.Threads(views.reply_tree(spark, d), "brand").seeds().select("seed", "customer")


@query("trace_backward", "SELECT seed, cur AS tweet_id, CAST(off AS BIGINT) AS off FROM back_walk")
def _(spark, d):
    paths = th.Threads(views.reply_tree(spark, d), "brand").backward_paths()
    return paths.select("walk.seed", F.col("node").alias("tweet_id"), "off")


@query("thread_roots", "SELECT seed, customer, root, CAST(depth AS BIGINT) AS depth FROM seed_roots")
def _(spark, d):
    return th.Threads(views.reply_tree(spark, d), "brand").roots().select(
        "seed", "customer", "root", "depth")


@query("trace_forward", """
    SELECT root, customer, cur AS tweet_id, CAST(off AS BIGINT) AS off FROM fore_walk WHERE off > 0""")
def _(spark, d):
    threads = th.Threads(views.reply_tree(spark, d), "brand")
    starts = threads.roots().select("root", "customer").distinct().select(
        F.struct("root", "customer").alias("walk"), "root", "customer")
    return threads.forward_paths(starts).select("walk.*", F.col("node").alias("tweet_id"), "off")


@query("build_conversations", """
    SELECT conversation_id, customer_id, CAST(pos AS BIGINT) AS pos, tweet_id, author_id, inbound
    FROM thread_messages""")
def _(spark, d):
    flat = th.build_conversations(views.reply_tree(spark, d), "brand")
    return flat.select("conversation_id", "customer_id", "pos", "tweet_id", "author_id", "inbound")


@query("conv_nested", """
    SELECT conversation_id, customer_id,
           string_agg(tweet_id || ':' || author_id || ':' || inbound || ':' || text, '|' ORDER BY pos) AS messages,
           count(*) AS turn_count
    FROM thread_messages GROUP BY 1, 2""")
def _(spark, d):
    nested = th.nest_conversations(th.build_conversations(views.reply_tree(spark, d), "brand"))
    line = F.transform("messages", lambda m: F.concat_ws(
        ":", m["tweet_id"].cast("string"), m["author_id"], m["inbound"].cast("string"), m["text"]))
    return nested.select("conversation_id", "customer_id", F.array_join(line, "|").alias("messages"),
                         "turn_count")


@query("flatten_messages", """
    SELECT conversation_id, tweet_id, trim(text) AS customer_message,
           count(*) OVER (PARTITION BY conversation_id) AS turn_count
    FROM thread_messages QUALIFY inbound""")
def _(spark, d):
    nested = th.nest_conversations(th.build_conversations(views.reply_tree(spark, d), "brand"))
    return flatten_messages(nested).select("conversation_id", "tweet_id", "customer_message", "turn_count")


# The walks of one brand see the other brand's rows as rows of other people.
@query("conversation_stats", """
    SELECT a.brand, coalesce(t.tweets, 0) AS tweets, coalesce(l.conversations, 0) AS conversations, avg_turns,
           median_turns, max_turns, coalesce(c3, 0) AS conversations_3plus, coalesce(c6, 0) AS conversations_6plus
    FROM (VALUES ('brand_view'), ('brand_click'), ('brand_none')) AS a(brand)
    LEFT JOIN (SELECT brand, count(*) AS tweets FROM connected GROUP BY 1) t USING (brand)
    LEFT JOIN (SELECT brand, count(*) AS conversations, round(avg(turn_count), 2) AS avg_turns,
                      median(turn_count) AS median_turns, max(turn_count) AS max_turns,
                      count(*) FILTER (turn_count >= 3) AS c3, count(*) FILTER (turn_count >= 6) AS c6
               FROM (SELECT brand, root, count(*) AS turn_count FROM brand_threads GROUP BY 1, 2)
               GROUP BY 1) l USING (brand)""")
def _(spark, d):
    connected = cut_lineage(brands.connected_rows(views.reply_tree_multi(spark, d), BRANDS))
    lengths = th.conversation_lengths(th.build_conversations(connected))
    return th.conversation_stats(connected, lengths, BRANDS)


@query("extract_conversations", """
    SELECT 'brand_click_' || t.root AS conversation_id, t.customer AS customer_id,
           string_agg(t.tweet_id || ':' || r.author_id, '|' ORDER BY t.place) AS messages, count(*) AS turn_count
    FROM brand_threads t JOIN reply_tree_multi r USING (tweet_id) WHERE t.brand = 'brand_click'
    GROUP BY t.root, t.customer""")
def _(spark, d):
    nested = extract_conversations(views.reply_tree_multi(spark, d), "brand_click")
    line = F.transform("messages", lambda m: F.concat_ws(":", m["tweet_id"].cast("string"), m["author_id"]))
    return nested.select("conversation_id", "customer_id", F.array_join(line, "|").alias("messages"),
                         "turn_count")


@query("build_corpus", f"""
    SELECT conversation_id, customer_tweet_id, agent_tweet_id, CAST(256 AS BIGINT) AS dims
    FROM ({PAIRS}) WHERE conversation_id NOT IN (SELECT conv_id FROM golden)""")
def _(spark, d):
    corpus = build_corpus(views.flat(spark, d), views.golden(spark, d),
                          lambda df: views.message_vectors(df, "customer_message"))
    return corpus.select("conversation_id", "customer_tweet_id", "agent_tweet_id",
                         F.size("embedding").cast("bigint").alias("dims"))


LETTERS = "aeio"


@query("corpus_vectors", f"""
    SELECT conversation_id, customer_tweet_id, {", ".join(
        f"round(CASE WHEN size > 0 THEN {c} / sqrt(size) ELSE {c} END, 6) AS v_{c}" for c in LETTERS)}
    FROM (SELECT *, {" + ".join(f"{c} * {c}" for c in LETTERS)} AS size
          FROM (SELECT *, {", ".join(
              f"CAST(length(customer_message) - length(replace(customer_message, '{c}', '')) AS DOUBLE) AS {c}" for c in LETTERS)}
                FROM ({PAIRS}) WHERE conversation_id NOT IN (SELECT conv_id FROM golden)))""")
def _(spark, d):
    """The stored unit vectors, from an encoder that SQL can follow: counts of some letters."""
    def letters(df):
        text = F.col("customer_message")
        return df.withColumn("embedding", F.array(*[
            (F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("double") for c in LETTERS]))

    corpus = build_corpus(views.flat(spark, d), views.golden(spark, d), letters)
    return corpus.select("conversation_id", "customer_tweet_id", *[
        F.round(F.col("embedding")[i], 6).alias(f"v_{c}") for i, c in enumerate(LETTERS)])
