"""Conversation building against chains written by hand and against recursive SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from replyloom.operators import threads as th
from replyloom.operators.brands import brand_volume, connected_rows, linked_brands

SCHEMA = ("tweet_id bigint, author_id string, inbound boolean, created_at timestamp, text string, "
          "response_tweet_id string, in_response_to_tweet_id bigint")


def frame(spark, rows):
    """Rows are (id, author, inbound, minute or None, replies, parent)."""
    import datetime

    base = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [
            (i, a, inb, None if m is None else base + datetime.timedelta(minutes=m), f"t{i}", r, p)
            for i, a, inb, m, r, p in rows
        ],
        SCHEMA,
    )


CHAINS = """
    WITH RECURSIVE rows AS (SELECT *, lower(author) = 'brand' AS is_brand FROM tweets),
    seeds AS (
        SELECT DISTINCT r.id AS seed, r.author AS customer
        FROM (SELECT *, unnest(string_split(replies, ',')) AS reply FROM rows WHERE inbound) r
        JOIN rows b ON b.id = try_cast(trim(r.reply) AS BIGINT) AND b.is_brand),
    back AS (
        SELECT seed, customer, seed AS cur, [seed] AS path FROM seeds
        UNION ALL
        SELECT w.seed, w.customer, p.id, list_append(w.path, p.id)
        FROM back w JOIN rows c ON c.id = w.cur JOIN rows p ON p.id = c.parent
        WHERE (p.is_brand OR p.author = w.customer) AND NOT list_contains(w.path, p.id)),
    roots AS (SELECT seed, customer, arg_max(path, len(path)) AS path, arg_max(cur, len(path)) AS root FROM back GROUP BY ALL),
    hops AS (
        SELECT c.id AS cur, CASE WHEN c.is_brand THEN k.author END AS by, k.id AS nxt
        FROM rows c JOIN rows k ON k.parent = c.id WHERE c.is_brand OR k.is_brand
        QUALIFY row_number() OVER (PARTITION BY c.id, CASE WHEN c.is_brand THEN k.author END
                                   ORDER BY k.minute NULLS LAST, k.id) = 1),
    ahead AS (
        SELECT DISTINCT root, customer, root AS cur, CAST([] AS BIGINT[]) AS path FROM roots
        UNION ALL
        SELECT w.root, w.customer, h.nxt, list_append(w.path, h.nxt)
        FROM ahead w JOIN hops h ON h.cur = w.cur AND coalesce(h.by, w.customer) = w.customer
        WHERE h.nxt <> w.root AND NOT list_contains(w.path, h.nxt)),
    chains AS (
        SELECT r.seed, r.customer, r.root,
               list_concat(list_reverse(r.path), list_filter(a.path, lambda x: NOT list_contains(r.path, x))) AS chain
        FROM roots r
        JOIN (SELECT root, customer, arg_max(path, len(path)) AS path FROM ahead GROUP BY ALL) a USING (root, customer))
    SELECT root, customer, chain FROM chains WHERE len(chain) > 1
    QUALIFY row_number() OVER (PARTITION BY root, CASE WHEN $per_customer THEN customer END ORDER BY seed) = 1
"""


def expected(rows, per_customer=False):
    """The conversations as recursive SQL finds them; lists of what was passed guard the circles."""
    con = duckdb.connect()
    con.execute("CREATE TABLE tweets (id BIGINT, author TEXT, inbound BOOLEAN, minute INT, replies TEXT, parent BIGINT)")
    con.executemany("INSERT INTO tweets VALUES (?, ?, ?, ?, ?, ?)", rows)
    found = con.execute(CHAINS, {"per_customer": per_customer}).fetchall()
    return {(f"Brand_{root}", customer): chain for root, customer, chain in found}


def built(spark, rows, **options):
    flat = th.build_conversations(frame(spark, rows), "Brand", **options).collect()
    found = {}
    for r in sorted(flat, key=lambda r: r["pos"]):
        chain = found.setdefault((r["conversation_id"], r["customer_id"]), [])
        assert r["pos"] == len(chain)
        chain.append(r["tweet_id"])
    return found


def link(rows):
    """Fill the reply lists from the parents."""
    children = {}
    for r in rows:
        children.setdefault(r[5], []).append(r[0])
    return [
        (i, a, inb, m, ",".join(map(str, children[i])) if i in children else None, p)
        for i, a, inb, m, _, p in rows
    ]


def test_linear_thread(spark):
    rows = link([(1, "c1", True, 0, None, None), (2, "Brand", False, 1, None, 1),
                 (3, "c1", True, 2, None, 2), (4, "Brand", False, 3, None, 3)])
    assert built(spark, rows) == {("Brand_1", "c1"): [1, 2, 3, 4]}


def test_two_customers_under_one_brand_tweet(spark):
    rows = link([(1, "c1", True, 0, None, None), (2, "Brand", False, 1, None, 1),
                 (3, "c1", True, 2, None, 2), (4, "c2", True, 2, None, 2),
                 (5, "Brand", False, 3, None, 3), (6, "Brand", False, 3, None, 4)])
    found = built(spark, rows)
    assert found == expected(rows)
    for chain in found.values():
        assert not {3, 4} <= set(chain)


def test_shared_brand_root_keeps_first_or_one_per_customer(spark):
    rows = link([(1, "Brand", False, 0, None, None), (2, "c1", True, 1, None, 1),
                 (3, "c2", True, 2, None, 1), (4, "Brand", False, 3, None, 2),
                 (5, "Brand", False, 4, None, 3)])
    assert built(spark, rows) == {("Brand_1", "c1"): [1, 2, 4]}
    assert built(spark, rows, per_customer=True) == {
        ("Brand_1", "c1"): [1, 2, 4], ("Brand_1", "c2"): [1, 3, 5]}


def test_order_is_backward_then_forward(spark):
    rows = link([(1, "c1", True, 0, None, None), (2, "Brand", False, 5, None, 1),
                 (3, "Brand", False, 2, None, 1), (4, "c1", True, 6, None, 2),
                 (5, "Brand", False, 7, None, 4), (6, "c1", True, 3, None, 3)])
    rows = [(*r[:4], None, r[5]) if r[0] == 1 else r for r in rows]
    assert built(spark, rows) == {("Brand_1", "c1"): [1, 2, 4, 3, 6]} == expected(rows)


def test_siblings_with_equal_and_missing_times(spark):
    rows = link([(1, "c1", True, 0, None, None), (2, "brand", False, None, None, 1),
                 (3, "BRAND", False, 9, None, 1), (4, "Brand", False, 9, None, 1)])
    assert built(spark, rows) == {("Brand_1", "c1"): [1, 3]} == expected(rows)


def test_reply_lists_with_noise(spark):
    rows = [(1, "c1", True, 0, " ,x, 99, 2 ", None), (2, "Brand", False, 1, None, 1),
            (3, "c2", True, 0, "77", None), (4, "Brand", False, 1, None, 3)]
    assert built(spark, rows) == {("Brand_1", "c1"): [1, 2]} == expected(rows)


@pytest.mark.parametrize("rows", [
    [(1, "c1", True, 0, "2", 2), (2, "Brand", False, 1, "1", 1)],
    [(1, "c1", True, 0, "2", 4), (2, "Brand", False, 1, "3", 1), (3, "c1", True, 2, "4", 2),
     (4, "Brand", False, 3, "1", 3), (5, "c1", True, 4, "6", 4), (6, "Brand", False, 5, None, 5)],
    [(1, "Brand", False, 0, None, 2), (2, "Brand", False, 1, "3", 1), (3, "c1", True, 2, "4", 2),
     (4, "Brand", False, 3, None, 3)],
    [(1, "c1", True, 0, "1,2", 1), (2, "Brand", False, 1, None, 1)],
])
def test_circles(spark, rows):
    assert built(spark, rows) == expected(rows)


def test_long_circles(spark):
    """A circle of 80 tweets with a tail of 9 leading into it, and a circle of brand tweets alone."""
    rows = [(i, "c1" if i % 2 else "Brand", bool(i % 2), i, None, i - 1 if i > 1 else 80) for i in range(1, 81)]
    rows += [(100 + i, "c1" if i % 2 else "Brand", bool(i % 2), 200 + i, None, 99 + i if i > 1 else 40) for i in range(1, 10)]
    rows += [(200 + i, "Brand", False, 300 + i, None, 199 + i if i > 1 else 206) for i in range(1, 7)]
    rows += [(210, "c2", True, 400, None, 203), (211, "Brand", False, 401, None, 210)]
    rows = link(rows)
    assert built(spark, rows) == expected(rows)


def test_deep_thread(spark):
    rows = link([(i, "c1" if i % 2 else "Brand", bool(i % 2), i, None, i - 1 if i > 1 else None)
                 for i in range(1, 151)])
    assert built(spark, rows) == {("Brand_1", "c1"): list(range(1, 151))}
    paths = th.Threads(frame(spark, rows), "Brand").backward_paths()
    assert paths.count() == sum(i for i in range(1, 151, 2))


def random_rows(seed, n, cyclic):
    rng = random.Random(seed)
    rows = []
    for i in range(1, n + 1):
        author = rng.choice(["Brand", "brand", "c1", "c2", "c3"])
        inbound = author.lower() != "brand" or rng.random() < 0.1
        if cyclic:
            parent = rng.choice([None, rng.randint(1, n), rng.randint(1, n + 2)])
        else:
            parent = rng.choice([None] + [rng.randint(1, i - 1)] * 6) if i > 1 else None
        rows.append((i, author, inbound, rng.choice([None, rng.randint(0, 20)]), None, parent))
    return link(rows)


@pytest.mark.parametrize("seed,cyclic", [(1, False), (2, False), (3, True), (4, True)])
def test_random_graphs(spark, seed, cyclic):
    rows = random_rows(seed, 60, cyclic)
    assert built(spark, rows) == expected(rows)
    assert built(spark, rows, per_customer=True) == expected(rows, per_customer=True)


def test_parent_with_most_replies(spark):
    """One tweet of the brand answered by every customer, as a third of a table may be."""
    rows = [(1, "c0", True, 0, None, None), (2, "Brand", False, 1, None, 1)]
    for i in range(40):
        rows.append((10 + 2 * i, f"c{i}", True, 2 + i, None, 2))
        rows.append((11 + 2 * i, "Brand", False, 50 + i, None, 10 + 2 * i))
    tweets = frame(spark, link(rows))
    paths = {}
    for r in th.Threads(tweets, "Brand").backward_paths().collect():
        paths.setdefault(r["walk"]["seed"], []).append((r["off"], r["node"]))
    # c0's own walk goes on to its first tweet, the others end at the brand's
    wanted = {10 + 2 * i: [(0, 10 + 2 * i), (1, 2)] for i in range(1, 40)}
    wanted |= {10: [(0, 10), (1, 2), (2, 1)], 1: [(0, 1)]}
    assert {seed: sorted(path) for seed, path in paths.items()} == wanted


def test_volume_starts_no_job_before_it_is_read(spark):
    tweets = frame(spark, link([(1, "c1", True, 0, None, None), (2, "A", False, 1, None, 1)]))
    spark.sparkContext.setJobGroup("planning", "planning")
    volume = brand_volume(tweets)
    connected_rows(tweets, ["A"])
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == 0
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert volume.count() == 1


def test_brand_association_both_ways(spark):
    rows = [(1, "c1", True, 0, None, 2), (2, "A", False, 1, "1", None), (3, "c2", True, 0, "2, 4,", None),
            (4, "B", False, 1, None, 3), (5, "C", False, 1, None, None)]
    tweets = frame(spark, rows)
    assert sorted(map(tuple, linked_brands(tweets).collect())) == [(1, "A"), (3, "A"), (3, "B")]
    volume = {r["brand"]: (r["inbound"], r["outbound"], r["total"]) for r in brand_volume(tweets).collect()}
    assert volume == {"A": (2, 1, 3), "B": (1, 1, 2), "C": (0, 1, 1)}
    twice = tweets.unionByName(tweets)
    connected = connected_rows(twice, ["A", "B"]).groupBy("brand").agg(F.count("*").alias("n"))
    assert {r["brand"]: r["n"] for r in connected.collect()} == {"A": 3, "B": 2}


def test_several_brands_in_one_pass(spark):
    rows = link([(1, "c1", True, 0, None, None), (2, "A", False, 1, None, 1), (3, "c1", True, 2, None, 2),
                 (4, "B", False, 3, None, 3), (5, "c2", True, 0, None, None), (6, "B", False, 1, None, 5)])
    connected = connected_rows(frame(spark, rows), ["A", "B"])
    lengths = th.conversation_lengths(th.build_conversations(connected))
    stats = {r["brand"]: r for r in th.conversation_stats(connected, lengths, ["A", "B", "Z"]).collect()}
    assert (stats["A"]["conversations"], stats["A"]["max_turns"]) == (1, 3)
    assert (stats["B"]["conversations"], stats["B"]["avg_turns"]) == (2, 2.0)
    assert (stats["Z"]["tweets"], stats["Z"]["conversations"]) == (0, 0)
