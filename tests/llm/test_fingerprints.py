"""Syncmer fingerprints and SimHash groups, held against plain Python on all pairs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replyloom.llm import simhash
from replyloom.llm.components import connected_components
from replyloom.llm.simhash import fingerprint_links, fingerprints_of, keep_one, near_duplicates
from replyloom.llm.syncmers import fingerprints, position_matches, with_anchors

from .conftest import texts_of


def test_edited_texts_and_equal_fingerprints(odd, small, none):
    for docs in (odd, small):
        rows = fingerprints(docs, ranges=5).collect()
        texts = texts_of(docs)
        expected = Counter()
        for (doc_id, text), (_, following) in zip(texts, texts[1:] + texts[:1]):
            n = len(text) // 2
            edited = text[:len(text) - n] + following[:n]
            expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] += 1
        assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows) == expected
        of_text = defaultdict(set)
        for r in rows:
            of_text[next(t for i, t in texts if i == r["doc_id"] and len(t) == r["n_chars"])].add(r["fingerprint"])
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if r["fingerprint"] == r["edited_fingerprint"]:
                assert r["near_edited"] == 1
        assert all(len(found) == 1 for found in of_text.values())
    assert fingerprints(none).count() == 0


def test_one_document_follows_itself(spark):
    row = fingerprints(spark.createDataFrame([(4, "a b c d")], "doc_id long, text string")).first()
    assert row["near_next"] == 1 and row["edited_sha256"] == hashlib.sha256(b"a b a b").hexdigest()


def test_ranges_do_not_matter(small):
    one = sorted(map(tuple, fingerprints(small, ranges=1).collect()))
    assert one == sorted(map(tuple, fingerprints(small, ranges=7).collect()))


def test_anchors_are_closed_syncmers(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in rng.integers(0, 400, 300)]
    passage = " ".join(words)
    df = spark.createDataFrame([(1, passage), (2, "other words in front " + passage + " and behind")], "id long, text string")
    k, s = 6, 2
    rows = {r["id"]: r["a"] for r in with_anchors(df, "text", "a", k, s, positions=True).collect()}
    hashed = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()]
    inner = [r[0] for r in spark.createDataFrame(list(zip(hashed, hashed[1:])), "a long, b long").select(F.xxhash64("a", "b")).collect()]
    closed = [i for i in range(len(words) - k + 1) if min(inner[i:i + k - s + 1]) in (inner[i], inner[i + k - s])]
    assert [a["position"] for a in rows[1]] == closed
    # Free of context: the passage has the same anchors elsewhere, shifted by the words in front.
    shifted = {(a["position"] - 4, a["hash"]) for a in rows[2]}
    assert {(a["position"], a["hash"]) for a in rows[1]} <= shifted
    both = with_anchors(df, "text", "a", k, s, positions=True)
    pairs = both.filter("id = 1").select(F.col("a").alias("x")).crossJoin(both.filter("id = 2").select(F.col("a").alias("y")))
    matches = pairs.select(F.explode(position_matches(F.col("x"), F.col("y"))).alias("m")).select("m.*").collect()
    assert len(matches) == len(closed) and Counter(m["position_b"] - m["position_a"] for m in matches).most_common(1)[0][0] == 4


def test_long_texts_share_a_passage(spark):
    rng = np.random.default_rng(5)
    first, second, passage = ([f"{x}{i}" for i in rng.integers(0, 10**6, n)] for x, n in (("a", 20_000), ("b", 20_000), ("p", 80)))
    docs = [(1, " ".join(first[:9000] + passage + first[9000:])), (2, " ".join(second[:300] + passage + second[300:]))]
    rows = {r["doc_id"]: r for r in fingerprints(spark.createDataFrame(docs, "doc_id long, text string"), ranges=2).collect()}
    places = {i: [r["fingerprint"][x:x + 24] for x in range(0, len(r["fingerprint"]), 24)] for i, r in rows.items()}
    assert all(len(x) > 6000 and x == sorted(x) for x in places.values())
    found = {i: {x[8:]: int(x[:8], 16) for x in at} for i, at in places.items()}
    shared = found[1].keys() & found[2].keys()
    assert len(shared) >= 10 and {found[1][h] - found[2][h] for h in shared} == {8700}
    n = len(shared) - 1
    assert rows[1]["near_next"] == rows[2]["near_next"] == n / (len(places[1]) + len(places[2]) - 2 - n)


def test_matches_at_all_occurrences(spark):
    line = "one two three four five six seven eight nine ten eleven twelve"
    df = with_anchors(spark.createDataFrame([(line, f"{line} x {line}")], "a string, b string"), "a", "x", positions=True)
    row = with_anchors(df, "b", "y", positions=True).select(F.size("x").alias("n"), position_matches(F.col("x"), F.col("y")).alias("m")).first()
    assert Counter(m["position_b"] - m["position_a"] for m in row["m"]) == {0: row["n"], 13: row["n"]}


def brute_fingerprint(text, shingle=4):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    parts = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(values, radius):
    """Group number of each value."""
    group = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if bin(a ^ values[j]).count("1") <= radius and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_near_duplicates(odd, small, none):
    for docs in (odd, small):
        texts = texts_of(docs)
        values = [brute_fingerprint(t) for _, t in texts]
        group = brute_groups(values, 4)
        least = {}
        for g, (doc_id, _) in zip(group, texts):
            if doc_id is not None:
                least[g] = min(doc_id, least.get(g, doc_id))
        expected = Counter((doc_id, f"{v:016x}", least.get(g)) for (doc_id, _), v, g in zip(texts, values, group))
        for size in (2048, 2):
            assert Counter(tuple(r) for r in near_duplicates(docs, tree_size=size).collect()) == expected
        kept = keep_one(docs)
        assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert near_duplicates(none).count() == 0 and keep_one(none).count() == 0


def test_long_text_fingerprint():
    text = " ".join(f"w{i % 977}" for i in range(70_000))
    assert fingerprints_of([text], 4)[0] % (1 << 64) == brute_fingerprint(text)


def clusters(seed, n=120):
    rng = np.random.default_rng(seed)
    out = set()
    for _ in range(6):
        center = int(rng.integers(0, 1 << 63))
        for _ in range(n // 6):
            center_ = center
            for b in rng.integers(0, 64, rng.integers(0, 6)):
                center_ ^= 1 << int(b)
            out.add(center_)
    return sorted(out)


def test_links_join_what_is_near(spark):
    for seed, size in ((1, 2048), (2, 5), (3, 1)):
        values = clusters(seed)
        signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
        links = fingerprint_links(spark.createDataFrame(signed, "value long"), 4, size).collect()
        place = {v: i for i, (v,) in enumerate(signed)}
        group = list(range(len(values)))
        for a, b in links:
            assert bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4
            old, new = group[place[a]], group[place[b]]
            group = [min(old, new) if g in (old, new) else g for g in group]
        assert group == brute_groups(values, 4)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 6))
def test_trees_find_all_within_radius(seed, radius):
    values = np.array(clusters(seed, 60), dtype=np.uint64).view(np.int64)
    rng = np.random.default_rng(seed)
    group = rng.integers(0, 3, len(values))
    sides = rng.integers(0, 2, len(values))
    left, right = simhash.forest_links(group, values, sides, radius)
    found = set(zip(left.tolist(), right.tolist()))
    expected = {
        (i, j) for i in range(len(values)) for j in range(len(values))
        if i != j and group[i] == group[j] and sides[j] == 0 and bin(int(values[i] ^ values[j]) & ((1 << 64) - 1)).count("1") <= radius
    }
    assert found == expected


def test_components(spark):
    links = [(5, 1), (1, 9), (2, 3), (4, 4), (None, 2), *[(100 + i, 101 + i) for i in range(60)], *[(200, 201 + i) for i in range(50)]]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    expected = {1: 1, 5: 1, 9: 1, 2: 2, 3: 2} | {100 + i: 100 for i in range(61)} | {200 + i: 200 for i in range(51)}
    assert found == expected
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
