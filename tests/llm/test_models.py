"""Toxicity, language and n-gram model: held-out accuracy, odd rows, and a plain trigram model."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from replyloom.llm import queries
from replyloom.llm.elias_fano import EliasFano, Trie, build_trie
from replyloom.llm.language import CodeLength, identify_language, language_samples, with_language
from replyloom.llm.ngram_lm import score_texts, shards_of_units, unit_of, words_of
from replyloom.llm.toxicity import FEATURES, disguised_words, feature_arrays, fit_toxicity, score_toxicity

from .conftest import texts_of

MEDIUM = "/root/testdata/sf0.01"
LABELS = "doc_id long, toxic int, quality int, text string, score string"


def test_language_of_held_out_documents(spark):
    found = queries.op6_language(spark, MEDIUM)
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    rows = found.join(docs, F.col("doc_id") == F.col("id")).filter("held_out").collect()
    assert {r["held_out"] for r in rows} == {True} and len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    assert sum(r["rejected"] for r in rows) / len(rows) < 0.02
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert {zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in rows} == {2}


def test_language_of_odd_rows(odd, none, small):
    samples = language_samples(small)
    rows = identify_language(odd, samples).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts_of(odd))
    for doc_id in (2, 3, 4, 9):
        r = next(r for r in rows if r["doc_id"] == doc_id)
        assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
    assert all(r["lang_pred"] in samples or r["lang_pred"] == "und" for r in rows)
    twins = {tuple(r) for r in rows if r["doc_id"] == 1}
    assert len(twins) == 1
    assert identify_language(none, samples).count() == 0
    assert language_samples(none) == {} and language_samples(small.withColumn("lang", F.lit(None).cast("string"))) == {}
    unknown = identify_language(odd, {}).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in unknown} == {("und", False)}


def test_language_uses_no_held_out_rows(small):
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    changed = small.withColumn("lang", F.when(held, "zz").otherwise(F.col("lang"))).withColumn("text", F.when(held, "other").otherwise(F.col("text")))
    assert language_samples(small) == language_samples(changed)
    assert all(len(content) <= 1 << 15 for content in language_samples(small).values())


def test_language_of_short_texts(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").filter("lang is not null")
    samples = language_samples(docs)
    for words, most, least in ((1, 0.01, 0.93), (2, 0.0, 0.99), (3, 0.0, 0.99)):
        start = F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), 1, words), " ")
        cut = docs.select("doc_id", start.alias("text"), F.col("lang").alias("truth"))
        rows = with_language(cut, samples).select("truth", "language.*").filter("lang_pred <> 'und'").collect()
        assert sum(r["rejected"] for r in rows) <= most * len(rows)
        assert sum(r["truth"] == r["lang_pred"] for r in rows) >= least * len(rows)


def test_code_length():
    model = CodeLength(b"abcabcabcabd")
    assert model.bits(b"abc") < model.bits(b"abd") < model.bits(b"zzz")
    assert model.bits(b"") == model.bits(b"a") == 0.0
    assert CodeLength(b"").bits(b"xy") == pytest.approx(8, abs=0.1)


def test_all_languages_are_learned(spark):
    rows = [(10 * i + j, f"l{i}", f"wort{i} satz{i} ende{i} " * 3) for i in range(300) for j in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    samples = language_samples(docs, held_fold=9, all_bytes=300 * 512)
    assert len(samples) == 300 and max(map(len, samples.values())) <= 512


def test_toxicity_features_have_no_gates():
    def of(text, lexicon):
        return dict(zip(FEATURES, feature_arrays([text], lexicon)[0][0].as_py()))

    assert of("calm words here " * 20 + " YOU STOP", {})["capital_words"] == pytest.approx(2 / 62)
    assert of("ПРИВЕТ ТЫ ДУРАК", {})["capitals"] == 1.0 and of("ПРИВЕТ ТЫ ДУРАК", {})["capital_words"] == 1.0
    assert of("you you you are bad", {})["second_person"] == of("you you you are idiot", {"idiot": 2.0})["second_person"] == 0.6
    assert of("дааааа", {})["long_runs"] == pytest.approx(100 * 3 / 1)
    assert of("日本語 です", {})["capitals"] == 0.0 and of("!!! ---", {})["punctuation"] == 0.0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aAbB éÉßДд!.1日𝐀\n"), max_size=40))
def test_toxicity_letters_as_python_counts_them(text):
    found = dict(zip(FEATURES, feature_arrays([text], {})[0][0].as_py()))
    words = re.findall(r"[^\W\d_]+", text)
    if words:
        letters = [c for c in text if c.isalpha()]
        assert found["capitals"] == pytest.approx(sum(map(str.isupper, letters)) / max(1, len(letters)))
        assert found["capital_words"] == pytest.approx(sum(map(str.isupper, words)) / len(words))
        runs = sum(a == b == c and a.isalpha() for a, b, c in zip(text, text[1:], text[2:]))
        assert found["long_runs"] == pytest.approx(100 * runs / len(words))


def test_toxicity_of_held_out_documents(spark):
    rows = queries.op5_toxicity(spark, "/root/testdata/sf0.1")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    held = rows.join(labels, F.col("doc_id") == F.col("id")).filter("held_out").collect()
    bad = [r for r in held if r["toxic"] == 1]
    told = [r for r in held if r["predicted"] == 1]
    assert sum(r["predicted"] for r in bad) / len(bad) > 0.85
    assert sum(r["toxic"] for r in told) / len(told) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in held)


def toy(spark):
    rows = [(i, ("you are an idiot, you scum" if i % 3 == 0 else "what a pleasant morning walk") + f" w{i}", i % 3 == 0) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(x), 1, "own", "own") for i, _, x in rows] + [(0, None, 1, "", ""), (None, 1, 1, "", ""), (1, 0, 1, "", "")], LABELS)
    return docs, labels


def test_toxicity_of_odd_rows(spark, odd, none):
    docs, labels = toy(spark)
    model = fit_toxicity(docs, labels, trees=5)
    assert model.lexicon["idiot"] > 0 and "pleasant" not in model.lexicon
    rows = score_toxicity(odd, model).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(i for i, _ in texts_of(odd))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert score_toxicity(none, model).count() == 0
    found = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, model).collect()}
    assert all(found[i] == (i % 3 == 0) for i in found)
    hidden = spark.createDataFrame([(1, "Y0u 1d1ot, " * 3), (2, "sc.um s-c-u-m")], "doc_id long, text string")
    assert score_toxicity(hidden, model).count() == 2


@pytest.mark.parametrize("value, rate", [(1, 1.0), (0, 0.0), (None, 0.0)])
def test_toxicity_without_both_labels(spark, odd, none, value, rate):
    labels = spark.createDataFrame([(i, value, 1, "", "") for i in range(1, 12)], LABELS)
    model = fit_toxicity(odd, labels)
    assert {r["score"] for r in score_toxicity(odd, model).collect()} == {rate}
    assert fit_toxicity(none, labels).rate == 0.0


def test_disguised_words():
    assert disguised_words("an 1diot is st*pid. It's 5pm, a-b 12.5 end.Start") == ["1diot", "st*pid.", "a-b", "end.Start"]


NUMBERS = st.lists(st.integers(0, 10**7), max_size=200).map(sorted)


@settings(max_examples=150, deadline=None)
@given(NUMBERS, st.lists(st.integers(0, 10**7), max_size=50))
def test_elias_fano(values, wanted):
    data = b"head" + EliasFano.encode(np.array(values, np.uint64), 10**7 + 1)
    sequence = EliasFano(data, 4)
    assert sequence.end == len(data) and sequence.values().tolist() == values
    for value, place in zip(wanted + values, sequence.find(np.array(wanted + values, np.uint64)).tolist()):
        assert (place >= 0) == (value in values) and (place < 0 or values[place] == value)


def test_elias_fano_is_compact():
    values = np.arange(0, 10**9, 1000, dtype=np.uint64)
    assert len(EliasFano.encode(values, 10**9)) * 8 / len(values) < 2.1 + math.log2(1000)


class Plain:
    """Interpolated absolute discounting, word by word; very long and unknown words are one class."""

    def __init__(self, texts, discount=0.75):
        self.d, self.c1, self.c2, self.c3 = discount, Counter(), Counter(), Counter()
        for tokens in texts:
            self.c1.update(tokens)
        rare = [w for w in self.c1 if len(w.encode()) > 64]
        self.rare_mass = sum(self.c1[w] + 1 for w in rare) + 1
        for tokens in texts:
            stream = ["<", "<", *map(self.name, tokens)]
            self.c3.update(zip(stream, stream[1:], stream[2:]))
        self.t2, self.n2, self.t3, self.n3 = Counter(), Counter(), Counter(), Counter()
        for (a, b, w), n in self.c3.items():
            self.c2[b, w] += n
            self.t3[a, b] += n
            self.n3[a, b] += 1
        for (b, _), n in self.c2.items():
            self.t2[b] += n
            self.n2[b] += 1
        self.tokens, self.types = sum(self.c1.values()), len(self.c1)

    def name(self, word):
        return word if word == "<" or self.c1[word] and len(word.encode()) <= 64 else "\0"

    def log10(self, a, b, word):
        a, b, w = map(self.name, (a, b, word))
        p = (self.rare_mass if w == "\0" else self.c1[w] + 1) / (self.tokens + self.types + 1)
        if self.t2[b]:
            p = max(self.c2[b, w] - self.d, 0) / self.t2[b] + self.d * self.n2[b] / self.t2[b] * p
        if self.t3[a, b]:
            p = max(self.c3[a, b, w] - self.d, 0) / self.t3[a, b] + self.d * self.n3[a, b] / self.t3[a, b] * p
        return math.log10(p * ((self.c1[word] + 1) / self.rare_mass if w == "\0" else 1))


def tokens_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", lowered) + [" "]


def is_held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def expected_scores(texts, plain):
    out = []
    for doc_id, text in texts:
        tokens = tokens_of(text)
        base = sum(math.log10((plain.c1[w] + 1) / (plain.tokens + plain.types + 1)) for w in tokens)
        stream = ["<", "<", *tokens]
        score = sum(plain.log10(*gram) for gram in zip(stream, stream[1:], stream[2:]))
        out.append((doc_id, is_held(doc_id), len(tokens), sum(plain.c1[w] > 0 for w in tokens), plain.tokens, base, score))
    return out


def key(row):
    return (row[0] is not None, row[0] or 0, *row[1:5], round(row[5], 4))


def test_scores_equal_a_plain_model(spark, odd, small):
    for docs in (odd, small):
        texts = texts_of(docs)
        plain = Plain([tokens_of(t) for i, t in texts if not is_held(i)])
        expected = sorted(expected_scores(texts, plain), key=key)
        for settings_ in ({}, {"shard_grams": 5000, "unit_grams": 1000}, {"unit_grams": 500, "batch_bytes": 4000}):
            rows = sorted((tuple(r) for r in score_texts(docs, **settings_).collect()), key=key)
            assert len(rows) == len(expected)
            for ours, theirs in zip(rows, expected):
                assert ours[:5] == theirs[:5]
                assert ours[5] == pytest.approx(theirs[5], rel=1e-9)
                assert abs(ours[6] - theirs[6]) <= 3e-4 * theirs[2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB É\t\x0b\x0c\r\n\x1c\x85日"), max_size=12), max_size=6), st.integers(0, 6))
def test_words_of_slices(texts, start):
    import pyarrow as pa

    words, places = words_of(pa.array(texts, pa.string()).slice(min(start, len(texts))))
    expected = [(w.encode(), i) for i, t in enumerate(texts[start:]) for w in tokens_of(t)[:-1]]
    assert list(zip(words.to_pylist(), places.tolist())) == expected


def test_rare_words_are_a_class(spark, small):
    texts = texts_of(small)
    plain = Plain([tokens_of(t) for i, t in texts if not is_held(i)])
    expected = {r[0]: r for r in expected_scores(texts, plain)}
    rows = score_texts(small, dictionary=300, shard_grams=4000, unit_grams=2000).collect()
    for r in rows:
        assert tuple(r)[:5] == expected[r["doc_id"]][:5] and r["base_score"] == pytest.approx(expected[r["doc_id"]][5], rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def assert_plain_scores(docs, **settings_):
    texts = texts_of(docs)
    plain = Plain([tokens_of(t) for i, t in texts if not is_held(i)])
    expected = sorted(expected_scores(texts, plain), key=key)
    rows = sorted((tuple(r) for r in score_texts(docs, **settings_).collect()), key=key)
    assert len(rows) == len(expected)
    for ours, theirs in zip(rows, expected):
        assert ours[:5] == theirs[:5]
        assert ours[5] == pytest.approx(theirs[5], rel=1e-9)
        assert abs(ours[6] - theirs[6]) <= 3e-4 * theirs[2]


def test_words_beyond_the_dictionary_have_their_own_ngrams(small):
    for dictionary in (300, 0):
        assert_plain_scores(small, dictionary=dictionary, shard_grams=4000, unit_grams=2000)


def test_hot_pairs_are_split_by_text(spark, small):
    passage = "the same passage stands in a third of all rows"
    rows = [(1000 + i, f"{passage} w{i % 90} {'x y ' * (i % 5)}" if i % 3 == 0 else f"w{i} v{i % 7} the w{i % 50} same") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert_plain_scores(docs, shard_grams=500, unit_grams=100, batch_bytes=2000)
    assert_plain_scores(docs, dictionary=20, shard_grams=500, unit_grams=100, batch_bytes=2000)
    # All first words of documents, one pair, go to the four units of the pair, by batch.
    zeros = np.zeros(10, np.int64)
    starts = np.array([0, 1, 5])
    units = Counter(int(u) for batch in range(100) for u in unit_of(zeros, zeros, batch, starts[:2], np.array([0]), starts[1:]))
    assert sorted(units) == [1, 2, 3, 4] and max(units.values()) < 500


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    grams, counts = np.unique((rng.integers(0, 9, 500) << 40 | rng.integers(0, 9, 500) << 20 | rng.integers(0, 20, 500)).astype(np.uint64), return_counts=True)
    unigrams = np.log10(np.full(20, 1 / 20))
    trie = Trie(build_trie(grams, counts, {}, unigrams))
    for a, b in ((1, 2), (8, 8), (15, 3), (4, 17)):
        total = (10 ** trie.log10(np.full(20, a), np.full(20, b), np.arange(20), unigrams)).sum()
        assert total == pytest.approx(1, abs=2e-3)


def test_followers_not_told_are_counted_in_place():
    rng = np.random.default_rng(2)
    grams, counts = np.unique((rng.integers(0, 3, 300) << 40 | rng.integers(0, 9, 300) << 20 | rng.integers(0, 20, 300)).astype(np.uint64), return_counts=True)
    unigrams = np.log10(np.full(20, 1 / 20))
    followers = Counter()
    for gram, n in zip(grams.tolist(), counts.tolist()):
        if gram >> 40 == 1:
            followers[gram & 0xFFFFF] += n
    told = np.array(sorted(followers)[::3], np.int64)
    for words in (told, told[:0]):
        of = {1: (words, np.array([followers[w] for w in words.tolist()], np.int64), sum(followers.values()), len(followers))}
        assert build_trie(grams, counts, of, unigrams) == build_trie(grams, counts, {}, unigrams)


def test_no_row_for_each_word_beyond_the_dictionary(small):
    plan = score_texts(small, dictionary=300, shard_grams=4000, unit_grams=2000)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


def test_scores_of_empty_and_unlearned_tables(spark, none):
    assert score_texts(none).count() == 0
    held = [i for i in range(100) if is_held(i)][:3]
    rows = score_texts(spark.createDataFrame([(i, "a b c") for i in held], "doc_id long, text string")).collect()
    assert {tuple(r)[1:] for r in rows} == {(True, 4, 0, 0, 0.0, 0.0)}


def test_units_are_dealt_evenly():
    begins, chosen = shards_of_units([100.0, 30.0, 30.0, 5.0, 5.0], 4, 40.0)
    assert begins == [0, 3, 4, 5, 6, 7]
    load = Counter()
    for unit, shard in enumerate(chosen):
        load[shard] += [100 / 3] * 3 + [30, 30, 5, 5] and ([100 / 3] * 3 + [30, 30, 5, 5])[unit]
    assert len(load) == 4 and max(load.values()) < 70
