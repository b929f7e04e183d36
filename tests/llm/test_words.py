"""Encoding by different words, and phrases counted by tries, held against the library and brute force."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from replyloom.llm import phrase_tries
from replyloom.llm.phrase_tries import Trie, collocations, digits_of, double_array, score
from replyloom.llm.piece_words import encode_pieces, marked_words, words_stand_alone
from replyloom.llm.word_blocks import planes, squeeze
from replyloom.session import ensure_checkpoint_dir

from .conftest import texts_of

PIECES = public_tokenizers.path("piece_bpe_32k.model")
processor = sentencepiece.SentencePieceProcessor(model_file=PIECES)

PARTS = ["a", "the", " ", "  ", "   ", "\n", "\t", "▁", "▁▁", "é", "漢", "😀", "\x00", "<s>", "</s>", "<0x0A>", "x" * 40, ".",
         "don't", "\xa0", "　", "﻿", "é", "<unk>", " ⁇ ", "<pad>"]


def test_words_equal_whole_texts():
    assert words_stand_alone(processor)
    source = random.Random(1)
    for _ in range(4000):
        text = "".join(source.choice(PARTS) for _ in range(source.randint(0, 9)))
        words = marked_words(text)
        ids = processor.encode(words, num_threads=1)
        expected = processor.encode(text)
        assert [i for part in ids for i in part] == expected
        assert " ".join(processor.decode(ids, num_threads=1) if words else []) == processor.decode(expected)


def expected_pieces(docs):
    out = Counter()
    for doc_id, text in texts_of(docs):
        ids = processor.encode(text, add_eos=True)
        decoded = processor.decode(ids)
        out[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    return out


def test_pieces(odd, small, none):
    for docs in (odd, small):
        expected = expected_pieces(docs)
        stable = {"stable": docs is small}
        for sizes in (stable, {"block_size": 3000, "shard_size": 5000}, stable | {"block_size": 50_000}):
            rows = encode_pieces(docs, PIECES, keep_output=False, **sizes).collect()
            assert Counter(tuple(r) for r in rows) == expected
    assert encode_pieces(none, PIECES).count() == 0


def test_pieces_give_ids_and_text(odd):
    docs = odd.filter("doc_id in (3, 6, 7, 12)")
    expected = {(i, tuple(processor.encode(t, add_eos=True)), processor.decode(processor.encode(t))) for i, t in texts_of(docs)}
    rows = encode_pieces(docs, PIECES).collect()
    assert {(r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), r["decoded"]) for r in rows} == expected


def test_vocabulary_whose_pieces_cross_words(odd, monkeypatch):
    monkeypatch.setattr("replyloom.llm.piece_words.words_stand_alone", lambda processor: False)
    assert Counter(tuple(r) for r in encode_pieces(odd, PIECES, keep_output=False).collect()) == expected_pieces(odd)


def test_trie_holds_its_pairs_and_no_others():
    rng = np.random.default_rng(0)
    for n, codes, prefixes in ((10, 5, 3), (20_000, 3000, 500), (1000, 100_000, 1), (2000, 20_000_000, 900)):
        pairs = np.unique(np.stack([rng.zipf(1.2, 2 * n) % prefixes, rng.zipf(1.3, 2 * n) % codes + 1]), axis=1)
        roots, base, check, slots = double_array(*pairs)
        assert len(np.unique(slots)) == pairs.shape[1]
        trie = Trie(roots.tobytes(), base.tobytes(), check.tobytes(), digits_of(pairs[1].max()))
        assert (trie.step(*pairs) == slots).all()
        assert all((a == b).all() for a, b in zip(trie.spell(slots), pairs))
        known = {(a, b): s for a, b, s in zip(*pairs.tolist(), slots.tolist())}
        asked = rng.integers(0, prefixes + 5, 5000), rng.integers(1, 3 * codes, 5000)
        assert trie.step(*asked).tolist() == [known.get(pair, -1) for pair in zip(*(a.tolist() for a in asked))]


def plain_collocations(docs, least, longest, first):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, n = defaultdict(Counter), Counter()
    for r in docs.select("text", "lang").collect():
        lang = "und" if r["lang"] is None else r["lang"]
        for piece in re.split("[.,;:!?\x0a-\x0d]", (r["text"] or "").translate(fold)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                counts[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, of in counts.items():
        chosen = {p: a for p, a in of.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in chosen.items():
            value, k = min((2_000_000 * a // (of[p[:k]] + of[p[k:]]), k) for k in range(1, len(p)))
            around = [b for q, b in chosen.items() if len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in around):
                rows.append((-value, -a, " ".join(p).encode(), of[p[:k]], of[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, le, r, n[lang], -value) for i, (value, a, p, le, r) in enumerate(sorted(rows)[:first])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"block_size": 2000, "shard_words": 3000, "shard_size": 400}])
def test_collocations(odd, none, sizes):
    source = random.Random(3)
    words = ["The", "of", "new", "york", "City", "big", "apple", "é", "x\x00y", "漢字"]
    texts = [" ".join(source.choice(words[:3 + i % 8]) + source.choice(["", "", "", ",", " .", "\t", "\n", "  "]) for _ in range(60)) for i in range(60)]
    rows = [(i, t, ["en", "de", None, "und"][i % 4]) for i, t in enumerate([*texts, *["one two three four five. "] * 12, "a b " * 3000])]
    docs = odd.sparkSession.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string").unionByName(odd.select("doc_id", "text", "lang"))
    for least, longest, first in ((6, 4, 2000),) if sizes else ((3, 3, 10),):
        expected = plain_collocations(docs, least, longest, first)
        assert sorted(map(tuple, collocations(docs, least, longest, first, **sizes).collect())) == expected and len(expected) > 20
    assert collocations(none).count() == 0


def test_replaced_blocks_are_deleted(spark, monkeypatch):
    source = random.Random(5)
    texts = [" ".join(source.choice("abcdefghij") for _ in range(300)) for _ in range(30)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    folder = ensure_checkpoint_dir(spark).removeprefix("file:")
    written, there, cut = [], [], phrase_tries.cut_lineage

    def watched(df):
        before = set(os.listdir(folder))
        out = cut(df)
        if df.columns[:2] == ["block", "codes"]:
            written.extend(set(os.listdir(folder)) - before)
            there.append(len(set(written) & set(os.listdir(folder))))
        return out

    monkeypatch.setattr(phrase_tries, "cut_lineage", watched)
    monkeypatch.setattr(phrase_tries, "WAVE", 1, raising=False)
    found = sorted(map(tuple, collocations(docs, 3, 4, 50, shard_size=120).collect()))
    assert found == plain_collocations(docs, 3, 4, 50)
    assert len(written) > 6 and max(there) <= 2 and not set(written) & set(os.listdir(folder))


def test_tries_of_a_broadcast(monkeypatch):
    monkeypatch.setattr(phrase_tries, "WAVE", 10)
    assert phrase_tries.waves([(3, 4), (0, 6), (2, 30), (1, 4), (7, 9)]) == [[0, 1], [2], [3], [7]]
    assert phrase_tries.waves([]) == []


def test_candidates_of_more_cells_than_a_broadcast_held(spark):
    source = np.random.default_rng(2)
    codes = [source.integers(0, 40, 500).astype("<u4") for _ in range(6)]
    rows = [("", bytearray(squeeze(planes(c))), bytearray(squeeze(c.astype("<i8")))) for c in codes]
    coded = spark.createDataFrame(rows, phrase_tries.CODED).repartition(3)
    counts = Counter(pair for c in codes for pair in zip(c[:-1].tolist(), c[1:].tolist()) if min(pair) > 0)
    payloads = [r["payload"] for r in phrase_tries.candidates(coded, 1, 30, 3).collect()]
    pairs = [pair for p in payloads for pair in zip(*(x.tolist() for x in phrase_tries.unpack_pairs(p)))]
    assert sorted(pairs) == sorted(pair for pair, n in counts.items() if n >= 3) and len(pairs) > 100


@pytest.mark.parametrize("top", [50, 1 << 31])
def test_pairs_travel_packed(top):
    source = np.random.default_rng(4)
    prefixes, codes = source.integers(1, 20 * top * top // 50, 3000), source.integers(1, top, 3000)
    prefixes[:1000], codes[:1000] = prefixes[1000:2000], codes[1000:2000]
    found = phrase_tries.distinct(prefixes, codes)
    assert {(a, b): n for a, b, n in zip(*(x.tolist() for x in found))} == Counter(zip(prefixes.tolist(), codes.tolist()))
    assert all((a == b).all() for a, b in zip(phrase_tries.unpack_pairs(phrase_tries.pack_pairs(*found), 1), found))


def test_scores_are_exact(spark):
    rows = [(9_000_000_000_000_000_000, 9_000_000_000_000_000_000 * 2 + 1), (30, 61), (1, 3_000_000)]
    found = spark.createDataFrame([(a, str(p)) for a, p in rows], "a long, p string").select(score(F.col("a"), F.col("p").cast("decimal(20,0)"))).collect()
    assert [r[0] for r in found] == [2_000_000 * a // p for a, p in rows]
