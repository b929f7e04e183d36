"""Token counts, packing, encoding and decoding, held against the tokenizers library on whole texts."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from replyloom.llm import chunk_bpe, packing
from replyloom.llm.chunk_bpe import encode_documents
from replyloom.llm.fast_bytes import text_encoder
from replyloom.llm.packing import pack
from replyloom.llm.token_counts import token_counts
from replyloom.llm.token_units import BYTE_WORDS, LOWER_WORDS, Pieces, long_cut, read_vocabulary

from .conftest import texts_of

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
byte_tokenizer, word_tokenizer = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)

PARTS = st.sampled_from(["a", "the", "don't", "'s", "É", "İ", "ß", "Σ", "́", " ", "  ", "\n", "\t", " ", "\x1c", "12", "3", ".", "!!", "<|endoftext|>",
                         "<|startoftext|>", "<|", "漢", "😀", "x" * 90])
TEXTS = st.lists(PARTS, max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_pieces_equal_whole_texts(values):
    for tokenizer, words, lower in ((byte_tokenizer, BYTE_WORDS, False), (word_tokenizer, LOWER_WORDS, True)):
        pieces = Pieces(lambda parts: [e.ids for e in tokenizer.encode_batch(parts, add_special_tokens=False)],
                        lambda lists: [i for ids in lists for i in ids], words, lower)
        expected = [e.ids for e in tokenizer.encode_batch(values, add_special_tokens=False)]
        assert pieces.texts(values) == expected
        assert pieces.texts(values) == expected  # now from memory


def test_separators_are_no_white_space_to_the_vocabularies():
    """U+001C to U+001F next to a word, and in a long piece without blanks."""
    values = [f"{c}a" for c in "\x1c\x1d\x1e\x1f"] + ["b \x1fa", "!!\x1ca" * 30_000]
    for tokenizer, words, lower in ((byte_tokenizer, BYTE_WORDS, False), (word_tokenizer, LOWER_WORDS, True)):
        pieces = Pieces(lambda parts: [e.ids for e in tokenizer.encode_batch(parts, add_special_tokens=False)],
                        lambda lists: [i for ids in lists for i in ids], words, lower)
        assert pieces.texts(values) == [e.ids for e in tokenizer.encode_batch(values, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_fast_encoder_equals_library(text):
    encode = text_encoder(read_vocabulary(BYTES), public_tokenizers.PATTERN)
    assert encode(text).tolist() == byte_tokenizer.encode(text, add_special_tokens=False).ids


def test_long_pieces_are_cut_and_whole_again():
    text = "ab\tcd" * 40_000
    parts = long_cut(text, 1000)
    assert "".join(parts) == text and max(map(len, parts)) < 1100


def counts(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in df.collect())


def test_token_counts(odd, small, none):
    for docs in (odd, small):
        expected = Counter()
        for doc_id, text in texts_of(docs):
            n = len(byte_tokenizer.encode(text, add_special_tokens=False).ids)
            expected[doc_id, len(text.encode()), n, n > 1024] += 1
        assert counts(token_counts(docs, BYTES)) == expected
        assert counts(token_counts(docs, BYTES, batch_bytes=50, column_bytes=200)) == expected
    assert token_counts(none, BYTES).count() == 0


def check_packing(docs, rows, tiers):
    """Every id in exactly one piece, sequences gapless; gives tokens and padding."""
    expected = Counter()
    for doc_id, text in texts_of(docs):
        ids = np.array([*byte_tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        expected.update((doc_id, len(ids), int(at), int(i)) for at, i in enumerate(ids.tolist()))
    texts = defaultdict(list)
    for doc_id, text in texts_of(docs):
        ids = np.array([*byte_tokenizer.encode(text, add_special_tokens=False).ids, 0], dtype="<u4")
        texts[doc_id, len(ids)].append(ids)
    covered = Counter()
    for r in rows:
        same = texts[r["doc_id"], r["doc_tokens"]]
        ids = next(i for i in same if zlib.crc32(i[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"])
        covered.update((r["doc_id"], r["doc_tokens"], at, int(ids[at])) for at in range(r["start"], r["start"] + r["length"]))
    assert covered == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append(r)
    padding = 0
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r["offset"])
        at = 0
        for r in pieces:
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= tiers[-1] and len({r["step_group"] for r in pieces}) == 1
        padded = at if at & (at - 1) == 0 else tiers[-1]
        assert {r["tier"] for r in pieces} == {padded}
        padding += padded - at
    return sum(r["length"] for r in rows), padding


def test_packing(odd, small, none):
    for docs, settings_ in ((odd.coalesce(1), {}), (small.coalesce(1), {}), (small.coalesce(1), {"block_tokens": 3000, "group_tokens": 4096})):
        rows = pack(docs, BYTES, public_tokenizers.PATTERN, **settings_).collect()
        _, padding = check_packing(docs, rows, packing.TIERS)
        assert padding < packing.TIERS[0]
    groups = defaultdict(int)
    for r in rows:
        groups[r["step_group"]] += r["length"]
    assert pack(none, BYTES, public_tokenizers.PATTERN).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), min_size=1, max_size=40))
def test_windows_are_full(lengths):
    tiers = (8, 16, 32, 64)
    items = [(min(n, 64), row, 0) for row, n in enumerate(lengths)]
    windows, left = packing.fill_windows(items, tiers)
    assert all(sum(p[0] for p in w) in tiers for w in windows)
    last = packing.last_windows(left, tiers)
    every = sorted((row, start, n) for w in windows + last for n, row, start in w)
    ends = defaultdict(int)
    for row, start, n in every:
        assert start == ends[row]
        ends[row] += n
    assert dict(ends) == {row: n for n, row, _ in items}
    assert all(sum(p[0] for p in w) <= 64 for w in last)


def test_step_groups_are_balanced():
    windows = [[(64, i, 0)] for i in range(40)] + [[(32, i, 0)] * 2 for i in range(40)]
    chosen = packing.step_groups(windows, 640)
    totals, costs = defaultdict(int), defaultdict(int)
    for window, group in zip(windows, chosen):
        totals[group] += sum(p[0] for p in window)
        costs[group] += sum(p[0] ** 2 for p in window)
    assert len(totals) == 8 and set(totals.values()) == {640} and max(costs.values()) < 1.3 * min(costs.values())


def expected_encodings(docs):
    out = Counter()
    for doc_id, text in texts_of(docs):
        ids = word_tokenizer.encode(text, add_special_tokens=False).ids
        decoded = word_tokenizer.decode(ids, skip_special_tokens=False)
        out[doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    return out


def test_encoding(odd, small, none):
    for docs in (odd, small, small.unionByName(small.selectExpr("doc_id + 10000 as doc_id", "concat('x ', text, ' y') as text", "lang", "source", "n_chars"))):
        rows = encode_documents(docs, WORDS, keep_output=False).collect()
        assert Counter(tuple(r) for r in rows) == expected_encodings(docs)
    assert encode_documents(none, WORDS).count() == 0


def test_encoding_gives_ids_and_text(odd):
    rows = encode_documents(odd.filter("doc_id = 6"), WORDS).collect()
    assert np.frombuffer(rows[0]["ids"], "<u4").tolist() == word_tokenizer.encode(rows and odd_text(6), add_special_tokens=False).ids
    assert "<|startoftext|>" in rows[0]["decoded"]


def odd_text(doc_id):
    from .conftest import odd_rows

    return next(r[1] for r in odd_rows() if r[0] == doc_id)


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    passage = bytes(rng.integers(97, 123, 60_000, dtype=np.uint8))
    texts = [passage, b"some other beginning, " + passage, passage[:30_000] + b"!" + passage[30_000:]]
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])
    cut = [[t[a:b] for a, b in zip([0, *ends], ends)] for t, ends in zip(texts, chunk_bpe.cut_places(buffer, starts))]
    assert [b"".join(c) for c in cut] == texts
    for other in cut[1:]:
        assert len(set(cut[0]) & set(other)) > 0.8 * len(cut[0])
    assert max(len(c) for c in cut[0]) <= 16384


def test_chunks_do_not_cut_characters():
    texts = ["é漢😀" * 20_000, "", "x"]
    encoded = [t.encode() for t in texts]
    buffer = np.frombuffer(b"".join(encoded), np.uint8)
    starts = np.cumsum([0, *map(len, encoded)])
    for data, ends in zip(encoded, chunk_bpe.cut_places(buffer, starts)):
        assert b"".join(data[a:b] for a, b in zip([0, *ends], ends)) == data
        for a, b in zip([0, *ends], ends):
            data[a:b].decode()


@pytest.mark.parametrize("wrong", [False, True])
def test_joins_are_repaired(wrong):
    """A core whose ids at an end are not what the join gives is taken back piece by piece."""
    encode = lambda text: bytes(len(w) for w in text.split())
    pieces = [" aa", " b", " cccc"]
    ids = b"".join(map(encode, pieces))
    if wrong:
        ids = b"\x09" + ids[1:]
    assert chunk_bpe.joined(["head", (pieces, ids), "tail end"], encode) == encode("head aa b cccctail end")
