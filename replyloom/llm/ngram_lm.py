"""Log probabilities of texts under an n-gram model learned from the corpus itself.

The model interpolates trigrams, bigrams and unigrams by absolute discounting. It lies in Elias-Fano tries
(:mod:`elias_fano`), one per shard. A trigram belongs to the shard of its middle word, where both its context and
its suffix live, so a lookup never leaves a shard. One shuffle brings all trigrams of all texts to their shards, packed. A shard goes through its middle words in
groups of bounded size: it builds a group's trie from the learned texts, maps it from a file, and scores all
trigrams of the group. What leaves is one sum per text and shard.

Every word of up to 64 bytes has n-grams of its own. Frequent words have short ids (``dictionary`` of them, and all with
more than a unit of trigrams, sent to the tasks); the others are named by a 64-bit hash, and numbered again within each
unit's trie. As a shard doesn't know how often such a word occurs, it gives what is left of the probability as a + b p.
The counts of these words are dealt to the shards by hash, each shard answers the words that a batch of texts asks of it, and
counts and shares meet where the batch's sums do. Longer words form one class in n-grams, times the word's share of the class.

Middle words with more than ``unit_grams`` trigrams are split into units by their left neighbour, pairs of neighbours
with more than that by what follows them, and trigrams with more than that by text. What follows such a word needs
counts over all its units; it is counted before, and a shard gets the counts of those followers of its own trigrams that other
units have as well.
"""

from __future__ import annotations

import heapq
import math
import struct
import uuid
import zlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage, fold, kept, sliced, texts, worker_cache
from replyloom.llm.elias_fano import IDS, Trie, build_trie

START, END, RARE, FIRST = 0, 1, 2, 3
HASHED = -(1 << 63)
#: log10 of the share of a hashed word that its shard doesn't know.
NOTHING = -300.0
PART = "shard int, kind int, payload binary, b long, n long"
COUNTS, FOLLOWERS, GRAMS, HEADS = range(4)
#: What leaves a shard for a batch of texts: the head of the batch, or sums of its texts with shares and counts of words.
SUMS = "batch long, kind int, payload binary"
HEAD_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "base", "score"]
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double"
#: Counts of what follows hot words, packed, and their sums by word, by pair and by trigram.
FOLLOWED = "kind int, payload binary, b long, a long, w long, n long, types long"
PACKED, WORDS, PAIRS, TRIPLES = range(4)


@dataclass
class Frequencies:
    """Counts over the learned texts. ``words`` are the frequent ones, most frequent first; the class is that of words over 64 bytes."""

    tokens: int
    types: int
    learned: int
    words: list[bytes]
    counts: list[int]
    class_tokens: int
    class_types: int
    complete: bool

    def unigrams(self):
        """log10 probability by id; the start of a text is never asked for."""
        import numpy as np

        counts = np.array([0, self.learned, self.class_tokens + self.class_types, *self.counts], dtype=np.float64)
        return np.log10((counts + 1) / (self.tokens + self.types + 1))


def learned_texts(docs: DataFrame, folds: int, held_fold: int) -> DataFrame:
    """``doc_id, text, held_out``."""
    return texts(docs).withColumn("held_out", F.coalesce(fold("doc_id", folds) == held_fold, F.lit(False)))


def words_of(column):
    """The words of an Arrow array of texts in a row, as bytes with A-Z in lower case, and the place of each one's text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    # A slice is copied first: ascii_lower takes a slice's texts from the wrong place.
    lowered = pc.ascii_lower(pa.array(column.to_pylist(), pa.large_string()))
    split = pc.ascii_split_whitespace(lowered)
    words, texts_ = split.flatten().cast(pa.large_binary()), pc.list_parent_indices(split)
    full = pc.greater(pc.binary_length(words), 0)
    return words.filter(full), texts_.filter(full).to_numpy()


def word_counts(rows: DataFrame, most: int = 300_000) -> DataFrame:
    """``word, n``: how often each word occurs in the learned texts."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        def flushed(counts):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
            )

        counts: Counter = Counter()
        for batch in sliced(batches, "text"):
            found = words_of(batch["text"])[0].value_counts()
            counts.update(dict(zip(found.field("values").to_pylist(), found.field("counts").to_pylist())))
            if len(counts) > most:
                yield flushed(counts)
                counts.clear()
        if counts:
            yield flushed(counts)

    parts = rows.filter(~F.col("held_out")).select("text").mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def frequencies(rows: DataFrame, vocabulary: DataFrame, dictionary: int, hot: float) -> Frequencies:
    """Totals, and the words frequent enough for the dictionary: ``dictionary`` at most, and all that occur more than ``hot`` times."""
    learned = rows.select("held_out").filter(~F.col("held_out")).count()
    is_short = F.length("word") <= 64
    total = vocabulary.agg(
        F.count(F.lit(1)).alias("types"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"),
        F.count(F.when(is_short, 1)).alias("short_types"), F.coalesce(F.sum(F.when(is_short, F.col("n"))), F.lit(0)).alias("short_tokens"),
    ).first()
    short = vocabulary.filter(is_short)
    steps = F.least("n", F.lit(1_000_000))
    least, room = 1_000_001, dictionary
    for row in sorted(short.groupBy(steps.alias("n")).count().collect(), key=lambda r: -r["n"]):
        room -= row["count"]
        if room < 0 and row["n"] <= hot:
            break
        least = row["n"]
    frequent = sorted(((r["n"], bytes(r["word"])) for r in short.filter(F.col("n") >= least).toLocalIterator()), key=lambda x: (-x[0], x[1]))
    return Frequencies(
        total["tokens"] + learned, total["types"] + bool(learned), learned, [w for _, w in frequent], [n for n, _ in frequent],
        total["tokens"] - total["short_tokens"], total["types"] - total["short_types"], len(frequent) == total["short_types"],
    )


def units_needed(sizes: list[float], most: float) -> list[int]:
    return [max(1, math.ceil(s / most)) for s in sizes]


def shards_of_units(sizes: list[float], shards: int, most: float, pieces: list[int] | None = None) -> tuple[list[int], list[int]]:
    """Where each id's units begin in the second list, and the shard of each unit.

    An id has one unit, or as many as keep each below ``most``, if ``pieces`` doesn't tell how many; the largest units go
    first, each to the shard with the least.
    """
    pieces = pieces or units_needed(sizes, most)
    begins = [0]
    for p in pieces:
        begins.append(begins[-1] + p)
    load = [(0.0, s) for s in range(shards)]
    chosen = [0] * begins[-1]
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i] / pieces[i]):
        for unit in range(begins[i], begins[i + 1]):
            weight, shard = heapq.heappop(load)
            chosen[unit] = shard
            heapq.heappush(load, (weight + sizes[i] / pieces[i], shard))
    return begins, chosen


def token_stream(column, ids: dict, complete: bool):
    """Codes of the words of an Arrow array of texts in a row, each text with two starts before and an end after; words of each text; keys.

    A word with an id has that; others have the number of ids and their place in the keys, two columns: the word's hash, and
    its code in n-grams, which is the hash or, for words of the class, that of the class.
    """
    import itertools

    import numpy as np
    import xxhash

    words, text_of_word = words_of(column)
    n_texts = len(column)
    lengths = np.bincount(text_of_word, minlength=n_texts)
    # Each different word is looked up once.
    coded = words.dictionary_encode()
    listed = coded.dictionary.to_pylist()
    codes_of = np.fromiter(map(ids.get, listed, itertools.repeat(RARE)), np.int64, len(listed))
    rare = np.flatnonzero(codes_of == RARE)
    listed = [listed[i] for i in rare.tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(w, 42) for w in listed), np.uint64, len(listed)).view(np.int64) | HASHED
    hashes, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    in_class = np.array([complete or len(listed[i]) > 64 for i in first.tolist()], bool)
    codes_of[rare] = which + len(ids) + FIRST
    stream = np.full(len(words) + 3 * n_texts, START, np.int64)
    stream[np.arange(len(words)) + 3 * text_of_word + 2] = codes_of[coded.indices.to_numpy()]
    stream[np.cumsum(lengths) + 3 * np.arange(n_texts) + 2] = END
    return stream, lengths, np.stack([hashes, np.where(in_class, RARE, hashes)])


def codes(local, keys, n_ids: int):
    """Codes that hold in all batches: ids, and hashes, which are negative."""
    import numpy as np

    out = local.astype(np.int64)
    at = np.flatnonzero(out >= n_ids)
    out[at] = keys[1][out[at] - n_ids]
    return out


def trigrams(stream, lengths):
    """w1, w2, w3 and the text of each word and end of a stream."""
    import numpy as np

    text = np.repeat(np.arange(len(lengths)), lengths + 1)
    at = np.arange(len(text)) + 2 * text + 2
    return stream[at - 2], stream[at - 1], stream[at], text


def share_of(w1, units):
    """Which of a middle word's units has a left neighbour."""
    return (w1 * 2654435761 % (1 << 32)) % units


def unit_of(w1, w2, batch: int, starts, pairs, pair_starts, w3=None, triples=(), triple_starts=None):
    """The unit that trigrams belong to: their middle word, for frequent ones a share of its left neighbours, for
    frequent ``pairs`` of both a share of the followers ``w3``, for frequent ``triples`` (place of the pair and follower)
    a share of the batches, as for pairs where no followers are given. Hashed words follow, in groups."""
    import numpy as np

    id2 = np.maximum(w2, 0)
    out = starts[id2] + share_of(w1, starts[id2 + 1] - starts[id2])
    hashed = w2 < 0
    out[hashed] = (pair_starts if w3 is None else triple_starts)[-1] + ((w2[hashed] >> 20) & 0xFFFF)
    of_batch = zlib.crc32(struct.pack("<q", batch))
    if len(pairs):
        both = np.where((w1 >= 0) & ~hashed, (w2 << 24) | w1, -1)
        at = np.minimum(np.searchsorted(pairs, both), len(pairs) - 1)
        hot = np.flatnonzero(pairs[at] == both)
        at = at[hot]
        share = of_batch if w3 is None else w3[hot]
        out[hot] = pair_starts[at] + share % (pair_starts[at + 1] - pair_starts[at])
        if len(triples):
            all_three = np.where(w3[hot] >= 0, (at << 24) | w3[hot], -1)
            at = np.minimum(np.searchsorted(triples, all_three), len(triples) - 1)
            same = np.flatnonzero(triples[at] == all_three)
            at = at[same]
            out[hot[same]] = triple_starts[at] + of_batch % (triple_starts[at + 1] - triple_starts[at])
    return out


def numbered(values, n_ids: int):
    """The different codes, sorted, and the place of each value among them; ids by a table, hashes by sorting."""
    import numpy as np

    has_id = values >= 0
    ids = values[has_id]
    table = np.zeros(n_ids, np.int64)
    table[ids] = 1
    listed = np.flatnonzero(table)
    hashes, places = np.unique(values[~has_id], return_inverse=True)
    table[listed] = np.arange(len(hashes), len(hashes) + len(listed))
    out = np.empty(len(values), np.int64)
    out[has_id], out[~has_id] = table[ids], places
    return np.concatenate((hashes, listed)), out


def planes(numbers) -> bytes:
    """32-bit numbers, byte by byte, which packs well."""
    import numpy as np

    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def from_planes(data, n: int, at: int):
    import numpy as np

    out = np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at).reshape(4, n).T)
    return out.view("<u4").ravel().astype(np.int64)


def in_part(b, w, parts: int):
    """The part that counts of a follower are summed in."""
    import numpy as np

    mixed = (w.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((mixed ^ (mixed >> np.uint64(29))) >> np.uint64(7)) % np.uint64(parts)


def pack_followers(unit, a, w, n) -> bytes:
    """Counts by unit, word before (-1: not told) and follower; sorted by follower they pack well."""
    return struct.pack("<Q", len(unit)) + planes(unit) + planes(a + 1) + n.astype("<i8").tobytes() + w.astype("<i8").tobytes()


def followers_packed(data):
    import numpy as np

    size, = struct.unpack_from("<Q", data)
    unit, a = (from_planes(data, size, 8 + i * 4 * size) for i in range(2))
    n, w = (np.frombuffer(data, "<i8", size, 8 + (8 + i * 8) * size) for i in range(2))
    return unit, a - 1, w, n


def runs(*columns):
    """Where runs of equal rows begin in sorted columns."""
    import numpy as np

    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def summed(values, first):
    """Sums of the runs that begin at ``first``."""
    import numpy as np

    return np.diff(np.concatenate(([0], np.cumsum(values)))[np.append(first, len(values))])


def score_texts(
    docs: DataFrame, folds: int = 7, held_fold: int = 2, dictionary: int = 250_000, shard_grams: int = 1_500_000,
    unit_grams: int = 500_000, discount: float = 0.75, batch_bytes: int = 3 << 20,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``: a row for each row of ``docs``.

    Learned are the texts whose crc32 of the id as text, modulo ``folds``, is not ``held_fold``; those without id
    too. Tokens are the words of a text, A-Z in lower case, and one end; so null and empty texts have one
    token. ``base_score`` sums log10((c + 1) / (N + V + 1)), ``score`` the log10 probabilities of the model. Without any
    learned text both are 0. A repeated row counts, and is scored, as often as it occurs. Sums find their text by input
    split and place in it, so ``docs`` should be a table or a checkpoint, which a task that runs again reads in the same order.
    """
    import numpy as np

    spark = docs.sparkSession
    rows = learned_texts(docs, folds, held_fold)
    vocabulary = cut_lineage(word_counts(rows))
    n_rows = rows.count()
    n_learned = rows.filter(~F.col("held_out")).count()
    share = max(1, n_rows) / max(1, n_learned)
    known = frequencies(rows, vocabulary, dictionary, unit_grams / share)
    unigrams = known.unigrams()
    n_ids = len(known.words) + FIRST
    all_mass = known.tokens + known.types + 1
    log_all = math.log10(all_mass)
    class_mass = known.class_tokens + known.class_types + 1

    # Sizes as contexts, over all texts: every text has a start that is a middle word, and an end.
    sizes = [share * x for x in (known.learned, known.learned, known.class_tokens, *known.counts)]
    shards = max(1, math.ceil(share * known.tokens / shard_grams))
    hot = [i for i, x in enumerate(sizes) if x > unit_grams]
    sent_words = spark.sparkContext.broadcast(b"\n".join(known.words))
    model_key = uuid.uuid4().hex

    def loaded_ids():
        def ids():
            listed = sent_words.value
            return {w: i + FIRST for i, w in enumerate(listed.split(b"\n"))} if listed else {}

        return kept("n-gram words", model_key, ids)

    pieces = units_needed(sizes, unit_grams)
    hot_units = {i: (sum(pieces[:i]), pieces[i]) for i in hot}

    # Units of hot words, in order, and their words.
    hot_firsts, hot_ids = [hot_units[i][0] for i in hot], list(hot)
    follow_parts = max(1, shards // 3)

    def followers(batches):
        """How often each word follows each hot one in the learned texts of a batch, apart by unit, and by the word before where
        that is hot too, packed by part. What stands in other texts only has count 0."""
        import numpy as np
        import pyarrow as pa
        import zstandard

        ids = loaded_ids()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        first_unit, n_units = np.zeros(n_ids + 1, np.int64), np.zeros(n_ids + 1, np.int64)
        for i, (first, n) in hot_units.items():
            first_unit[i], n_units[i] = first, n
        for batch in sliced(batches, "text", batch_bytes):
            held = batch["held_out"].to_numpy(zero_copy_only=False)
            stream, lengths, keys = token_stream(batch["text"], ids, known.complete)
            a, b, w, text = trigrams(stream, lengths)
            # Only words with ids are hot.
            at = np.flatnonzero(n_units[np.minimum(b, n_ids)])
            a, b, w = codes(a[at], keys, n_ids), b[at], codes(w[at], keys, n_ids)
            learned = ~held[text[at]]
            unit = first_unit[b] + share_of(a, n_units[b])
            a = np.where(n_units[np.where(a >= 0, a, n_ids)] > 0, a, -1)
            part = in_part(b, w, follow_parts)
            # Units are numbered by word, and a word before belongs to one unit, so these two tell all.
            order = np.lexsort(((unit << 24) | (a + 1), w, part))
            a, w, unit, part = a[order], w[order], unit[order], part[order]
            first = runs(w, unit, a)
            a, w, unit, part, n = a[first], w[first], unit[first], part[first], summed(learned[order], first)
            edges = np.searchsorted(part, np.arange(follow_parts + 1, dtype=np.uint64))
            mine = [p for p in range(follow_parts) if edges[p] < edges[p + 1]]
            packed = [squeeze(pack_followers(*[x[edges[p]:edges[p + 1]] for x in (unit, a, w, n)])) for p in mine]
            yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int32()), pa.array(packed, pa.binary())], names=["part", "payload"])

    def added(batches):
        """The counts of a part over all batches, and its shares of the sums by word, pair and trigram."""
        import numpy as np
        import pyarrow as pa
        import zstandard

        squeeze, expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        firsts, words = np.array(hot_firsts), np.array(hot_ids)

        def rows_of(kind, **columns):
            size = len(next(iter(columns.values())))
            values = [pa.array(columns[c]) if c in columns else pa.nulls(size, t) for c, t in (
                ("payload", pa.binary()), ("b", pa.int64()), ("a", pa.int64()), ("w", pa.int64()), ("n", pa.int64()), ("types", pa.int64()))]
            names = ["kind", "payload", "b", "a", "w", "n", "types"]
            return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), *values], names=names)

        def of_part(payloads):
            unit, a, w, n = (np.concatenate(x) for x in zip(*(followers_packed(expand(p)) for p in payloads)))
            order = np.lexsort(((unit << 24) | (a + 1), w))
            unit, a, w, n = unit[order], a[order], w[order], n[order]
            first = runs(w, unit, a)
            unit, a, w, n = unit[first], a[first], w[first], summed(n, first)
            yield rows_of(PACKED, payload=pa.array([squeeze(pack_followers(unit, a, w, n))], pa.binary()))
            # Sorted by follower and unit, a hot word's rows lie together.
            b = words[np.searchsorted(firsts, unit, side="right") - 1]
            first = runs(w, b)
            total, of = summed(n, first), b[first]
            sums = np.bincount(of, weights=total, minlength=1).astype(np.int64)
            types = np.bincount(of, weights=total > 0, minlength=1).astype(np.int64)
            there = np.flatnonzero(sums)
            yield rows_of(WORDS, b=there, n=sums[there], types=types[there])
            both = np.flatnonzero((a >= 0) & (n > 0))
            pair, which = np.unique((b[both] << 24) | a[both], return_inverse=True)
            yield rows_of(
                PAIRS, b=pair >> 24, a=pair & ((1 << 24) - 1),
                n=np.bincount(which, weights=n[both], minlength=len(pair)).astype(np.int64), types=np.bincount(which, minlength=len(pair)),
            )
            often = np.flatnonzero((a >= 0) & (n * share > unit_grams) & (w >= 0))
            yield rows_of(TRIPLES, b=b[often], a=a[often], w=w[often], n=n[often])

        part, payloads = None, []
        for batch in batches:
            for p, payload in zip(batch["part"].to_pylist(), batch["payload"].to_pylist()):
                if p != part and payloads:
                    yield from of_part(payloads)
                    payloads = []
                part = p
                payloads.append(payload)
        if payloads:
            yield from of_part(payloads)

    # Frequent words, pairs and trigrams, each with its count and the number of its different followers.
    hot_totals: dict[int, tuple[int, int]] = {}
    pairs: list[tuple] = []
    triples: list[tuple] = []
    loads = list(sizes)
    if hot:
        counted = rows.select("text", "held_out").mapInArrow(followers, "part int, payload binary")
        counted = cut_lineage(counted.repartition("part").sortWithinPartitions("part").mapInArrow(added, FOLLOWED))
        both = F.sum("n").alias("n"), F.sum("types").alias("types")
        hot_totals = {r["b"]: (r["n"], r["types"]) for r in counted.filter(F.col("kind") == WORDS).groupBy("b").agg(*both).collect()}
        before = counted.filter(F.col("kind") == PAIRS).groupBy("a", "b").agg(*both)
        pairs = sorted((r["b"], r["a"], r["n"], r["types"]) for r in before.filter(F.col("n") * share > unit_grams).collect())
        place = {(b, a): i for i, (b, a, *_) in enumerate(pairs)}
        triples = sorted((place[r["b"], r["a"]], r["w"], r["n"]) for r in counted.filter(F.col("kind") == TRIPLES).collect())
        for b, _, n, _ in pairs:
            loads[b] = max(0.0, loads[b] - share * n)
        pieces += units_needed([share * n for _, _, n, _ in pairs], unit_grams)
        loads += [share * n for _, _, n, _ in pairs]
        for i, _, n in triples:
            loads[n_ids + i] = max(0.0, loads[n_ids + i] - share * n)
        pieces += units_needed([share * n for _, _, n in triples], unit_grams)
        loads += [share * n for _, _, n in triples]
    begins, unit_shards = shards_of_units(loads, shards, unit_grams, pieces)
    sent = spark.sparkContext.broadcast((np.array(begins, np.int64), np.array(unit_shards, np.int32), unigrams, pairs, triples, hot_totals))

    def loaded():
        """Begins and shards of units, unigrams, and what :func:`unit_of` wants to know of pairs and triples."""
        import numpy as np

        def arrays():
            starts, of_units, log10, pairs, triples, _ = sent.value
            pair_codes = np.array([(b << 24) | a for b, a, *_ in pairs], np.int64)
            triple_codes = np.array([(i << 24) | w for i, w, _ in triples], np.int64)
            of_pairs, of_triples = starts[n_ids:n_ids + len(pairs) + 1], starts[n_ids + len(pairs):]
            return starts, of_units, np.asarray(log10), (pair_codes, of_pairs), (triple_codes, of_triples)

        return kept("n-gram units", model_key, arrays)

    def dealt(batches):
        """Packed trigrams for their shards, and the heads of texts."""
        import numpy as np
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        ids = loaded_ids()
        starts, of_units, log10, of_pairs, of_triples = loaded()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        name = TaskContext.get().partitionId() << 32
        for batch in sliced(batches, "text", batch_bytes):
            n_texts = batch.num_rows
            held = batch["held_out"].to_numpy(zero_copy_only=False)
            stream, lengths, keys = token_stream(batch["text"], ids, known.complete)
            w1, w2, w3, text = trigrams(stream, lengths)
            out: list[tuple] = []
            # Heads: what needs no shard.
            by_id = w3 < n_ids
            plain = np.where(by_id, log10[np.where(by_id, w3, 0)], 0.0)
            firsts = np.cumsum(lengths + 1) - lengths - 1
            known_words = np.add.reduceat(by_id.astype(np.int64), firsts) * bool(known.learned)
            head = pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(lengths + 1), pa.array(known_words), pa.array(np.add.reduceat(plain, firsts))],
                names=HEAD_NAMES[:-1],
            )
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as writer:
                writer.write_batch(head)
            out.append((name % shards, HEADS, struct.pack("<qq", name, keys.shape[1]) + sink.getvalue().to_pybytes()))
            # Trigrams, by shard; learned and held-out texts stay apart by a mark per text.
            code1, code2, code3 = (codes(w, keys, n_ids) for w in (w1, w2, w3))
            unit = unit_of(code1, code2, name, starts, *of_pairs, code3, *of_triples)
            shard = of_units[np.minimum(unit, starts[-1] - 1)]
            hashed = code2 < 0
            shard[hashed] = (code2[hashed] - HASHED) % shards
            order = np.argsort(shard, kind="stable")
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            # The words that a shard is asked to count: those whose hash is its own.
            asked_of = (keys[0] - HASHED) % shards
            asked = np.argsort(asked_of, kind="stable")
            asked_edges = np.searchsorted(asked_of[asked], np.arange(shards + 1))
            for s in range(shards):
                mine, ask = order[edges[s]:edges[s + 1]], asked[asked_edges[s]:asked_edges[s + 1]]
                if not len(mine) and not len(ask):
                    continue
                here, counts = np.unique(text[mine], return_counts=True)
                three = np.concatenate((w1[mine], w2[mine], w3[mine]))
                # The keys of other words than those with ids, numbered anew.
                rare = np.flatnonzero(three >= n_ids)
                used, which = np.unique(three[rare] - n_ids, return_inverse=True)
                three[rare] = which + n_ids
                out.append((s, GRAMS, struct.pack("<QQQQQ", name, len(here), len(mine), len(used), len(ask)) + squeeze(
                    held[here].tobytes() + planes(here) + planes(counts) + planes(three) + keys[0][used].tobytes()
                    + (keys[1][used] == RARE).tobytes() + planes(used) + planes(ask) + keys[0][ask].tobytes()
                )))
            name += 1
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary()),
                 *[pa.nulls(len(out), pa.int64())] * 2], names=["shard", "kind", "payload", "b", "n"],
            )

    def scored(batches):
        import mmap
        import tempfile

        import numpy as np
        import pyarrow as pa
        import zstandard

        # What dealing out needed is not needed here, nor what Arrow has kept for it.
        worker_cache("n-gram words").clear()
        pa.default_memory_pool().release_unused()
        starts, _, log10, of_pairs, of_triples = loaded()
        *_, pairs, triples, hot_totals = sent.value
        pair_words = np.array([(a, b) for b, a, *_ in pairs], np.int64).reshape(-1, 2)
        triple_words = np.array([(pairs[i][1], pairs[i][0], w) for i, w, _ in triples], np.int64).reshape(-1, 3)
        triple_counts = np.array([n for *_, n in triples], np.int64)
        hot_words = np.array(sorted(hot_totals), np.int64)
        expand, squeeze = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        head_size = struct.calcsize("<QQQQQ")

        def grams_of(payload):
            """Batch, texts, trigrams, and the words asked for, of which the last two columns are."""
            batch, texts_here, n, n_keys, n_asked = struct.unpack_from("<QQQQQ", payload)
            data = expand(memoryview(payload)[head_size:])
            held = np.frombuffer(data, np.bool_, texts_here)
            at = texts_here
            place, counts = (from_planes(data, texts_here, at + i * 4 * texts_here) for i in range(2))
            at += 8 * texts_here
            three = from_planes(data, 3 * n, at)
            at += 12 * n
            keys = np.frombuffer(data, np.int64, n_keys, at) if n_keys else np.zeros(0, np.int64)
            in_class = np.frombuffer(data, np.bool_, n_keys, at + 8 * n_keys) if n_keys else np.zeros(0, bool)
            at += 9 * n_keys
            used, asked = from_planes(data, n_keys, at), from_planes(data, n_asked, at + 4 * n_keys)
            asked_keys = np.frombuffer(data, np.int64, n_asked, at + 4 * (n_keys + n_asked))
            keys = np.stack([keys, np.where(in_class, RARE, keys)])
            of_class = np.zeros(n, bool)
            last = three[2 * n:]
            rare = np.flatnonzero(last >= n_ids)
            of_class[rare] = in_class[last[rare] - n_ids]
            key_at = np.zeros(n, np.int32)
            key_at[rare] = used[last[rare] - n_ids]
            a, b = codes(three[:n], keys, n_ids), codes(three[n:2 * n], keys, n_ids)
            return batch, place, held, counts, (asked, asked_keys), a, b, codes(last, keys[[0, 0]], n_ids), of_class, key_at

        def among(values, wanted):
            """Which of the sorted values are among the sorted wanted, and their places there."""
            at = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
            same = np.flatnonzero(wanted[at] == values)
            return same, at[same]

        def places(values, listed):
            """Places of values among the sorted ones listed, and which of them are there."""
            at = np.minimum(np.searchsorted(listed, values), len(listed) - 1)
            return at, listed[at] == values

        def of_unit(a, b, key, of_class, use, follow):
            """log10 of each trigram's probability, and of the weight of the last word's own."""
            ua, a = numbered(a, n_ids)
            ub, b = numbered(b, n_ids)
            uc, c = numbered(np.where(of_class, RARE, key), n_ids)
            if max(len(ua), len(ub), len(uc)) > IDS:
                raise ValueError("a unit has too many different words; unit_grams must be smaller")
            asked, which = np.unique((b << 40) | (a << 20) | c, return_inverse=True)
            del a, b, c
            n = np.bincount(which[use], minlength=len(asked))
            if len(triple_words):
                (x, in_a), (y, in_b), (z, in_c) = (places(triple_words[:, i], u) for i, u in enumerate((ua, ub, uc)))
                at, there = places((y << 40) | (x << 20) | z, asked)
                there &= in_a & in_b & in_c
                n[at[there]] = triple_counts[there]
            split, contexts = {}, {}
            at, there = places(hot_words, ub)
            for w, node in zip(hot_words[there].tolist(), at[there].tolist()):
                words, counts = follow.get(w, (hot_words[:0], hot_words[:0]))
                followers, known_here = places(words, uc)
                split[node] = (followers[known_here], counts[known_here], *hot_totals[w])
            if len(pairs):
                (x, in_a), (y, in_b) = (places(pair_words[:, i], u) for i, u in enumerate((ua, ub)))
                for i in np.flatnonzero(in_a & in_b).tolist():
                    contexts[int(y[i] << 20 | x[i])] = pairs[i][2:]
            of_words = np.where(uc >= 0, log10[np.maximum(uc, 0)], NOTHING)
            with tempfile.TemporaryFile() as file:
                file.write(build_trie(asked[n > 0].astype(np.uint64), n[n > 0], split, of_words, discount, contexts))
                file.flush()
                del n
                trie = Trie(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
                # Each different trigram is asked for once.
                word = (1 << 20) - 1
                found, weight = trie.log10((asked >> 20) & word, asked >> 40, asked & word, of_words, weights=True)
                return found[which], weight[which]

        def grouped(rows_of):
            """Followers (sorted) and counts by hot word."""
            if not rows_of:
                return {}
            packed = [followers_packed(expand(x)) for x in rows_of]
            b, w, n = (np.concatenate([x[i] for x in packed]) for i in (0, 2, 3))
            order = np.lexsort((w, b))
            b, w, n = b[order], w[order], n[order]
            edges = [0, *(np.flatnonzero(b[1:] != b[:-1]) + 1).tolist(), len(b)]
            return {int(b[x]): (w[x:y], n[x:y]) for x, y in zip(edges, edges[1:])}

        def of_shard(counted, follow, grams):
            if not grams:
                return
            heads = [struct.unpack_from("<QQQ", payload) for payload in grams]
            total, all_texts = sum(h[2] for h in heads), sum(h[1] for h in heads)
            w1, w2, w3 = (np.empty(total, np.int64) for _ in range(3))
            text, units, key_at = (np.empty(total, np.int32) for _ in range(3))
            learned, of_class = np.empty(total, np.bool_), np.empty(total, np.bool_)
            word, n_of = (np.concatenate([x[i] for x in counted]) if counted else np.zeros(0, np.int64) for i in range(2))
            order = np.argsort(word)
            word, n_of = word[order], n_of[order]
            batch_of: list[tuple] = []
            at = done = 0
            while grams:
                batch, place, held, counts, (asked, asked_keys), *columns = grams_of(grams.pop())
                end, last = at + len(columns[0]), done + len(place)
                for column, values in zip((w1, w2, w3, of_class, key_at), columns):
                    column[at:end] = values
                last_words = np.where(columns[3], RARE, columns[2])
                units[at:end] = unit_of(columns[0], columns[1], batch, starts, *of_pairs, last_words, *of_triples)
                # What words never learned count is 0, and is not sent.
                there, places_ = among(asked_keys, word) if len(word) else (np.zeros(0, np.int64),) * 2
                batch_of.append((batch, done, last, place, asked[there], n_of[places_]))
                text[at:end] = np.repeat(np.arange(done, last, dtype=np.int32), counts)
                learned[at:end] = np.repeat(~held, counts)
                at, done = end, last
            del word, n_of
            follow = grouped(follow)
            order = np.argsort(units, kind="stable")
            units = units[order]
            edges = np.append(np.flatnonzero(units[1:] != units[:-1]) + 1, total) if total else []
            del units
            order = order.astype(np.int32)
            scores = np.zeros(all_texts)
            late = [(np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), np.zeros(0, np.float32))]
            begin = 0
            for i, end in enumerate(edges):
                if i + 1 < len(edges) and edges[i + 1] - begin <= unit_grams:
                    continue
                mine = order[begin:end]
                begin = end
                key, in_class, texts_here = w3[mine], of_class[mine], text[mine]
                found, weight = of_unit(w1[mine], w2[mine], key, in_class, learned[mine], follow)
                scores += np.bincount(texts_here, weights=np.where(key >= 0, found, 0.0), minlength=all_texts)
                rare = np.flatnonzero(key < 0)
                found, weight, in_class = 10 ** found[rare], 10 ** weight[rare], in_class[rare]
                late.append((
                    texts_here[rare], key_at[mine[rare]], np.where(in_class, 0.0, found).astype(np.float32),
                    np.where(in_class, found * (all_mass / class_mass), weight).astype(np.float32),
                ))
            of_text, *fields = (np.concatenate(x) for x in zip(*late))
            order = np.argsort(of_text, kind="stable")
            n_late = np.bincount(of_text, minlength=all_texts)
            ends = np.concatenate(([0], np.cumsum(n_late)))
            fields = [x[order] for x in fields]
            for batch, first, last, place, asked, n in batch_of:
                words, a, b = (x[ends[first]:ends[last]] for x in fields)
                payload = squeeze(
                    struct.pack("<QQQ", len(place), len(words), len(asked)) + planes(place) + planes(n_late[first:last]) + planes(words)
                    + planes(asked) + n.astype("<i8").tobytes()
                    + b"".join(planes(x.view(np.uint32)) for x in (scores[first:last].astype(np.float32), a, b))
                )
                yield out_row(batch, GRAMS, payload)

        def out_row(batch, kind, payload):
            columns = [pa.array([batch], pa.int64()), pa.array([kind], pa.int32()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["batch", "kind", "payload"])

        shard, state = None, None
        for batch in batches:
            at = 0
            marks = batch["shard"].to_numpy()
            kinds = batch["kind"].to_numpy()
            edges = np.flatnonzero(np.diff(marks) | np.diff(kinds)) + 1
            for end in [*edges.tolist(), len(marks)] if len(marks) else []:
                if marks[at] != shard:
                    if state:
                        yield from of_shard(*state)
                    shard, state = marks[at], ([], [], [])
                part, kind = batch.slice(at, end - at), kinds[at]
                if kind == HEADS:
                    for data in part["payload"].to_pylist():
                        yield out_row(struct.unpack_from("<q", data)[0], HEADS, data)
                elif kind == COUNTS:
                    state[COUNTS].append([part[c].to_numpy() for c in ("b", "n")])
                else:
                    state[kind].extend(part["payload"].to_pylist())
                at = end
        if state:
            yield from of_shard(*state)

    def merged(batches):
        """The texts of each batch with their sums over all shards."""
        import numpy as np
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress

        def of_batch(head, payloads):
            n_keys = struct.unpack_from("<qq", head)[1]
            rows_ = pa.ipc.open_stream(head[16:]).read_all()
            doc_id, held_out, n_tokens, n_known, base = (rows_[c].combine_chunks() for c in HEAD_NAMES[:-1])
            n_known, base = n_known.to_numpy().copy(), base.to_numpy().copy()
            score, n = np.zeros(len(base)), np.zeros(n_keys, np.int64)
            late = []
            for payload in payloads:
                data = expand(payload)
                texts_here, entries, asked = struct.unpack_from("<QQQ", data)
                at, columns = 24, []
                for size in (texts_here, texts_here, entries, asked):
                    columns.append(from_planes(data, size, at))
                    at += 4 * size
                n[columns[3]] = np.frombuffer(data, "<i8", asked, at)
                at += 8 * asked
                for size in (texts_here, entries, entries):
                    columns.append(from_planes(data, size, at).astype(np.uint32).view(np.float32))
                    at += 4 * size
                place, counts, word, _, sums, a, b = columns
                score[place] += sums
                late.append((np.repeat(place, counts).astype(np.int32), word.astype(np.int32), a, b))
            for text, word, a, b in late:
                times = n[word]
                n_known += np.bincount(text, weights=times > 0, minlength=len(base)).astype(np.int64)
                base += np.bincount(text, weights=np.log10(times + 1) - log_all, minlength=len(base))
                p = a + (b * (times + 1).astype(np.float32)).astype(np.float64) / all_mass
                score += np.bincount(text, weights=np.log10(p), minlength=len(base))
            return pa.RecordBatch.from_arrays([doc_id, held_out, n_tokens, pa.array(n_known), pa.array(base), pa.array(score)], names=HEAD_NAMES)

        batch_now, head, payloads = None, None, []
        for batch in batches:
            for name, kind, payload in zip(*(batch[c].to_pylist() for c in ("batch", "kind", "payload"))):
                if name != batch_now and batch_now is not None:
                    yield of_batch(head, payloads)
                    payloads = []
                batch_now = name
                if kind == HEADS:
                    head = payload
                else:
                    payloads.append(payload)
        if batch_now is not None:
            yield of_batch(head, payloads)

    def replied(batches):
        """For each shard the counts of followers that its units don't know: those that other units have as well."""
        import numpy as np
        import pyarrow as pa
        import zstandard

        starts, of_units, _, (pair_codes, pair_starts), _ = loaded()
        *_, pairs, triples, _ = sent.value
        squeeze, expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        firsts, words = np.array(hot_firsts), np.array(hot_ids)
        first_triple = n_ids + len(pairs)
        of_triples = [
            (s, pairs[p][0], w) for i, (p, w, _) in enumerate(triples)
            for s in sorted(set(of_units[starts[first_triple + i]:starts[first_triple + i + 1]].tolist()))
        ]
        triple_shards, triple_b, triple_w = np.array(of_triples, np.int64).reshape(-1, 3).T
        for batch in batches:
            for payload in batch["payload"].to_pylist():
                unit, a, w, n = followers_packed(expand(payload))
                b = words[np.searchsorted(firsts, unit, side="right") - 1]
                if len(pair_codes):
                    both = np.where(a >= 0, (b << 24) | a, -1)
                    at = np.minimum(np.searchsorted(pair_codes, both), len(pair_codes) - 1)
                    hot_ones = np.flatnonzero(pair_codes[at] == both)
                    at = at[hot_ones]
                    unit[hot_ones] = pair_starts[at] + w[hot_ones] % (pair_starts[at + 1] - pair_starts[at])
                order = np.lexsort((unit, b, w))
                unit, b, w, n = unit[order], b[order], w[order], n[order]
                first = runs(w, b, unit)
                unit, b, w, own = unit[first], b[first], w[first], summed(n, first)
                first = runs(w, b)
                of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(unit))))
                total = summed(own, first)
                needed = total[of] != own
                shard = of_units[unit].astype(np.int64)
                if len(triple_w):
                    # The parts of a trigram split by text have its count from the driver, so its follower's is sent to all.
                    key = {(x, y): i for i, (x, y) in enumerate(zip(b[first].tolist(), w[first].tolist()))}
                    own_triples = [(s, key[x, y]) for s, x, y in zip(triple_shards.tolist(), triple_b.tolist(), triple_w.tolist()) if (x, y) in key]
                    if own_triples:
                        more_shards, more = np.array(own_triples, np.int64).T
                        needed |= np.isin(of, more)
                        shard, of, needed = np.concatenate((shard, more_shards)), np.concatenate((of, more)), np.append(needed, np.ones(len(more), bool))
                shard, of = shard[needed], of[needed]
                asked = np.unique(shard * len(first) + of)
                shard, of = asked // len(first), asked % len(first)
                known_ = np.flatnonzero(total[of] > 0)
                shard, of = shard[known_], of[known_]
                edges = np.searchsorted(shard, np.arange(shards + 1))
                out = [
                    (s, squeeze(pack_followers(b[first[x]], np.full(len(x), -1), w[first[x]], total[x])))
                    for s in np.unique(shard).tolist() for x in (of[edges[s]:edges[s + 1]],)
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s for s, _ in out], pa.int32()), pa.array(np.full(len(out), FOLLOWERS, np.int32)), pa.array([x for _, x in out], pa.binary()),
                     *[pa.nulls(len(out), pa.int64())] * 2], names=["shard", "kind", "payload", "b", "n"],
                )

    # Words without id are counted by the shard of their hash.
    least = known.counts[-1] if known.counts else None
    others = vocabulary.filter((F.length("word") > 64) | (F.col("n") < least)) if least is not None else vocabulary
    code = F.xxhash64("word").bitwiseOR(F.lit(HASHED))
    word_rows = others.groupBy(code.alias("b")).agg(F.sum("n").alias("n")).select(
        (F.col("b").bitwiseAND(F.lit(-1 - HASHED)) % shards).cast("int").alias("shard"), F.lit(COUNTS).alias("kind"),
        F.lit(None).cast("binary").alias("payload"), "b", "n",
    )
    parts = rows.mapInArrow(dealt, PART).unionByName(word_rows)
    if hot:
        parts = parts.unionByName(counted.filter(F.col("kind") == PACKED).select("payload").mapInArrow(replied, PART))
    together = parts.repartition("shard").sortWithinPartitions("shard", "kind")
    sums = together.mapInArrow(scored, SUMS).repartition("batch").sortWithinPartitions("batch")
    return sums.mapInArrow(merged, SCORES).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(known.tokens).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), "score",
    )
