"""Phrases whose words occur together, counted by broadcast tries of candidates.

Texts become blocks of word codes (see :mod:`word_blocks`; words that are too rare have none). Then phrases
grow level by level. A phrase can only be frequent if both phrases it becomes without its first or last word are, and if the cells
that a first pass counts hashed phrases in are full enough: those are its candidates. They are laid out as double-array
tries, in shards of bounded size that are broadcast packed, many at a time. Numpy advances the states of all places of a
block at once by one word, and counts the states reached; counts are summed by ranges of states.

A state is the place of a phrase in the tries of its level, so that next to the codes each block keeps one number a word: the state of
the frequent phrase that begins there, or 0. A level writes the blocks anew for each broadcast, and what it replaces is deleted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage, texts
from replyloom.llm.word_blocks import (
    VALUES, block_bytes, by_shard, cut_words, planes, squeeze, unplanes, unsqueeze, with_values, word_blocks,
)
from replyloom.operators.spread import top_per_group
from replyloom.session import drop_checkpoints

#: A-Z in lower case, all that ends a piece as a line feed, a tab as a blank.
FOLDED = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d\t", bytes(range(97, 123)) + b"\n" * 9 + b" "
)
GAP = b"\n"
#: States summed in one task at a time.
RANGE = 1 << 20
#: Hashed cells counted in one task at a time, as a power of two.
MOST_CELLS = 22
#: Candidates in a shard of a trie, which then takes 10 to 30 MB, and 1 to 4 MB packed.
SHARD = 300_000
#: Bytes of packed tries in a broadcast; a level reads the blocks twice for each.
WAVE = 32 << 20
#: Places that a task holds at a time, for which each trie is opened once.
HELD = 1 << 21

CODED = "block string, codes binary, states binary"
COUNTED = "range long, payload binary"


# --- words ---------------------------------------------------------------------------------------------


def read_pieces(batch):
    """Words by language, with a gap between pieces and texts."""
    of: dict[bytes, list] = {}
    for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist()):
        of.setdefault(lang.encode(), []).append(text.encode().translate(FOLDED))
    # a word holds no blank, so a blank ends it
    return [(b" " + lang, b"\n".join(parts).replace(b"\n", b" \n ").split(b" ") + [GAP]) for lang, parts in of.items()], b""


def code_words(shards: int, least: int) -> Callable:
    """Codes of the words of each row, and a row for each frequent word of a shard and for each language.

    The word with rank r in shard s has code r * shards + s + 1; rarer words and gaps have none (0).
    """

    def one_shard(shard: int, rows: list[tuple[str, bytes]]):
        totals: dict[bytes, int] = {}
        for _, payload in rows:
            lengths, joined, counts = unsqueeze(payload, 3)
            for word, n in zip(cut_words(lengths, joined), unplanes(counts).tolist()):
                totals[word] = totals.get(word, 0) + n
        langs: dict[str, int] = {}
        frequent = []
        for word, n in totals.items():
            if word.startswith(GAP):
                continue
            text, lang = word.split(b" ", 1)
            lang = lang.decode()
            langs[lang] = langs.get(lang, 0) + n
            if n >= least:
                frequent.append((-n, word, text, lang))
        frequent.sort()
        codes = {word: r * shards + shard + 1 for r, (_, word, _, _) in enumerate(frequent)}
        yield from ((None, VALUES, shard, None, lang, None, n, None) for lang, n in langs.items())
        yield from ((None, VALUES, shard, None, lang, text.decode(), -n, codes[word]) for n, word, text, lang in frequent)
        for block, payload in rows:
            lengths, joined, _ = unsqueeze(payload, 3)
            found = np.fromiter((codes.get(w, 0) for w in cut_words(lengths, joined)), "<u4")
            yield block, VALUES, shard, squeeze(planes(found)), None, None, None, None

    def run(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
        names = ["block", "kind", "shard", "payload", "lang", "word", "f", "code"]

        def out(shard, rows):
            held, size = [], 0
            for row in one_shard(shard, rows):
                held.append(row)
                size += len(row[3] or b"") + 50
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)

        at, rows = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != at:
                    if rows:
                        yield from out(at, rows)
                    at, rows = row["shard"], []
                rows.append((row["block"], row["payload"]))
        if rows:
            yield from out(at, rows)

    return run


def place_codes(payloads: list[bytes]):
    """Codes of all places of a slice; at first a word's code is its state as well."""
    codes = np.concatenate([np.zeros(0, "<u4"), *[unplanes(unsqueeze(p, 1)[0]) for p in payloads]])

    def of_slice(count, head, places):
        import pyarrow as pa

        if count != len(codes):
            raise RuntimeError("a block has lost words")
        found = codes[places]
        # gaps and rare words in a row say no more than one
        keep = found > 0
        keep[1:] |= found[:-1] > 0
        found = found[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array([""]), pa.array([squeeze(planes(found))], pa.binary()), pa.array([squeeze(found.astype("<i8"))], pa.binary())],
            names=["block", "codes", "states"],
        )

    return of_slice


# --- counting ------------------------------------------------------------------------------------------


def counted_rows(numbers, counts) -> Iterable:
    """Sums of rising numbers as a row of :data:`COUNTED` for each range of numbers."""
    import pyarrow as pa

    if not len(numbers):
        return
    of = numbers >> 20
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    rows = [
        (int(of[a]), squeeze((numbers[a:b] & (RANGE - 1)).astype("<u4"), counts[a:b].astype("<i8")))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(numbers)])
    ]
    yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.binary())],
                                     names=["range", "payload"])


def summed(counted: DataFrame, use: Callable, schema: str) -> DataFrame:
    """What ``use`` makes of the sums of each range: (range, sums of its numbers) to an Arrow batch."""

    def run(batches):
        at, total = None, None
        for batch in batches:
            for number, payload in zip(batch["range"].to_pylist(), batch["payload"].to_pylist()):
                if number != at:
                    if total is not None:
                        yield use(at, total)
                    at, total = number, np.zeros(RANGE, np.int64)
                places, counts = unsqueeze(payload, 2)
                total[np.frombuffer(places, "<u4")] += np.frombuffer(counts, "<i8")
        if total is not None:
            yield use(at, total)

    return counted.repartition("range").sortWithinPartitions("range").mapInArrow(run, schema)


def grown(codes, states, length: int):
    """Places where a phrase of ``length`` words may go on: it is frequent, and so is the one a word later."""
    if len(states) <= length:
        return np.zeros(0, np.int64)
    return np.flatnonzero((states[:-1] > 0) & (states[1:] > 0) & (np.arange(len(states) - 1) + length < len(codes)))


def cells(states, codes, width: int):
    """The cell, of 2**width, that a state and the word after it are counted in."""
    with np.errstate(over="ignore"):
        mixed = states.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + codes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - width)).astype(np.int64)


def open_block(row: dict):
    return unplanes(unsqueeze(row["codes"], 1)[0]), np.frombuffer(unsqueeze(row["states"], 1)[0], "<i8")


def held_blocks(batches) -> Iterable[list]:
    """Rows of blocks, opened, in lists of about :data:`HELD` places: (row, codes, states)."""
    rows, size = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            rows.append((row, *open_block(row)))
            size += len(rows[-1][1])
            if size >= HELD:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def distinct(prefixes, codes):
    """Different pairs in rising order, and how often each comes."""
    if not len(codes):
        return prefixes, codes, np.zeros(0, np.int64)
    bits = int(codes.max()).bit_length()
    if int(prefixes.max()).bit_length() + bits < 64:
        keys, counts = np.unique((prefixes << bits) | codes, return_counts=True)
        return keys >> bits, keys & ((1 << bits) - 1), counts
    order = np.lexsort((codes, prefixes))
    prefixes, codes = prefixes[order], codes[order]
    starts = np.flatnonzero(np.r_[True, (prefixes[1:] != prefixes[:-1]) | (codes[1:] != codes[:-1])])
    return prefixes[starts], codes[starts], np.diff(np.r_[starts, len(codes)])


def pack_pairs(prefixes, codes, *counts) -> bytes:
    """Pairs with rising prefixes, and their counts, as bytes; the prefixes as steps."""
    steps = np.diff(prefixes, prepend=0).astype("<i8")
    return squeeze(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), planes(codes), *[planes(c) for c in counts])


def unpack_pairs(payload: bytes, counts: int = 0) -> list:
    steps, codes, *more = unsqueeze(payload, 2 + counts)
    steps = np.ascontiguousarray(np.frombuffer(steps, np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return [np.cumsum(steps), *[unplanes(x).astype(np.int64) for x in (codes, *more)]]


def candidates(coded: DataFrame, length: int, width: int, least: int) -> DataFrame:
    """``n, payload``: the ``n`` different phrases of ``length + 1`` words that may be frequent, packed by range of cells.

    Different phrases are dealt by ranges of their cells, of which there are 2**width. Where a cell counts ``least`` phrases or more, those in
    it are candidates. A task holds the counts of one range, so there can be as many cells as the places need.
    """
    inside = min(MOST_CELLS, max(0, width - 6))

    def count(batches):
        import pyarrow as pa

        for rows in held_blocks(batches):
            ats = [grown(codes, states, length) for _, codes, states in rows]
            prefixes, found, counts = distinct(
                np.concatenate([states[at] for at, (_, _, states) in zip(ats, rows)]),
                np.concatenate([codes[at + length] for at, (_, codes, _) in zip(ats, rows)]).astype(np.int64),
            )
            if not len(found):
                continue
            of = cells(prefixes, found, width) >> inside
            order = np.argsort(of, kind="stable")
            prefixes, found, counts, of = prefixes[order], found[order], counts[order], of[order]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            ends = [*starts[1:].tolist(), len(of)]
            packed = [pack_pairs(prefixes[a:b], found[a:b], counts[a:b]) for a, b in zip(starts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays([pa.array(of[starts], pa.int64()), pa.array(packed, pa.binary())], names=["range", "payload"])

    def merge(batches):
        import pyarrow as pa

        def full(payloads, total):
            kept = []
            for payload in payloads:
                prefixes, codes, _ = unpack_pairs(payload, 1)
                keep = total[cells(prefixes, codes, width) & ((1 << inside) - 1)] >= least
                kept.append((prefixes[keep], codes[keep]))
            prefixes, codes, _ = distinct(*[np.concatenate(x) for x in zip(*kept)])
            if len(codes):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(codes)], pa.int64()), pa.array([pack_pairs(prefixes, codes)], pa.binary())], names=["n", "payload"]
                )

        at, payloads, total = None, [], None
        for batch in batches:
            for number, payload in zip(batch["range"].to_pylist(), batch["payload"].to_pylist()):
                if number != at:
                    if payloads:
                        yield from full(payloads, total)
                    at, payloads, total = number, [], np.zeros(1 << inside, np.int64)
                prefixes, codes, counts = unpack_pairs(payload, 1)
                np.add.at(total, cells(prefixes, codes, width) & ((1 << inside) - 1), counts)
                payloads.append(payload)
        if payloads:
            yield from full(payloads, total)

    dealt = coded.mapInArrow(count, COUNTED).repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(merge, "n long, payload binary")


# --- the trie --------------------------------------------------------------------------------------------


def digits_of(largest: int) -> int:
    """Digits to base 256 that a code takes; a trie's edges are digits, highest first."""
    return max(1, -(-int(largest).bit_length() // 8))


def place(check, parents, labels, source):
    """Bases of the nodes ``parents`` so that each edge ``parents[i]`` --``labels[i]``--> falls on a slot of its own.

    Edges come sorted by node. Nodes without a place try one at random, all at once, those with many edges first; a
    node keeps its place if all its edges fall on free slots. Slots are added when a round places few.
    Gives the slots of the edges, the different nodes, their bases, and ``check``, which names the node that holds a slot.
    """
    nodes, starts, sizes = np.unique(parents, return_index=True, return_counts=True)
    bases = np.zeros(len(nodes), np.int64)
    waiting = np.argsort(-sizes, kind="stable")
    claimed = np.full(len(check), len(nodes), np.int64)
    while len(waiting):
        room = np.cumsum(sizes[waiting])
        some = waiting[:max(1, int(np.searchsorted(room, len(check) // 8)))]
        tried = source.integers(0, len(check) - 255, len(some))
        lengths = sizes[some]
        edges = np.repeat(starts[some] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        owner = np.repeat(np.arange(len(some)), lengths)
        slots = tried[owner] + labels[edges]
        # of several nodes that want one slot, the first gets it
        np.minimum.at(claimed, slots, owner)
        bad = (check[slots] != -1) | (claimed[slots] != owner)
        claimed[slots] = len(nodes)
        placed = np.ones(len(some), bool)
        placed[owner[bad]] = False
        bases[some[placed]] = tried[placed]
        good = placed[owner]
        check[slots[good]] = parents[edges[good]]
        rest = np.ones(len(nodes), bool)
        rest[some[placed]] = False
        waiting = waiting[rest[waiting]]
        if placed.sum() * 50 < len(some) or not placed.any():
            more = max(1024, len(check) // 4)
            check = np.r_[check, np.full(more, -1, np.int64)]
            claimed = np.r_[claimed, np.full(more, len(nodes), np.int64)]
    return np.repeat(bases, sizes) + labels, nodes, bases, check


def double_array(prefixes, codes, seed: int = 0):
    """Roots, base and check of a trie over different pairs of a prefix and a code, and the slot of each pair.

    Root ``prefixes[i]`` is named -2 - prefix in ``check``, other nodes by their slot, and -1 is a free slot.
    """
    digits = digits_of(codes.max())
    source = np.random.default_rng(seed)
    check = np.full(4 * len(codes) + 1024, -1, np.int64)
    roots = np.full(int(prefixes.max()) + 1, -1, np.int64)
    parents = -2 - prefixes
    inner = []
    for j in range(digits):
        label = (codes >> (8 * (digits - 1 - j))) & 255
        keys, back = np.unique((parents << 8) | label, return_inverse=True)
        slots, nodes, bases, check = place(check, keys >> 8, keys & 255, source)
        if j:
            inner.append((nodes, bases))
        else:
            roots[-2 - nodes] = bases
        parents = slots[back]
    base = np.full(len(check), -1, np.int64)
    for nodes, bases in inner:
        base[nodes] = bases
    return roots.astype("<i4"), base.astype("<i4"), check.astype("<i4"), parents


class Trie:
    """A double array as it travels: three arrays as bytes."""

    def __init__(self, roots: bytes, base: bytes, check: bytes, digits: int):
        self.roots, self.base, self.check = (np.frombuffer(x, "<i4") for x in (roots, base, check))
        self.digits = digits

    def step(self, prefixes, codes):
        """The slots that the codes lead to from the prefixes; -1 where the trie has no such pair."""
        known = (prefixes < len(self.roots)) & (codes < 1 << (8 * self.digits))
        name = np.where(known, -2 - prefixes, -1)
        base = np.where(known, self.roots[np.where(known, prefixes, 0)], -1).astype(np.int64)
        for j in range(self.digits):
            if j:
                base = np.where(base >= 0, self.base[name], -1).astype(np.int64)
            slot = np.where(base >= 0, base + ((codes >> (8 * (self.digits - 1 - j))) & 255), 0)
            reached = (base >= 0) & (self.check[slot] == name)
            name = np.where(reached, slot, 0)
            base = np.where(reached, 0, -1)
        return np.where(base >= 0, name, -1)

    def spell(self, slots):
        """The prefixes and codes that lead to some slots."""
        at, codes = slots.astype(np.int64), np.zeros(len(slots), np.int64)
        for j in range(self.digits):
            parent = self.check[at].astype(np.int64)
            base = np.where(parent <= -2, self.roots[np.where(parent <= -2, -2 - parent, 0)], self.base[np.maximum(parent, 0)])
            codes |= (at - base) << (8 * j)
            at = parent
        return -2 - at, codes


def build_tries(found: DataFrame, shards: int) -> DataFrame:
    """``shard, payload, digits``: a packed double array of the candidates of each shard, built in one task each.

    A shard holds the phrases whose prefix is one more than its number, modulo ``shards``.
    """

    def deal(batches):
        import pyarrow as pa

        for batch in batches:
            for payload in batch["payload"].to_pylist():
                prefixes, codes = unpack_pairs(payload)
                of = (prefixes - 1) % shards
                order = np.argsort(of, kind="stable")
                prefixes, codes, of = prefixes[order], codes[order], of[order]
                starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                packed = [pack_pairs(prefixes[a:b], codes[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)])]
                yield pa.RecordBatch.from_arrays([pa.array(of[starts], pa.int64()), pa.array(packed, pa.binary())], names=["shard", "payload"])

    def build(key, table):
        import pyarrow as pa

        prefixes, codes = np.hstack([unpack_pairs(p) for p in table["payload"].to_pylist()])
        return pa.Table.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([squeeze(*double_array((prefixes - 1) // shards, codes)[:3])], pa.binary()),
             pa.array([digits_of(codes.max())], pa.int32())],
            names=["shard", "payload", "digits"],
        )

    return (
        found.mapInArrow(deal, "shard long, payload binary")
        .groupBy("shard").applyInArrow(build, "shard long, payload binary, digits int")
    )


def open_trie(packed: tuple[bytes, int]) -> Trie:
    payload, digits = packed
    return Trie(*unsqueeze(payload, 3), digits)


class Ahead:
    """The places of a block whose phrase may go on, dealt to the shards of the tries."""

    def __init__(self, codes, states, length: int, shards: int):
        at = grown(codes, states, length)
        prefixes = states[at] - 1
        of = prefixes % shards
        order = np.argsort(of, kind="stable")
        self.at, self.prefixes = at[order], prefixes[order] // shards
        self.codes = codes[self.at + length].astype(np.int64)
        self.starts = np.searchsorted(of[order], np.arange(shards + 1))

    def advance(self, shard: int, trie: Trie):
        """Places whose phrase goes on by an edge of this shard's trie, and the slots the edges lead to."""
        own = slice(self.starts[shard], self.starts[shard + 1])
        slots = trie.step(self.prefixes[own], self.codes[own])
        return self.at[own][slots >= 0], slots[slots >= 0]


def count_shards(coded: DataFrame, length: int, shards: int, sent, least: int) -> DataFrame:
    """``state, prefix, code, f`` of the frequent phrases of the shards whose tries are ``sent``."""

    def count(batches):
        for rows in held_blocks(batches):
            ahead = [Ahead(codes, states, length, shards) for _, codes, states in rows]
            for shard, packed in sent.value.items():
                trie = open_trie(packed)
                counts = np.bincount(np.concatenate([x.advance(shard, trie)[1] for x in ahead]))
                numbers = np.flatnonzero(counts)
                yield from counted_rows((shard << 40) | numbers, counts[numbers])

    def use(number, total):
        import pyarrow as pa

        shard, part = number >> 20, number & ((1 << 20) - 1)
        slots = np.flatnonzero(total >= least)
        at = slots + part * RANGE
        prefixes, found = open_trie(sent.value[shard]).spell(at)
        columns = (at * shards + shard + 1, prefixes * shards + shard + 1, found, total[slots])
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64), pa.int64()) for c in columns], names=["state", "prefix", "code", "f"])

    return summed(coded.mapInArrow(count, COUNTED), use, "state long, prefix long, code long, f long")


def move_on(coded: DataFrame, length: int, shards: int, sent, told, last: bool) -> DataFrame:
    """The blocks with states one word longer for the phrases that ``told`` has bits for, by shard and slot.

    They stand in ``moved`` beside the old states, and after the ``last`` tries of a level in their stead.
    """

    def run(batches):
        import pyarrow as pa

        for rows in held_blocks(batches):
            ahead = [Ahead(codes, states, length, shards) for _, codes, states in rows]
            moved = [
                np.frombuffer(unsqueeze(row["moved"], 1)[0], "<i8").copy() if "moved" in row else np.zeros(len(states), "<i8")
                for row, _, states in rows
            ]
            for shard, bits in told.value.items():
                trie = open_trie(sent.value[shard])
                frequent = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(trie.check)).view(bool)
                for x, to in zip(ahead, moved):
                    at, slots = x.advance(shard, trie)
                    good = frequent[slots]
                    to[at[good]] = slots[good] * shards + shard + 1
            for (row, _, _), to in zip(rows, moved):
                columns = [row["codes"], squeeze(to)] if last else [row["codes"], row["states"], squeeze(to)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), *[pa.array([c], pa.binary()) for c in columns]],
                    names=["block", "codes", "states", "moved"][:1 + len(columns)],
                )

    return coded.mapInArrow(run, CODED if last else CODED + ", moved binary")


def waves(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Shards, given with the bytes of their packed tries, in lists of up to :data:`WAVE` bytes or one."""
    out, size = [], 0
    for shard, n in sorted(sizes):
        if not out or size + n > WAVE:
            out.append([])
            size = 0
        out[-1].append(shard)
        size += n
    return out


def next_level(coded: DataFrame, length: int, places: int, least: int, last: bool, shard_size: int):
    """Frequent phrases of ``length + 1`` words (``state, prefix, code, f``) and the blocks with their states; those given are deleted."""
    context = coded.sparkSession.sparkContext
    width = max(10, int(2 * places).bit_length())
    found = cut_lineage(candidates(coded, length, width, least))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_size))
    tries = cut_lineage(build_tries(found, shards))
    drop_checkpoints(found)
    plan = waves([tuple(r) for r in tries.select("shard", F.octet_length("payload")).collect()])
    phrases = None
    for i, wave in enumerate(plan):
        rows = tries.filter(F.col("shard").between(wave[0], wave[-1])).toArrow().to_pylist()
        sent = context.broadcast({r["shard"]: (r["payload"], r["digits"]) for r in rows})
        del rows
        counted = cut_lineage(count_shards(coded, length, shards, sent, least))
        phrases = counted if phrases is None else phrases.unionByName(counted)
        if not last:
            told = context.broadcast(frequent_bits(counted, shards))
            moved = cut_lineage(move_on(coded, length, shards, sent, told, i + 1 == len(plan)))
            told.destroy()
            drop_checkpoints(coded)
            coded = moved
        sent.destroy()
    drop_checkpoints(tries, *([coded] if last or not plan else []))
    return phrases, coded


def frequent_bits(counted: DataFrame, shards: int) -> dict[int, bytes]:
    """A bit for each slot of a frequent phrase, by shard; shards without any are left out."""
    states = counted.select("state").toArrow()["state"].to_numpy() - 1
    order = np.argsort(states % shards, kind="stable")
    states = states[order]
    of, slots = states % shards, states // shards
    out = {}
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][:len(of)])
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(of)]):
        bits = np.zeros(int(slots[a:b].max()) + 1, bool)
        bits[slots[a:b]] = True
        out[int(of[a])] = np.packbits(bits).tobytes()
    return out


# --- the operator ----------------------------------------------------------------------------------------


def score(a: Column, parts: Column) -> Column:
    """floor(2000000 a / parts), exact beyond 64 bits."""
    wide = F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(19,0)")
    return F.call_function("div", wide, parts.cast("decimal(20,0)"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, first: int = 2000, shard_words: int = 16 << 20,
                 block_size: int = 32 << 20, shard_size: int = SHARD) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the leading collocations of each language (null: ``und``).

    A-Z are put in lower case, texts are split at ``. , ; : ! ?`` and line ends into pieces, and those at blanks and tabs into words. Phrases of 2 to ``longest`` words
    that occur ``least`` times or more within pieces are candidates, ``a`` times. Of the cuts of a candidate in
    two parts that occur ``l`` and ``r`` times, the one with the lowest score floor(2000000 a / (l + r)) counts, of equal
    ones the first. Candidates inside a longer one that occurs at least four fifths as often are dropped. The ``first`` by
    score, count and phrase (UTF-8 bytes) are ranked. ``n`` counts all words of the language.

    Null and empty texts have no word. Repeated rows count each; ids play no part. A very long text is cut into words like any other and
    may fill a block. An empty table, or one without candidates, gives no row. Other columns are left out, whatever their names.

    ``block_size`` bytes of text make a block, ``shard_words`` bytes of all texts a shard of words, and ``shard_size`` candidates
    a trie. A broadcast holds some ten tries, and a level reads all blocks twice for each broadcast. Jobs run while the plan is built.
    """
    spark = docs.sparkSession
    rows = texts(docs, "lang").select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    size = block_bytes(rows)
    shards = max(1, -(-size // shard_words))
    blocks = word_blocks(rows, read_pieces, shards, block_size, skip=b"")
    coded_words = cut_lineage(by_shard(blocks, shards).mapInArrow(
        code_words(shards, least), blocks.schema.simpleString()[7:-1] + ",lang:string,word:string,f:bigint,code:bigint"
    ))
    values = coded_words.filter(F.col("payload").isNotNull()).select(*blocks.columns)
    words = coded_words.filter(F.col("word").isNotNull()).select("lang", "word", "f", "code")
    totals = (
        coded_words.filter(F.col("lang").isNotNull() & F.col("word").isNull())
        .groupBy(F.col("lang").alias("of_lang")).agg(F.sum("f").alias("n"))
    )
    coded = cut_lineage(with_values(blocks, values, -(-size // block_size), place_codes, CODED))
    drop_checkpoints(blocks)
    del blocks, values

    # phrases as lists of codes, with their counts
    counts = words.select(F.array("code").alias("codes"), "f")
    before = words.select(F.col("code").alias("state"), F.array("code").alias("codes"))
    places = words.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    for length in range(1, longest):
        phrases, coded = next_level(coded, length, places, least, length + 1 == longest, shard_size)
        if phrases is None:
            break
        known = before.select(F.col("state").alias("prefix"), F.col("codes").alias("first"))
        phrases = cut_lineage(
            phrases.join(known, "prefix").select("state", F.array_append("first", F.col("code")).alias("codes"), "f")
        )
        counts = counts.unionByName(phrases.select("codes", "f"))
        before = phrases
        places = phrases.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        if not places:
            break
    return rank_phrases(cut_lineage(counts), words, totals, first)


def rank_phrases(counts: DataFrame, words: DataFrame, totals: DataFrame, first: int) -> DataFrame:
    """Score, select and rank phrases given as lists of codes."""
    found = counts.filter(F.size("codes") > 1).select("codes", F.col("f").alias("a"))
    cuts = found.select(
        "codes", "a", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("k")
    ).select(
        "codes", "a", "k", F.slice("codes", F.lit(1), F.col("k")).alias("head"),
        F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")).alias("tail"),
    )
    heads = counts.select(F.col("codes").alias("head"), F.col("f").alias("l"))
    tails = counts.select(F.col("codes").alias("tail"), F.col("f").alias("r"))
    scored = (
        cuts.join(heads, "head").join(tails, "tail")
        .withColumn("score", score(F.col("a"), F.col("l").cast("decimal(19,0)") + F.col("r").cast("decimal(19,0)")))
        .groupBy("codes").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    )
    # every phrase inside a longer one, with the most frequent of those
    starts = F.sequence(F.lit(1), F.size("codes") - F.col("size") + 1)
    inside = (
        found.filter(F.size("codes") > 2)
        .withColumn("size", F.explode(F.sequence(F.lit(2), F.size("codes") - 1)))
        .withColumn("start", F.explode(starts))
        .select(F.slice("codes", F.col("start"), F.col("size")).alias("inner"), F.col("a").alias("longer"))
        .groupBy("inner").agg(F.max("longer").alias("longer"))
    )
    kept = (
        scored.join(inside, F.col("codes") == F.col("inner"), "left")
        .filter(F.col("longer").isNull() | (F.col("longer") * 5 < F.col("cut.a") * 4))
        .select("codes", "cut.*")
    )
    spelled = (
        kept.select("codes", "a", "l", "r", "score", F.posexplode("codes").alias("place", "code"))
        .join(words.select("code", "word", "lang"), "code")
        .groupBy("codes", "a", "l", "r", "score", "lang")
        .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    top = top_per_group(spelled, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], first, ["phrase"], "rank")
    return top.join(totals, F.col("lang") == F.col("of_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
