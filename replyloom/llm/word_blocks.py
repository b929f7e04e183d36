"""Texts as numbers of their words, and values of words brought back to where the words stand.

Tasks read texts in *blocks* of some megabytes. A block numbers its different words and keeps the numbers of its
words in reading order (*places*). Its different words are dealt, packed, to shards by their hash, so that all blocks
that hold a word meet in one shard. What a shard says of each word (*values*) goes back to the blocks, where the places
turn into values by one indexing. Frequent words cross the network once a block, however often they stand in it.

A shard holds about the same share of all different words, a block is bounded in bytes; no key can be hot.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage, sliced

WORDS, VALUES, PLACES = 0, 1, 2
ROW = "block string, kind int, shard int, payload binary"
ROW_NAMES = ["block", "kind", "shard", "payload"]


def squeeze(*parts) -> bytes:
    """Byte strings or arrays as one compressed byte string."""
    import zstandard

    parts = [bytes(memoryview(p).cast("B")) if not isinstance(p, bytes) else p for p in parts]
    head = struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unsqueeze(data: bytes, parts: int) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    at, out = 8 * parts, []
    for size in struct.unpack_from(f"<{parts}Q", raw):
        out.append(raw[at:at + size])
        at += size
    return out


def planes(numbers) -> bytes:
    """Numbers of 32 bits, all lowest bytes first: high bytes repeat and shrink well."""
    import numpy as np

    return np.ascontiguousarray(np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(data: bytes):
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def join_words(words: list[bytes]) -> tuple:
    """Lengths of some byte strings and all their bytes."""
    import numpy as np

    return np.fromiter(map(len, words), "<u4", len(words)), b"".join(words)


def cut_words(lengths: bytes, joined: bytes) -> list[bytes]:
    import numpy as np

    ends = np.cumsum(np.frombuffer(lengths, "<u4").astype(np.int64)).tolist()
    return [joined[a:b] for a, b in zip([0, *ends], ends)]


def row_batch(rows: list[tuple]):
    """Rows of :data:`ROW` as an Arrow batch."""
    import pyarrow as pa

    columns = list(zip(*rows)) or [[], [], [], []]
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=ROW_NAMES)


class Block:
    """Words of some texts, numbered as they first come; words of different groups are different words."""

    def __init__(self):
        self.numbers: dict[bytes, defaultdict] = {}
        self.slices: list[tuple[bytes, list]] = []
        self.size = 0

    def add(self, size: int, groups: Iterable[tuple[bytes, list]], head: bytes, skip) -> None:
        """Texts of ``size`` bytes as words by group; a word equal to ``skip`` is none."""
        import numpy as np

        self.size += size
        parts = []
        for group, words in groups:
            known = self.numbers.get(group)
            if known is None:
                known = self.numbers[group] = defaultdict()
                known.default_factory = known.__len__
            places = np.fromiter(map(known.__getitem__, words), np.uint32, len(words))
            if skip in known:
                places = places[places != known[skip]]
            parts.append((group, places))
        self.slices.append((head, parts))

    def rows(self, name: str, shards: int) -> Iterator[tuple]:
        """Packed words by shard, then the places of each slice, in which words are numbered by shard.

        The block's name tells its place among all blocks and, by a digest, its words.
        """
        import numpy as np
        import xxhash

        firsts, words = {}, []
        for group, known in self.numbers.items():
            firsts[group] = len(words)
            words += [(w.encode() if isinstance(w, str) else w) + group for w in known]
        of = np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words)) % np.uint32(shards)
        order = np.argsort(of, kind="stable")
        moved = np.empty(len(words), np.uint32)
        moved[order] = np.arange(len(words), dtype=np.uint32)
        counts = np.zeros(len(words), np.int64)
        for _, parts in self.slices:
            for i, (group, places) in enumerate(parts):
                parts[i] = moved[places + np.uint32(firsts[group])]
                counts += np.bincount(parts[i], minlength=len(words))
        name += xxhash.xxh3_128_hexdigest(b"".join(map(memoryview, join_words([words[i] for i in order.tolist()]))))
        present, starts = np.unique(of[order], return_index=True)
        for shard, a, b in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(words)]):
            yield name, WORDS, shard, squeeze(*join_words([words[i] for i in order[a:b].tolist()]), planes(counts[a:b]))
        for i, (head, parts) in enumerate(self.slices):
            places = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            yield name, PLACES, i, squeeze(struct.pack("<Q", len(words)), head, planes(places))


def block_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def word_blocks(docs: DataFrame, read: Callable, shards: int, block_size: int = 32 << 20, skip=None,
                stable: bool = False) -> DataFrame:
    """Blocks of ``docs`` as rows of packed words and places.

    ``read`` takes an Arrow batch and gives its words by group, and bytes that come back with their places.
    The rows are read twice. ``stable`` says that ``docs`` gives the same rows in the same order each time, as files do:
    the blocks are then worked out again rather than written, which a digest in their names guards. Otherwise they are
    written to the checkpoint folder.
    """

    def run(batches):
        from pyspark import TaskContext

        task, index, block = TaskContext.get().partitionId(), 0, Block()
        for batch in sliced(batches, "text"):
            block.add(batch["text"].nbytes, *read(batch), skip)
            if block.size >= block_size:
                for row in block.rows(f"{task}.{index}.", shards):
                    yield row_batch([row])
                index, block = index + 1, Block()
        if block.slices:
            for row in block.rows(f"{task}.{index}.", shards):
                yield row_batch([row])

    rows = docs.mapInArrow(run, ROW)
    return rows if stable else cut_lineage(rows)


def by_shard(blocks: DataFrame, shards: int) -> DataFrame:
    """The packed words, each shard in one task and in one run of rows."""
    return (
        blocks.filter(F.col("kind") == WORDS).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "block")
    )


def with_values(blocks: DataFrame, values: DataFrame, blocks_about: int, assemble: Callable, schema: str) -> DataFrame:
    """What ``assemble`` makes of the places of each slice of a block.

    ``values`` has rows of kind ``VALUES``, one for each row of words, whose payload speaks of the same words in
    the same order. ``assemble`` takes the block's payloads in order of their words and gives a function of (number of words, head, places)
    that yields Arrow batches. ``blocks_about`` blocks are expected; most tasks get one or none.
    """

    def run(batches):
        name, payloads, make = None, [], None
        for batch in batches:
            columns = [batch.column(i) for i in range(3)]
            for i in range(batch.num_rows):
                block, kind = columns[0][i].as_py(), columns[1][i].as_py()
                payload = batch.column(3)[i].as_py()
                if block != name:
                    if payloads:
                        raise RuntimeError(f"the places of block {name} are lost")
                    name, payloads, make = block, [], None
                if kind == VALUES:
                    payloads.append(payload)
                    continue
                if make is None:
                    make = assemble(payloads)
                    payloads = []
                count, head, places = unsqueeze(payload, 3)
                yield from make(struct.unpack("<Q", count)[0], head, unplanes(places))

    # places come first: tasks of a union are numbered on, and blocks are named after their task
    both = blocks.filter(F.col("kind") == PLACES).unionByName(values)
    return both.repartition(max(1, 4 * blocks_about), "block").sortWithinPartitions("block", "kind", "shard").mapInArrow(run, schema)
