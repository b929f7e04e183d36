"""Hierarchical packing of documents into sequences of several context sizes.

Every task packs the documents of its input split, block by block, so nothing is shuffled and memory
is bounded by a block. Within a block:

1. *Routing.* Whole windows of the longest tier are cut from a long document; what is left is routed
   to the smallest tier it fits in.
2. *Packing each tier.* What was routed to a tier lies in a window of that tier's size of its own; the
   shortest tier packs several end to end.
3. *Filling.* Gaps of long windows are filled from shorter tiers, the longest pieces that fit first, then
   a piece cut to the size of the gap. When the shortest tier is used up, the next longer one gives
   its documents.
4. *Step groups.* Finished sequences are dealt to groups of equal numbers of tokens, costly ones (by the
   squares of their pieces' lengths) first, each to the group with the fewest tokens and least cost.

All windows are full but one per task at most: the tokens left over at the end, with one long window
held back until then, make sequences of tier sizes and one that lacks less than the smallest.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable

from pyspark.sql import DataFrame

from replyloom.llm.common import sliced, texts
from replyloom.llm.fast_bytes import text_encoder
from replyloom.llm.token_units import read_vocabulary

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, tier long, step_group long"
)
TIERS = (64, 128, 256, 512, 1024)


def fill_windows(items: list[tuple], tiers: tuple[int, ...]) -> tuple[list[list], list[tuple]]:
    """Full windows, and what is left over; an item is (length, row, start), a window a list of items.

    Items are at most as long as the longest tier. What is left over is shorter than that in all.
    """
    longest = tiers[-1]
    by_tier: list[list[tuple]] = [[] for _ in tiers]
    for item in items:
        by_tier[next(i for i, size in enumerate(tiers) if item[0] <= size)].append(item)
    fillers = sorted(by_tier[0])
    open_tiers = [sorted(found) for found in by_tier[1:]]
    sizes, windows = tiers[1:], []
    while any(open_tiers):
        level = max(i for i, found in enumerate(open_tiers) if found)
        item = open_tiers[level].pop()
        window, gap = [item], sizes[level] - item[0]
        while gap:
            if not fillers:
                lower = next((i for i, found in enumerate(open_tiers) if found), None)
                if lower is None:
                    break
                fillers = open_tiers[lower] if lower < level else [open_tiers[lower].pop()]
                if lower < level:
                    open_tiers[lower] = []
            at = bisect_right(fillers, (gap, float("inf"), 0))
            if at:
                piece = fillers.pop(at - 1)
            else:
                length, row, start = fillers.pop(0)
                piece = (gap, row, start)
                insort(fillers, (length - gap, row, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            fillers = sorted(window)
            break
        windows.append(window)
    return windows + (ended := end_to_end(fillers, longest))[0], ended[1]


def end_to_end(items: list[tuple], size: int) -> tuple[list[list], list[tuple]]:
    """Windows of one size from items laid end to end and cut, and the items left over."""
    windows, window, room = [], [], size
    for length, row, start in items:
        while length >= room:
            windows.append([*window, (room, row, start)])
            length, start, window, room = length - room, start + room, [], size
        if length:
            window.append((length, row, start))
            room -= length
    return windows, window


def last_windows(items: list[tuple], tiers: tuple[int, ...]) -> list[list]:
    """Windows of tier sizes, the longest first, and one last that fills none; an item is as above."""
    total, windows = sum(item[0] for item in items), []
    longest, smallest = tiers[-1], tiers[0]
    if total > longest and total % smallest:
        # One long sequence lacks less than the smallest tier; the others are full.
        lack = smallest - total % smallest
        plan = [longest - lack]
    else:
        plan = []
    left = total - sum(plan)
    for size in reversed(tiers):
        while left >= size:
            plan.append(size)
            left -= size
    if left:
        plan.append(left)
    queue = list(items)
    for size in plan:
        window = []
        while size:
            length, row, start = queue.pop(0)
            taken = min(size, length)
            window.append((taken, row, start))
            if length > taken:
                queue.insert(0, (length - taken, row, start + taken))
            size -= taken
        windows.append(window)
    return windows


def step_groups(windows: list[list], group_tokens: int) -> list[int]:
    """A group for each window: equal tokens, and as equal as can be sums of squared lengths."""
    totals = [sum(p[0] for p in w) for w in windows]
    costs = [sum(p[0] ** 2 for p in w) for w in windows]
    groups = max(1, round(sum(totals) / group_tokens))
    load = [(0, 0, g) for g in range(groups)]
    chosen = [0] * len(windows)
    for i in sorted(range(len(windows)), key=lambda i: (-totals[i], -costs[i])):
        tokens, cost, group = heapq.heappop(load)
        chosen[i] = group
        heapq.heappush(load, (tokens + totals[i], cost + costs[i], group))
    return chosen


def pack(
    docs: DataFrame, vocabulary: str, pattern: str, tiers: tuple[int, ...] = TIERS, end_id: int = 0,
    block_tokens: int = 1 << 20, group_tokens: int = 1 << 15, encoder: Callable = text_encoder,
) -> DataFrame:
    """A row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group``.

    ``vocabulary`` is the path of a byte-level vocabulary file, ``pattern`` the pattern it splits by; a
    document is its ids and then ``end_id``, so null and empty texts have one token. ``tiers`` are
    context sizes, powers of two in ascending order. ``tier`` is the size that a sequence is
    padded to. A null ``doc_id`` and repeated rows are packed as they are; an empty table gives no
    row. Sequence ids hold the number of the input split, so a task that runs again gives the same.
    """
    content = read_vocabulary(vocabulary)
    longest = tiers[-1]
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be different powers of two in ascending order")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = encoder(content, pattern)
        first = TaskContext.get().partitionId() << 33
        state = {"sequences": 0, "groups": 0, "held": None}
        documents: dict[int, tuple] = {}
        rows, items, buffered = 0, [], 0

        def written(windows):
            """Rows of finished windows."""
            if not windows:
                return
            out = [[] for _ in range(9)]
            for window, group in zip(windows, step_groups(windows, group_tokens)):
                sequence, offset = first + state["sequences"], 0
                state["sequences"] += 1
                size = sum(p[0] for p in window)
                padded = size if size & (size - 1) == 0 else longest
                for length, row, start in window:
                    doc_id, ids = documents[row]
                    values = (doc_id, start, length, zlib.crc32(ids[start:start + length]), len(ids),
                              sequence, offset, padded, first + state["groups"] + group)
                    for column, value in zip(out, values):
                        column.append(value)
                    offset += length
            state["groups"] += max(1, round(sum(p[0] for w in windows for p in w) / group_tokens))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=[
                f.split()[0] for f in PIECES.split(", ")])

        def settled(last=False):
            """Packs what is buffered; a long window stays back until the end."""
            nonlocal items, documents, buffered
            windows, left = fill_windows(items, tiers)
            if state["held"] is not None:
                windows.append(state["held"])
                state["held"] = None
            at = next((i for i in reversed(range(len(windows))) if sum(p[0] for p in windows[i]) == longest), None)
            held = windows.pop(at) if at is not None else None
            if last:
                if held and sum(p[0] for p in left) % tiers[0]:
                    left, held = held + left, None
                windows += ([held] if held else []) + last_windows(left, tiers)
                held, left = None, []
            yield from written(windows)
            state["held"] = held
            needed = {p[1] for p in (held or []) + left}
            documents = {row: documents[row] for row in needed}
            items, buffered = left, sum(p[0] for p in left)

        for batch in sliced(batches, "text"):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4", copy=False)
                documents[rows] = (doc_id, ids)
                whole = len(ids) // longest * longest
                items += [(longest, rows, start) for start in range(0, whole, longest)]
                if len(ids) > whole:
                    items.append((len(ids) - whole, rows, whole))
                buffered += len(ids)
                rows += 1
                if buffered >= block_tokens:
                    yield from settled()
        if rows:
            yield from settled(last=True)

    return texts(docs).mapInArrow(run, PIECES)
