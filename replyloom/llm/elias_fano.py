"""Elias-Fano sequences and the n-gram trie made of them, as bytes that can be mapped from a file."""

from __future__ import annotations

import struct

#: Word ids are below this.
IDS = 1 << 20
#: Steps of a quantised probability to one power of ten; 16 bits reach down to 10 ** -16.
STEPS = 4096


def quantise(log10):
    """Negative powers of ten in 16 bits."""
    import numpy as np

    return np.clip(np.rint(-log10 * STEPS), 0, 65535).astype("<u2")


def in_runs(find, wanted):
    """``find`` of ``wanted``, asked once for neighbours that are equal."""
    import numpy as np

    if not len(wanted):
        return find(wanted)
    new = np.concatenate(([True], wanted[1:] != wanted[:-1]))
    return find(wanted[new])[np.cumsum(new) - 1]


class EliasFano:
    """A monotone sequence of n numbers below u in about n (2 + log2(u / n)) bits.

    The low bits of each number are packed; of the high bits the number of entries in each bucket is stored in
    unary. A successor search goes straight to the bucket of a value and compares low bits there.
    """

    def __init__(self, buffer, at: int = 0):
        import numpy as np

        self.n, self.low_bits, n_low, n_high = struct.unpack_from("<QQQQ", buffer, at)
        at += 32
        self.low = np.frombuffer(buffer, np.uint8, n_low, at)
        high = np.frombuffer(buffer, np.uint8, n_high, at + n_low)
        self.end = at + n_low + n_high
        bits = np.unpackbits(high, bitorder="little")
        #: Entries in the buckets before each; zeros of the unary code end a bucket.
        zeros = np.flatnonzero(bits == 0)
        self.before = np.concatenate(([0], zeros - np.arange(len(zeros))))
        self.before = np.minimum(self.before, self.n)

    @staticmethod
    def encode(values, universe: int) -> bytes:
        import numpy as np

        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        low_bits = max(0, min(40, (max(1, universe) // max(1, n)).bit_length() - 1))
        low = np.zeros(((n * low_bits + 7) // 8) + 8, np.uint8)
        # Each number touches at most seven bytes; no two share a bit.
        if low_bits:
            kept = values & np.uint64((1 << low_bits) - 1)
            places = np.arange(n, dtype=np.uint64) * np.uint64(low_bits)
            spread = kept << (places & np.uint64(7))
            first = (places >> np.uint64(3)).astype(np.int64)
            for i in range((low_bits + 14) // 8):
                part = ((spread >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8)
                np.bitwise_or.at(low, first + i, part)
        high = (values >> np.uint64(low_bits)).astype(np.int64)
        buckets = (int(high[-1]) if n else 0) + 1
        bits = np.zeros(n + buckets, np.uint8)
        bits[high + np.arange(n)] = 1
        unary = np.packbits(bits, bitorder="little")
        return struct.pack("<QQQQ", n, low_bits, low.size, unary.size) + low.tobytes() + unary.tobytes()

    def lows(self, places):
        import numpy as np

        if not self.low_bits:
            return np.zeros(len(places), np.uint64)
        bit = places.astype(np.uint64) * np.uint64(self.low_bits)
        first = (bit >> np.uint64(3)).astype(np.int64)
        out = np.zeros(len(places), np.uint64)
        for i in range((self.low_bits + 14) // 8):
            out |= self.low[first + i].astype(np.uint64) << np.uint64(8 * i)
        return (out >> (bit & np.uint64(7))) & np.uint64((1 << self.low_bits) - 1)

    def values(self):
        """All numbers."""
        import numpy as np

        places = np.arange(self.n)
        high = np.searchsorted(self.before, places, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.lows(places)

    def find(self, wanted):
        """The place of each wanted value, -1 where it does not occur: successor search in its bucket."""
        import numpy as np

        wanted = np.asarray(wanted, dtype=np.uint64)
        found = np.full(len(wanted), -1, np.int64)
        if not self.n:
            return found
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        inside = np.flatnonzero(high < len(self.before) - 1)
        low_end, high_end = self.before[high[inside]], self.before[high[inside] + 1]
        target = wanted[inside] & np.uint64((1 << self.low_bits) - 1)
        # Binary search for the first entry of the bucket that is not below the target.
        while True:
            open_ = np.flatnonzero(low_end < high_end)
            if not len(open_):
                break
            middle = (low_end[open_] + high_end[open_]) >> 1
            value = self.lows(middle)
            goal = target[open_]
            below, equal = value < goal, value == goal
            found[inside[open_[equal]]] = middle[equal]
            low_end[open_[below]] = middle[below] + 1
            high_end[open_[~below]] = middle[~below]
            low_end[open_[equal]] = high_end[open_[equal]]
        return found


def build_trie(grams, counts, hot_bigrams, unigram_log10, discount: float = 0.75, hot_contexts=()) -> bytes:
    """Trie of the trigrams of a shard.

    ``grams`` are sorted different numbers (w2, w1, w3), 20 bits each, ``counts`` how often they occur.
    ``hot_bigrams`` maps a w2 to followers whose counts over all shards are others than those here (sorted, perhaps none), these
    counts, and the sum and number of all its followers; those of other w2 are complete here. ``hot_contexts`` maps a (w2, w1)
    of 40 bits to the sum and number of all its trigrams, of which only some, or none, are here. Probabilities are interpolated by absolute discounting with the next shorter context.

    Below each w2 lie its followers w3 and its contexts w1. A trigram is stored as the place of its w3 among the
    followers of w2, which is a much smaller number than a word id.
    """
    import numpy as np

    ids = np.uint64(IDS - 1)
    w2, w1, w3 = grams >> np.uint64(40), (grams >> np.uint64(20)) & ids, grams & ids
    # Followers of each w2.
    pairs, inverse = np.unique((w2 << np.uint64(20)) | w3, return_inverse=True)
    pair_counts = np.bincount(inverse, weights=counts, minlength=len(pairs)).astype(np.int64)
    if hot_bigrams:
        told = np.concatenate([(np.uint64(w) << np.uint64(20)) | f.astype(np.uint64) for w, (f, *_) in hot_bigrams.items()])
        local = ~np.isin(pairs, told)
        pairs = np.concatenate((pairs[local], told))
        pair_counts = np.concatenate((pair_counts[local], *[c for _, c, *_ in hot_bigrams.values()]))
        order = np.argsort(pairs)
        pairs, pair_counts = pairs[order], pair_counts[order]
    nodes = np.union1d(pairs >> np.uint64(20), np.fromiter(hot_bigrams, np.uint64, len(hot_bigrams)))
    starts = np.searchsorted(pairs, nodes << np.uint64(20))
    sizes = np.diff(np.append(starts, len(pairs)))
    sums = np.concatenate(([0], np.cumsum(pair_counts)))
    totals = sums[starts + sizes] - sums[starts]
    node_of_pair = np.repeat(np.arange(len(nodes)), sizes)
    types = sizes.copy()
    for w, (_, _, total, size) in hot_bigrams.items():
        at = np.searchsorted(nodes, np.uint64(w))
        totals[at], types[at] = total, size
    node_back = discount * types / totals
    followers = pairs & ids
    p2 = (pair_counts - discount) / totals[node_of_pair] + node_back[node_of_pair] * 10 ** unigram_log10[followers]
    del inverse
    # Contexts of each w2.
    contexts = np.union1d(grams >> np.uint64(20), np.fromiter(hot_contexts, np.uint64, len(hot_contexts)))
    ctx_starts = np.searchsorted(grams, contexts << np.uint64(20))
    ctx_sizes = np.diff(np.append(ctx_starts, len(grams)))
    ctx_of_gram = np.repeat(np.arange(len(contexts)), ctx_sizes)
    sums = np.concatenate(([0], np.cumsum(counts)))
    ctx_totals = sums[ctx_starts + ctx_sizes] - sums[ctx_starts]
    for context in hot_contexts:
        at = np.searchsorted(contexts, np.uint64(context))
        ctx_totals[at], ctx_sizes[at] = hot_contexts[context]
    ctx_back = discount * ctx_sizes / ctx_totals
    ctx_node = np.searchsorted(nodes, contexts >> np.uint64(20))
    pair_of_gram = np.searchsorted(pairs, (w2 << np.uint64(20)) | w3)
    p3 = (counts - discount) / ctx_totals[ctx_of_gram] + ctx_back[ctx_of_gram] * p2[pair_of_gram]
    # Each range of relative places follows the one before, which makes the level monotone.
    bases = np.concatenate(([0], np.cumsum(sizes[ctx_node])))
    relative = pair_of_gram - starts[ctx_node[ctx_of_gram]] + bases[ctx_of_gram]
    del w1, w2, w3, pair_of_gram, ctx_of_gram
    node_at = np.arange(len(nodes), dtype=np.uint64)
    levels = [
        EliasFano.encode(nodes, IDS),
        EliasFano.encode(np.append(starts, len(pairs)), len(pairs) + 1),
        EliasFano.encode((node_at[node_of_pair] << np.uint64(20)) | followers, max(1, len(nodes)) * IDS),
        EliasFano.encode((ctx_node.astype(np.uint64) << np.uint64(20)) | (contexts & ids), max(1, len(nodes)) * IDS),
        EliasFano.encode(bases, int(bases[-1]) + 1),
        EliasFano.encode(relative, int(bases[-1]) + 1),
    ]
    numbers = [quantise(np.log10(x)).tobytes() if len(x) else b"" for x in (node_back, p2, ctx_back, p3)]
    head = struct.pack("<QQQQQ", len(levels), *map(len, numbers))
    return head + b"".join(levels) + b"".join(numbers)


class Trie:
    """A trie over mapped bytes."""

    def __init__(self, buffer):
        import numpy as np

        n, *lengths = struct.unpack_from("<QQQQQ", buffer, 0)
        at, self.levels = 40, []
        for _ in range(n):
            self.levels.append(EliasFano(buffer, at))
            at = self.levels[-1].end
        self.numbers = []
        for length in lengths:
            self.numbers.append(np.frombuffer(buffer, "<u2", length // 2, at))
            at += length
        self.starts = self.levels[1].values().astype(np.int64)
        self.bases = self.levels[4].values().astype(np.int64)

    def log10(self, w1, w2, w3, unigram_log10, weights: bool = False):
        """log10 of the probability of each w3 after (w1, w2); with ``weights`` also of the share of w3's unigram in it."""
        import numpy as np

        nodes, _, pairs, contexts, _, grams = self.levels
        node_back, p2, ctx_back, p3 = self.numbers
        out = unigram_log10[w3].astype(np.float64)
        node = in_runs(nodes.find, w2)
        known = np.flatnonzero(node >= 0)
        weight = np.zeros(len(out))
        at = node[known].astype(np.uint64) << np.uint64(20)
        pair = pairs.find(at | w3[known].astype(np.uint64))
        seen = pair >= 0
        out[known[~seen]] -= node_back[node[known[~seen]]] / STEPS
        out[known[seen]] = p2[pair[seen]] / -STEPS
        context = in_runs(contexts.find, at | w1[known].astype(np.uint64))
        inside = context >= 0
        if weights:
            weight[known] -= node_back[node[known]] / STEPS
            weight[known[inside]] -= ctx_back[context[inside]] / STEPS
        # The place of w3 among the followers of w2, searched in the range of (w1, w2).
        both = np.flatnonzero(seen & inside)
        gram = grams.find(pair[both] - self.starts[node[known[both]]] + self.bases[context[both]])
        exact = np.zeros(len(known), bool)
        exact[both[gram >= 0]] = True
        out[known[both[gram >= 0]]] = p3[gram[gram >= 0]] / -STEPS
        back = np.flatnonzero(inside & ~exact)
        out[known[back]] -= ctx_back[context[back]] / STEPS
        return (out, weight) if weights else out
