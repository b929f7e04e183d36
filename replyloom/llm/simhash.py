"""Near duplicates by SimHash: fingerprints of word shingles, linked within a Hamming distance by BK-trees.

Different fingerprints only are compared; copies collapse before. Fingerprints within distance r agree in one of
r + 1 bands of their bits, and within what that band leaves again in one of r + 1 bands. Each pair of bands and
their values is a shard; every link lies in a shard, so no cap is needed. The shards are the trees: in a
tree, a node's children are keyed by their integer distance to it, and a search goes down only those edges
whose key is within the radius of the distance just found.

A shard of more than ``tree_size`` fingerprints is dealt into parts. Each part's tree is sent to the tasks of
all parts (a row per fingerprint and pair of parts), so that no task holds a whole hot shard. From each tree
a task gives at most one link per searching fingerprint and component of the tree, never all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage, free_name, row_key, texts, with_text_struct
from replyloom.llm.components import connected_components



def fingerprints_of(values: list[str], shingle: int) -> list[int]:
    """Signed 64-bit SimHash of each text."""

    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    out = []
    for text in values:
        # bytes.split() parts at exactly the characters that are not word characters here.
        words = text.encode().translate(lower).split()
        if not words:
            out.append(0)
            continue
        if len(words) <= shingle:
            hashes = [digest(b" ".join(words), 42)]
        else:
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = np.concatenate(([0], ends[:-shingle]))
            hashes = [digest(whole[a:b], 42) for a, b in zip(starts.tolist(), (ends[shingle - 1:] - 1).tolist())]
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            chunk = np.array(hashes[at:at + (1 << 16)], dtype="<u8")
            ones += np.unpackbits(chunk.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(ones * 2 > len(hashes), bitorder="little")
        out.append(int(bits.view("<i8")[0]))
    return out


def with_fingerprint(docs: DataFrame, shingle: int, name: str) -> DataFrame:
    """All columns and a struct ``name`` with the signed 64-bit fingerprint ``value``."""

    def run(values):
        import pyarrow as pa

        return [pa.array(fingerprints_of(values, shingle), pa.int64())]

    return with_text_struct(docs, name, "value long", run)


def bands(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` dealt into ``n`` bands in order, as equal as can be."""
    size, more = divmod(len(bits), n)
    out, at = [], 0
    for i in range(n):
        end = at + size + (i < more)
        out.append(bits[at:end])
        at = end
    return out


def shard_keys(value: Column, radius: int) -> Column:
    """Array of the shards that a fingerprint belongs to: (r + 1) squared longs.

    The bits of two bands and the numbers of the bands. Bands are runs of bits, so a key is made by masks; the
    two run numbers go to a second field, as the masks of different bands overlap.
    """
    keys = []
    for i, outer in enumerate(bands(list(range(64)), radius + 1)):
        left = [b for b in range(64) if b not in outer]
        for j, inner in enumerate(bands(left, radius + 1)):
            mask = sum(1 << b for b in outer + inner)
            signed = mask - (1 << 64) if mask >= 1 << 63 else mask
            keys.append(F.struct(F.lit(i * (radius + 1) + j).cast("short").alias("band"), value.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def forest_links(group, values, sides, radius: int):
    """Links found by BK-trees, as two arrays.

    ``group`` numbers the tree that an entry belongs to, ``sides`` is 0 for fingerprints that make up the
    tree, 1 for those that search in it only. All trees are built and searched level by level at once.
    """
    import numpy as np

    n = len(values)
    values = values.view(np.uint64)
    first_nodes = None
    # Building: an entry that is the first of its (parent, distance) becomes that child, the others go down to it.
    waiting = np.flatnonzero(sides == 0)
    key = group[waiting].astype(np.int64)
    parent_of = np.full(n, -1, np.int64)
    edge_of = np.full(n, -1, np.int64)
    while len(waiting):
        order = np.argsort(key, kind="stable")
        waiting, key = waiting[order], key[order]
        head = np.r_[True, key[1:] != key[:-1]]
        nodes = waiting[head]
        if first_nodes is None:
            first_nodes = nodes
        else:
            parent_of[nodes], edge_of[nodes] = key[head] // 65, key[head] % 65
        node_at = nodes[np.cumsum(head) - 1]
        rest = ~head
        below, at = waiting[rest], node_at[rest]
        distance = np.bitwise_count(values[below] ^ values[at]).astype(np.int64)
        waiting, key = below, at * 65 + distance
    # Children of each node, in order of their edge.
    children = np.flatnonzero(parent_of >= 0)
    child_key = parent_of[children] * 65 + edge_of[children]
    order = np.argsort(child_key)
    children, child_key = children[order], child_key[order]
    roots = np.full(int(group.max()) + 1, -1, np.int64)
    if first_nodes is not None:
        roots[group[first_nodes]] = first_nodes
    # Searching: pairs of a searching entry and a node.
    who = np.arange(n)
    at = roots[group]
    who, at = who[at >= 0], at[at >= 0]
    left, right = [who[:0]], [at[:0]]
    while len(who):
        distance = np.bitwise_count(values[who] ^ values[at]).astype(np.int64)
        hit = (distance <= radius) & (who != at)
        left.append(who[hit])
        right.append(at[hit])
        low = np.searchsorted(child_key, at * 65 + np.maximum(0, distance - radius))
        high = np.searchsorted(child_key, at * 65 + np.minimum(64, distance + radius), side="right")
        count = high - low
        more = count > 0
        who, low, count = who[more], low[more], count[more]
        total = int(count.sum())
        offset = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        at = children[np.repeat(low, count) + offset]
        who = np.repeat(who, count)
    return np.concatenate(left), np.concatenate(right)


def spanning(left, right, n: int):
    """Indices of links that join what earlier ones have not: a spanning forest."""
    parent = list(range(n))
    keep = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        while parent[b] != b:
            parent[b] = parent[parent[b]]
            b = parent[b]
        if a != b:
            parent[max(a, b)] = min(a, b)
            keep.append(i)
    return keep


def fingerprint_links(values: DataFrame, radius: int = 4, tree_size: int = 2048) -> DataFrame:
    """``a, b``: links between the different fingerprints ``value``, enough to join what is linked.

    Two values have a chain of links between them if and only if they have a chain of pairs within ``radius``.
    """
    keyed = values.select("value", F.explode(shard_keys(F.col("value"), radius)).alias("shard")).select("value", "shard.*")
    sizes = keyed.groupBy("band", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = cut_lineage(sizes.select(F.col("band").alias("size_band"), F.col("bits").alias("size_bits"), "n"))
    met = keyed.join(sizes, (F.col("band") == F.col("size_band")) & (F.col("bits") == F.col("size_bits")))
    parts = F.ceil(F.col("n") / tree_size).cast("int")
    dealt = met.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("value"), F.col("parts")).cast("int"))
    # Part p searches the trees of parts 0 to p; the tree of part t goes to the tasks of parts t and above.
    searching = F.transform(F.sequence(F.lit(0), F.col("part")), lambda t: F.struct(t.alias("tree"), F.col("part").alias("probe"), F.when(t == F.col("part"), 0).otherwise(1).alias("side")))
    serving = F.transform(
        F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: p > F.col("part")),
        lambda p: F.struct(F.col("part").alias("tree"), p.alias("probe"), F.lit(0).alias("side")),
    )
    rows = dealt.select("value", "band", "bits", F.explode(F.concat(searching, serving)).alias("task")).select(
        "value", F.xxhash64("band", "bits", "task.tree", "task.probe").alias("tree_id"), F.col("task.side").alias("side")
    )
    rows = rows.repartition("tree_id").sortWithinPartitions("tree_id")

    def link(batches):
        import numpy as np
        import pyarrow as pa

        def found(ids, values, sides):
            _, group = np.unique(ids, return_inverse=True)
            left, right = forest_links(group, values, sides, radius)
            keep = spanning(left, right, len(values))
            pairs = np.unique(np.sort(np.stack([values[left[keep]], values[right[keep]]], 1), axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])

        held: list = []
        size = 0
        for batch in batches:
            ids, values, sides = (batch[c].to_numpy() for c in ("tree_id", "value", "side"))
            if not len(ids):
                continue
            held.append((ids, values, sides))
            size += len(ids)
            if size >= 1 << 16:
                ids, values, sides = map(np.concatenate, zip(*held))
                # The last tree may go on in the next batch.
                done = int(np.searchsorted(ids, ids[-1]))
                if done:
                    yield found(ids[:done], values[:done], sides[:done])
                held, size = [(ids[done:], values[done:], sides[done:])], len(ids) - done
        if held:
            yield found(*map(np.concatenate, zip(*held)))

    return rows.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, tree_size: int = 2048) -> DataFrame:
    """``doc_id, fingerprint, component_id``: a row for each row of ``docs``.

    ``fingerprint`` is 16 lowercase hex digits, ``component_id`` the smallest ``doc_id`` reached over links of at
    most ``radius`` differing bits, itself included. Texts of fewer words than ``shingle`` have their whole
    sequence as one shingle; texts without word, null ones included, have fingerprint zero and are linked like
    others. Rows with a null ``doc_id`` take part in links; a component of such rows alone has a null id.
    """
    prints = cut_lineage(with_fingerprint(texts(docs), shingle, "found").select("doc_id", F.col("found.value").alias("value")))
    labelled = with_component(prints, radius, tree_size)
    least = labelled.groupBy(F.col("component").alias("of")).agg(F.min("doc_id").alias("component_id"))
    named = cut_lineage(least)
    return labelled.join(named, F.col("component") == F.col("of")).select(
        "doc_id", F.lpad(F.lower(F.hex("value")), 16, "0").alias("fingerprint"), "component_id"
    )


def with_component(prints: DataFrame, radius: int, tree_size: int = 2048) -> DataFrame:
    """``prints``, a written table with a fingerprint ``value``, and the smallest fingerprint (as a signed number)
    that each reaches, ``component``."""
    links = fingerprint_links(prints.select("value").distinct(), radius, tree_size)
    members = connected_components(links)
    return cut_lineage(
        prints.join(members, F.col("value") == F.col("node"), "left")
        .withColumn("component", F.coalesce("component", "value")).drop("node")
    )


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4, tree_size: int = 2048) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest ``doc_id`` (null ids last), then text digest.

    Of repeated rows one stays as well. All columns stay as they are.
    """
    name, mark = free_name(docs, "row_key"), free_name(docs, "kept_key")
    keyed = texts(docs).withColumn("key", row_key())
    prints = cut_lineage(with_fingerprint(keyed, shingle, "found").select("doc_id", "key", F.col("found.value").alias("value")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id"), F.col("key")))
    chosen = with_component(prints, radius, tree_size).groupBy("component").agg(first.alias("first")).select(
        F.col("first.key").alias(mark)
    )
    keyed = docs.withColumn(name, row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    return keyed.join(chosen, F.col(name) == F.col(mark), "left_semi").dropDuplicates([name]).drop(name)
