"""Exact top-k by inner product over integer vectors, block at a time.

Vectors near the same pivot lie side by side and are cut into blocks of consecutive rows. A block has a forward
index (ids and vectors) and the largest and smallest value of each term (component). For a query the sum over the terms
of the larger of ``q * max`` and ``q * min`` bounds every score in the block. Blocks are visited in the order of
their bounds and scored through the forward index until the next bound is below the k-th score so far; a block
whose bound equals it is still scored, as ties go to the smaller id.

Blocks are dealt to lanes; a lane's blocks wait in memory while batches of queries stream past. Each query
starts with the k-th score that its own block already gives. A lane gives at most k rows per query; pairs of
vectors never leave a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage

#: The ends of a long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1
CHUNK = "queries boolean, chunk long, ids binary, vectors binary, highest binary, lowest binary"
FOUND = "query_id long, vector_hash long, vec_id long, score long"


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, vector``: components times ``scale``, rounded down; each different row once.

    Left out are rows with a null id or vector and those with a null or non-finite component.
    """
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = embeddings.select(
        embeddings["vec_id"].cast("long").alias("vec_id"), embeddings["embedding"].cast("array<double>").alias("embedding")
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", usable))
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x * scale).cast("long")).alias("vector")).distinct()


def product(left, right):
    """Inner products of integer rows, exact: in floating point only where that holds every sum."""
    import numpy as np

    largest = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if largest < 2**53:
        return (left.astype(np.float64) @ right.astype(np.float64).T).astype(np.int64)
    if largest < 2**63:
        return left @ right.T
    return left.astype(object) @ right.astype(object).T


def bounds(queries, highest, lowest):
    """The largest score that any vector of each block can have with each query: queries x blocks."""
    import numpy as np

    return product(np.maximum(queries, 0), highest) + product(np.minimum(queries, 0), lowest)


def best(scores, ids, k: int):
    """Places of the k highest scores, ties by smaller id."""
    import numpy as np

    if len(scores) > 4 * k and scores.dtype != object:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= kth)
        return place[np.lexsort((ids[place], -scores[place]))][:k]
    return np.lexsort((ids, -scores))[:k]


def make_chunks(vectors: DataFrame, dims: int, pivots: list[list[int]], is_query: Column, k: int, block_rows: int,
                partitions: int) -> DataFrame:
    """Blocks, and for each the queries it holds with the k-th score that the block itself gives them."""

    def nearest(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(pivots, dtype=np.int64)
        for batch in batches:
            lists = batch["vector"]
            n = batch.num_rows
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False)
            if len(flat) == 0 or (np.diff(offsets) == dims).all():
                dense = flat[offsets[0]:offsets[-1]].reshape(n, -1).astype("<i8")
                dense = dense if dense.shape[1] == dims else np.zeros((n, dims), "<i8")
            else:
                dense = np.zeros((n, dims), "<i8")
                for i in range(n):
                    dense[i, :offsets[i + 1] - offsets[i]] = flat[offsets[i]:offsets[i + 1]]
            pivot = np.argmax(product(dense, table).astype(np.float64), axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch["vec_id"], batch["asks"], pa.array(pivot.astype(np.int32)), pa.array([r.tobytes() for r in dense], pa.binary())],
                names=["vec_id", "asks", "pivot", "vector"],
            )

    def cut(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        state = {"chunk": TaskContext.get().partitionId() << 32}

        def block(ids, vectors, asks):
            highest, lowest = vectors.max(axis=0), vectors.min(axis=0)
            chunk = state["chunk"]
            state["chunk"] += 1
            rows = [(False, chunk, ids.tobytes(), vectors.tobytes(), highest.tobytes(), lowest.tobytes())]
            at = np.flatnonzero(asks)
            if len(at):
                least = []
                for i, scores in zip(at, product(vectors[at], vectors)):
                    scores = scores[ids != ids[i]]
                    least.append(int(np.sort(scores)[-k]) if len(scores) >= k else LEAST - 1)
                known = np.array([x >= LEAST for x in least])
                kth = np.array([min(max(x, LEAST), MOST) for x in least], dtype="<i8")
                rows.append((True, chunk, ids[at].tobytes(), vectors[at].tobytes(), kth.tobytes(), known.tobytes()))
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.bool_()), pa.array(columns[1], pa.int64()), *[pa.array(c, pa.binary()) for c in columns[2:]]],
                names=["queries", "chunk", "ids", "vectors", "highest", "lowest"],
            )

        held = None
        for batch in batches:
            ids, asks = batch["vec_id"].to_numpy(), batch["asks"].to_numpy(zero_copy_only=False)
            vectors = np.frombuffer(b"".join(batch["vector"].to_pylist()), "<i8").reshape(len(ids), dims)
            held = (ids, vectors, asks) if held is None else tuple(map(np.concatenate, zip(held, (ids, vectors, asks))))
            while len(held[0]) >= block_rows:
                yield block(*(x[:block_rows] for x in held))
                held = tuple(x[block_rows:] for x in held)
        if held is not None and len(held[0]):
            yield block(*held)

    rows = vectors.withColumn("asks", is_query).mapInArrow(nearest, "vec_id long, asks boolean, pivot int, vector binary")
    placed = rows.repartitionByRange(partitions, "pivot", "vec_id").sortWithinPartitions("pivot", "vec_id")
    return placed.mapInArrow(cut, CHUNK)


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = 5, scale: int = 256, block_rows: int = 1024, lane_blocks: int = 256,
    pivot_rows: int = 64, query_batch: int = 256,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of all other rows for each row that ``is_query`` marks.

    ``is_query`` is a condition on ``vec_id``. Vectors are integers (see :func:`integer_vectors`); a
    shorter one counts as ending in zeros. Rows with the query's own id are not among its candidates;
    repeated rows count once; vectors that share an id are each asked for and each found. Ranks start at 1;
    ties go to the smaller id. A score beyond a long is given as the end of its range. ``pivot_rows`` vectors, chosen by a hash of the id, say only which vectors
    lie side by side. ``lane_blocks`` bounds what a task holds: 256 blocks of 1,024 rows of 64 components
    are 128 MB.
    """
    spark = embeddings.sparkSession
    vectors = cut_lineage(integer_vectors(embeddings, scale))
    sizes = vectors.agg(F.max(F.size("vector")).alias("dims"), F.count(F.lit(1)).alias("n")).first()
    if not sizes["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = max(1, sizes["dims"])
    chosen = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_rows).collect()
    pivots = [list(r["vector"]) + [0] * (dims - len(r["vector"])) for r in chosen]
    parallel = spark.sparkContext.defaultParallelism
    partitions = max(parallel, -(-sizes["n"] // (block_rows * lane_blocks)))
    chunks = cut_lineage(make_chunks(vectors, dims, pivots, is_query, k, block_rows, partitions))
    blocks = chunks.filter(~F.col("queries")).count()
    lanes = max(1, -(-blocks // lane_blocks), min(blocks, 2 * parallel))
    every = F.sequence(F.lit(0), F.lit(lanes - 1))
    here = F.array(F.pmod(F.xxhash64("chunk"), F.lit(lanes)).cast("int"))
    dealt = chunks.select("*", F.explode(F.when(F.col("queries"), every).otherwise(here)).alias("lane"))
    dealt = dealt.repartition(lanes, "lane").sortWithinPartitions("lane", "queries")

    def visit(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash

        def answer(blocks, waiting):
            if not blocks or not waiting:
                return None
            ids = np.concatenate([w[0] for w in waiting])
            queries = np.concatenate([w[1] for w in waiting])
            kth, known = (np.concatenate([w[i] for w in waiting]) for i in (2, 3))
            bound = bounds(queries, np.stack([b[2] for b in blocks]), np.stack([b[3] for b in blocks]))
            order = np.argsort(-bound, axis=1, kind="stable")
            found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in ids]
            rows = np.arange(len(ids))
            for rank in range(len(blocks)):
                block = order[rows, rank]
                open_ = ~known[rows] | (bound[rows, block] >= kth[rows])
                rows, block = rows[open_], block[open_]
                if not len(rows):
                    break
                for b in np.unique(block):
                    mine = rows[block == b]
                    block_ids, vectors = blocks[b][0], blocks[b][1]
                    for q, scores in zip(mine, product(queries[mine], vectors)):
                        keep = block_ids != ids[q]
                        if known[q]:
                            keep &= scores >= kth[q]
                        all_ids = np.concatenate((found[q][0], block_ids[keep]))
                        all_scores = np.concatenate((found[q][1], scores[keep]))
                        top = best(all_scores, all_ids, k)
                        found[q] = (all_ids[top], all_scores[top])
                        if len(top) == k and all_scores[top[-1]] >= LEAST:
                            now = min(int(all_scores[top[-1]]), MOST)
                            kth[q] = max(int(kth[q]), now) if known[q] else now
                            known[q] = True
            sizes = [len(f[0]) for f in found]
            scores = [min(max(int(s), LEAST), MOST) for f in found for s in f[1]]
            hashes = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in queries], dtype=np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, sizes)), pa.array(np.repeat(hashes, sizes)),
                 pa.array(np.concatenate([f[0] for f in found]).astype(np.int64)), pa.array(scores, pa.int64())],
                names=["query_id", "vector_hash", "vec_id", "score"],
            )

        lane, blocks, waiting, size = None, [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["lane"] != lane:
                    if (out := answer(blocks, waiting)) is not None:
                        yield out
                    lane, blocks, waiting, size = row["lane"], [], [], 0
                ids = np.frombuffer(row["ids"], "<i8")
                vectors = np.frombuffer(row["vectors"], "<i8").reshape(len(ids), dims)
                if not row["queries"]:
                    blocks.append((ids, vectors, np.frombuffer(row["highest"], "<i8"), np.frombuffer(row["lowest"], "<i8")))
                    continue
                waiting.append((ids, vectors, np.frombuffer(row["highest"], "<i8"), np.frombuffer(row["lowest"], np.bool_)))
                size += len(ids)
                if size >= query_batch:
                    if (out := answer(blocks, waiting)) is not None:
                        yield out
                    waiting, size = [], 0
        if (out := answer(blocks, waiting)) is not None:
            yield out

    place = W.partitionBy("query_id", "vector_hash").orderBy(F.desc("score"), "vec_id")
    return (
        dealt.mapInArrow(visit, FOUND)
        .withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
