"""Unit vectors in cells around centres, and exact top-k that visits only cells that can still win.

Every vector of a corpus belongs to the nearest of some centres, which are vectors of the corpus themselves. Of each
cell its number of rows is known, and the least inner product of a row with the centre. Angles obey the
triangle inequality, so a query at angle a from a centre whose cell reaches out to angle r meets no row there
at less than a - r. And a query's k best centres are rows of the corpus, so the k-th of them is a score that the result reaches
at least. A query is sent to the cells whose bound reaches that score and to no others; every corpus row is
shuffled once, to its cell.

Cells that lie near each other share a part as far as they fit, so a query travels once for each part and not for each
cell; a cell with more rows than fit is cut into parts by a hash of the id. A part that very many queries ask for is
given to several tasks, a copy for each ``PART_QUERIES`` of them. Every copy of a part has a task of its own, and beyond
``OWN_TASKS`` at most four share one, so what a task holds does not grow with the tables.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# functions travel to the workers whole, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of vectors in a part, queries that a task takes for it, and centres, which travel to all tasks.
PART_BYTES = 64 << 20
PART_QUERIES = 32_768
#: A copy is not made for fewer queries than these.
FEW_QUERIES = 4_096
#: So many copies of parts have each a task of their own.
OWN_TASKS = 4_096
MOST_CENTRES = 4_096
#: Rows of a part that a chunk of queries meets at once.
BLOCK_ROWS = 8_192
#: Inner products worked out at once.
CHUNK_CELLS = 4_000_000
#: More than floating point and rounding to 9 digits can take from a bound.
SLACK = 1e-7


def matrix(column) -> np.ndarray:
    """A list column of an Arrow batch as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def plain(column) -> np.ndarray:
    """Ids as an array that compares and sorts."""
    if pa.types.is_integer(column.type):
        return column.to_numpy(zero_copy_only=False)
    return np.asarray(column.to_pylist(), dtype=object)


def named(df: DataFrame, name: str) -> str:
    return f"{name} {df.schema[name].dataType.simpleString()}"


@dataclass
class Cells:
    """Centres of a corpus (id, vector), and of each the rows of its cell, their least product with it, the
    number and the first of its parts, which small cells share; and the number of all parts."""

    ids: np.ndarray
    centres: np.ndarray
    rows: np.ndarray
    least: np.ndarray
    parts: np.ndarray
    first: np.ndarray
    all_parts: int


def in_line(centres: np.ndarray) -> list[int]:
    """Numbers of the centres, each followed by the nearest one that is left."""
    left, at, line = np.ones(len(centres), bool), 0, []
    for _ in range(len(centres)):
        line.append(at)
        left[at] = False
        at = int(np.where(left, centres @ centres[at], -np.inf).argmax())
    return line


def packed(centres: np.ndarray, rows: np.ndarray, part_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Number and first of the parts of each cell, and the number of all: cells in line share a part while they fit."""
    parts, first = -(-rows // part_rows), np.zeros(len(rows), np.int64)
    number, filled = 0, 0
    for cell in in_line(centres):
        if filled and filled + rows[cell] > part_rows:
            number, filled = number + 1, 0
        first[cell] = number
        if rows[cell] > part_rows:
            number += int(parts[cell])
        else:
            filled += rows[cell]
    return parts, first, int(number + (filled > 0))


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centre of each row, and the inner product with it."""
    number, product = np.zeros(len(rows), np.int32), np.zeros(len(rows))
    step = max(1, CHUNK_CELLS // max(1, len(centres)))
    for start in range(0, len(rows), step):
        products = rows[start:start + step] @ centres.T
        number[start:start + step] = products.argmax(axis=1)
        product[start:start + step] = products.max(axis=1)
    return number, product


def assign(corpus: DataFrame, centres: np.ndarray) -> DataFrame:
    """``corpus_id, vector, centre, product`` of each row."""
    sent = corpus.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, product = nearest(matrix(batch["vector"]), sent.value)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(number), pa.array(product)], names=[*batch.schema.names, "centre", "product"]
                )

    return corpus.mapInArrow(run, f"{named(corpus, 'corpus_id')}, {named(corpus, 'vector')}, centre int, product double")


def find_cells(corpus: DataFrame, part_rows: int | None = None) -> Cells | None:
    """Cells of ``corpus`` (corpus_id, vector); None if it is empty.

    About two centres for each part that the corpus would fill, and at most ``MOST_CENTRES``, are taken by a hash of the id.
    """
    seen = corpus.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    if not seen["n"]:
        return None
    part_rows = part_rows or max(64, PART_BYTES // (8 * max(1, seen["d"])))
    wanted = min(MOST_CENTRES, max(2 * -(-seen["n"] // part_rows), int(seen["n"] ** 0.5)))
    chosen = corpus.orderBy(F.xxhash64("corpus_id"), "corpus_id").limit(wanted).toArrow().combine_chunks()
    centres = matrix(chosen["vector"].combine_chunks())
    stats = assign(corpus, centres).groupBy("centre").agg(F.count(F.lit(1)).alias("n"), F.min("product").alias("least")).collect()
    rows, least = np.zeros(len(centres), np.int64), np.full(len(centres), 1.0)
    for r in stats:
        rows[r["centre"]], least[r["centre"]] = r["n"], r["least"]
    return Cells(plain(chosen["corpus_id"].combine_chunks()), centres, rows, least, *packed(centres, rows, part_rows))


def bounds(products: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The largest inner product that a row of each cell can have, from those of the queries with the centres."""
    away = np.arccos(np.clip(products, -1, 1)) - np.arccos(np.clip(least, -1, 1))[None, :]
    return np.cos(np.maximum(0.0, away)) + SLACK


def reached(products: np.ndarray, k: int, own: np.ndarray | None) -> np.ndarray:
    """A score that the k-th best row of each query has at least: that of its k-th best centre, other than itself."""
    if own is not None:
        products = np.where(own, -np.inf, products)
    if products.shape[1] < k:
        return np.full(len(products), -np.inf)
    return np.partition(products, products.shape[1] - k, axis=1)[:, products.shape[1] - k] - SLACK


def route(queries: DataFrame, cells: Cells, k: int, exclude_self: bool) -> DataFrame:
    """``query_id, vector, part``: each query, once for each part it has to visit."""
    sent = queries.sparkSession.sparkContext.broadcast(SimpleNamespace(**vars(cells)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        full = cells.rows > 0
        step = max(1, CHUNK_CELLS // len(cells.centres))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                some = batch.slice(start, step)
                products = matrix(some["vector"]) @ cells.centres.T
                own = plain(some["query_id"])[:, None] == cells.ids[None, :] if exclude_self else None
                row, cell = np.nonzero((bounds(products, cells.least) >= reached(products, k, own)[:, None]) & full)
                # a cell's parts one after the other
                many = cells.parts[cell]
                row = np.repeat(row, many)
                part = np.repeat(cells.first[cell] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
                # cells of one part need it once
                row, part = np.divmod(np.unique(row * cells.all_parts + part), cells.all_parts)
                for a in range(0, len(row), 16_384):
                    taken = pa.array(row[a:a + 16_384])
                    yield pa.RecordBatch.from_arrays(
                        [some["query_id"].take(taken), some["vector"].take(taken), pa.array(part[a:a + 16_384].astype(np.int32))],
                        names=["query_id", "vector", "part"],
                    )

    return queries.mapInArrow(run, f"{named(queries, 'query_id')}, {named(queries, 'vector')}, part int")


def part_of(cells: Cells) -> Column:
    """The part of an assigned row."""
    first = F.array(*[F.lit(int(x)) for x in cells.first])
    many = F.array(*[F.lit(int(x)) for x in np.maximum(1, cells.parts)])
    at = F.col("centre")
    return (F.get(first, at) + F.pmod(F.xxhash64("corpus_id"), F.get(many, at))).cast("int")


def leading(row, column, value, order, k: int):
    """The ``k`` largest values of each row; of equal ones those of the lower id."""
    sort = np.lexsort((order[column], -value, row))
    row, column, value = row[sort], column[sort], value[sort]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept], value[kept]


def best_of(ids, order, base, asked, vectors, k: int, exclude_self: bool):
    """Query row, corpus row and score of the ``k`` best corpus rows of each query; of equal scores the lower id comes first.

    The rows come in blocks; of a block only scores that reach the k-th best so far are looked at.
    """
    bound = np.full(len(vectors), -np.inf)
    row, column, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for start in range(0, len(ids), BLOCK_ROWS):
        scores = vectors @ base[start:start + BLOCK_ROWS].T
        if exclude_self:
            scores[asked[:, None] == ids[None, start:start + BLOCK_ROWS]] = -np.inf
        if start == 0 and scores.shape[1] > k:
            bound = np.round(np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k], 9)
        # rounding may lift a score to the bound
        new, at = np.nonzero(scores >= (bound - 1e-9)[:, None])
        score = scores[new, at]
        real = score > -np.inf
        if real.any():
            row, column, value = leading(
                np.r_[row, new[real]], np.r_[column, at[real] + start], np.r_[value, np.round(score[real], 9)], order, k)
            last = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, row) == k - 1)
            bound[row[last]] = value[last]
    return row, column, value


def keys_of_tasks(spark: SparkSession, tasks: int) -> list[int]:
    """A number for each of ``tasks`` partitions; a repartition by these sends each of them to another partition."""
    found = spark.range(32 * tasks).groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("task")).agg(F.min("id").alias("id")).collect()
    keys = {r["task"]: r["id"] for r in found}
    return [keys.get(task, task) for task in range(tasks)]


def search(sent: DataFrame, rows: DataFrame, copies: list[int], k: int, exclude_self: bool) -> DataFrame:
    """The ``k`` best rows of each (part, copy) for each query sent there: ``query_id, corpus_id, similarity``.

    ``copies`` has the number of copies of each part. They are dealt to the tasks one after the other, as a hash of part
    and copy would give many to some tasks and none to others. The corpus rows of a part come first and are held, its
    queries stream past them.
    """
    places = sum(copies)
    tasks = min(places, max(OWN_TASKS, -(-places // 4)))
    begins = F.array(*[F.lit(int(x)) for x in np.cumsum([0, *copies[:-1]])])
    keys = F.array(*[F.lit(x).cast("bigint") for x in keys_of_tasks(sent.sparkSession, tasks)])
    query_kind, corpus_kind = named(sent, "query_id").split()[1], named(rows, "corpus_id").split()[1]
    vector = F.col("vector").cast("array<double>").alias("vector")
    both = rows.select(
        "part", "copy", F.lit(0).alias("kind"), F.lit(None).cast(query_kind).alias("query_id"), "corpus_id", vector
    ).unionByName(sent.select(
        "part", "copy", F.lit(1).alias("kind"), "query_id", F.lit(None).cast(corpus_kind).alias("corpus_id"), vector
    ))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, base = None, [], None
        for batch in batches:
            key = np.stack([batch[c].to_numpy().astype(np.int64) for c in ("part", "copy", "kind")])
            cuts = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)]) if batch.num_rows else []
            for a, b in zip(cuts, [*cuts[1:], batch.num_rows]):
                piece, place = batch.slice(a, b - a), tuple(key[:2, a])
                if place != at:
                    at, held, base = place, [], None
                if key[2, a] == 0:
                    held.append(piece)
                    continue
                if base is None:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    name = whole["corpus_id"].combine_chunks()
                    ids, base = plain(name), matrix(whole["vector"].combine_chunks())
                    order = np.empty(len(ids), np.int64)
                    order[np.argsort(ids, kind="stable")] = np.arange(len(ids))
                step = max(1, CHUNK_CELLS // min(len(ids), BLOCK_ROWS))
                for start in range(0, piece.num_rows, step):
                    some = piece.slice(start, step)
                    row, column, value = best_of(ids, order, base, plain(some["query_id"]), matrix(some["vector"]), k, exclude_self)
                    yield pa.RecordBatch.from_arrays(
                        [some["query_id"].take(pa.array(row)), name.take(pa.array(column)), pa.array(value)],
                        names=["query_id", "corpus_id", "similarity"],
                    )

    schema = f"query_id {query_kind}, corpus_id {corpus_kind}, similarity double"
    dealt = both.withColumn("slot", F.get(keys, F.pmod(F.get(begins, F.col("part")) + F.col("copy"), F.lit(tasks))))
    ordered = dealt.repartition(tasks, "slot").drop("slot").sortWithinPartitions("part", "copy", "kind")
    return ordered.mapInArrow(run, schema)


def top_in_cells(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool, part_rows: int | None = None,
                 part_queries: int = PART_QUERIES) -> DataFrame:
    """``query_id, corpus_id, similarity``: the ``k`` best rows of each query and some others, at most ``k`` for each part visited."""
    cells = find_cells(corpus, part_rows)
    if cells is None:
        kind = f"{named(queries, 'query_id')}, {named(corpus, 'corpus_id')}, similarity double"
        return queries.sparkSession.createDataFrame([], kind)
    sent = route(queries, cells, k, exclude_self)
    # a row for each part: some thousands, or as many as the corpus has blocks
    load = {r["part"]: r["queries"] for r in sent.groupBy("part").agg(F.count(F.lit(1)).alias("queries")).collect()}
    # few parts are copied so far that all cores have work
    spread = -(-sum(load.values()) // (2 * queries.sparkSession.sparkContext.defaultParallelism))
    taken = min(part_queries, max(FEW_QUERIES, spread))
    hot = {part: -(-n // taken) for part, n in load.items() if n > taken}
    rows = assign(corpus, cells.centres).withColumn("part", part_of(cells))
    if hot:
        copies = F.coalesce(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])[F.col("part")], F.lit(1))
        sent = sent.withColumn("copy", F.pmod(F.xxhash64("query_id"), copies).cast("int"))
        rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    else:
        sent, rows = sent.withColumn("copy", F.lit(0)), rows.withColumn("copy", F.lit(0))
    return search(sent, rows, [hot.get(part, 1) for part in range(cells.all_parts)], k, exclude_self)
