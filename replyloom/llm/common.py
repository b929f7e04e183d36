"""What several operators share: reading tables, clean inputs, work inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.session import cut_lineage, ensure_checkpoint_dir  # noqa: F401


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null: empty) and the columns named; all others are left out,
    so columns of the input never clash with those an operator makes."""
    return docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
        *[docs[name] for name in more],
    )


def text_key(text: Column | str) -> Column:
    """128-bit digest of a text; with ``doc_id`` it tells rows apart, and repeated rows together."""
    return F.concat(F.xxhash64(text), F.lit(":"), F.xxhash64(text, F.lit(1)))


def fold(key: Column | str, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return (F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % folds)


def worker_cache(name: str) -> dict:
    """A dictionary that stays with the Python worker from task to task."""
    return sys.__dict__.setdefault("_replyloom_worker_cache", {}).setdefault(name, {})


def kept(name: str, key, make: Callable):
    """What ``make`` gives, made once per Python worker; of each name the last key stays."""
    cache = worker_cache(name)
    if key not in cache:
        cache.clear()
        cache[key] = make()
    return cache[key]


def sliced(batches: Iterable, column: str, max_bytes: int = 8 << 20) -> Iterator:
    """Arrow batches cut so that ``column`` holds about ``max_bytes`` in each; a longer value is alone."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch[column]), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_text_struct(
    df: DataFrame, name: str, fields: str, function: Callable[[list[str]], list], max_bytes: int = 8 << 20
) -> DataFrame:
    """All columns of ``df`` and a struct column worked out from ``text`` in Arrow batches.

    ``function`` takes a list of texts (null: empty) and gives an Arrow array or a list for each field;
    ``fields`` is their DDL.
    """
    from pyspark.sql import types as T

    struct = T.StructType.fromDDL(fields)
    schema = T.StructType([*df.schema.fields, T.StructField(name, struct)])
    field_names = struct.names
    place = df.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches, "text", max_bytes):
            values = [t or "" for t in batch.column(place).to_pylist()]
            found = [x if isinstance(x, pa.Array) else pa.array(x) for x in function(values)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.StructArray.from_arrays(found, names=field_names)], names=[*batch.schema.names, name]
            )

    return df.mapInArrow(run, schema)


def row_hashes(df: DataFrame) -> DataFrame:
    """``df`` (``doc_id, text``) with two hashes of both, ``k1`` and ``k2``: equal for repeated rows only."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    return df.withColumns({"k1": F.xxhash64(name, "text"), "k2": F.xxhash64(F.lit(1), "text", name)})


def row_key(doc_id: Column | str = "doc_id", text: Column | str = "text") -> Column:
    """Id and digest of the text as one string: equal for repeated rows only, and never null."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    text = F.col(text) if isinstance(text, str) else text
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), text_key(F.coalesce(text, F.lit(""))))
