"""CSV with line breaks inside quotes, read by many tasks.

Whether a line break ends a record depends on all quotes before it, so Spark's ``multiLine`` reader gives a whole
file to one task. Here the file is read as lines, split like any text file. A first pass tells of each split whether
it holds an odd number of quotes, and which of its lines would be the last to begin a record if the split began
outside or inside quotes. Running parities over the splits of a file settle which of the two it is. Then each task
puts the records of its split together where they lie; only the pieces of records that run over the end of a split are shuffled,
at most two from a split.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# functions travel to the workers whole, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPLIT = "file string, start bigint"
STATE = f"{SPLIT}, odd int, outer bigint, inner bigint, head bigint"
PIECE = f"{SPLIT}, line bigint, first_start bigint, first_line bigint, value string"


def _runs(batches: Iterable) -> Iterator:
    """(file, start, lines) of each run of lines of one split."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        file, start, value = (batch.column(name) for name in ("file", "start", "value"))
        changed = pc.or_(pc.not_equal(file[1:], file[:-1]), pc.not_equal(start[1:], start[:-1]))
        cuts = np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows]):
            yield file[int(low)].as_py(), start[int(low)].as_py(), value.slice(low, high - low)


def _odd(value) -> np.ndarray:
    """1 for each line that holds an odd number of quotes."""
    import pyarrow.compute as pc

    return pc.count_substring(value, '"').to_numpy() & 1


def _filled(value) -> np.ndarray:
    """Whether a line has content."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.invert(pc.is_in(value, pa.array(["", "\r"], value.type))).to_numpy(zero_copy_only=False)


def _states(batches: Iterable) -> Iterator:
    """One row for each split: the parity of its quotes, the last lines that begin a record if it begins outside, or
    inside, quotes (-1: none), and the first line with content."""
    import pyarrow as pa

    found: dict[tuple, list] = {}
    for file, start, value in _runs(batches):
        # lines so far, parity, last line outside, last line inside, first line with content
        seen = found.setdefault((file, start), [0, 0, -1, -1, None])
        odd, filled = _odd(value), np.flatnonzero(_filled(value))
        after = (seen[1] + np.cumsum(odd)) & 1
        inside = after ^ odd
        for place, state in ((2, 0), (3, 1)):
            such = np.flatnonzero(inside == state)
            if len(such):
                seen[place] = seen[0] + int(such[-1])
        if seen[4] is None and len(filled):
            seen[4] = seen[0] + int(filled[0])
        seen[0], seen[1] = seen[0] + len(value), int(after[-1])
    columns = list(zip(*((file, start, s[1], s[2], s[3], s[4]) for (file, start), s in found.items()))) or [[]] * 6
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "odd", "outer", "inner", "head"])


def _pieces(batches: Iterable, states: dict, heads: dict, closed: bool) -> Iterator:
    """The records of each split, put together: the whole ones, or the pieces of those that another split has a part of.

    ``line`` is the first line of a piece, ``first_start`` and ``first_line`` say where its record begins. ``states`` are
    (within, owner's start and line, ends inside) of each split, ``heads`` the records to leave out.
    """
    split, held, key, out = None, [], None, []

    def give(line: int, first: tuple, whole: bool, lines: list) -> None:
        if whole == closed and heads.get(split[0]) != first:
            out.append((*split, line, *first, "\n".join(lines)))

    def end(whole: bool) -> None:
        """The piece whose lines are held: whole if it begins in this split and is not open at its end."""
        if held:
            line, first = key
            give(line, first, whole and first == (split[1], line), [x for chunk in held for x in chunk])

    for file, start, value in _runs(batches):
        if (file, start) != split:
            if split is not None:
                end(not states[split][3])
            split, held, key = (file, start), [], None
            if split not in states:
                raise RuntimeError("the splits of the file changed while it was read")
            parity, number = states[split][0], 0
        odd = _odd(value)
        after = (parity + np.cumsum(odd)) & 1
        begins = np.flatnonzero((after ^ odd) == 0).tolist()
        lines = value.to_pylist()
        before = begins[0] if begins else len(lines)
        if before:
            if not held:
                # lines that go on with a record of a split before
                key = number, states[split][1:3]
            held.append(lines[:before])
        if begins:
            end(True)
            for low, high in zip(begins[:-1], begins[1:]):
                give(number + low, (start, number + low), True, lines[low:high])
            held, key = [lines[begins[-1]:]], (number + begins[-1], (start, number + begins[-1]))
        parity, number = int(after[-1]), number + len(lines)
        if out:
            yield _batch(out)
            out.clear()
    if split is not None:
        end(not states[split][3])
    if out:
        yield _batch(out)


def _batch(rows: list):
    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
        names=["file", "start", "line", "first_start", "first_line", "value"])


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value"
    )


def split_states(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, within, odd, owner, head): one row per split of the files under ``path``.

    ``within`` is 1 where the split begins inside quotes, ``odd`` where it holds an odd number of them; ``owner`` is the (start, line) of the record that is open
    there, and ``head`` that of the first line with content in the file.
    """
    found = _lines(spark, path).mapInArrow(_states, STATE).withColumn(
        "head", F.when(F.col("head").isNotNull(), F.struct("start", F.col("head").alias("line"))))
    # one row per split of up to 128 MB, so the splits of a file fit in a task
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.when(F.col("within") == 0, F.col("outer")).otherwise(F.col("inner"))
    owner = F.last(
        F.when(begun >= 0, F.struct("start", begun.alias("line"))), ignorenulls=True
    ).over(before)
    return (
        found.withColumn("within", (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int"))
        .withColumns({"owner": owner, "head": F.min("head").over(Window.partitionBy("file"))})
        .select("file", "start", "within", "odd", "owner", "head")
    )


def read_records(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(file, start, line, value): each record of the files under ``path``, with the split and line it begins at.

    With ``header`` the first record with content of each file is left out. A record is what stands between line breaks outside quotes; its own line breaks stay. Fields that hold a quote
    must be quoted and the quote doubled, as CSV writers do. A carriage return before the line break that ends a
    record is dropped. A record whose quotes never close runs to the end of its file; a file of no lines gives none.
    Splits that differ from those of the first pass (as when the cluster changes size between the two and files are
    cut by its size) stop the job rather than lose lines.
    """
    # a row for each split of up to 128 MB
    splits = split_states(spark, path).collect()
    states, heads = {}, {}
    for r in splits:
        owner = r["owner"] or (r["start"], 0)
        states[r["file"], r["start"]] = (r["within"], owner[0], owner[1], bool((r["within"] + r["odd"]) % 2))
        if r["head"] is not None:
            heads[r["file"]] = (r["head"]["start"], r["head"]["line"])
    sent = spark.sparkContext.broadcast((states, heads if header else {}))

    def pieces(closed: bool) -> DataFrame:
        return _lines(spark, path).mapInArrow(lambda batches: _pieces(batches, *sent.value, closed), PIECE)

    whole = pieces(True).select("file", "start", "line", "value")
    # two pieces at most of each split
    several = (
        pieces(False).groupBy("file", F.col("first_start").alias("start"), F.col("first_line").alias("line"))
        .agg(F.array_sort(F.collect_list(F.struct(F.col("start").alias("at"), F.col("line").alias("number"), "value"))).alias("parts"))
        .select("file", "start", "line", F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"))
    )
    return whole.unionByName(several).withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    """Rows of quoted CSV files, equal to those of Spark's ``multiLine`` reader with ``escape='"'``.

    Columns are taken by place. Empty lines between records are skipped, unreadable values become NULL, and short
    records are filled with NULL. With ``header`` the first record with content of each file is left out; files
    without rows give none. Line breaks inside quotes stay as written, also where lines end with a carriage return
    (the ``multiLine`` reader drops it there). The first pass runs when this is called.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    records = read_records(spark, path, header).where(F.col("value") != "")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    parsed = F.from_csv("value", schema.toDDL(), options)
    return records.select(parsed.alias("row")).select("row.*")
