"""Phrase lists of any size, looked for in texts by Aho-Corasick automata.

A :class:`~replyloom.functions.lexicon.Lexicon` puts its phrases into the plan, which suits up to some thousands, and
its work grows with their number. Here the phrases are a table. A table of one shard, which is bounded, travels to the tasks once and becomes an
automaton that finds all its phrases in one pass over a text; texts are not shuffled. A larger table stays where it is and
is joined: each text tells, of the runs of its words as long as the phrases, those parts that can be a phrase, and these are
joined to the table. A phrase begins inside or at the start of a word and ends inside or at the end of one, so such a part
is the end of a word, whole words, and the start of a word; a bitmap of bounded size of the first and last words of all
phrases leaves out most that are none. Work grows with texts and phrases, not with their product.

Results are those of the functions of the same purpose for a ``Lexicon``. A phrase counts once for a text however
often it occurs there, and as often as its class lists it. The empty phrase is in every text; a null text has no
phrase; rows without class or phrase are left out; an empty table finds nothing.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator, Sequence
from uuid import uuid4
from zlib import crc32

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom import fixed_values as fixed
from replyloom.functions.columns import settle
from replyloom.functions.lexicon import contains_any
from replyloom.functions.text import normalize_text
from replyloom.session import cut_lineage

# functions travel to the workers whole, which need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Characters of the phrases of a shard, and what a phrase and a listing of it count for beside them.
SHARD_CHARACTERS = 2_000_000
ROW_CHARACTERS = 16
#: Slots of the bitmap of first and last words, which has a bit for each, and words up to this length whose parts a task keeps.
WORD_SLOTS = 1 << 23
KEPT_WORDS = 100_000
KEPT_CHARACTERS = 64
#: Parts of texts in a batch.
PART_ROWS = 50_000
HITS = T.ArrayType(T.StructType([
    T.StructField("class_ord", T.IntegerType()), T.StructField("class", T.StringType()),
    T.StructField("single", T.IntegerType()), T.StructField("multi", T.IntegerType()),
]))


class PhraseTable:
    """Phrases of classes, from rows (class, class_ord, phrase); a class has the least of its orders.

    The rows are counted and written once, when this is called.
    """

    def __init__(self, rows: DataFrame, shard_characters: int = SHARD_CHARACTERS):
        listed = rows.select(
            F.col("class").cast("string").alias("class"), F.col("class_ord").cast("int").alias("class_ord"),
            F.col("phrase").cast("string").alias("phrase"),
        ).dropna(subset=["class", "phrase"])
        counted = listed.groupBy("phrase", "class").agg(F.count(F.lit(1)).cast("int").alias("times"))
        classes = listed.groupBy("class").agg(F.coalesce(F.min("class_ord"), F.lit(0)).alias("class_ord"))
        # a phrase has at most one entry of each class
        self.phrases = cut_lineage(
            counted.join(classes, "class").groupBy("phrase")
            .agg(F.collect_list(F.struct("class_ord", "class", "times")).alias("entries"))
        )
        size = self.phrases.agg(
            F.sum(F.length("phrase") + ROW_CHARACTERS * (1 + F.size("entries"))).cast("bigint")
        ).first()[0]
        self.shards = -(-(size or 0) // shard_characters)

    def _shard(self) -> list[tuple[str, list[tuple[int, str, int]]]]:
        """Phrases of a table of one shard, which :data:`SHARD_CHARACTERS` bounds."""
        return [(r["phrase"], [tuple(e) for e in r["entries"]]) for r in self.phrases.collect()]

    def with_hits(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Add an array of (class_ord, class, single, multi), in the order of the classes: how many of a class's
        phrases are substrings of the column ``text``, by whether they are one word or more."""
        if self.shards == 0:
            return df.withColumn(out, F.array().cast(HITS))
        if self.shards == 1:
            return _found(df, text, out, df.sparkSession.sparkContext.broadcast(self._shard()))
        return self._joined(df, text, out)

    def _joined(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """As :meth:`with_hits`, by a join of the texts' parts to the phrases."""
        numbered = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
        slots = np.zeros(WORD_SLOTS, bool)
        slots[self.phrases.select("phrase").mapInArrow(_slots, "slot int").distinct().toArrow()["slot"].to_numpy()] = True
        spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" ")))
        # one row per number of words, and per length of the phrases of one word
        kinds = self.phrases.groupBy(
            spaces.alias("spaces"), F.when(spaces == 0, F.length("phrase")).alias("length"),
        ).agg(
            F.max(F.length(F.substring_index("phrase", " ", 1))).alias("first"),
            F.max(F.length(F.substring_index("phrase", " ", -1))).alias("last"),
        ).collect()
        sent = df.sparkSession.sparkContext.broadcast((
            np.packbits(slots).tobytes(), sorted({r["spaces"] for r in kinds} - {0}),
            sorted(r["length"] for r in kinds if r["length"] is not None),
            max((r["first"] for r in kinds if r["spaces"]), default=0), max((r["last"] for r in kinds if r["spaces"]), default=0)))
        parts = numbered.where(F.col(text).isNotNull()).select("_row", F.col(text).alias("text")).mapInArrow(
            lambda batches: _parts(batches, *sent.value), "_row bigint, phrase string")
        multi = F.when(F.contains("phrase", F.lit(" ")), F.col("times")).otherwise(0)
        hits = (
            # Spark takes the parts for as small as the texts and would broadcast them
            parts.join(self.phrases.hint("merge"), "phrase").select("_row", "phrase", F.inline("entries"))
            .groupBy("_row", "class_ord", "class")
            .agg(F.sum(F.col("times") - multi).cast("int").alias("single"), F.sum(multi).cast("int").alias("multi"))
            .groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("class_ord", "class", "single", "multi"))).alias(out))
        )
        joined = numbered.join(hits, "_row", "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(HITS)))
        return cut_lineage(joined.select(*df.columns, F.col(out).cast(HITS).alias(out)))


def _slot(kind: str, part: str) -> int:
    return crc32((kind + part).encode("utf-8", "surrogatepass")) % WORD_SLOTS


def _slots(batches: Iterable) -> Iterator:
    """Slots of the first and last words of phrases, and of those that are one word."""
    import pyarrow as pa

    for batch in batches:
        found = set()
        for phrase in batch.column(0).to_pylist():
            first, space, _ = phrase.partition(" ")
            if space:
                found.add(_slot("<", first))
                found.add(_slot(">", phrase[phrase.rindex(" ") + 1:]))
            else:
                found.add(_slot("=", phrase))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32())], names=["slot"])


def _parts(batches: Iterable, packed: bytes, spaces: Sequence[int], lengths: Sequence[int], first: int, last: int) -> Iterator:
    """(row, part) of texts: the different parts of each that may be a phrase, going by the slots of its first and last word.

    ``spaces`` are the numbers of spaces that phrases have, ``lengths`` those of characters of phrases without a space, ``first``
    and ``last`` the characters of the longest first and last word.
    """
    import pyarrow as pa

    kept: dict[str, tuple[list[str], list[str], set[str]]] = {}

    def listed(kind: str, part: str) -> bool:
        slot = _slot(kind, part)
        return bool(packed[slot >> 3] & (128 >> (slot & 7)))

    def of(word: str) -> tuple[list[str], list[str], set[str]]:
        """Ends that begin a phrase, starts that end one, and phrases inside."""
        found = kept.get(word)
        if found is None:
            size = len(word)
            ends, starts = [], []
            if spaces:
                ends = [word[i:] for i in range(max(0, size - first), size + 1) if listed("<", word[i:])]
                starts = [word[:i] for i in range(min(size, last) + 1) if listed(">", word[:i])]
            inside = {word[i:i + n] for n in lengths if n <= size for i in range(size - n + 1) if listed("=", word[i:i + n])}
            found = ends, starts, inside
            if size <= KEPT_CHARACTERS:
                if len(kept) >= KEPT_WORDS:
                    kept.clear()
                kept[word] = found
        return found

    rows: list[int] = []
    parts: list[str] = []
    for batch in batches:
        for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words = text.split(" ")
            own = [of(word) for word in words]
            found = {part for _, _, inside in own for part in inside}
            for n in spaces:
                for i in range(len(words) - n):
                    ends, starts = own[i][0], own[i + n][1]
                    if ends and starts:
                        middle = " ".join(["", *words[i + 1:i + n], ""])
                        found.update([end + middle + start for end in ends for start in starts])
            rows += [row] * len(found)
            parts += found
            for a in range(0, len(rows) - PART_ROWS + 1, PART_ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[a:a + PART_ROWS], pa.int64()), pa.array(parts[a:a + PART_ROWS])], names=["_row", "phrase"])
            left = len(rows) // PART_ROWS * PART_ROWS
            rows, parts = (rows[left:], parts[left:]) if left else (rows, parts)
    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(parts, pa.string())], names=["_row", "phrase"])


def _automaton(phrases: Sequence[tuple[str, list]]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    always = []
    for place, (phrase, _) in enumerate(phrases):
        if phrase:
            automaton.add_word(phrase, place)
        else:
            always.append(place)
    automaton.make_automaton()
    return automaton, always


def _found(df: DataFrame, text: str, out: str, shard) -> DataFrame:
    """Add the hits of one shard, a broadcast list of (phrase, entries)."""
    place, key = df.columns.index(text), uuid4().hex
    schema = T.StructType([*df.schema.fields, T.StructField(out, HITS)])

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        # the worker keeps the automaton of the last shard from task to task
        cache = sys.__dict__.setdefault("_replyloom_phrase_automaton", {})
        if key not in cache:
            cache.clear()
            cache[key] = _automaton(shard.value)
        automaton, always = cache[key]
        phrases = shard.value
        kind = pa.list_(pa.struct([("class_ord", pa.int32()), ("class", pa.string()), ("single", pa.int32()), ("multi", pa.int32())]))
        for batch in batches:
            rows = []
            for value in batch.column(place).to_pylist():
                tally: dict[tuple[int, str], list[int]] = {}
                if value is not None:
                    seen = {found for _, found in automaton.iter(value)} if len(automaton) else set()
                    for found in (*seen, *always):
                        phrase, entries = phrases[found]
                        for order, name, times in entries:
                            tally.setdefault((order, name), [0, 0])[" " in phrase] += times
                rows.append([
                    {"class_ord": order, "class": name, "single": single, "multi": multi}
                    for (order, name), (single, multi) in sorted(tally.items())
                ])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _ranked(hits: str, multi_word_weight: int) -> Column:
    """(score, tie, class) of each class found; the largest element is the best class."""
    return F.transform(hits, lambda h: F.struct(
        (h["single"] + multi_word_weight * h["multi"]).alias("score"), (-h["class_ord"]).alias("tie"),
        h["class"].alias("class"),
    ))


def _lowered(df: DataFrame, text: str, table: PhraseTable) -> DataFrame:
    return table.with_hits(df.withColumn("_lower", F.lower(F.col(text))), "_lower", "_hits").drop("_lower")


def match_phrases(df: DataFrame, text: str, table: PhraseTable, out: str = "classes",
                  ascii_only: bool = False) -> DataFrame:
    """Add the array of matching classes, in their order; as ``match_lexicon``."""
    clean = df.withColumn("_norm", normalize_text(text, ascii_only))
    hit = table.with_hits(clean, "_norm", "_hits")
    return hit.withColumn(out, F.transform("_hits", lambda h: h["class"])).drop("_norm", "_hits")


def label_by_phrases(df: DataFrame, text: str, table: PhraseTable,
                     other_phrases: Sequence[str] = tuple(fixed.OTHER_PHRASES), out: str = "intent",
                     other: str = fixed.OTHER_CLASS, ascii_only: bool = False) -> DataFrame:
    """Add the only matching class; ``other`` if none matches but an other-phrase does; or NULL; as ``label_weakly``."""
    clean = df.withColumn("_norm", normalize_text(text, ascii_only))
    hit = table.with_hits(clean, "_norm", "_hits")
    label = F.when(F.size("_hits") == 1, F.element_at("_hits", 1)["class"]).when(
        (F.size("_hits") == 0) & contains_any(F.col("_norm"), other_phrases), F.lit(other)
    )
    return hit.withColumn(out, label).drop("_norm", "_hits")


def add_phrase_candidate(df: DataFrame, text: str, table: PhraseTable, out: str = "candidate_intent",
                         score_out: str = "keyword_score", default: str = fixed.OTHER_CLASS) -> DataFrame:
    """Add the class with most phrases present and its score; the default class with 0 if none; as ``add_candidate``."""
    hit = _lowered(df, text, table).withColumn("_best", F.array_max(_ranked("_hits", 1)))
    return settle(hit, {
        out: F.coalesce(F.col("_best")["class"], F.lit(default)),
        score_out: F.coalesce(F.col("_best")["score"], F.lit(0)),
    }).drop("_hits", "_best")


def rank_phrase_candidates(df: DataFrame, text: str, table: PhraseTable, out: str = "candidates",
                           default: str = fixed.OTHER_CLASS) -> DataFrame:
    """Add all classes with a phrase present as (class, score), best first; as ``rank_candidates``."""
    ranked = F.transform(
        F.sort_array(_ranked("_hits", 1), asc=False),
        lambda s: F.struct(s["class"].alias("class"), s["score"].alias("score")),
    )
    fallback = F.array(F.struct(F.lit(default).alias("class"), F.lit(0).alias("score")))
    hit = _lowered(df, text, table)
    return hit.withColumn(out, F.when(F.size("_hits") > 0, ranked).otherwise(fallback)).drop("_hits")


def infer_phrase_class(df: DataFrame, text: str, table: PhraseTable, out: str = "inferred",
                       unknown: str = fixed.UNKNOWN_CLASS, multi_word_weight: int = 2) -> DataFrame:
    """Add the class with the largest weighted score, the first of equals; ``unknown`` if none; as ``infer_class``."""
    best = F.array_max(_ranked("_hits", multi_word_weight))["class"]
    return _lowered(df, text, table).withColumn(out, F.coalesce(best, F.lit(unknown))).drop("_hits")
