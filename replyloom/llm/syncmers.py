"""Document fingerprints of closed syncmers, by DataFrame functions alone.

A k-mer is k consecutive words, its inner s-mers are s consecutive words. A k-mer is a closed syncmer if its
smallest s-mer (by hash) is its first or its last. That depends on the k-mer alone, not on what stands
around it, so a passage has the same anchors in any document and at any place, and about 2 of k - s + 1
positions are anchors. The fingerprint is all anchors of a text in order, with their positions. Two texts share a place
where two anchors in a row are in both, equally far apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from replyloom.llm.common import free_name, texts

#: Scripts written without blanks: each character is a word.
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"


def words_of(text: Column) -> Column:
    spaced = F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text)
    return F.array_remove(F.split(spaced, r"\s+"), "")


def shifted(array: Column, by: int) -> Column:
    """Without the first ``by`` elements."""
    return F.slice(array, by + 1, F.size(array))


def shortened(array: Column, by: int) -> Column:
    """Without the last ``by`` elements."""
    return F.slice(array, 1, F.greatest(F.size(array) - by, F.lit(0)))


def with_anchors(df: DataFrame, text: str, name: str, k: int = 6, s: int = 2, positions: bool = False) -> DataFrame:
    """All columns and an array of the hashes of the closed syncmers of ``text``, in order.

    With ``positions``, an array of structs of ``position`` (in words, from 0) and ``hash``. A text with words
    but without closed syncmer, as one of fewer than ``k`` words may be, has the hash of all its words as
    its one anchor, at 0. Null and empty texts have none.
    """
    if not 1 <= s < k:
        raise ValueError("s must be at least 1 and less than k")
    words, hashes, inner, least = (free_name(df, f"{name}_{x}") for x in ("words", "hashes", "inner", "least"))
    df = df.withColumn(words, words_of(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    smers = F.col(hashes)
    for i in range(1, s):
        smers = F.zip_with(shortened(smers, 1), shifted(F.col(hashes), i), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn(inner, smers)
    # Smallest of each window of k - s + 1 inner hashes: from windows half as long, then one at its end.
    width, window = 1, k - s + 1
    df = df.withColumn(least, F.col(inner))
    while width < window:
        step = min(width, window - width)
        df = df.withColumn(least, F.zip_with(shortened(F.col(least), step), shifted(F.col(least), step), lambda a, b: F.least(a, b)))
        width += step
    covers = sorted({*range(0, k - s, s), k - s})

    def anchor(smallest, i):
        value = F.xxhash64(*[F.get(F.col(inner), i + c) for c in covers])
        chosen = (smallest == F.get(F.col(inner), i)) | (smallest == F.get(F.col(inner), i + (k - s)))
        return F.when(chosen, F.struct(i.cast("int").alias("position"), value.alias("hash")) if positions else value)

    found = free_name(df, f"{name}_found")
    df = df.withColumn(found, F.array_compact(F.transform(least, anchor)))
    whole = F.xxhash64(F.array_join(words, " "))
    only = F.struct(F.lit(0).alias("position"), whole.alias("hash")) if positions else whole
    value = F.when((F.size(found) == 0) & (F.size(words) > 0), F.array(only)).otherwise(F.col(found))
    return df.withColumn(name, value).drop(words, hashes, inner, least, found)


def with_places(df: DataFrame, text: str, positions: str, hashes: str, k: int = 6, s: int = 2) -> DataFrame:
    """All columns, and the positions and the hashes of all anchors of ``text`` as two arrays, in order."""
    anchors = free_name(df, f"{hashes}_anchors")
    df = with_anchors(df, text, anchors, k, s, positions=True)
    return df.withColumns({
        positions: F.transform(anchors, lambda x: x["position"]), hashes: F.transform(anchors, lambda x: x["hash"]),
    }).drop(anchors)


def fingerprint_text(positions: Column, hashes: Column) -> Column:
    """For each anchor eight lowercase hex digits of its position and 16 of its hash."""
    return F.lower(F.array_join(F.zip_with(
        positions, hashes, lambda p, h: F.concat(F.lpad(F.hex(p), 8, "0"), F.lpad(F.hex(h), 16, "0"))
    ), ""))


def links(positions: Column, hashes: Column) -> Column:
    """A hash of each two anchors in a row and the words between their beginnings."""
    gaps = F.zip_with(shortened(positions, 1), shifted(positions, 1), lambda a, b: b - a)
    return F.zip_with(F.zip_with(shortened(hashes, 1), gaps, lambda h, g: F.xxhash64(h, g)), shifted(hashes, 1), lambda a, b: F.xxhash64(a, b))


def likeness(positions_a: Column, a: Column, positions_b: Column, b: Column) -> Column:
    """The share of places of either text that are in both, wherever and however often; 1 for two texts without anchors.

    A place is two anchors in a row at their distance. Where a text has a single anchor, anchors alone are compared.
    """
    single = (F.size(a) == 1) | (F.size(b) == 1)
    x = F.when(single, a).otherwise(links(positions_a, a))
    y = F.when(single, b).otherwise(links(positions_b, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    ).cast("double")


def position_matches(a: Column, b: Column) -> Column:
    """Anchors with positions that two texts share: ``position_a, position_b, hash`` for each anchor of ``a``
    and each place of its hash in ``b``."""
    shared = F.array_intersect(F.transform(a, lambda x: x["hash"]), F.transform(b, lambda x: x["hash"]))
    common = lambda anchors: F.filter(anchors, lambda x: F.array_contains(shared, x["hash"]))
    return F.flatten(F.transform(common(a), lambda x: F.transform(
        F.filter(common(b), lambda y: y["hash"] == x["hash"]),
        lambda y: F.struct(x["position"].alias("position_a"), y["position"].alias("position_b"), x["hash"].alias("hash")),
    )))


def with_range(docs: DataFrame, name: str, ranges: int) -> tuple[DataFrame, list, bool]:
    """``docs`` with the number of the range its ``doc_id`` lies in; the first id of each range; whether ids are null.

    Ranges hold about equally many rows and begin with an id that occurs. Null ids belong to the first.
    """
    shares = [i / ranges for i in range(1, ranges)]
    found = docs.agg(
        F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares or [0.5], max(10_000, 20 * ranges)).alias("cuts"),
        (F.count(F.lit(1)) > F.count("doc_id")).alias("nulls"),
    ).first()
    firsts = sorted({found["least"], *(found["cuts"] if shares else [])}) if found["least"] is not None else []
    # Halving steps: the last first id that is not above the id.
    steps = [1 << i for i in reversed(range(max(1, len(firsts)).bit_length()))]
    listed = F.array(*[F.lit(x).cast("long") for x in firsts or [0]])
    place = F.aggregate(
        F.array(*[F.lit(x) for x in steps]), F.lit(0),
        lambda at, step: F.when(F.get(listed, at + step) <= F.col("doc_id"), at + step).otherwise(at),
    )
    return docs.withColumn(name, place), firsts, bool(found["nulls"])


def with_next(docs: DataFrame, ranges: int, prepare=lambda df: df, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """``docs`` (``doc_id, text``) with ``next_<column>`` of the next row by ``doc_id``, then text; after the last the first.

    Rows are shuffled once, by ranges of ids. The first rows of a range also go to the end of the range
    before, so the last row of each range finds its next one there. ``prepare`` adds columns after the shuffle.
    """
    placed, firsts, nulls = with_range(docs, "range", ranges)
    last = max(0, len(firsts) - 1)
    first_of_all = F.col("doc_id").isNull() if nulls else F.coalesce(F.col("doc_id") == F.lit(firsts[0] if firsts else None), F.lit(False))
    listed = F.array(*[F.lit(x).cast("long") for x in firsts or [0]])
    begins = F.coalesce((F.col("range") > 0) & (F.get(listed, F.col("range")) == F.col("doc_id")), F.lit(False))
    places = F.array_compact(F.array(
        F.struct(F.col("range").alias("range"), F.lit(0).alias("extra")),
        F.when(begins, F.struct((F.col("range") - 1).alias("range"), F.lit(1).alias("extra"))),
        F.when(first_of_all, F.struct(F.lit(last).alias("range"), F.lit(2).alias("extra"))),
    ))
    rows = placed.withColumn("places", places).select("doc_id", "text", F.inline("places"))
    rows = prepare(rows.repartition("range"))
    order = W.partitionBy("range").orderBy("extra", F.asc_nulls_first("doc_id"), "text")
    return rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns]).filter("extra = 0").drop("range", "extra")


def fingerprints(docs: DataFrame, k: int = 6, s: int = 2, ranges: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row.

    The edited text has the last half of its code points (rounded down) replaced by the first as many of the next
    document by ascending ``doc_id``, then text; null ids come first, and after the last document comes the first. A null text counts as empty: no
    anchors, an empty fingerprint. ``near_*`` are the :func:`likeness` of all anchors of the document to those of
    its edited text and of the next document. A repeated row has its twin as next document.
    """
    ranges = ranges or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = with_next(texts(docs), ranges, lambda df: with_places(df, "text", "positions", "hashes", k, s), ("text", "positions", "hashes"))
    half = F.floor(F.col("n_chars") / 2)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")),
        F.substring(F.col("next_text"), F.lit(1), half.cast("int")),
    ))
    rows = rows.select("doc_id", "n_chars", "edited", "positions", "hashes", "next_positions", "next_hashes")
    rows = with_places(rows, "edited", "edited_positions", "edited_hashes", k, s)
    own, edited, following = ((F.col(f"{x}positions"), F.col(f"{x}hashes")) for x in ("", "edited_", "next_"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint_text(*own).alias("fingerprint"),
        fingerprint_text(*edited).alias("edited_fingerprint"),
        likeness(*own, *edited).alias("near_edited"), likeness(*own, *following).alias("near_next"),
    )
