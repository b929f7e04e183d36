"""TF-IDF over words and word pairs, class weights and combined feature vectors."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from replyloom.functions.text import ngrams
from replyloom.session import cut_lineage

MAX_VOCABULARY = 1_000_000


@lru_cache(maxsize=1)
def _accent_table() -> tuple[str, str, dict[str, str]]:
    """Characters that decompose to one base character, and that character; marks are dropped.

    Those that decompose to more, as ligatures do, are given apart, with what takes their place.
    """
    marked, plain, marks, longer = [], [], [], {}
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        if unicodedata.combining(char):
            marks.append(char)
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)
        )
        if len(base) == 1 and base != char:
            marked.append(char)
            plain.append(base)
        elif len(base) > 1 and not 0xAC00 <= code <= 0xD7A3:
            longer[char] = base
    return "".join(marked + marks), "".join(plain), longer


def drop_accents(c: Column) -> Column:
    """Replace accented and compatibility characters by their base characters.

    Hangul syllables stay whole; words are the same with them taken apart.
    """
    marked, plain, longer = _accent_table()
    table = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    taken_apart = F.array_join(F.transform(F.split(c, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    has_any = c.rlike("[" + "".join(sorted(longer)) + "]")
    return F.translate(F.when(has_any, taken_apart).otherwise(c), marked, plain)


def add_terms(df: DataFrame, text: str, out: str = "terms", sizes: Sequence[int] = (1, 2),
              strip_accents: bool = False, ascii_only: bool = False) -> DataFrame:
    """Add the lower-case words of two or more word characters, and runs of them."""
    lower = F.lower(F.col(text))
    if strip_accents:
        lower = drop_accents(lower)
    pattern = r"\w\w+" if ascii_only else r"(?U)\w\w+"
    words = F.regexp_extract_all(lower, F.lit(pattern), 0)
    if tuple(sizes) == (1,):
        return df.withColumn(out, words)
    return (
        df.withColumn("_words", words)
        .withColumn(out, F.flatten(F.array(*[ngrams("_words", n) for n in sizes])))
        .drop("_words")
    )


def term_counts(df: DataFrame, key: str, listed: str = "terms") -> DataFrame:
    """(key, term, tf) per document."""
    # the outer form keeps Spark from working the list out twice, to drop empty ones early
    return (
        df.select(key, F.explode_outer(listed).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy(key, "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def vocabulary(counts: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(term, df): terms in ``min_df`` documents or more, the most frequent ``max_features``."""
    table = counts.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")
    ).where(F.col("df") >= min_df)
    if max_features is not None:
        table = leading_terms(cut_lineage(table), max_features)
    return table.select("term", "df")


def leading_terms(table: DataFrame, n: int, small: int = 1_000) -> DataFrame:
    """The ``n`` rows of (term, total, ...) with the largest total, of equal ones with the first terms.

    Nothing is sorted whole. Counts of terms by total say which total the cut falls on; among the terms with that
    total, counts by a growing prefix lead to the last term that is taken. Jobs run while the plan is built, each an aggregate over ``table``.
    """
    above = Window.orderBy(F.desc("total"))
    at = (
        table.groupBy("total").agg(F.count(F.lit(1)).alias("terms"))
        .withColumn("upto", F.sum("terms").over(above)).where(F.col("upto") >= n)
        .orderBy(F.desc("total")).first()
    )
    if at is None:
        return table
    need, size, prefix = n - (at["upto"] - at["terms"]), at["terms"], ""
    if need == size:
        return table.where(F.col("total") >= at["total"])
    tied = table.where(F.col("total") == at["total"])
    while size > small:
        # a term that ends with the prefix is a group of its own, and the first
        groups = (
            tied.where(F.col("term").startswith(prefix))
            .groupBy(F.substring("term", 1, len(prefix) + 1).alias("start")).agg(F.count(F.lit(1)).alias("terms"))
            .orderBy("start").collect()
        )
        for group in groups:
            if need <= group["terms"]:
                break
            need -= group["terms"]
        prefix, size, ended = group["start"], group["terms"], group["start"] == prefix
        if ended:
            break
    inside = tied.where(F.col("term").startswith(prefix)).select("term").orderBy("term").limit(need).collect()
    last = inside[need - 1]["term"]
    return table.where((F.col("total") > at["total"]) | (F.col("total") == at["total"]) & (F.col("term") <= last))


def _idf(df: Column, documents: Column) -> Column:
    return F.log((1.0 + documents) / (1.0 + df)) + 1.0


def tfidf_weights(df: DataFrame, key: str, listed: str = "terms", min_df: int = 1,
                  max_features: int | None = None, sublinear: bool = False) -> DataFrame:
    """(key, term, weight): smooth idf, optional 1 + ln tf, each document of length one."""
    counts = term_counts(df, key, listed)
    documents = df.agg(F.count(F.lit(1)).cast("double")).scalar()
    weighted = vocabulary(counts, min_df, max_features).withColumn(
        "idf", _idf(F.col("df"), documents)
    )
    tf = (1.0 + F.log(F.col("tf").cast("double"))) if sublinear else F.col("tf").cast("double")
    raw = counts.join(weighted, "term").withColumn("raw", tf * F.col("idf"))
    # one document holds no more terms than its text, so this group is bounded
    return (
        raw.groupBy(key)
        .agg(
            F.collect_list(F.struct("term", "raw")).alias("entries"),
            F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length"),
        )
        .select(key, "length", F.inline("entries"))
        .select(key, "term", (F.col("raw") / F.col("length")).alias("weight"))
    )


@dataclass(frozen=True)
class TfidfSettings:
    """Word and pair counts as the classifiers use them."""

    sizes: tuple[int, ...] = (1, 2)
    min_df: int = 2
    max_features: int = 30_000
    sublinear: bool = True
    strip_accents: bool = True


CLASSIFIER = TfidfSettings()
BASELINE = TfidfSettings(min_df=1, max_features=20_000, sublinear=False, strip_accents=False)
HYBRID = TfidfSettings(strip_accents=False)


def _weighted(df: DataFrame, counts: str, out: str, idf: np.ndarray) -> DataFrame:
    """Replace a column of sparse counts by ``out``: (1 + ln count) * idf, scaled to length one.

    No built-in takes the logarithm of a sparse vector's entries. Numpy does, over the entries of all vectors of a batch
    at once; indices stay as they are.
    """
    place = df.columns.index(counts)
    schema = T.StructType([*[f for f in df.schema.fields if f.name != counts], T.StructField(out, VectorUDT())])

    def weigh(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            kind, size, indices, values = batch.column(place).flatten()
            rows = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(values), 0).to_numpy())
            weight = (1.0 + np.log(values.flatten().to_numpy())) * idf[indices.flatten().to_numpy()]
            length = np.sqrt(np.bincount(rows, weight * weight, minlength=batch.num_rows))
            weight /= np.where(length > 0, length, 1.0)[rows]
            starts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            scaled = pa.StructArray.from_arrays(
                [kind, size, indices, pa.ListArray.from_arrays(pa.array(starts), pa.array(weight)).cast(values.type)],
                fields=list(batch.column(place).type),
            )
            others = [(c, f) for i, (c, f) in enumerate(zip(batch.columns, batch.schema)) if i != place]
            yield pa.RecordBatch.from_arrays([*[c for c, _ in others], scaled], names=[*[f.name for _, f in others], out])

    return df.mapInArrow(weigh, schema)


class Tfidf:
    """A fitted vocabulary with its idf values, applied to any frame.

    The vocabulary is bounded by ``max_features``, so it may come to the driver.
    """

    def __init__(self, words: list[str], idf: list[float], settings: TfidfSettings):
        self.words, self.idf, self.settings = words, idf, settings

    @classmethod
    def fit(cls, df: DataFrame, text: str, settings: TfidfSettings = CLASSIFIER) -> Tfidf:
        if not settings.max_features or settings.max_features > MAX_VOCABULARY:
            raise ValueError(f"max_features is at most {MAX_VOCABULARY}")
        numbered = df.select(F.monotonically_increasing_id().alias("_doc"), text)
        listed = add_terms(numbered, text, "terms", settings.sizes, settings.strip_accents)
        counts = term_counts(listed, "_doc")
        chosen = vocabulary(counts, settings.min_df, settings.max_features)
        documents = df.agg(F.count(F.lit(1)).cast("double")).scalar()
        rows = chosen.select("term", _idf(F.col("df"), documents).alias("idf")).collect()
        rows.sort(key=lambda r: r["term"])
        if not rows:
            raise ValueError("no term is left in the vocabulary")
        return cls([r["term"] for r in rows], [r["idf"] for r in rows], settings)

    def transform(self, df: DataFrame, text: str, out: str = "tfidf") -> DataFrame:
        """Add the sparse unit vector of each text; that of a null text is empty."""
        listed = add_terms(df, text, "_terms", self.settings.sizes, self.settings.strip_accents).withColumn(
            "_terms", F.coalesce("_terms", F.array().cast("array<string>"))
        )
        counter = CountVectorizerModel.from_vocabulary(
            self.words, inputCol="_terms", outputCol="_counts"
        )
        counted = counter.transform(listed)
        if not self.settings.sublinear:
            scale = ElementwiseProduct(
                scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_scaled"
            )
            unit = Normalizer(inputCol="_scaled", outputCol=out)
            return unit.transform(scale.transform(counted)).drop("_terms", "_counts", "_scaled")
        return _weighted(counted.drop("_terms"), "_counts", out, np.asarray(self.idf))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(
            list(zip(range(len(self.words)), self.words, self.idf, strict=True)),
            "place int, term string, idf double",
        ).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, settings: TfidfSettings) -> Tfidf:
        rows = spark.read.parquet(path).orderBy("place").collect()
        return cls([r["term"] for r in rows], [r["idf"] for r in rows], settings)


def assemble(df: DataFrame, embedding: str, sparse: str, out: str = "features") -> DataFrame:
    """Dense embedding and sparse TF-IDF in one vector."""
    dense = df.withColumn("_dense", array_to_vector(F.col(embedding).cast("array<double>")))
    return VectorAssembler(inputCols=["_dense", sparse], outputCol=out).transform(dense).drop("_dense")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (classes * rows of the class)."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k")).alias("t"))
    return (
        counts.withColumn("t", totals.scalar())
        .select("label", "n", (F.col("t.rows") / (F.col("t.k") * F.col("n"))).alias("weight"))
    )
