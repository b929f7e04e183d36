"""A cleaning pipeline over ``documents``: toxic texts, unclear languages and near copies go, secrets are
blanked out, and what is left is packed into sequences.

Each stage works on all that the one before kept. :func:`run` writes what a stage returns to the session's
checkpoint folder and reads it again, so a lost executor costs the work of one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage, free_name, table
from replyloom.llm.credentials import redact
from replyloom.llm.language import language_samples, with_language
from replyloom.llm.packing import pack
from replyloom.llm.simhash import keep_one
from replyloom.llm.toxicity import fit_toxicity, with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic; the model is learned from the labels of ``docs``."""
    name = free_name(docs, "toxicity")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return with_toxicity(docs, model, name).filter(F.col(name)["predicted"] == 0).select(*docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a margin; those without letter go as well."""
    name = free_name(docs, "language")
    found = with_language(docs, language_samples(docs), name)
    return found.filter(~F.col(name)["rejected"]).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return keep_one(docs, shingle=4, radius=4)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets blanked out of their texts."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of at most 1,024 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", packing),
]

#: Learned models, compression and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
