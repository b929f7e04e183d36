"""The registered queries: each operator with production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from replyloom.llm.block_topk import top_k
from replyloom.llm.chunk_bpe import encode_documents
from replyloom.llm.common import fold, table
from replyloom.llm.credentials import find_secrets, listing
from replyloom.llm.language import identify_language, language_samples
from replyloom.llm.ngram_lm import score_texts
from replyloom.llm.packing import pack
from replyloom.llm.phrase_tries import collocations
from replyloom.llm.piece_words import encode_pieces
from replyloom.llm.registry import query
from replyloom.llm.simhash import near_duplicates
from replyloom.llm.syncmers import fingerprints
from replyloom.llm.token_counts import token_counts
from replyloom.llm.toxicity import fit_toxicity, score_toxicity
from replyloom.llm.whitening import whiten


def held_out(folds: int = 4, held_fold: int = 2) -> Column:
    """Whether a document lies in the held fold; one without id does not."""
    return F.coalesce(fold("doc_id", folds) == held_fold, F.lit(False))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op6_language")
def op6_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = identify_language(docs, language_samples(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fit_toxicity(docs, table(spark, folder, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op3_credentials")
def op3_credentials(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", of_kind(0).alias("n_assign"), of_kind(1).alias("n_access"), of_kind(2).alias("n_hex"),
        F.sha2(listing(F.col("base")), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"),
    )


@query("op8_simhash")
def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), shingle=4, radius=4)


OP9_SQL = """
WITH kept AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM kept q JOIN kept c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 50 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op9_block_topk", OP9_SQL)
def op9_block_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query("op10_chunk_bpe")
def op10_chunk_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_output=False)


@query("op1_syncmers")
def op1_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))


@query("op4_ngram_lm")
def op4_ngram_lm(spark: SparkSession, folder: str) -> DataFrame:
    return score_texts(table(spark, folder, "documents"), folds=7, held_fold=2)


@query("op13_piece_words")
def op13_piece_words(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return encode_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_output=False, stable=True)


@query("op11_whitening")
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"), components=8)


OP12_SQL = r"""
WITH pieces AS (
    SELECT doc, lang, piece, unnest(words) AS word, generate_subscripts(words, 1) AS place
    FROM (
        SELECT doc, lang, piece, regexp_extract_all(text, '[^ \t]+') AS words
        FROM (
            SELECT doc, lang, unnest(parts) AS text, generate_subscripts(parts, 1) AS piece
            FROM (
                SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
                       regexp_split_to_array(
                           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[.,;:!?\x0A-\x0D]') AS parts
                FROM documents
            )
        )
    )
), followed AS (
    SELECT lang, word AS w1, lead(word, 1) OVER piece_words AS w2, lead(word, 2) OVER piece_words AS w3,
           lead(word, 3) OVER piece_words AS w4
    FROM pieces
    WINDOW piece_words AS (PARTITION BY doc, piece ORDER BY place)
), counts AS (
    SELECT lang, [w1] AS p, count(*) AS f FROM followed GROUP BY ALL
    UNION ALL SELECT lang, [w1, w2], count(*) FROM followed WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM followed WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
    UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM followed WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
), candidates AS (
    SELECT * FROM counts WHERE len(p) > 1
), cuts AS (
    SELECT c.lang, c.p, c.f AS a, h.f AS l, t.f AS r, k,
           CAST((2000000::HUGEINT * c.f) // (h.f::HUGEINT + t.f) AS BIGINT) AS score
    FROM (SELECT *, unnest(range(1, len(p))) AS k FROM candidates) c
    JOIN counts h ON h.lang = c.lang AND h.p = c.p[1:k]
    JOIN counts t ON t.lang = c.lang AND t.p = c.p[k + 1:]
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1
), insides AS (
    SELECT lang, p[s:s + n - 1] AS p, max(f) AS longer
    FROM (
        SELECT lang, p, f, n, unnest(range(1, len(p) - n + 2)) AS s
        FROM (SELECT *, unnest(range(2, len(p))) AS n FROM candidates WHERE len(p) > 2)
    )
    GROUP BY ALL
), kept AS (
    SELECT s.* FROM scored s LEFT JOIN insides i ON i.lang = s.lang AND i.p = s.p
    WHERE i.longer IS NULL OR 100 * i.longer::HUGEINT < 80 * s.a::HUGEINT
), totals AS (
    SELECT lang, count(*) AS n FROM pieces GROUP BY lang
)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, array_to_string(p, ' ')) AS rank,
       array_to_string(p, ' ') AS phrase, a, l, r, n, score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""


@query("op12_phrases", OP12_SQL)
def op12_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"), least=30, longest=4, first=2000)
