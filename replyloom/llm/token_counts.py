"""Token counts of whole texts, without keeping the tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame

from replyloom.llm.common import kept, sliced, texts
from replyloom.llm.token_units import BYTE_WORDS, Pieces, load_tokenizer, read_vocabulary

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(
    docs: DataFrame, vocabulary: str, limit: int = 1024, batch_bytes: int = 1 << 20,
    column_bytes: int = 8 << 20,
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: a row for each row of ``docs``.

    ``vocabulary`` is the path of a byte-level vocabulary file of the tokenizers library, read on the
    driver. Tasks take Arrow batches of about ``column_bytes`` of text; texts are cut at safe
    boundaries (see :mod:`token_units`), and the library encodes batches of about ``batch_bytes``.
    Only lengths leave a task. Null text counts as empty: 0 bytes, 0 tokens. A null ``doc_id`` and
    repeated rows are kept as they are. Other columns are ignored.
    """
    content = read_vocabulary(vocabulary)

    def count(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        tokenizer = load_tokenizer(content)

        def lengths(pieces):
            return [len(e) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

        pieces = kept("count pieces", hash(content), lambda: Pieces(lengths, sum, BYTE_WORDS, batch_bytes=batch_bytes))
        for batch in sliced(batches, "text", column_bytes):
            column = batch["text"]
            counts = pa.array(pieces.texts(column.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pc.cast(pc.binary_length(column), pa.int64()), counts, pc.greater(counts, limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return texts(docs).mapInArrow(count, COUNTS)
