"""Encoding and decoding by a piece vocabulary, where each different word is segmented once.

The vocabulary marks white space in front of words, and none of its pieces has such a marker behind another
character. So no piece lies on both sides of a place where a marker follows another character: there a text is cut into
marked words, and the ids of a text are those of its words one after the other. Different words meet by their hash (see
:mod:`word_blocks`), the library segments each of them once, and the ids come back to the places of the words.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import kept, texts
from replyloom.llm.word_blocks import VALUES, block_bytes, by_shard, cut_words, row_batch, squeeze, unsqueeze, with_values, word_blocks

MARK = "▁"
#: One marker behind another character; markers at the end of a text stay with the last word.
CUT = re.compile(rf"(?<=[^ {MARK}])[ {MARK}](?=[ {MARK}]*[^ {MARK}])")

ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def load_pieces(model: bytes):
    """The library's processor, once per worker."""
    def make():
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_proto=model)

    return kept("pieces", hash(model), make)


def words_stand_alone(processor) -> bool:
    """Whether texts may be cut at markers: a marker is put in front and no other character is ever changed,
    and no piece goes on behind a word."""
    names = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any(MARK in name.lstrip(MARK) for name in names):
        return False
    changed = processor.normalize(" a  b ") != MARK * 2 + "a" + MARK * 2 + "b" + MARK
    for start in range(1, 0x110000, 0x8000):
        probe = "".join(chr(c) for c in range(start, min(start + 0x8000, 0x110000)) if c != 32 and not 0xD800 <= c < 0xE000)
        changed = changed or processor.normalize(probe) != MARK + probe
    return not changed


def marked_words(text: str) -> list[str]:
    """Words of a text, each without the marker in front of it, which the library puts back."""
    if not text:
        return []
    if text[0] != " " and text[-1] != " " and "  " not in text and MARK not in text:
        return text.split(" ")
    return CUT.split(text)


def whole_text(text: str) -> list[str]:
    return [text] if text else []


def read_words(cut: Callable) -> Callable:
    def read(batch):
        import numpy as np
        import pyarrow.compute as pc

        lists = [cut(text) for text in batch["text"].to_pylist()]
        ids = batch["doc_id"]
        head = squeeze(
            pc.is_null(ids).to_numpy(zero_copy_only=False).astype(np.uint8), pc.fill_null(ids, 0).to_numpy(),
            np.fromiter(map(len, lists), np.int64, len(lists)),
        )
        return [(b"", [word for words in lists for word in words])], head

    return read


def encode_pieces(docs: DataFrame, vocabulary: str, keep_output: bool = True, block_size: int = 32 << 20,
                  shard_size: int = 16 << 20, stable: bool = False) -> DataFrame:
    """``doc_id, n_tokens`` and the ids (little-endian, 32 bits each) and decoded text of every whole text.

    ``vocabulary`` is the path of a model file of the sentencepiece library. Ids are those the library gives for the
    whole text with an end id only and without sampling, and the text is what it decodes from them. With ``keep_output``
    false, SHA-256 digests stand in their place: ``ids_sha256`` of the ids in decimals joined by blanks, and
    ``decoded_sha256``. Where a vocabulary has pieces that go on behind a word, or changes characters, a whole
    text takes the place of a word, and equal texts are segmented once.

    Null and empty texts have the end id alone. Null ids and repeated rows are kept as they are, ties do not arise. A very long text
    is a block of its own. An empty table gives no row. Other columns are left out, whatever their names.

    ``block_size`` bytes of text make a block, ``shard_size`` bytes of all texts a shard of words. ``stable`` says that
    ``docs`` gives the same rows in the same order each time it is read, as files do; blocks need not be written then.
    """
    with open(vocabulary, "rb") as file:
        model = file.read()
    cut = marked_words if words_stand_alone(load_pieces(model)) else whole_text
    rows = texts(docs)
    size = block_bytes(rows)
    shards = max(1, -(-size // shard_size))
    blocks = word_blocks(rows, read_words(cut), shards, block_size, stable=stable)

    def segment(batches):
        """Ids of the words of each row; a word that stood in a row of the shard before is not segmented again."""
        import numpy as np

        processor = load_pieces(model)
        kind = "<u2" if processor.get_piece_size() <= 1 << 16 else "<u4"
        known: dict[bytes, bytes] = {}
        at = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != at:
                    known, at = {}, row["shard"]
                lengths, joined, _ = unsqueeze(row["payload"], 3)
                words = cut_words(lengths, joined)
                fresh = [w for w in words if w not in known]
                found = processor.encode([w.decode() for w in fresh], num_threads=1)
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                flat = np.fromiter((i for ids in found for i in ids), kind, int(sizes.sum())).tobytes()
                ends = (np.cumsum(sizes) * int(kind[2])).tolist()
                known.update(zip(fresh, (flat[a:b] for a, b in zip([0, *ends], ends))))
                values = list(map(known.__getitem__, words))
                sizes = np.fromiter(map(len, values), "<u4", len(values)) // np.uint32(int(kind[2]))
                yield row_batch([(row["block"], VALUES, row["shard"], squeeze(sizes.astype("<u4"), b"".join(values)))])

    def assemble(payloads):
        import numpy as np

        processor = load_pieces(model)
        kind = "<u2" if processor.get_piece_size() <= 1 << 16 else "<u4"
        end = processor.eos_id()
        pairs = [unsqueeze(p, 2) for p in payloads]
        sizes = np.concatenate([np.zeros(0, "<u4"), *[np.frombuffer(p[0], "<u4") for p in pairs]]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, kind), *[np.frombuffer(p[1], kind) for p in pairs]]).astype("<u4")
        ends = np.cumsum(sizes)
        cuts = list(zip([0, *ends.tolist()], ends.tolist()))
        listed = ids.tolist()
        decoded = processor.decode([listed[a:b] for a, b in cuts]) if cuts else []
        names = kept("piece names", hash(model), lambda: [str(i) for i in range(processor.get_piece_size())])
        decimals = list(map(names.__getitem__, listed))
        numbers = [] if keep_output else [" ".join(decimals[a:b]) for a, b in cuts]
        del listed, decimals

        def of_slice(count, head, places):
            import hashlib

            import pyarrow as pa

            if count != len(sizes):
                raise RuntimeError("a block has lost words")
            nulls, keys, lengths = unsqueeze(head, 3)
            keys = pa.array(np.frombuffer(keys, np.int64), mask=np.frombuffer(nulls, np.uint8).astype(bool))
            stops = np.cumsum(np.frombuffer(lengths, np.int64))
            counts, first, second = [], [], []
            for a, b in zip([0, *stops.tolist()], stops.tolist()):
                of_text = places[a:b]
                counts.append(int(sizes[of_text].sum()) + 1)
                words = of_text.tolist()
                text = " ".join(map(decoded.__getitem__, words))
                if keep_output:
                    parts = [ids[cuts[w][0]:cuts[w][1]] for w in words]
                    first.append(np.concatenate([*parts, np.array([end], "<u4")]).astype("<u4").tobytes())
                    second.append(text)
                else:
                    first.append(hashlib.sha256(" ".join([*map(numbers.__getitem__, words), str(end)]).encode()).hexdigest())
                    second.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(counts, pa.int64()), pa.array(first, pa.binary() if keep_output else pa.string()), pa.array(second, pa.string())],
                names=[f.split()[0] for f in (ENCODED if keep_output else DIGESTS).split(", ")],
            )

        return of_slice

    values = by_shard(blocks, shards).mapInArrow(segment, blocks.schema)
    return with_values(blocks, values, -(-size // block_size), assemble, ENCODED if keep_output else DIGESTS)
