"""Encoding and decoding whole texts, where passages that documents share are encoded once.

1. A rolling hash over bytes cuts texts into chunks at places that depend on the content around them
   alone, so equal passages give equal chunks wherever they stand.
2. Chunks that occur more than once are encoded once, by the first document that holds them. Only the
   *core* counts: what lies between the first and the last blank at which the vocabulary surely cuts.
3. Documents come together with the cores they hold. What lies between cores is encoded in place, with the
   neighbouring piece of each core; the join is good if both neighbours come out as the core has them. If
   not, the join takes in one more piece of each core, until the encodings agree.

Texts cross the network once; of encoded chunks only the shared ones do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage, kept, row_hashes, sliced, texts
from replyloom.llm.token_units import LOWER_WORDS, SAFE_BLANK, Pieces, load_tokenizer, read_vocabulary

ENCODED = "doc_id long, n_tokens long, ids binary, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def cut_places(buffer, starts, window_power: int = 5, mask_bits: int = 12, shortest: int = 512, longest: int = 16384):
    """For each text of a buffer the ends of its chunks; ``starts`` has the texts' starts and the end of all.

    A place is cut where the hash of the 32 bytes before it has ``mask_bits`` zeros, moved on to the next
    whole character. The hash of a window of 2n bytes is made of those of its halves.
    """
    import numpy as np

    values = (np.arange(256, dtype=np.uint32) * np.uint32(2654435761) ^ np.uint32(0x9E3779B9))[buffer]
    factor = np.uint32(16777619)
    width = 1
    for _ in range(window_power):
        grown = values.copy()
        grown[width:] += values[:-width] * factor
        values, factor = grown, np.uint32((int(factor) * int(factor)) & 0xFFFFFFFF)
        width *= 2
    hits = np.flatnonzero(values >> np.uint32(32 - mask_bits) == 0) + 1
    out = []
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
        ends, last = [], start
        low, high = np.searchsorted(hits, (start + width, end))
        for place in [*hits[low:high].tolist(), end]:
            while place - last > longest:
                last = whole_character(buffer, last + longest, end)
                ends.append(last - start)
            place = whole_character(buffer, place, end)
            if place - last >= shortest and place < end:
                ends.append(place - start)
                last = place
        if end > last or not ends:
            ends.append(end - start)
        out.append(ends)
    return out


def whole_character(buffer, place: int, end: int) -> int:
    while place < end and buffer[place] & 0xC0 == 0x80:
        place += 1
    return place


def buffer_of(column):
    """Bytes of a string column one after the other, and the starts of its values with the end of all."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.cast(column, pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks_of(keyed: DataFrame) -> DataFrame:
    """``k1, k2, place, start, length, chunk``: bytes and 128-bit digest of each chunk of each text."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        digest = xxhash.xxh3_128_digest
        for batch in sliced(batches, "text"):
            buffer, starts = buffer_of(batch["text"])
            content = buffer.tobytes()
            columns: list[list] = [[], [], [], []]
            cut = cut_places(buffer, starts)
            for first, ends in zip(starts.tolist(), cut):
                start = 0
                for place, end in enumerate(ends):
                    for column, value in zip(columns, (place, start, end - start, digest(content[first + start:first + end]))):
                        column.append(value)
                    start = end
            of_text = pa.array([i for i, ends in enumerate(cut) for _ in ends], pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch["k1"].take(of_text), batch["k2"].take(of_text), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                names=["k1", "k2", "place", "start", "length", "chunk"],
            )

    return keyed.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, place int, start long, length long, chunk binary")


def core(chunk: str) -> tuple[str, list[str], str]:
    """What stands before the first sure cut of a chunk, the pieces between the cuts, and what stands after."""
    pieces = SAFE_BLANK.split(chunk)
    return (chunk, [], "") if len(pieces) < 3 else (pieces[0], pieces[1:-1], pieces[-1])


class Encoder:
    """Ids of pieces as bytes of ``width`` each, and their text, by the tokenizers library."""

    def __init__(self, vocabulary: str):
        import array

        self.tokenizer = load_tokenizer(vocabulary)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.code, self.width = ("H", 2) if size <= 1 << 16 else ("I", 4)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.pieces = Pieces(
            lambda parts: [array.array(self.code, e.ids).tobytes()
                           for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)],
            b"".join, LOWER_WORDS, lower=True,
        )

    def encode(self, values: list[str]) -> list[bytes]:
        return self.pieces.texts(values)

    def decode(self, ids: list[int]) -> str:
        if self.tokenizer.decoder is None:
            return " ".join(map(self.names.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def joined(parts: list, encode) -> bytes:
    """Ids of a text given as strings and cores in turn; a core is its pieces and their ids.

    ``encode`` gives the ids of a string. The text between two cores is encoded with the nearest piece of each
    core; if the ids of those pieces do not come out as the cores have them, with one more, and so on.
    """
    out = b""
    at = 0
    while at < len(parts):
        text, wide = parts[at], 0
        left = parts[at - 1] if at else None
        right = parts[at + 1] if at + 1 < len(parts) else None
        while True:
            wide += 1
            a = left[0][-wide:] if left else []
            b = right[0][:wide] if right else []
            ids_a, ids_b = b"".join(map(encode, a)), b"".join(map(encode, b))
            whole = encode("".join([*a, text, *b]))
            good_a = not left or out.endswith(ids_a) and whole.startswith(ids_a)
            good_b = not right or right[1].startswith(ids_b) and whole.endswith(ids_b)
            if good_a and good_b and len(whole) >= len(ids_a) + len(ids_b):
                out = out[:len(out) - len(ids_a)] + whole
                if right:
                    out += right[1][len(ids_b):]
                break
            if (not left or wide >= len(left[0])) and (not right or wide >= len(right[0])):
                # Nothing to agree on: this text with both cores is encoded as a whole.
                pieces = [*(left[0] if left else []), text, *(right[0] if right else [])]
                out = out[:len(out) - (len(left[1]) if left else 0)] + encode("".join(pieces))
                break
        at += 2
    return out


def encode_documents(docs: DataFrame, vocabulary: str, keep_output: bool = True) -> DataFrame:
    """``doc_id, n_tokens`` and the ids (little-endian, 32 bits each) and decoded text of every whole text.

    ``vocabulary`` is the path of a word vocabulary file of the tokenizers library. The ids are those the
    library gives for the whole text, without added special tokens, truncation or padding, and the text what
    it decodes from them, special tokens included. With ``keep_output`` false, SHA-256 digests
    ``ids_sha256`` and ``decoded_sha256`` stand in their place. Null and empty texts have no token. Null ids and
    repeated rows are kept as they are.
    """
    content = read_vocabulary(vocabulary)
    keyed = row_hashes(texts(docs))
    chunks = cut_lineage(chunks_of(keyed))
    shared = (
        chunks.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "place", "start", "length")).alias("first"))
        .filter("n > 1")
    )
    owned = shared.groupBy(F.col("first.k1").alias("o1"), F.col("first.k2").alias("o2")).agg(
        F.collect_list(F.struct("first.start", "first.length", "chunk")).alias("pieces")
    )

    def encode_chunks(batches):
        import pyarrow as pa

        encoder = kept("encoder", hash(content), lambda: Encoder(content))
        for batch in sliced(batches, "text"):
            names, inner = [], []
            for text, pieces in zip(batch["text"].to_pylist(), batch["pieces"].to_pylist()):
                data = text.encode()
                for piece in pieces:
                    names.append(piece["chunk"])
                    inner.append("".join(core(data[piece["start"]:piece["start"] + piece["length"]].decode())[1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(encoder.encode(inner), pa.binary())],
                                             names=["known", "ids"])

    encoded = (
        keyed.join(owned.hint("shuffle_hash"), (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")))
        .select("doc_id", "text", "k1", "k2", "pieces").mapInArrow(encode_chunks, "known binary, ids binary")
    )
    used = (
        chunks.join(encoded, F.col("chunk") == F.col("known"))
        .groupBy(F.col("k1").alias("u1"), F.col("k2").alias("u2")).agg(F.collect_set(F.struct("start", "length", "ids")).alias("cores"))
    )

    def assemble(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        encoder = kept("encoder", hash(content), lambda: Encoder(content))
        for batch in sliced(batches, "text"):
            fresh, places, plans = [], [], []
            for text, cores in zip(batch["text"].to_pylist(), batch["cores"].to_pylist()):
                if not cores:
                    places.append(len(fresh))
                    plans.append(None)
                    fresh.append(text)
                    continue
                data, parts, open_text, at = text.encode(), [], "", 0
                for c in sorted(cores, key=lambda c: c["start"]):
                    head, pieces, tail = core(data[c["start"]:c["start"] + c["length"]].decode())
                    open_text += data[at:c["start"]].decode()
                    at = c["start"] + c["length"]
                    if pieces:
                        parts += [open_text + head, (pieces, c["ids"])]
                        open_text = tail
                    else:
                        open_text += head
                parts.append(open_text + data[at:].decode())
                places.append(-1)
                plans.append(parts)
            whole = encoder.encode(fresh)
            one = lambda value: encoder.encode([value])[0]
            ids = [whole[p] if plan is None else joined(plan, one) for p, plan in zip(places, plans)]
            arrays = [np.frombuffer(x, f"<u{encoder.width}").astype("<u4") for x in ids]
            decoded = (encoder.decode(a.tolist()) for a in arrays)
            if keep_output:
                last = [pa.array([a.tobytes() for a in arrays], pa.binary()), pa.array(list(decoded), pa.string())]
            else:
                last = [pa.array([hashlib.sha256(a.tobytes()).hexdigest() for a in arrays], pa.string()),
                        pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string())]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(a) for a in arrays], pa.int64()), *last],
                                             names=[f.split()[0] for f in (ENCODED if keep_output else DIGESTS).split(", ")])

    return (
        keyed.join(used.hint("shuffle_hash"), (F.col("k1") == F.col("u1")) & (F.col("k2") == F.col("u2")), "left")
        .select("doc_id", "text", "k1", "k2", "cores").mapInArrow(assemble, ENCODED if keep_output else DIGESTS)
    )
