"""Language identification by compression.

Each language has a raw-content dictionary of zstandard, made of texts in that language. A text is
encoded with every dictionary, block by block, and belongs to the language that gives the fewest bytes.
Sizes are whole bytes, so languages whose sizes are as good as equal, as with texts of a few words, are told
apart by the code length in parts of a bit that the same dictionaries give. Where the second smallest is
close, the language is told all the same and the text is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import fold, kept, texts, with_text_struct
from replyloom.session import literal_rows

UNKNOWN = "und"
RESULT = "lang_pred string, score double, margin double, rejected boolean"

#: Ends every block. Zstandard stores what it can't shrink as it is; with a run that it can shrink, short
#: texts are encoded as well, and differ between dictionaries.
TAIL = b" " + b"-" * 64

NOT_LETTERS = re.compile(r"[\W\d_]+")


def plain(text: str) -> str:
    """Letters in lower case, everything between them one blank."""
    return NOT_LETTERS.sub(" ", text.lower()).strip()


class CodeLength:
    """Bits that a text takes when each byte is coded by how often it follows the two before in ``content``.

    Pairs of bytes that ``content`` lacks fall back on the byte before, then on the share of the byte itself.
    """

    def __init__(self, content: bytes):
        from collections import Counter

        self.counts = [Counter(content)]
        for n in (2, 3):
            self.counts.append(Counter(content[i:i + n] for i in range(len(content) - n + 1)))
        self.total = len(content)

    def bits(self, content: bytes) -> float:
        import math

        single, pairs, triples = self.counts
        out = 0.0
        for i in range(1, len(content)):
            p = (single[content[i]] + 0.5) / (self.total + 128)
            p = (pairs[content[i - 1:i + 1]] + 4 * p) / (single[content[i - 1]] + 4)
            if i > 1:
                p = (triples[content[i - 2:i + 1]] + 4 * p) / (pairs[content[i - 2:i]] + 4)
            out -= math.log2(p)
        return out


def language_samples(
    docs: DataFrame, folds: int = 4, held_fold: int = 2, sample_docs: int = 200, sample_chars: int = 4096,
    dictionary_bytes: int = 1 << 15, all_bytes: int = 1 << 23,
) -> dict[str, bytes]:
    """A dictionary for each language, the most frequent first.

    Fitted on a bounded sample: about ``sample_docs`` documents of each language, chosen by a hash of
    their id, and of each a passage of at most ``sample_chars`` characters from a place that the hash
    chooses. All languages are learned, with dictionaries of equal size: ``dictionary_bytes``, or where
    there are many languages their share of ``all_bytes``. Rows without language, without id or of the
    held fold are never used; blank languages count as none, and an empty table gives no dictionary.
    """
    learned = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"), docs["lang"].cast("string").alias("lang"), docs["text"].alias("text")
    ).filter(F.col("lang").isNotNull() & (F.trim("lang") != "") & (fold("doc_id", folds) != held_fold))
    counts = learned.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return {}
    dictionary_bytes = min(dictionary_bytes, max(256, all_bytes // len(counts)))
    sample_docs = min(sample_docs, max(4, dictionary_bytes // 64))
    share = literal_rows(
        docs.sparkSession, ["share_lang", "share"], [(r["lang"], min(1.0, 1.5 * sample_docs / r["count"])) for r in counts]
    )
    place = F.xxhash64("doc_id")
    chosen = (
        learned.filter(F.col("text").isNotNull())
        .join(F.broadcast(share), F.col("lang") == F.col("share_lang"))
        .filter(F.pmod(place, F.lit(1_000_000)) < F.col("share") * 1_000_000)
        .withColumn("at", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - sample_chars, F.lit(0)) + 1))
        .select("lang", place.alias("place"), F.expr(f"substring(text, int(at) + 1, {sample_chars})").alias("text"))
        .groupBy("lang", "place").agg(F.min("text").alias("text"))
    )
    found: dict[str, list] = {r["lang"]: [] for r in counts}
    for row in chosen.orderBy("lang", "place").toLocalIterator():
        if len(found[row["lang"]]) < sample_docs:
            found[row["lang"]].append(plain(row["text"]))
    out = {}
    for lang, parts in found.items():
        # Equal shares, so that one long text does not fill a dictionary.
        each = max(64, dictionary_bytes // max(1, len(parts)))
        content, spare = b"", b""
        for part in parts:
            encoded = part.encode()
            content += encoded[:each] + b" "
            spare += encoded[each:] + b" "
        content = (spare + content)[-dictionary_bytes:]
        if content.strip():
            out[lang] = content
    return out


def with_language(
    docs: DataFrame, samples: Mapping[str, bytes], name: str = "language", level: int = 6,
    block_bytes: int = 4096, narrow: float = 0.01,
) -> DataFrame:
    """All columns of ``docs`` and a struct ``name`` of ``lang_pred, score, margin, rejected``.

    ``margin`` is by how much the second smallest encoding is larger than the smallest, as a share of
    that; ``score`` is the share of the chosen language when sizes are turned into weights. A null
    text and one without letter give ``und`` with score 0, and so does any text if ``samples`` is empty.
    Sizes within two bytes a block of the smallest are no difference: such languages are compared by code length, and the
    margin is that of the code lengths. What still ties goes to the language with more training rows. ``rejected``
    marks ``und`` and margins below ``narrow``, and nothing if ``samples`` is empty. Whole texts are encoded. Null ids and repeated rows stay as they are.
    """
    languages, contents = list(samples), [samples[lang] for lang in samples]

    def judge_all(values):
        import math

        import zstandard

        def make():
            out = []
            for content in contents:
                params = zstandard.ZstdCompressionParameters.from_level(
                    level, write_content_size=False, write_checksum=False, write_dict_id=False
                )
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=params)
                out.append(zstandard.ZstdCompressor(dict_data=dictionary, compression_params=params).compress)
            return out

        lengths = kept("code lengths", tuple(contents), dict)
        encoders = kept("language", (tuple(contents), level), make)
        empty = min((len(encode(b" " + TAIL)) for encode in encoders), default=0)

        def judge(text):
            letters = plain(text)
            if not letters or not encoders:
                return UNKNOWN, 0.0, 0.0
            content = letters.encode()
            blocks = [b" " + content[at:at + block_bytes] + TAIL for at in range(0, len(content), block_bytes)]
            sizes = [sum([len(encode(b)) for b in blocks]) - empty * len(blocks) for encode in encoders]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            least = max(1, sizes[best])
            second = min((s for i, s in enumerate(sizes) if i != best), default=2 * least)
            score = 1 / sum(math.exp(-50 * min(10, (s - sizes[best]) / least)) for s in sizes)
            close = [i for i, s in enumerate(sizes) if s <= sizes[best] + 2 * len(blocks)]
            if len(close) == 1:
                return languages[best], score, max(0, second - sizes[best]) / least
            bits = []
            for i in close:
                if i not in lengths:
                    lengths[i] = CodeLength(contents[i])
                bits.append(lengths[i].bits(b" " + content + b" "))
            (first, best), (other, _) = sorted(zip(bits, close))[:2]
            return languages[best], score, (other - first) / max(1.0, first)

        names, scores, margins = zip(*map(judge, values))
        rejected = [bool(encoders) and (name == UNKNOWN or margin < narrow) for name, margin in zip(names, margins)]
        return list(names), list(scores), list(margins), rejected

    return with_text_struct(docs, name, RESULT, judge_all)


def identify_language(docs: DataFrame, samples: Mapping[str, bytes], **settings) -> DataFrame:
    """``doc_id, lang_pred, score, margin, rejected``: a row for each row of ``docs``, as above."""
    return with_language(texts(docs), samples, "found", **settings).select("doc_id", "found.*")
