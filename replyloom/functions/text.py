"""Column expressions over message text and loosely typed fields.

Whitespace, word and digit classes follow Unicode by default; ``ascii_only=True`` narrows them to
ASCII for engines whose regular expressions know nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from replyloom import fixed_values as fixed

SPACE = r"[\s\x1c-\x1f]"


def _flag(ascii_only: bool) -> str:
    return "" if ascii_only else "(?U)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str, ascii_only: bool = False) -> Column:
    """Drop white space of every kind at both ends (SQL ``trim`` drops blanks only)."""
    space = r"\s" if ascii_only else SPACE
    return F.regexp_replace(_col(c), f"{_flag(ascii_only)}^{space}+|{space}+$", "")


def is_blank(c: Column | str, ascii_only: bool = False) -> Column:
    """True for NULL, empty and white-space-only values; never NULL."""
    return F.coalesce(F.length(strip(c, ascii_only)) == 0, F.lit(True))


def has_text(c: Column | str, ascii_only: bool = False) -> Column:
    return ~is_blank(c, ascii_only)


def blank_to_null(c: Column | str, ascii_only: bool = False) -> Column:
    return F.nullif(strip(c, ascii_only), F.lit(""))


def null_to_blank(c: Column | str) -> Column:
    return F.coalesce(_col(c).cast("string"), F.lit(""))


def collapse_spaces(c: Column | str, ascii_only: bool = False) -> Column:
    space = r"\s" if ascii_only else SPACE
    return strip(F.regexp_replace(_col(c), f"{_flag(ascii_only)}{space}+", " "), ascii_only)


def normalize_text(c: Column | str, ascii_only: bool = False) -> Column:
    """Lower case, single blanks between words, none at the ends."""
    return collapse_spaces(F.lower(_col(c)), ascii_only)


def normalize_for_discovery(c: Column | str, ascii_only: bool = False) -> Column:
    """Lower case without links, mentions, digits and anything else but a-z and apostrophes."""
    u = _flag(ascii_only)
    out = F.lower(_col(c))
    for pattern in (r"https?://\S+|www\.\S+", r"@\w+", r"\d+", r"[^a-z'\s]"):
        out = F.regexp_replace(out, u + pattern, " ")
    return collapse_spaces(out, ascii_only)


def tokens(normalized: Column | str, stopwords: Sequence[str] = tuple(fixed.STOPWORDS)) -> Column:
    """Words of three or more characters that are no stop words, in text order."""
    words = F.regexp_extract_all(_col(normalized), F.lit("[a-z][a-z']+"), 0)
    stop = F.array(*[F.lit(w) for w in stopwords]) if stopwords else None
    if stop is None:
        return F.filter(words, lambda w: F.length(w) > 2)
    return F.filter(words, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def ngrams(words: Column | str, n: int) -> Column:
    """Runs of ``n`` neighbouring words joined by a blank; empty when there are too few."""
    words = _col(words)
    if n == 1:
        return words
    length = F.greatest(F.size(words) - (n - 1), F.lit(0))
    runs = F.slice(words, 1, length)
    for k in range(2, n + 1):
        runs = F.zip_with(runs, F.slice(words, k, length), lambda a, b: F.concat_ws(" ", a, b))
    return runs


def parse_created_at(c: Column | str) -> Column:
    """``Tue Oct 31 22:10:47 +0000 2017`` to a timestamp, NULL where the text is anything else."""
    c = _col(c)
    day = F.when(c.rlike(r"(?i)^(mon|tue|wed|thu|fri|sat|sun) "), F.substring(c, 5, 64))
    return F.try_to_timestamp(day, F.lit("MMM dd HH:mm:ss Z yyyy"))


def parse_reply_ids(c: Column | str) -> Column:
    """Comma list of ids to an array of longs; blanks and anything but digits are dropped."""
    parts = F.transform(F.split(_col(c), ","), lambda p: strip(p))
    digits = F.filter(parts, lambda p: p.rlike("^[0-9]+$"))
    ids = F.filter(F.transform(digits, lambda p: p.try_cast("bigint")), lambda p: p.isNotNull())
    return F.coalesce(ids, F.array().cast("array<bigint>"))


def parse_tweet_id(c: Column | str) -> Column:
    """An id that may have been written as ``12`` or ``12.0``; NULL otherwise."""
    text = strip(_col(c).cast("string"))
    return F.regexp_extract(text, r"^(\d+)(\.0*)?$", 1).try_cast("bigint")


def normalize_bool(c: Column | str, accept_y: bool = False) -> Column:
    """True for true/1/yes (and y on request), false for all else, NULL included."""
    words = ["true", "1", "yes"] + (["y"] if accept_y else [])
    return F.coalesce(F.lower(strip(_col(c).cast("string"))).isin(words), F.lit(False))


def strict_bool(c: Column | str) -> Column:
    """True or false for their usual spellings, NULL for anything else."""
    word = F.lower(strip(_col(c).cast("string")))
    return F.when(word.isin("true", "yes", "y", "1"), F.lit(True)).when(
        word.isin("false", "no", "n", "0"), F.lit(False)
    )


def bool_text(c: Column | str) -> Column:
    return F.when(_col(c), F.lit("true")).otherwise(F.lit("false"))


def to_number(c: Column | str) -> Column:
    """Text to double, NULL where it is no number."""
    number = strip(_col(c).cast("string")).try_cast("double")
    return F.when(~F.isnan(number), number)


def clean_response(c: Column | str) -> Column:
    """Strip, drop one leading ``assistant:`` or ``response:``, unwrap one pair of quotes."""
    space = SPACE
    bare = F.regexp_replace(strip(c), f"(?iU)^(assistant|response){space}*:{space}*", "")
    quoted = (F.length(bare) >= 2) & bare.startswith('"') & bare.endswith('"')
    inner = strip(F.substring(bare, F.lit(2), F.length(bare) - 2))
    return F.when(quoted, inner).otherwise(bare)


def extract_json(c: Column | str) -> Column:
    """The text itself if it is JSON, else its first ``{`` to last ``}`` if that is; else NULL."""
    c = _col(c)
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(c).isNotNull(), c).when(
        F.try_parse_json(inner).isNotNull(), inner
    )


def extract_json_error(c: Column | str) -> Column:
    """Why :func:`extract_json` gave NULL; NULL where it gave JSON."""
    c = _col(c)
    return F.when(extract_json(c).isNull(), F.when(
        c.rlike(r"(?s)\{.*\}"), F.lit("Invalid JSON")
    ).otherwise(F.lit("No JSON object found.")))


def unfence_json(c: Column | str) -> Column:
    """Drop a surrounding code fence, then cut out first ``{`` to last ``}`` if there is one."""
    bare = strip(c)
    opened = F.regexp_replace(bare, r"(?iU)^```(?:json)?\s*", "")
    fenced = F.regexp_replace(opened, r"(?U)\s*```$", "")
    text = F.when(bare.startswith("```"), fenced).otherwise(bare)
    inner = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(inner != "", inner).otherwise(text)
