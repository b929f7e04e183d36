"""Secrets in texts, and credentials whose parts stand apart.

Plain patterns find the *base* spans. Besides, a text holds weak parts: identifiers after words such as
"user", strings of high entropy, and endpoints. Alone they mean little; they are reported where parts of
the other roles start within ``reach`` characters in the same document: a secret-like string beside an
identifier, an identifier beside a secret and an endpoint, an endpoint beside an identifier and a secret.

The interval join is an equal join on (document, stretch of ``reach`` characters) with the stretch itself
and its neighbours. The other side is reduced to the first and last start per stretch and role before, as
that decides whether any part is in reach; so a candidate meets at most three rows per role, however
many parts a document holds.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from replyloom.llm.common import cut_lineage, free_name, row_key, texts, with_text_struct

#: Kinds in the order of their listing; the first three are the base.
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ID, SECRET, ENDPOINT = 0, 1, 2

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
# Runs of one class: the shorter ones that the base drops need not be found first.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK_ID = re.compile(
    r"""(?:user(?:name)?|login|client[_-]?id|account[_-]?(?:id|name)?|tenant[_-]?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WEAK_ENDPOINT = re.compile(
    r"""https?://[^\s"'<>]+|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9.])"""
    r"""|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{3,}(?::[0-9]{1,5})?""",
    re.ASCII,
)

SPAN = "struct<kind:int, start:long, end:long>"
PARTS = f"base array<{SPAN}>, weak array<{SPAN}>"


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    found = []
    lower = text.lower()
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(1, *m.span()) for m in ACCESS.finditer(text)]
    found += [(2, *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], s[0]))


def weak_parts(text: str, base: list[tuple[int, int, int]], least_entropy: float = 3.2) -> list[tuple[int, int, int]]:
    """Weak parts as (role, start, end); none overlaps a base span or, for secrets, an endpoint."""
    secrets = [
        m.span() for m in WEAK_SECRET.finditer(text)
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= least_entropy
    ]
    ids = [m.span(1) for m in WEAK_ID.finditer(text)] if "=" in text or ":" in text else []
    if not (secrets or ids or base):
        return []
    endpoints = [m.span() for m in WEAK_ENDPOINT.finditer(text)]
    taken = [(s, e) for _, s, e in base]

    def free(spans, others):
        """Spans that overlap none of ``others``; both in order of their start."""
        out, others = [], sorted(others)
        at = 0
        for s, e in spans:
            while at < len(others) and others[at][1] <= s:
                at += 1
            if not any(o[0] < e and o[1] > s for o in others[at:at + 4]):
                out.append((s, e))
        return out

    endpoints = free(endpoints, taken)
    found = [(ENDPOINT, s, e) for s, e in endpoints]
    found += [(ID, s, e) for s, e in free(ids, taken)]
    found += [(SECRET, s, e) for s, e in free(secrets, taken + endpoints)]
    return found


def with_parts(docs: DataFrame, name: str) -> DataFrame:
    """All columns and a struct of the base spans and the weak parts of each text."""

    def find(values):
        import pyarrow as pa

        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        base = [base_spans(text) for text in values]
        weak = [weak_parts(text, spans) for text, spans in zip(values, base)]
        as_rows = lambda lists: pa.array(
            [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in lists], pa.list_(span)
        )
        return [as_rows(base), as_rows(weak)]

    return with_text_struct(docs, name, PARTS, find)


def linked_parts(found: DataFrame, reach: int) -> DataFrame:
    """``key, linked``: the weak parts of a document that have what completes them in reach.

    ``found`` holds ``key, base, weak`` and may hold repeated rows.
    """
    base_role = F.when(F.col("part.kind") == 1, ID).otherwise(SECRET)
    parts = (
        found.filter(F.size("weak") > 0)
        .select("key", F.explode(F.concat(
            F.transform("base", lambda p: F.struct(F.lit(False).alias("weak"), p.alias("part"))),
            F.transform("weak", lambda p: F.struct(F.lit(True).alias("weak"), p.alias("part"))),
        )).alias("entry"))
        .select("key", "entry.*")
        .select(
            "key", "weak", F.when(F.col("weak"), F.col("part.kind")).otherwise(base_role).alias("role"),
            F.col("part.start").alias("start"), F.col("part.end").alias("end"),
        )
        .withColumn("stretch", F.floor(F.col("start") / reach))
    )
    summary = parts.groupBy("key", "stretch", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    summary = summary.select(
        F.col("key").alias("other_key"), F.col("stretch").alias("other_stretch"), F.col("role").alias("other_role"), "first", "last"
    )
    candidates = parts.filter("weak").distinct().withColumn(
        "near", F.explode(F.array(*[F.col("stretch") + d for d in (-1, 0, 1)]))
    )
    met = candidates.join(
        summary,
        (F.col("key") == F.col("other_key")) & (F.col("near") == F.col("other_stretch"))
        & (F.col("first") <= F.col("start") + reach) & (F.col("last") >= F.col("start") - reach),
    )
    has = lambda role: F.max(F.when(F.col("other_role") == role, 1).otherwise(0)) == 1
    complete = met.groupBy("key", "role", "start", "end").agg(
        has(ID).alias("id"), has(SECRET).alias("secret"), has(ENDPOINT).alias("endpoint")
    ).filter(
        F.when(F.col("role") == SECRET, F.col("id"))
        .when(F.col("role") == ID, F.col("secret") & F.col("endpoint"))
        .otherwise(F.col("id") & F.col("secret"))
    )
    span = F.struct((F.col("role") + 3).cast("int").alias("kind"), F.col("start"), F.col("end"))
    return complete.groupBy("key").agg(F.collect_list(span).alias("linked"))


def ordered(spans: Column) -> Column:
    """Spans by start, then kind as listed."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"])))
    return F.transform(keyed, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def listing(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def find_secrets(docs: DataFrame, reach: int = 400) -> DataFrame:
    """``doc_id, key, base, spans``: for each row of ``docs`` its base spans and all spans, as arrays of
    ``kind`` (place in :data:`KINDS`), ``start``, ``end`` (code points, end exclusive), by start, then kind.

    Whole texts are searched; a null text counts as empty and has none. Repeated rows have equal spans; a
    null ``doc_id`` is kept. ``key`` tells rows apart (see :func:`row_key`).
    """
    found = cut_lineage(
        with_parts(texts(docs), "found").select("doc_id", row_key().alias("key"), "found.base", "found.weak")
    )
    linked = linked_parts(found, reach).select(F.col("key").alias("linked_key"), "linked")
    return found.join(linked, F.col("key") == F.col("linked_key"), "left").select(
        "doc_id", "key", "base",
        ordered(F.concat("base", F.coalesce("linked", F.array().cast(f"array<{SPAN}>")))).alias("spans"),
    )


def redact(docs: DataFrame, reach: int = 400, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span replaced by ``mark``; overlapping spans together by one.

    Texts without span stay as they are, null ones too. A numeric column ``n_chars`` follows the text.
    """
    spans = find_secrets(docs, reach).filter(F.size("spans") > 0)
    spans = spans.groupBy(F.col("key").alias("spans_key")).agg(F.first("spans").alias("spans"))
    name, out = free_name(docs, "row_key"), free_name(docs, "clean_text")
    keyed = docs.withColumn(name, row_key(docs["doc_id"].cast("long"), docs["text"].cast("string")))
    joined = keyed.join(spans.withColumnsRenamed({"spans": free_name(docs, "spans"), "spans_key": free_name(docs, "spans_key")}),
                        F.col(name) == F.col(free_name(docs, "spans_key")), "left")
    spans_name = free_name(docs, "spans")
    # From the left: what is kept so far, and where the next kept part starts.
    empty = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at"))
    step = lambda state, s: F.when(
        s["end"] > state["at"],
        F.struct(
            F.concat(
                state["text"],
                F.when(s["start"] >= state["at"], F.concat(F.substring(F.col("text"), (state["at"] + 1).cast("int"),
                       (s["start"] - state["at"]).cast("int")), F.lit(mark))).otherwise(F.lit("")),
            ).alias("text"),
            s["end"].alias("at"),
        ),
    ).otherwise(state)
    redacted = F.aggregate(
        F.col(spans_name), empty, step,
        lambda state: F.concat(state["text"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.length("text"))),
    )
    joined = joined.withColumn(out, F.when(F.col(spans_name).isNull(), F.col("text")).otherwise(redacted))
    columns = [
        F.col(out).alias("text") if c == "text"
        else F.when(F.col(spans_name).isNull(), F.col(c)).otherwise(F.length(out)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
        else F.col(c)
        for c in docs.columns
    ]
    return joined.select(*columns)
