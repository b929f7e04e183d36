"""Ids of whole texts under a byte-level vocabulary, by the faster of two libraries with equal output."""

from __future__ import annotations

import json
from collections.abc import Callable

from replyloom.llm.common import kept
from replyloom.llm.token_units import PLAIN, load_tokenizer


def byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes stand for
    themselves, the others follow from U+0100 on in their order."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def ranks_of(vocabulary: str) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """Ids by bytes, and special ids by text, where the order of merges is the order of ids."""
    content = json.loads(vocabulary)
    model, special = content["model"], {t["content"]: t["id"] for t in content["added_tokens"]}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    ids = {token: i for token, i in model["vocab"].items() if token not in special}
    pre = content["pre_tokenizer"]
    plain = (
        content["normalizer"] is None and content["post_processor"] is None and pre["type"] == "ByteLevel"
        and pre["use_regex"] and not pre["add_prefix_space"] and not model.get("end_of_word_suffix")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in content["added_tokens"])
    )
    if not plain or any(ids.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    to_byte = byte_of_char()
    return {bytes(map(to_byte.__getitem__, token)): i for token, i in ids.items()}, special


def text_encoder(vocabulary: str, pattern: str) -> Callable:
    """A function from a text to its ids as a uint32 array, made once per worker.

    Texts of ASCII and plain Latin characters go to tiktoken, which is about four times as fast, all
    others to tokenizers: only outside those characters could the Unicode tables of the two differ.
    """
    def make():
        import numpy as np
        import tiktoken

        tokenizer, found = load_tokenizer(vocabulary), ranks_of(vocabulary)

        def by_tokenizers(text):
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

        if found is None:
            return by_tokenizers
        ranks, special = found
        fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: (
            fast.encode_to_numpy(text, allowed_special="all") if text.isascii() or PLAIN(text)
            else by_tokenizers(text)
        )

    return kept("text encoder", (hash(vocabulary), pattern), make)
