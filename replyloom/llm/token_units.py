"""Exact tokenizer output from pieces that do not influence each other.

Both public tokenizers split a text by a pattern that never joins the two sides of a blank between
two characters that are not white space: the blank begins a new piece (byte-level vocabulary) or is
dropped (word vocabulary), and nothing looks back across it. A text is therefore cut in front of such
blanks, and each different piece is encoded by the library once per worker. Texts with other white
space next to a blank are cut by a pattern instead; special strings hold no blank, so no cut divides them.

Pieces of plain characters (ASCII and the Latin letters below U+0180, whose classes and composition no
Unicode version changes) are cut further by the vocabulary's own pattern, so that a word is encoded
once whatever stands next to it. All other pieces go to the library as they are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from replyloom.llm.common import kept

#: Pieces and words remembered per worker (about 200 bytes each), and the longest of them.
REMEMBERED = 300_000
LONGEST = 80

SAFE_BLANK = re.compile(r"(?<=\S)(?= \S)")
#: U+001C to U+001F are white space to Python, but not to the vocabularies' patterns.
SAFE_SPACE = re.compile(r"(?<=\S)(?=[^\S\x1c-\x1f]\S)")
PLAIN = re.compile("[\n !-~À-įı-ſ]+").fullmatch
SPECIAL = "<|"

_LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
#: The patterns of the two vocabularies, for plain characters.
BYTE_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^\s0-9{_LETTER}]+|\s+(?!\S)|\s+"
).findall
LOWER_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[0-9]|[^\s0-9{_LETTER}]+").findall


def load_tokenizer(vocabulary: str):
    """Tokenizer from the text of its file, once per worker; truncation and padding off."""
    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(vocabulary)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        return tokenizer

    return kept("tokenizer", hash(vocabulary), make)


def read_vocabulary(path: str) -> str:
    """The vocabulary file as text; about 2 MB, sent with the function to the tasks."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_batches(pieces: Sequence[str], max_bytes: int) -> Iterator[Sequence[str]]:
    """Consecutive pieces of about ``max_bytes`` in all."""
    start = total = 0
    for i, piece in enumerate(pieces):
        if i > start and total + len(piece) > max_bytes:
            yield pieces[start:i]
            start, total = i, 0
        total += len(piece)
    if start < len(pieces):
        yield pieces[start:]


def long_cut(piece: str, longest: int = 1 << 16) -> list[str]:
    """A long piece, cut in front of single white-space characters between others."""
    if len(piece) <= longest:
        return [piece]
    whole, held, size = [], [], 0
    for part in SAFE_SPACE.split(piece):
        if held and size + len(part) > longest:
            whole.append("".join(held))
            held, size = [], 0
        held.append(part)
        size += len(part)
    whole.append("".join(held))
    return whole


def odd(part: str) -> bool:
    """What follows a blank is empty, or has white space at an end: a cut next to it may not be safe."""
    return not part or part[0].isspace() or part[-1].isspace()


class Pieces:
    """Encodes texts piece by piece and remembers pieces.

    ``encode`` gives a value for each of a list of strings, ``join`` makes one value of a list of them,
    ``words`` cuts a plain piece into parts that are encoded alone, ``lower`` tells that case is dropped.
    """

    def __init__(self, encode: Callable, join: Callable, words: Callable, lower: bool = False,
                 batch_bytes: int = 1 << 20):
        self.encode, self.join, self.words, self.lower, self.batch_bytes = encode, join, words, lower, batch_bytes
        self.after_blank: dict = {}
        self.word_values: dict = {}

    def fresh(self, pieces: Sequence[str]) -> list:
        """Values of pieces, each independent of what stood around it."""
        if len(self.word_values) > REMEMBERED:
            self.word_values = {}
        memory, words, lower = self.word_values, self.words, self.lower
        plan, seen = [], set()
        for piece in pieces:
            if piece.isascii() and piece[1:].isalpha():
                parts = words(piece.lower() if lower else piece) if "'" in piece else (
                    [piece.lstrip(" ").lower()] if lower else [piece])
            elif PLAIN(piece) and SPECIAL not in piece:
                parts = words(piece.lower() if lower else piece)
            else:
                parts = long_cut(piece)
            plan.append(parts)
            seen.update(parts)
        new = list(seen.difference(memory))
        for chunk in byte_batches(new, self.batch_bytes):
            memory.update(zip(chunk, self.encode(chunk)))
        look, join = memory.__getitem__, self.join
        out = [look(parts[0]) if len(parts) == 1 else join(list(map(look, parts))) for parts in plan]
        for part in new:
            if len(part) > LONGEST:
                del memory[part]
        return out

    def texts(self, texts: Sequence[str]) -> list:
        """The value of each whole text."""
        if len(self.after_blank) > REMEMBERED:
            self.after_blank = {}
        split = [text.split(" ") for text in texts]
        seen: set = set()
        for parts in split:
            seen.update(parts[1:])
        memory = self.after_blank
        new = seen.difference(memory)
        odd_parts = {part for part in new if odd(part)}
        new -= odd_parts
        new = list(new)
        memory.update(zip(new, self.fresh([" " + part for part in new])))
        look, join = memory.__getitem__, self.join
        heads = self.fresh([parts[0] for parts in split])
        out = []
        for text, parts, head in zip(texts, split, heads):
            if odd_parts and not odd_parts.isdisjoint(parts) or odd(parts[0]):
                out.append(join(self.fresh(SAFE_BLANK.split(text)) if text else []))
            elif len(parts) == 1:
                out.append(head)
            else:
                values = list(map(look, parts[1:]))
                values.insert(0, head)
                out.append(join(values))
        for part in new:
            if len(part) > LONGEST:
                del memory[part]
        return out
