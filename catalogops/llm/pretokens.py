"""Pre-tokens of a text, and a bounded per-process memory of what they encode to."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: Fixed value: the public pattern that byte-level BPE vocabularies split text by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# The same over ASCII only, for the faster module; its \s would take in four control characters.
_ASCII = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)
_SPACE = r"\p{White_Space}"
_ANY = regex.compile(PATTERN.replace(r"[^\s", rf"[^{_SPACE}").replace(r"\s", _SPACE).replace(r"(?!\S)", rf"(?!\P{{White_Space}})"))

# Entries kept in memory by a worker process, and the longest pre-token kept.
REMEMBERED, REMEMBERED_CHARS = 200_000, 64


def pre_tokens(text: str) -> list[str]:
    """The matches of PATTERN in order; end to end they are the whole text."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


class Memory(dict):
    """What a pre-token encodes to; emptied when it holds REMEMBERED entries."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        made = self.encode(piece)
        if len(piece) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = made
        return made


# White space before a space: there a cut at the space could part a run of white space.
_RUN = re.compile(r"\s ")


class Encoder:
    """Encodes texts by the encoding of single pre-tokens, whose results are joined.

    A pre-token never goes on past a character before a space, so a text without runs of white
    space can be cut at its spaces and the stretches between them be remembered whole.
    """

    def __init__(self, encode: Callable[[str], bytes]):
        self._piece = Memory(encode)
        self._stretch = Memory(lambda s: self._pieces(f" {s}"))

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece.__getitem__, pre_tokens(text)))

    def __call__(self, text: str) -> bytes:
        if _RUN.search(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self._pieces(first) + b"".join(map(self._stretch.__getitem__, rest))
