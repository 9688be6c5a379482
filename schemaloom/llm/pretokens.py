"""Splitting texts into pre-tokens, and remembering what an encoder gave for them."""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from functools import cached_property

#: Entries of one generation of what a task remembers: of chunks, and of pre-tokens inside of them, which are fewer.
REMEMBERED, INSIDE = 160_000, 40_000


#: Begins a chunk that has no space before it; a text that holds it is split by the pattern as a whole.
BARE = "\x00"
#: ASCII marks between a letter or digit and a space, a line end or the end: always a pre-token of their own.
_MARKS = re.compile(r"[!-/:-@\[-`{-~](?<=[^\W_].)[!-/:-@\[-`{-~]*+(?=[ \n]|\Z)")


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Remembered(dict):
    """What `work` gave for a string, in two generations.

    When the younger is full it takes the place of the older, so that frequent strings stay and memory is bounded.
    """

    def __init__(self, work: Callable[[str], bytes], size: int = REMEMBERED):
        super().__init__()
        self.work, self.size, self.older = work, size, {}

    def __missing__(self, token: str) -> bytes:
        got = self.older.get(token)
        self[token] = got = self.work(token) if got is None else got
        return got

    def make_room(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()


class Chunks(Remembered):
    """Remembers chunks that are one pre-token with the space before them; `split` puts the others together each time.

    Strings like two words with a mark between them are many and seldom come again: they would push the words out.
    """

    def __init__(self, work: Callable[[str], bytes], split: Callable[[str], bytes | None]):
        super().__init__(work)
        self.split = split

    def __missing__(self, token: str) -> bytes:
        got = self.older.get(token)
        if got is None:
            if not token.isalpha() and (put := self.split(token)) is not None:
                return put
            got = self.work(token)
        self[token] = got
        return got


class Uneven(Exception):
    """A chunk next to which white space does not stand alone."""


class TextEncoder:
    """Encodes texts pre-token by pre-token; subclasses give the ids of one pre-token.

    A space between two characters that are no white space always begins a pre-token. So a text falls into chunks at
    its spaces, and a chunk has the same ids wherever it stands. Marks at the end of a word, and a line end between two
    characters that are no white space, become chunks without a space before them, so that words are remembered
    as they are. A text with other white space beside a space or a line end is split by the pattern as a whole.
    """

    pattern: str

    def resolve(self, token: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers."""
        raise NotImplementedError

    @cached_property
    def split(self) -> Callable[[str], list[str]]:
        import regex

        return regex.compile(self.pattern).findall

    @cached_property
    def tokens(self) -> Remembered:
        return Remembered(self.resolve, INSIDE)

    @cached_property
    def chunks(self) -> Chunks:
        return Chunks(lambda chunk: self.resolve(chunk[1:] if chunk[0] == BARE else " " + chunk), self._split)

    def _split(self, chunk: str) -> bytes | None:
        """Ids of a chunk that is not one pre-token with the space before it, if it has one; None for one that is."""
        bare = chunk[:1] == BARE
        body = chunk[1:] if bare else chunk
        if bare and body == "\n":
            return None
        if not body or body[0].isspace() or body[-1].isspace():
            raise Uneven
        first, *rest = self.split(body if bare else " " + body)
        if not rest:
            return None
        known = self.chunks[first[1:]] if not bare and first[1:].isalpha() else self.tokens[first]
        return known + b"".join(map(self.tokens.__getitem__, rest))

    def _by_pattern(self, text: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, self.split(text)))

    def encode_text(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        self.tokens.make_room()
        self.chunks.make_room()
        if text and BARE not in text:
            marked = BARE + _MARKS.sub(rf" {BARE}\g<0>", text).replace("\n", f" {BARE}\n {BARE}")
            try:
                return b"".join(map(self.chunks.__getitem__, marked.removesuffix(f" {BARE}").split(" ")))
            except Uneven:
                pass
        return self._by_pattern(text)
