"""Exact tokenisation of whole texts by the tokenizers library, with the ids of repeated pieces remembered.

Both vocabularies here split a text into pieces before merging, and no piece crosses the cuts below, so a text's ids are
its pieces' ids one after the other. The library encodes each new piece; a text is then a sequence of look-ups.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
import re
from array import array
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc

#: White space as the library's patterns have it (Unicode White_Space).
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

#: Cuts of a byte-level vocabulary: a word takes one space before it; of a longer run of white space the last character stands apart.
BYTE_LEVEL = f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]"
#: Cuts of a vocabulary that drops white space.
WORD_END = f"[^{SPACE}]+"


class TextEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Pieces are remembered in two generations of about `remembered`: a full one becomes the old one, what is used from there moves
    on, and the rest goes when the next is full. So frequent pieces are encoded once and rare ones take bounded room.
    """

    def __init__(self, tokenizer: str, cut: str, remembered: int = 600_000, longest: int = 200):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer)
        self.cut = re.compile(cut)
        self.remembered, self.longest = remembered, longest
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        pieces = [self.cut.findall(t) if t else [] for t in texts]
        found = [list(map(known.get, row)) for row in pieces]
        holes = [[j for j, ids in enumerate(row) if ids is None] for row in found]
        new = []
        for piece in {row[j] for row, at in zip(pieces, holes, strict=True) for j in at}:
            if piece in before:
                known[piece] = before[piece]
            else:
                new.append(piece)
        for piece, encoded in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[piece] = array("I", encoded.ids).tobytes()
        for row, ids, at in zip(pieces, found, holes, strict=True):
            for j in at:
                ids[j] = known[row[j]]
        for piece in new:
            if len(piece) > self.longest:
                del known[piece]
        return [b"".join(ids) for ids in found]


@lru_cache(maxsize=4)
def encoder(tokenizer: str, cut: str) -> TextEncoder:
    """One per Python worker, kept from task to task."""
    return TextEncoder(tokenizer, cut)


def slices(texts: list[str | None], characters: int = 2_000_000):
    """(from, to) over `texts`, so that each slice but a single long text stays below so many characters."""
    yield from _cut([len(t or "") for t in texts], characters)


def column_slices(column: pa.Array, size: int = 2_000_000):
    """(from, to, texts) over a column, of about `size` bytes each: only one slice is in Python's strings at a time."""
    for a, b in _cut(pc.fill_null(pc.binary_length(column), 0).to_pylist(), size):
        yield a, b, column.slice(a, b - a).to_pylist()


def _cut(lengths: list[int], most: int):
    start = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def give_back() -> None:
    """Return what a worker has freed to the system: the next task in it may be of another kind, and its neighbours need the memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
