"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The encoder is a score-ordered agenda: all adjacent symbol pairs whose concatenation is a piece wait in a heap, the highest
score first and the leftmost among equals; merging a pair makes two new pairs with its neighbours. A pair is dropped if one
of its symbols has been merged in the meantime. What is no piece in the end is spelt in bytes.

No piece of such a vocabulary crosses from a letter to the mark of the next word, or a line feed, which is checked when the
model is loaded, so a text is encoded word by word and each distinct word once. In every Arrow batch the ids of the words
that are new to the worker are checked against the library; a difference raises an error. Decoding is the library's.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkloom.llm.tokens import slices

MARK = "▁"
ENCODED = "doc_id long, ids binary"
DECODED = "doc_id long, n_tokens long, ids_sha256 string, decoded string"


class Agenda:
    """Encoder of one model. Remembers the ids of up to `remembered` words, then starts anew."""

    def __init__(self, model: str, remembered: int = 500_000, longest: int = 200):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        trainer, normal = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type != trainer.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback is needed")
        if normal.precompiled_charsmap or normal.remove_extra_whitespaces or not (normal.add_dummy_prefix and normal.escape_whitespaces):
            raise ValueError("a model with identity normalisation and a dummy prefix is needed")
        kind = proto.SentencePiece
        if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        if any(re.search(f"[^{MARK}]{MARK}|\n.|.\n", p) for p in self.pieces):
            raise ValueError("a piece crosses a word's start")
        self.bos, self.eos = self.library.bos_id(), self.library.eos_id()
        self.cut = re.compile(f"{MARK}*[^{MARK}\n]+|\n|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.remembered, self.longest = remembered, longest

    def merge(self, word: str) -> list[int]:
        """Ids of a word, in which spaces are marks already."""
        pieces = self.pieces
        if word in pieces and len(word) <= 2:
            return [pieces[word][0]]
        symbols: list[str | None] = list(word)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (found := pieces.get(both := symbols[a] + symbols[b])):
                heapq.heappush(agenda, (-found[1], a, b, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, both = heapq.heappop(agenda)
            if symbols[a] is None or symbols[b] is None or after[a] != b or symbols[a] + symbols[b] != both:
                continue
            symbols[a], symbols[b] = both, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out: list[int] = []
        for s in symbols:
            if s is not None:
                if found := pieces.get(s):
                    out.append(found[0])
                else:
                    out += [self.bytes[x] for x in s.encode()]
        return out

    def _check(self, new: list[str]) -> None:
        """The library adds a mark in front, so words that have one lose it, and others follow a line feed."""
        theirs = self.library.encode([w[1:].replace(MARK, " ") if w[0] == MARK else f"\n{w}" for w in new if w[1:]], num_threads=1)
        lead = self.library.encode("\n", num_threads=1)
        for w, ids in zip((w for w in new if w[1:]), theirs, strict=True):
            ours = array("I", self.known[w]).tolist()
            if (ours if w[0] == MARK else lead + ours) != ids:
                raise ValueError(f"the library encodes {w!r} in another way")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids with begin and end id, as little-endian unsigned 32-bit bytes."""
        rows = [self.cut.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        known = self.known
        if len(known) > self.remembered:
            known.clear()
        new = list({w for row in rows for w in row if w not in known})
        for w in new:
            known[w] = array("I", self.merge(w)).tobytes()
        self._check(new)
        first, last = array("I", [self.bos]).tobytes(), array("I", [self.eos]).tobytes()
        out = [b"".join((first, *map(known.__getitem__, row), last)) for row in rows]
        for w in new:
            if len(w) > self.longest:
                del known[w]
        return out

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([array("I", x).tolist() for x in ids], num_threads=1)


@lru_cache(maxsize=2)
def agenda(model: str) -> Agenda:
    """One per Python worker, kept from task to task."""
    return Agenda(model)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its ids with begin and end id. A null or empty text has those two alone. Other columns aren't read.

    Repeated rows, and rows with the same id or none, each have a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = agenda(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(tool.encode(texts[a:b]), pa.binary())], names=["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """One row per row of `encode`: number of ids, sha256 of the ids as they are stored, and the library's decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = agenda(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                ids = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(tool.decode(ids), pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, DECODED)
