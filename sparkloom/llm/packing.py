"""Best-fit packing of documents into token sequences.

Bounded-space online best-fit: each task reads its documents once and holds a fixed number of open bins. A bitset has a bit
for each amount of free space that some open bin has, so the tightest bin that holds a piece is the lowest set bit from the
piece's length on. If none fits, a bin is opened; if that would be one too many, the fullest is closed first. A piece gets
its place when it is read, so the task's memory doesn't depend on the input and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from sparkloom.llm.tokens import WORD_END, column_slices, encoder, give_back

SCHEMA = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"


class BestFit:
    """Places of pieces in bins of `capacity`. Sequence ids count from `first` on."""

    def __init__(self, capacity: int, open_bins: int, first: int = 0):
        self.capacity, self.open_bins, self.next = capacity, open_bins, first
        self.free = 0  # bit f: an open bin has f free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by free space; of equally free ones the last is taken
        self.opened = 0

    def _take(self, f: int) -> int:
        bins = self.bins[f]
        found = bins.pop()
        if not bins:
            self.free &= ~(1 << f)
        self.opened -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of 1 to `capacity` tokens."""
        if not 1 <= length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens doesn't fit {self.capacity}")
        fits = self.free >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            found = self._take(f)
        else:
            f, found = self.capacity, self.next
            self.next += 1
            if length < self.capacity and self.opened == self.open_bins:
                self._take((self.free & -self.free).bit_length() - 1)
        left = f - length
        if left:
            self.bins[left].append(found)
            self.free |= 1 << left
            self.opened += 1
        return found, self.capacity - f


def pack(docs: DataFrame, tokenizer: str, *, cut: str = WORD_END, end_id: int = 1, capacity: int = 4096, open_bins: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32-bit) and its place in a sequence.

    A document is its ids and then `end_id`; a null or empty text is `end_id` alone. Longer documents are cut into pieces of
    `capacity`, the last of which may be shorter. Rows with the same id, or a null id, are packed as documents of their own.
    Other columns of `docs` are not read. Sequence ids are unique and in no order; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cut).encode
        place = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 33).place
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in column_slices(batch.column(1)):
                rows: list[tuple] = []
                for doc, found in zip(ids[a:b], encode(texts), strict=True):
                    data = found + end
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        rows.append((doc, k, start // 4, len(part) // 4, part, *place(len(part) // 4)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                names = ("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))
        give_back()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, SCHEMA)
