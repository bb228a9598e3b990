"""Which items (64-bit hashes) of named lists occur in another list too, with a small shuffle.

Lists are dealt to buckets by their items' hashes and travel in packed blocks: five bytes an item, and a name and a count for each list
in a bucket. Bucket and forty bits together are compared. Numbers of buckets grow with the data, so the rate of false
matches stays small; a false match only keeps an item that a later exact step drops.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

BLOCK = "bucket int, names binary, counts binary, items binary"
_MASK = np.uint64((1 << 40) - 1)


def packed(names: np.ndarray, lists: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Blocks of the lists' items, a row for each bucket. Items are well mixed unsigned integers."""
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    h = np.concatenate(lists).astype(np.uint64, copy=False) if lists else np.zeros(0, np.uint64)
    bucket = bucket_of(h, buckets)
    order = np.argsort(bucket, kind="stable")
    doc, h, bucket = doc[order], h[order], bucket[order]
    short = (h & _MASK).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    rows: list[tuple] = []
    for k in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[k], bounds[k + 1]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(doc[a:b])) + 1])  # a list's items still stand together
        count = np.diff([*starts, b - a])
        rows.append((int(k), names[doc[a:b][starts]].astype("<i8").tobytes(), count.astype("<u4").tobytes(), short[a:b].tobytes()))
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["bucket", "names", "counts", "items"])


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def short_items(h: np.ndarray, buckets: int) -> np.ndarray:
    """Items as `shared` gives them back: the bucket above forty bits."""
    return (bucket_of(h, buckets) << 40) | (h & _MASK).astype(np.int64)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the blocks of whole buckets, for each bucket: names and counts of the lists, and all items."""
    parts: dict[int, list] = {}
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts.setdefault(bucket, []).append(row)
    for bucket in list(parts):
        rows = parts.pop(bucket)
        names = np.concatenate([np.frombuffer(x, "<i8") for x, _, _ in rows])
        counts = np.concatenate([np.frombuffer(x, "<u4") for _, x, _ in rows]).astype(np.int64)
        raw = np.frombuffer(b"".join(x for _, _, x in rows), np.uint8).reshape(-1, 5)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw
        yield names, counts, wide.view("<u8").ravel().astype(np.int64) | (bucket << 40)


def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """From the blocks of whole buckets, for each bucket: names and counts of the lists, all items, and which of them another name has too."""
    for names, counts, items in _buckets(batches):
        owner = np.repeat(names, counts)
        order = np.argsort(items, kind="stable")
        ordered, owners = items[order], owner[order]
        first = np.concatenate([[0], np.flatnonzero(np.diff(ordered)) + 1])
        several = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)
        found = np.zeros(len(items), bool)
        found[order] = np.repeat(several, np.diff([*first, len(items)]))
        yield names, counts, items, found


def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The same of lists without repetitions and with names of their own: an item's name, the item, and how many lists have it."""
    for names, counts, items in _buckets(batches):
        order = np.argsort(items, kind="stable")
        first = np.concatenate([[0], np.flatnonzero(np.diff(items[order])) + 1])
        count = np.diff([*first, len(items)])
        often = np.empty(len(items), np.int64)
        often[order] = np.repeat(count, count)
        yield np.repeat(names, counts), items, often


def sums(named: Iterator[tuple[np.ndarray, np.ndarray]], buckets: int) -> Iterator[pa.RecordBatch]:
    """Numbers (or rows of them) by name, packed for the partition that adds up a name's numbers: a row for each such partition, not for each name."""
    for names, numbers in named:
        to = (names.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        bounds = np.searchsorted(to[order], np.arange(buckets + 1))
        rows = [(int(k), names[order[bounds[k] : bounds[k + 1]]].tobytes(), numbers[order[bounds[k] : bounds[k + 1]]].astype("<i8").tobytes()) for k in np.flatnonzero(np.diff(bounds))]
        columns = zip(*rows, strict=True) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "names", "numbers"])


SUMS = "bucket int, names binary, numbers binary"


def dealt(blocks: DataFrame, buckets: int) -> DataFrame:
    """Each bucket of blocks or sums in a partition of its own."""
    return blocks.repartitionById(buckets, "bucket")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    parts: dict[int, list] = {}
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts.setdefault(bucket, []).append(row)
    for bucket in list(parts):
        rows = parts.pop(bucket)
        yield np.concatenate([np.frombuffer(x, "<i8") for x, _ in rows]), np.concatenate([np.frombuffer(x, "<i8") for _, x in rows])


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From the rows of `sums` for whole buckets: distinct names and the sums of their numbers."""
    for names, numbers in _gathered(batches):
        names, at = np.unique(names, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, at, numbers)
        yield names, total


def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From the rows of `sums` for whole buckets, with an item and its frequency as numbers: names, items and frequencies, ordered by name, frequency and item."""
    for names, numbers in _gathered(batches):
        items, often = numbers.reshape(-1, 2).T
        order = np.lexsort((items, often, names))
        yield names[order], items[order], often[order]


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """From the rows of `sums` for whole buckets: names and numbers, ordered by name."""
    for names, numbers in _gathered(batches):
        order = np.argsort(names, kind="stable")
        yield names[order], numbers[order]
