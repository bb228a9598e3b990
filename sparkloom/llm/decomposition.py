"""Packing by power-of-two decomposition: no sequence crosses documents and none is padded.

The number of ids of a document is a sum of powers of two. The document is cut into pieces of just those lengths, the longest
first and none above `capacity`, and each piece is a sequence of its own. Sequences of equal length form a bucket, from which a
trainer takes batches of one length. A piece gets its bucket and its number in it when its document is read: nothing is
shuffled, and a task's memory doesn't depend on the input. A task that is run again gives the same numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.tokens import BYTE_LEVEL, column_slices, encoder, give_back

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int, sequence_id long, offset long"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
_NAMES = ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "sequence_id", "offset"]


def lengths(n: int, capacity: int) -> list[int]:
    """The powers of two that a document of `n` ids is cut into, in falling order; `capacity`, a power of two, as often as it fits."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


class Buckets:
    """Numbers for sequences: the task, the bucket and a running number within both."""

    def __init__(self, task: int, buckets: int):
        self.next = [(task << 5 | k) << 33 for k in range(buckets)]

    def number(self, bucket: int) -> int:
        found = self.next[bucket]
        self.next[bucket] += 1
        return found


def decompose(docs: DataFrame, tokenizer: str, *, cut: str = BYTE_LEVEL, end_id: int = 0, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: its ids (little-endian unsigned 32-bit), its bucket (the logarithm of its length to base 2) and its sequence.

    A document is its ids and then `end_id`; a null or empty text is `end_id` alone, a sequence of length 1. Rows with the same id,
    or a null id, are documents of their own. Other columns of `docs` are not read. Sequence ids are unique and in no order, the
    offset is always 0; an empty table gives no rows. `capacity` must be a power of two.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cut).encode
        number = Buckets(TaskContext.get().partitionId(), capacity.bit_length()).number
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for a, b, texts in column_slices(batch.column(1)):
                rows: list[tuple] = []
                for doc, found in zip(ids[a:b], encode(texts), strict=True):
                    data, at = found + end, 0
                    n = len(data) // 4
                    for size in lengths(n, capacity):
                        bucket = size.bit_length() - 1
                        rows.append((doc, at, size, data[4 * at : 4 * (at + size)], n, bucket, number(bucket), 0))
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)
        give_back()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The pieces as Parquet below `path`, a folder for each bucket, so that a reader of one length opens no other."""
    pieces.write.partitionBy("bucket").parquet(path)


def read_bucket(spark: SparkSession, path: str, length: int) -> DataFrame:
    """The sequences of one length that `write_buckets` wrote; an empty table where there are none."""
    return spark.read.schema(SCHEMA).parquet(path).filter(f"bucket = {length.bit_length() - 1}")
