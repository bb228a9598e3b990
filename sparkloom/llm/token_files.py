"""Token-id files: shards of concatenated ids with Elias-Fano coded document boundaries.

A shard holds the ids of a range of documents in ascending id order:

    magic "SLTOK001" | ids, little-endian, 2 bytes each where the vocabulary allows, else 4 | boundaries (Elias-Fano:
    the end of each document in ids) | document ids (Elias-Fano, less the smallest) | footer

The footer (fixed size, at the end) says where the parts are. Shards are written under a name of the task attempt, and only
those that the manifest (a Parquet table, committed by Spark) lists belong to the data set: a task that is run again, or a
lost executor, leaves at worst a file that nobody reads.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.elias_fano import EliasFano
from sparkloom.llm.tokens import BYTE_LEVEL, encoder, slices

MAGIC = b"SLTOK001"
#: bytes of an id, documents, of which without id, smallest id, ids, length of boundaries, length of document ids
_FOOTER = "<BQQqQQQ"
MANIFEST = "shard int, path string, n_docs long, n_tokens long"
ROWS = "doc_id long, start long, n_tokens long, ids binary"
_DOCS_AT_ONCE = 512


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write(docs: DataFrame, path: str, tokenizer: str, *, cut: str = BYTE_LEVEL, end_id: int = 2, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents below `path` (a URI that executors share) and return the manifest.

    A document is its ids and then `end_id`; a null or empty text is `end_id` alone. Rows with the same id stand next to each
    other, rows without id come first. Other columns aren't read; an empty table gives an empty manifest. `id_bytes` is 2
    for vocabularies of up to 65,536 ids, else 4; an id that doesn't fit raises an error.
    """
    kind = {2: "<u2", 4: "<u4"}[id_bytes]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, cut).encode
        end = end_id.to_bytes(4, "little")
        shard = TaskContext.get().partitionId()
        system, folder = _opened(path)
        name = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        ends: list[np.ndarray] = []
        keys: list[np.ndarray] = []
        total = missing = 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                out = system.open_output_stream(name)
                out.write(MAGIC)
            missing += batch.column(0).null_count
            keys.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                found = [x + end for x in encode(texts[a:b])]
                ids = np.frombuffer(b"".join(found), "<u4")
                if id_bytes == 2 and ids.max() > 0xFFFF:
                    raise ValueError("an id doesn't fit 2 bytes")
                out.write(ids.astype(kind).tobytes())
                ends.append(total + np.cumsum([len(x) // 4 for x in found]))
                total += len(ids)
        if out is None:
            return
        key, bounds = np.concatenate(keys), np.concatenate(ends)
        least = int(key.min()) if len(key) else 0
        parts = [EliasFano.of(bounds).to_bytes(), EliasFano.of(key - least).to_bytes()]
        for x in parts:
            out.write(x)
        out.write(struct.pack(_FOOTER, id_bytes, len(bounds), missing, least, total, *map(len, parts)))
        out.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{path}/{name.rpartition('/')[2]}"], "n_docs": [len(bounds)], "n_tokens": [total]})

    system, folder = _opened(path)
    system.create_dir(folder)
    spark = docs.sparkSession
    placed = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).repartitionByRange(F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"))
    placed.mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


class Shard:
    """Random access to the documents of one shard file."""

    def __init__(self, path: str):
        system, name = _opened(path)
        self.file = system.open_input_file(name)
        size, tail = self.file.size(), struct.calcsize(_FOOTER)
        self.id_bytes, self.n_docs, self.missing, self.least, self.n_tokens, n_bounds, n_keys = struct.unpack(_FOOTER, self.file.read_at(tail, size - tail))
        if self.file.read_at(len(MAGIC), 0) != MAGIC:
            raise ValueError(f"{path} isn't a token file")
        at = len(MAGIC) + self.id_bytes * self.n_tokens
        self.bounds = EliasFano.from_bytes(self.file.read_at(n_bounds, at))
        self.keys = EliasFano.from_bytes(self.file.read_at(n_keys, at + n_bounds))

    def offsets(self, start: int, stop: int) -> np.ndarray:
        """stop - start + 1 places in ids: where the documents start, and where the last ends."""
        ends = self.bounds.values(max(start - 1, 0), stop)
        return ends if start else np.concatenate([np.zeros(1, np.int64), ends])

    def doc_ids(self, start: int, stop: int) -> list[int | None]:
        a, b = max(start - self.missing, 0), max(stop - self.missing, 0)
        return [None] * ((stop - start) - (b - a)) + (self.keys.values(a, b) + self.least).tolist()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids from place `start` to `stop`, as unsigned 32-bit integers."""
        data = self.file.read_at(self.id_bytes * (stop - start), len(MAGIC) + self.id_bytes * start)
        return np.frombuffer(data, {2: "<u2", 4: "<u4"}[self.id_bytes]).astype("<u4")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files below `path`: id, ids of all documents before it, number of ids, ids (little-endian unsigned 32-bit)."""
    shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("shard").collect()  # a row per shard file
    starts = np.cumsum([0, *(s.n_tokens for s in shards)]).tolist()
    listed = spark.createDataFrame([(s.path, at) for s, at in zip(shards, starts, strict=False)], "path string, start long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(name)
                for a in range(0, shard.n_docs, _DOCS_AT_ONCE):
                    b = min(a + _DOCS_AT_ONCE, shard.n_docs)
                    at = shard.offsets(a, b)
                    ids = shard.ids(int(at[0]), int(at[-1]))
                    bounds = pa.py_buffer((4 * (at - at[0])).astype("<i4").tobytes())
                    packed = pa.Array.from_buffers(pa.binary(), b - a, [None, bounds, pa.py_buffer(ids.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids(a, b), pa.int64()), pa.array(at[:-1] + first), pa.array(np.diff(at)), packed], names=["doc_id", "start", "n_tokens", "ids"])

    return listed.repartition(max(1, len(shards))).mapInArrow(run, ROWS)
