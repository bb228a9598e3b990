"""Resampling documents towards a target distribution by importance weights over hashed word runs.

A document is a row of a sparse matrix: how often its runs of words fall in each bucket of a hash. The matrix is written once, as
compressed sparse rows (buckets as differences, counts), and everything else reads it some rows at a time: sums by
column give the distributions of all documents and of the target, a bucket's gain is the logarithm of their ratio, and the
product of the matrix with the gains gives every document's weight. Weights plus Gumbel noise from a hash of the id rank the
documents, so the highest ones are a sample without replacement. A rank is a place within a sorted range and the number of rows
in the ranges before it; no task sees all rows, and equal scores may lie in several ranges. The driver gets a number per bucket
and per range.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import discard, written
from sparkloom.llm.tokens import column_slices, give_back

#: Words are runs of digits, letters and all bytes beyond ASCII; the rest becomes spaces, A-Z become a-z.
_CLEAN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Bytes of a long text whose words are in memory at a time.
_AT_ONCE = 2_000_000

#: A row is a document: Spark reads 4096 rows of a Parquet file at once, so a row that held many documents would take memory with the size of a file.
SPARSE = "row long, doc_id long, n_words long, buckets binary, counts binary"
ROWS = "row long, doc_id long, n_words long, n_features long, weight long, score long"


def _words(text: bytes) -> Iterator[list[bytes]]:
    """A text's words, in parts that are cut between words."""
    clean, a = text.translate(_CLEAN), 0
    while a < len(clean):
        b = clean.find(b" ", a + _AT_ONCE)
        b = len(clean) if b < 0 else b
        yield clean[a:b].split()
        a = b


def counted(text: bytes | None, buckets: int, longest: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of words, buckets in rising order, counts) of a text's runs of 1 to `longest` words."""
    n_words, tail, found = 0, [], []
    for new in _words(text or b""):
        n_words += len(new)
        words = tail + new
        spaced = [b" " + w for w in words]
        crc, part = list(map(crc32, words)), []
        for k in range(1, longest + 1):
            if k > 1:  # a run's hash goes on from that of the run without its last word
                crc = list(map(crc32, spaced[k - 1 :], crc))
            part += crc[max(0, len(tail) - k + 1) :]
        found.append(np.fromiter(part, np.uint32, len(part)) % np.uint32(buckets))
        tail = words[len(words) - longest + 1 :] if len(words) >= longest else words
    if len(found) == 1:
        return n_words, *np.unique(found[0], return_counts=True)
    total = sum((np.bincount(x, minlength=buckets) for x in found), np.zeros(buckets, np.int64))
    at = np.flatnonzero(total)
    return n_words, at, total[at]


def matrix(docs: DataFrame, *, buckets: int = 10_000, longest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The compressed sparse row of each document; one without text or words has no entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in column_slices(batch.column(1)):
                rows = [counted(t, buckets, longest) for t in texts]
                steps = [np.diff(at.astype(np.int64), prepend=0).astype("<u4").tobytes() for _, at, _ in rows]
                counts = [c.astype("<u4").tobytes() for _, _, c in rows]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + b - a)), ids.slice(a, b - a), pa.array([n for n, _, _ in rows], pa.int64()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], names=["row", "doc_id", "n_words", "buckets", "counts"])
                row += b - a
        give_back()

    return docs.select(docs[id_col].cast("long"), docs[text_col].cast("binary")).mapInArrow(run, SPARSE)


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Some rows of the matrix at a time, with the bounds, buckets and counts of their entries."""
    for a, b, steps in column_slices(batch.column("buckets")):
        part = batch.slice(a, b - a)
        bounds = np.cumsum([0, *(len(x) // 4 for x in steps)])
        total = np.cumsum(np.frombuffer(b"".join(steps), "<u4"), dtype=np.int64)  # the differences start anew in each row
        before = np.concatenate([[0], total])[bounds[:-1]]
        counts = np.frombuffer(b"".join(part.column("counts").to_pylist()), "<u4").astype(np.int64)
        yield part, bounds, total - np.repeat(before, np.diff(bounds)), counts


def column_sums(sparse: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows. A task gives one number per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, at, counts in _parts(batch):
                np.add.at(total, at, counts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})
        give_back()

    found = sparse.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most `buckets` rows
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source, both with one more feature in every bucket."""
    k = len(source)
    s_all, t_all = float(source.sum() + k), float(target.sum() + k)
    return np.array([math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise in thousandths from a hash of seed and id; a null id counts as the text ''."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(sparse: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """One row per document: the matrix times the gains, over the number of features and rounded down, and the score with noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bounds, at, counts in _parts(batch):
                total = np.concatenate([[0], np.cumsum(gain[at] * counts)])
                number = np.concatenate([[0], np.cumsum(counts)])
                n = np.diff(number[bounds])
                weight = np.diff(total[bounds]) // np.maximum(n, 1)
                score = weight + np.array([noise(seed, i) for i in part.column("doc_id").to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("row", "doc_id", "n_words")), pa.array(n), pa.array(weight), pa.array(score)], names=["row", "doc_id", "n_words", "n_features", "weight", "score"])
        give_back()

    return sparse.mapInArrow(run, ROWS)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        place = pa.array(np.arange(at + 1, at + n + 1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), place], names=[*batch.schema.names, "part", "place"])
        at += n


def drawn(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    """All rows with `rank`: 1, 2, 3... of the highest scores among documents with at least `least_words` words, null for the rest."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    able = scored.filter(F.col("n_words") >= least_words)
    placed = written(able.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_numbered, f"{ROWS}, part int, place long"), "ranked")
    counts = placed.groupBy("part").count().orderBy("part").collect()  # a row per range
    before = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    starts = scored.sparkSession.createDataFrame([(r.part, at) for r, at in zip(counts, before, strict=False)], "part int, before long")
    rank = F.col("before") + F.col("place")
    ranked = placed.join(F.broadcast(starts), "part").withColumn("rank", F.when(rank <= percent * before[-1] // 100, rank))
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(columns).unionAll(rest.select(columns))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 25, buckets: int = 10_000, longest: int = 2, seed: int = 7, least_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_id_col: str = "item_id", target_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (null where it isn't drawn).

    Null, empty and wordless texts have no features, weight 0 and are never drawn (unless `least_words` is 0). Rows that share an
    id are documents of their own with the same noise; equal scores are ranked by id, rows without id last, and rows of one id in
    the order they are read. An empty target has every bucket equally likely; an empty table gives no rows. Other columns aren't read.
    """
    sparse = written(matrix(docs, buckets=buckets, longest=longest, id_col=id_col, text_col=text_col), "matrix", compression="zstd")
    wanted = column_sums(matrix(target, buckets=buckets, longest=longest, id_col=target_id_col, text_col=target_text_col), buckets)
    scored = written(weighed(sparse, gains(column_sums(sparse, buckets), wanted), seed), "weights")
    discard(sparse)
    return drawn(scored, percent, least_words)
