"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Each byte has a small learned vector; learned
filters slide over a chunk and the strongest response of each filter is kept. A document is the mean and the maximum of its
chunks' responses, which a small dense layer combines into one probability. Training is plain back-propagation with Adam:
only the place of each maximum has a gradient, so it is cheap.

The network is fitted on the driver on a bounded sample of labelled rows (`max_docs` of `max_bytes` together), of which all chunks are
learned from. Scoring reads all chunks of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import discard, written

CHUNK, STEP = 512, 448
WIDTH, STRIDE, DEPTH, FILTERS, HIDDEN = 8, 4, 8, 32, 16
_AT_ONCE = 256  # chunks in one matrix product


def chunked(data: bytes) -> np.ndarray:
    """The overlapping chunks of a text, the last filled with zeros; one chunk of zeros for an empty text."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (STEP, 1))


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "bytes": normal(256, DEPTH, scale=0.5), "filters": normal(WIDTH * DEPTH, FILTERS, scale=0.15), "bias": np.zeros(FILTERS, np.float32),
            "dense": normal(2 * FILTERS, HIDDEN, scale=0.15), "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=0.2), "out_bias": np.zeros(1, np.float32),
        }

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunk, place, WIDTH * DEPTH) vectors under the filters; neighbouring places share half of their bytes."""
        x = self.p["bytes"][chunks].reshape(len(chunks), CHUNK // STRIDE, STRIDE * DEPTH)
        return np.concatenate([x[:, :-1], x[:, 1:]], axis=2)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The strongest response of each filter in each chunk, and its place; a block of chunks at a time."""
        best, places = [], []
        for a in range(0, len(chunks), _AT_ONCE):
            out = self.windows(chunks[a : a + _AT_ONCE]) @ self.p["filters"]
            best.append(np.maximum(out.max(axis=1) + self.p["bias"], 0))
            places.append(out.argmax(axis=1))
        return np.concatenate(best), np.concatenate(places)

    def combine(self, pool: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of each document, whose chunks begin at `starts`, and what back-propagation needs."""
        sizes = np.diff([*starts, len(pool)])[:, None]
        both = np.concatenate([np.add.reduceat(pool, starts) / sizes, np.maximum.reduceat(pool, starts)], axis=1).astype(np.float32)
        hidden = np.maximum(both @ self.p["dense"] + self.p["dense_bias"], 0)
        odds = hidden @ self.p["out"] + self.p["out_bias"][0]
        return 1 / (1 + np.exp(-np.clip(odds.astype(np.float64), -30, 30))), both, hidden

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Scores of whole texts; a long text's chunks go through the filters in blocks."""
        parts = [chunked(t) for t in texts]
        starts = np.cumsum([0, *map(len, parts)])[:-1]
        pool = np.concatenate([self.pooled(p)[0] for p in _blocks(parts)])
        return self.combine(pool, starts)[0]

    def gradient(self, docs: list[np.ndarray], labels: np.ndarray) -> dict[str, np.ndarray]:
        chunks, sizes = np.concatenate(docs), np.array([len(d) for d in docs])
        starts = np.cumsum([0, *sizes])[:-1]
        pool, at = self.pooled(chunks)
        score, both, hidden = self.combine(pool, starts)
        d = ((score - labels) / len(docs)).astype(np.float32)
        g = {"out": hidden.T @ d, "out_bias": d.sum(keepdims=True)}
        d_hidden = np.outer(d, self.p["out"]) * (hidden > 0)
        g |= {"dense": both.T @ d_hidden, "dense_bias": d_hidden.sum(0)}
        d_both = d_hidden @ self.p["dense"].T
        doc = np.repeat(np.arange(len(docs)), sizes)
        first_max = pool == np.maximum.reduceat(pool, starts)[doc]
        ties = np.add.reduceat(first_max.astype(np.float32), starts)
        d_pool = d_both[doc, :FILTERS] / sizes[doc, None] + np.where(first_max, d_both[doc, FILTERS:] / ties[doc], 0)
        d_pool = (d_pool * (pool > 0)).astype(np.float32)
        g["bias"] = d_pool.sum(0)
        g |= {"filters": np.zeros_like(self.p["filters"]), "bytes": np.zeros_like(self.p["bytes"])}
        for a in range(0, len(chunks), _AT_ONCE):
            part, d_part = chunks[a : a + _AT_ONCE], d_pool[a : a + _AT_ONCE]
            place = at[a : a + _AT_ONCE, :, None] * STRIDE + np.arange(WIDTH)  # chunk, filter, byte under the filter
            under = part[np.arange(len(part))[:, None, None], place]
            g["filters"] += np.einsum("cfk,cf->kf", self.p["bytes"][under].reshape(len(part), FILTERS, -1), d_part)
            d_bytes = d_part[:, :, None, None] * self.p["filters"].T.reshape(1, FILTERS, WIDTH, DEPTH)
            g["bytes"] += np.stack([np.bincount(under.ravel(), d_bytes[..., k].ravel(), 256) for k in range(DEPTH)], axis=1).astype(g["bytes"].dtype)
        return g

    @classmethod
    def fit(cls, docs: list[np.ndarray], labels: list[int], epochs: int = 8, batch: int = 48, rate: float = 4e-3, seed: int = 7) -> Network:
        """Adam over shuffled batches with a falling rate. Without documents of both labels the answer is their share."""
        net, y, r = cls(seed), np.asarray(labels, np.float64), np.random.default_rng(seed)
        if len(set(labels)) < 2:
            net.p["out"][:] = 0
            net.p["out_bias"][:] = 0 if not len(y) else 6 * (2 * y[0] - 1)
            return net
        net.p["out_bias"][:] = np.log(y.mean() / (1 - y.mean()))
        m = {k: np.zeros_like(v) for k, v in net.p.items()}
        v = {k: np.zeros_like(x) for k, x in net.p.items()}
        steps = epochs * -(-len(docs) // batch)
        t = 0
        for _ in range(epochs):
            order = r.permutation(len(docs))
            for a in range(0, len(docs), batch):
                rows = order[a : a + batch]
                t += 1
                for k, g in net.gradient([docs[i] for i in rows], y[rows]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    step = rate * (1 - (t - 1) / steps) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)
                    net.p[k] = (net.p[k] - step).astype(np.float32)
        return net


def _blocks(parts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """The chunks of many texts in blocks of about _AT_ONCE, a longer text's as they are."""
    held: list[np.ndarray] = []
    n = 0
    for p in parts:
        if held and n + len(p) > _AT_ONCE:
            yield np.concatenate(held)
            held, n = [], 0
        held.append(p)
        n += len(p)
    if held:
        yield np.concatenate(held) if len(held) > 1 else held[0]


def train(docs: DataFrame, labels: DataFrame, *, max_docs: int = 3000, max_bytes: int = 12 << 20, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Network:
    """Fit on whole texts of at most `max_docs` labelled rows of `max_bytes` together, in the order of a hash of the id.

    A row that would exceed the bytes is passed over, so one very long text keeps no others out. Rows without id or label are left
    out; of texts that share an id the smallest counts, so what reaches the driver is bounded whatever the tables hold.
    """
    chosen = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).dropna().distinct()
    chosen = chosen.orderBy(F.xxhash64("id"), "id", "label").limit(max_docs)
    texts = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    rows = written(texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")), "labelled")  # at most max_docs
    sizes = rows.select("id", "label", F.octet_length("text").alias("n")).orderBy(F.xxhash64("id"), "id", "label").collect()
    held, taken = 0, []
    for r in sizes:
        if held + r.n <= max_bytes:
            held += r.n
            taken.append((r.id, r.label))
    picked = docs.sparkSession.createDataFrame(taken, rows.select("id", "label").schema)
    found = rows.join(F.broadcast(picked), ["id", "label"]).collect()  # at most max_bytes of text
    discard(rows)
    found.sort(key=lambda r: (r["id"], r["label"]))
    return Network.fit([chunked(r["text"].encode()) for r in found], [r["label"] for r in found])


def score(docs: DataFrame, network: Network, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` and each whole text's probability of label 1 as a last column; a null text counts as an empty one.

    Repeated rows each have a row of their own, an empty table gives none. `score_col` must not be a column of `docs`.
    """
    if score_col in docs.columns:
        raise ValueError(f"{score_col} is a column already")
    rows = scored(docs, network, text_col=text_col)
    return rows.select("row.*", F.col("score").alias(score_col))


def scored(docs: DataFrame, network: Network, *, text_col: str = "text") -> DataFrame:
    """(row, score): the rows of `docs`, whatever their columns are called, as a struct, and their scores."""
    held = docs.sparkSession.sparkContext.broadcast(network.p)  # 20 KB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network()
        net.p = held.value
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts = [(t or "").encode() for t in part.column(1).to_pylist()]
                scores = np.concatenate([net.score(texts[i : i + 50]) for i in range(0, len(texts), 50)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], names=["row", "score"])

    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), docs[text_col].alias("text"))
    schema = T.StructType([given.schema["row"], T.StructField("score", T.DoubleType())])
    return given.mapInArrow(run, schema)
