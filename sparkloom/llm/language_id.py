"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of the lower-cased text, hashed; the value of one is its share among the text's n-grams times
its inverse document frequency. The weights are learned by follow-the-regularised-leader with an L1 and an L2 penalty, which
leaves most of them at zero. A temperature, fitted on sample rows that the weights haven't seen, calibrates the probabilities.

Learning takes a bounded sample (`max_docs`, shared out among the languages); prediction reads whole texts, in numpy on
Arrow batches: an n-gram's place in the table is a hash of three code points, so a text's score is a sum of table rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.tokens import slices

BITS = 17
ORDERS = (1, 2, 3)
UNKNOWN = "und"
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _hashed(codes: np.ndarray, order: int) -> np.ndarray:
    """Table places of the n-grams of `order` that begin at each code point but the last order - 1."""
    n = len(codes) - order + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, order * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
    for k in range(order):
        h = (h ^ codes[k : k + n]) * _FACTORS[k]
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text between two spaces."""
    return np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The places that occur in a text, and how often."""
    codes = _codes(text)
    return np.unique(np.concatenate([_hashed(codes, k) for k in ORDERS]), return_counts=True)


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # place, label: weight times inverse document frequency
    bias: np.ndarray
    temperature: float = 1.0

    def odds(self, texts: list[str]) -> np.ndarray:
        """Log odds of each text, all of its n-grams counted."""
        parts = [_codes(t) for t in texts]
        codes, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        total, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        for k in ORDERS:
            rows = self.table[_hashed(codes, k)]
            last = ends - (k - 1)  # an n-gram must not run into the next text
            for j in range(1, k):
                at = (ends - j)[:-1]
                rows[at] = 0
            sums = np.add.reduceat(rows, np.minimum(ends - sizes, max(len(rows) - 1, 0)), axis=0) if len(rows) else np.zeros_like(total)
            total += np.where((last > ends - sizes)[:, None], sums, 0)
            n += np.maximum(sizes - (k - 1), 0)
        return self.bias + total / n[:, None]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        at = [i for i, t in enumerate(texts) if t and self.labels and any(map(str.isalpha, t))]
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if at:
            p = _softmax(self.odds([texts[i] for i in at]) / self.temperature)
            for i, j, x in zip(at, p.argmax(1), p.max(1), strict=True):
                names[i], scores[i] = self.labels[j], float(x)
        return names, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], *, epochs: int = 4, alpha: float = 8.0, beta: float = 1.0, l1: float = 2e-4, l2: float = 1e-5, seed: int = 5) -> Model:
    """FTRL-proximal over (places, counts) of texts; every fifth row is kept for the temperature."""
    names = sorted(set(labels))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    y = np.array([names.index(x) for x in labels])
    df = np.bincount(np.concatenate([p for p, _ in rows]), minlength=1 << BITS)
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    values = [(p, (c / c.sum()) * idf[p]) for p, c in rows]
    shape = (1 << BITS, len(names))
    z, n = np.zeros(shape), np.zeros(shape)
    bias, r = np.zeros(len(names)), np.random.default_rng(seed)

    def weights(at) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    train, held = [i for i in range(len(rows)) if i % 5], [i for i in range(len(rows)) if i % 5 == 0]
    for _ in range(epochs):
        for i in r.permutation(train) if train else []:
            p, x = values[i]
            w = weights(p)
            error = _softmax((bias + x @ w)[None])[0]
            error[y[i]] -= 1
            g = np.outer(x, error)
            more = n[p] + g * g
            z[p] += g - (np.sqrt(more) - np.sqrt(n[p])) / alpha * w
            n[p] = more
            bias -= 0.05 * error
    w = weights(slice(None))
    model = Model(names, (w * idf[:, None]).astype(np.float32), bias)
    if held and len(names) > 1:
        odds = np.stack([bias + values[i][1] @ w[values[i][0]] for i in held])
        loss = lambda t: -np.log(_softmax(odds / t)[np.arange(len(held)), y[held]] + 1e-12).mean()
        model.temperature = min(np.geomspace(0.01, 20, 141), key=loss)
    return model


def train(docs: DataFrame, *, max_docs: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> Model:
    """Fit on about `max_docs` rows with text and label: of each label an equal share at most, the first in the order of a hash of the id."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngram_counts(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([p.astype("<i4").tobytes() for p, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], names=["id", "label", "places", "counts"])

    rows = docs.select(docs[id_col].alias("id"), docs[label_col].cast("string").alias("label"), docs[text_col].alias("text")).dropna()
    ids = rows.select("id", "label", (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)).alias("at"))
    sizes = {r["label"]: r["count"] for r in ids.groupBy("label").count().collect()}  # a row per language
    if not sizes:
        return fit([], [])
    each = max(50, max_docs // len(sizes))
    share = F.lit(0.0)
    for label, n in sorted(sizes.items()):
        share = F.when(F.col("label") == label, min(1.0, each / n)).otherwise(share)
    chosen = rows.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)) < share)
    found = chosen.mapInArrow(counted, "id long, label string, places binary, counts binary").collect()  # about max_docs
    found.sort(key=lambda r: (r["id"], r["label"], bytes(r["places"])))
    return fit([(np.frombuffer(bytes(r["places"]), "<i4").astype(np.int64), np.frombuffer(bytes(r["counts"]), "<i4")) for r in found], [r["label"] for r in found])


def predict(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: lang_pred and its calibrated probability; `und` and 0 where the text is null or has no letter. Other columns aren't read.

    Repeated rows, and rows with the same id or none, each have a row; an empty table gives none.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS rows of a number per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, 500_000):
                names, scores = held.value.predict(texts[a:b])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col]).mapInArrow(run, "doc_id long, lang_pred string, score double")
