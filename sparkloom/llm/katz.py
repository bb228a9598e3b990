"""Katz back-off bigram model: Good-Turing discounts and exactly normalised back-off weights.

    P(w | v) = d(c(v w)) c(v w) / c(v)   if v w was seen in training, else   a(v) P(w)
    P(w)     = d(c(w)) c(w) / N          if w was seen, else the mass that the discounts leave, for all unseen words as one

d(c) is Katz's discount from the counts of counts up to `CUT`, a(v) makes the conditional probabilities of all words add up to 1. A
context whose counts are all above the cut leaves nothing; there all counts are divided by c(v) + 1 instead.

Layout. Texts are coded once, in blocks of documents with a vocabulary each, and stored in a table that is bucketed by block.
Counting is a question and an answer: each block sends its distinct words with their training counts, dealt by hash to the
partitions of the unigram table, which add them up and answer with the totals; then the same with its distinct pairs, dealt by the
first word, where each partition of the bigram table also gathers what a(v) needs. Answers join their blocks in place (the blocks
don't move), where each token is scored recursively: the pair if it was seen, else the weight and the word. A frequent word is one
entry of a block, and the pairs of a word that begins a large share of all pairs are dealt by both words.

Words and pairs are compared by hashes of 64 bits and of 48 bits and bucket.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import written
from sparkloom.llm.hashes import WordHash, mixed
from sparkloom.llm.tokens import column_slices, give_back

CUT = 5
BEGIN, END = np.uint64(0x5BD1E995A3C59AC3), np.uint64(0xC2B2AE3D27D4EB4F)
BLOCKS = "block long, ids array<long>, train binary, lengths binary, vocabulary binary, tokens binary"
ANSWER = "block long, kind int, part int, a binary, b binary, c binary"
SCORES = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"
_48 = np.uint64((1 << 48) - 1)


def _zip(x: np.ndarray) -> bytes:
    """Compressed by byte planes: the high bytes of most numbers here are zero."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() if len(x) else b""
    return len(x).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if len(x) else b"")


def _unzip(data: bytes, kind: str) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def _short(x: np.ndarray) -> bytes:
    """The low six bytes of each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _dealt(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def coded(docs: DataFrame, train: Column, id_col: str, text_col: str, characters: int = 8_000_000) -> DataFrame:
    """The texts as blocks: per document its length in tokens (the end token included), per block its sorted word hashes and the tokens' places there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()

        def words(texts: list[str | None]) -> tuple[np.ndarray, list[int]]:
            rows = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
            lengths = [len(r) + 1 for r in rows]
            h = hashes.of([w for r in rows for w in (*r, b"")])
            h[np.cumsum(lengths) - 1] = END
            return h, lengths

        def block(rows: list[tuple], parts: list[np.ndarray], lengths: list[int]) -> pa.RecordBatch:
            vocabulary, tokens = np.unique(np.concatenate(parts), return_inverse=True)
            ids, flags = zip(*rows, strict=True)
            values = [uuid.uuid4().int >> 65, list(ids), np.array(flags, bool).tobytes(), np.array(lengths, "<u4").tobytes(), vocabulary.astype("<u8").tobytes(), _zip(tokens.astype("<u4"))]
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["block", "ids", "train", "lengths", "vocabulary", "tokens"])

        held: tuple[list, list, list] = ([], [], [])
        size = 0
        for batch in batches:
            ids, flags = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, texts in column_slices(batch.column(2), 1_000_000):
                h, lengths = words(texts)
                held[0].extend(zip(ids[a:b], flags[a:b], strict=True))
                held[1].append(h)
                held[2].extend(lengths)
                size += sum(len(t or "") for t in texts)
                if size >= characters:
                    yield block(*held)
                    held, size = ([], [], []), 0
        if held[0]:
            yield block(*held)
        give_back()

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, BLOCKS)


def _stored(df: DataFrame, buckets: int) -> str:
    """The name of a table bucketed by block in the warehouse: joins with answers leave it where it is."""
    name = f"sparkloom_blocks_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").format("parquet").saveAsTable(name)
    return name


class Discounts:
    """Katz's discounts from the counts of counts N(1) to N(CUT + 1).

    Where the raw counts of counts give a discount outside (0, 1), as copies in a corpus make them do, they are smoothed by a line
    through log N(r) over log r (simple Good-Turing); where that falls too slowly, or there is only one count, by a line of slope -2.
    """

    def __init__(self, of_counts: dict[int, int]):
        n = [float(of_counts.get(r, 0)) for r in range(CUT + 2)]
        self.d = np.ones(CUT + 1)
        if not n[1]:
            return
        self.d[1:] = self._katz(n)
        if not ((self.d[1:] > 0) & (self.d[1:] < 1)).all():
            some = [r for r in range(1, CUT + 2) if n[r]]
            slope = np.polyfit(np.log(some), np.log([n[r] for r in some]), 1)[0] if len(some) > 1 else -2.0
            slope = slope if slope < -1.05 else -2.0
            self.d[1:] = self._katz([0.0, *(r**slope for r in range(1, CUT + 2))])

    @staticmethod
    def _katz(n: list[float]) -> np.ndarray:
        high = (CUT + 1) * n[CUT + 1] / n[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.array([(np.float64((r + 1) * n[r + 1]) / (r * n[r]) - high) / (1 - high) for r in range(1, CUT + 1)])

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > CUT, 1.0, self.d[np.minimum(counts, CUT)])


class Unigrams:
    """Probabilities of words from their training counts; a count of 0 is the probability of all unseen words together."""

    def __init__(self, of_counts: dict[int, int], total: int, distinct: int):
        self.total, self.distinct, self.discount = total, distinct, Discounts(of_counts)
        lost = sum((1 - self.discount.d[r]) * r * of_counts.get(r, 0) for r in range(1, CUT + 1))
        self.scale, self.unseen = 1 / max(total, 1), lost / max(total, 1)
        if lost <= 0:
            self.scale, self.unseen = 1 / (total + 1), 1 / (total + 1)

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discount(counts) * counts * self.scale, self.unseen)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def _of_counts(counts: np.ndarray) -> np.ndarray:
    """Numbers of entries with count 1 to CUT + 1, of all entries, and their sum."""
    return np.array([*(np.count_nonzero(counts == r) for r in range(1, CUT + 2)), np.count_nonzero(counts), counts.sum()], "<i8")


def _sum(rows: list) -> tuple[dict[int, int], int, int]:
    total = np.sum([np.frombuffer(bytes(r["a"]), "<i8") for r in rows], axis=0) if rows else np.zeros(CUT + 3, np.int64)
    return {r: int(total[r - 1]) for r in range(1, CUT + 2)}, int(total[-1]), int(total[-2])


def _batch(rows: list[tuple], schema: str = ANSWER) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _words(blocks: DataFrame, buckets: int) -> DataFrame:
    """The unigram table (kind 0: hashes, totals), its counts of counts (kind 1) and the blocks' answers (kind 2: totals)."""
    asked = "part int, block long, hashes binary, counts binary"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, tokens = np.frombuffer(row["vocabulary"], "<u8"), _unzip(row["tokens"], "<u4")
                learned = np.repeat(np.frombuffer(row["train"], bool), np.frombuffer(row["lengths"], "<u4"))
                counts = np.bincount(tokens[learned], minlength=len(vocabulary)).astype("<u4")
                part = _dealt(vocabulary, buckets)
                bounds = np.searchsorted(part, np.arange(buckets + 1))  # the vocabulary is sorted, and so are its buckets
                yield _batch([(k, row["block"], vocabulary[a:b].tobytes(), _zip(counts[a:b])) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if a < b], asked)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts.setdefault(row["part"], []).append(row)
        for part in list(parts):
            rows = parts.pop(part)
            asked_for = [np.frombuffer(r["hashes"], "<u8") for r in rows]
            words, at = np.unique(np.concatenate(asked_for), return_inverse=True)
            totals = np.bincount(at, np.concatenate([_unzip(r["counts"], "<u4") for r in rows]), len(words)).astype("<u4")
            yield _batch([(None, 0, part, words.tobytes(), _zip(totals), None), (None, 1, part, _of_counts(totals.astype(np.int64)).tobytes(), None, None)])
            ends = np.cumsum([len(x) for x in asked_for])
            for r, x, end in zip(rows, asked_for, ends, strict=True):
                yield _batch([(r["block"], 2, part, _zip(totals[at[end - len(x) : end]]), None, None)])

    return blocks.select("block", "train", "lengths", "vocabulary", "tokens").mapInArrow(ask, asked).repartition(buckets, "part").mapInArrow(answer, ANSWER)


def _in_order(answers: list[dict], kind: int, column: str, dtype: str) -> np.ndarray:
    found = sorted((r for r in answers if r["kind"] == kind), key=lambda r: r["part"])
    return np.concatenate([_unzip(r[column], dtype) for r in found]) if found else np.zeros(0, dtype)


class Pairs:
    """A block's distinct pairs in the order in which they are sent: by bucket, then by first word."""

    def __init__(self, row: dict, counts: np.ndarray, begun: int, total: int, buckets: int):
        vocabulary, w = np.frombuffer(row["vocabulary"], "<u8"), _unzip(row["tokens"], "<u4").astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.learned = np.frombuffer(row["train"], bool)
        self.words, n = w, len(vocabulary)
        v = np.concatenate([[n], w[:-1]])
        v[np.cumsum(self.lengths)[:-1]] = n  # each document begins anew
        self.context = v
        self.counts = np.concatenate([counts.astype(np.int64), [begun]])
        names = np.concatenate([vocabulary, [BEGIN]])
        pairs, self.at = np.unique(v * n + w, return_inverse=True)
        self.first, self.second = pairs // n, pairs % n
        self.name = mixed(mixed(names[self.first], 6) + names[self.second], 7)
        hot = self.counts * 4 * buckets > total
        self.hot = hot[self.first]
        self.part = _dealt(np.where(self.hot, self.name, mixed(names[self.first], 3)), buckets)
        self.order = np.lexsort((self.first, self.part))
        self.names = names


def _pairs(blocks: DataFrame, answers: DataFrame, unigrams: Unigrams, begun: int, buckets: int) -> DataFrame:
    """Of the bigram table: what it answers to the blocks (kind 3: totals of the pairs, kind 4: of the first words the numbers of pairs by
    count, the sum of higher counts and the seen words' probability), counts of counts (kind 5), the parts of hot first words (kind 6)."""
    asked = "part int, block long, firsts binary, groups binary, pairs binary, seconds binary, counts binary"
    total = unigrams.total

    def ask(block: pa.Table, found: pa.Table) -> pa.Table:
        row = block.to_pylist()[0]
        p = Pairs(row, _in_order(found.to_pylist(), 2, "a", "<u4"), begun, total, buckets)
        train = np.bincount(p.at[np.repeat(p.learned, p.lengths)], minlength=len(p.name)).astype("<u4")
        part = p.part[p.order]
        bounds = np.searchsorted(part, np.arange(buckets + 1))
        out = []
        for k in np.flatnonzero(np.diff(bounds)):
            at = p.order[bounds[k] : bounds[k + 1]]
            first = p.first[at]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(first)) + 1])
            hot = p.hot[at[starts]]
            firsts = p.names[first[starts]] >> np.uint64(1) << np.uint64(1) | hot.astype(np.uint64)
            out.append((int(k), row["block"], firsts.astype("<u8").tobytes(), _zip(np.diff([*starts, len(at)]).astype("<u4")), _short(p.name[at] & _48), _zip(p.counts[p.second[at]].astype("<u4")), _zip(train[at])))
        return pa.Table.from_batches([_batch(out, asked)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for batch in batches:
            for row in batch.to_pylist():
                parts.setdefault(row["part"], []).append(row)
        for part in list(parts):
            rows = parts.pop(part)
            sizes = [len(r["pairs"]) // 6 for r in rows]
            _, index, at = np.unique(np.concatenate([_long(r["pairs"]) for r in rows]), return_index=True, return_inverse=True)
            totals = np.bincount(at, np.concatenate([_unzip(r["counts"], "<u4") for r in rows]), len(index)).astype(np.int64)
            firsts = [np.frombuffer(r["firsts"], "<u8") for r in rows]
            groups = np.concatenate([_unzip(r["groups"], "<u4") for r in rows])
            names, named = np.unique(np.concatenate(firsts), return_inverse=True)
            of = np.repeat(named, groups)[index]  # the first word of each distinct pair
            second = np.concatenate([_unzip(r["seconds"], "<u4") for r in rows])[index].astype(np.int64)
            seen = totals > 0
            tally = np.stack([np.bincount(of[totals == r], minlength=len(names)) for r in range(1, CUT + 1)] + [np.bincount(of[totals > CUT], totals[totals > CUT], len(names)).astype(np.int64)], axis=1)
            mass = np.bincount(of[seen], unigrams(second[seen]), len(names))
            hot = (names & np.uint64(1)).astype(bool)
            yield _batch([(None, 5, part, _of_counts(totals).tobytes(), None, None), (None, 6, part, names[hot].tobytes(), tally[hot].astype("<i8").tobytes(), mass[hot].tobytes())])
            end = last = 0
            for r, n, f in zip(rows, sizes, firsts, strict=True):
                end, last = end + n, last + len(f)
                who = named[last - len(f) : last]
                yield _batch([(r["block"], 3, part, _zip(totals[at[end - n : end]].astype("<u4")), None, None), (r["block"], 4, part, _zip(tally[who].astype("<u4").T.ravel()), _zip(mass[who]), None)])

    cogrouped = blocks.select("block", "train", "lengths", "vocabulary", "tokens").groupBy("block").cogroup(answers.groupBy("block"))
    return cogrouped.applyInArrow(ask, asked).repartition(buckets, "part").mapInArrow(answer, ANSWER)


def weights(tally: np.ndarray, mass: np.ndarray, counts: np.ndarray, discount: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """(a(v), divisor of v's pairs) of contexts; 1 where a context was not seen."""
    kept = tally[:, :CUT] @ (discount.d[1:] * np.arange(1, CUT + 1)) + tally[:, CUT]
    divisor = np.where(kept > counts * (1 - 1e-12), counts + 1.0, counts)
    left = np.maximum(0.0, 1 - kept / np.maximum(divisor, 1))
    return np.where(counts > 0, left / np.maximum(1 - mass, 1e-300), 1.0), np.maximum(divisor, 1)


def score(docs: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, train, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the text).

    The model learns from the rows where `train` is true. A null or empty text is its end token alone. Rows with the same id, or
    none, are documents of their own. Without training rows all words are unseen. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stored = _stored(coded(docs, train, id_col, text_col), buckets)
    try:
        out, total = _scored(docs, train, spark.table(stored), buckets)
    finally:
        spark.sql(f"DROP TABLE {stored}")
    return out.withColumn("train_tokens", F.lit(total).cast("long"))


def _scored(docs: DataFrame, train: Column, blocks: DataFrame, buckets: int) -> tuple[DataFrame, int]:
    """(scores of all documents, written; number of training tokens) from the stored blocks."""
    words = written(_words(blocks, buckets), "unigrams")
    unigrams = Unigrams(*_sum(words.filter("kind = 1").select("a").collect()))  # a row per partition
    begun = docs.filter(F.coalesce(train, F.lit(False))).count()
    word_answers = words.filter("kind = 2")
    pairs = written(_pairs(blocks, word_answers, unigrams, begun, buckets), "bigrams")
    discount = Discounts(_sum(pairs.filter("kind = 5").select("a").collect())[0])
    hot: dict[int, tuple[np.ndarray, float]] = {}
    for r in pairs.filter("kind = 6").select("a", "b", "c").collect():  # at most 4 * buckets first words are hot
        tallies = np.frombuffer(bytes(r["b"]), "<i8").reshape(-1, CUT + 1)
        for name, tally, mass in zip(np.frombuffer(bytes(r["a"]), "<u8").tolist(), tallies, np.frombuffer(bytes(r["c"]), "<f8"), strict=True):
            held = hot.get(name, (np.zeros(CUT + 1, np.int64), 0.0))
            hot[name] = (held[0] + tally, held[1] + float(mass))
    total = unigrams.total

    def run(block: pa.Table, found: pa.Table) -> pa.Table:
        row, answers = block.to_pylist()[0], found.to_pylist()
        p = Pairs(row, _in_order(answers, 2, "a", "<u4"), begun, total, buckets)
        totals = np.zeros(len(p.name), np.int64)
        totals[p.order] = _in_order(answers, 3, "a", "<u4")
        n = len(p.names)
        tally, mass = np.zeros((n, CUT + 1), np.int64), np.zeros(n)
        part, first = p.part[p.order], p.first[p.order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(part) != 0) | (np.diff(first) != 0)]))
        who = first[starts]
        parts = sorted((r for r in answers if r["kind"] == 4), key=lambda r: r["part"])
        tally[who] = np.concatenate([_unzip(r["a"], "<u4").reshape(CUT + 1, -1).T for r in parts])
        mass[who] = np.concatenate([_unzip(r["b"], "<f8") for r in parts])
        for i in np.unique(p.first[p.hot]):
            tally[i], mass[i] = hot[int(p.names[i]) | 1]
        a, divisor = weights(tally, mass, p.counts, discount)
        single = unigrams(p.counts)
        seen = totals > 0
        with np.errstate(divide="ignore"):
            chance = np.where(seen, discount(totals) * totals / divisor[p.first], a[p.first] * single[p.second])
            logs = np.log10(chance)[p.at]
        ends = np.cumsum(p.lengths)
        add = lambda x: np.add.reduceat(x, ends - p.lengths)
        known = p.counts[p.words]
        columns = [pa.array(row["ids"], pa.int64()), pa.array(p.learned), pa.array(p.lengths), pa.array(add((known > 0).astype(np.int64))), pa.array(add(unigrams.base(known))), pa.array(add(logs))]
        return pa.Table.from_arrays(columns, names=["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])

    answers = word_answers.unionByName(pairs.filter("kind in (3, 4)"))
    out = written(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, SCORES), "scores")
    return out, total
