"""Repeated passages by exact runs of words and by MinHash banding of paragraphs.

A run is 28 words that begin at a word which is chosen by content: of 24 neighbouring words that a run can begin at, the one
whose first five words have the smallest hash. So a passage of 51 words or more that stands in two documents, wherever it begins
and ends and however it is punctuated, has at least one run in common in both, while a text has about one run for 12 words. Runs
are compared by 96 bits of digests; equal ones are one cluster. They meet in the task of their digest's bucket, which names the document that
keeps them, and come back to their row, where those that overlap become one island.

Copies with changed words are found by paragraphs: whole sentences of at least 28 words that begin at a sentence which is chosen
the same way, of the sentences that begin within 24 words of any sentence's start.

Paragraphs have a MinHash signature over their word 5-grams, cut into bands of two rows: at a similarity of 0.75 five bands
find a pair with a chance of 0.98, equal paragraphs always. Only paragraphs that share a band with another document go on;
equal ones are one class. All classes that share a band with another are joined and verified by
exact Jaccard similarity, as `jaccard_join` does it: through the differences to common heads and an index that skips by position, so
that no bucket is listed pair by pair, none is cut, and no pair that is similar enough is lost. What is verified is clustered by connected
components. In each cluster the smallest document keeps its passage. Where a removed passage begins or ends with a run or an equal
paragraph, it is extended word by word for as long as the words agree with those around it in the document that keeps it; as runs lie less than 24
words apart, 24 words on each side reach the ends of what the two have in common.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm import recurring
from sparkloom.llm.common import WORD, discard, written
from sparkloom.llm.components import components
from sparkloom.llm.families import MINIMA, all_minima
from sparkloom.llm.hashes import WordHash, mixed
from sparkloom.llm.jaccard_join import class_links, digest
from sparkloom.llm.tokens import column_slices, give_back, slices

_ENDS = np.array([ord(c) for c in ".!?:;…。！？"], np.uint32)
BANDS, ROWS, N = 5, 2, 5


def _slid(f: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """`f` (minimum or maximum) over each `width` neighbours."""
    done = 1
    while 2 * done <= width:
        x, done = f(x[:-done], x[done:]), 2 * done
    return f(x[: len(x) - width + done], x[width - done :]) if done < width else x


class Passages:
    """The paragraphs of some texts: text, bounds in words (of all texts, one after the other) and in characters, and the shingles.

    The same of the exact runs stands in `runs`, once it is asked for.
    """

    def __init__(self, texts: list[str], hashes: WordHash, least_words: int, spread: int):
        joined = "\n".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        space = (codes == 32) | ((codes >= 9) & (codes <= 13))
        edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
        begins, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)
        n = len(begins)
        text = np.searchsorted(offsets, begins, "right") - 1
        lines = np.concatenate([[0], np.cumsum(codes == 10)])
        closes = np.isin(codes[ends - 1], _ENDS) if n else np.zeros(0, bool)
        closes[:-1] |= lines[begins[1:]] > lines[ends[:-1]]
        closes[-1:] = True
        stops = np.flatnonzero(closes) + 1
        starts = np.concatenate([[0], stops[:-1]]).astype(np.int64) if n else stops
        words = hashes.within(codes, begins, ends)
        self.shingles = np.full(max(0, n - N + 1), N, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(N if n >= N else 0):
                self.shingles = mixed(self.shingles + words[k : n - N + 1 + k], k)
        stop = np.searchsorted(stops, starts + least_words)
        last = stops[np.minimum(stop, max(len(stops) - 1, 0))] if n else stops
        whole = (stop < len(stops)) & (text[last - 1] == text[starts]) if n else np.zeros(0, bool)
        at = self._chosen(starts, text[starts] if n else text, spread)
        at = at[whole[at]]
        self.first, self.last = starts[at], last[at]
        self.text = text[self.first]
        self.start, self.stop = begins[self.first] - offsets[self.text], ends[self.last - 1] - offsets[self.text]
        self._of_runs = (text, begins, ends, offsets, least_words, spread)

    @cached_property
    def runs(self) -> Runs:
        return Runs(self.shingles, *self._of_runs)

    def _chosen(self, starts: np.ndarray, text: np.ndarray, spread: int) -> np.ndarray:
        """Of each run of sentence starts within `spread` words of one text, the place with the smallest hash."""
        n = len(starts)
        if not n:
            return starts
        value = np.full(n, np.iinfo(np.uint64).max, np.uint64)
        fits = starts < len(self.shingles)
        value[fits] = mixed(self.shingles[starts[fits]], 4)
        here = np.arange(n)
        until = np.minimum(np.searchsorted(starts, starts + spread), np.searchsorted(text, text, "right"))
        best = here.copy()
        for d in range(1, int((until - here).max())):
            at = np.minimum(here + d, n - 1)
            better = (here + d < until) & (value[at] <= value[best])
            best[better] = at[better]
        return np.unique(best)

    def bands(self) -> np.ndarray:
        """(paragraph, band) keys."""
        if not len(self.first):
            return np.zeros((0, BANDS), np.uint64)
        bounds = np.stack([self.first, self.last - N + 1], axis=1).ravel()
        padded = np.concatenate([self.shingles, self.shingles[-1:]])  # reduceat takes no bound behind the end
        out = []
        for b in range(BANDS):
            key = np.full(len(self.first), b, np.uint64)
            for r in range(ROWS):
                salt = np.uint64((b * ROWS + r + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                key = mixed(key ^ np.minimum.reduceat(mixed(padded ^ salt, r), bounds)[::2], 2 + r)
            out.append(key)
        return np.stack(out, axis=1)

    def shingle_set(self, i: int) -> np.ndarray:
        return np.unique(self.shingles[self.first[i] : self.last[i] - N + 1].view(np.int64))

    def short_sets(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """32 bits of the shingles of some paragraphs, each paragraph's sorted and without repetitions, and where each paragraph's begin and end."""
        count = self.last[at] - N + 1 - self.first[at]
        ends = np.cumsum(count)
        places = np.arange(count.sum()) + np.repeat(self.first[at] - ends + count, count)
        short = self.shingles[places].astype(np.uint32).view(np.int32).astype(np.int64)
        found = np.sort((np.repeat(np.arange(len(at)), count) << 32) + short)  # signed, so a paragraph's reach from its number less a half to plus a half
        found = found[np.concatenate([np.ones(min(1, len(found)), bool), found[1:] != found[:-1]])]
        bounds = np.searchsorted(found, (np.arange(len(at) + 1) << 32) - (1 << 31))
        return found.astype(np.uint32).view(np.int32), bounds


class Runs:
    """The exact runs of some texts: text, bounds in characters, and two hashes of the words."""

    def __init__(self, shingles: np.ndarray, text: np.ndarray, begins: np.ndarray, ends: np.ndarray, offsets: np.ndarray, words: int, spread: int):
        fits = np.flatnonzero(text[words - 1 :] == text[: max(0, len(text) - words + 1)])
        at = fits[self._chosen(mixed(shingles[fits], 4), text[fits], spread)]
        self.text = text[at]
        self.start, self.stop = begins[at] - offsets[self.text], ends[at + words - 1] - offsets[self.text]
        self.hashes = np.full((2, len(at)), words, np.uint64)
        with np.errstate(over="ignore"):
            for half in range(2):
                for k, d in enumerate([*range(0, words - N, N), words - N]):
                    self.hashes[half] = mixed(self.hashes[half] + mixed(shingles[at + d], 7 - half), 3 * half + k % 3)

    @classmethod
    def joined(cls, parts: list[Runs]) -> Runs:
        """All of some, as they lie in their own texts."""
        out = cls.__new__(cls)
        for name in ("text", "start", "stop", "hashes"):
            setattr(out, name, np.concatenate([getattr(x, name) for x in parts], axis=-1))
        return out

    def _chosen(self, value: np.ndarray, text: np.ndarray, spread: int) -> np.ndarray:
        """Which places have the smallest hash of some `spread` neighbours of one text, or of all if the text has fewer."""
        chosen, n = np.zeros(len(value), bool), len(value)
        if not n:
            return chosen
        value = value | np.uint64(1)
        if n >= spread:
            least = _slid(np.minimum, value, spread)
            least[text[spread - 1 :] != text[: n - spread + 1]] = 0
            none = np.zeros(spread - 1, np.uint64)
            chosen = _slid(np.maximum, np.concatenate([none, least, none]), spread) == value
        first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        count = np.diff(first, append=n)
        chosen |= (value == np.repeat(np.minimum.reduceat(value, first), count)) & np.repeat(count < spread, count)
        # equal neighbours (one word again and again): inside, where all runs read alike, one place of `spread` is enough
        first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (value[1:] != value[:-1])]))
        count = np.diff(first, append=n)
        place = np.arange(n) - np.repeat(first, count)
        return chosen & ((place < 4 * spread) | (np.repeat(count, count) - place <= 4 * spread) | (place % spread == 0))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, key, text): key tells rows with the same id and other texts apart."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).dropna()
    return rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")


#: Spans of one row (removed or not) as islands: bounds in characters, the first span's stop and the last one's start, the cluster of the first.
#: Where the first (left) or last (right) span is word for word that of the document that keeps it: that row's key and where it begins or ends there.
ISLANDS = "doc_id long, key long, removed boolean, start int, stop int, first_stop int, last_start int, component_id long, left_low long, left_at int, right_low long, right_at int"
#: What is sent for a run beside the first half of its digest: 32 bits of the second, start and length, byte by byte.
_PLACE = 12


def _placed(ids: np.ndarray, names: np.ndarray, doc: np.ndarray, runs: Runs, buckets: int) -> pa.RecordBatch:
    """Blocks of runs, a row for each bucket of the first half of their digests; `doc` is each run's place in ids and names."""
    bucket = recurring.bucket_of(runs.hashes[0], buckets)
    order = np.argsort(bucket, kind="stable")
    doc, bucket, h = doc[order], bucket[order], runs.hashes[:, order]
    place = np.stack([h[1].astype("<u4"), runs.start[order].astype("<u4"), (runs.stop - runs.start)[order].astype("<u4")], axis=1).view(np.uint8)
    bounds = np.searchsorted(bucket, np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[k], bounds[k + 1]
        starts = np.concatenate([[0], np.flatnonzero(np.diff(doc[a:b])) + 1])
        owner = doc[a:b][starts]
        rows.append((int(k), names[owner].astype("<i8").tobytes(), np.diff(starts, append=b - a).astype("<u4").tobytes(), h[0, a:b].astype("<u8").tobytes(), ids[owner].astype("<i8").tobytes(), place[a:b].T.tobytes()))
    columns = zip(*rows, strict=True) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *[pa.binary()] * 5), strict=True)], names=["bucket", "names", "counts", "items", "ids", "places"])


def _met(rows: list[list], buckets: int) -> Iterator[pa.RecordBatch]:
    """Of the runs of a bucket those that another document has too, packed for the partition of their row: doc_id, cluster, key of the row that
    keeps it, bounds (and whether removed) here and there."""
    counts = np.concatenate([np.frombuffer(r[1], "<u4") for r in rows])
    h1 = np.concatenate([np.frombuffer(r[2], "<i8") for r in rows])
    order = np.argsort(h1, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], np.diff(h1[order]) != 0]))
    often = np.diff(first, append=len(order))
    at = order[np.repeat(often > 1, often)]
    if not len(at):
        return
    h1 = h1[at]
    names, ids = (np.repeat(np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]), counts)[at] for c in (0, 3))
    place = np.ascontiguousarray(np.concatenate([np.frombuffer(r[4], np.uint8).reshape(_PLACE, -1).T for r in rows])[at]).view("<u4").astype(np.int64)
    h2, start, stop = place[:, 0], place[:, 1], place[:, 1] + place[:, 2]
    order = np.lexsort((start, names, ids, h2, h1))
    names, ids, h1, h2, start, stop = (x[order] for x in (names, ids, h1, h2, start, stop))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(h1) != 0) | (np.diff(h2) != 0)]))
    often = np.diff(first, append=len(h1))
    last = first + often - 1
    of_low = np.repeat(first, often)
    several = np.repeat((names[first] != names[last]) | (ids[first] != ids[last]), often)
    removed = (names != names[of_low]) | (ids != ids[of_low])
    numbers = np.stack([ids, h1, names[of_low], removed, start | stop << 32, start[of_low] | stop[of_low] << 32], axis=1)
    yield from recurring.sums(iter([(names[several], numbers[several])]), buckets)


def _run_islands(names: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """The rows that `_met` packed as islands. In their order both bounds of a row's runs rise, as all have as many words."""
    ids, h1, low, removed, here, there = numbers.reshape(-1, 6).T
    start, stop = here & 0x7FFFFFFF, here >> 32
    order = np.lexsort((stop, start, removed, ids, names))
    names, ids, h1, low, removed, start, stop, there = (x[order] for x in (names, ids, h1, low, removed, start, stop, there))
    new = (np.diff(names) != 0) | (np.diff(ids) != 0) | (np.diff(removed) != 0) | (stop[:-1] + 1 < start[1:])
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(names)), bool), new]))
    last = np.append(first, len(names))[1:] - 1
    columns = [ids[first], names[first], removed[first] > 0, start[first], stop[last], stop[first], start[last], h1[first], low[first], there[first] & 0x7FFFFFFF, low[last], there[last] >> 32]
    schema = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int32()] * 4, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema, strict=True)], names=[c.split()[0] for c in ISLANDS.split(", ")])


def shared(docs: DataFrame, least_words: int, spread: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What another row has too: rows (key, keys) with a row's band keys, and rows of ISLANDS of its runs, whose keys are null."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def apart(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], dict[int, list[list]]]:
        """Batches of bands, and rows of runs by bucket."""
        bands, runs = [], {}
        for batch in batches:
            of_runs = batch.column(batch.num_columns - 1).is_valid()
            bands.append(batch.filter(pc.invert(of_runs)))
            for bucket, *row in zip(*(c.to_pylist() for c in batch.filter(of_runs).columns), strict=True):
                runs.setdefault(bucket, []).append(row)
        return bands, runs

    def widened(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
        columns = [batch.column(c) if c in batch.schema.names else pa.nulls(batch.num_rows, pa.binary()) for c in names]
        return pa.RecordBatch.from_arrays(columns, names=names)

    blocks_of, sums_of = ["bucket", "names", "counts", "items", "ids", "places"], ["bucket", "names", "numbers", "places"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b, texts in column_slices(batch.column(2), 4_000_000):
                lists: list[np.ndarray] = []
                runs, doc = [], []
                for c, d in slices(texts, 500_000):
                    p = Passages(texts[c:d], hashes, least_words, spread)
                    bounds, keys = np.searchsorted(p.text, np.arange(d - c + 1)), p.bands()
                    lists += [np.unique(keys[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                    runs.append(p.runs)
                    doc.append(a + c + p.runs.text)
                yield widened(recurring.packed(names[a:b], lists, buckets), blocks_of)
                yield _placed(ids, names, np.concatenate(doc), Runs.joined(runs), buckets)
        give_back()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, runs = apart(batches)

        def found():
            for names, counts, items, several in recurring.shared(b.select(blocks_of[:4]) for b in bands):
                yield np.repeat(names, counts)[several], items[several]

        for batch in recurring.sums(found(), buckets):
            yield widened(batch, sums_of)
        bands.clear()
        for bucket in list(runs):
            for batch in _met(runs.pop(bucket), buckets):
                yield widened(batch.rename_columns(["bucket", "names", "places"]), sums_of)
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, runs = apart(batches)
        kinds = pa.schema([*_run_islands(np.zeros(0, np.int64), np.zeros(0, np.int64)).schema, pa.field("keys", pa.list_(pa.int64()))])
        for names, items in recurring.listed(b.select(sums_of[:3]) for b in bands):
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else np.zeros(0, np.int64)
            some = {"key": pa.array(names[first]), "keys": pa.ListArray.from_arrays(pa.array([*first, len(names)], pa.int32()), pa.array(items))}
            yield pa.RecordBatch.from_arrays([some.get(f.name, pa.nulls(len(first), f.type)) for f in kinds], schema=kinds)
        bands.clear()
        for bucket in list(runs):
            rows = runs.pop(bucket)
            found = _run_islands(np.concatenate([np.frombuffer(r[0], "<i8") for r in rows]), np.concatenate([np.frombuffer(r[2], "<i8") for r in rows]))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.list_(pa.int64()))], schema=kinds)
        give_back()

    blocks = _rows(docs, id_col, text_col).mapInArrow(emit, f"{recurring.BLOCK}, ids binary, places binary")
    found = recurring.dealt(blocks, buckets).mapInArrow(find, f"{recurring.SUMS}, places binary")
    return recurring.dealt(found, buckets).mapInArrow(gather, f"{ISLANDS}, keys array<long>")


def paragraphs(docs: DataFrame, bands: DataFrame, least_words: int, spread: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The paragraphs with one of the `bands` (key, keys): doc_id, key, bounds in characters, digest, band keys, shingles (32 bits of their hashes)."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            ids, names, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, b, texts in column_slices(batch.column(2), 500_000):
                p = Passages(texts, hashes, least_words, spread)
                found = p.bands()
                items = recurring.short_items(found.ravel(), buckets).reshape(found.shape)
                bounds = np.searchsorted(p.text, np.arange(b - a + 1))
                hits = [x + np.flatnonzero(np.isin(items[x:y], keys[a + i].values.to_numpy()).any(axis=1)) for i, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if x < y]
                at = np.concatenate(hits) if hits else np.zeros(0, np.int64)
                short, ends = p.short_sets(at)
                d = np.array([digest(short[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)], np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[a:b][p.text[at]]), pa.array(names[a:b][p.text[at]]), pa.array(p.start[at].astype(np.int32)), pa.array(p.stop[at].astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.ListArray.from_arrays(pa.array(np.arange(0, BANDS * len(at) + 1, BANDS), pa.int32()), pa.array(found[at].ravel().view(np.int64))), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(short))],
                    names=["doc_id", "key", "start", "stop", "d1", "d2", "bands", "shingles"],
                )
        give_back()

    joined = _rows(docs, id_col, text_col).join(bands, "key").select("doc_id", "key", "text", "keys")
    return joined.mapInArrow(run, "doc_id long, key long, start int, stop int, d1 long, d2 long, bands array<long>, shingles array<int>")


def clusters(classes: DataFrame, percent: int) -> DataFrame:
    """(rid, component_id) of the classes (rid, bands, n, shingles) that links between classes with a common band lead to."""
    keys = classes.select("rid", F.explode("bands").alias("band"))
    several = keys.groupBy("band").agg(F.count("*").alias("classes")).filter("classes > 1").select("band")
    collide = keys.join(several, "band").select("rid").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(2).offsets.to_numpy()
            sets = batch.column(2).values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)  # sorted, as `short_sets` gives them
            routes = pa.ListArray.from_arrays(pa.array(np.arange(0, MINIMA * batch.num_rows + 1, MINIMA), pa.int32()), pa.array(all_minima(sets, np.diff(ends)).ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(sets)), routes], names=["rid", "n", "shingles", "minima"])

    sets = classes.join(collide, "rid").select("rid", "n", "shingles").mapInArrow(run, "rid long, n long, shingles array<long>, minima array<long>")
    sets = written(sets, "colliding")
    found = components(written(class_links(sets, percent), "band-links")).withColumnRenamed("id", "rid")
    discard(sets)
    return found


def _islands(spans: DataFrame) -> DataFrame:
    """Spans or islands (ISLANDS) of one row that overlap or touch and fare alike as one."""
    w = Window.partitionBy("doc_id", "key", "removed").orderBy("start", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.coalesce(before, F.lit(-2)) + 1 < F.col("start")).cast("int")).over(w)
    met = spans.withColumn("island", island).groupBy("doc_id", "key", "removed", "island").agg(
        F.min(F.struct("start", "first_stop", F.col("left_low").isNull(), "left_low", "left_at")).alias("left"),
        F.max(F.struct("stop", (-F.col("last_start")).alias("place"), "right_low", "right_at")).alias("right"),
        F.min_by("component_id", F.when(F.col("component_id").isNotNull(), F.struct("start", "first_stop"))).alias("component_id"),
    )
    return met.select("doc_id", "key", "removed", "left.start", "right.stop", "left.first_stop", (-F.col("right.place")).alias("last_start"), "component_id", "left.left_low", "left.left_at", "right.right_low", "right.right_at")


def _staying(spans: DataFrame) -> DataFrame:
    """The spans without those not removed that lie within a removed one of their row: another cluster cuts them."""
    w = Window.partitionBy("doc_id", "key").orderBy("start", F.col("removed").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = F.coalesce(F.max(F.when(F.col("removed"), F.col("stop"))).over(w), F.lit(-1))
    return spans.withColumn("cut", cut).filter("removed or stop > cut").drop("cut")


def surroundings(docs: DataFrame, asked: DataFrame, spread: int, id_col: str, text_col: str) -> DataFrame:
    """Of places (key, side, at) the `spread` words before (side 0) or after (side 1), the nearest first, in lower case, and where each begins or ends."""
    word = re.compile(WORD)
    lower = {c: c + 32 for c in range(65, 91)}

    def nearest(text: str, side: int, at: int) -> list[re.Match]:
        if side:
            return [m for m, _ in zip(word.finditer(text, at), range(spread), strict=False)]
        reach = 16 * spread
        while True:
            low = max(0, at - reach)
            found = list(word.finditer(text, low, at))
            if low == 0 or len(found) > spread:  # the first may be the end of a longer word
                return found[-1 : -spread - 1 : -1]
            reach *= 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in column_slices(batch.column(1)):
                rows = []
                for key, text, places in zip(batch.column(0).slice(a, b - a).to_pylist(), texts, batch.column(2).slice(a, b - a).to_pylist(), strict=True):
                    for p in places:
                        found = nearest(text, p["side"], p["at"])
                        rows.append((key, p["side"], p["at"], [m[0].translate(lower) for m in found], [m.end() if p["side"] else m.start() for m in found]))
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "side", "at", "words", "bounds"])

    places = asked.groupBy("key").agg(F.collect_set(F.struct("side", "at")).alias("places"))  # no more than a row's own runs
    joined = _rows(docs, id_col, text_col).join(places, "key").select("key", "text", "places")
    return joined.mapInArrow(run, "key long, side int, at int, words array<string>, bounds array<int>").dropDuplicates(["key", "side", "at"])


def _extended(docs: DataFrame, removed: DataFrame, spread: int, id_col: str, text_col: str) -> DataFrame:
    """The removed islands, those that begin or end with what the kept document has word for word extended as far as the words agree with the kept document's."""
    islands = written(removed, "islands")
    sides = F.array(*[F.struct(F.lit(k).alias("side"), F.col(at).alias("at"), F.col(f"{e}_low").alias("low"), F.col(f"{e}_at").alias("low_at")) for k, (e, at) in enumerate((("left", "start"), ("right", "stop")))])
    edges = written(islands.select("key", F.explode(sides).alias("e")).select("key", "e.*").filter("low is not null").distinct(), "edges-of-passages")
    asked = edges.select("key", "side", "at").unionByName(edges.select(F.col("low").alias("key"), "side", F.col("low_at").alias("at"))).distinct()
    found = written(surroundings(docs, asked, spread, id_col, text_col), "surroundings")
    there = found.select(F.col("key").alias("low"), "side", F.col("at").alias("low_at"), F.col("words").alias("other"))
    met = edges.join(found, ["key", "side", "at"]).join(there, ["low", "side", "low_at"])
    differs = F.array_position(F.zip_with("words", "other", lambda x, y: x.eqNullSafe(y)), False)
    agree = F.when(differs > 0, differs - 1).otherwise(F.size("words"))
    moved = met.select("key", "side", "at", F.when(agree > 0, F.get("bounds", (agree - 1).cast("int"))).alias("to")).filter("to is not null")
    # an edge that reaches further is a span of its own from the old edge to the new one, which joins its island
    more = moved.select("key", F.least("at", "to").alias("start"), F.greatest("at", "to").alias("stop"))
    more = more.join(islands.select("doc_id", "key").distinct(), "key").select("doc_id", "key", F.lit(True).alias("removed"), "start", "stop", F.col("stop").alias("first_stop"), F.col("start").alias("last_start"))
    return _islands(islands.unionByName(more, allowMissingColumns=True))


def repeated(docs: DataFrame, *, least_words: int = 28, spread: int = 24, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per passage that another document has too: doc_id, start and stop in characters, component_id, removed, key.

    Passages of one document that overlap or touch and fare alike are one row. component_id (any number) names the cluster of its first
    paragraph or run; a cluster lies in two documents at least. The passages of the cluster's smallest doc_id stay, all others are
    removed, up to the first word on each side in which they differ. A passage that would stay, but lies within a removed one, is no row.
    Repetitions within one document alone are left. Rows without id or text have no passages. Rows with the same id and other texts are documents of their own, which `key` tells apart; repeated
    rows (same id and text) are one document. Other columns aren't read, and an empty table gives no rows.
    """
    both = written(shared(docs, least_words, spread, id_col, text_col), "shared")
    near = written(paragraphs(docs, both.filter("keys IS NOT NULL").select("key", "keys"), least_words, spread, id_col, text_col), "paragraphs")
    classes = near.groupBy("d1", "d2").agg(F.first("bands").alias("bands"), F.first("shingles").alias("shingles"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("rid"), "d1", "d2", "bands", F.size("shingles").cast("long").alias("n"), "shingles"), "paragraph-classes")
    named = classes.select("rid", "d1", "d2").join(clusters(classes, percent), "rid", "left")
    named = named.select("d1", "d2", F.coalesce("component_id", "rid").alias("component_id"))
    placed = written(near.select("doc_id", "key", "start", "stop", "d1", "d2").join(named, ["d1", "d2"]).select("doc_id", "key", "start", "stop", "component_id", "d1"), "placed")
    discard(classes)
    discard(near)
    where = F.struct("doc_id", "key", "start", "stop", "d1")
    first = placed.groupBy("component_id").agg(F.min(where).alias("low"), F.max(where).alias("high"))
    first = first.filter((F.col("low.doc_id") != F.col("high.doc_id")) | (F.col("low.key") != F.col("high.key")))
    # written, so that both sides of the join are plain and a cluster with many paragraphs can be split
    first = written(first.select("component_id", "low"), "first")
    marked = placed.join(first, "component_id").withColumn("removed", (F.col("doc_id") != F.col("low.doc_id")) | (F.col("key") != F.col("low.key")))
    exact = {name: F.when(F.col("d1") == F.col("low.d1"), F.col(f"low.{c}")).alias(name) for name, c in (("left_low", "key"), ("left_at", "start"), ("right_low", "key"), ("right_at", "stop"))}
    marked = marked.select("doc_id", "key", "removed", "start", "stop", F.col("stop").alias("first_stop"), F.col("start").alias("last_start"), "component_id", *exact.values())
    spans = written(marked.unionByName(both.filter("keys IS NULL").drop("keys")), "marked")
    discard(placed)
    discard(both)
    found = _islands(spans.filter("not removed")).unionByName(_extended(docs, _islands(spans.filter("removed")), spread, id_col, text_col))
    return _staying(found).select("doc_id", "start", "stop", "component_id", "removed", "key")


def without_repeats(docs: DataFrame, *, least_words: int = 28, spread: int = 24, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the repeated passages cut out of their texts; documents of which no word is left go. Columns stay as they are.

    Cuts are found by id and text, so rows that share an id lose only what is theirs. Rows without id or text stay as they are.
    """
    spans = repeated(docs, least_words=least_words, spread=spread, percent=percent, id_col=id_col, text_col=text_col).filter("removed")
    cuts = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    key = F.when(docs[id_col].isNotNull() & docs[text_col].isNotNull(), F.xxhash64(docs[id_col].cast("long"), docs[text_col]))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), key.alias("key"), docs[text_col].alias("text")).join(cuts, "key", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, emptied = [], []
            for text, spots in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, parts = 0, []
                for s in spots or []:
                    parts.append(text[at : s["start"]].rstrip(" "))
                    at = s["stop"]
                out.append(text if not spots else "".join([*parts, text[at:]]).strip())
                emptied.append(bool(spots) and not out[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(emptied, pa.bool_()), pa.array(out, pa.string())], names=["row", "emptied", "text"])

    schema = type(rows.schema)([rows.schema["row"]]).add("emptied", "boolean").add("text", "string")
    cut = rows.select("row", "text", "cuts").mapInArrow(run, schema).filter("not emptied")
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
