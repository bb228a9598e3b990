"""Exact Jaccard similarity join of documents' word n-gram sets, as classes and components.

Set relations are used to skip work, on two levels.

Index level. Only shingles that another document has too can make a link. A first pass counts shingles in packed blocks
(by bucket of the hash, five bytes each), for so long a prefix of each set that a linked set must share many of them; what
falls below is left out. Of what remains, the index lists hold prefixes in the order of document frequency, the rarest
first; a pair from a list is skipped by its positions in both sets if what is left behind them can't reach the overlap.

Answer level. Identical sets are one class. Classes adopt a head, the most common set among those that share their minimum hashes,
and the links within a head's family are derived from each member's small difference to the head (see `families`). So a group of many
copies costs a comparison each and not one for each pair. Only entries of different families are then joined through the index lists.

Lists are joined by blocks of about 64 entries at most with like positions. The block's largest rest, its sizes and its family
come first: a pair of blocks that can't reach the overlap, or that lies within one family, is skipped as a whole.

A group's lists are never held in one task: blocks are dealt by a hash, and joins split. All figures are exact: no list,
group or candidate is capped. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import recurring
from sparkloom.llm.common import discard, written
from sparkloom.llm.components import components
from sparkloom.llm.families import links, minima
from sparkloom.llm.hashes import WordHash, mixed
from sparkloom.llm.tokens import column_slices, give_back, slices

_U = np.uint64


def shingle_sets(texts: list[str | None], n: int, hashes: WordHash) -> list[np.ndarray]:
    """Of each text the sorted hashes of its distinct n-word shingles; A-Z count as a-z, and ASCII white space parts words.

    A text of fewer words is one shingle; a text without words has none.
    """
    rows = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    words = hashes.of([w for row in rows for w in row])
    out, at = [], 0
    with np.errstate(over="ignore"):
        for row in rows:
            w, at = words[at : at + len(row)], at + len(row)
            width = min(n, len(w))
            if not width:
                out.append(np.zeros(0, np.int64))
                continue
            h = np.full(len(w) - width + 1, width, _U)
            for k in range(width):
                h = mixed(h + w[k : len(w) - width + 1 + k], k)
            out.append(np.unique(h.view(np.int64)))
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any linked set."""
    return -(-percent * n // 100)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))


def keys(docs: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """One row per document: a hash of its text, size and 128-bit digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for a, b, texts in column_slices(batch.column(1), 1_000_000):
                sets = shingle_sets(texts, n, hashes)
                d1, d2 = zip(*map(digest, sets), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64())], names=["doc_id", "of_text", "n", "d1", "d2"])
        give_back()

    return _texts(docs, id_col, text_col).withColumn("of_text", F.xxhash64("text")).mapInArrow(run, "doc_id long, of_text long, n long, d1 long, d2 long")


def shared_counts(docs: DataFrame, n: int, percent: int, text_col: str) -> DataFrame:
    """(d1, found): how many shingles of the sets' prefixes (the smallest hashes) other documents' prefixes hold too, by the first
    half of the digest. Forty bits of a hash and its bucket are compared: a false match keeps a set, and loses nothing."""
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            for _, _, texts in column_slices(batch.column(0), 4_000_000):
                sets = [s for c, d in slices(texts, 500_000) for s in shingle_sets(texts[c:d], n, hashes)]
                sets = [s for s in sets if len(s)]
                fronts = [s[: len(s) - least_overlap(len(s), percent) + -(-len(s) // 4)].view(_U) for s in sets]
                yield recurring.packed(np.array([digest(s)[0] for s in sets]), [mixed(f, 5) for f in fronts], buckets)
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for names, counts, _, several in recurring.shared(batches):
                n = np.add.reduceat(several.astype(np.int64), np.cumsum(counts) - counts)
                yield names[n > 0], n[n > 0]

        yield from recurring.sums(found(), buckets)
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, found in recurring.added(batches):
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found)], names=["d1", "found"])

    packed = docs.select(docs[text_col].alias("text")).mapInArrow(emit, recurring.BLOCK)
    counted = recurring.dealt(packed, buckets).mapInArrow(count, recurring.SUMS)
    return recurring.dealt(counted, buckets).mapInArrow(add, "d1 long, found long")


def candidate_sets(docs: DataFrame, known: DataFrame, n: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(rid, n, d1, d2, shingles, minima) of one document of each class whose set may have links with unlike sets."""
    classes = known.filter("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    least = F.ceil(F.ceil(percent * F.col("n") / 100) / 4)
    found = shared_counts(docs, n, percent, text_col)
    some = classes.join(found, "d1").filter(F.col("found") >= least * F.col("copies")).select("doc_id", "d1", "d2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in batches:
            d1, d2 = (batch.column(c).to_pylist() for c in ("d1", "d2"))
            for a, _, texts in column_slices(batch.column("text"), 1_000_000):
                sets = shingle_sets(texts, n, hashes)
                fine = [i for i, s in enumerate(sets) if digest(s) == (d1[a + i], d2[a + i])]  # else another row of the same id
                yield pa.RecordBatch.from_arrays([pa.array([d1[a + i] for i in fine], pa.int64()), pa.array([d2[a + i] for i in fine], pa.int64()), pa.array([len(sets[i]) for i in fine], pa.int64()), pa.array([sets[i] for i in fine], pa.list_(pa.int64())), pa.array([minima(sets[i]) for i in fine], pa.list_(pa.int64()))], names=["d1", "d2", "n", "shingles", "minima"])

    joined = _texts(docs, id_col, text_col).join(some, "doc_id").select("doc_id", "text", "d1", "d2")
    sets = joined.mapInArrow(run, "d1 long, d2 long, n long, shingles array<long>, minima array<long>")
    return sets.dropDuplicates(["d1", "d2"]).select(F.monotonically_increasing_id().alias("rid"), "d1", "d2", "n", "shingles", "minima")


def fronts(sets: DataFrame, percent: int) -> DataFrame:
    """(rid, found, held, front) of the sets (rid, shingles): how many elements another set has too, the sum of their frequencies,
    and the rarest of them, as many as the prefix of a set of no more than these would hold.

    Elements travel in packed blocks to be counted, and back to their sets. An element is named by bucket and forty bits; elements that share a name
    count as one here, which adds entries to the index and loses none.
    """
    buckets = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, shingles = batch.column(0).to_numpy(), batch.column(1)
            bounds = shingles.offsets.to_numpy()
            values = mixed(shingles.values.to_numpy().view(_U), 5)
            a = 0
            while a < len(names):
                b = max(a + 1, int(np.searchsorted(bounds, bounds[a] + 2_000_000, "right")) - 1)
                yield recurring.packed(names[a:b], np.split(values[bounds[a] : bounds[b]], bounds[a + 1 : b] - bounds[a]), buckets)
                a = b
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        several = ((names[often > 1], np.stack([items, often], axis=1)[often > 1]) for names, items, often in recurring.frequencies(batches))
        yield from recurring.sums(several, buckets)
        give_back()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, items, often in recurring.ranked(batches):
            if not len(names):
                continue
            first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            found = np.diff([*first, len(names)])
            reach = found + 1 + -percent * found // 100
            kept = np.arange(len(names)) - np.repeat(first, found) < np.repeat(reach, found)
            ends = pa.array(np.concatenate([[0], np.cumsum(reach)]), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(names[first]), pa.array(found), pa.array(np.add.reduceat(often, first)), pa.ListArray.from_arrays(ends, pa.array(items[kept]))], names=["rid", "found", "held", "front"])
        give_back()

    counted = recurring.dealt(sets.select("rid", "shingles").mapInArrow(emit, recurring.BLOCK), buckets).mapInArrow(count, recurring.SUMS)
    return recurring.dealt(counted, buckets).mapInArrow(gather, "rid long, found long, held long, front array<long>")


def class_links(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of rids: links that connect all that any links connect."""
    least = F.ceil(percent * F.col("n") / 100)
    enough = fronts(sets, percent).join(sets.select("rid", "n"), "rid").filter(F.col("found") >= least)
    reach = (F.col("found") - least + 1).cast("int")
    enough = written(enough.select("rid", "n", "found", (F.col("held") / F.col("n")).alias("score"), F.slice("front", 1, reach).alias("front")), "fronts")
    # elements that are in one set only would come first, so the others' places begin behind them
    places = enough.select("rid", "n", "found", F.posexplode("front").alias("pos", "h"))
    index = places.select("rid", "n", "h", (F.col("found") - F.col("pos") - 1).alias("behind"))

    asked = sets.join(enough.select("rid", "score"), "rid")
    routes = asked.select("rid", "score", F.posexplode("minima").alias("round", "token"))
    return links(sets, written(routes, "routes"), index, percent)


def join(docs: DataFrame, *, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, class_id, component_id, of_text (a hash of the text).

    Two documents link when 100 * intersection >= percent * union of their sets. class_id is the smallest doc_id with the same
    set, component_id the smallest that links lead to, itself included. Null and empty texts, and texts without words, have no
    shingles and link with nothing. Rows with a null id take part but name no class; alone, their component is null. Rows with
    the same id are rows of their own. Other columns aren't read, and an empty table gives no rows.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be 50 to 100")
    known = written(keys(docs, n, id_col, text_col), "keys")
    sets = written(candidate_sets(docs, known, n, percent, id_col, text_col), "sets")
    classes = known.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"))
    between = written(class_links(sets.select("rid", "n", "shingles", "minima"), percent), "class-links")
    grouped = components(between)
    discard(between)
    named = written(grouped.join(sets.select(F.col("rid").alias("id"), "d1", "d2"), "id").join(classes, ["d1", "d2"]), "named")
    discard(sets)
    least = named.groupBy("component_id").agg(F.min("class_id").alias("least"))
    reached = named.join(least, "component_id").select("d1", "d2", "least")
    per_class = classes.join(reached, ["d1", "d2"], "left").select("d1", "d2", "class_id", F.coalesce("least", "class_id").alias("component_id"))
    lone = F.col("n") == 0
    out = known.join(per_class, ["d1", "d2"], "left")
    return out.select("doc_id", "of_text", F.col("n").alias("n_shingles"), F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(lone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, that with the smallest id; columns stay as they are.

    Documents without shingles stay, and so do rows without id. Of repeated rows (same id and text) one stays.
    """
    found = join(docs, n=n, percent=percent, id_col=id_col, text_col=text_col).filter("doc_id = component_id")
    found = written(found.groupBy("doc_id", "of_text").agg(F.count("*").alias("copies")), "joined")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # whatever the columns are called
    rows = docs.select(whole.alias("row"), docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    keyed = rows.withColumn("of_text", F.xxhash64("text"))
    once, again = (keyed.join(found.filter(some), ["doc_id", "of_text"], "left_semi") for some in ("copies = 1", "copies > 1"))
    kept = once.select("row").unionByName(again.dropDuplicates(["doc_id", "text"]).select("row"))
    return kept.unionByName(rows.filter("doc_id is null").select("row")).select("row.*")
