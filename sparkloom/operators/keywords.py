"""Keywords of texts by TextRank and by TF-IDF, and what they say of a text or of a pair of texts."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import questions as Q
from sparkloom.functions import text as T
from sparkloom.sources.shared import written_once

RANKED = "doc long, place int, word string, score double"


def words(c: str | Column, shortest: int = 2) -> Column:
    """Tokens of some length in lower case, without stop words."""
    return F.filter(T.tokens(c), lambda x: (F.length(x) >= shortest) & ~x.isin(T.REWRITE_STOP_WORDS))


def _ranks(lists: pa.Array, span: int, damping: float, rounds: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(row, word, score) of the distinct words of each list: the graphs of all rows are one sparse matrix, a round is a product with it."""
    row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
    coded = pc.list_flatten(lists).dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    nodes, at = np.unique(row * (len(coded.dictionary) or 1) + code, return_inverse=True)
    n = len(nodes)
    pairs = [np.zeros(0, np.int64)]
    for k in range(1, span):
        a, b = at[:-k], at[k:]
        near = (row[:-k] == row[k:]) & (a != b)
        pairs += [a[near] * n + b[near], b[near] * n + a[near]]
    edges, weight = np.unique(np.concatenate(pairs), return_counts=True)
    source, target = np.divmod(edges, max(n, 1))
    out = np.bincount(source, weight, n)
    share = weight / out[source]
    score = np.ones(n)
    for _ in range(rounds):
        score = (1 - damping) + damping * np.bincount(target, share * score[source], n)
    of = nodes // (len(coded.dictionary) or 1)
    best = np.zeros(len(lists))
    np.maximum.at(best, of, score)
    return of, coded.dictionary.take(pa.array(nodes % (len(coded.dictionary) or 1))), np.round(score / np.where(best[of] > 0, best[of], 1), 9)


#: Words of texts that are ranked at once, whole texts only.
RANKED_WORDS = 1 << 17


def _parts(batch: pa.RecordBatch, sizes: pa.Array | None = None, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole texts with about `RANKED_WORDS` words each (or `size` of what `sizes` counts), so that no part's graph grows with the batch."""
    sizes, size = pc.list_value_length(batch.column(1)) if sizes is None else sizes, size or RANKED_WORDS
    ends = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.flatnonzero(np.diff(ends // size, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=False):
        yield batch.slice(a, b - a)


def text_rank(docs: DataFrame, most: int = 10, span: int = 5, damping: float = 0.85, rounds: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, place, word, score): the words that words near them lead to, relative to the best; of equal scores by spelling.

    Two different words are linked as often as they stand less than `span` words apart. Rows that share an id are texts of their own; a
    text without words has no rows. Texts are worked on some at a time, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            of, word, score = _ranks(batch.column(1), span, damping, rounds)
            spelling = pc.rank(word, tiebreaker="dense").to_numpy(zero_copy_only=False) if len(word) else np.zeros(0)
            order = np.lexsort((spelling, -score, of))
            place = np.arange(len(of)) - np.searchsorted(of[order], of[order]) + 1
            top = place <= most
            picked = pa.array(order[top])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of[order[top]])), pa.array(place[top].astype(np.int32)), word.take(picked), pa.array(score[order[top]])], names=["doc", "place", "word", "score"])

    return docs.select(F.col(id_col).cast("long"), words(text_col)).mapInArrow(run, RANKED)


#: Characters of texts that are counted at once, and about how many words of the vocabulary every task knows.
COUNTED_CHARACTERS, KNOWN_WORDS = 1 << 23, 1 << 18
_BAG = "doc long, words string, counts string"


def _by_characters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (part for batch in batches for part in _parts(batch, pc.binary_length(batch.column(1)), COUNTED_CHARACTERS))


def _counted(texts: DataFrame, shortest: int) -> DataFrame:
    """(doc, words, counts): the distinct words of each text (doc, low: in lower case) and how often it has them, joined by spaces; texts without words have no row."""
    token, stop = re.compile(re.sub(r"\\x\{(\w+)\}", r"\\u\1", T.BM25_TOKEN)), frozenset(T.REWRITE_STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_characters(batches):
            bags = [[(w, n) for w, n in Counter(token.findall(low)).items() if len(w) >= shortest and w not in stop] for low in batch.column(1).to_pylist()]
            said = [(" ".join([w for w, _ in b]), " ".join([str(n) for _, n in b])) for b in bags if b]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(map(bool, bags), pa.bool_())), *[pa.array([x[k] for x in said], pa.string()) for k in range(2)]], names=["doc", "words", "counts"])

    return texts.mapInArrow(run, _BAG)


def _bags(docs: DataFrame, shortest: int, id_col: str, text_col: str) -> DataFrame:
    """`_counted`, one row for all texts that share an id. Only those are shuffled."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.lower(T.text(text_col)).alias("low"))
    several = written_once(texts.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc").alias("shared")), "shared-ids")
    same = F.col("doc").eqNullSafe(F.col("shared"))
    parts = _counted(texts.join(several, same, "left_semi"), shortest).select("doc", F.explode(F.arrays_zip(F.split("words", " ").alias("word"), F.split("counts", " ").alias("n"))).alias("w"))
    sums = parts.groupBy("doc", F.col("w.word").alias("word")).agg(F.sum(F.col("w.n").cast("long")).alias("n"))
    whole = sums.groupBy("doc").agg(F.collect_list(F.struct("word", "n")).alias("w")).select("doc", F.array_join("w.word", " ").alias("words"), F.array_join(F.col("w.n").cast("array<string>"), " ").alias("counts"))
    return _counted(texts.join(several, same, "left_anti"), shortest).unionByName(whole)


def _texts_of_words(bags: DataFrame) -> DataFrame:
    """(word, df): in how many texts a word is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_characters(batches):
            found = pc.value_counts(pc.list_flatten(pc.split_pattern(batch.column(1), " ")))
            yield pa.RecordBatch.from_arrays(found.flatten(), names=["word", "df"])

    return bags.select("doc", "words").mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df"))


def _candidates(bags: DataFrame, known: list[tuple[str, float]], rare: tuple[float, float], most: int) -> DataFrame:
    """(doc, word, share, idf) of the words of a text that may be among its `most` best; idf is null for words that aren't `known`, which lies in `rare`."""
    names, idf = pa.array([w for w, _ in known], pa.string()), np.array([*(x for _, x in known), 0.0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_characters(batches):
            words = pc.split_pattern(batch.column(1), " ")
            size = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
            row, first = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
            word, n = pc.list_flatten(words), pc.list_flatten(pc.split_pattern(batch.column(2), " ")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            share = n / np.bincount(row, n, len(size))[row]
            at = pc.fill_null(pc.index_in(word, names), -1).to_numpy(zero_copy_only=False)
            least, best = (share * np.where(at >= 0, idf[at], x) for x in rare)
            falling = least[np.lexsort((-least, row))]
            bound = np.full(len(size), -np.inf)
            full = size >= most
            bound[full] = falling[first[full] + most - 1]
            may = np.flatnonzero(best >= bound[row] - 2e-9)  # scores are rounded to 9 places
            picked = pa.array(may)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[may])), word.take(picked), pa.array(share[may]), pa.array(idf[at[may]], mask=at[may] < 0)], names=["doc", "word", "share", "idf"])

    return bags.mapInArrow(run, "doc long, word string, share double, idf double")


def tf_idf(docs: DataFrame, most: int = 10, shortest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, place, word, score): share of the text's words times the logarithm of all texts with words over those with the word.

    Rows that share an id are one text. Words are counted where a text lies. All tasks know the words that are in many texts, fewer than
    `KNOWN_WORDS`; a word that isn't one of them is in few texts, which bounds its score on both sides. Only words that may be among the
    best by these bounds leave their text, and only rare ones look their count up.
    """
    bags = written_once(_bags(docs, shortest, id_col, text_col), "bags")
    of_word = written_once(_texts_of_words(bags), "texts-of-words")
    texts, pairs = bags.count(), of_word.agg(F.sum("df")).first()[0] or 0
    many = pairs // KNOWN_WORDS + 1  # words in so many texts are no more than KNOWN_WORDS
    of_word = of_word.withColumn("idf", F.ln(F.lit(texts) / F.col("df")))
    known = [(r.word, r.idf) for r in of_word.filter(F.col("df") >= many).collect()]
    candidates = written_once(_candidates(bags, known, (max(0.0, math.log(max(texts, 1) / many)), math.log(max(texts, 1))), most), "candidates")
    rare = candidates.filter("idf is null").drop("idf").join(of_word.drop("df"), "word")
    scored = candidates.filter("idf is not null").unionByName(rare).withColumn("score", F.round(F.col("share") * F.col("idf"), 9))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("score"), "word"))
    return scored.withColumn("place", place).filter(F.col("place") <= most).select("doc", "place", "word", "score")


def density(ranked: DataFrame) -> DataFrame:
    """(doc, density): the mean score of a text's keywords, 1 at most."""
    return ranked.groupBy("doc").agg(F.least(F.lit(1.0), F.avg("score")).alias("density"))


def coverage(pairs: DataFrame, ranked: DataFrame, docs: DataFrame, most: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`pairs` (query, doc) with `coverage`: the share of the query's first keywords (`ranked`, its doc is the query) among the document's words."""
    keys = ranked.filter(F.col("place") <= most).groupBy(F.col("doc").alias("query")).agg(F.collect_set("word").alias("keys"))
    texts = docs.select(F.col(id_col).alias("doc"), F.array_distinct(T.tokens(text_col)).alias("words"))
    met = pairs.join(keys, "query", "left").join(texts, "doc", "left")
    n = F.size("keys")
    share = F.size(F.array_intersect("keys", F.coalesce("words", F.array().cast("array<string>")))) / F.greatest(n, F.lit(1))
    return met.select(*pairs.columns, F.when(F.col("keys").isNotNull(), share).otherwise(0.0).alias("coverage"))


def prepared(docs: DataFrame, languages: tuple[str, ...] = ("chinese", "mixed"), most: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, language, text, token_count, keywords, searchable): texts as an index takes them; the last three only for some languages (else the text)."""
    chosen = T.language_mix(text_col).isin(*languages)
    tokens = T.tokens(text_col)
    keys = tf_idf(docs, most, id_col=id_col, text_col=text_col).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]).alias("keys"))
    plain = Q.plain(text_col)
    rows = docs.select(F.col(id_col).alias("doc"), T.language_mix(text_col).alias("language"), plain.alias("text"), F.when(chosen, F.size(tokens)).alias("token_count"), chosen.alias("_chosen"), F.array_join(tokens, " ").alias("_said"))
    whole = rows.join(keys, "doc", "left")
    searchable = F.when(F.col("_chosen") & (F.col("_said") != ""), F.concat("text", F.lit("\n"), F.col("_said"))).otherwise(F.col("text"))
    return whole.select("doc", "language", "text", "token_count", F.when(F.col("_chosen"), F.coalesce("keys", F.array().cast("array<string>"))).alias("keywords"), searchable.alias("searchable"))
