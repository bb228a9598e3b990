"""Lexical and dense retrieval, fusion, re-ranking and parent expansion over batches of queries.

Every ranking has an explicit tiebreak: equal scores go by ascending id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as D

from sparkloom.functions import text as T
from sparkloom.sources.shared import written_once

K1, B, EPSILON = 1.5, 0.75, 0.25


def scoped(docs: DataFrame, allowed: list[str] | None, column: str = "source", required: bool = True) -> DataFrame:
    """Rows of the allowed sources. None raises an error where a scope is required; an empty list gives no rows."""
    if allowed is None:
        if required:
            raise ValueError("a source scope is required")
        return docs
    return docs.filter(F.col(column).isin(allowed)) if allowed else docs.filter(F.lit(False))


def ranked(rows: DataFrame, keys: list[str], score: str, tiebreak: str, k: int | Column | None = None) -> DataFrame:
    """`rank` from 1 within `keys`, the highest score first; at most k rows of each (a number, or a column)."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tiebreak))))
    return out if k is None else out.filter(F.col("rank") <= k)


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc"), T.tokens(text_col).alias("w")).withColumn("length", F.size("w"))


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, w, length) of all texts, cut into tokens once and written, for several searches; for one, cutting anew was quicker than writing."""
    return written_once(_words(docs, id_col, text_col), "tokens")


#: Terms of queries, each counted for its query, up to which they go to all tasks; queries of one table of scores; its additions at a time.
SENT_TERMS, TOGETHER, ADDED = 1 << 18, 256, 1 << 21


def _sent(words: DataFrame, asked: DataFrame) -> bool:
    """Whether the queries are few enough to go to all tasks, and each document is one row with a number as id."""
    numbers = isinstance(words.schema["doc"].dataType, D.IntegralType) and isinstance(asked.schema["query"].dataType, (D.IntegralType, D.StringType))
    return numbers and asked.limit(SENT_TERMS + 1).count() <= SENT_TERMS and words.groupBy("doc").count().filter("count > 1 or doc is null").isEmpty()


def _scored_in_place(words: DataFrame, weights: DataFrame, k: int, decimals: int, held: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(query, doc, score): each task's k best of each query by the sum of weight x held(occurrences, length) over the query's terms.

    `weights` (query, term, weight) goes to all tasks. A task adds up the scores of its own documents and gives back only the best of
    them, so neither occurrences nor pairs of query and document are shuffled.
    """
    by_query: dict = {}
    for r in weights.select("query", "term", "weight").toLocalIterator():
        by_query.setdefault(r["query"], []).append((r["term"], r["weight"]))
    asked, blocks = list(by_query), []
    for a in range(0, len(asked), TOGETHER):
        rows = sorted((t, q, w) for q, x in enumerate(asked[a : a + TOGETHER]) for t, w in by_query[x])
        terms, first = np.unique(np.array([t for t, _, _ in rows], object), return_index=True)
        blocks.append((asked[a : a + TOGETHER], list(terms), np.append(first, len(rows)), np.array([q for _, q, _ in rows]), np.array([w for _, _, w in rows])))

    def scores(row: np.ndarray, term: np.ndarray, value: np.ndarray, n: int, block: tuple) -> np.ndarray:
        ids, _, first, queries, weight = block
        times = first[term + 1] - first[term]
        of = np.repeat(np.arange(len(term)), times)
        at = np.arange(len(of)) + np.repeat(first[term] - (np.cumsum(times) - times), times)
        return np.bincount(row[of] * len(ids) + queries[at], value[of] * weight[at], n * len(ids)).reshape(n, len(ids))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [pa.array(b[1], pa.string()) for b in blocks]
        # of each block: query, score and document of the best so far, and score and document that a full list ends with
        kept = [(np.zeros(0, int), np.zeros(0), np.zeros(0, "<i8")) for _ in blocks]
        floors = [(np.zeros(len(b[0])), np.full(len(b[0]), np.iinfo("<i8").min)) for b in blocks]
        for batch in batches:
            lists, length, docs = (batch.column(c) for c in ("w", "length", "doc"))
            ends = lists.offsets.to_numpy()
            flat, length, docs = lists.values.slice(ends[0], ends[-1] - ends[0]), length.to_numpy(), docs.to_numpy()
            of = np.repeat(np.arange(len(docs)), np.diff(ends))
            for i, block in enumerate(blocks):
                found = pc.fill_null(pc.index_in(flat, value_set=sets[i]), -1).to_numpy()
                key, tf = np.unique((of * len(sets[i]) + found)[found >= 0], return_counts=True)
                if not len(key):
                    continue
                row, term = np.divmod(key, len(sets[i]))
                value = held(tf, length[row])
                parts = np.cumsum(block[2][term + 1] - block[2][term]) // ADDED  # whole documents, about as many additions each
                starts = np.unique(np.searchsorted(row, row[np.flatnonzero(np.diff(parts, prepend=-1))]))
                for a, b in zip(starts, [*starts[1:], len(row)], strict=True):
                    here, place = np.unique(row[a:b], return_inverse=True)
                    s, d, (low, last) = np.round(scores(place, term[a:b], value[a:b], len(here), block), decimals), docs[here].astype("<i8"), floors[i]
                    r, q = np.nonzero((s > low) | ((s == low) & (d[:, None] < last)))
                    q, s, d = (np.concatenate(x) for x in zip(kept[i], (q, s[r, q], d[r]), strict=True))
                    order = np.lexsort((d, -s, q))
                    q, s, d = q[order], s[order], d[order]
                    rank = np.arange(len(q)) - np.searchsorted(q, q)
                    kept[i] = tuple(x[rank < k] for x in (q, s, d))
                    full = rank == k - 1
                    low[q[full]], last[q[full]] = s[full], d[full]
        for (ids, *_), (q, s, d) in zip(blocks, kept, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in q], pa.string() if text else pa.int64()), pa.array(d), pa.array(s)], ["query", "doc", "score"])

    kind, doc = weights.schema["query"].dataType, words.schema["doc"].dataType
    text = isinstance(kind, D.StringType)
    found = words.select("doc", "w", "length").mapInArrow(best, f"query {'string' if text else 'long'}, doc long, score double")
    return found.select(F.col("query").cast(kind).alias("query"), F.col("doc").cast(doc).alias("doc"), "score")


def bm25(docs: DataFrame, queries: DataFrame, k: int = 6, *, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text", decimals: int = 8, words: DataFrame | None = None) -> DataFrame:
    """(query, doc, score, rank) of the k best documents of each query by Okapi BM25, without scores of 0 or less.

    Terms that more than half of the documents hold have a negative idf, which is replaced by a quarter of the mean idf. Filter
    `docs` first to have the statistics of a scope, or give `words`, what `tokenised` made of them. Queries up to `SENT_TERMS` go to the
    documents; beyond, or where rows share an id, occurrences of query terms are grouped by document.
    """
    words = _words(docs, id_col, text_col) if words is None else words
    stats = words.agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean_length"))
    df = words.select(F.explode(F.array_distinct("w")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).select("term", "n_docs", "mean_length", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf").alias("mean_idf"))
    asked = queries.select(F.col(query_col).alias("query"), F.explode(T.tokens(text_col)).alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    wanted = asked.select("term").distinct()
    idf = raw.join(wanted, "term", "left_semi").crossJoin(F.broadcast(mean)).withColumn("idf", F.when(F.col("idf") < 0, EPSILON * F.col("mean_idf")).otherwise(F.col("idf")))
    if _sent(words, asked):
        weights = idf.join(asked, "term").select("query", "term", (F.col("times") * F.col("idf")).alias("weight"))
        average = stats.first()["mean_length"]
        out = _scored_in_place(words, weights, k, decimals, lambda tf, length: tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average)))
        return ranked(out, ["query"], "score", "doc", k)
    tf = words.select("doc", "length", F.explode("w").alias("term")).join(wanted, "term", "left_semi").groupBy("doc", "length", "term").agg(F.count("*").alias("tf"))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scores = tf.join(idf, "term").join(asked, "term").groupBy("query", "doc").agg(F.round(F.sum(part), decimals).alias("score"))
    return ranked(scores, ["query"], "score", "doc", k).filter("score > 0")


def overlap_search(docs: DataFrame, queries: DataFrame, k: int = 6, *, id_col: str = "doc_id", query_col: str = "item_id", text_col: str = "text", words: DataFrame | None = None) -> DataFrame:
    """As `bm25`, by the number of distinct query tokens that a document holds."""
    terms = queries.select(F.col(query_col).alias("query"), F.explode(F.array_distinct(T.tokens(text_col))).alias("term"))
    words = _words(docs, id_col, text_col) if words is None else words
    if _sent(words, terms):
        out = _scored_in_place(words, terms.withColumn("weight", F.lit(1.0)), k, 0, lambda tf, length: np.ones(len(tf)))
        return ranked(out, ["query"], "score", "doc", k)
    held = words.select("doc", F.explode(F.array_distinct("w")).alias("term"))
    scores = held.join(terms, "term").groupBy("query", "doc").agg(F.count("*").cast("double").alias("score"))
    return ranked(scores, ["query"], "score", "doc", k).filter("score > 0")


#: Bytes of query vectors up to which they go to all tasks; beyond, both sides are dealt to a grid of this width.
SENT_BYTES, GRID = 64 << 20, 16


def dense(vectors: DataFrame, queries: DataFrame, k: int = 6, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float | None = None, block: int = 1024, decimals: int = 6) -> DataFrame:
    """(query, doc, score, rank) of the k nearest vectors of each query by cosine, itself included; exact.

    Both sides go into blocks; a block of queries meets a block of vectors as one matrix product that gives back k rows a query. The
    queries' blocks go to all tasks if they are small (their size is added up first); else blocks of both sides meet in the cells
    of a grid, a block of queries in those of its row and a block of vectors in those of its column. Null and zero vectors are left out.
    """

    def blocks(df: DataFrame, prefix: str) -> DataFrame:
        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for a in range(0, len(pdf), block):
                    part = pdf.iloc[a : a + block]
                    x = np.stack(part["v"].to_numpy()).astype("<f8")
                    norm = np.linalg.norm(x, axis=1)
                    fine = norm > 0
                    if fine.any():
                        yield pd.DataFrame({f"{prefix}_ids": [part["id"].to_numpy("<i8")[fine].tobytes()], f"{prefix}_m": [(x[fine] / norm[fine, None]).tobytes()], f"{prefix}_d": [x.shape[1]]})

        rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null")
        return rows.mapInPandas(pack, f"{prefix}_ids binary, {prefix}_m binary, {prefix}_d int")

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                q, d = np.frombuffer(r.q_ids, "<i8"), np.frombuffer(r.d_ids, "<i8")
                s = np.round(np.frombuffer(r.q_m).reshape(len(q), -1) @ np.frombuffer(r.d_m).reshape(len(d), -1).T, decimals)
                order = np.lexsort((np.broadcast_to(d, s.shape), -s), axis=1)[:, :k]
                yield pd.DataFrame({"query": np.repeat(q, order.shape[1]), "doc": d[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    size = queries.agg(F.coalesce(F.sum(F.size(vector_col).cast("long") * 8), F.lit(0))).first()[0]
    if size <= SENT_BYTES:
        met = blocks(vectors, "d").join(F.broadcast(blocks(queries, "q")), F.col("q_d") == F.col("d_d"))
    else:
        cells = F.explode(F.sequence(F.lit(0), F.lit(GRID - 1)))
        rows = blocks(queries, "q").withColumns({"i": F.pmod(F.xxhash64("q_ids"), F.lit(GRID)).cast("int"), "j": cells})
        columns = blocks(vectors, "d").withColumns({"j": F.pmod(F.xxhash64("d_ids"), F.lit(GRID)).cast("int"), "i": cells})
        met = rows.join(columns, ["i", "j"]).filter("q_d = d_d")
    found = met.select("q_ids", "q_m", "d_ids", "d_m").mapInPandas(best, "query long, doc long, score double")
    out = ranked(found, ["query"], "score", "doc", k)
    return out if threshold is None else out.filter(F.col("score") >= threshold)


def relaxed(rows: DataFrame, strict: float = 0.2, loose: float = 0.05) -> DataFrame:
    """Rows at the strict threshold; of queries that have none, rows at the loose one. One pass."""
    hit = F.max((F.col("score") >= strict).cast("int")).over(Window.partitionBy("query"))
    return rows.withColumn("_hit", hit).filter((F.col("score") >= strict) | ((F.col("_hit") == 0) & (F.col("score") >= loose))).drop("_hit")


def fuse(channels: dict[str, tuple[DataFrame, float]], k: int = 60, decimals: int = 10) -> DataFrame:
    """Weighted reciprocal-rank fusion of ranked channels: (query, doc, hybrid_score, channels, a score for each channel).

    All channels are one long table that is grouped once; there is no outer join.
    """
    long = None
    for name, (rows, weight) in channels.items():
        part = rows.select("query", "doc", F.lit(name).alias("channel"), "score", (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"))
        long = part if long is None else long.unionByName(part)
    scores = [F.max(F.when(F.col("channel") == n, F.col("score"))).alias(f"{n}_score") for n in channels]
    return long.groupBy("query", "doc").agg(F.round(F.sum("part"), decimals).alias("hybrid_score"), F.array_sort(F.collect_set("channel")).alias("channels"), *scores)


def rank_features(source: Column, updated: Column, channels: Column, as_of: Column, weights: tuple[float, float, float] = (0.08, 0.07, 0.05)) -> Column:
    """Bonus for known file types, freshness within a year, and several channels."""
    low = F.lower(F.coalesce(source, F.lit("")))
    kind = F.when(low == "", 0.0).when(low.rlike(r"\.(md|pdf|docx|txt)$"), 1.0).otherwise(0.6)
    age = F.greatest(F.lit(0.0), (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 86_400e6)
    fresh = F.coalesce(F.greatest(F.lit(0.0), 1 - F.least(age / 365, F.lit(1.0))), F.lit(0.0))
    several = F.least(F.lit(1.0), F.size(F.array_distinct(channels)) / 2)
    return weights[0] * kind + weights[1] * fresh + weights[2] * several


def rerank_lexical(candidates: DataFrame, n: int = 5, decimals: int = 8) -> DataFrame:
    """Candidates (query, doc, query_text, text, hybrid_score) with rerank_score, the n best of each query.

    0.7 x share of query tokens in the text + 0.3 x hybrid score over the query's best (over 2 where that is 0.01 or less); a query
    without tokens keeps its hybrid scores.
    """
    q = F.array_distinct(T.tokens("query_text"))
    best = F.max("hybrid_score").over(Window.partitionBy("query"))
    share = F.size(F.array_intersect(q, T.tokens("text"))) / F.greatest(F.size(q), F.lit(1))
    score = F.when(F.size(q) == 0, F.col("hybrid_score")).otherwise(0.7 * share + 0.3 * F.col("hybrid_score") / F.when(best > 0.01, best).otherwise(2.0))
    return ranked(candidates.withColumn("rerank_score", F.round(score, decimals)), ["query"], "rerank_score", "doc", n)


def with_floor(candidates: DataFrame, score: str, threshold: float = 0.3, least: int = 3) -> DataFrame:
    """Candidates at or above a threshold; where fewer than `least` of a query are, its `least` best."""
    w = Window.partitionBy("query")
    place = F.row_number().over(w.orderBy(F.desc(score), "doc"))
    enough = F.count_if(F.col(score) >= threshold).over(w) >= least
    return candidates.withColumns({"_place": place, "_enough": enough}).filter(F.when(F.col("_enough"), F.col(score) >= threshold).otherwise(F.col("_place") <= least)).drop("_place", "_enough")


def expand_parents(candidates: DataFrame, parents: DataFrame) -> DataFrame:
    """The best candidate of each (query, parent_id), with its parent's text where there is one (granularity parent), else its own (child)."""
    best = Window.partitionBy("query", F.coalesce("parent_id", F.col("doc").cast("string"))).orderBy(F.desc("hybrid_score"), "doc")
    one = candidates.withColumn("_place", F.row_number().over(best)).filter("_place = 1").drop("_place")
    out = one.join(parents.select("parent_id", F.col("text").alias("parent_text")), "parent_id", "left")
    return out.withColumn("granularity", F.when(F.col("parent_text").isNull(), "child").otherwise("parent")).withColumn("text", F.coalesce("parent_text", "text")).drop("parent_text")
