"""Chunking documents: fixed windows, parents and children, sentence packing, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sizes(size: int, overlap: int) -> tuple[int, int]:
    """Size of 1 at least; an overlap of the size or more is a fifth of it instead, and less than it."""
    size, overlap = max(1, int(size)), max(0, int(overlap))
    return size, overlap if overlap < size else min(size - 1, size // 5)


def windows(text: Column, size: int, overlap: int) -> Column:
    """Windows of a text, the last of which ends with it; none of a null or empty text."""
    size, overlap = sizes(size, overlap)
    step, n = size - overlap, F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step) + 1).cast("int")
    starts = F.sequence(F.lit(0), count - 1)
    return F.when(n > 0, F.transform(starts, lambda i: F.substr(text, i * step + 1, F.lit(size))))


def chunk(docs: DataFrame, size: int, overlap: int, text_col: str = "text") -> DataFrame:
    """One row per window: the columns but the text, chunk_index from 0, chunk."""
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(windows(F.col(text_col), size, overlap)).alias("chunk_index", "chunk"))


def parents_and_children(docs: DataFrame, parent: tuple[int, int] = (1500, 200), child: tuple[int, int] = (600, 120)) -> DataFrame:
    """Windows of windows: parent_index, child_index and the child's text."""
    up = docs.select("doc_id", "source", F.posexplode(windows(F.col("text"), *parent)).alias("parent_index", "parent"))
    return up.select("doc_id", "source", "parent_index", F.posexplode(windows(F.col("parent"), *child)).alias("child_index", "text"))


def _short(c: Column, preview: int) -> Column:
    return F.when(F.length(c) > preview, F.concat(F.substr(c, F.lit(1), F.lit(preview)), F.lit("..."))).otherwise(c)


def _position(index: Column, last: Column) -> Column:
    return F.when(index == 0, "start").when(index == last, "end").otherwise("middle")


def with_neighbours(chunks: DataFrame, preview: int = 100) -> DataFrame:
    """Previews of the chunks before and after, and the position: start, middle or end; an only chunk is the start."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    last = F.max("chunk_index").over(Window.partitionBy("doc_id"))
    previous, following = F.lag("_short").over(w), F.lead("_short").over(w)
    return chunks.withColumn("_short", _short(F.col("chunk"), preview)).withColumns({"previous": previous, "next": following, "position": _position(F.col("chunk_index"), last)}).drop("_short")


def chunk_with_neighbours(docs: DataFrame, size: int, overlap: int, preview: int = 100, text_col: str = "text") -> DataFrame:
    """`chunk` and `with_neighbours` of whole documents, whose chunks find their neighbours before they are parted: no row is moved."""
    rest = [c for c in docs.columns if c != text_col]
    cut = docs.select(*rest, windows(F.col(text_col), size, overlap).alias("_cut"))
    near = lambda i: _short(F.get("_cut", i), preview)
    told = F.transform("_cut", lambda x, i: F.struct(x.alias("chunk"), near(i - 1).alias("previous"), near(i + 1).alias("next"), _position(i, F.size("_cut") - 1).alias("position")))
    return cut.select(*rest, F.posexplode(told).alias("chunk_index", "_told")).select(*rest, "chunk_index", "_told.*")


def packed_sentences(sentences: Column, size: int = 500, overlap: int = 50) -> Column:
    """Sentences put together greedily up to `size` characters; a chunk begins with the last `overlap` characters of the one before it."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s: Column, x: Column) -> Column:
        full = (s["open"] != "") & (F.length(s["open"]) + F.length(x) > size)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]).alias("done"),
            F.when(full, F.concat(F.right(s["open"], F.lit(overlap)), x)).otherwise(F.concat(s["open"], x)).alias("open"),
        )

    return F.aggregate(sentences, state, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def repeated_edge_lines(pages: DataFrame, least: int = 3, edge: int = 3) -> DataFrame:
    """(doc, line): lines of over five characters among the first or last lines of at least `least` pages of a document."""
    lines = pages.select("doc", "page", F.split("text", "\n").alias("l"))
    placed = lines.select("doc", "page", F.size("l").alias("n"), F.posexplode("l").alias("i", "line"))
    ends = placed.filter((F.col("i") < edge) | (F.col("i") >= F.col("n") - edge)).withColumn("line", F.trim("line")).filter(F.length("line") > 5)
    return ends.groupBy("doc", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key isn't there; rows without key are dropped."""
    fresh = new.filter(F.col(key).isNotNull())
    return old.filter(F.col(key).isNotNull()).join(fresh.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))
