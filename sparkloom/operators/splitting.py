"""Splitting texts by a hierarchy of separators, and parents with children under stable ids.

A text is cut before each occurrence of the first separator it holds; a piece that is still too long is cut by the separators after
that one. Neighbouring short pieces of one cut are a run, and a run is put together again greedily, each chunk beginning with the
last whole pieces of the one before it. Pieces are places in the text and never copied: a run's pieces touch, so a chunk is the
text from its first piece to its last.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import hashing as H
from sparkloom.operators.chunks import sizes

# --- Fixed values: separators in the order in which they are tried ---
PLAIN = ["\n\n", "\n", "。", ". ", " ", ""]
MARKDOWN = ["\n## ", "\n### ", "\n\n", "\n- ", "\n* ", "\n1. ", "\n", ". ", " ", ""]
CODE = ["\nclass ", "\ndef ", "\n\n", "\n", ";", " ", ""]
PDF_CHINESE = ["\n\n", "。\n", "。", "；", "，", "\n", " ", ""]
PDF = ["\n\n", ". \n", ". ", "; ", ", ", "\n", " ", ""]
MIXED = ["\n\n", "。\n", ". \n", "。", ". ", "！", "？", "；", "\n", " ", ""]
# --- end of fixed values ---

Span = tuple[int, int]
#: Characters of chunks that are handed on at a time.
_AT_ONCE = 4_000_000
_NEW = ("chunk_index", "begins", "chunk")


def _starts(text: str, a: int, b: int, separator: str) -> list[int]:
    """Where the pieces of text[a:b] begin: at `a` and at each separator; everywhere for the empty separator."""
    if not separator:
        return list(range(a, b))
    found, at = [a], text.find(separator, a, b)
    while at >= 0:
        if at > a:
            found.append(at)
        at = text.find(separator, at + len(separator), b)
    return found


def runs(text: str, size: int, separators: list[str], a: int = 0, b: int | None = None) -> Iterator[list[Span]]:
    """In order: runs of neighbouring pieces shorter than `size`, and alone each longer piece that no further separator cuts."""
    b = len(text) if b is None else b
    if a == b:
        return
    here = next((k for k, s in enumerate(separators) if not s or text.find(s, a, b) >= 0), None)
    starts = [a] if here is None else _starts(text, a, b, separators[here])
    deeper = [] if here is None or not separators[here] else separators[here + 1 :]
    run: list[Span] = []
    for piece in zip(starts, [*starts[1:], b], strict=True):
        if piece[1] - piece[0] < size:
            run.append(piece)
            continue
        if run:
            yield run
            run = []
        if deeper:
            yield from runs(text, size, deeper, *piece)
        else:
            yield [piece]
    if run:
        yield run


def joined(run: list[Span], size: int, overlap: int) -> Iterator[Span]:
    """Chunks of a run: as many pieces as `size` holds; the next begins with the last pieces of up to `overlap` characters that leave room."""
    first = 0
    for k, (a, b) in enumerate(run):
        if first < k and b - run[first][0] > size:
            yield run[first][0], a
            while first < k and (a - run[first][0] > overlap or b - run[first][0] > size):
                first += 1
    yield run[first][0], run[-1][1]


def chunks_of(text: str, size: int, overlap: int, separators: list[str]) -> Iterator[tuple[int, str]]:
    """(begin, chunk) of a text, without white space at the ends; a piece too long to go into a run keeps its own."""
    for run in runs(text, size, separators):
        if len(run) == 1 and run[0][1] - run[0][0] >= size:
            yield run[0][0], text[slice(*run[0])]
            continue
        for a, b in joined(run, size, overlap):
            chunk = text[a:b].strip()
            if chunk:
                yield a + len(text[a:b]) - len(text[a:b].lstrip()), chunk


def separators_for(kind: Column, language: Column) -> Column:
    """The separators of a kind of file: markdown, code, pdf (in Chinese: zh), or any other."""
    lists = {n: F.array(*map(F.lit, x)) for n, x in (("markdown", MARKDOWN), ("code", CODE), ("zh", PDF_CHINESE), ("pdf", PDF), ("", MIXED))}
    pdf = F.when(language == "zh", lists["zh"]).otherwise(lists["pdf"])
    return F.when(kind == "markdown", lists["markdown"]).when(kind == "code", lists["code"]).when(kind == "pdf", pdf).otherwise(lists[""])


def split(docs: DataFrame, size: int, overlap: int, separators: list[str] | Column = PLAIN, text_col: str = "text") -> DataFrame:
    """One row per chunk: the columns but the text, chunk_index from 0, begins (place of the chunk in the text), chunk.

    A null, empty or blank text has no chunks. Columns of `docs` that are named like the new ones are replaced. An overlap of the
    size or more is a fifth of it; separators may differ by row, and a row without any is cut nowhere.
    """
    size, overlap = sizes(size, overlap)
    rest = [c for c in docs.columns if c != text_col and c not in _NEW]
    by_row = separators if isinstance(separators, Column) else F.array(*map(F.lit, separators))
    given = docs.select(F.struct(*[F.col(c) for c in rest], F.lit(0).alias("")).alias("row"), F.col(text_col).alias("text"), by_row.alias("separators"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def out(batch=batch):
                at, *columns = zip(*rows, strict=True)
                kinds = (pa.int32(), pa.int64(), pa.string())
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["row", *_NEW])

            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for k, (begin, chunk) in enumerate(chunks_of(text or "", size, overlap, batch.column(2)[i].as_py() or [])):
                    rows.append((i, k, begin, chunk))
                    held += len(chunk)
                    if held > _AT_ONCE:
                        yield out()
                        rows, held = [], 0
            if rows:
                yield out()

    schema = T.StructType([given.schema["row"], *(T.StructField(n, t()) for n, t in zip(_NEW, (T.IntegerType, T.LongType, T.StringType), strict=True))])
    return given.mapInArrow(run, schema).select(*[F.col("row").getField(c).alias(c) for c in rest], *_NEW)


def _stripped(column: str) -> Column:
    return F.regexp_replace(F.coalesce(column, F.lit("")), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def parents(docs: DataFrame, size: int = 1500, overlap: int = 200, separators: list[str] | Column = PLAIN, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, parent_index, parent_id, text): chunks without blank ones; the id is a hash of source, document, place and text."""
    by_row = separators if isinstance(separators, Column) else F.array(*map(F.lit, separators))
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), by_row.alias("separators"), _stripped(text_col).alias("text"))
    found = split(given, size, overlap, F.col("separators")).withColumn("text", _stripped("chunk")).filter("text <> ''")
    return found.select("doc_id", "source", "separators", F.col("chunk_index").alias("parent_index"), H.parent_id(F.col("source"), F.col("doc_id"), F.col("chunk_index"), F.col("text")).alias("parent_id"), "text")


def children(parents_: DataFrame, size: int = 600, overlap: int = 120) -> DataFrame:
    """(doc_id, source, parent_index, parent_id, child_index, chunk_id, text): the chunks of each of `parents`, by its separators."""
    found = split(parents_, size, overlap, F.col("separators")).withColumn("text", _stripped("chunk")).filter("text <> ''")
    key = H.chunk_id(F.col("source"), F.lit(""), F.col("parent_id"), F.col("text"), F.col("parent_index"), F.col("chunk_index"), F.lit(""))
    return found.select("doc_id", "source", "parent_index", "parent_id", F.col("chunk_index").alias("child_index"), key.alias("chunk_id"), "text")
