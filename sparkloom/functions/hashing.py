"""Stable ids and buckets from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _joined(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def chunk_id(source: Column, page: Column, parent: Column, text: Column, *places: Column) -> Column:
    """chunk- and 16 hex digits over source, page, parent, places within the parent (if any) and a digest of the text."""
    return F.concat(F.lit("chunk-"), F.substring(F.sha1(_joined(source, page, parent, *places, F.substring(F.sha1(F.coalesce(text, F.lit(""))), 1, 16))), 1, 16))


def parent_id(source: Column, document: Column, index: Column, text: Column | None = None) -> Column:
    """parent- and 12 hex digits over source, document and place; with its text, 16 over a digest of that too."""
    if text is None:
        return F.concat(F.lit("parent-"), F.substring(F.sha1(_joined(source, document, index)), 1, 12))
    return F.concat(F.lit("parent-"), F.substring(F.sha1(_joined(source, document, index, F.substring(F.sha1(text), 1, 12))), 1, 16))


def document_id(owner: Column, source: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(F.sha1(_joined(owner, source)), 1, 16))


def bucket(*parts: Column, buckets: int = 100) -> Column:
    """The first 32 bits of a sha256, modulo `buckets`: canary, shadow and feature shares."""
    return (F.conv(F.substring(F.sha2(_joined(*parts), 256), 1, 8), 16, 10).cast("long") % buckets).cast("int")
