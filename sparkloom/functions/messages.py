"""Confidential parts of nested messages: the texts in a JSON tree are redacted with numbers that all of them share.

A message's strings are found where they stand in the JSON, with the field they belong to; fields that say how a message is built,
and payloads, stay. The texts go through one redaction as a list, and are put back in their places, so all else in a message
(numbers, order and spelling of fields, white space) stays byte for byte.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions import text as X
from sparkloom.functions import vectorised as V

# --- Fixed values: fields whose texts stay ---
STRUCTURAL = {"role", "type", "media_type", "mime_type", "finish_reason", "tool_name", "tool_call_id", "id"}
PAYLOAD = {"data", "b64_json", "image", "images"}
# --- end of fixed values ---

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\],:]', re.DOTALL)
LEAF = T.ArrayType(T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def leaves(message: str) -> list[tuple[int, int, str]]:
    """(begin, end, text) of the strings of a JSON text that may be redacted; a text that isn't JSON is one string, as a whole.

    A string belongs to the nearest field around it, through lists as well; at the top that is `content`.
    """
    try:
        json.loads(message)
    except (ValueError, RecursionError):
        return [(0, len(message), message)]
    found, field = [], "content"
    around: list[tuple[str, bool]] = []  # the field outside each open bracket, and whether that bracket is an object's
    name = False  # the next string names a field
    for m in _TOKEN.finditer(message):
        sign = m[0]
        if sign in "{[":
            around.append((field, sign == "{"))
            name = sign == "{"
        elif sign in "}]":
            field = around.pop()[0]
            name = False
        elif sign == ",":
            name = around[-1][1]
        elif sign == ":":
            name = False
        elif name:
            field = json.loads(sign, strict=False)
        else:
            text, key = json.loads(sign, strict=False), field.strip().lower()
            if not (key in STRUCTURAL or key in PAYLOAD or (key == "url" and text.startswith("data:"))):
                found.append((*m.span(), text))
    return found


#: Characters of messages that are held as Python texts at once.
CHARACTERS = 1 << 21


def _parts(batch: pa.RecordBatch, message: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole messages with about `CHARACTERS` bytes each, besides one longer message."""
    ends = np.cumsum(pc.binary_length(batch.column(message)).to_numpy(zero_copy_only=False).astype(np.int64))
    starts = np.flatnonzero(np.diff(ends // CHARACTERS, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=False):
        yield batch.slice(a, b - a)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, message, found) of rows (row, message)."""
    for batch in (part for whole in batches for part in _parts(whole, 1)):
        found = [leaves(m.as_py()) for m in batch.column(1)]
        offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
        columns = [pa.array([x[k] for f in found for x in f], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, names=["begin", "end", "text"]))], names=["row", "message", "found"])
        del found, columns
    pa.default_memory_pool().release_unused()


def rebuilt(message: str, changed: list[dict]) -> str:
    """A message with other texts in their places (begin, end, text); a `plain` one isn't JSON, so its text isn't quoted."""
    out, at = [], 0
    for f in changed:
        out += [message[at : f["begin"]], f["text"] if f["plain"] else json.dumps(f["text"], ensure_ascii=False)]
        at = f["end"]
    return "".join(out) + message[at:]


def _put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, message) of rows (row, message, changed)."""
    for batch in (part for whole in batches for part in _parts(whole, 1)):
        new = [rebuilt(m.as_py(), c.as_py()) for m, c in zip(*batch.columns[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row", "message"])
    pa.default_memory_pool().release_unused()


def redacted(rows: DataFrame, column: str, terms: tuple[str, ...] = (), expressions: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with the confidential parts of a JSON message as <KIND_n>; equal parts of a message have one number, in whatever string they stand.

    A null message becomes an empty text; one that isn't JSON is redacted as a whole. Other columns stay. Messages are taken apart and put
    together some at a time, and only texts that change go back to their places.
    """
    rest = [c for c in rows.columns if c != column]
    given = rows.select(F.struct(*rest, F.lit(0).alias("")).alias("row"), X.text(column).alias("message"))
    schema = T.StructType([given.schema["row"], T.StructField("message", T.StringType())])
    found = given.mapInArrow(_found, T.StructType([*schema, T.StructField("found", LEAF)]))
    found = found.withColumn("texts", V.redact_all(F.transform("found", lambda x: x["text"]), terms, expressions))
    edits = F.zip_with("found", "texts", lambda x, t: F.when(x["text"] != t, F.struct(x["begin"].alias("begin"), x["end"].alias("end"), t.alias("text"), (x["text"] == F.col("message")).alias("plain"))))
    done = found.select("row", "message", F.filter(edits, lambda e: e.isNotNull()).alias("changed")).mapInArrow(_put, schema)
    return done.select(*[F.col("message").alias(c) if c == column else F.col("row").getField(c).alias(c) for c in rows.columns])
