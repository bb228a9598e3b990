"""Normalised, redacted and embedded texts: column expressions, with Arrow-batched functions for what no built-in does (NFKC, blake2b)."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import EMBEDDING_TOKEN, let, text, tokens

# --- Fixed values: what counts as confidential, in the order in which it is looked for; kinds whose spelling doesn't count; runs of punctuation ---
CONFIDENTIAL = [
    ("SECRET", r"(?i)\b(?:api[_-]?key|token|secret|password)\s*[:=]\s*\S+\b"),
    ("SECRET", r"(?i)\bBearer\s+[A-Za-z0-9._\-]{8,}\b"),
    ("SECRET", r"\b(?:sk|rk|pk)-[A-Za-z0-9_\-]{6,}\b"),
    ("URL", r"(?i)https?://[^\s'\"<>]+"),
    ("EMAIL", r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"),
    ("IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("UUID", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"),
    ("PATH", r"\b[A-Za-z]:\\(?:[^\\\s]+\\)*[^\\\s]*"),
    ("PATH", r"/(?:[^/\s]+/)+[^/\s]+"),
    ("PHONE", r"(?<!\w)(?:\+?\d[\d()\-\s]{7,}\d)(?!\w)"),
]
ANY_CASE = ["EMAIL", "URL", "IP", "UUID"]
PUNCTUATION = r"[!?！？。．\.]{3,}"
# --- end of fixed values ---


@F.pandas_udf(T.StringType())
def _nfkc(c: pd.Series) -> pd.Series:
    return c.str.normalize("NFKC")


def normalise(c: str | Column) -> Column:
    """NFKC without control characters; spaces collapse, empty lines go, six or more of a character become three and runs of three or more
    marks (!?. and their wide forms) two; null if nothing is left."""
    t = F.regexp_replace(_nfkc(text(c)), r"\r\n?", "\n")
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\t]]", "")
    t = F.regexp_replace(t, r"[ \x{3000}\t]+", " ")
    t = F.regexp_replace(t, r"(?U)[\s\p{Z}]*\n[\s\p{Z}]*", "\n")
    t = F.regexp_replace(t, r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    t = F.regexp_replace(t, r"([^\n])\1{5,}", "$1$1$1")
    marks = f"({PUNCTUATION[:-4]}{{2}}){PUNCTUATION[:-4]}+"
    return F.nullif(F.regexp_replace(F.regexp_replace(t, marks, "$1"), r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$", ""), F.lit(""))


def own_patterns(terms: Sequence[str] = (), expressions: Sequence[str] = ()) -> list[tuple[str, str]]:
    """A caller's own terms, the longest first, and then own expressions, all in any case."""
    escaped = ["".join(x if x.isalnum() or x == "_" or ord(x) > 127 else f"\\{x}" for x in t) for t in sorted(filter(None, terms), key=len, reverse=True)]
    return [("CUSTOM", f"(?iu){p}") for p in (*escaped, *expressions)]


def _state(out: Column, kinds: list[str], found: Callable[[str], Column]) -> Column:
    return F.struct(out.alias("out"), *[found(k).alias(k) for k in kinds])


def _redacted(state: Column, steps: list[tuple[str, str]], kinds: list[str]) -> Column:
    """A text and what was found of each kind so far, after all steps; each pattern splits the text once."""

    def step(kind: str, pattern: str) -> Callable[[Column], Column]:
        p = f"(?U){pattern}"
        name = (lambda x: F.lower(F.trim(x))) if kind in ANY_CASE else (lambda x: F.trim(x))

        def numbered(s: Column) -> Column:
            names = F.transform(F.regexp_extract_all(s["out"], F.lit(p), F.lit(0)), name)
            found = F.struct(names.alias("names"), F.array_distinct(F.concat(s[kind], names)).alias("all"), F.split(s["out"], p, -1).alias("pieces"))

            def put(f: Column) -> Column:
                marks = F.transform(f["names"], lambda x: F.concat(F.lit(f"<{kind}_"), F.array_position(f["all"], x).cast("string"), F.lit(">")))
                joined = F.array_join(F.zip_with(f["pieces"], marks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
                return _state(joined, kinds, lambda k: f["all"] if k == kind else s[k])

            return F.when(F.size(names) > 0, let(found, put)).otherwise(s)

        return numbered

    for kind, pattern in steps:
        state = let(state, step(kind, pattern))
    return state


def _steps(terms: Sequence[str], expressions: Sequence[str]) -> tuple[list[tuple[str, str]], list[str]]:
    steps = [*CONFIDENTIAL, *own_patterns(terms, expressions)]
    return steps, list(dict.fromkeys(kind for kind, _ in steps))


def redact(c: str | Column, terms: Sequence[str] = (), expressions: Sequence[str] = ()) -> Column:
    """Confidential parts as <KIND_n>, kind by kind; equal parts of a text have the same number, in any case where spelling doesn't count.

    Each pattern splits the text once; its matches are numbered by their first place among all of their kind.
    """
    steps, kinds = _steps(terms, expressions)
    none = F.array().cast("array<string>")
    return _redacted(_state(text(c), kinds, lambda _: none), steps, kinds)["out"]


def redact_all(texts: Column, terms: Sequence[str] = (), expressions: Sequence[str] = ()) -> Column:
    """A list of texts redacted one after the other with numbers that they share."""
    steps, kinds = _steps(terms, expressions)
    none = F.array().cast("array<string>")
    kind = "struct<done:array<string>," + ",".join(f"{k}:array<string>" for k in kinds) + ">"

    def step(s: Column, x: Column) -> Column:
        after = _redacted(_state(text(x), kinds, lambda k: s[k]), steps, kinds)
        return let(after, lambda r: F.struct(F.concat(s["done"], F.array(r["out"])).alias("done"), *[r[k].alias(k) for k in kinds])).cast(kind)

    start = F.struct(none.alias("done"), *[none.alias(k) for k in kinds]).cast(kind)
    return F.aggregate(texts, start, step, lambda s: s["done"])


def embed(c: str | Column, dimensions: int = 384) -> Column:
    """Signed feature hashing of tokens, of length 1. A text without tokens is one token: its first 64 characters, or the word empty."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def hashed(found: pd.Series) -> pd.Series:
        words, at = np.unique(np.concatenate([np.asarray(x, object) for x in found]) if len(found) else np.zeros(0, object), return_inverse=True)
        digests = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "ignore"), digest_size=16).digest() for w in words), np.uint8).reshape(-1, 16)
        place = digests[:, :4].copy().view("<u4").ravel() % dimensions
        sign = 1.0 - 2.0 * (digests[:, 4] & 1)
        rows = np.repeat(np.arange(len(found)), [len(x) for x in found])
        out = np.zeros((len(found), dimensions))
        np.add.at(out, (rows, place[at]), sign[at])
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return pd.Series(list(out / np.where(lengths > 0, lengths, 1.0)), index=found.index)

    words = tokens(c, EMBEDDING_TOKEN)
    whole = F.coalesce(F.nullif(F.substring(text(c), 1, 64), F.lit("")), F.lit("empty"))
    return hashed(F.when(F.size(words) > 0, words).otherwise(F.array(whole)))
