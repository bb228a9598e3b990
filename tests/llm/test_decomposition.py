"""Power-of-two pieces against the tokenizers library, on odd texts and on the whole small table."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import decomposition
from sparkloom.llm.common import shared_path
from sparkloom.llm.queries import QUERIES

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@given(st.integers(1, 10_000), st.sampled_from([1, 2, 8, 1024]))
def test_lengths_are_falling_powers_of_two(n, capacity):
    found = decomposition.lengths(n, capacity)
    assert sum(found) == n and found == sorted(found, reverse=True)
    assert all(x & (x - 1) == 0 and x <= capacity for x in found)
    rest = [x for x in found if x < capacity]
    assert len(set(rest)) == len(rest)  # no length twice below the largest


def test_capacity_must_be_a_power_of_two(make_docs):
    with pytest.raises(ValueError, match="power of two"):
        decomposition.decompose(make_docs([]), BYTES, capacity=1000)


def check(rows, texts):
    """`texts`: (id, text); equal rows may stand for each other."""
    library = Tokenizer.from_file(BYTES)
    want = sorted(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes() for _, t in texts)
    whole, parts = [], []
    for r in sorted(rows, key=lambda r: (str(r.doc_id), r.sequence_id >> 38, r.start)):
        parts.append(r)
    by_doc: dict = {}
    for r in parts:
        by_doc.setdefault((r.doc_id, r.doc_tokens), {}).setdefault(r.start, []).append(bytes(r.ids))
    for (_, n), pieces in by_doc.items():
        copies = len(pieces[0])
        for k in range(copies):
            whole.append(b"".join(pieces[s][k] for s in sorted(pieces)))
            assert len(whole[-1]) == 4 * n
    assert sorted(whole) == want
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} <= {0}
    assert all(len(r.ids) == 4 * r.length and r.length == 1 << r.bucket and r.length <= 1024 for r in rows)


def test_odd_rows_and_extra_columns(make_docs, odd_texts):
    rows = decomposition.decompose(make_docs(odd_texts), BYTES).collect()
    check(rows, odd_texts)
    assert [(r.length, bytes(r.ids)) for r in rows if r.doc_id in (0, 1)] == [(1, b"\0\0\0\0")] * 2
    assert decomposition.decompose(make_docs([]), BYTES).count() == 0


def test_buckets_are_read_by_length(spark, make_docs, odd_texts):
    path = shared_path(spark, "buckets")
    pieces = decomposition.decompose(make_docs(odd_texts), BYTES)
    decomposition.write_buckets(pieces, path)
    for n in (1, 64, 1024):
        assert sorted(decomposition.read_bucket(spark, path, n).select("doc_id", "start", "ids").collect(), key=str) == sorted(pieces.filter(f"length = {n}").select("doc_id", "start", "ids").collect(), key=str)


def test_query_on_the_whole_small_table(spark):
    rows = QUERIES["op11_binary_pieces"](spark, "/root/testdata/sf0.001").collect()
    library = Tokenizer.from_file(BYTES)
    want = set()
    for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for size in decomposition.lengths(len(ids), 1024):
            want.add((r["doc_id"], at, size, zlib.crc32(ids[at : at + size].tobytes()), len(ids)))
            at += size
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows} == want and len(rows) == len(want)
