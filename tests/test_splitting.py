"""Recursive splitting against the rule on plain strings, on odd texts and on the whole small table."""

import hashlib

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloom.operators import splitting as S
from sparkloom.plans import registry

SF = "/root/testdata/sf0.001"
registry.load_all()


def plain(text, size, overlap, separators):
    """The rule on lists of strings: split, keep the separator in front, merge what is short, go deeper into what is long."""
    for k, sep in enumerate(separators):
        if sep == "" or sep in text:
            break
    else:
        k, sep = len(separators), None
    if sep is None:
        pieces = [text] if text else []
    elif sep == "":
        pieces = list(text)
    else:
        head, *tail = text.split(sep)
        pieces = [p for p in [head, *(sep + t for t in tail)] if p]
    rest = [] if not sep else separators[k + 1 :]
    out, short = [], []

    def flush():
        window: list[str] = []
        for p in short:
            if window and len("".join(window)) + len(p) > size:
                out.append("".join(window).strip())
                while window and (len("".join(window)) > overlap or len("".join(window)) + len(p) > size):
                    window.pop(0)
            window.append(p)
        if window:
            out.append("".join(window).strip())
        short.clear()

    for p in pieces:
        if len(p) < size:
            short.append(p)
        else:
            flush()
            out.extend(plain(p, size, overlap, rest) if rest else [p])
    flush()
    return [x for x in out if x]


TEXT = st.text(alphabet=st.sampled_from(list("ab \n.。;é")), max_size=120)


@given(TEXT, st.integers(1, 30), st.integers(0, 40), st.sampled_from([S.PLAIN, S.CODE, S.MIXED, ["\n", " "], []]))
@settings(max_examples=400, deadline=None)
def test_spans_follow_the_rule(text, size, overlap, separators):
    size, overlap = S.sizes(size, overlap)
    found = list(S.chunks_of(text, size, overlap, separators))
    assert [c for _, c in found] == plain(text, size, overlap, separators)
    assert all(text[a : a + len(c)] == c for a, c in found)


def nested(rows, separators_of):
    out = set()
    sha = lambda s, n: hashlib.sha1(s.encode()).hexdigest()[:n]
    for r in rows:
        separators = separators_of(r)
        for i, parent in enumerate(plain((r["text"] or "").strip(), 1500, 200, separators)):
            parent = parent.strip()
            pid = f"parent-{sha(f'{r["source"]}|{r["doc_id"]}|{i}|{sha(parent, 12)}', 16)}"
            for j, child in enumerate(plain(parent, 600, 120, separators)):
                child = child.strip()
                if child:
                    out.add((r["doc_id"], pid, j, f"chunk-{sha(f'{r["source"]}||{pid}|{i}|{j}||{sha(child, 16)}', 16)}", hashlib.md5(child.encode()).hexdigest()))
    return out


def test_recursive_query_on_the_whole_small_table(spark):
    rows = registry.QUERIES["chunk_recursive"](spark, SF).collect()
    want = nested(pq.read_table(f"{SF}/documents.parquet").to_pylist(), lambda r: S.PLAIN)
    assert {(r.doc_id, r.parent_id, r.child_index, r.chunk_id, r.digest) for r in rows} == want and len(rows) == len(want)
    assert {r.chunk_id for r in rows} == {r.chunk_id for r in registry.QUERIES["chunk_recursive"](spark, SF).collect()}


def test_typed_query_on_the_whole_small_table(spark):
    lists = [S.MARKDOWN, S.CODE, S.PDF, S.MIXED]

    def separators(r):
        k = int(hashlib.sha256(f"kind|{r['doc_id']}".encode()).hexdigest()[:8], 16) % 4
        text = r["text"] or ""
        han = sum("一" <= c <= "鿿" for c in text)
        every = han + sum(c.isascii() and c.isalnum() for c in text)
        return S.PDF_CHINESE if k == 2 and (not every or han > 0.2 * every) else lists[k]

    rows = registry.QUERIES["chunk_typed"](spark, SF).collect()
    want = nested(pq.read_table(f"{SF}/documents.parquet").to_pylist(), separators)
    assert {(r.doc_id, r.parent_id, r.child_index, r.chunk_id, r.digest) for r in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("overlap", [999, 0])
def test_odd_texts_and_clashing_columns(spark, overlap):
    texts = [None, "", " \n ", "abcdefg " * 120, "x" * 95, "第一段。\n\n第二段。 " * 10, "a"]
    docs = spark.createDataFrame([(i, t, "old", 7, "kept") for i, t in enumerate(texts)], "doc_id long, text string, chunk string, begins int, row string")
    rows = S.split(docs, 20, overlap).collect()
    assert {r.doc_id for r in rows} == {3, 4, 5, 6} and {r.row for r in rows} == {"kept"} and all(len(r.chunk) <= 20 for r in rows)
    for i in (3, 4, 5, 6):
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.chunk_index)
        assert [r.chunk for r in mine] == plain(texts[i], *S.sizes(20, overlap), S.PLAIN) and [r.chunk_index for r in mine] == list(range(len(mine)))
        assert all(texts[i][r.begins : r.begins + len(r.chunk)] == r.chunk for r in mine)
    assert S.split(docs.limit(0), 20, 5).count() == 0


def test_children_name_their_parents(spark):
    docs = spark.createDataFrame([(1, "这是第一段。这里有一些信息。\n\n这是第二段。这里有更多信息。 " * 10, "demo.md"), (1, "short", "demo.md"), (2, None, None)], "doc_id long, text string, source string")
    up = S.parents(docs, 120, 20)
    down = S.children(up, 60, 10)
    assert {r.parent_id for r in down.collect()} == {r.parent_id for r in up.collect()}
    assert up.filter("doc_id = 2").count() == 0
