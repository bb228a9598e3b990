"""Packing, token files and sentencepiece encoding against the libraries themselves."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm import packing, sentencepieces, token_files
from sparkloom.llm.common import shared_path
from sparkloom.llm.elias_fano import EliasFano
from sparkloom.llm.tokens import BYTE_LEVEL, WORD_END, TextEncoder

WORD, BYTES, PIECES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXTS = st.text(alphabet=st.sampled_from(list(" \n\t\r\x0b\x1c\x85\xa0 aAbeéßΣ中😀'.,!<|endoftext>0179s▁́")), max_size=60)


@pytest.mark.parametrize(("path", "cut"), [(WORD, WORD_END), (BYTES, BYTE_LEVEL)])
def test_pieces_give_the_librarys_ids(path, cut):
    ours, library = TextEncoder(path, cut), Tokenizer.from_file(path)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(text):
        want = np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert ours.encode([text, None]) == [want, b""]

    check()


def test_forgotten_pieces_are_encoded_again():
    ours = TextEncoder(WORD, WORD_END, remembered=2, longest=3)
    assert ours.encode(["alpha beta gamma delta"]) == ours.encode(["alpha beta gamma delta"])


def test_agenda_gives_the_librarys_ids():
    ours, library = sentencepieces.Agenda(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)

    @settings(max_examples=300, deadline=None)
    @given(TEXTS)
    def check(text):
        assert np.frombuffer(ours.encode([text])[0], "<u4").tolist() == [1, *library.encode(text), 2]

    check()


@given(st.lists(st.integers(1, 50), max_size=300), st.integers(1, 8))
@settings(deadline=None)
def test_best_fit_places_without_overlap(lengths, bins):
    fit, used = packing.BestFit(50, bins), {}
    for n in lengths:
        seq, at = fit.place(n)
        assert at == used.get(seq, 0)
        used[seq] = at + n
        assert used[seq] <= 50
        assert fit.opened <= bins and fit.opened == sum(map(len, fit.bins))


@pytest.mark.parametrize("n", [0, 51])
def test_best_fit_refuses_other_lengths(n):
    with pytest.raises(ValueError):
        packing.BestFit(50, 2).place(n)


def test_packing(make_docs, odd_texts):
    library = Tokenizer.from_file(WORD)
    rows = packing.pack(make_docs(odd_texts), WORD, capacity=64).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    texts = {}
    for i, t in odd_texts:
        texts.setdefault(i, []).append(t)
    for doc, found in by_doc.items():
        want = [i for t in texts[doc] for i in [*library.encode(t or "", add_special_tokens=False).ids, 1]]
        if len(texts[doc]) == 1:
            got = [i for r in sorted(found, key=lambda r: r.piece) for i in np.frombuffer(bytes(r.ids), "<u4")]
            assert got == want
            assert [r.length for r in sorted(found, key=lambda r: r.piece)][:-1] == [64] * (len(found) - 1)
        assert sum(r.length for r in found) == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_of_nothing(make_docs):
    assert packing.pack(make_docs([]), WORD).count() == 0


@given(st.lists(st.integers(0, 10_000), max_size=600), st.data())
@settings(deadline=None, max_examples=60)
def test_elias_fano_round_trip(values, data):
    values = np.sort(np.array(values, np.int64))
    coded = EliasFano.from_bytes(EliasFano.of(values).to_bytes())
    assert coded.values().tolist() == values.tolist()
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert coded.values(a, b).tolist() == values[a:b].tolist()


def test_elias_fano_refuses_disorder():
    with pytest.raises(ValueError):
        EliasFano.of(np.array([2, 1]))


def test_elias_fano_is_small():
    values = np.sort(np.random.default_rng(1).integers(0, 1 << 30, 10_000))
    assert len(EliasFano.of(values).to_bytes()) < 10_000 * (2 + 18) / 8 + 600


@pytest.mark.parametrize("id_bytes", [2, 4])
def test_token_files(spark, make_docs, odd_texts, id_bytes):
    path = shared_path(spark, "files")
    manifest = token_files.write(make_docs(odd_texts), path, BYTES, id_bytes=id_bytes)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r.start)
    assert manifest.count() >= 1
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 4, 5, 6, 7, 7]
    library, texts, at = Tokenizer.from_file(BYTES), dict(odd_texts), 0
    for r in rows:
        ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, np.frombuffer(bytes(r.ids), "<u4").tolist()) == (at, len(ids), ids)
        at += len(ids)


def test_token_files_of_nothing(spark, make_docs):
    path = shared_path(spark, "files")
    assert token_files.write(make_docs([]), path, BYTES).count() == 0
    assert token_files.read(spark, path).count() == 0


def test_sentencepieces(make_docs, odd_texts):
    library, texts = sentencepiece.SentencePieceProcessor(model_file=PIECES), dict(odd_texts)
    rows = sentencepieces.decode(sentencepieces.encode(make_docs(odd_texts), PIECES), PIECES).collect()
    assert len(rows) == len(odd_texts)
    for r in rows:
        ids = [1, *library.encode(texts[r.doc_id] or ""), 2]
        assert (r.n_tokens, r.ids_sha256, r.decoded) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), library.decode(ids))


def test_query_columns(spark):
    from sparkloom.llm import queries

    out = queries.op1_best_fit_packing(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    library = Tokenizer.from_file(WORD)
    first = out.filter("doc_id = 3 and piece = 0").first()
    text = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id = 3").first().text
    ids = [*library.encode(text, add_special_tokens=False).ids, 1][: first.length]
    assert first.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
