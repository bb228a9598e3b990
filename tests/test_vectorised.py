"""Normalisation, numbered redaction and hashed embeddings against plain Python."""

import hashlib
import itertools
import re
import unicodedata

import numpy as np
import pytest

from sparkloom.functions import vectorised as V

SF = "/root/testdata/sf0.001"
ODD = ["你好!!!!!\n我想问：ＡＢＣ   系统？？？？", " \t\r\n\u200b\x00 ", "a,,,,b;;;;c", "aaaaaaaab\r\n\r\n\r\nccccc dddddd", "  x\t y \n\n z  ", None, "", "...a. . ..。。。。", "ﬁne\u00a0\u3000wide", "1234567890" * 3]


def plain_normalised(text):
    t = unicodedata.normalize("NFKC", text or "")
    t = re.sub(r"\r\n?", "\n", t)
    t = "".join(c for c in t if c in "\n\t" or unicodedata.category(c)[0] != "C")
    t = "\n".join(filter(None, (re.sub("[ \u3000\t]+", " ", x).strip() for x in t.split("\n"))))
    t = "".join(c if c == "\n" else c * (3 if n > 5 else n) for c, n in ((c, len(list(g))) for c, g in itertools.groupby(t))) if "\n\n" not in t else t
    return re.sub("([!?！？。．.]{2})[!?！？。．.]+", r"\1", t).strip() or None


def column(spark, texts, f):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", f("t").alias("o"))
    return [o for _, o in sorted(rows.collect())]


def test_normalised(spark):
    assert column(spark, ODD, V.normalise) == [plain_normalised(t) for t in ODD]
    assert column(spark, ODD[:3], V.normalise) == ["你好!!\n我想问:ABC 系统??", None, "a,,,,b;;;;c"]
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert column(spark, texts, V.normalise) == [plain_normalised(t) for t in texts]


def plain_redacted(text, own=()):
    """One pattern after the other; a kind's parts are numbered as they are found."""
    names = {}
    for kind, pattern in [*V.CONFIDENTIAL, *(("CUSTOM", p) for p in own)]:
        pieces, at = [], 0
        for m in re.finditer(pattern, text):
            part = m[0].strip().lower() if kind in ("EMAIL", "URL", "IP", "UUID") else m[0].strip()
            of_kind = names.setdefault(kind, [])
            if part not in of_kind:
                of_kind.append(part)
            pieces += [text[at : m.start()], f"<{kind}_{of_kind.index(part) + 1}>"]
            at = m.end()
        text = "".join([*pieces, text[at:]])
    return text


def test_redacted(spark):
    texts = [
        "Write to Ann@Example.com or ann@example.COM, see https://Internal.example.com/Run and HTTPS://internal.example.com/run.",
        "password: hunter22 and token=abc123; Bearer abcdefgh1234 then sk-secret-123456, password: hunter22",
        "from 10.1.2.3 to 10.1.2.4 by 10.1.2.3, C:\\sensitive\\ops.txt or /var/log/app.log, call +49 (30) 1234-5678",
        "id 123E4567-e89b-12d3-a456-426614174000 and 123e4567-E89B-12d3-a456-426614174000", "", "nothing here",
    ]
    assert column(spark, texts, V.redact) == [plain_redacted(t) for t in texts]
    assert column(spark, texts[:1], V.redact) == ["Write to <EMAIL_1> or <EMAIL_1>, see <URL_1> and <URL_2>"]
    table = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert column(spark, table, V.redact) == [plain_redacted(t) for t in table]
    assert column(spark, [None], V.redact) == [""]


def test_redacted_by_own_terms(spark):
    text = ["Acme and ACME Labs met acme (a+b) in room 12."]
    found = column(spark, text, lambda c: V.redact(c, ["acme", "acme labs", "(a+b)"], [r"room \d+"]))
    assert found == ["<CUSTOM_3> and <CUSTOM_1> met <CUSTOM_4> <CUSTOM_2> in <CUSTOM_5>."]  # the longest term first, so (a+b) before acme


@pytest.mark.parametrize("dimensions", [16, 384])
def test_embedded(spark, dimensions):
    texts = ["Two-part words, 中文 and a b c", "", None, "!?", "same same word"]
    for text, found in zip(texts, column(spark, texts, lambda c: V.embed(c, dimensions)), strict=True):
        want = np.zeros(dimensions)
        for t in re.findall(r"[a-z0-9_-]{2,}|[一-鿿]", (text or "").lower()) or [(text or "")[:64] or "empty"]:
            d = hashlib.blake2b(t.encode(), digest_size=16).digest()
            want[int.from_bytes(d[:4], "little") % dimensions] += (1, -1)[d[4] % 2]
        assert found == pytest.approx(want / np.linalg.norm(want))
