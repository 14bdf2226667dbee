"""Problem 6: composition against the Unicode reference, and the rules of the plain form."""

from __future__ import annotations

import random
import unicodedata

import pyarrow as pa
import pytest

from wordloom.llm import charforms as c


def plain(*texts):
    return c.plain_array(pa.array(list(texts), pa.string())).to_pylist()


def test_composition_is_canonical():
    rng = random.Random(1)
    pool = [chr(x) for x in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x300, 0x345), *range(0x300, 0x345), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3), 0xAC00, 0xAC01, 0x9C7, 0x9BE, 0x9D7, 0x1E9B, 0x323, 0x307, 0x212B, 0x2126]]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 9))) for _ in range(20_000)]
    expand = lambda t: "".join(c._expansion(ord(x), x) for x in t)
    assert plain(*texts) == [unicodedata.normalize("NFC", expand(t)).strip() for t in texts]


@pytest.mark.parametrize(
    ("text", "form"),
    [
        ("ｄｏｎ＇ｔ", "don't"), ("２５０", "250"), ("élan", "élan"), ("ko‌̈ln", "köln"), ("﻿a­", "a"), ("to ", "to"), ("a b", "a b"), ("uh‑huh", "uh-huh"), ("well‐known", "well-known"),
        ("thе", "the"), ("Ηоme", "Home"), ("it'ѕ", "it's"), ("Réѕumе́", "Résumé"), ("ﬁnal", "final"), ("diﬃcult", "difficult"), ("Kahar", "Kahar"), ("площадь", "площадь"), ("νερό", "νερό"), ("а-", "а-"),
        ("площадь sо", "площадь so"), ("♪♪", "♪♪"), ("", ""), ("​ 　", ""), (" x ", "x"), (None, None), ("THE", "THE"), ("…", "…"), ("m²", "m²"),
    ],
)
def test_plain_form(text, form):
    assert plain(text) == [form]


def test_slices_chunks_and_length():
    a = pa.array(["x", "ｙ", None, "é" * 100_000, ""])
    assert c.plain_array(a.slice(1, 3)).to_pylist() == ["y", None, "é" * 100_000]
    assert c.plain_array(pa.chunked_array([a.slice(0, 1), a.slice(4, 1)])).to_pylist() == ["x", ""]
    assert c.plain_array(pa.array([], pa.string())).to_pylist() == []


def test_changed(spark):
    schema = "row_id long, token string, text string, tbl string, plain string"
    rows = [(1, "the", "", "", ""), (2, " the ", "", "", ""), (3, "thе", "", "", ""), (3, "thе", "", "", ""), (4, None, "", "", ""), (5, " ", "", "", ""), (6, "площадь", "", "", ""), (7, " x", "", "", "")]
    got = sorted((r.row_id, r.plain) for r in c.changed(spark.createDataFrame(rows, schema), "row_id", "token", "t").collect())
    assert got == [(3, "the"), (3, "the"), (5, ""), (7, "x")]
    assert c.changed(spark.createDataFrame([], schema), "row_id", "token", "t").count() == 0


def test_final_line_terminators_are_not_ordinary(spark):
    texts = ["ab\n", "ab\r\n", "ab\u0085", "ab\u2028", "ab", " ab "]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, token string")
    got = {r.row_id: r.plain for r in c.changed(df, "row_id", "token", "t").collect()}
    assert got == dict.fromkeys(range(4), "ab")
    assert [r.p for r in df.orderBy("row_id").select(c.plain(df.token).alias("p")).collect()] == ["ab"] * 6
