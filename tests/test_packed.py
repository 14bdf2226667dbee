"""Problem 2: against a separate hand-written scanner, and edge cases."""

from __future__ import annotations

import random

from wordloom.operators.packed import infer_delimiters, long_form, unpack

SCHEMA = "row_id long, labels string, wer_tags string, _bare string, field string"


def scan(text):
    """Values of a packed text, read character by character."""
    s = (text or "").strip()
    if s[:1] in ("[", "(") and s[-1:] in ("]", ")"):
        s = s[1:-1].strip()
    out, i, after_mark = [], 0, True
    while i < len(s):
        c = s[i]
        if c in "'\"" and after_mark:
            value, i = "", i + 1
            while i < len(s):
                if s[i] == "\\" and i + 1 < len(s):
                    value, i = value + s[i + 1], i + 2
                elif s[i] == c and s[i + 1 : i + 2] == c:
                    value, i = value + c, i + 2
                elif s[i] == c:
                    i += 1
                    break
                else:
                    value, i = value + s[i], i + 1
            out.append(value.strip())
            after_mark = False
        elif c in ",;|/\t ":
            i, after_mark = i + 1, True
        else:
            j = i
            while j < len(s) and s[j] not in ",;|/\t ":
                j += 1
            out.append(s[i:j])
            i, after_mark = j, False
    return [v for v in out if v]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, None, "extra", "clash") for i, t in enumerate(texts)], SCHEMA)


def test_against_scanner(spark):
    rng = random.Random(2)
    words = ["CARDINAL", "ORG", "WORK_OF_ART", "SPACY>ORG"]
    odd = ["LAW, STATUTE", "PLACE; REGION", "ORG | UNIT"]
    texts = []
    for _ in range(400):
        values = [f"{rng.randint(0, 30)}:{rng.choice(words)}" for _ in range(rng.randint(1, 4))]
        quoted = [f"{rng.randint(0, 9)}:{rng.choice(words + odd)}" for _ in range(rng.randint(1, 4))]
        texts += [
            "[" + ",".join(f"'{v}'" for v in quoted) + "]", "[" + ", ".join(f'"{v}"' for v in quoted) + "]", ";".join(f'"{v}"' for v in quoted), "(" + ", ".join(f"'{v}'" for v in quoted) + ",)",
            "['" + "' '".join(quoted) + "']", ";".join(values), " / ".join(values), "[" + " | ".join(values) + "]", "\t".join(values), ", ".join(values), "; ".join(values) + ";", "['" + "',,'".join(quoted) + "']",
        ]
    got = {}
    for r in unpack(rows_of(spark, texts), "row_id", ["labels", "wer_tags"]).collect():
        got.setdefault(r.row_id, {})[r.idx] = r.val
    expected = {i: dict(enumerate(scan(t), 1)) for i, t in enumerate(texts) if len(scan(t)) > 1}
    assert got == expected


def test_quotes_escapes_and_edges(spark):
    texts = ["['0:HOUR O''CLOCK', '1:X']", r"['0:HOUR O\'CLOCK', '1:X']", '"0:HOUR O\'CLOCK";"1:X"', None, "", "  ", "[]", "[,,]", "0:X", "['0:X']", "['0:X','0:X']", "[ '0:A' , '0:B' ]", "['" + "',' ".join(f"{i}:A" for i in range(5000)) + "']"]
    got = {}
    for r in unpack(rows_of(spark, texts), "row_id", ["labels", "wer_tags"]).collect():
        got.setdefault(r.row_id, []).append((r.idx, r.val))
    o = [(1, "0:HOUR O'CLOCK"), (2, "1:X")]
    assert [sorted(got.get(i, [])) for i in range(3)] == [o, o, o]
    assert all(i not in got for i in range(3, 10))
    assert sorted(got[10]) == [(1, "0:X"), (2, "0:X")]
    assert sorted(got[11]) == [(1, "0:A"), (2, "0:B")]
    assert len(got[12]) == 5000


def test_delimiter_is_inferred_per_source(spark):
    texts = ["1 2 3", "1 2", "4,5", "6, 7", "7", "[1 | 2]"] * 3
    best = {(r._layout, r.delimiter) for r in infer_delimiters(long_form(rows_of(spark, texts), "row_id", ["labels"])).collect()}
    assert {d for _, d in best} == {"blank", "comma", "bar"}


def test_empty_table(spark):
    assert unpack(spark.createDataFrame([], SCHEMA), "row_id", ["labels", "wer_tags"]).count() == 0
    assert unpack(rows_of(spark, ["a", "b"]), "row_id", ["labels"], least=1).count() == 2
