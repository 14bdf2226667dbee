"""Problem 5: shapes of bodies, and the typed tables."""

from __future__ import annotations

import json

from wordloom.operators.nested import SUPERTYPES, VARIANTS, flat_tables, parse, rows_of, state, words

C = lambda *w, **k: {"verbalization": list(w), **k}
BODIES = {
    1: {"0": {"candidates": [C("one", "two", probability=0.5), C("a b")], "class": "X"}},
    2: {"0": {"candidates": C("x")}, "1": {"candidates": {"verbalization": "lone word", "probability": "0.25"}, "class": None}},
    3: {"norm": {"7": {"candidates": [{"verbalization": [["a"], ["b", ["c"]]]}, {"verbalization": []}, {"verbalization": None}, {}]}}},
    4: {"5": {"class": "Y"}, "6": {"candidates": None}, "007": {"candidates": []}},
    5: {"1": {"candidates": [{"verbalization": [20, 1.50, True, None, {"deep": 1}]}], "meta": {"made_by": {"steps": [{"ok": True}]}}}},
    6: {"a": {"b": {"3": {"class": "Z", "candidates": [[C("n")]]}}}},
    17: {"0": {"candidates": [C("m")]}, "meta": {"by": "z"}, "more": [{"8": [{"class": "W"}, {"candidates": ["s", 2]}]}]},
    18: {"0": None, "x": {"class": "none under a name"}},
}
RAW = {7: None, 8: "", 9: "null", 10: "{}", 11: '{"0": {"candidates": [', 12: "[1, 2]", 13: '{"0": {"candidates": [{"verbalization": ["x"], "probability": NaN}]}}', 14: "  ", 15: "[" * 100_000, 16: '{"a":' * 900 + "1" + "}" * 900}
INNER = '{"2": {"candidates": [{"verbalization": "deep"}]}}'
RAW |= {
    19: '{"a":' * 1_500 + INNER + "}" * 1_500,
    20: '{"b": ' + '{"a":' * 20_000 + INNER + "}" * 20_000 + ', "9": {"candidates": "beside", "class": ' + "[" * 20_000 + "]" * 20_000 + "}}",
    21: '{"4": {"candidates": ' + "[" * 30_000 + '"in"' + "]" * 30_000 + "}}",
    22: '{"0":' * 20_000 + "}" * 20_000,
}
EXPECTED = {
    (1, "0", 1, 1, "one"), (1, "0", 1, 2, "two"), (1, "0", 2, 1, "a b"), (2, "0", 1, 1, "x"), (2, "1", 1, 1, "lone word"),
    (3, "7", 1, 1, "a"), (3, "7", 1, 2, "b"), (3, "7", 1, 3, "c"), (3, "7", 2, 0, ""), (3, "7", 3, 0, ""), (3, "7", 4, 0, ""),
    (4, "5", 0, 0, ""), (4, "6", 0, 0, ""), (4, "007", 0, 0, ""), (5, "1", 1, 1, "20"), (5, "1", 1, 2, "1.50"), (5, "1", 1, 3, "true"), (6, "3", 1, 1, "n"),
    (17, "0", 1, 1, "m"), (17, "8", 1, 1, "s"), (17, "8", 2, 1, "2"), (18, "0", 0, 0, ""),
    *((i, "2", 1, 1, "deep") for i in (19, 20)), (20, "9", 1, 1, "beside"), (21, "4", 1, 1, "in"),
}


def docs(spark, longest=10**9):
    # 1.50 must stay as written.
    rows = [(i, "r", json.dumps(b).replace("1.5,", "1.50,"), "clash") for i, b in BODIES.items()] + [(i, "r", b, "clash") for i, b in RAW.items() if len(b or "") < longest]
    return spark.createDataFrame(rows, "norm_id long, recording string, body string, variant string")


def test_words(spark):
    got = [tuple(r) for r in words(docs(spark)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == EXPECTED


def test_typed_tables(spark):
    t = flat_tables(docs(spark, 5_000))
    entities = {(r.norm_id, r.label_id): r["class"] for r in t["entities"].collect()}
    assert entities[1, "0"] == "X"
    assert entities[2, "1"] is None
    assert (entities[17, "8"], entities[18, "0"]) == ("W", None)
    assert len(entities) == 12
    p = {(r.norm_id, r.label_id, r.cand_no): r.probability for r in t["candidates"].collect()}
    kinds = {v: {(r.norm_id, r.label_id) for r in t[v].collect()} for v in VARIANTS if v != "other"}
    assert (kinds["entity_bare"], kinds["entity_uncandidated"]) == ({(4, "6"), (18, "0")}, {(4, "5")})
    assert kinds["candidate_bare"] == {(17, "8")}
    assert kinds["word_value"] == {(5, "1"), (17, "8")}
    assert t["entity_full"].columns == ["norm_id", "label_id", "class", "n_candidates"]
    # Supertypes are the unions of their variants.
    for s, (_, variants) in SUPERTYPES.items():
        assert t[s].count() == sum(t[v].count() for v in variants)
    assert (p[1, "0", 1], p[1, "0", 2], p[2, "1", 1]) == (0.5, None, 0.25)
    assert [(r.path, r.value) for r in t["others"].where("norm_id = 5").collect()] == [("meta.made_by.steps[0].ok", "true")]
    # Every child has its parent.
    assert t["words"].join(t["candidates"], ["norm_id", "label_id", "cand_no"], "left_anti").count() == 0
    assert t["candidates"].join(t["entities"], ["norm_id", "label_id"], "left_anti").count() == 0


def test_states():
    assert state({"candidates": []}) == "entity"
    assert state({"probability": 1}) == "candidate"
    # A field counts only with a member of a fitting state.
    assert state({"probability": {"x": 1}}) == "other"
    assert state({"1": {}}) == "entities"
    assert state({"x": [{"1": {"class": "A"}}]}) == "wrapper"
    assert state({"x": 1}) == "other"
    assert list(rows_of("7")) == []


def test_both_parsers_agree():
    from wordloom.operators import nested

    texts = [json.dumps(b) for b in BODIES.values()] + [b for b in RAW.values() if b and len(b) < 20_000]
    texts += ['{"a": 1, "a": 2}', '[1, -0.5e+3, true, false, null, "\\u00e9\\n"]', "[1,]", "[1 2]", '{"a" 1}', '{"a": 1,}', "{,}", "01", "tru", '"a', '{"a": "b" "c"}', " [ ] ", "[[], {}] x", "-", "1.", '{a: 1}', '["\t"]']
    for text in texts:
        try:
            want = json.loads(text, parse_int=str, parse_float=str, parse_constant=nested._no_json)
        except (ValueError, RecursionError):
            want = None
        try:
            got = nested._deep(text)
        except ValueError:
            got = None
        if want is not None or len(text) < 2_000:
            assert got == want, text
    assert parse("[" * 50_000 + "]" * 50_000) is not None


def test_empty_table(spark):
    none = docs(spark).limit(0)
    assert words(none).count() == 0
    assert flat_tables(none)["entities"].count() == 0
