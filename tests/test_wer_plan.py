"""End to end: token rows, entities, timings, breakdowns and reports on golden cases."""

from __future__ import annotations

import json
from dataclasses import replace
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wordloom.operators.graphs import parse_rules
from wordloom.plans.wer import WerOptions, align_times, oracle_wer, wer
from wordloom.session import checkpointed
from wordloom.sources import readers

GOLDEN = Path(__file__).parent / "golden"


@pytest.fixture(scope="module")
def demo(spark):
    ref = readers.read_transcript(spark, str(GOLDEN / "demo.ref.nlp"), "demo")
    hyp = readers.read_transcript(spark, str(GOLDEN / "demo.hyp.ctm"), "demo")
    rules = parse_rules(readers.read_rules(spark, str(GOLDEN / "demo.rules")))
    norms = readers.read_normalisations(spark, str(GOLDEN / "demo.norm.json"))
    out = align_times(ref, hyp, rules, norms, WerOptions(add_inserts_nlp=True, speaker_switch_context=0))
    return replace(out, stitches=checkpointed(out.stitches))


def golden(name):
    return (GOLDEN / name).read_text().splitlines()


def test_demo_aligned_rows(demo):
    assert [r.line for r in demo.aligned().orderBy("seq").collect()] == golden("demo.aligned.nlp")[1:]


def test_demo_report(spark, demo):
    tags = readers.read_sidecar(spark, str(GOLDEN / "demo.tags.json"))
    assert [r.line for r in demo.side_by_side(tags).orderBy("part", "line_no").collect()] == golden("demo.sbs")


def test_demo_counts_and_json(demo):
    told = json.loads(demo.json().head().json)["wer"]
    assert {k: told["bestWER"][k] for k in ("insertions", "deletions", "substitutions", "numWordsInReference")} == {"insertions": 2, "deletions": 1, "substitutions": 1, "numWordsInReference": 13}
    assert {k: (v["numErrors"], v["numWordsInReference"]) for k, v in told["classWER"].items()} == {"NAME": (1, 2), "CARDINAL": (1, 2), "FALLBACK": (0, 0), "SYN_1-2": (1, 2)}
    assert told["unigrams"]["to"]["deletions"] == 1
    assert told["speakerWER"]["2"]["insertions"] == 1
    assert "speakerSwitchWER" not in told  # a context of 0 leaves it out
    assert {r.tag_id: (r.errors, r.n_ref) for r in demo.tags().collect()} == {"1": (1, 2), "2": (1, 2), "3": (0, 1), "4": (0, 1)}


def text(spark, *pairs):
    rows = [(u, i, w) for u, t in pairs for i, w in enumerate(t.split(), 1)]
    return spark.createDataFrame(rows, "utt_id string, pos long, token string")


def nlp(spark, *rows):
    return spark.createDataFrame([(u, i, *r) for u, part in rows for i, r in enumerate(part, 1)], "utt_id string, pos long, token string, speaker string, punctuation string, casing string, wer_tags string")


def test_speakers_switches_sentences_tags_and_case(spark):
    # The counts that these words must have.
    one = [(w, "1", "", "LC", "") for w in "a b c d e f g h i j".split()] + [(w, "2", "", "LC", "") for w in "um it's a b c d e f g h".split()]
    who = "1 1 2 1 1 1 1 1 3 3 3 3 3 3 2 2 2 2 2".split()
    two = [(w, s, "", "LC", "") for w, s in zip("a b c d e f g h i j k l m n o p q r s".split(), who, strict=True)]
    three = [("Hi", "1", "", "UC", "['0', '2']"), ("There", "1", ".", "UC", "['0']"), ("you", "2", "?", "LC", ""), ("Bye", "2", "", "UC", "")]
    ref = nlp(spark, ("one", one), ("two", two), ("three", three)).withColumns({c: F.lit("") for c in ("ts", "end_ts", "prepunctuation", "labels", "confidence")})
    hyp = text(spark, ("one", "a b c d e e f g h i j it is uh a b c d f g h i"), ("two", "a b a d e f f g h i k l m n n n o p q r"), ("three", "Hi there You so Bye"))
    rules = spark.createDataFrame([(["it's"], [["it", "is"]])], "lhs array<string>, alts array<array<string>>")
    got = wer(ref, hyp, rules, options=WerOptions(speaker_switch_context=3))
    got.stitches.persist()
    speakers = {(r.utt_id, r.speaker_id): (r.errors, r.n_ref) for r in got.speakers().collect()}
    assert speakers["one", "1"] == (1, 10)
    assert speakers["one", "2"] == (4, 11)
    assert (speakers["two", "1"], speakers["two", "2"], speakers["two", "3"]) == ((1, 7), (2, 6), (3, 6))
    switch = {r.utt_id: (r.errors, r.n_ref) for r in got.speaker_switches().collect()}
    assert switch["one"] == (1, 6)
    best = {r.utt_id: (r.errors, r.n_ref) for r in got.best().collect()}
    assert best["two"] == (6, 19)
    from wordloom.operators.metrics import speaker_switch_wer

    assert {r.utt_id: (r.errors, r.n_ref) for r in speaker_switch_wer(got.stitches, 2).collect()}["two"] == (4, 13)
    sentences = [(r.sentence, r.errors, r.n_ref) for r in got.sentences().where("utt_id = 'three'").orderBy("sentence").collect()]
    assert sentences == [(0, 0, 2), (1, 0, 1), (2, 1, 1)]
    tags = {r.tag_id: (r.errors, r.n_ref) for r in got.tags().where("utt_id = 'three'").collect()}
    assert tags == {"0": (0, 2), "2": (0, 1)}
    case = got.casing().where("utt_id = 'three'").head()
    assert (case.matching_tp, case.matching_fp, case.matching_fn) == (2, 1, 1)


def test_empty_sides_and_nulls(spark):
    ref = text(spark, ("a", "x y z"), ("c", "p q"))
    hyp = text(spark, ("b", "x y z"), ("c", "p q"))
    got = {r.utt_id: (r["ins"], r["del"], r["sub"], r["n_ref"], r.wer) for r in wer(ref, hyp).best().collect()}
    assert got["a"] == (0, 3, 0, 3, 1.0)
    assert got["b"][:4] == (3, 0, 0, 0)
    assert got["b"][4] == float("inf")
    assert got["c"] == (0, 0, 0, 2, 0.0)
    none = spark.createDataFrame([], "utt_id string, pos long, token string")
    assert wer(none, none).best().count() == 0


def test_bigrams_and_unigrams(spark):
    got = wer(text(spark, ("x", "a b c d")), text(spark, ("x", "a x c d e")))
    uni = {r.gram: (r.correct, r["del"], r.subst_fp, r.subst_fn, r["ins"]) for r in got.unigrams().collect()}
    assert uni == {"a": (1, 0, 0, 0, 0), "b": (0, 0, 0, 1, 0), "x": (0, 0, 1, 0, 0), "c": (1, 0, 0, 0, 0), "d": (1, 0, 0, 0, 0), "e": (0, 0, 0, 0, 1)}
    bi = {r.gram: (r.correct, r["del"], r.subst_fp, r.subst_fn, r["ins"]) for r in got.bigrams().collect()}
    assert bi == {"a b": (0, 0, 0, 1, 0), "a x": (0, 0, 1, 0, 0), "b c": (0, 0, 0, 1, 0), "x c": (0, 0, 1, 0, 0), "c d": (1, 0, 0, 0, 0), "d e": (0, 0, 0, 0, 1)}


def test_oracle(spark, tmp_path):
    (tmp_path / "s.txt").write_text("<eps> 0\nthis 8\nis 10\na 12\nisa 13\ntest 14\n")
    (tmp_path / "l.fst").write_text("0 1 8\n1 2 10\n1 3 13\n2 3 12\n3 4 14\n4\n")
    arcs = readers.read_transcript(spark, str(tmp_path / "l.fst"), "x", symbols=str(tmp_path / "s.txt"))
    r = oracle_wer(text(spark, ("x", "this is a test now")), arcs).head()
    assert (r["ins"], r["del"], r["sub"], r["n_ref"]) == (0, 1, 0, 5)
    with pytest.raises(ValueError, match="symbol table"):
        readers.read_transcript(spark, str(tmp_path / "l.fst"))


def test_options():
    with pytest.raises(ValueError, match="composition"):
        WerOptions(composition_approach="other")


def test_punctuation_and_case(spark):
    ref = nlp(spark, ("x", [("We", "1", "", "UC", ""), ("left", "1", ".", "LC", ""), ("<cough>", "1", "", "", ""), ("Why", "2", "?", "UC", "")])).withColumns({c: F.lit("") for c in ("ts", "end_ts", "prepunctuation", "labels", "confidence")})
    for approach in ("exact", "adapted"):
        got = wer(ref, text(spark, ("x", "we left . <cough> Why")), options=WerOptions(composition_approach=approach, use_punctuation=True, use_case=True))
        shown = [(r.ref_tok, r.hyp_tok, r.op, r.nlp_token, r.speaker, r.punctuation) for r in got.stitches.orderBy("seq").collect()]
        assert shown == [("We", "we", "sub", "We", "1", ""), ("left", "left", "cor", "left", "1", "."), (".", ".", "cor", "", "1", ""), ("<cough>", "<cough>", "cor", "<cough>", "1", ""), ("Why", "Why", "cor", "Why", "2", "?"), ("?", "<del>", "del", "", "2", "")]
