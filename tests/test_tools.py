"""Readers, rules, functions, the pre-pass, SQL and streaming entry points, the command line."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import synth, tokens as fn, udtf
from wordloom.operators import graphs, metrics, prepass
from wordloom.operators.align import align_words
from wordloom.sources import readers


def one(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_readers(spark, tmp_path):
    (tmp_path / "a.nlp").write_bytes("﻿speaker|extra|token |case|ts\r\n1|x| It |UC|0.5\r\n2|y|is<é>|LC|\r\n\r\n".encode())
    rows = readers.read_nlp(spark, str(tmp_path / "a.nlp"), "u").orderBy("pos").collect()
    assert [(r.pos, r.token, r.speaker, r.casing, r.ts, r.labels) for r in rows] == [(1, "It", "1", "UC", "0.5", ""), (2, "is<é>", "2", "LC", "", "")]
    (tmp_path / "empty.nlp").write_text("token|speaker\n")
    assert readers.read_nlp(spark, str(tmp_path / "empty.nlp")).count() == 0
    (tmp_path / "a.ctm").write_text("r 1 0.5 0.25 hi 0.9\n\nr  1\t1.0 x  yo 0.8\n")
    got = readers.read_ctm(spark, str(tmp_path / "a.ctm"), "u").orderBy("pos").collect()
    assert [(r.token, r.start_ts, r.duration, r.confidence) for r in got] == [("hi", 0.5, 0.25, 0.9), ("yo", 1.0, None, 0.8)]
    (tmp_path / "b.ctm").write_text("r 1 0.5 0.25 hi\n")
    assert readers.read_ctm(spark, str(tmp_path / "b.ctm")).head().confidence == 1.0
    (tmp_path / "e.ctm").write_text("")
    assert readers.read_ctm(spark, str(tmp_path / "e.ctm")).count() == 0
    (tmp_path / "t.txt").write_text("a b\n\n c\t d")
    assert [r.token for r in readers.read_transcript(spark, str(tmp_path / "t.txt")).orderBy("pos").collect()] == ["a", "b", "c", "d"]
    (tmp_path / "n.json").write_text(json.dumps({"0": {"candidates": [{"probability": 1, "verbalization": ["a", "b"]}], "class": "X"}}))
    r = readers.read_normalisations(spark, str(tmp_path / "n.json")).head()
    assert (r.label_id, r["class"], r.candidates) == ("0", "X", [["a", "b"]])
    (tmp_path / "s.json").write_text('{"1": {"entity_type": "T"}}')
    assert [tuple(r) for r in readers.read_sidecar(spark, str(tmp_path / "s.json")).collect()] == [("1", "T")]
    with pytest.raises(Exception, match="(?i)path"):
        readers.read_sidecar(spark, str(tmp_path / "missing.json")).count()


def test_rules(spark):
    lines = ["# comment", "", "a b | c ; d e", "a b | later", "no bar", "x | y | z", " | q", "w |", None]
    df = one(spark, "line_no long, raw_line string", *enumerate(lines, 1))
    got = {" ".join(r.lhs): r.alts for r in graphs.parse_rules(df).collect()}
    assert got == {"a b": [["c"], ["d", "e"]], "w": [[]]}
    assert {r.line_no for r in graphs.rejected_rules(df).collect()} == {5, 6, 7}
    words = one(spark, "token string", ("the-",), ("a-b",), ("c",), ("-",), ("x--y",), ("___0_A-B___",), (None,))
    every = {" ".join(r.lhs): r.alts for r in graphs.all_rules(graphs.parse_rules(df), words).collect()}
    assert every == got | {"the-": [["the"]], "a-b": [["a", "b"]]}
    tokens = one(spark, "utt_id string, pos long, token string", ("u", 1, "a"), ("u", 2, "b"), ("u", 3, "a"))
    assert [(r.pos, r.lhs) for r in graphs.rule_matches(tokens, graphs.parse_rules(df)).collect()] == [(1, ["a", "b"])]


def test_functions(spark):
    r = one(spark, "t string, m string, l string", ("Éa|b|", "___23_ORD_X___", "['0:A','1:B']")).select(
        fn.lowercase(F.col("t")).alias("low"), fn.split_on(F.col("t"), "|").alias("s"), fn.label_id(F.col("m")).alias("i"), fn.label_name(F.col("m")).alias("n"), fn.best_label(F.col("l")).alias("b"),
        fn.ascii_equal(F.col("t"), F.lit("éa|b|")).alias("eq"), fn.tag_ids(F.lit("['89', '90']")).alias("tags"), fn.is_synonym_label(F.lit("___1_SYN_1-2___")).alias("syn"), fn.trimmed_noise_code(F.lit("<foreign:fr>")).alias("code"),
        fn.joined(F.array(F.lit("a"), F.lit("b")), "-").alias("j"), fn.token_distance(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("b"), F.lit("c"), F.lit("d"))).alias("d"),
        fn.error_rate(F.lit(1), F.lit(0)).alias("inf"), fn.error_rate(F.lit(0), F.lit(0)).alias("none"), fn.label_number(F.lit("7:X")).alias("num"),
    ).head()
    assert (r.low, r.s, r.i, r.n, r.b, r.eq, r.tags, r.syn, r.code, r.j, r.d, r.inf, r.none, r.num) == ("éa|b|", ["Éa", "b"], "23", "ORD_X", "0:A", False, ["89", "90"], True, "<foreign>", "a-b", 2, float("inf"), None, "7")
    with pytest.raises(Exception, match="malformed label"):
        one(spark, "t string", ("x",)).select(fn.label_number(F.col("t"))).collect()


def test_prepass():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 12))] for _ in range(2))
        steps = align_words(a, b)
        d = prepass.edit_distance(a, b)
        assert d == prepass.edit_distance(b, a) == sum(s.op != "cor" for s in steps)
        errors, left, right = prepass.match_maps(a, b, relax=False)
        assert (errors, len(left), len(right)) == (d, len(a), len(b))
        assert left.count(1) == right.count(1)
    assert prepass.match_maps(list("xax"), list("yay"))[1] == [-1, -1, -1]
    assert prepass.has_error_streak([-1, -1, -1, 1], 2)
    assert not prepass.has_error_streak([1, -1, -1, -1], 2)


def test_injected_errors_bound_the_measured_ones(spark):
    ref, made = synth.synthetic_pairs(spark, 4, 300)
    from wordloom.plans.wer import align

    got = {r.utt_id: r.errors for r in metrics.best_wer(align(ref, synth.hypothesis(made))).collect()}
    known = {r.utt_id: r.errors for r in metrics.best_wer(made).collect()}
    assert all(0 < got[u] <= known[u] for u in known)


def test_table_function(spark):
    udtf.register(spark)
    got = spark.sql("SELECT t.op FROM (SELECT array('a', 'b') AS ref, array('a', 'c', 'd') AS hyp) p, LATERAL wer_align(p.ref, p.hyp) t ORDER BY t.seq").collect()
    assert sorted(r.op for r in got) == ["cor", "ins", "sub"]


def test_stream(spark, tmp_path):
    from wordloom.streaming.monitor import stream_wer

    schema = "utt_id long, at timestamp, ref array<string>, hyp array<string>"
    rows = one(spark, "utt_id long, at string, ref array<string>, hyp array<string>", (1, "2026-01-01 00:01:00", ["a", "b"], ["a"]), (2, "2026-01-01 00:02:00", ["a"], ["a", "x"]), (3, "2026-01-01 02:00:00", ["q"], ["z"]))
    rows.withColumn("at", F.col("at").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    out = stream_wer(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    query = out.writeStream.format("memory").queryName("rates").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {str(r.window.start): (r["ins"], r["del"], r["sub"], r.n_ref) for r in spark.table("rates").collect()}
    assert got == {"2026-01-01 00:00:00": (1, 1, 0, 3), "2026-01-01 02:00:00": (0, 0, 1, 1)}


def test_command_line(spark, tmp_path):
    from wordloom.__main__ import main

    (tmp_path / "r.nlp").write_text("token|speaker|ts|endTs|punctuation|case|tags|wer_tags\nHi|1|||,|UC|[]|['1']\nwe'll|1|||.|LC|[]|[]\n")
    (tmp_path / "h.ctm").write_text("r 1 1 1 hi\nr 1 2 1 we\nr 1 3 1 will\n")
    (tmp_path / "rules").write_text("we'll | we will\n")
    (tmp_path / "tags.json").write_text('{"1": {"entity_type": "T"}}')
    out = {k: str(tmp_path / k) for k in ("o.nlp", "o.sbs", "o.json")}
    assert main(["wer", "--ref", str(tmp_path / "r.nlp"), "--hyp", str(tmp_path / "h.ctm"), "--syn", str(tmp_path / "rules"), "--wer-sidecar", str(tmp_path / "tags.json"), "--output-nlp", out["o.nlp"], "--output-sbs", out["o.sbs"], "--json-log", out["o.json"]]) == 0
    assert (tmp_path / "o.nlp").read_text().splitlines()[1:] == ["Hi|1|1.0000|2.0000|,||UC|[]|['1']||||", "we|1|2.0000|3.0000|||LC|[]|[]|||,push_last|", "will|1|3.0000|4.0000|.||LC|[]|[]|||,push_last|"]
    assert "###1_T###|" in (tmp_path / "o.sbs").read_text()
    assert json.loads((tmp_path / "o.json").read_text())["wer"]["bestWER"]["numErrors"] == 0


def test_harness_and_graph_lines():
    from wordloom.operators.align import graph_of
    from wordloom.plans.harness import made_pair, measure

    ref, hyp, made = made_pair(300, 0.1, 0.2, 0.1, seed=3)
    assert len(ref) == 300
    assert 0 < made <= 120
    assert measure(50, 0.1, 0.1, 0.1, 2)["pairs"] == 2
    graph = graph_of(["a", "b"], [{"first": 1, "last": 1, "marker": "___0_X___", "candidates": [["c", "d"]]}], None)
    assert sorted(graph.lines()) == sorted(["0 1 a", "1 3 c ___0_X___", "3 2 d ___0_X___", "1 2 b ___0_X___"])
    assert graph.lines(2) == []


def test_noise_codes_and_steps(spark):
    from wordloom.operators.stitches import out_of_step
    from wordloom.plans.wer import wer

    ref = one(spark, "utt_id string, pos long, token string, speaker string", ("u", 1, "<foreign:fr>", "1"), ("u", 2, "B", "1"))
    hyp = one(spark, "utt_id string, pos long, token string", ("u", 1, "<unk>"), ("u", 2, "b"))
    got = wer(ref, hyp)
    r = got.best().head()
    assert (r.errors, r.n_ref) == (0, 2)
    assert out_of_step(got.stitches).count() == 0
    assert [x.line.split("|")[0] for x in got.aligned().orderBy("seq").collect()] == ["<foreign:fr>", "B"]
    assert {x.why for x in out_of_step(got.stitches.withColumn("hyp_orig", F.lit("z"))).collect()} == {"heard"}
