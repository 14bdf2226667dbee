"""Registered queries do the whole job: nothing of their input goes without a result."""

from __future__ import annotations

import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from wordloom.functions import tokens as fn
from wordloom.operators import prepass
from wordloom.plans import catalog


def write_table(spark, tmp_path, name, schema, rows):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))


NLP = "row_id long, recording string, pos long, token string, speaker string, ts string, end_ts string, punctuation string, prepunctuation string, casing string, labels string, best_label string, wer_tags string, confidence string"


def token_table(spark, tmp_path, rows):
    """``recording, pos, token`` and perhaps ``labels, best_label`` as the token table."""
    full = [(i, r[0], r[1], r[2], "1", "", "", "", "", "LC", *(r[3:5] if len(r) > 3 else ("[]", "")), "[]", "") for i, r in enumerate(rows)]
    write_table(spark, tmp_path, "nlp_tokens", NLP, full)
    return str(tmp_path)


def test_ngrams_seen_once_have_rows(spark, tmp_path):
    words = "a b c a d e f g".split()
    sf = token_table(spark, tmp_path, [("rec_7", i, w) for i, w in enumerate(words)])
    st = catalog.injected(spark, sf).orderBy("seq").collect()
    want: dict = defaultdict(Counter)
    for r in st:
        for gram, role in {"cor": [(r.ref_tok, "correct")], "del": [(r.ref_tok, "del")], "ins": [(r.hyp_tok, "ins")], "sub": [(r.ref_tok, "subst_fn"), (r.hyp_tok, "subst_fp")]}[r.op]:
            want[gram][role] += 1
    roles = ["correct", "del", "subst_fp", "subst_fn", "ins"]
    got = {r.gram: [r[x] for x in roles] for r in catalog.QUERIES["unigram_stats_all"](spark, sf).collect()}
    assert got == {g: [c[x] for x in roles] for g, c in want.items()}
    assert any(sum(c) == 1 for c in got.values())
    countable = lambda t: not any(x in t for x in ("<ins>", "<del>", "<eps>", "___"))
    pairs = {g for x, y in zip(st, st[1:]) for g in (f"{x.ref_tok} {y.ref_tok}", f"{x.hyp_tok} {y.hyp_tok}") if countable(g)}
    assert {r.gram for r in catalog.QUERIES["bigram_stats_all"](spark, sf).collect()} == pairs
    assert sorted(r.place for r in catalog.QUERIES["unigrams_ranked_all"](spark, sf).collect()) == list(range(1, len(want) + 1))
    log = json.dumps([r.asDict() for r in catalog.json_log(spark, sf).collect()], default=str)
    spark.catalog.clearCache()
    assert all(f'\\"{g}\\"' in log for g in want)


LAYOUTS = [
    ("['7:PERSON']", "7:PERSON"), ('["35:HOUR O\'CLOCK"]', "35:HOUR O'CLOCK"), ("['35:HOUR O''CLOCK', '1:A']", "35:HOUR O'CLOCK"), (r"['35:HOUR O\'CLOCK']", "35:HOUR O'CLOCK"), ("7:PERSON", "7:PERSON"), ("[7:ORG | 8:A]", "7:ORG"),
    ("('7:A', '8:B',)", "7:A"), ("7:A / 8:B", "7:A"), ("7:A;8:B", "7:A"), ("7:A; 8:B;", "7:A"), ("7:A\t8:B", "7:A"), ('"7:LAW, STATUTE";"8:B"', "7:LAW, STATUTE"), ("7:LAW, STATUTE", "7:LAW, STATUTE"), ("[ '7:A' , '8:B' ]", "7:A"),
    ("['7:A' '8:B']", "7:A"), ("['9: a']", "9:A"), ("['9：ORG | UNIT']", "9:ORG | UNIT"), (" 07 : date ", "7:DATE"), ("['0:A']", "0:A"), ("[]", ""), ("", ""), (None, ""), ("['nothing']", "NOTHING"),
]


def test_every_row_has_a_label_result(spark, tmp_path):
    sf = token_table(spark, tmp_path, [("rec_1", i, "w", x, "") for i, (x, _) in enumerate(LAYOUTS)])
    got = {r.row_id: r for r in catalog.QUERIES["label_functions_all"](spark, sf).collect()}
    assert [got[i].best for i in range(len(LAYOUTS))] == [want for _, want in LAYOUTS]
    for i, (_, want) in enumerate(LAYOUTS):
        number, colon, name = want.partition(":")
        assert (got[i].number, got[i].marker is None) == (number if colon else None, want == "")
        if colon:
            assert (got[i].marker_id, got[i]["name"], got[i].entity, got[i].synonym) == (number, name, True, False)


def test_every_best_label_is_an_entity(spark, tmp_path):
    labels = ["1:ORG", "2:SPACY>ORG", "3:LAW, STATUTE", "4:PLACE; REGION", "5:ORG | UNIT", "6:HOUR O'CLOCK", "9: a", "7：TIME", " 8:date "]
    sf = token_table(spark, tmp_path, [("rec_1", 2 * i + k, f"w{2 * i + k}", "[]", x if k else "") for i, x in enumerate(labels) for k in range(2)] + [("rec_1", 30, "z", "(10:B)", "")])
    write_table(spark, tmp_path, "synonym_rules", "line_no long, raw_line string", [(1, "x | y")])
    write_table(spark, tmp_path, "norm_docs", "norm_id long, recording string, body string", [(1, "rec_1", '{"6": {"candidates": [{"probability": 1, "verbalization": ["w11"]}], "class": "HOUR"}}')])
    got = {r.class_name: r.n_ref for r in catalog.align_entity_classes(spark, sf).collect()}
    assert got == dict.fromkeys(["ORG", "SPACY>ORG", "LAW, STATUTE", "PLACE; REGION", "ORG | UNIT", "HOUR O'CLOCK", "A", "TIME", "DATE", "B"], 1)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_edit_distance_of_whole_recordings(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert prepass.edit_distance(a, b) == brute_distance(a, b)
    sf = token_table(spark, tmp_path, [(rec, i, rng.choice("abcde")) for rec, n in (("rec_1", 150), ("rec_2", 40), ("rec_3", 1)) for i in range(n)])
    sides = defaultdict(lambda: ([], []))
    for r in catalog.injected(spark, sf).orderBy("seq").collect():
        if r.op != "ins":
            sides[r.utt_id][0].append(r.ref_tok)
        if r.op != "del":
            sides[r.utt_id][1].append(r.hyp_tok)
    want = {u: brute_distance(*x) for u, x in sides.items()}
    assert {r.utt_id: r.distance for r in catalog.QUERIES["edit_distance_recordings"](spark, sf).collect()} == want
    # Beyond the most distinct tokens the exact way gives the same.
    monkeypatch.setattr(fn, "DISTINCT", 10)
    assert {r.utt_id: r.distance for r in catalog.edit_distance_recordings(spark, sf).collect()} == want


def test_distance_of_many_distinct_tokens(spark):
    df = spark.range(2).select("id", F.transform(F.sequence(F.lit(1), F.when(F.col("id") == 0, 21_000).otherwise(5)), lambda i: i.cast("string")).alias("a"))
    got = df.select("id", fn.token_distance(F.col("a"), F.concat(F.array(F.lit("x")), F.slice("a", 3, 30_000))).alias("d")).collect()
    assert {r.id: r.d for r in got} == {0: 2, 1: 2}
