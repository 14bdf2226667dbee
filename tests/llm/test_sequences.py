"""Problems 1 and 7 on small recordings with small blocks."""

from __future__ import annotations

import random
import re

import pytest

from wordloom.llm import layouts, repeats, turns

COLUMNS = ["recording", "pos", "token", "speaker", "ts", "end_ts", "labels", "best_label", "best_label_id", "row_id", "text", "event", "_block"]
SCHEMA = ", ".join(f"{c} {'long' if c in ('pos', 'row_id') else 'string'}" for c in COLUMNS)


def rows_of(spark, rows):
    full = [{"recording": "r", "ts": None, "end_ts": None, "labels": None, "best_label": None, "best_label_id": None, "row_id": i, "text": "clash", "event": "clash", "_block": "clash"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in COLUMNS) for r in full], SCHEMA)


TALK = [
    ("<silence>", "01"), ("Well", "1"), ("um", "Speaker one:"), ("uh-huh", "s.1"), ("[00:01:02]", "SPEAKER 2:"), ("the-", "unknown"), ("(phone", "2"), ("ringing)", "1"), ("yes", None),
    (">>", "[S3]"), ("9:15", "3.0"), ("9:15", "3.0"), ("12:45", " 3 "), ("ｕｍ", "3"), ("it'ѕ", "speaker three"), ("'", "3"), (None, "2"), ("  ", "2"), ("(well", "?"), ("45", ""), ("*sighs*", "1.0"), ("word", "Spk 1"),
]


def talk(shift=0):
    return [{"pos": 2 * i + shift, "token": t, "speaker": s, "labels": "['0:TIME']" if i == 10 else "[]"} for i, (t, s) in enumerate(TALK)]


def found(df):
    return sorted((r.recording, r.speaker_no, r.first_pos, r.last_pos) for r in df.collect())


#: Words: Well, uh-huh (1); the- (2, from the row before); yes (1); 9:15 with a TIME label, it's (3); (well, 45 (2); word (1).
TURNS = [("r", 1, 2, 6), ("r", 2, 10, 10), ("r", 1, 16, 16), ("r", 3, 20, 28), ("r", 2, 36, 38), ("r", 1, 42, 42)]


@pytest.mark.parametrize("size", [2, 5, 4096])
def test_turns(spark, size):
    rows = talk()
    df = rows_of(spark, rows + rows[::3] + [{"pos": None, "token": "x", "speaker": "1"}, {"pos": 1, "token": "x", "speaker": "1", "recording": None}])
    assert found(turns.speaker_turns(df, size=size)) == sorted(TURNS)


def test_turn_texts_and_edges(spark):
    df = rows_of(spark, talk())
    texts = {(r.speaker_no, r.first_pos): r.text for r in turns.turn_texts(df, size=7).collect()}
    assert {(n, p) for n, p in texts} == {(n, first) for _, n, first, _ in TURNS}
    assert texts[1, 2] == "Well uh-huh"
    assert texts[3, 20] == "9:15 it's"
    assert turns.speaker_turns(rows_of(spark, [])).count() == 0
    # No usable label at all: no speaker, no turn.
    assert turns.speaker_turns(rows_of(spark, [{"pos": 1, "token": "a", "speaker": "?"}])).count() == 0
    assert found(turns.speaker_turns(rows_of(spark, [{"pos": 1, "token": "a" * 100_000, "speaker": "7"}]))) == [("r", 7, 1, 1)]


def test_layouts(spark):
    rows = [("speaker", "speaker 12:", 3), ("speaker", "speaker 3:", 1), ("speaker", "1.0", 2), ("speaker", "2.0", 2), ("speaker", "unk", 1), ("token", "[00:01:02]", 1), ("token", "01:02", 1), ("token", "90:59.5", 1), ("token", "3:99", 1), ("token", "(a", 1), ("token", "b)", 1), ("token", "45", 1), ("token", "--", 1)]
    got = {}
    roles = layouts.roles(layouts.mine(spark.createDataFrame(rows, "field string, text string, n long"))).collect()
    for field, text, _ in rows:
        path = spark.createDataFrame([(text,)], "t string").select(layouts.path(layouts.F.col("t"))).head()[0]
        got[field, text] = next((r.role, r.slot) for r in roles if (r.field, r.path) == (field, path))
    assert got["speaker", "speaker 3:"] == ("speaker", 0)
    assert got["speaker", "2.0"] == ("speaker", 0)
    assert got["speaker", "unk"] == ("none", None)
    assert got["token", "[00:01:02]"][0] == "note"
    assert got["token", "01:02"][0] == got["token", "3:99"][0] == "text"
    assert got["token", "90:59.5"][0] == "time"
    assert (got["token", "(a"][0], got["token", "b)"][0], got["token", "45"][0], got["token", "--"][0]) == ("open(", "close)", "text", "none")


def test_single_rows_do_not_change_a_layout(spark):
    rows = [("token", "12:30", 10**6), ("token", "00:59", 10**6), ("token", "12:75", 1), ("speaker", "ch 1 spk 2", 1_000), ("speaker", "ch 1 spk 3", 500), ("speaker", "ch 2 spk 3", 1)]
    got = {(r.field, r.role, r.slot) for r in layouts.roles(layouts.mine(spark.createDataFrame(rows, "field string, text string, n long"))).collect()}
    assert got == {("token", "time", None), ("speaker", "speaker", 1)}


def test_many_layouts_are_joined_in_copies(spark, monkeypatch):
    monkeypatch.setattr(layouts, "MAX_SENT", 0)
    monkeypatch.setattr(layouts, "COPIES", 3)
    assert found(turns.speaker_turns(rows_of(spark, talk()), size=5)) == sorted(TURNS)


def event(r):
    m = re.match(r"\s*0*(\d+)", r["best_label_id"] or "") or re.match(r"\s*0*(\d+)\s*[:：]", r["best_label"] or "")
    if m:
        return "#" + m[1]
    core = re.sub(r"^[\W_]+|[\W_]+$", "", r["token"] or "").lower()
    return core or None


@pytest.mark.parametrize("size", [3, 50])
def test_runs(spark, size):
    rng = random.Random(size)
    rows = []
    for rec in ("a", "b"):
        for pos in sorted(rng.sample(range(300), 150)):
            rows.append({"recording": rec, "pos": pos, "token": rng.choice(["go", "Go", "go,", '"go"', "no", "NO-", "<go>", "--", "", None, " "]), "best_label": rng.choice([None, None, "", "3:A", "03: B", "4：A"]), "best_label_id": rng.choice([None, None, "", "3", " 04"])})
    expected, last = [], None
    for r in rows:
        e = event(r)
        if last and e and last[0] == r["recording"] and last[1] == e:
            last[3], last[4] = r["pos"], last[4] + 1
        else:
            last = [r["recording"], e, r["pos"], r["pos"], 1] if e else None
            if last:
                expected.append(last)
    got = repeats.event_runs(rows_of(spark, rows + rows[::5]), size=size).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(e) for e in expected if e[4] > 1)


def test_run_times_and_empty(spark):
    rows = [{"pos": 1, "token": "go", "ts": "1.5", "end_ts": "2,25"}, {"pos": 4, "token": "GО", "ts": "", "end_ts": "00:00:03.500"}]
    r = repeats.event_runs(rows_of(spark, rows), times=True).head()
    assert (r.n_events, r.start_secs, r.end_secs, r.duration_secs) == (2, 1.5, 3.5, 2.0)
    assert repeats.event_runs(rows_of(spark, [])).count() == 0
