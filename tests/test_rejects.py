"""Problem 3: reasons, and that loaded and rejected lines part the others."""

from __future__ import annotations

from wordloom.operators.rejects import rejected, strict_load

LINES = [
    ("r.wav 1 0.5 0.25 word", 5, None), ("r.wav\tA\t1.5e+1\t.5\tword\t1", 6, None), ("  r.wav   1 3. 4 word 0.0\r", 6, None), ('r.wav 1 0.5 0.25 "two words" 0.5', 6, None), ('r.wav 1 "0.5" 0.25 a', 5, None),
    ("", 5, "-"), (None, 6, "-"), (" \t\r", 5, "-"), ('r.wav 1 0.5 0.25 "open', 5, "quoting"), ('"r.wav 1 x y', 6, "quoting"), ("r.wav 1 0.5 0.25", 5, "columns"), ("r.wav 1 0.5 0.25 a 0.5", 5, "columns"), ("r.wav 1 0.5 0.25 a", 6, "columns"),
    ("r.wav,1,0.5,0.25,a", 5, "columns"), ("r.wav 1 0.5 0.25 a", None, "columns"), ("r.wav 1 -0.1 x a", 5, "start"), ("r.wav 1 1e 0.1 a", 5, "start"), ("r.wav 1 0x1F 0.1 a", 5, "start"), ("r.wav 1 NaN 0.1 a", 5, "start"), ("r.wav 1 1e999 0.1 a", 5, "start"),
    ("r.wav 1 １２.５ 0.1 a", 5, "start"), ("r.wav 1 1_0 0.1 a", 5, "start"), ("r.wav 1 1 0.5s a", 5, "duration"), ("r.wav 1 1 1.0f a", 5, "duration"), ("r.wav 1 1 inf a", 5, "duration"), ("r.wav 1 1 1 a 1.01", 6, "confidence"), ("r.wav 1 1 1 a -0.1", 6, "confidence"),
    ("r.wav 1 1 1 a 0.8d", 6, "confidence"), ("r.wav 1 1 1 a 98%", 6, "confidence"), ("r.wav 1 1 1 " + "x" * 100_000, 5, None),
]
SCHEMA = "line_id long, file_name string, line_no long, n_columns long, raw_line string, _f string, reason string"


def lines(spark):
    return spark.createDataFrame([(i, "f", i, n, t, "clash", "clash") for i, (t, n, _) in enumerate(LINES)], SCHEMA)


def test_reasons(spark):
    got = {r.line_id: r.reason for r in rejected(lines(spark)).collect()}
    assert got == {i: why for i, (_, _, why) in enumerate(LINES) if why not in (None, "-")}


def test_records(spark):
    got = {r.line_id: r for r in strict_load(lines(spark)).collect()}
    assert set(got) == {i for i, (_, _, why) in enumerate(LINES) if why is None}
    assert (got[1].channel, got[1].start_time_secs, got[1].duration_secs, got[1].confidence) == ("A", 15.0, 0.5, 1.0)
    assert got[0].confidence == 1.0
    assert got[3].word == "two words"
    assert got[4].start_time_secs == 0.5


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert rejected(none).count() == 0
    assert strict_load(none).count() == 0
