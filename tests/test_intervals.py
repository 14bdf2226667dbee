"""Problem 4: against a plain sweep, with small shards so that every border case occurs."""

from __future__ import annotations

import random

import pytest

from wordloom.operators.intervals import periods_and_gaps

SCHEMA = "recording string, start_time_secs double, duration_secs double, _k string, entity string"


def sweep(rows, session):
    by = {}
    for r, s, d in rows:
        if r is not None and s is not None and d is not None and s == s and d == d and 0 <= s < 1e300 and 0 < d < 1e300:
            by.setdefault(r, []).append((round(s * 1000), round(s * 1000) + round(d * 1000)))
    out = set()
    for r, spans in by.items():
        spans.sort()
        a, z = spans[0]
        merged = []
        for s, e in spans[1:]:
            if s <= z:
                z = max(z, e)
            else:
                merged.append((a, z))
                a, z = s, e
        merged.append((a, z))
        out |= {(r, "period", *m) for m in merged}
        out |= {(r, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:], strict=False) if q[0] - p[1] < session}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, "recording", "start_time_secs", "duration_secs", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(3))
def test_against_sweep(spark, seed):
    rng = random.Random(seed)
    rows = []
    for r in ("a", "b", "c"):
        for _ in range(250):
            s = rng.randrange(0, 4000)
            rows.append((r, s / 1000, rng.choice([1, 3, 10, 40, 100, 250] if r != "c" else [1, 2]) / 1000))
    rows += rows[:30]
    nan, inf = float("nan"), float("inf")
    rows += [("a", None, 1.0), ("a", 1.0, None), ("b", nan, 1.0), ("b", 1.0, nan), ("c", -1.0, 5.0), ("c", 1.0, 0.0), ("c", 1.0, -2.0), ("a", inf, 1.0), ("a", 1.0, inf), (None, 1.0, 1.0)]
    for block in (1, 3, 256):
        assert run(spark, rows, session_ms=300, shard_ms=50, block=block) == sweep(rows, 300)


def test_intervals_over_very_many_shards(spark):
    rng = random.Random(9)
    rows = [("a", rng.randrange(0, 30_000) / 1000, rng.choice([1, 5, 20]) / 1000) for _ in range(300)]
    rows += [("a", 2.005, 9.3), ("a", 8.0, 7.123), ("b", 1.0, 20.0), ("b", 5.0, 0.001), ("b", 21.0, 0.5), ("b", 30.0, 1.0)]
    rows += [("c", float(i), 1e12) for i in (5, 7, 7)] + [("c", 1.0, 0.5), ("c", 4e11, 3.0), ("d", 10.0, 1.28), ("d", 11.28, 2.56), ("d", 13.84, 0.01), ("d", 14.0, 5.12)]
    for block in (4, 16, 256):
        assert run(spark, rows, session_ms=5000, shard_ms=10, block=block) == sweep(rows, 5000)


def test_sessions_touching_and_single_precision(spark):
    rows = [("a", 0.0, 1.0), ("a", 1.0, 1.0), ("a", 3602.0, 1.0), ("a", 3603.5, 0.5), ("a", 0.06700000166893005, 0.2809999883174896)]
    assert run(spark, rows) == {("a", "period", 0, 2000), ("a", "period", 3602000, 3603000), ("a", "period", 3603500, 3604000), ("a", "gap", 3603000, 3603500)}


def test_empty_table(spark):
    assert run(spark, []) == set()
