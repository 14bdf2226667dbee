"""Two-level runs and running values against plain loops, with small blocks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from wordloom.operators import blocks
from wordloom.operators.blocks import one_per_place, running, stitched_runs

SCHEMA = "k string, pos long, v string, x long"


def table(spark, seed):
    rng = random.Random(seed)
    rows = []
    for k in "abc":
        value = "p"
        for pos in sorted(rng.sample(range(200), 120)):
            value = rng.choice(["p", "q", None]) if rng.random() < (0.4 if k != "c" else 0.03) else value
            rows.append((k, pos, value, rng.randint(0, 9)))
    return rows, spark.createDataFrame(rows + rows[::7] + [(None, 1, "p", 1), ("a", None, "p", 1)], SCHEMA)


@pytest.mark.parametrize("by_difference", [True, False])
@pytest.mark.parametrize(("size", "fan"), [(3, 4), (16, 2), (1000, 1024)])
def test_runs(spark, size, fan, by_difference, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", fan)
    rows, df = table(spark, size)
    expected, last = [], None
    for k, pos, v, x in rows:
        if last and last[0] == k and last[1] == v and v is not None:
            last[3:] = [pos, last[4] + 1, min(last[5], x)]
        else:
            last = [k, v, pos, pos, 1, x]
            if v is not None:
                expected.append(last)
    placed = one_per_place(df, "k", "pos", ["v", "x"], size)
    for least in (1, 2) if by_difference else (1,):
        got = stitched_runs(placed, "k", "pos", "v", least, low=("x",), by_difference=by_difference)
        assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(e) for e in expected if e[4] >= least)


@pytest.mark.parametrize(("size", "fan"), [(4, 3), (1000, 1024)])
def test_running(spark, size, fan, monkeypatch):
    monkeypatch.setattr(blocks, "FAN", fan)
    rows, df = table(spark, 1)
    got = {(r.k, r.pos): r for r in running(df.dropDuplicates(["k", "pos"]), "k", "pos", sums={"s": F.col("x")}, fills={"f": F.col("v")}, before={"b": F.col("v")}, size=size).collect()}
    assert len(got) == len(rows)
    at = {}
    for k, pos, v, x in rows:
        s, f = at.get(k, (0, None))
        r = got[k, pos]
        assert r.b == f
        s, f = s + x, v if v is not None else f
        assert (r.s, r.f) == (s, f)
        at[k] = (s, f)
