"""Problem 9: the schedule's deviation, budgets, and drawn records."""

from __future__ import annotations

import os
import random

import pytest

from wordloom.llm import bpe, mixing

DOCS = "doc_id long, source string, text string, _h string, slot string"


@pytest.mark.parametrize("seed", range(5))
def test_no_source_is_a_block_off(seed):
    rng = random.Random(seed)
    weights = {f"s{i}": rng.randint(1, 1000) for i in range(rng.randint(1, 8))}
    total = sum(weights.values())
    order = mixing.pfair(weights, 3000)
    assert len(order) == 3000
    done = dict.fromkeys(weights, 0)
    for t, s in enumerate(order, 1):
        done[s] += 1
        assert all(abs(done[x] - t * w / total) < 1 for x, w in weights.items())


def test_budgets():
    targets = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 3), "none": (0.1, 2)}
    have = {"a": 1000, "b": 1000, "c": 50, "other": 9}
    plan = {p.source: p.budget for p in mixing.budgets(targets, have)}
    assert plan == {"a": 750, "b": 450, "c": 150, "none": 0}
    capped = {p.source: p.budget for p in mixing.budgets(targets, have, total=2000)}
    # What the two scarce sources cannot give comes from the third.
    assert capped == {"a": 1000, "b": 850, "c": 150, "none": 0}
    assert all(p.budget == 0 for p in mixing.budgets({}, have))


@pytest.mark.skipif(not os.path.exists(bpe.BYTE_BPE_50K), reason="no vocabulary file")
@pytest.mark.parametrize(("blocks", "block_tokens"), [(64, 1 << 20), (16, 40), (4, 100)])
def test_drawn_records(spark, blocks, block_tokens):
    rng = random.Random(5)
    size = {"big": 400, " Big": 100, "SMALL ": 20, "mid": 150, "unlisted": 30, None: 5}
    rows, n = [], 0
    for s, k in size.items():
        for _ in range(k):
            n += 1
            rows.append((n, s, " word" * rng.randint(1, 30), "clash", "clash"))
    rows += [(n + 1, "small", None, "", ""), (n + 2, "small", "", "", "")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.2, 3), ("Mid", 0.2, 2), ("gone", 0.1, 4), (None, 0.1, 1), ("zero", None, 1)], "source string, target_share double, max_repeats int")
    drawn = mixing.mix(docs, targets, blocks=blocks, block_tokens=block_tokens).collect()
    of = {i: (s or "").strip().lower() for i, s, *_ in rows}
    assert all(of[r.doc_id] == r.source for r in drawn)
    seen = {}
    for r in drawn:
        seen.setdefault((r.source, r.doc_id), []).append(r.copy_no)
    limit = {"big": 1, "small": 3, "mid": 2}
    assert all(sorted(c) == list(range(1, len(c) + 1)) and len(c) <= limit[s] for (s, _), c in seen.items())
    # Every record of the scarce source is used as often as allowed.
    assert sum(len(c) for (s, _), c in seen.items() if s == "small") == 60
    report = {r.source: r for r in mixing.shares(docs, targets, blocks=64).collect()}
    assert set(report) == {"big", "small", "mid", "gone"}
    total = sum(r.n_tokens for r in drawn)
    for s, r in report.items():
        assert r.n_tokens == sum(x.n_tokens for x in drawn if x.source == s)
        assert abs(r.actual_share - (0 if s == "gone" else r.target_share / 0.9)) < 2 * 31 / total + 1e-9
    # In order, each source keeps near its share.
    done = dict.fromkeys(limit, 0)
    for i, r in enumerate(sorted(drawn, key=lambda r: (r.slot, r.source_offset)), 1):
        done[r.source] += r.n_tokens
        so_far = sum(done.values())
        if i % 20 == 0:
            assert all(abs(done[s] - so_far * report[s].target_share / 0.9) < 3 * (min(total / blocks, block_tokens) + 31) for s in done)


@pytest.mark.skipif(not os.path.exists(bpe.BYTE_BPE_50K), reason="no vocabulary file")
def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(none, targets).count() == 0
    assert [(r.source, r.actual_share) for r in mixing.shares(none, targets).collect()] == [("a", 0.0)]
    assert mixing.mix(spark.createDataFrame([(1, "a", "x", "", "")], DOCS), targets.limit(0)).count() == 0
