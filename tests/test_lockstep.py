"""Many graphs at once: the steps are those of each by itself."""

from __future__ import annotations

import random

import pytest
from test_alignment import random_graph
from test_corridor import _long_pair

from wordloom.operators import align, lockstep


@pytest.mark.parametrize(("row", "cells"), [(12_288, 48_000_000), (60, 48_000_000), (12_288, 2_000)])
def test_many_graphs_at_once(monkeypatch, row, cells):
    """Random graphs with entities and synonyms, ties included; what doesn't fit is aligned by itself (F2, F4)."""
    rng = random.Random(21)
    pairs = [random_graph(rng, rng.choice([3, 7, 30])) for _ in range(400)]
    monkeypatch.setattr(lockstep, "ROW", row)
    monkeypatch.setattr(lockstep, "CELLS", cells)
    assert align.best_paths(pairs) == [align.best_path(*p) for p in pairs]


def test_graphs_of_usual_length_share_their_steps(monkeypatch):
    """Recordings of usual length don't go through the program one by one (F2, F4)."""
    pairs = []
    for seed in range(12):
        ref, hyp = _long_pair(200 + 20 * seed, seed)
        spans = [{"first": i, "last": i + 1, "marker": f"___{i}_X___", "candidates": [["one", "two", "three"], [], ref[i : i + 1]]} for i in range(5, 190, 30)]
        pairs.append((align.graph_of(ref, spans, {("w3",): [["w4", "w5"], []]}), hyp))
    alone = [align._steps(g, align.best_path(g, h), h) for g, h in pairs]
    made = []
    solve = align._Rows.solve
    monkeypatch.setattr(align._Rows, "solve", lambda self: (made.append(1), solve(self))[1])
    assert align.align_graphs(*map(list, zip(*pairs, strict=True))) == alone
    assert not made


def test_entity_queries_shuffle_what_they_need(spark):
    """Other columns of the rows are not carried along (F2, F4)."""
    from wordloom.plans import catalog

    for query in (catalog.align_entities, catalog.align_entity_classes):
        lines = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [x for x in lines if "casing" in x and "Relation" not in x]
