"""Long pairs in narrow windows: the steps are those of the whole band."""

from __future__ import annotations

import random

import pytest

from wordloom.operators import align


def _long_pair(n: int, seed: int) -> tuple[list[str], list[str]]:
    rng = random.Random(seed)
    ref = [f"w{int(900 * rng.random() ** 2)}" for _ in range(n)]
    hyp: list[str] = []
    for i, w in enumerate(ref):
        r = rng.random()
        if r >= 0.1:
            hyp.append(f"sub{i}" if r < 0.2 else w)
        if r >= 0.9:
            hyp.append(rng.choice(ref))
    return ref, hyp


def _cells(monkeypatch) -> list[int]:
    """Cells of the rows that the program makes."""
    made: list[int] = []
    solve = align._Rows.solve
    monkeypatch.setattr(align._Rows, "solve", lambda self: (made.append(sum(hi - lo for lo, hi in self.windows.values())), solve(self))[1])
    return made


@pytest.mark.parametrize("packed", [False, True])
def test_long_graph_in_narrow_windows(monkeypatch, packed):
    """Long recordings with entities and synonyms: the same steps as over the whole band, of far fewer cells (F1, F2, F4)."""
    ref, hyp = _long_pair(6_000, 1)
    spans = [{"first": i, "last": i + 1, "marker": f"___{i}_X___", "candidates": [["one", "two", "three"], [], ref[i : i + 1]]} for i in range(50, 5_900, 90)]
    graph = align.graph_of(ref, spans, {("w3",): [["w4", "w5"], []]})
    tried: list[bool] = []
    if packed:
        rebased = align._Rows._rebased
        monkeypatch.setattr(align, "ROOM", 48)
        monkeypatch.setattr(align._Rows, "_rebased", lambda self, row: (tried.append(True), rebased(self, row))[1])
    made = _cells(monkeypatch)
    found = align.best_path(graph, hyp)
    narrow = max(made)
    assert (len(tried) > 60) == packed
    monkeypatch.setattr(align, "ROOM", 61)
    monkeypatch.setattr(align, "LONG", 1 << 40)
    assert found == align.best_path(graph, hyp)
    assert narrow * 3 < max(made)


def test_long_plain_pair_in_narrow_windows(monkeypatch):
    """Long plain recordings (F5)."""
    ref, hyp = _long_pair(5_000, 2)
    whole = align.plain_operations([(ref, hyp)])[0].tolist()
    monkeypatch.setattr(align, "LONG_PLAIN", 1_000)
    made = _cells(monkeypatch)
    assert align.plain_operations([(ref, hyp)])[0].tolist() == whole
    assert made and max(made) < 700 * len(ref)


def test_long_lattice_in_narrow_windows(monkeypatch):
    """Long lattices (F3)."""
    ref, hyp = _long_pair(5_000, 3)
    arcs = [(i, i + 1, w) for i, h in enumerate(hyp) for w in (h, f"x{i}")]
    made = _cells(monkeypatch)
    found = align.oracle_words(ref, arcs, 0, {len(hyp)})
    narrow = max(made)
    monkeypatch.setattr(align, "LONG", 1 << 40)
    assert found == align.oracle_words(ref, arcs, 0, {len(hyp)})
    assert narrow * 2 < max(made)


def test_paths_that_may_leave_the_windows_are_not_proved():
    """A hypothesis in which a stretch stands twice: no proof where the other place is as good."""
    ref, _ = _long_pair(4_000, 4)
    hyp = ref[:2_000] + ref[1_400:2_000] + ref[2_000:]
    whole = align._Rows(chain := align.graph_of(ref, None, None), hyp, None, 600).solve()
    assert align.best_path(chain, hyp) and align._tally(whole, hyp) == align._tally(align.best_path(chain, hyp), hyp)


def test_plain_queries_shuffle_tokens_only(spark):
    """Other columns of the rows are not carried along, and the references stay the same (F3, F5)."""
    from wordloom.plans import catalog

    sf = "/root/testdata/sf0.001"
    whole, few = catalog.token_rows(spark, sf), catalog.token_rows(spark, sf, ("token",))
    key = lambda df: sorted((r.utt_id, r.pos, r.token or "") for r in df.select("utt_id", "pos", "token").collect())
    assert key(whole) == key(few)
    for query in (catalog.align_recordings, catalog.oracle_lattice_wer):
        lines = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString().splitlines()
        assert not [x for x in lines if "casing" in x and "Relation" not in x]
