"""JSON of long utterances in parts: no row holds all of their words, and together they are the whole."""

from __future__ import annotations

import json

from wordloom.plans import catalog, roundtrips
from wordloom.sinks import reports


def test_long_utterances_are_in_parts(spark, monkeypatch):
    """No part has more than a share of the keys; merged they are the object in one piece (F6)."""
    sf = "/root/testdata/sf0.001"
    stitches = catalog.injected(spark, sf).persist()
    told = lambda: {u: [r.json for r in sorted(rows, key=lambda r: r.part)] for u, rows in _by(reports.json_log(stitches, case=True).collect()).items()}
    whole = told()
    monkeypatch.setattr(reports, "PART", 60)
    parts = told()
    stitches.unpersist()
    assert all(len(x) == 1 for x in whole.values()) and max(map(len, parts.values())) > 5
    assert {u: json.loads(reports.merged_json(x)) for u, x in parts.items()} == {u: json.loads(x[0]) for u, x in whole.items()}
    size = lambda x: len(json.loads(x)["wer"].get("bigrams", {}))
    assert max(size(x) for p in parts.values() for x in p) < 200


def test_parts_are_read_again(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(str, roundtrips.json_log_read(spark, sf).collect()))
    whole = rows()
    monkeypatch.setattr(reports, "PART", 60)
    assert rows() == whole
    spark.catalog.clearCache()


def _by(rows):
    out: dict = {}
    for r in rows:
        out.setdefault(r.utt_id, []).append(r)
    return out
