"""Problem 8: ids against the library's own encoder, and round trips."""

from __future__ import annotations

import os
import random

import pytest

from wordloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.BYTE_BPE_50K), reason="no vocabulary file")


@pytest.fixture(scope="module")
def ranks():
    with open(bpe.BYTE_BPE_50K, "rb") as f:
        return bpe.load_ranks(f.read())


def strange_texts():
    rng = random.Random(3)
    alphabet = "aab  \n\t\r .,'sé█漢🙂0 19 　x<|endoftext|>"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(5000)] + ["a" * 20_000, " " * 5000 + "x", "█" * 9000, " a  b ", "<|endoftext|>", "\n\n a", "it's we'll"]


def test_against_library(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    theirs = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = strange_texts()
    ids, at = bpe.BatchEncoder(bpe.Encoder(ranks)).encode(texts)
    back = {v: k for k, v in ranks.items()}
    for text, a, z in zip(texts, at, at[1:], strict=False):
        own = ids[a:z].tolist()
        assert own == theirs.encode_ordinary(text)
        assert b"".join(back[i] for i in own).decode() == text


def test_segment_tree():
    rng = random.Random(1)
    values = [rng.randint(0, 5) for _ in range(37)]
    tree = bpe.SegmentTree(values[:])
    for _ in range(300):
        assert (tree.least(), tree.leftmost()) == (min(values), values.index(min(values)))
        i = rng.randrange(37)
        values[i] = rng.randint(0, 9)
        tree.put(i, values[i])


def test_store_of_chunks_changes_nothing(ranks, monkeypatch):
    texts = strange_texts()[:300]
    whole = bpe.BatchEncoder(bpe.Encoder(ranks)).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 5)
    small = bpe.BatchEncoder(bpe.Encoder(ranks))
    assert [i for t in texts for i in small.encode([t])[0].tolist()] == whole
    assert small.count(texts).sum() == len(whole)


def test_query(spark):
    schema = "doc_id long, text string, ids string, _row string"
    df = spark.createDataFrame([(1, "Hello world", "", ""), (2, None, "", ""), (3, "", "", ""), (1, "Hello world", "", "")], schema)
    got = sorted((r.doc_id, list(r.ids)) for r in bpe.encode_corpus(df, "doc_id", "text").collect())
    assert got == [(1, [15496, 995]), (1, [15496, 995]), (2, []), (3, [])]
    assert bpe.encode_corpus(spark.createDataFrame([], schema), "doc_id", "text").count() == 0
    assert sorted((r.doc_id, r.n) for r in bpe.count_tokens(df, "text", ["doc_id"], "n").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
