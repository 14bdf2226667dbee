"""Encoding of the whole corpus with a public byte-level BPE tokenizer (problem 8).

Method: a segment tree over the ranks of adjacent pairs.  The root holds the leftmost pair of
the lowest rank; merging it changes at most three leaves, each updated in logarithmic time,
until no pair can be merged.  A piece of n bytes takes O(n log n), however long it is.

Texts are cut at single blanks between other characters, which no pre-token can span, and
the ids of each distinct chunk are found once per Python worker; a batch is then a gather
from these ids.  The store of chunks is emptied when it is full; it saves work and changes
no result.

Defined cases: an empty or null text has an empty list of ids; names of special tokens are
plain text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary lies; never copied into this repository.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how byte-level BPE of this vocabulary parts a text into pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Distinct chunks that a worker keeps, and code points handled at a time.
KEPT_CHUNKS = 400_000
SLICE = 2_000_000

_NONE = 1 << 62


class SegmentTree:
    """Least values of a row of leaves; the root tells the leftmost least leaf."""

    def __init__(self, values: list[int]) -> None:
        self.size = 1
        while self.size < len(values):
            self.size *= 2
        self.node = [_NONE] * self.size + values + [_NONE] * (self.size - len(values))
        for i in range(self.size - 1, 0, -1):
            self.node[i] = min(self.node[2 * i], self.node[2 * i + 1])

    def least(self) -> int:
        return self.node[1]

    def leftmost(self) -> int:
        i, low = 1, self.node[1]
        while i < self.size:
            i *= 2
            if self.node[i] != low:
                i += 1
        return i - self.size

    def put(self, leaf: int, value: int) -> None:
        i = leaf + self.size
        node = self.node
        node[i] = value
        i //= 2
        while i:
            low = min(node[2 * i], node[2 * i + 1])
            if node[i] == low:
                break
            node[i] = low
            i //= 2


class Encoder:
    """Byte-level BPE by ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.words = regex.compile(PATTERN)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        rank = self.ranks.get
        n = len(piece)
        part: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = SegmentTree([rank(piece[i : i + 2], _NONE) for i in range(n - 1)])
        while tree.least() != _NONE:
            i = tree.leftmost()
            j = after[i]
            part[i] += part[j]
            part[j] = None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if j < n - 1:
                tree.put(j, _NONE)
            tree.put(i, rank(part[i] + part[after[i]], _NONE) if after[i] < n else _NONE)
            if before[i] >= 0:
                tree.put(before[i], rank(part[before[i]] + part[i], _NONE))
        return [self.ranks[p] for p in part if p is not None]

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        out: list[int] = []
        for word in self.words.findall(text):
            out.extend(self.merge(word.encode("utf-8")))
        return out


def load_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}


class _Chunks(dict):
    """Numbers of chunks; a chunk that is new is encoded and gets the next number."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.flat: list[int] = []
        self.ends: list[int] = [0]

    def __missing__(self, chunk: str) -> int:
        self.flat.extend(self.encoder.encode(chunk))
        self.ends.append(len(self.flat))
        self[chunk] = n = len(self.ends) - 2
        return n


_SAFE_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: A blank beside other white space, where a blank is no safe place to cut.
_CROWDED = regex.compile(r"\s[ ]|[ ]\s|^[ ]|[ ]$")


def chunks_of(text: str) -> list[str]:
    """The text in chunks whose ids can be found apart; joined they are the text."""
    parts = _SAFE_CUT.split(text) if _CROWDED.search(text) else text.split(" ")
    if len(parts) > 1:
        parts[1:] = [" " + p for p in parts[1:]]
    return parts


class BatchEncoder:
    """Encodes batches of texts, keeping what it learnt of chunks."""

    def __init__(self, encoder: Encoder) -> None:
        self.known = _Chunks(encoder)

    def _numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The chunk numbers of all texts in a row, and where each text ends."""
        if len(self.known) > KEPT_CHUNKS:
            self.known.reset()
        find = self.known.__getitem__
        rows = [[find(c) for c in chunks_of(t)] if t else [] for t in texts]
        ends = np.cumsum([len(r) for r in rows], dtype=np.int64)
        flat = np.fromiter((n for r in rows for n in r), np.int64, int(ends[-1]) if len(ends) else 0)
        return flat, ends

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the offsets of each text (one more at the end)."""
        numbers, ends = self._numbers(texts)
        stops, flat = np.array(self.known.ends, np.int64), np.array(self.known.flat, np.int32)
        length = (stops[1:] - stops[:-1])[numbers]
        total = np.concatenate([[0], np.cumsum(length)])
        at = np.arange(total[-1], dtype=np.int64) + np.repeat(stops[numbers] - total[:-1], length)
        return flat[at], np.concatenate([[0], total[ends]]).astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        numbers, ends = self._numbers(texts)
        total = np.concatenate([[0], np.cumsum(np.diff(self.known.ends)[numbers])])[np.concatenate([[0], ends])]
        return np.diff(total).astype(np.int64)


@cache
def _worker_encoder(data: bytes) -> BatchEncoder:
    return BatchEncoder(Encoder(load_ranks(data)))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``SLICE`` characters, so that long texts do not fill the memory."""
    sizes = pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes) // SLICE
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _shared_vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read once by the driver; its size is fixed by the tokenizer."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_corpus(df: DataFrame, row_id: str, text: str, path: str = BYTE_BPE_50K) -> DataFrame:
    """``row_id, ids`` of each row, without special tokens."""
    vocabulary = _shared_vocabulary(df, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(vocabulary.value)
        for batch in batches:
            for part in _slices(batch, 1):
                ids, offsets = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))], ["_row", "ids"])

    kind = df.schema[row_id].dataType.simpleString()
    return df.select(F.col(row_id).alias("_row"), F.col(text).cast("string")).mapInArrow(run, f"_row {kind}, ids array<int>").withColumnRenamed("_row", row_id)


def count_tokens(df: DataFrame, text: str, keep: list[str], name: str = "n_tokens", path: str = BYTE_BPE_50K) -> DataFrame:
    """The columns ``keep`` and the number of tokens of ``text``; the text itself is not carried on."""
    vocabulary = _shared_vocabulary(df, path)
    last = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker_encoder(vocabulary.value)
        for batch in batches:
            for part in _slices(batch, last):
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(encoder.count(part.column(last).to_pylist()))], [*keep, name])

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, f"{schema}, {name} long")
