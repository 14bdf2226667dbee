"""Reading level of each document (problem 10).

Method: a linear pairwise ranker over features of syntax and vocabulary is learnt from pairs
of graded documents of different grade; isotonic regression calibrates its scores into
levels.

Features are of the ruling's own prose: lines that carry a headnote and citations in brackets
are left out, and medians and means over sentences keep single foreign sentences from
counting.  Vocabulary and sentence length are compared within the language of the text, which
its function words tell; means and deviations per language come from the whole corpus.

The ranker and the calibration are fitted on the driver from at most ``LABELLED`` graded
documents (a documented bound); everything else is distributed over all documents and whole
texts.

Defined cases: null, empty and short texts (under ``min_words`` words) have no grade; several
ratings of a document are averaged, null ratings left out; a text without a complete sentence
counts as one sentence; without graded documents of two grades every grade is null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.bpe import _slices
from wordloom.session import checkpointed

#: Most graded documents that the ranker is fitted on, and most partners of each in pairs.
LABELLED = 5_000
PARTNERS = 40

# What begins a headnote line, and frequent function words of each language.
HEADNOTES = "headnote headnotes summary catchwords held leitsatz leitsätze sommaire syllabus abstract regeste".split()
FUNCTION_WORDS = {
    "en": "the of and to in was that for is with by had his her they we at not this be or she he it from on which".split(),
    "de": "der die das und den dem des ein eine nicht ist war mit von zu auf im es er sie hatte für sich als auch".split(),
    "fr": "le la les de des et un une du que dans est pas pour par sur au il elle ne se a qui aux ce".split(),
}
LANGUAGES = list(FUNCTION_WORDS)
FEATURES = ["sentence", "spread", "word", "long", "mixed", "clauses"]

_HEADNOTE_LINE = re.compile(rf"(?:^|(?<=\n))[ \t]*(?:{'|'.join(HEADNOTES)})[ \t]*[:.–—-][^\n]*", re.I)
_NUMBERING = re.compile(r"[(\[]?\d{1,3}[.)\]]+$|§+$|\[\d{1,3}\]$")
_LONG = 10
_KEPT_WORDS = 400_000


class _Words(dict):
    """Numbers of words, and what is known of each word by its number."""

    def __init__(self) -> None:
        super().__init__()
        self.rows: list[tuple] = []
        self.told: np.ndarray | None = None
        self.common: dict[str, int] = {}
        for i, lang in enumerate(LANGUAGES):
            for w in FUNCTION_WORDS[lang]:
                self.common[w] = self.common.get(w, 0) | 1 << i

    def __missing__(self, token: str) -> int:
        letters = sum(c.isalpha() for c in token)
        core = token.rstrip("\"'”’»)]*")
        bare = core.rstrip(".!?…")
        ends = len(bare) > 1 and bare != core and bare[-1].isalpha() and "." not in bare
        opens, closes = token.count("(") > token.count(")"), token.count(")") > token.count("(")
        first = token.lstrip("\"'“„«([*")[:1]
        starts = first.isupper() or bool(_NUMBERING.match(token)) or first in "█*["
        whole = "(" in token and ")" in token
        self.rows.append((letters, ends, opens, closes, starts, core.endswith((",", ";")), self.common.get(bare.rstrip(",;:").lower(), 0), whole))
        self[token] = n = len(self.rows) - 1
        self.told = None
        return n

    def table(self) -> np.ndarray:
        if self.told is None:
            self.told = np.array(self.rows, np.int32).reshape(-1, 8)
        return self.told


@cache
def _worker_words() -> list[_Words]:
    return [_Words()]


def _bracketed(opens: np.ndarray, closes: np.ndarray) -> np.ndarray:
    """Words inside brackets that close within 30 words; other brackets enclose nothing."""
    n = len(opens)
    a, z = np.flatnonzero(opens), np.flatnonzero(closes)
    if not len(a) or not len(z):
        return np.zeros(n, bool)
    at = np.searchsorted(z, a)
    ok = at < len(z)
    a, end = a[ok], z[at[ok]]
    near = end - a <= 30
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, a[near], 1)
    np.add.at(delta, end[near] + 1, -1)
    return np.cumsum(delta[:-1]) > 0


def measure(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, language number (-1: unknown) and features of each text."""
    held = _worker_words()
    if len(held[0]) > _KEPT_WORDS:
        held[0] = _Words()
    known = held[0]
    find = known.__getitem__
    n = len(texts)
    sizes = np.zeros(n, np.int64)
    rows = []
    for i, t in enumerate(texts):
        if not t:
            rows.append([])
            continue
        own = _HEADNOTE_LINE.sub("", t)
        row = [find(w) for w in own.split()]
        sizes[i] = len(row) if own is t or len(own) == len(t) else len(t.split())
        rows.append(row)
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.fromiter((w for r in rows for w in r), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(n), lengths)
    told = known.table()
    letters, ends, opens, closes, starts, comma, common, whole = (told[:, k][flat] for k in range(8)) if len(told) else [np.zeros(0, np.int32)] * 8
    hits = np.stack([np.bincount(doc, (common >> k) & 1, n) for k in range(len(LANGUAGES))], 1)
    language = np.where(hits.max(1) > 0, hits.argmax(1), -1)
    out = np.zeros((n, len(FEATURES)))
    if not len(flat):
        return sizes, language, out
    aside = _bracketed(opens > 0, closes > 0) | (whole > 0)
    last = np.append(doc[1:] != doc[:-1], True)
    stop = ((ends > 0) & ~aside & np.append(starts[1:] > 0, True)) | last
    sentence = np.concatenate([[0], np.cumsum(stop)[:-1]])
    m = int(sentence[-1]) + 1
    counted = (letters > 0) & ~aside
    size = np.bincount(sentence, counted, m)
    total = np.bincount(sentence, letters * counted, m)
    long = np.bincount(sentence, (letters >= _LONG) & counted, m)
    commas = np.bincount(sentence, (comma > 0) & counted, m)
    of = np.zeros(m, np.int64)
    of[sentence] = doc
    solid = size >= 3
    bare = np.bincount(of[solid], minlength=n) == 0
    solid |= bare[of] & (size > 0)
    size, total, long, commas, of = size[solid], total[solid], long[solid], commas[solid], of[solid]
    count = np.bincount(of, minlength=n)
    order = np.lexsort((size, of))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    some = count > 0

    def quantile(q: float) -> np.ndarray:
        v = np.ones(n)
        v[some] = size[order][first[some] + ((count[some] - 1) * q).astype(np.int64)]
        return v

    mean = lambda x: np.bincount(of, x, n) / np.maximum(count, 1)
    out[:, 0] = np.log(quantile(0.5))
    out[:, 1] = np.log(quantile(0.75)) - np.log(quantile(0.25))
    out[:, 2] = mean(total / size)
    out[:, 3] = mean(long / size)
    out[:, 4] = mean(long > 0)
    out[:, 5] = mean(np.minimum(commas, 6))
    return sizes, language, out


def features(documents: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id, words, language`` and the features of each document, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                words, language, x = measure(part.column(1).to_pylist())
                names = [LANGUAGES[k] if k >= 0 else None for k in language]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words), pa.array(names, pa.string()), *[pa.array(x[:, k]) for k in range(len(FEATURES))]], ["_row", "words", "language", *FEATURES])

    kind = documents.schema[row_id].dataType.simpleString()
    schema = f"_row {kind}, words long, language string, " + ", ".join(f"{f} double" for f in FEATURES)
    return documents.select(F.col(row_id).alias("_row"), F.col(text).cast("string")).mapInArrow(run, schema).withColumnRenamed("_row", row_id)


def standardised(rows: DataFrame, min_words: int) -> DataFrame:
    """Features less the mean of the language, in deviations of it; texts too short take no part."""
    long = rows.where(F.col("words") >= min_words).withColumn("language", F.coalesce("language", F.lit("?")))
    # One row for each of the languages of this module and one for none: a few rows whatever the corpus.
    stats = long.groupBy("language").agg(*[f(c).alias(f"_{n}_{c}") for c in FEATURES for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [((F.col(c) - F.col(f"_m_{c}")) / F.greatest(F.col(f"_s_{c}"), F.lit(1e-9))).alias(c) for c in FEATURES]
    return long.join(F.broadcast(stats), "language").select("doc_id", "language", *z)


def rank_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights of a linear ranker: logistic loss on differences of pairs with different grades, by Newton steps."""
    rng = np.random.default_rng(7)
    n = len(y)
    a = np.repeat(np.arange(n), PARTNERS)
    b = rng.integers(0, n, n * PARTNERS)
    ok = np.abs(y[a] - y[b]) > 0.25
    sign = np.sign(y[a] - y[b])[ok]
    d = (x[a] - x[b])[ok] * sign[:, None]
    w = np.zeros(x.shape[1])
    if not len(d):
        return w
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
        grad = d.T @ p / len(d) - ridge * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / len(d) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def isotonic(score: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: scores and the levels at them.

    Scores that agree to nine digits are one point, with the mean of their grades.
    """
    points, at = np.unique(score.round(9), return_inverse=True)
    blocks: list[list[float]] = []  # sum, count, first score, last score
    for s, g, n in zip(points, np.bincount(at, grade), np.bincount(at), strict=True):
        blocks.append([g, n, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            g2, c2, _, z2 = blocks.pop()
            blocks[-1][0] += g2
            blocks[-1][1] += c2
            blocks[-1][3] = z2
    xs = [v for b in blocks for v in (b[2], b[3])]
    ys = [b[0] / b[1] for b in blocks for _ in (0, 1)]
    return np.array(xs), np.array(ys)


def cuts(score: np.ndarray, grade: np.ndarray) -> list[float]:
    """Scores at which the calibrated level passes from grade to grade, for the grades seen."""
    xs, ys = isotonic(score, grade)
    levels = sorted({round(g) for g in grade})
    out = []
    for low, high in zip(levels, levels[1:], strict=False):
        half = (low + high) / 2
        k = int(np.searchsorted(ys, half))
        if k == 0:
            out.append(-math.inf)
        elif k == len(ys):
            out.append(math.inf)
        else:
            span = ys[k] - ys[k - 1]
            out.append(float(xs[k - 1] + (xs[k] - xs[k - 1]) * ((half - ys[k - 1]) / span if span > 0 else 0.5)))
    return out


def grade_documents(documents: DataFrame, labels: DataFrame, min_words: int = 100) -> DataFrame:
    """``doc_id, grade, score`` of every document of at least ``min_words`` words."""
    # The texts are read once; their features are a few numbers each and are kept in the shared folder.
    z = standardised(checkpointed(features(documents)), min_words)
    rated = labels.where(F.col("grade").isNotNull()).groupBy("doc_id").agg(F.avg("grade").alias("_g"))
    graded = z.join(rated, "doc_id")
    n = graded.count()
    # Of more graded documents than the bound, those of a low hash: a share a little above it, of which the lowest stay.
    low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = min(1.0, 1.1 * LABELLED / n) if n else 1.0
    sample = sorted(graded.select("*", low.alias("_h")).where(F.col("_h") < int(share * (1 << 40))).collect(), key=lambda r: (r["_h"], r["doc_id"]))[:LABELLED]
    y = np.array([r["_g"] for r in sample])
    if len({round(g) for g in y}) < 2:
        return z.select("doc_id", F.lit(None).cast("int").alias("grade"), F.lit(None).cast("double").alias("score"))
    x = np.array([[r[f] for f in FEATURES] for r in sample])
    w = rank_weights(x, y)
    levels = sorted({round(g) for g in y})
    at = cuts(x @ w, y)
    score: Column = sum((F.col(f) * float(v) for f, v in zip(FEATURES, w, strict=True)), F.lit(0.0))
    grade = F.lit(levels[0])
    for cut, level in zip(at, levels[1:], strict=True):
        grade = F.when(F.col("score") > cut, level).otherwise(grade)
    return z.select("doc_id", score.alias("score")).select("doc_id", grade.cast("int").alias("grade"), "score")
