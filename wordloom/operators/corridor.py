"""Narrow windows for long pairs, with a proof that they hold every best path.

Word runs that stand once in either side give a first guess of the path; the windows go
along it.  Between nodes that all paths cross (``cuts``) the graph is dealt into blocks of at
most 64 words.  A bit-parallel scan gives for each block the least errors with which it can
end outside the inner window, anywhere in the hypothesis.  A path that leaves the outer window
does so between two bounds at which it is in the inner one, and pays at least for the blocks
that end outside, or the way out and back.  ``proved`` compares that with what the program
inside the windows has found between the same bounds; if it is dearer everywhere, no path that
leaves is as good as the best one inside, since the program's values are a potential.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

from wordloom.operators.distance import edit_distance
from wordloom.operators.graphs import Arc, ReferenceGraph

BLOCK = 64
#: Half widths of the inner window and what the outer one has beside it, one try after another.
TRIES = ((32, 224), (128, 1_024))
#: Excursions over so many bounds may be excluded by the way out and back.
SHORT = 48


def anchors(ref: list[str], hyp: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places, rising in both, of words in runs that stand once on either side."""
    ids: dict[str, int] = {}
    a, b = (np.array([ids.setdefault(w, len(ids)) for w in words], np.uint64) for words in (ref, hyp))
    spots: dict[int, int] = {}
    mixed = np.uint64(0x9E3779B97F4A7C15)
    for n in (2, 3, 4, 6):  # what a longer run says goes before
        if min(len(a), len(b)) < n:
            break
        runs = []
        for x in (a, b):
            h = np.zeros(len(x) - n + 1, np.uint64)
            for k in range(n):
                h = (h ^ x[k : k + len(h)]) * mixed
                h ^= h >> np.uint64(29)
            runs.append(h)
        (u, i, c), (v, j, d) = (np.unique(h, return_index=True, return_counts=True) for h in runs)
        _, s, t = np.intersect1d(u[c == 1], v[d == 1], assume_unique=True, return_indices=True)
        spots.update(zip(i[c == 1][s].tolist(), j[d == 1][t].tolist(), strict=True))
    pairs = sorted((i, j) for i, j in spots.items() if ref[i] == hyp[j])
    # The longest rising chain.
    tails: list[int] = []
    at: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        before[k] = at[p - 1] if p else -1
        tails[p : p + 1], at[p : p + 1] = [j], [k]
    chain, k = [], at[-1] if at else -1
    while k >= 0:
        chain.append(pairs[k])
        k = before[k]
    out = np.array(chain[::-1], np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


class Corridor:
    """Windows along a graph and a hypothesis; ``usable`` is false where none can be made."""

    def __init__(self, graph: ReferenceGraph, hyp: list[str], said: list[Arc], low: list[int], high: list[int]) -> None:
        """``said``: the arcs of some path, in order."""
        self.g, self.hyp, self.low, self.high = graph, hyp, low, high
        words = [a.word for a in said if a.word is not None]
        x, y = anchors(words, hyp)
        self.usable = len(x) > len(words) / 100
        if not self.usable:
            return
        # The errors of a path through the anchors.
        self.errors, i, j = 0, 0, 0
        for p, q in [*zip(x.tolist(), y.tolist(), strict=True), (len(words), len(hyp))]:
            self.errors += edit_distance(words[i:p], hyp[j:q])
            i, j = p + 1, q + 1
        before, n = {graph.order[0]: 0}, 0
        for a in said:
            n += a.word is not None
            before[a.dst] = n
        self._deal()
        self.usable = len(self.bounds) > 2 and all(v in before for v in self.bounds)
        if self.usable:
            known_x, known_y = np.concatenate([[0], x, [len(words)]]), np.concatenate([[0], y, [len(hyp)]])
            own = np.array([before[v] for v in self.bounds])
            self.centre = np.maximum.accumulate(np.rint(np.interp(own, known_x, known_y)).astype(np.int64))
            self.centre[0], self.centre[-1] = 0, len(hyp)
            self.low_at, self.high_at = (np.array([d[v] for v in self.bounds], np.int64) for d in (low, high))

    def _deal(self) -> None:
        """Blocks between cuts, as patterns of sets of words and of words that match all."""
        g, rank = self.g, {v: i for i, v in enumerate(self.g.order)}
        self.bounds, self.lane_of = [g.order[0]], []
        if len(rank) != g.size or g.order[-1] != g.end:
            return
        reach, cuts = 0, []
        out = [0] * g.size
        for a in g.arcs:
            out[rank[a.src]] = max(out[rank[a.src]], rank[a.dst])
        for i, v in enumerate(g.order):
            if reach <= i:
                cuts.append(v)
            reach = max(reach, out[i])
        lens, slack, any_, sets = [], [], [], []
        n = lost = wild = 0
        own: list[tuple[int, str]] = []

        def close(v: int) -> None:
            nonlocal n, lost, wild, own
            self.bounds.append(v)
            lens.append(min(n, BLOCK))
            slack.append(lost if n <= BLOCK else n)
            any_.append(wild)
            sets.append(own if n <= BLOCK else [])
            n = lost = wild = 0
            own = []

        for u, v in zip(cuts, cuts[1:], strict=False):
            arcs = g.into[v]
            least, most = self.low[v] - self.low[u], self.high[v] - self.high[u]
            plain = rank[v] == rank[u] + 1 and all(a.word is not None for a in arcs)
            size = 1 if plain else (least + most + 1) // 2
            if n and n + size > BLOCK:
                close(u)
            if plain:
                own += [(n, w) for w in {a.word: 0 for a in arcs}]
            else:
                wild |= ((1 << size) - 1) << n
                lost += max(most - size, size - least)
            n += size
            if n >= BLOCK:
                close(v)
        if self.bounds[-1] != cuts[-1]:
            close(cuts[-1])
        ones = (1 << BLOCK) - 1
        # Patterns lie at the upper bits; the bits below stay at no errors.
        self.lens, self.slack = np.array(lens, np.int64), np.array(slack, np.int64)
        self.always = np.array([((w << BLOCK - k) | ((1 << BLOCK - k) - 1)) & ones for w, k in zip(any_, lens, strict=True)], np.uint64)
        masks: dict[str, dict[int, int]] = {}
        for lane, (own, k) in enumerate(zip(sets, lens, strict=True)):
            for bit, w in own:
                of = masks.setdefault(w, {})
                of[lane] = of.get(lane, 0) | 1 << bit + BLOCK - k
        self.masks = masks

    def windows(self, inner: int, more: int) -> dict[int, tuple[int, int]]:
        """The columns of each node, from and to; those of the inner window at the bounds are kept beside."""
        self.inner, self.more = inner, more
        m, off = len(self.hyp), self.centre - self.low_at
        out: dict[int, tuple[int, int]] = {}
        k = 0
        for v in self.g.order:
            lo, hi = m, 0
            if v == self.bounds[k + 1]:
                blocks = (k, k + 1) if k + 2 < len(self.bounds) else (k,)
                k = blocks[-1]
            else:
                blocks = (k,)
            for b in blocks:
                lo = min(lo, self.low[v] + int(min(off[b], off[b + 1])) - inner - more)
                hi = max(hi, self.high[v] - int(self.high_at[b] - self.low_at[b]) + int(max(off[b], off[b + 1])) + inner + more + 1)
            lo = min(max(0, lo), m)
            out[v] = lo, max(lo + 1, min(m + 1, hi))
        return out

    def outside(self, dels: int, inss: int) -> np.ndarray:
        """The least errors of each block that ends outside the inner window, of paths with at most so many deletions and insertions."""
        m, count = len(self.hyp), len(self.lens)
        vp, vn = np.uint64(0xFFFFFFFFFFFFFFFF) << (BLOCK - np.maximum(self.lens, 1)).astype(np.uint64), np.zeros(count, np.uint64)
        vp[self.lens == 0] = 0
        best = self.lens.astype(np.uint8)
        eq, d0, hp, hn = (np.empty(count, np.uint64) for _ in range(4))
        # Errors are read at every fourth column; two columns further there are at most two less.
        every, near = 4, 2
        centre, column = self.centre[1:], np.arange(1, m + 1)
        x0 = np.searchsorted(centre, column - (self.inner - near), "left").tolist()
        x1 = np.searchsorted(centre, column + (self.inner - near), "right").tolist()
        dense: dict[str, np.ndarray] = {}
        sparse: dict[str, tuple[list[int], np.ndarray, np.ndarray]] = {}
        for w, of in self.masks.items():
            where, bits = np.array(list(of), np.int64), np.array(list(of.values()), np.uint64)
            if 8 * len(where) > count and len(dense) < 500:
                dense[w] = np.zeros(count, np.uint64)
                dense[w][where] = bits
            else:
                sparse[w] = list(of), where, bits
        one, step = np.uint64(1), 256
        for begin in range(0, m, step):
            a = int(np.searchsorted(self.high_at[1:] + inss, begin, "left"))
            z = int(np.searchsorted(self.low_at[:-1] - dels, begin + step, "right"))
            if a >= z:
                continue
            cut = slice(a, z)
            VP, VN, EQ, D0, HP, HN, base = vp[cut], vn[cut], eq[cut], d0[cut], hp[cut], hn[cut], self.always[cut]
            for j in range(begin, min(m, begin + step)):
                np.bitwise_or(base, VN, out=EQ)
                w = self.hyp[j]
                if w in sparse:
                    lanes, where, bits = sparse[w]
                    x, y = bisect_left(lanes, a), bisect_left(lanes, z)
                    if x < y:
                        eq[where[x:y]] |= bits[x:y]
                elif w in dense:
                    np.bitwise_or(EQ, dense[w][cut], out=EQ)
                np.bitwise_and(EQ, VP, out=D0)
                np.add(D0, VP, out=D0)
                np.bitwise_xor(D0, VP, out=D0)
                np.bitwise_or(D0, EQ, out=D0)
                np.bitwise_and(VP, D0, out=HN)
                np.bitwise_or(VP, D0, out=HP)
                np.invert(HP, out=HP)
                np.bitwise_or(HP, VN, out=HP)
                np.left_shift(HP, one, out=HP)
                np.left_shift(HN, one, out=HN)
                np.bitwise_and(HP, D0, out=VN)
                np.bitwise_or(HP, D0, out=VP)
                np.invert(VP, out=VP)
                np.bitwise_or(VP, HN, out=VP)
                if j % every == 0 or j == m - 1:
                    # A column of the table begins with no errors: its differences add up to those of the whole block.
                    score = np.bitwise_count(VP) - np.bitwise_count(VN)
                    p, q = min(max(x0[j], a), z), min(max(x1[j], a), z)
                    np.minimum(best[a:p], score[: p - a], out=best[a:p])
                    np.minimum(best[q:z], score[q - a :], out=best[q:z])
        return np.maximum(best.astype(np.int64) - near - self.slack, 0)

    def proved(self, least: np.ndarray, greatest: np.ndarray, p: int, q: int, dels: int, inss: int) -> bool:
        """Whether all paths that leave the windows weigh more than the best inside.

        ``least`` and ``greatest``: the weights found (errors times ``q`` less words times ``p``) at
        each bound within the inner window.
        """
        blocks = self.outside(dels, inss)
        paid = q * np.concatenate([[0], np.cumsum(blocks)])  # before each bound
        words = p * self.high_at
        off, spread = self.centre - self.low_at, self.high_at - self.low_at
        drift = 2 * (np.concatenate([[0], np.cumsum(np.abs(np.diff(off)))]) + spread)
        count = len(self.bounds)
        for k in range(1, min(SHORT, count - 1) + 1):
            a, b = slice(0, count - k), slice(k, count)
            out = np.maximum(paid[k - 1 : count - 1] - paid[a], q * (2 * self.more - (drift[b] - drift[a])))
            if not (out - (words[b] - words[a]) > greatest[b] - least[a]).all():
                return False
        if count - 1 > SHORT:
            before = np.maximum.accumulate(paid - words - least)[: count - SHORT - 1]
            after = paid[SHORT:-1] - words[SHORT + 1 :] - greatest[SHORT + 1 :]
            return bool((after - before > 0).all())
        return True
