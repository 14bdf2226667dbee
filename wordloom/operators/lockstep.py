"""The program of ``align`` over many graphs of like size at once, a node of each at a time.

A row has a column for each place of the hypothesis that the best path can have at its node,
counted from the least number of words on the way there; so a word and its match keep their
column.  All arcs into the nodes of one step are weighed together; where a node has several,
the earlier of equal ones stays.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

from wordloom.functions.tokens import UNCOUNTED
from wordloom.operators.graphs import ReferenceGraph

_DIAG, _DEL, _EMPTY, _INS = 0, 1, 2, 3
_BIG = np.int64(1) << np.int64(62)
#: More than any path weighs, and the bits of a weight that are less.
_NONE, ROOM = np.int64(1) << np.int64(61), 60
#: Most arcs into a node.
ARCS = 60
#: Back-pointers of so many cells are kept, and rows of so many are made at a time.
CELLS, ROW = 48_000_000, 12_288


class Job:
    """A graph and its hypothesis; ``usable`` is false where it must be aligned by itself."""

    def __init__(self, graph: ReferenceGraph, hyp: list[str]) -> None:
        self.g, self.hyp, self.m = graph, hyp, len(hyp)
        order, into = graph.order, graph.into
        rank = [0] * graph.size
        for i, v in enumerate(order):
            rank[v] = i
        uses = [0] * graph.size
        for a in graph.arcs:
            uses[a.src] += 1
        ids: dict[str, int] = {}
        self.words = np.array([ids.setdefault(w, len(ids)) for w in hyp], np.int32)
        n = len(order)
        low, high, slot = [0] * n, [0] * n, [0] * n
        free: list[int] = []
        self.slots = 1
        arcs: list[int] = []  # step, which, slot, shift, word, and of its weight: words ahead, uncounted, mark
        self.spread = marks = most = 0
        get = ids.get
        for i in range(1, n):
            own = into[order[i]]
            if len(own) == 1 and own[0].word is not None:  # nearly all
                a = own[0]
                r = rank[a.src]
                low[i], high[i] = low[r] + 1, high[r] + 1
                arcs += i, 0, slot[r], 0, get(a.word, -1), 1, a.word in UNCOUNTED, 0
                if uses[a.src] == 1:
                    slot[i] = slot[r]
                    continue
            else:
                lo, hi = n, 0
                for a in own:
                    r = rank[a.src]
                    said = a.word is not None
                    lo = min(lo, low[r] + said)
                    hi = max(hi, high[r] + said)
                low[i], high[i] = lo, hi
                self.spread = max(self.spread, hi - lo)
                most = max(most, len(own))
                for k, a in enumerate(own):
                    r = rank[a.src]
                    ahead = lo - low[r]
                    if a.word is None:
                        marks += a.mark
                        arcs += i, k, slot[r], 1 - ahead, -3, ahead, 0, a.mark
                    else:
                        arcs += i, k, slot[r], 1 - ahead, get(a.word, -1), ahead, a.word in UNCOUNTED, 0
            for a in own:
                uses[a.src] -= 1
                if uses[a.src] == 0:
                    free.append(slot[rank[a.src]])
            if free:
                slot[i] = free.pop()
            else:
                slot[i] = self.slots
                self.slots += 1
        self.n, self.marks = n, marks
        self.low, self.slot = np.array(low, np.int64), np.array(slot, np.int64)
        self.shortest, self.longest = (low[-1], high[-1]) if n else (0, 0)
        self.arcs = np.array(arcs, np.int64).reshape(-1, 8)
        self.usable = n == graph.size > 1 and order[-1] == graph.end and most <= ARCS

    def limit(self, rate: Fraction | None, most: int) -> None:
        """Weights and width of a round; ``most`` as for ``align._Rows``."""
        self.p, self.q = (rate.numerator, rate.denominator) if rate is not None else (0, 1)
        self.most = most
        self.dels = max(0, (most + self.longest - self.m) // 2)
        inss = max(0, (most + self.m - self.shortest) // 2)
        self.width = max(self.spread + self.dels + inss, self.m - self.shortest + self.dels) + 1

    def fits(self, width: int) -> bool:
        """Whether the weights fit into one integer in rows of a width; sets how they are packed."""
        self.half_bits = (3 * self.most + 3).bit_length()
        self.fine_bits = self.half_bits + (self.most + self.spread + 2 * self.marks + 2).bit_length()
        main = self.q * (2 * width + self.most + self.n + 1) + self.p * (self.spread + self.n + 1)
        return main.bit_length() + self.fine_bits <= ROOM and self.n * width <= CELLS


def solve(jobs: list[Job]) -> dict[int, list]:
    """The steps of each job's best path, as ``align._Rows.solve``, by its place; those that don't fit are left out."""
    out: dict[int, list] = {}
    todo = sorted((j.width, j.n, k) for k, j in enumerate(jobs) if j.usable and j.fits(j.width))
    while todo:
        width = todo[-1][0]  # the widest first; others join it while they are not much narrower
        group: list[int] = []
        longest = 0
        while todo and (not group or todo[-1][0] * 4 > width * 3 - 64):
            longest = max(longest, todo[-1][1])
            count = len(group) + 1
            if group and (count * width > ROW or count * width * longest > CELLS or not jobs[todo[-1][2]].fits(width)):
                break
            group.append(todo.pop()[2])
        group.sort(key=lambda k: -jobs[k].n)
        out.update(zip(group, _together([jobs[k] for k in group], width), strict=True))
    return out


def _together(jobs: list[Job], W: int) -> list[list]:
    """Jobs, the longest first, in rows of one width."""
    count, longest = len(jobs), jobs[0].n
    ints = lambda f: np.array([f(j) for j in jobs], np.int64)
    sizes = ints(lambda j: len(j.arcs))
    who = np.repeat(np.arange(count), sizes)
    table = np.concatenate([j.arcs for j in jobs])
    # The first arcs of all into a step's nodes, then the second ones.
    sort = np.lexsort((who, table[:, 1], table[:, 0]))
    table, who = table[sort], who[sort]
    step, which, slot, shift, word, ahead, uncounted, mark = table.T
    p, q, fine, half = (ints(f)[who] for f in (lambda j: j.p, lambda j: j.q, lambda j: j.fine_bits, lambda j: j.half_bits))
    own = p * (ahead + uncounted)
    weigh = lambda main, steps, halves: (main << fine) + (steps << half) + halves
    empty = word == -3
    cor = np.where(empty, _NONE, weigh(own - p, 1 - ahead, 0))[:, None]
    more = np.where(empty, 0, (q << fine) + 3)[:, None]
    lost = np.where(empty, weigh(own, 2 * mark - ahead, 0), weigh(q - p + own, 1 - ahead, 2))[:, None]
    code = word.astype(np.int32)[:, None]
    # Hypotheses with room on either side, end to end; a node's columns begin at the word that a match in the first of them takes.
    before = ints(lambda j: j.dels) + 1
    lengths = before + ints(lambda j: j.m) + W + ints(lambda j: j.longest)
    begins = np.cumsum(lengths) - lengths
    words = np.full(int(lengths.sum()) + W, -2, np.int32)
    for j, b, x in zip(jobs, begins.tolist(), before.tolist(), strict=True):
        words[b + x : b + x + j.m] = j.words
    heard = np.lib.stride_tricks.sliding_window_view(words, W)
    lows = np.concatenate([j.low for j in jobs])
    first = np.cumsum(ints(lambda j: j.n)) - ints(lambda j: j.n)
    at = begins[who] + lows[first[who] + step]
    source = slot * count + who
    edges = np.searchsorted(step, np.arange(longest + 1)).tolist()
    moved: dict[int, list[tuple[int, int]]] = {}
    for e in np.flatnonzero(shift).tolist():
        moved.setdefault(int(step[e]), []).append((e, int(shift[e])))
    target = np.concatenate([j.slot for j in jobs]) * count + np.repeat(np.arange(count), ints(lambda j: j.n))
    active = np.searchsorted(-ints(lambda j: j.n), -np.arange(longest), "left").tolist()
    slope = np.arange(W, dtype=np.int64) * ints(lambda j: (j.q << j.fine_bits) + (1 << j.half_bits) + 2)[:, None]
    rows = np.full((max(j.slots for j in jobs) * count, W + 1), _BIG)
    back = np.empty((longest, count, W), np.uint8)

    def ended(best: np.ndarray, i: int, how: np.ndarray) -> None:
        """Takes the row of a step, with insertions along it."""
        k = len(best)
        np.minimum(best, _BIG, out=best)
        run = best - slope[:k]
        np.minimum.accumulate(run, axis=1, out=run)
        run += slope[:k]
        np.putmask(how, run < best, _INS)
        rows[target[first[:k] + i], :W] = run
        back[i, :k] = how

    best = np.full((count, W), _BIG)
    best[np.arange(count), before - 1] = 0
    ended(best, 0, np.zeros((count, W), np.uint8))
    for i in range(1, longest):
        a, z, k = edges[i], edges[i + 1], active[i]
        src = rows[source[a:z]]
        for e, n in moved.get(i, ()):
            row = src[e - a]
            if n <= W:
                row[n:] = row[:-n].copy()
            row[:n] = _BIG
        diag = (heard[at[a:z]] != code[a:z]) * more[a:z]
        diag += cor[a:z]
        diag += src[:, :W]
        down = src[:, 1:] + lost[a:z]
        how = (down < diag).view(np.uint8)
        np.minimum(diag, down, out=diag)
        for e in range(a + k, z):  # the other arcs, in order
            b = who[e]
            won = diag[e - a] < diag[b]
            np.copyto(diag[b], diag[e - a], where=won)
            np.copyto(how[b], how[e - a] + np.uint8(4 * which[e]), where=won)
        ended(diag[:k], i, how[:k])
    told, out = memoryview(back).cast("B"), []
    for b, j in enumerate(jobs):
        order, into, low = j.g.order, j.g.into, j.low.tolist()
        rank = {v: i for i, v in enumerate(order)}
        steps: list = []
        i, y = j.n - 1, j.m
        while i or y:
            x = told[(i * count + b) * W + y - low[i] + j.dels]
            if x & 3 == _INS:
                y -= 1
                steps.append((_INS, None, y))
                continue
            arc = into[order[i]][x >> 2]
            if x & 3 == _DIAG:
                y -= 1
                steps.append((_DIAG, arc, y))
            else:
                steps.append((_DEL if arc.word is not None else _EMPTY, arc, y - 1))
            i = rank[arc.src]
        steps.reverse()
        out.append(steps)
    return out
