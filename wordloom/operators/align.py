"""Alignment of reference graphs with hypotheses, many pairs at once.

One pair is one row, aligned where it lies: pairs are never grouped or shuffled by the
aligner, and throughput comes from many pairs.  Within a pair a dynamic program runs over the
nodes of the reference graph in topological order, each with one numpy row over the
hypothesis.

The best alignment has the least errors per reference word; of equal ones that with the fewest
steps (a synonym is entered and left by a step each), then the least cost (insertion 1, deletion
1, substitution 1.5), then match before substitution, deletion and insertion.  Where alternatives make the number of reference words
vary, the ratio is found by Dinkelbach's rounds of the same program with exact integers.

Three measures keep long pairs cheap and small, all exact.  Rows are limited to a band: the
errors of a known path (by bit vectors, or of the round before) bound those of the best one,
and so how far it can stray.  Plain sequences of like size go through the band together.
Back-pointers are kept for one stretch of rows at a time, computed again from saved rows.
"""

from __future__ import annotations

import gc
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wordloom.functions.tokens import DEL, EPS, FALLBACK, GLOBAL, INS, NOOP, UNCOUNTED
from wordloom.operators import lockstep
from wordloom.operators.corridor import BLOCK, TRIES, Corridor
from wordloom.operators.distance import edit_distance
from wordloom.operators.graphs import Arc, ReferenceGraph

_DIAG, _DEL, _EMPTY, _INS = 0, 1, 2, 3
_BIG = np.int64(1) << np.int64(62)
#: Bits of a weight that one integer holds; what needs more goes by two.
ROOM = 61
#: Back-pointers of so many cells are kept at a time.
CELLS = 16_000_000
#: So many of one pair whose windows are narrow, so that its rows are made once.
KEPT = 240_000_000
#: Graphs of so many nodes are aligned in narrow windows, if these can be proved to do.
LONG = 1_500
#: Graphs of fewer nodes are aligned together.
APART = 4_000
#: Plain pairs of so many words each also are.
LONG_PLAIN = 20_000
#: Pairs of so many words in all are aligned together, and at most so many plain ones in a band.
WORDS = 100_000
TOGETHER = 64

STITCH_FIELDS = "seq long, class_label string, span long, ref_tok string, hyp_tok string, op string, ref_row long, span_row long, span_rows long, hyp_idx long"


@dataclass
class Step:
    """A row of an alignment: the operation, its words and the span of the reference word."""

    op: str
    ref: str
    hyp: str
    span: int
    row: int = -1


def _depths(graph: ReferenceGraph) -> tuple[list[int], list[int]]:
    """Least and greatest number of words on a path to each node."""
    low, high = [0] * graph.size, [0] * graph.size
    for v in graph.order[1:]:
        arcs = graph.into[v]
        low[v] = min(low[a.src] + (a.word is not None) for a in arcs)
        high[v] = max(high[a.src] + (a.word is not None) for a in arcs)
    return low, high


class _Rows:
    """The program over one graph and one hypothesis, with weights for one round.

    ``most``: a number of errors that the best path is known not to exceed.  ``corridor`` limits
    the rows further; what the program finds at its bounds is kept.  ``coarse``: steps and cost are left out.
    """

    def __init__(self, graph: ReferenceGraph, hyp: list[str], rate: Fraction | None, most: int, corridor: Corridor | None = None, windows: dict | None = None, coarse: bool = False, packed: bool = True) -> None:
        self.g, self.m, self.windows, self.coarse = graph, len(hyp), windows, coarse
        self.corridor, self.found = corridor, []
        self.rank = {v: i for i, v in enumerate(graph.order)}
        places: dict[str, list[int]] = {}
        for j, w in enumerate(hyp):
            places.setdefault(w, []).append(j)
        self.places = {w: np.array(p) for w, p in places.items()}
        self.sorted_places = places
        self.low, self.high = low, high = (corridor.low, corridor.high) if corridor else _depths(graph)
        # A path of at most ``most`` errors has so many deletions and insertions at most.
        self.dels = (most + high[graph.end] - self.m) // 2
        self.inss = (most + self.m - low[graph.end]) // 2
        windows = {v: self.window(v) for v in graph.order} if windows is None else windows
        self.windows, self.width = windows, max(hi - lo for lo, hi in windows.values())
        if corridor:
            most += 2 * self.width  # of any path to a cell of the windows
        # Weights: errors less rate times words, then steps, then cost in halves.  Words and steps are
        # counted beyond the least on the way to a node, so that numbers stay small; what has more
        # than ``most`` errors may be counted too high, but never too low.
        self.p, self.q = (rate.numerator, rate.denominator) if rate is not None else (0, 1)
        spread = max(h - n for h, n in zip(high, low, strict=True))
        self.half_bits = (3 * most + 3).bit_length()
        fine_bits = self.half_bits + (most + spread + 2 * sum(a.mark for a in graph.arcs) + 2).bit_length()
        main_bits = (self.q * (self.width + most + 1) + self.p * (spread + 1)).bit_length()
        self.wide, self.packed = main_bits + fine_bits > ROOM, False
        if coarse:
            fine_bits, self.wide = 0, False
        elif self.wide and corridor and packed and int(np.diff(corridor.high_at).max()) <= 4 * BLOCK:
            # Numbers are counted from those of the bound before (see ``_rebased``).
            near = (self.q * (2 * self.width + 4 * BLOCK) + self.p * 4 * BLOCK).bit_length()
            if near + 24 <= ROOM - 2:
                self.packed, self.wide = True, False
                self.half_bits = (ROOM - 2 - near) // 2
                fine_bits = 2 * self.half_bits
        self.fine_bits = fine_bits
        far_bits = 2 + max(fine_bits, self.half_bits + self.width.bit_length() + 1)
        if self.wide and far_bits + self.width.bit_length() > 61:
            raise ValueError("the sequences are too long to be compared")
        self.far = np.int64(1) << np.int64(far_bits)
        self.slope = np.arange(self.width, dtype=np.int64) * self.weight(self.q, 1, 2)
        self.known: dict[tuple[int, bool], tuple] = {}

    def weight(self, main: int, steps: int, half: int) -> np.ndarray | np.int64:
        fine = 0 if self.coarse else (steps << self.half_bits) + half
        return np.array([[main], [fine]], np.int64) if self.wide else np.int64((main << self.fine_bits) + fine)

    def window(self, v: int) -> tuple[int, int]:
        lo = max(0, self.low[v] - self.dels)
        return lo, max(lo, min(self.m, self.high[v] + self.inss) + 1)

    def _along(self, best: np.ndarray) -> np.ndarray:
        """``best`` with insertions along the row."""
        slope = self.slope[..., : best.shape[-1]]
        if not self.wide:
            run = best - slope
            np.minimum.accumulate(run, out=run)
            run += slope
            return run
        main, fine = best - slope
        least = np.minimum.accumulate(main)
        # Within a stretch of equal least main weights the fine ones are compared; an offset for each stretch keeps them apart.
        stretch = np.cumsum(least[1:] < least[:-1]) if len(least) else least
        offset = np.concatenate([[0], stretch])[: len(least)] * (self.far << np.int64(1))
        told = np.minimum.accumulate(np.where(main == least, np.minimum(fine, self.far), self.far) - offset) + offset
        return np.stack([least, told]) + slope

    def _less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1])) if self.wide else a < b

    def _word_row(self, from_lo: int, row: np.ndarray, v: int, arc: Arc, trace: bool) -> tuple[np.ndarray, tuple | None]:
        """The row of a node with one arc into it, of a word: as ``_row``, of numbers that one integer holds."""
        lo, hi = self.windows[v]
        kind = (self.low[v] - self.low[arc.src], arc.word in UNCOUNTED)
        if kind not in self.known:
            own = self.p * (kind[0] + kind[1])
            self.known[kind] = tuple(self.weight(main, 1 - kind[0], half) for main, half in ((self.q - self.p + own, 3), (own - self.p, 0), (self.q - self.p + own, 2)))
        sub, cor, lost = self.known[kind]
        size, end = hi - lo, from_lo + len(row)
        best = np.empty(size, np.int64)
        # Columns of the word matched or replaced, then of the word left out.
        a, z = max(from_lo + 1, lo), min(end + 1, hi)
        if a < z:
            best[: a - lo] = _BIG
            best[z - lo :] = _BIG
            src = row[a - 1 - from_lo : z - 1 - from_lo]
            np.add(src, sub, out=best[a - lo : z - lo])
            same = self.sorted_places.get(arc.word)
            if same is not None:
                x, y = bisect_left(same, a - 1), bisect_left(same, z - 1)
                if x < y:
                    at = self.places[arc.word][x:y]
                    best[at + (1 - lo)] = row[at - from_lo] + cor
        else:
            best[:] = _BIG
        how = np.zeros(size, np.uint8) if trace else None
        a, z = max(from_lo, lo), min(end, hi)
        if a < z:
            left, old = row[a - from_lo : z - from_lo] + lost, best[a - lo : z - lo]
            if trace:
                np.less(left, old, out=how[a - lo : z - lo].view(bool))  # 1 is ``_DEL``
            np.minimum(old, left, out=old)
        np.minimum(best, _BIG, out=best)
        slope = self.slope[:size]
        run = best - slope
        np.minimum.accumulate(run, out=run)
        run += slope
        if trace:
            np.putmask(how, run < best, _INS)
        return run, (lo, how, None) if trace else None

    def _row(self, rows: dict[int, tuple[int, np.ndarray]], v: int, trace: bool) -> tuple[np.ndarray, tuple | None]:
        arcs = self.g.into[v]
        if not self.wide and len(arcs) == 1 and arcs[0].word is not None:
            return self._word_row(*rows[arcs[0].src], v, arcs[0], trace)
        lo, hi = self.windows[v]
        best = np.full((2, hi - lo) if self.wide else hi - lo, _BIG)
        how = np.zeros(hi - lo, np.uint8) if trace else None
        which = np.zeros(hi - lo, np.uint16 if len(arcs) <= 1 << 16 else np.uint32) if trace and len(arcs) > 1 else None

        def offer(values: np.ndarray, at: int, op: int, k: int, first: bool = False) -> None:
            """Values for the columns from ``at`` on; the earlier of equal offers stays."""
            a, z = max(at, lo), min(at + values.shape[-1], hi)
            if a >= z:
                return
            cut, old = values[..., a - at : z - at], best[..., a - lo : z - lo]
            if first:
                old[...] = cut
                return
            won = self._less(cut, old)
            np.copyto(old, cut, where=won)
            if trace:
                np.putmask(how[a - lo : z - lo], won, op)
                if which is not None:
                    np.putmask(which[a - lo : z - lo], won, k)

        if v == self.g.order[0] and lo == 0 and hi > 0:
            best[..., 0] = 0
        for k, a in enumerate(arcs):
            from_lo, row = rows[a.src]
            ahead = self.low[v] - self.low[a.src]  # words that the least path has on the way
            own = self.p * (ahead + (a.word in UNCOUNTED))  # a symbol that is no word gives its share back
            if a.word is None:
                offer(row + self.weight(own, 2 * a.mark - ahead, 0), from_lo, _EMPTY, k)
                continue
            n = min(row.shape[-1], self.m - from_lo)
            if n > 0:
                stepped = row[..., :n] + self.weight(self.q - self.p + own, 1 - ahead, 3)
                same = self.places.get(a.word)
                if same is not None:
                    same = same[np.searchsorted(same, from_lo) : np.searchsorted(same, from_lo + n)] - from_lo
                    stepped[..., same] = row[..., same] + self.weight(own - self.p, 1 - ahead, 0)
                offer(stepped, from_lo + 1, _DIAG, k, k == 0)
            offer(row + self.weight(self.q - self.p + own, 1 - ahead, 2), from_lo, _DEL, k)
        np.minimum(best, _BIG, out=best)
        run = self._along(best)
        won = self._less(run, best)
        if trace:
            np.putmask(how, won, _INS)
        np.copyto(best, run, where=won)
        return best, (lo, how, which) if trace else None

    def _rebased(self, row: np.ndarray) -> tuple[np.ndarray, int]:
        """A row at a node that all paths cross, with its three numbers less their least, and the least main one.

        What all paths have in common is no matter beyond such a node.  The numbers keep room for what
        a block adds; where they don't, ``OverflowError`` is raised.
        """
        there = row < _BIG >> 1
        main, fine = row >> np.int64(self.fine_bits), row & np.int64((1 << self.fine_bits) - 1)
        steps, half = fine >> np.int64(self.half_bits), fine & np.int64((1 << self.half_bits) - 1)
        (main, base), (steps, _), (half, _) = ((x - x[there].min(), int(x[there].min())) for x in (main, steps, half))
        if max(steps[there].max(), half[there].max()) + 3 * (self.width + 4 * BLOCK) >= 1 << self.half_bits or main[there].max() > self.q * 2 * self.width:
            raise OverflowError
        return np.where(there, (main << np.int64(self.fine_bits)) + (steps << np.int64(self.half_bits)) + half, _BIG), base

    def solve(self) -> list[tuple[int, Arc | None, int]]:
        """The steps of the path of least weight as (operation, arc, hypothesis place), in order."""
        order, g = self.g.order, self.g
        uses = [0] * g.size
        for a in g.arcs:
            uses[a.src] += 1
        width = max(1, self.width)
        stretch = len(order) if len(order) * width <= (KEPT if self.corridor else CELLS) else max(1, CELLS // width)
        bounds = set(self.corridor.bounds) if self.corridor else ()
        rows: dict[int, tuple[int, np.ndarray]] = {}
        left = uses[:]
        saved: list[dict[int, tuple[int, np.ndarray]]] = []
        kept: list | None = [] if stretch >= len(order) else None
        total = 0
        for i, v in enumerate(order):
            if i % stretch == 0:
                saved.append(dict(rows))
            row, back = self._row(rows, v, kept is not None)
            if kept is not None:
                kept.append(back)
            rows[v] = (self.windows[v][0], row)
            if v in bounds:
                if self.packed:
                    kept_row, base = self._rebased(row)
                    total += base
                    rows[v] = (rows[v][0], kept_row)
                self.found.append((v, *rows[v], total))
            for a in g.into[v]:
                left[a.src] -= 1
                if left[a.src] == 0:
                    rows.pop(a.src, None)
        steps: list[tuple[int, Arc | None, int]] = []
        v, j, at = g.end, self.m, -1
        while not (v == order[0] and j == 0):
            i = self.rank[v]
            if i // stretch != at:
                at = i // stretch
                if kept is None or stretch < len(order):
                    kept, part = [], dict(saved[at])
                    for u in order[at * stretch : (at + 1) * stretch]:
                        row, back = self._row(part, u, True)
                        part[u] = (self.windows[u][0], self._rebased(row)[0] if self.packed and u in bounds else row)
                        kept.append(back)
            lo, how, which = kept[i - at * stretch]
            op = int(how[j - lo])
            if op == _INS:
                steps.append((_INS, None, j - 1))
                j -= 1
                continue
            arc = g.into[v][int(which[j - lo]) if which is not None else 0]
            steps.append((op, arc, j - 1))
            v, j = arc.src, j - (op == _DIAG)
        steps.reverse()
        return steps


    def proved(self, errors: int) -> bool:
        """Whether the best path, of so many errors at most, can't leave the windows."""
        c = self.corridor
        least, greatest = [], []
        for (v, lo, row, base), at in zip(self.found, c.centre.tolist(), strict=True):
            main = row[0] if self.wide else row >> np.int64(self.fine_bits)
            main = main[max(0, at - c.inner - lo) : at + c.inner + 1 - lo] + (base - self.p * self.low[v])
            least.append(int(main.min()))
            greatest.append(int(main.max()) + (not self.wide))
        dels, inss = (errors + self.high[self.g.end] - self.m) // 2, (errors + self.m - self.low[self.g.end]) // 2
        return c.proved(np.array(least), np.array(greatest), self.p, self.q, dels, inss)


def _tally(steps: list[tuple[int, Arc | None, int]], hyp: list[str]) -> tuple[int, int]:
    """Errors and reference words of a path."""
    errors = words = 0
    for op, arc, j in steps:
        if op == _INS:
            errors += 1
        elif op in (_DIAG, _DEL):
            errors += op == _DEL or arc.word != hyp[j]
            words += arc.word not in UNCOUNTED
    return errors, words


# --- plain sequences ---------------------------------------------------------------------


def _codes(ref: list[str], hyp: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ids: dict[str, int] = {}
    number = lambda words: np.array([ids.setdefault(w, len(ids)) for w in words], np.int32)
    return number(ref), number(hyp)


def _in_band(pairs: list[tuple[np.ndarray, np.ndarray, int]]) -> list[np.ndarray]:
    """Operations, in order, of pairs of coded sequences of known distance, all in one band.

    Without alternatives the number of reference words is fixed, so the least errors, then the
    fewest steps (insertions and deletions), are the whole objective.  A row has a column for
    each distance from the diagonal that a path of that many errors can have; shorter pairs
    are padded by words that match nothing, which no path to their own end touches.
    """
    ns, ms = np.array([len(a) for a, _, _ in pairs]), np.array([len(b) for _, b, _ in pairs])
    far = np.array([d for _, _, d in pairs])
    dels, inss = int(((far + ns - ms) // 2).max()), int(((far + ms - ns) // 2).max())
    n, m, count, width = int(ns.max()), int(ms.max()), len(pairs), dels + inss + 1
    bits = (n + m + 1).bit_length()
    kind = np.int32 if 2 * bits < 29 else np.int64
    step, sub, most = kind((1 << bits) + 1), kind(1 << bits), kind(1) << kind(29 if kind is np.int32 else 61)
    ref = np.full((n, count), -1, np.int32)
    hyp = np.full((dels + n + width, count), -2, np.int32)  # hyp[dels + j] is the word of place j
    for p, (a, b, _) in enumerate(pairs):
        ref[: len(a), p] = a
        cut = b[: n + width]
        hyp[dels : dels + len(cut), p] = cut
    slope, shape = np.arange(width, dtype=kind) * step, (width,) if count == 1 else (width, count)
    if count == 1:
        ref, hyp = ref[:, 0], hyp[:, 0]
    else:
        slope = slope[:, None]
    diag, down, run, neq = np.empty(shape, kind), np.empty(shape, kind)[1:], np.empty(shape, kind), np.empty(shape, bool)

    def advance(row: np.ndarray, first: int, end: int, back: np.ndarray | None) -> np.ndarray:
        """Rows ``first`` + 1 to ``end``; column b of row i is hypothesis place i - dels + b."""
        row = row.copy()
        for i in range(first, end):
            np.not_equal(hyp[i : i + width], ref[i], out=neq)
            np.multiply(neq, sub, out=diag)
            np.add(diag, row, out=diag)
            np.add(row[1:], step, out=down)
            if back is not None:
                how = back[i - first]
                np.less(down, diag[:-1], out=how[:-1].view(bool))
                how[-1] = 0
            np.minimum(diag[:-1], down, out=diag[:-1])
            np.subtract(diag, slope, out=run)
            np.minimum.accumulate(run, axis=0, out=run)
            np.add(run, slope, out=row)
            if back is not None:
                np.less(row, diag, out=neq)
                np.putmask(how, neq, _INS)
        return row

    start = np.full(shape, most)
    start[dels:] = slope[: inss + 1]
    stretch = max(1, CELLS // (width * count))
    back = np.empty((min(n, stretch), *shape), np.uint8)
    saved = [start]
    for first in range(0, n - stretch, stretch):
        saved.append(advance(saved[-1], first, first + stretch, None))
    # Each pair is traced back through the stretches, the last first.
    at = list(zip(ns.tolist(), ms.tolist(), strict=True))
    trails: list[bytearray] = [bytearray() for _ in pairs]
    for k in range(len(saved) - 1, -1, -1):
        first = k * stretch
        advance(saved[k], first, min(n, first + stretch), back)
        for p, trail in enumerate(trails):
            i, j = at[p]
            if i <= first:
                continue
            told = (back[: i - first] if count == 1 else back[: i - first, :, p]).tobytes()
            place = (i - 1 - first) * width + j - i + dels
            while i > first and j:
                op = told[place]
                trail.append(op)
                if op == _INS:
                    j -= 1
                    place -= 1
                elif op == _DEL:
                    i -= 1
                    place -= width - 1
                else:
                    i -= 1
                    j -= 1
                    place -= width
            if j == 0:
                trail.extend(bytes([_DEL]) * i)
                i = 0
            at[p] = i, j
    return [np.frombuffer(bytes(t[::-1]), np.uint8) if j == 0 else np.frombuffer(bytes([_INS]) * j + bytes(t[::-1]), np.uint8) for t, (_, j) in zip(trails, at, strict=True)]


def plain_operations(pairs: list[tuple[list[str], list[str]]]) -> list[np.ndarray]:
    """The operations (``_DIAG``, ``_DEL``, ``_INS``) of the best alignment of each pair of word sequences."""
    out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(pairs)
    todo = []
    for k, (ref, hyp) in enumerate(pairs):
        if not ref or not hyp:
            out[k] = np.full(len(ref) + len(hyp), _DEL if ref else _INS, np.uint8)
            continue
        if min(len(ref), len(hyp)) >= LONG_PLAIN:
            graph = ReferenceGraph()
            graph.add_words(ref)
            graph.finish()
            if (steps := _in_corridor(graph, hyp, False)) is not None:
                out[k] = np.array([op for op, _, _ in steps], np.uint8)
                continue
        a, b = _codes(ref, hyp)
        far = edit_distance(a.tolist(), b.tolist())
        todo.append((len(a), far, k, a, b))
    todo.sort(key=lambda x: x[:3])
    while todo:
        # The longest first; others join it while the band of all is not much more than their own.
        group, own = [], 0
        dels = inss = 0
        while todo and len(group) < TOGETHER:
            n, far, _, _, b = todo[-1]
            d, e = max(dels, (far + n - len(b)) // 2), max(inss, (far + len(b) - n) // 2)
            whole = (group[0][0] if group else n) * (d + e + 1) * (len(group) + 1)
            own += n * (far + 1)
            if group and (whole > CELLS or whole > 2 * own):
                break
            dels, inss = d, e
            group.append(todo.pop())
        for (_, _, k, _, _), ops in zip(group, _in_band([(a, b, far) for _, far, _, a, b in group]), strict=True):
            out[k] = ops
    return out


def _places(ops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The reference and hypothesis places of operations: that of the word, or of the one ahead."""
    return np.cumsum(ops != _INS) - 1, np.cumsum(ops != _DEL) - 1


# --- graphs ------------------------------------------------------------------------------


def align_graphs(graphs: list[ReferenceGraph], hyps: list[list[str]]) -> list[list[Step]]:
    """``align_graph`` of many; those without alternatives are aligned together."""
    plain = [k for k, g in enumerate(graphs) if not g.spans]
    arcs = {k: [graphs[k].into[v][0] for v in graphs[k].order[1:]] for k in plain}
    out: list[list[Step]] = [[] for _ in graphs]
    for k, ops in zip(plain, plain_operations([([a.word for a in arcs[k]], hyps[k]) for k in plain]), strict=True):
        x, y = _places(ops)
        out[k] = _steps(graphs[k], [(op, arcs[k][i] if op != _INS else None, j) for op, i, j in zip(ops.tolist(), x.tolist(), y.tolist(), strict=True)], hyps[k])
    others = [k for k, g in enumerate(graphs) if g.spans]
    for k, steps in zip(others, best_paths([(graphs[k], hyps[k]) for k in others]), strict=True):
        out[k] = _steps(graphs[k], steps, hyps[k])
    return out


def align_graph(graph: ReferenceGraph, hyp: list[str]) -> list[Step]:
    """The best alignment of a finished graph with the words of a hypothesis."""
    return align_graphs([graph], [hyp])[0]


def _some_arcs(graph: ReferenceGraph) -> list[Arc]:
    """One path through a graph."""
    arcs, v = [], graph.end
    while v != graph.order[0]:
        arcs.append(graph.into[v][0])
        v = arcs[-1].src
    return arcs[::-1]


def _some_path(graph: ReferenceGraph) -> list[str]:
    """The words of one path through a graph."""
    return [a.word for a in _some_arcs(graph) if a.word is not None]


def _in_corridor(graph: ReferenceGraph, hyp: list[str], rated: bool) -> list[tuple[int, Arc | None, int]] | None:
    """The steps of the best path of a long pair, or nothing where narrow windows are not proved to hold it.

    ``rated``: the least errors per word are sought, else the least errors.
    """
    if min(graph.size, len(hyp)) < LONG:
        return None
    said = _some_arcs(graph)
    corridor = Corridor(graph, hyp, said, *_depths(graph))
    if not corridor.usable:
        return None
    errors, words = corridor.errors, sum(a.word is not None and a.word not in UNCOUNTED for a in said)
    longest = corridor.high[graph.end]
    for inner, more in TRIES:
        windows = corridor.windows(inner, more)
        coarse = rated and inner == TRIES[0][0]  # the first round alone: it looks for a better rate only
        while True:
            rate = Fraction(errors, words) if rated and words else None
            most = max(errors, int(rate * longest)) if rate is not None else errors
            rows = _Rows(graph, hyp, rate, most, corridor, windows, coarse)
            try:
                steps = rows.solve()
            except OverflowError:
                rows = _Rows(graph, hyp, rate, most, corridor, windows, packed=False)
                steps = rows.solve()
            e, w = _tally(steps, hyp)
            better = rate is not None and e * words < errors * w
            if e and better:
                errors, words = e, w
            elif not coarse:
                break
            coarse = False
        if rated and not (e and w and words):
            return None  # nothing to weigh by words
        if rows.proved(max(e, int(rate * longest)) if rate is not None else e):
            return steps
    return None


def best_path(graph: ReferenceGraph, hyp: list[str]) -> list[tuple[int, Arc | None, int]]:
    """The steps of the least rate: rounds of the program until a round finds no better one."""
    if (steps := _in_corridor(graph, hyp, True)) is not None:
        return steps
    said = _some_path(graph)
    errors, words = edit_distance(said, hyp), sum(w not in UNCOUNTED for w in said)
    shortest, longest = (d[graph.end] for d in _depths(graph))
    if not hyp and not shortest:  # a path without words says nothing, and nothing was heard
        errors = 0
    steps = None
    while errors:
        # A path as good as the known one has at most its rate times the most words as errors; any path with words is better than one without.
        rate = Fraction(errors, words) if words else Fraction(errors + len(hyp) + graph.size)
        steps = _Rows(graph, hyp, rate, max(errors, int(rate * longest)) if words else longest + len(hyp)).solve()
        e, w = _tally(steps, hyp)
        if words and e * words >= errors * w or not words and not w:
            break
        errors, words = e, w
    if errors == 0 or words == 0:
        # Nothing to weigh by words: the least errors.
        steps = _Rows(graph, hyp, None, errors).solve()
    return steps


def best_paths(pairs: list[tuple[ReferenceGraph, list[str]]]) -> list[list[tuple[int, Arc | None, int]]]:
    """``best_path`` of many; each round is run for all together but the longest (see ``lockstep``)."""
    out: list = [None] * len(pairs)
    todo: list[tuple[int, lockstep.Job, int, int]] = []
    for k, (graph, hyp) in enumerate(pairs):
        if min(graph.size, len(hyp)) < APART and (job := lockstep.Job(graph, hyp)).usable:
            said = _some_path(graph)
            # As in ``best_path``: a path without words says nothing, and nothing was heard.
            errors = edit_distance(said, hyp) if hyp or job.shortest else 0
            todo.append((k, job, errors, sum(w not in UNCOUNTED for w in said)))
    while todo:
        for _, job, errors, words in todo:
            if not errors or not words:
                job.limit(None if not errors else Fraction(errors + job.m + job.g.size), errors if not errors else job.longest + job.m)
            else:
                job.limit(rate := Fraction(errors, words), max(errors, int(rate * job.longest)))
        found, again = lockstep.solve([job for _, job, _, _ in todo]), []
        for n, (k, job, errors, words) in enumerate(todo):
            if n not in found:
                continue
            e, w = _tally(found[n], job.hyp)
            if errors and (e * words < errors * w if words else w):
                again.append((k, job, e, w))
            elif words or not errors:
                out[k] = found[n]
        todo = again
    return [steps if steps is not None else best_path(*pairs[k]) for k, steps in enumerate(out)]


def _steps(graph: ReferenceGraph, steps: list, hyp: list[str]) -> list[Step]:
    out: list[Step] = []
    inside = -1
    filled = {a.span for op, a, _ in steps if op in (_DIAG, _DEL)}
    # The span of the next step that is no insertion.
    later, after = [-1] * len(steps), -1
    for n in range(len(steps) - 1, -1, -1):
        later[n] = after
        if steps[n][0] != _INS:
            after = steps[n][1].span
    for n, (op, arc, j) in enumerate(steps):
        if op == _INS:
            # An insertion between two words of a span belongs to it.
            out.append(Step("ins", INS, hyp[j], inside if inside >= 0 and later[n] == inside else -1))
            continue
        inside = arc.span
        if op == _EMPTY:
            if not arc.mark and arc.span >= 0:
                name = graph.spans[arc.span]
                fallback = name.rstrip("_").endswith("_" + FALLBACK)
                if arc.span not in filled:
                    out.append(Step("noop", NOOP, NOOP, arc.span) if fallback else Step("empty", "", "", arc.span))
        elif op == _DEL:
            out.append(Step("del", arc.word, DEL, arc.span, arc.row))
        else:
            out.append(Step("cor" if arc.word == hyp[j] else "sub", arc.word, hyp[j], arc.span, arc.row))
    return out


def align_words(ref: list[str], hyp: list[str]) -> list[Step]:
    """The best alignment of two sequences of words."""
    graph = ReferenceGraph()
    graph.add_words(ref)
    graph.finish()
    return align_graph(graph, hyp)


def counts(steps: list[Step]) -> dict[str, int]:
    """Insertions, deletions, substitutions and reference words of an alignment."""
    n = {op: sum(s.op == op for s in steps) for op in ("ins", "del", "sub")}
    return n | {"n_ref": sum(s.op in ("cor", "del", "sub") and s.ref not in UNCOUNTED for s in steps)}


def graph_of(tokens: list[str], spans: list[dict] | None, rules: dict[tuple[str, ...], list[list[str]]] | None) -> ReferenceGraph:
    """A finished reference graph.

    ``spans`` are entity spans ``first, last`` (places in ``tokens`` from 0), ``marker`` and
    ``candidates``; the fused words of a span are always a candidate, the last one.
    """
    graph = ReferenceGraph()
    at = 0
    for s in sorted(spans or [], key=lambda s: s["first"]):
        graph.add_words(tokens[at : s["first"]])
        own = tokens[s["first"] : s["last"] + 1]
        graph.add_entity(s["marker"], [*[list(c or []) for c in s["candidates"] or []], own], len(own))
        at = s["last"] + 1
    graph.add_words(tokens[at:])
    if rules:
        graph.add_synonyms(rules)
    graph.finish()
    return graph


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about ``WORDS`` words, the unit that is aligned together."""
    size = sum(np.nan_to_num(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)) for c in ("ref", "hyp"))
    part = np.cumsum(size) // WORDS
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, z in zip(edges, edges[1:], strict=False):
        if z > a:
            yield batch.slice(a, z - a)


def spread(pairs: DataFrame) -> DataFrame:
    """Pairs over many tasks.

    Pairs are small beside the work that they take, so the sizes in bytes by which Spark
    joins partitions would leave most cores idle.
    """
    spark = pairs.sparkSession
    return pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def align_pairs(pairs: DataFrame, rules: list[tuple[list[str], list[list[str]]]] | None = None, greedy: bool = False, empty_end: bool = False, search: dict | None = None) -> DataFrame:
    """Stitches of pairs ``utt_id, ref, hyp[, spans][, rules]``: ``utt_id`` and ``STITCH_FIELDS``.

    ``ref`` and ``hyp`` are arrays of words (null: none); ``spans`` an array of entity spans
    (see ``graph_of``); ``rules`` of the argument hold for all pairs, those of the column
    (array of ``lhs, alts``) for their pair only, where no other rule has the same left side.
    Words of no span have the class ``global``.  ``greedy`` aligns as ``greedy.align_greedy``
    does, which takes ``empty_end`` and the options ``search``.
    """
    names = [c for c in ("spans", "rules") if c in pairs.columns]
    common = {tuple(lhs): alts for lhs, alts in rules or []}
    starts = {lhs[0] for lhs in common}
    kind = pairs.schema["utt_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.schema.field("utt_id").type
            for part in _parts(batch):
                gc.disable()  # many small objects, none in a cycle
                columns = {c: part.column(c).to_pylist() for c in part.schema.names}
                plain: list[tuple] = []
                graphs: list[tuple] = []
                for i, utt_id in enumerate(columns["utt_id"]):
                    ref, hyp = ([w for w in columns[c][i] or [] if w is not None] for c in ("ref", "hyp"))
                    spans = columns["spans"][i] if "spans" in columns else None
                    own = {tuple(r["lhs"]): r["alts"] for r in (columns["rules"][i] if "rules" in columns else None) or []}
                    if not greedy and not spans and starts.isdisjoint(ref) and {lhs[0] for lhs in own}.isdisjoint(ref):
                        plain.append((utt_id, ref, hyp))
                    else:
                        graphs.append((utt_id, graph_of(ref, spans, own | common), hyp))
                gc.enable()
                yield from _plain_stitches(plain, key)
                gc.disable()
                if greedy:
                    from wordloom.operators.greedy import align_greedy

                    found = [align_greedy(g, h, empty_end, **(search or {})) for _, g, h in graphs]
                else:
                    found = align_graphs([g for _, g, _ in graphs], [h for _, _, h in graphs])
                gc.enable()
                yield from _graph_stitches([u for u, _, _ in graphs], [g for _, g, _ in graphs], found, key)

    return spread(pairs.select("utt_id", "ref", "hyp", *names)).mapInArrow(run, f"utt_id {kind}, {STITCH_FIELDS}")


_NAMES = ["utt_id", "seq", "class_label", "span", "ref_tok", "hyp_tok", "op", "ref_row", "span_row", "span_rows", "hyp_idx"]
_OPERATIONS = pa.array(["cor", "del", "sub", "ins"])


def _plain_stitches(pairs: list[tuple], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Stitches of pairs ``utt_id, ref, hyp`` of plain sequences, gathered from arrays."""
    found = plain_operations([(ref, hyp) for _, ref, hyp in pairs])
    sizes = np.array([len(o) for o in found], np.int64)
    total = int(sizes.sum())
    if not total:
        return
    ops = np.concatenate(found)
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    refs, hyps = [w for _, r, _ in pairs for w in r], [w for _, _, h in pairs for w in h]
    offset = lambda k: np.cumsum([0, *(len(p[k]) for p in pairs)])[:-1]
    x, y = np.cumsum(ops != _INS) - 1, np.cumsum(ops != _DEL) - 1  # places among the words of all pairs
    said, heard = ops != _INS, ops != _DEL
    word = lambda words, other, at, there: pa.array([*words, other], pa.string()).take(pa.array(np.where(there, at, len(words))))
    ref_tok, hyp_tok = word(refs, INS, x, said), word(hyps, DEL, y, heard)
    same = pc.equal(ref_tok, hyp_tok).to_numpy(zero_copy_only=False)
    code = np.where(ops == _INS, 3, np.where(ops == _DEL, 1, np.where(same, 0, 2)))
    none = pa.nulls(total, pa.int64())
    row = pa.array(x - np.repeat(offset(1), sizes), mask=~said)
    place = pa.array(y - np.repeat(offset(2), sizes), mask=~heard)
    pair = np.repeat(np.arange(len(pairs)), sizes)
    yield pa.RecordBatch.from_arrays(
        [pa.array([u for u, _, _ in pairs], key).take(pa.array(pair)), pa.array(np.arange(total) - first + 1), pa.array([GLOBAL]).take(pa.array(np.zeros(total, np.int64))), none, ref_tok, hyp_tok, _OPERATIONS.take(pa.array(code)), row, none, none, place], _NAMES
    )


def _graph_stitches(keys: list, graphs: list[ReferenceGraph], found: list[list[Step]], key: pa.DataType) -> Iterator[pa.RecordBatch]:
    types = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    rows: list[tuple] = []
    for utt_id, graph, steps in zip(keys, graphs, found, strict=True):
        heard = 0
        for seq, s in enumerate(steps, 1):
            inside, hears = s.span >= 0, s.op in ("cor", "sub", "ins")
            place = graph.places[s.span] if inside else (None, None)
            rows.append((utt_id, seq, graph.spans[s.span] if inside else GLOBAL, s.span if inside else None, s.ref, s.hyp, s.op, s.row if s.row >= 0 and not inside else None, *place, heard if hears else None))
            heard += hears
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], _NAMES)


# --- lattices ----------------------------------------------------------------------------


def lattice_graph(arcs: list[tuple[int, int, str]], start: int, finals: set[int]) -> ReferenceGraph:
    """A word lattice (``src, dst, word``) as a finished graph: what the start reaches, with one end behind all final states."""
    after: dict[int, list[tuple[int, str]]] = {}
    for a, b, w in arcs:
        after.setdefault(a, []).append((b, w))
    graph = ReferenceGraph()
    known, todo = {start: 0}, [start]
    while todo:
        v = todo.pop()
        for b, _ in after.get(v, ()):
            if b not in known:
                known[b] = graph.node()
                todo.append(b)
    for v, n in known.items():
        for b, w in after.get(v, ()):
            graph.arcs.append(Arc(n, known[b], None if w in (EPS, "0") else w))
    ends = [known[v] for v in finals if v in known]
    if not ends:
        raise ValueError("the lattice has no final state")
    graph.end = graph.node()
    graph.arcs += [Arc(v, graph.end, None) for v in sorted(ends)]
    graph.finish()
    if len(graph.order) != graph.size:
        raise ValueError("the lattice has a cycle")
    return graph


def oracle_words(ref: list[str], arcs: list[tuple[int, int, str]], start: int, finals: set[int]) -> list[Step]:
    """The alignment of least errors over all paths of a word lattice (``src, dst, word``).

    The program runs over the lattice with the reference along its rows, so what it calls an
    insertion is a deletion and the other way round.
    """
    graph = lattice_graph(arcs, start, finals)
    out = []
    steps = _in_corridor(graph, ref, False)
    if steps is None:
        steps = _Rows(graph, ref, None, edit_distance(_some_path(graph), ref)).solve()
    for op, arc, i in steps:
        if op == _INS:
            out.append(Step("del", ref[i], DEL, -1))
        elif op == _DEL:
            out.append(Step("ins", INS, arc.word, -1))
        elif op == _DIAG:
            out.append(Step("cor" if arc.word == ref[i] else "sub", ref[i], arc.word, -1))
    return out
