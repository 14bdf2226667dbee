"""A greedy alignment, by level: what a quick search that prefers matches would choose.

It differs from the exact one in three ways.  A synonym is taken only where its words stand
in the hypothesis one after another.  A word is deleted only where neither it nor a way tried
before it matches.  Hypotheses without times end in one more, empty word, which can be inserted
at a cost or stand for a deleted word.  Paths grow by one step at a time; a state takes an
arrival that costs no more than those before it, and of arrivals alike in step, errors and
cost the first stays.  Of the paths that reach the end the one of least errors per word wins,
the shortest if several do.

Costs are insertion and deletion 2, substitution 3, in halves.  All states of a level are
expanded at once, as arrays.  Nothing is given up unless it is asked for: ``beam`` keeps, every
``EVERY`` levels, that many states of least errors and cost, and those within ``SLACK`` errors
of the last of them; ``most`` ends the search when so many paths have reached the end;
``anchors`` forbids errors on words that a quick look matched (``prepass.anchors``).
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

from wordloom.functions.tokens import EPS, UNCOUNTED
from wordloom.operators.align import _DEL, _DIAG, _EMPTY, _INS, Step, _steps
from wordloom.operators.graphs import Arc, ReferenceGraph

# The levels between two prunings, and the errors that a kept state may have more than the last of the best.
EVERY, SLACK = 50, 20
#: Edge of the square tiles in which the least costs of states are kept.
TILE = 128
_BIG = np.int32(1 << 30)
_WAY = 4  # the code of a synonym taken whole


class _Costs:
    """The least cost by which each state (node, place) was reached, in tiles made when they are needed."""

    def __init__(self, nodes: int, places: int) -> None:
        self.slot = np.full((nodes // TILE + 1, places // TILE + 1), -1, np.int64)
        self.cells, self.used = np.full(4 * TILE * TILE, _BIG), 0

    def at(self, v: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The address of each state."""
        a, b = v // TILE, j // TILE
        slots = self.slot[a, b]
        new = slots < 0
        if new.any():
            for x, y in set(zip(a[new].tolist(), b[new].tolist(), strict=True)):
                self.slot[x, y] = self.used
                self.used += 1
            while self.used * TILE * TILE > len(self.cells):
                self.cells = np.concatenate([self.cells, np.full(len(self.cells), _BIG)])
            slots = self.slot[a, b]
        return (slots * TILE + v % TILE) * TILE + j % TILE


class _Search:
    """The arcs of a graph as arrays, in the order in which they are tried, and the words heard."""

    def __init__(self, graph: ReferenceGraph, words: list[str], anchors: tuple[list[bool], list[bool]] | None) -> None:
        self.graph, self.words, self.m = graph, words, len(words)
        after: list[list[Arc]] = [[] for _ in range(graph.size)]
        for a in graph.arcs:
            after[a.src].append(a)
        for arcs in after:
            arcs.reverse()  # of ways to say the same, the later comes first
            arcs.sort(key=lambda a: a.word is not None)  # and what opens a span before all
        self.arcs = [a for arcs in after for a in arcs]
        self.degree = np.array([len(arcs) for arcs in after], np.int64)
        self.first = np.cumsum(self.degree) - self.degree
        ids: dict[str, int] = {}
        self.heard = np.array([ids.setdefault(w, len(ids)) for w in words] + [-2], np.int64)
        self.code = np.array([-3 if a.word is None else ids.get(a.word, -1) for a in self.arcs], np.int64)
        self.is_word = np.array([a.word is not None for a in self.arcs], bool)
        self.is_mark = np.array([bool(a.mark) for a in self.arcs], bool)
        self.dst = np.array([a.dst for a in self.arcs], np.int64)
        # A synonym: its words as one number list, and where it ends.
        self.way = {k: (graph.ways[a.dst][0], graph.ways[a.dst][1]) for k, a in enumerate(self.arcs) if a.mark}
        fixed_ref, fixed_hyp = anchors or ([], [])
        self.fixed_arc = np.array([0 <= a.row < len(fixed_ref) and fixed_ref[a.row] for a in self.arcs], bool)
        self.fixed_hyp = np.zeros(self.m + 1, bool)
        self.fixed_hyp[: len(fixed_hyp)] = fixed_hyp[: self.m]

    def expand(self, errors: np.ndarray, cost: np.ndarray, v: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, ...]:
        """Arrivals from the states of a level, in order: ``parent, errors, cost, v, j, code`` (arc times 8 and what was done)."""
        count = len(v)
        degree = self.degree[v]
        s = np.repeat(np.arange(count), degree)
        nth = np.arange(len(s)) - np.repeat(np.cumsum(degree) - degree, degree)
        arc = self.first[v[s]] + nth
        at = j[s]
        word = self.is_word[arc]
        same = word & (self.code[arc] == self.heard[at])
        mark = self.is_mark[arc]
        taken = np.zeros(len(s), bool)
        ends, lengths = self.dst[arc].copy(), np.zeros(len(s), np.int64)
        for x in np.flatnonzero(mark):  # synonyms are few
            say, end = self.way[int(arc[x])]
            if self.words[at[x] : at[x] + len(say)] == say:
                taken[x], ends[x], lengths[x] = True, end, len(say)
        empty = ~word & ~mark
        # How many ways up to and with this one match: a deletion is offered where none does.
        hits = np.cumsum(same | taken)
        before = np.concatenate([[0], hits])[np.cumsum(degree) - degree]
        unmatched = hits - before[s] == 0
        more = at < self.m
        free = ~self.fixed_hyp[at]
        sub = word & ~same & more & free & ~self.fixed_arc[arc]
        rank = 4 * int(degree.max(initial=1)) + 4
        ins = np.flatnonzero((j < self.m) & ~self.fixed_hyp[j])
        parts = []
        for chosen, order, more_errors, more_cost, to, on, what in (
            (taken, nth, 0, 0, ends, lengths, _WAY),
            (empty, nth, 0, 0, ends, 0, _EMPTY),
            (same, nth, 0, 0, ends, 1, _DIAG),
            (sub, rank // 2 + 2 * nth, 1, 3, ends, 1, _DIAG),
            (word & unmatched, rank // 2 + 2 * nth + 1, 1, 2, ends, 0, _DEL),
        ):
            x = np.flatnonzero(chosen)
            p = s[x]
            parts.append((p * rank + order[x], p, errors[p] + more_errors, cost[p] + more_cost, to[x], at[x] + (on[x] if isinstance(on, np.ndarray) else on), arc[x] * 8 + what))
        parts.append((ins * rank + rank - 1, ins, errors[ins] + 1, cost[ins] + 2, v[ins], j[ins] + 1, np.full(len(ins), _INS, np.int64)))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        return tuple(c[order] for c in columns[1:])


def greedy_paths(graph: ReferenceGraph, hyp: list[str], empty_end: bool = False, beam: int | None = None, most: int | None = None, anchors: tuple[list[bool], list[bool]] | None = None) -> list[list[Step]]:
    """The alignments that reach the end, by rising rate; equal ones in the order in which they were found."""
    words = [*hyp, EPS] if empty_end else list(hyp)
    search = _Search(graph, words, anchors)
    costs = _Costs(graph.size, len(words) + 1)
    m, end = len(words), graph.end
    one = lambda x: np.array([x], np.int64)
    errors, cost, v, j, trail = one(0), one(0), one(0), one(0), one(0)
    costs.cells[costs.at(v, j)] = 0
    parents, codes, known = [one(-1)], [one(-1)], 1
    ends: list[int] = []
    depth = 0
    while len(v):
        depth += 1
        order = np.lexsort((cost, errors))
        errors, cost, v, j, trail = errors[order], cost[order], v[order], j[order], trail[order]
        there = (v == end) & (j == m)
        if there.any():
            ends.extend(trail[there].tolist())
            if most is not None and len(ends) >= most:
                del ends[most:]
                break
            errors, cost, v, j, trail = (x[~there] for x in (errors, cost, v, j, trail))
        parent, errors, cost, v, j, code = search.expand(errors, cost, v, j)
        if not len(v):
            break
        # In order, an arrival is taken if it costs no more than the least so far at its state.
        cell = costs.at(v, j)
        group = np.argsort(cell, kind="stable")
        cells = cell[group]
        opens = np.concatenate([[True], cells[1:] != cells[:-1]])
        nth = np.cumsum(opens) - 1
        far = np.int64(1) << np.int64(31)
        here = cost[group] - nth * far
        least = np.minimum.accumulate(here) + nth * far
        ahead = np.minimum(np.where(opens, _BIG, np.concatenate([[_BIG], least[:-1]])), costs.cells[cells])
        won = cost[group] <= ahead
        np.minimum.at(costs.cells, cells[won], cost[group][won].astype(np.int32))
        taken = np.zeros(len(v), bool)
        taken[group[won]] = True
        # Of arrivals alike the first stays.
        x = np.flatnonzero(taken)
        if not len(x):
            break
        alike = np.lexsort((x, cost[x], errors[x], cell[x]))
        y = x[alike]
        first = np.concatenate([[True], (cell[y][1:] != cell[y][:-1]) | (cost[y][1:] != cost[y][:-1]) | (errors[y][1:] != errors[y][:-1])])
        x = np.sort(y[first])
        if beam is not None and depth % EVERY == 0 and len(x) > beam:
            by = x[np.lexsort((cost[x], errors[x]))]
            x = np.sort(by[errors[by] <= errors[by[beam - 1]] + SLACK])
        parents.append(trail[parent[x]])
        codes.append(code[x])
        errors, cost, v, j = errors[x], cost[x], v[x], j[x]
        trail = known + np.arange(len(x))
        known += len(x)
    if not ends:
        raise ValueError("no alignment")
    parent, code = np.concatenate(parents), np.concatenate(codes)
    found = [_unwound(search, parent, code, e) for e in ends]
    return [_told(graph, steps, words) for steps in sorted(found, key=lambda s: _rate(s, words))]


def align_greedy(graph: ReferenceGraph, hyp: list[str], empty_end: bool = False, beam: int | None = None, most: int | None = None, streak: int | None = None) -> list[Step]:
    """The greedy alignment of a finished graph with the words of a hypothesis; ``streak`` asks for anchors."""
    anchors = None
    if streak is not None:
        from wordloom.operators.prepass import anchors as looked

        rows = [w for _, w in sorted((a.row, a.word) for a in graph.arcs if a.row >= 0)]
        # Rows inside spans are no plain words; anchors need every row in its place.
        anchors = looked(rows, hyp, streak) if len(rows) == graph.rows_at[graph.end] else None
    return greedy_paths(graph, hyp, empty_end, beam, most, anchors)[0]


def _unwound(search: _Search, parent: np.ndarray, code: np.ndarray, at: int) -> list[tuple[int, Arc | None, int]]:
    todo = []
    while parent[at] >= 0:
        todo.append(int(code[at]))
        at = int(parent[at])
    steps: list[tuple[int, Arc | None, int]] = []
    after: dict[int, Arc] = {}
    j = 0
    for c in reversed(todo):
        op = c % 8
        if op == _INS:
            steps.append((_INS, None, j))
            j += 1
            continue
        arc = search.arcs[c // 8]
        if op == _WAY:
            steps.append((_EMPTY, arc, j))
            if not after:
                after = {a.src: a for a in search.arcs if a.word is not None}
            node = arc.dst
            for _ in search.way[c // 8][0]:
                steps.append((_DIAG, after[node], j))
                node, j = after[node].dst, j + 1
        else:
            steps.append((op, arc, j))
            j += op == _DIAG
    return steps


def _rate(steps: list[tuple[int, Arc | None, int]], words: list[str]) -> Fraction:
    errors = n = 0
    for op, arc, j in steps:
        if op == _INS:
            errors += words[j] != EPS
        elif op in (_DIAG, _DEL):
            errors += op == _DEL or arc.word != words[j]
            n += arc.word not in UNCOUNTED
    return Fraction(errors, n) if n else Fraction(errors * 10**6)


def _told(graph: ReferenceGraph, steps: list, words: list[str]) -> list[Step]:
    """Steps without the empty word: a word that stands against it is deleted."""
    real = []
    for op, arc, j in steps:
        if op == _INS and words[j] == EPS:
            continue
        real.append((_DEL if op == _DIAG and words[j] == EPS else op, arc, j))
    return _steps(graph, real, words)
