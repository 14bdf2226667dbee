"""Alignments of words and graphs: golden counts, and brute force over all paths of small graphs."""

from __future__ import annotations

import random
from fractions import Fraction

import pytest

from wordloom.operators import align as A
from wordloom.operators.greedy import align_greedy, greedy_paths

# Synonym rules that the golden counts rest on.
RULES = {
    "we will": ["we'll"], "we'll": ["we will"], "it is": ["it's"], "it's": ["it is"], "she's": ["she is"], "i'll": ["i will"], "wanna": ["want to"],
    "all right": ["alright"], "alright": ["all right"], "you'll": ["you will"],
}


def rules_of(table: dict[str, list[str]], *texts: str, cutoffs: bool = True, hyphens: bool = True):
    out = {tuple(k.split()): [a.split() for a in v] for k, v in table.items()}
    for w in " ".join(texts).split():
        if cutoffs and w.index("-") == len(w) - 1 if "-" in w else False:
            out.setdefault((w,), [[w[:-1]]])
        elif hyphens and "-" in w.strip("-"):
            out.setdefault((w,), [w.split("-")])
            out.setdefault(tuple(w.split("-")), [[w]])
    return out


def tally(ref: str, hyp: str, rules=None, spans=None):
    c = A.counts(A.align_graph(A.graph_of(ref.split(), spans, rules), hyp.split()))
    return c["ins"], c["del"], c["sub"], c["n_ref"]


# Sentences whose counts are known.
SYN_1 = ("we will have a nice evening no matter what will happen um it's a good opportunity to do this you'll see", "we'll have a nice evening um no matter what will happen it is uh a good opportunity to this you'll uh see")
TEST_1 = (
    "we will have victory marc it's a sure thing we must only calculate p i number we will have victory it's a sure thing we must only calculate p i number we will have victory it's a sure thing we must only calculate p i number we will have victory it's a sure thing we must only calculate p i number we will have victory it's a sure thing we must only calculate p i number",
    "we'll have victory it is a sure thing we must only calculate p i number we'll have victory it is a sure thing we must only calculate pee eye number we will have victory it's a sure thing we must only calculate p i number we will have victory it's a sure thing we must only calculate p i number we will have victory it's a sure thing we must only calculate p i number",
)


@pytest.mark.parametrize(
    ("ref", "hyp", "rules", "expected"),
    [
        ("a b c", "", None, (0, 3, 0, 3)),
        ("", "a b c", None, (3, 0, 0, 0)),
        ("", "", None, (0, 0, 0, 0)),
        (*SYN_1, None, (3, 2, 3, 21)),
        (*SYN_1, RULES, (3, 2, 0, 21)),
        ("we will", "we'll", RULES, (0, 0, 0, 1)),
        ("we'll", "we will", RULES, (0, 0, 0, 2)),
        ("we will", "no", RULES, (0, 1, 1, 2)),
        ("we'll", "will", RULES, (0, 1, 0, 2)),
        ("a b c d wanna e f g h i j", "a b c d want uh to e f g h i j", RULES, (1, 0, 0, 12)),
        ("a b c d wanna e f g h i j", "a b c d want e f g h i j", RULES, (0, 1, 0, 12)),
        (*TEST_1, None, (1, 2, 7, 76)),
        ("ça va bien aujourd'hui été inutile êtes", "ça va va bien aujourd'hui éte inutile êtes", None, (1, 0, 1, 7)),
    ],
)
def test_golden_counts(ref, hyp, rules, expected):
    assert tally(ref, hyp, rules_of(rules) if rules else None) == expected


def test_cutoffs_and_compounds():
    ref, hyp = "this- is what she's saying", "this is what saying"
    assert tally(ref, hyp, rules_of(RULES, ref, hyp)) == (0, 1, 0, 5)
    assert tally(ref, hyp, rules_of(RULES, ref, hyp, cutoffs=False)) == (0, 1, 1, 5)
    ref, hyp = "things are going to be next-level next quarter", "things are going to be next level next quarter"
    assert tally(ref, hyp, rules_of({}, ref, hyp)) == (0, 0, 0, 9)
    assert tally(ref, hyp, rules_of({}, ref, hyp, hyphens=False)) == (1, 0, 1, 8)
    ref, hyp = "what is our long term view on politics", "that is are long-term view on politics"
    assert tally(ref, hyp, rules_of({}, ref, hyp)) == (0, 0, 2, 7)
    assert tally("she- will have a great evening", "he will have a great evening", {("she-",): [["he"]]}) == (0, 0, 0, 6)
    assert tally("she- will have a great evening", "she will have a great evening", {("she-",): [["he"]]}) == (0, 0, 1, 6)


MONEY = [["ten", "billions"], ["ten", "billions", "dollars"], []]


@pytest.mark.parametrize(
    ("hyp", "expected"),
    [
        ("it costs ten bricks of bricks dollars but i will verify what we could have done differently for the second day", (1, 0, 0, 20)),
        ("it costs bricks of bricks dollars but i will verify what we could have done differently for the second day", (1, 1, 0, 20)),
        ("it costs ten bricks of bricks but i will verify what we could have done differently for the second day", (1, 0, 0, 19)),
    ],
)
def test_synonyms_inside_entities(hyp, expected):
    ref = "it costs $10 billions but i'll verify what we could have done differently- for the 2nd"
    words = ref.split()
    spans = [{"first": 2, "last": 3, "marker": "___0_MONEY___", "candidates": MONEY}, {"first": len(words) - 1, "last": len(words) - 1, "marker": "___1_ORDINAL___", "candidates": [["second"]]}]
    assert tally(ref, hyp, rules_of(RULES | {"ten billions": ["ten bricks of bricks"]}, ref, hyp), spans) == expected


def test_empty_candidate():
    spans = [{"first": 2, "last": 3, "marker": "___0_MONEY___", "candidates": MONEY}]
    steps = A.align_graph(A.graph_of("it costs $10 billions".split(), spans, None), "it costs".split())
    assert A.counts(steps) == {"ins": 0, "del": 0, "sub": 0, "n_ref": 2}
    assert [s.op for s in steps] == ["cor", "cor", "empty"]
    spans[0]["marker"] = "___0_FALLBACK___"
    assert [s.op for s in A.align_graph(A.graph_of("it costs $10 billions".split(), spans, None), "it costs".split())] == ["cor", "cor", "noop"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        old, row = row, [row[0] + 1]
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def test_against_brute_force(monkeypatch):
    rng = random.Random(11)
    for cells, longest in ((16_000_000, 10), (150, 50)):
        monkeypatch.setattr(A, "CELLS", cells)
        for _ in range(300):
            a = [rng.choice("abcd") for _ in range(rng.randint(0, longest))]
            b = [rng.choice("abcd") if rng.random() < 0.2 else x for x in a if rng.random() > 0.2] + [rng.choice("ab")] * rng.randint(0, 6)
            steps = A.align_words(a, b)
            c = A.counts(steps)
            assert c["ins"] + c["del"] + c["sub"] == distance(a, b)
            assert [s.ref for s in steps if s.op != "ins"] == a
            assert [s.hyp for s in steps if s.op != "del"] == b


def paths(graph):
    after = {}
    for arc in graph.arcs:
        after.setdefault(arc.src, []).append(arc)

    def go(v, words):
        if v == graph.end:
            yield words
        for arc in after.get(v, []):
            yield from go(arc.dst, [*words, arc.word] if arc.word else words)

    return list(go(0, []))


def test_least_rate_over_all_paths():
    rng = random.Random(4)
    huge = Fraction(10**6)
    rate = lambda e, n: Fraction(e, n) if n else (huge if e else Fraction(0))
    for _ in range(500):
        graph, hyp = random_graph(rng)
        c = A.counts(A.align_graph(graph, hyp))
        assert rate(c["ins"] + c["del"] + c["sub"], c["n_ref"]) == min(rate(distance(p, hyp), len(p)) for p in paths(graph))


def test_lattice_oracle():
    arcs = [(0, 1, "this"), (0, 1, "these"), (1, 2, "is"), (1, 2, "his"), (2, 3, "a"), (2, 3, "isa"), (3, 4, "test"), (4, 5, "and"), (5, 6, "very"), (6, 7, "good"), (7, 8, "one")]
    c = A.counts(A.oracle_words("this is a test and a very good one".split(), arcs, 0, {8}))
    assert c == {"ins": 0, "del": 1, "sub": 0, "n_ref": 9}
    with pytest.raises(ValueError, match="cycle"):
        A.oracle_words(["a"], [(0, 1, "a"), (1, 0, "b")], 0, {1})


def told(steps):
    return [(s.op, s.ref, s.hyp, s.span, s.row) for s in steps]


def test_all_programs_agree(monkeypatch):
    rng = random.Random(3)
    pairs = []
    for _ in range(250):
        a = [rng.choice("abcde") for _ in range(rng.randint(0, 40))]
        b = [rng.choice("abcde") if rng.random() < 0.2 else x for x in a if rng.random() > 0.15] + [rng.choice("ab")] * rng.randint(0, 9)
        pairs.append((a, b))
    graphs = [A.graph_of(a, None, None) for a, _ in pairs]
    by_rows = [told(A._steps(g, A.best_path(g, b), b)) for g, (_, b) in zip(graphs, pairs, strict=True)]
    for cells in (16_000_000, 3_000, 200):
        monkeypatch.setattr(A, "CELLS", cells)
        assert [told(s) for s in A.align_graphs(graphs, [b for _, b in pairs])] == by_rows
    assert [told(A.align_words(a, b)) for a, b in pairs] == by_rows


def random_graph(rng, longest=7):
    pick = lambda low, high: [rng.choice("abcde") for _ in range(rng.randint(low, high))]
    tokens, hyp = pick(1, longest), pick(0, longest + 1)
    rules = {tuple(pick(1, 2)): [pick(0, 3) for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(0, 3))}
    spans = [{"first": 1, "last": 2, "marker": "___0_X___", "candidates": [pick(0, 3), pick(0, 3)]}] if len(tokens) > 3 else []
    return A.graph_of(tokens, spans, rules), hyp


def test_ties_hold_at_every_length(monkeypatch):
    """Weights in one number or two, rows kept or worked out again: the same alignment, ties included."""
    rng = random.Random(12)
    for _ in range(300):
        graph, hyp = random_graph(rng, rng.choice([7, 30]))
        ways = []
        for room, cells in ((61, 16_000_000), (0, 16_000_000), (61, 40), (0, 40)):
            monkeypatch.setattr(A, "ROOM", room)
            monkeypatch.setattr(A, "CELLS", cells)
            ways.append(told(A.align_graph(graph, hyp)))
        assert ways[0] == ways[1] == ways[2] == ways[3]


def steps_of(path, hyp):
    """The least (errors, steps, cost in halves) of all alignments of a path (words; None: a mark) with a hypothesis."""
    words = [w for w in path if w is not None]
    row = [(j, j, 2 * j) for j in range(len(hyp) + 1)]
    add = lambda x, e, s, c: (x[0] + e, x[1] + s, x[2] + c)
    for w in words:
        old, row = row, [add(row[0], 1, 1, 2)]
        for j, y in enumerate(hyp, 1):
            row.append(min(add(old[j - 1], w != y, 1, 3 * (w != y)), add(old[j], 1, 1, 2), add(row[-1], 1, 1, 2)))
    return add(row[-1], 0, 2 * (len(path) - len(words)), 0)


def test_ties_against_brute_force():
    """Of all paths: the least rate, then the fewest steps, then the least cost."""
    rng = random.Random(5)
    for _ in range(400):
        graph, hyp = random_graph(rng, 5)
        after = {}
        for arc in graph.arcs:
            after.setdefault(arc.src, []).append(arc)

        def go(v, path, after=after, end=graph.end):
            if v == end:
                yield path
            for arc in after.get(v, []):
                yield from go(arc.dst, [*path, arc.word] if arc.word else [*path, None] if arc.mark else path)

        best = []
        for path in go(0, []):
            n = sum(w is not None for w in path)
            # Of one path the least errors need not have the fewest steps at equal rates of different paths, so all are ranked.
            e, s, c = steps_of(path, hyp)
            best.append((Fraction(e, n) if n else Fraction(10**6 * e), s, c))
        got = A.best_path(graph, hyp)
        errors, words = A._tally(got, hyp)
        steps = sum(1 if op != A._EMPTY else 2 * a.mark for op, a, _ in got)
        cost = sum({A._INS: 2, A._DEL: 2, A._EMPTY: 0}.get(op, 0 if op == A._EMPTY or (op == A._DIAG and a.word == hyp[j]) else 3) for op, a, j in got)
        assert (Fraction(errors, words) if words else Fraction(10**6 * errors), steps, cost) == min(best)


def greedily(ref, hyp, rules=None, spans=None, timed=False):
    c = A.counts(align_greedy(A.graph_of(ref.split(), spans, rules), hyp.split(), not timed))
    return c["ins"], c["del"], c["sub"], c["n_ref"]


def test_greedy_golden_counts():
    for ref, hyp, rules, expected in [
        ("a b c", "", None, (0, 3, 0, 3)), ("", "a b c", None, (3, 0, 0, 0)), (*SYN_1, None, (3, 2, 3, 21)), (*SYN_1, RULES, (3, 2, 0, 21)), ("we will", "we'll", RULES, (0, 0, 0, 1)), ("we'll", "we will", RULES, (0, 0, 0, 2)),
        ("we will", "no", RULES, (0, 1, 1, 2)), ("we'll", "will", RULES, (1, 1, 0, 1)), (*TEST_1, None, (1, 2, 7, 76)),
    ]:
        assert greedily(ref, hyp, rules_of(rules) if rules else None) == expected
    for hyp, expected in [("a b c d want uh to e f g h i j", (2, 0, 1, 11)), ("a b c d want e f g h i j", (0, 0, 1, 11))]:
        assert greedily("a b c d wanna e f g h i j", hyp, rules_of(RULES), timed=True) == expected
    ref = "<crosstalk> yeah yeah right yeah all right probably just that are there any visuals that come to mind or- yeah sure when i hear foobar i think about just that foo a"
    hyp = "<crosstalk> yeah right i'll do just that are there any visuals that come to mind or yeah sure when i hear foobar i think about just that foobar a"
    assert greedily(ref, hyp, rules_of(RULES, ref, hyp)) == (0, 3, 3, 32)
    ref, hyp = "what is our long term view on politics", "that is are long-term view on politics"
    assert greedily(ref, hyp, rules_of({}, ref, hyp)) == (0, 0, 2, 7)


@pytest.mark.parametrize(("middle", "expected"), [("ten bricks of bricks dollars", (1, 0, 0, 20)), ("bricks of bricks dollars", (2, 0, 2, 18)), ("ten bricks of bricks", (1, 0, 0, 19))])
def test_greedy_synonyms_inside_entities(middle, expected):
    ref = "it costs $10 billions but i'll verify what we could have done differently- for the 2nd"
    hyp = f"it costs {middle} but i will verify what we could have done differently for the second day"
    last = len(ref.split()) - 1
    spans = [{"first": 2, "last": 3, "marker": "___0_MONEY___", "candidates": MONEY}, {"first": last, "last": last, "marker": "___1_ORDINAL___", "candidates": [["second"]]}]
    assert greedily(ref, hyp, rules_of(RULES | {"ten billions": ["ten bricks of bricks"]}, ref, hyp), spans) == expected


def test_greedy_is_never_better():
    rng = random.Random(6)
    for _ in range(200):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 8))] for _ in range(2))
        steps = align_greedy(A.graph_of(a, None, None), b, True)
        assert [s.ref for s in steps if s.op != "ins"] == a
        assert [s.hyp for s in steps if s.op != "del"] == b
        assert sum(s.op != "cor" for s in steps) >= distance(a, b)


def test_beam_best_and_anchors():
    rng = random.Random(7)
    a = [f"w{rng.randrange(60)}" for _ in range(150)]
    b = [rng.choice(["x", w]) if rng.random() < 0.3 else w for w in a if rng.random() > 0.1]
    graph = A.graph_of(a, None, None)
    whole = A.counts(align_greedy(graph, b))
    errors = lambda steps: sum(s.op != "cor" for s in steps)
    assert sum(whole[k] for k in ("ins", "del", "sub")) == errors(align_greedy(graph, b, beam=10**6))
    for options in ({"beam": 20}, {"streak": 100}, {"most": 1}, {"beam": 20, "streak": 100, "most": 5}):
        steps = align_greedy(graph, b, **options)
        assert [s.ref for s in steps if s.op != "ins"] == a
        assert [s.hyp for s in steps if s.op != "del"] == b
    paths = greedy_paths(graph, b, most=5)
    assert 1 <= len(paths) <= 5
    assert [errors(p) for p in paths] == sorted(errors(p) for p in paths)
