"""A quick look at two sequences before they are aligned: unit-cost distance and maps of matched tokens."""

from __future__ import annotations

from wordloom.operators.align import align_words
from wordloom.operators.distance import edit_distance

__all__ = ["anchors", "edit_distance", "has_error_streak", "match_maps"]

# Fixed value: sequences of no more words than this are not looked at ahead.
FEW = 10


def match_maps(a: list[str], b: list[str], relax: bool = True) -> tuple[int, list[int], list[int]]:
    """The distance, and for each side 1 where a token is matched and -1 elsewhere.

    With ``relax`` a match between two mismatches counts as none, since it may be chance.
    """
    steps = align_words(a, b)
    left = [1 if s.op == "cor" else -1 for s in steps if s.op != "ins"]
    right = [1 if s.op == "cor" else -1 for s in steps if s.op != "del"]
    errors = sum(s.op != "cor" for s in steps)
    if relax:
        for side in (left, right):
            for i in range(1, len(side) - 1):
                if side[i - 1] < 0 < side[i] and side[i + 1] < 0:
                    side[i] = -1
    return errors, left, right


def has_error_streak(side: list[int], longest: int) -> bool:
    """Whether more than ``longest`` mismatches stand in a row before a match."""
    run = 0
    for x in side:
        if x > 0:
            if run > longest:
                return True
            run = 0
        else:
            run += 1
    return False


def anchors(a: list[str], b: list[str], streak: int = 100) -> tuple[list[bool], list[bool]] | None:
    """For each side, the words that a quick look matched, which a greedy search may then not get wrong.

    None for short sequences, and where the hypothesis has more than ``streak`` mismatches in a row.
    """
    if len(a) <= FEW or len(b) <= FEW:
        return None
    _, left, right = match_maps(a, b)
    return None if has_error_streak(right, streak) else ([x > 0 for x in left], [x > 0 for x in right])
