"""Unit-cost edit distance by bit vectors, exact at any length."""

from __future__ import annotations

import numpy as np

#: Sequences of so many tokens make the vector of a token when it is asked for, so that few are held at a time.
LAZY = 8_192


def _vectors(b: list):
    """A function that gives the places of a token in ``b`` as bits of a number."""
    if len(b) <= LAZY:
        bits: dict = {}
        for j, y in enumerate(b):
            bits[y] = bits.get(y, 0) | 1 << j
        return lambda y: bits.get(y, 0)
    places: dict = {}
    for j, y in enumerate(b):
        places.setdefault(y, []).append(j)
    where = {y: np.array(p) for y, p in places.items()}
    often: dict = {}

    def vector(y) -> int:
        if y in often or y not in where:
            return often.get(y, 0)
        p, held = where[y], np.zeros(len(b) + 7 >> 3, np.uint8)
        np.bitwise_or.at(held, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        made = int.from_bytes(held.tobytes(), "little")
        if len(p) > 1_000:  # vectors of frequent tokens are kept: few, so the memory stays small
            often[y] = made
        return made

    return vector


def edit_distance(a: list, b: list) -> int:
    """The distance of two lists; a row of the table is two bit vectors of its differences."""
    if not a or not b:
        return len(a) + len(b)
    matches = _vectors(b)
    all_ones, last = (1 << len(b)) - 1, 1 << len(b) - 1
    up, down, distance = all_ones, 0, len(b)
    for x in a:
        eq = matches(x)
        flat = (((eq & up) + up) ^ up) | eq | down
        right, left = down | (all_ones & ~(flat | up)), up & flat
        distance += bool(right & last) - bool(left & last)
        right = (right << 1 | 1) & all_ones
        left = left << 1 & all_ones
        vertical = eq | down
        up, down = left | (all_ones & ~(vertical | right)), right & vertical
    return distance
