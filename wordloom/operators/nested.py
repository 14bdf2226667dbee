"""Deeply nested semi-structured records (problem 5).

Method: structural-variant tables.  A bottom-up tree automaton gives every object of a body a
state from the names and the states of its members (``TRANSITIONS``): ``entity``,
``candidate``, ``entities`` (a map from entity numbers), ``wrapper`` (an object around such a
map) or ``other``.  The optional fields that an object has make its variant, and each variant
has a typed table of its own (``VARIANTS``) with only the columns it can fill.  All keep the
keys of the common supertype, ``norm_id, label_id, cand_no, word_no``, so a row finds its
parent; ``flat_tables`` gives the variants and the supertypes that are their unions.

A body is read once: a row per document carries its typed rows, and every table is unfolded
from them in the JVM.  Neither parser nor automaton recurses, so nesting may have any depth.

Defined cases: null, invalid and empty bodies give nothing (``NaN`` and ``Infinity`` are no
JSON); a single value in place of a list is a list of one; lists in lists are read through;
only number keys have entities; several objects in a list under one number are one entity;
null candidates and null words are none; numbers and truth values become text as written;
objects among words are no words; of repeated keys the last counts.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEAVES = frozenset({"null", "text", "value"})
_ANY = None
#: The automaton: an object takes the first state of which one of the members named here has a state allowed for it.
TRANSITIONS = (
    ("entity", {"candidates": _ANY, "class": _LEAVES}),
    ("candidate", {"verbalization": _ANY, "probability": _LEAVES}),
    ("entities", {"number": _ANY}),
    ("wrapper", {"other": frozenset({"entities", "wrapper"})}),
)
_NAMED = ("candidates", "class", "verbalization", "probability")
#: States in rising order; a list has the greatest of its members, since lists are read through.
_ORDER = {s: i for i, s in enumerate(("null", "text", "value", "other", "candidate", "entity", "wrapper", "entities"))}

#: The typed table of each variant.
VARIANTS = {
    "entity_full": "label_id string, class string, n_candidates long",
    "entity_unclassed": "label_id string, n_candidates long",
    "entity_uncandidated": "label_id string, class string",
    "entity_bare": "label_id string",
    "candidate_scored": "label_id string, cand_no long, probability double, n_words long",
    "candidate_unscored": "label_id string, cand_no long, n_words long",
    "candidate_bare": "label_id string, cand_no long, n_words long",
    "word_text": "label_id string, cand_no long, word_no long, word string",
    "word_value": "label_id string, cand_no long, word_no long, word string",
    "other": "label_id string, cand_no long, path string, value string",
}
#: The supertypes: their columns, and the variants that are of them.
SUPERTYPES = {
    "entities": ("label_id string, class string, n_candidates long", ("entity_full", "entity_unclassed", "entity_uncandidated", "entity_bare")),
    "candidates": ("label_id string, cand_no long, probability double, n_words long", ("candidate_scored", "candidate_unscored", "candidate_bare")),
    "words": ("label_id string, cand_no long, word_no long, word string", ("word_text", "word_value")),
    "others": ("label_id string, cand_no long, path string, value string", ("other",)),
}
_TYPES = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
#: Rows that a batch gathers before it is sent on.
ROWS = 50_000


# --- parsing -----------------------------------------------------------------------------


class _Number(str):
    """A number of the body, as written."""

    __slots__ = ()


def _no_json(text: str):
    raise ValueError(text)


_BLANK = re.compile(r"[ \t\n\r]*")
_LITERAL = re.compile(r"(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true)|(false)|(null)")


def _key(text: str, at: int) -> tuple[str, int]:
    """A member's name and the place behind its colon."""
    if text[at : at + 1] != '"':
        raise ValueError("name expected")
    name, at = scanstring(text, at + 1, True)
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("colon expected")
    return name, _BLANK.match(text, at + 1).end()


def _deep(text: str):
    """The tree of a JSON text with a stack of our own, for nesting of any depth."""
    stack: list[tuple[dict | list, str | None]] = []
    at = _BLANK.match(text).end()
    while True:
        mark = text[at : at + 1]
        if mark and mark in "{[":
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if mark == "{" else "]"):
                value, at = ({} if mark == "{" else []), at + 1
            else:
                name = None
                if mark == "{":
                    name, at = _key(text, at)
                stack.append(({} if mark == "{" else [], name))
                continue
        elif mark == '"':
            value, at = scanstring(text, at + 1, True)
        else:
            found = _LITERAL.match(text, at)
            if not found:
                raise ValueError("value expected")
            value = _Number(found[1]) if found[1] is not None else True if found[2] else False if found[3] else None
            at = found.end()
        while True:
            at = _BLANK.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError("text behind the value")
                return value
            holder, name = stack[-1]
            if name is None:
                holder.append(value)
            else:
                holder[name] = value
            mark = text[at : at + 1]
            if mark == ",":
                at = _BLANK.match(text, at + 1).end()
                if name is not None:
                    name, at = _key(text, at)
                    stack[-1] = (holder, name)
                break
            if mark != ("]" if name is None else "}"):
                raise ValueError("comma or end expected")
            value, at = stack.pop()[0], at + 1


def parse(body: str | None):
    """The tree of a body, or None if it is no JSON."""
    if body is None:
        return None
    body = body.lstrip("﻿")
    try:
        return json.loads(body, parse_int=_Number, parse_float=_Number, parse_constant=_no_json)
    except RecursionError:
        try:
            return _deep(body)
        except ValueError:
            return None
    except ValueError:
        return None


# --- the automaton -----------------------------------------------------------------------


def _flat(value) -> list:
    """The members of nested lists in order; a single value is a list of one; nulls are none."""
    out, stack = [], [value]
    while stack:
        x = stack.pop()
        if isinstance(x, list):
            stack.extend(reversed(x))
        elif x is not None:
            out.append(x)
    return out


def is_number(name: str) -> bool:
    return name.strip().isdigit()


def _letter(name: str) -> str:
    """The symbol of a member's name."""
    return name if name in _NAMED else "number" if is_number(name) else "other"


@cache
def _step(shape: frozenset[tuple[str, str]]) -> str:
    """The state of an object whose members have these symbols and states."""
    for to, members in TRANSITIONS:
        if any(name in members and (members[name] is _ANY or below in members[name]) for name, below in shape):
            return to
    return "other"


def states(tree) -> dict[int, str]:
    """The state of each object and list of a tree, by its ``id``, worked out from the leaves up."""
    found: dict[int, str] = {}

    def of(x) -> str:
        if x is None:
            return "null"
        if isinstance(x, (dict, list)):
            return found[id(x)]
        return "text" if type(x) is str else "value"

    inner, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, (dict, list)):
            inner.append(x)
            stack.extend(x.values() if isinstance(x, dict) else x)
    for x in reversed(inner):  # members come behind their holder
        if isinstance(x, dict):
            found[id(x)] = _step(frozenset((_letter(k), of(v)) for k, v in x.items()))
        else:
            found[id(x)] = max((of(v) for v in x), key=_ORDER.__getitem__, default="null")
    return found


def state(tree) -> str:
    """The state of a whole tree."""
    return states(tree)[id(tree)] if isinstance(tree, (dict, list)) else "null" if tree is None else "text" if type(tree) is str else "value"


# --- routing -----------------------------------------------------------------------------


def _text(leaf) -> str:
    return ("true" if leaf else "false") if isinstance(leaf, bool) else str(leaf)


def _leaf(value) -> str | None:
    return None if value is None or isinstance(value, (dict, list)) else _text(value)


def _probability(value) -> float | None:
    try:
        p = float(value)
    except (TypeError, ValueError):
        return None
    return p if math.isfinite(p) else None


def _other(members: dict, *named: str) -> Iterator[tuple[str, str]]:
    """Leaves of the members that have no column of their own, with their paths."""
    stack = [(v, k) for k, v in reversed(members.items()) if k not in named]
    while stack:
        x, at = stack.pop()
        if isinstance(x, dict):
            stack.extend((v, f"{at}.{k}") for k, v in reversed(x.items()))
        elif isinstance(x, list):
            stack.extend((v, f"{at}[{i}]") for i, v in reversed(list(enumerate(x))))
        elif x is not None:
            yield at, _text(x)


def _entities(tree) -> Iterator[tuple[str, object]]:
    """Pairs of entity number and entity in order, through wrappers and lists."""
    if not isinstance(tree, (dict, list)):
        return
    found = states(tree)
    stack: list[tuple[str | None, object]] = [(None, tree)]
    while stack:
        number, x = stack.pop()
        if number is not None:
            yield number, x
        elif isinstance(x, list):
            stack.extend((None, v) for v in reversed(x))
        elif isinstance(x, dict) and found[id(x)] in ("entities", "wrapper"):
            stack.extend((k if is_number(k) else None, v) for k, v in reversed(x.items()))


def rows_of(body: str | None) -> Iterator[tuple[str, tuple]]:
    """The typed rows of a body as pairs of variant and values."""
    for label, entity in _entities(parse(body)):
        parts = [x for x in _flat(entity) if isinstance(x, dict)]
        cls = next((c for p in parts if (c := _leaf(p.get("class"))) is not None), None)
        said = [p["candidates"] for p in parts if p.get("candidates") is not None]
        n = 0
        for candidate in _flat(said):
            n += 1
            members = candidate if isinstance(candidate, dict) else {"verbalization": candidate}
            words = [x for x in _flat(members.get("verbalization")) if not isinstance(x, dict)]
            for w, word in enumerate(words, 1):
                yield "word_text" if type(word) is str else "word_value", (label, n, w, _text(word))
            p = _probability(members.get("probability"))
            if not isinstance(candidate, dict):
                yield "candidate_bare", (label, n, len(words))
            elif p is None:
                yield "candidate_unscored", (label, n, len(words))
            else:
                yield "candidate_scored", (label, n, p, len(words))
            for at, leaf in _other(members, "probability", "verbalization"):
                yield "other", (label, n, at, leaf)
        if said:
            yield ("entity_unclassed", (label, n)) if cls is None else ("entity_full", (label, cls, n))
        else:
            yield ("entity_bare", (label,)) if cls is None else ("entity_uncandidated", (label, cls))
        for part in parts:
            for at, leaf in _other(part, "class", "candidates"):
                yield "other", (label, 0, at, leaf)


def _fields(columns: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in columns.split(", ")]


def _packed(ids: list, typed: dict[str, tuple[list[int], list[tuple]]]) -> pa.RecordBatch:
    """One row per document with its typed rows."""
    arrays: list[pa.Array] = [pa.array(ids, pa.int64())]
    for variant, (ends, rows) in typed.items():
        fields = _fields(VARIANTS[variant])
        values = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
        struct = pa.StructArray.from_arrays([pa.array(v, _TYPES[t]) for v, (_, t) in zip(values, fields, strict=True)], [n for n, _ in fields])
        arrays.append(pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), struct))
    return pa.RecordBatch.from_arrays(arrays, ["norm_id", *typed])


def routed(df: DataFrame) -> DataFrame:
    """``norm_id`` and an array of typed rows for each of ``VARIANTS``, a row per document."""

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids: list = []
            typed: dict[str, tuple[list[int], list[tuple]]] = {v: ([], []) for v in VARIANTS}
            held = 0
            for norm_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for variant, row in rows_of(body.as_py()):
                    typed[variant][1].append(row)
                    held += 1
                ids.append(norm_id)
                for ends, rows in typed.values():
                    ends.append(len(rows))
                if held >= ROWS:
                    yield _packed(ids, typed)
                    ids, typed, held = [], {v: ([], []) for v in VARIANTS}, 0
            if ids:
                yield _packed(ids, typed)

    schema = "norm_id long, " + ", ".join(f"{v} array<struct<{', '.join(f'{n}:{t}' for n, t in _fields(c)).replace('long', 'bigint')}>>" for v, c in VARIANTS.items())
    return df.select(F.col("norm_id").cast("long"), F.col("body").cast("string")).mapInArrow(classify, schema)


def _as_supertype(name: str) -> Column:
    """The typed rows of all variants of a supertype, with nulls for what a variant lacks."""
    columns, variants = SUPERTYPES[name]
    none = {"n_candidates": F.lit(0).cast("long")}

    def wide(variant: str) -> Column:
        have = {n for n, _ in _fields(VARIANTS[variant])}
        return F.transform(variant, lambda x: F.struct(*[(x[n] if n in have else none.get(n, F.lit(None).cast("bigint" if t == "long" else t))).alias(n) for n, t in _fields(columns)]))

    return F.concat(*[wide(v) for v in variants])


def flat_tables(df: DataFrame) -> dict[str, DataFrame]:
    """The table of each variant, and those of the supertypes ``entities``, ``candidates``, ``words`` and ``others``."""
    r = routed(df)
    out = {v: r.select("norm_id", F.inline(v)) for v in VARIANTS}
    return out | {s: r.select("norm_id", F.inline(_as_supertype(s))) for s in SUPERTYPES}


def words(df: DataFrame) -> DataFrame:
    """``norm_id, label_id, cand_no, word_no, word``: the rows of the word tables, each word whole.

    A row of a candidate table without words gives one with ``word_no`` 0 and an empty word,
    a row of an entity table without candidates one with ``cand_no`` 0 as well.
    """
    zero, blank = F.lit(0).cast("long"), F.lit("")
    row = lambda label, cand, word_no, word: F.struct(label.alias("label_id"), cand.alias("cand_no"), word_no.alias("word_no"), word.alias("word"))
    mute = F.transform(F.filter(_as_supertype("candidates"), lambda c: c["n_words"] == 0), lambda c: row(c["label_id"], c["cand_no"], zero, blank))
    bare = F.transform(F.filter(_as_supertype("entities"), lambda e: e["n_candidates"] == 0), lambda e: row(e["label_id"], zero, zero, blank))
    return routed(df).select("norm_id", F.inline(F.concat(_as_supertype("words"), mute, bare)))
