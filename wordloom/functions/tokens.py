"""Column functions on tokens, labels and rates."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

# Words with a meaning of their own in alignments.
EPS, INS, DEL, SUB, OOV = "<eps>", "<ins>", "<del>", "<sub>", "<oov>"
SILENCE, INAUDIBLE, UNK = "<silence>", "<inaudible>", "<unk>"
NOOP, GLOBAL, FALLBACK = "!!noop-token!!", "global", "FALLBACK"
UNCOUNTED = (EPS, DEL, INS, SUB, OOV)
SYMBOLS = {EPS: 0, OOV: 1, INS: 2, DEL: 3, SUB: 4, INAUDIBLE: 5, SILENCE: 6, UNK: 7}


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def lowercase(text: Column) -> Column:
    return F.lower(text)


def ends_with_any_case(text: Column, suffix: str) -> Column:
    return F.lower(text).endswith(suffix.lower())


def ascii_equal(a: Column, b: Column) -> Column:
    """Equality without regard to the case of ASCII letters; other letters must be the same."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(a, upper, lower) == F.translate(b, upper, lower)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def left_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def right_trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def joined(parts: Column, separator: str) -> Column:
    return F.array_join(parts, separator)


def split_on(text: Column, delimiter: str) -> Column:
    """Pieces between single-character delimiters; the text after a last delimiter is none if empty."""
    parts = F.split(text, "[" + ("\\" if delimiter in "\\]^-" else "") + delimiter + "]")
    return F.when((F.size(parts) > 0) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words_of(text: Column) -> Column:
    """The words of a text between any white space."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_countable_ngram(gram: Column) -> Column:
    return ~gram.rlike("<ins>|<del>|<eps>|___")


def is_entity_label(label: Column) -> Column:
    return label.startswith("___")


def is_synonym_label(label: Column) -> Column:
    return label.startswith("___") & label.contains("_SYN_")


def is_noise_code(token: Column) -> Column:
    return token.rlike(r"^<[^>]*>$")


def label_id(marker: Column) -> Column:
    """``___0_CONTRACTION___`` gives 0."""
    return F.regexp_extract(marker, r"^___([^_]+)", 1)


def label_name(marker: Column) -> Column:
    """``___23_ORDINAL___`` gives ORDINAL; a synonym marker SYN and its lengths."""
    return F.regexp_extract(marker, r"^___[^_]*_(.*)___$", 1)


def class_marker(label: Column) -> Column:
    """``0:YEAR`` gives ``___0_YEAR___``."""
    return F.concat(F.lit("___"), F.translate(label, ":", "_"), F.lit("___"))


def best_label(labels: Column) -> Column:
    """The first label of a list literal; empty without one."""
    return F.coalesce(F.regexp_extract(labels, r"""^\s*\[\s*['"]([^'"]*)['"]""", 1), F.lit(""))


_COLONS, _BREAKS = r"[:\uff1a\ufe55\u2236]", r"[,;|/\t]"
_QUOTED = rf"""(?s)^\s*[\[(]?\s*(['"])(.*?)\1(?=\s*(?:{_BREAKS}|[\])]|$)|\s+['"])"""
_IN_BRACKETS = rf"""(?s)^\s*[\[(]\s*([^\s\[\]()'"].*?)\s*(?:{_BREAKS}\s*(?=[0-9]+\s*{_COLONS}|['"]|[\])]\s*$)|[\])]\s*$|$)"""
_BARE = rf"""(?s)^\s*([^\s\[\]()'"].*?)\s*(?:{_BREAKS}\s*(?=[0-9]+\s*{_COLONS}|['"]|$)|$)"""


def first_label(labels: Column) -> Column:
    """The first label in any layout: quoted, in brackets or bare, before a comma, semicolon, bar, slash or tab; empty without one.

    A quote inside a label of other quotes belongs to it, and a delimiter that no label follows too.
    """
    found = [F.regexp_extract(labels, pattern, group) for pattern, group in ((_QUOTED, 2), (_IN_BRACKETS, 1), (_BARE, 1))]
    best = F.coalesce(F.get(F.filter(F.array(*found), lambda x: x != ""), F.lit(0)), F.lit(""))
    return F.regexp_replace(best, r"""\\(['"])|(['"])\2""", "$1$2")


def cleaned_label(label: Column) -> Column:
    """``number:CLASS`` of a label with blanks around its parts, another colon, zeros before its number, or its class in lower case."""
    bare = F.regexp_replace(label, r"^[\s\u00a0\u3000]+|[\s\u00a0\u3000]+$|^[\s\u00a0\u3000]*0+(?=[0-9])", "")
    return F.upper(F.regexp_replace(bare, rf"(?s)^([^:\uff1a\ufe55\u2236]*?)[\s\u00a0\u3000]*{_COLONS}[\s\u00a0\u3000]*(.*)$", "$1:$2"))


def label_literal(label: Column) -> Column:
    """A label as a list literal, in the quotes that it does not hold; ``[]`` for an empty one."""

    def literal(x: Column) -> Column:
        quote = F.when(x.contains("'"), '"').otherwise("'")
        return F.when(F.coalesce(x, F.lit("")) != "", F.concat(F.lit("["), quote, x, quote, F.lit("]"))).otherwise("[]")

    return bound(label, literal)


def label_number(label: Column) -> Column:
    """What stands before the colon; a label without one is an error."""
    return bound(label, lambda x: F.when(x.contains(":"), F.substring_index(x, ":", 1)).when(x != "", F.raise_error(F.concat(F.lit("malformed label: "), x))))


def tag_ids(tags: Column) -> Column:
    """The ids of a list literal of tags."""
    return F.coalesce(F.regexp_extract_all(tags, F.lit(r"'([^']*)'"), F.lit(1)), F.array().cast("array<string>"))


def trimmed_noise_code(token: Column) -> Column:
    """``<foreign:fr>`` gives ``<foreign>``."""
    return F.regexp_replace(token, r"^(<[^:>]*):[^>]*>$", "$1>")


def upper_count(token: Column) -> Column:
    return F.regexp_count(token, F.lit("[A-Z]"))


def environment(name: str, default: str = "") -> str:
    return os.environ.get(name, default)


def error_rate(errors: Column, n_ref: Column, empty: Column | None = None) -> Column:
    """Errors per reference word; errors over no words are infinite, and nothing over nothing is ``empty`` (null)."""
    return F.when(n_ref > 0, errors / n_ref).when(errors > 0, F.lit(float("inf"))).otherwise(F.lit(None).cast("double") if empty is None else empty)


def precision(correct: Column, ins: Column, sub: Column) -> Column:
    return F.when(correct + ins + sub > 0, correct / (correct + ins + sub))


def recall(correct: Column, dels: Column, sub: Column) -> Column:
    return F.when(correct + dels + sub > 0, correct / (correct + sub + dels))


#: Most distinct tokens of a pair that the built-in distance takes, a character each, and most tokens: coding them takes their square.
DISTINCT, LONG = 20_000, 64


def token_distance(a: Column, b: Column) -> Column:
    """Unit-cost edit distance of two arrays of tokens, by the built-in one.

    Each distinct token of both becomes one character by its place; longer pairs, or of more
    distinct tokens, go to ``prepass.edit_distance``.
    """
    vocabulary = F.array_distinct(F.concat(a, b))
    code = lambda t: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, t) + 256), 4, "0")), "UTF-16BE")
    text = lambda x: F.array_join(F.transform(x, code), "")
    few = (F.size(a) + F.size(b) <= LONG) & (F.size(vocabulary) <= DISTINCT)
    far = lambda x: F.when(~few, x)  # noqa: E731  only these pairs leave the JVM
    return F.when(few, F.levenshtein(text(a), text(b))).otherwise(_long_distance(far(a), far(b)))


@F.pandas_udf(IntegerType())
def _long_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    from wordloom.operators.prepass import edit_distance

    return pd.Series([None if x is None or y is None else edit_distance(list(x), list(y)) for x, y in zip(a, b)], dtype="Int32")
