r"""Rows that fail to parse (problem 3): CTM lines into typed records, with reasons for the rest.

Method: strict load plus anti-join.  Every raw line keeps its offset (``line_id``).  The
strict load accepts only lines that satisfy every rule at once and yields typed records;
their offsets are subtracted from the raw offsets by an anti-join, and only the remainder
is diagnosed.  Blank and null lines are neither loaded nor failed.

Defined cases: outer white space and carriage returns do not matter; a field in double
quotes may hold blanks; numbers may be quoted; a null column count fails every line of it
with ``columns``; repeated lines count each by its own offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_FIELD = r'(?:"[^"]*"|[^ \t"])+'
_WHITE = r"(?U)^\s+|\s+$"


def _unquoted(field: Column) -> Column:
    return F.regexp_replace(field, '"', "")


def _number(field: Column) -> Column:
    """The value of a field in plain or scientific decimal notation that is finite and at least 0; else null."""
    text = _unquoted(field)
    value = F.when(text.rlike(_NUMBER), text.try_cast("double"))
    return F.when((value >= 0) & (value < F.lit(float("inf"))), value)


def raw_offsets(df: DataFrame) -> DataFrame:
    """Lines that say anything, with their offset and declared width."""
    text = F.regexp_replace("raw_line", _WHITE, "")
    return df.select("line_id", F.col("n_columns").cast("long").alias("n_columns"), text.alias("_text")).where(F.col("_text") != "")


def _fields() -> Column:
    """The fields of a line; null if its double quotes do not pair."""
    text = F.col("_text")
    quoted = F.when(F.length(F.regexp_replace(text, '[^"]', "")) % 2 == 0, F.regexp_extract_all(text, F.lit(_FIELD), F.lit(0)))
    return F.when(text.contains('"'), quoted).otherwise(F.split(text, "[ \t]+"))


def _diagnosis(f: Column) -> Column:
    """The first reason for which a line with these fields does not conform; null if it does."""
    confidence = _number(F.get(f, F.lit(5)))
    return (
        F.when(f.isNull(), "quoting")
        .when(~F.coalesce(F.col("n_columns").isin(5, 6) & (F.size(f) == F.col("n_columns")), F.lit(False)), "columns")
        .when(_number(F.get(f, F.lit(2))).isNull(), "start")
        .when(_number(F.get(f, F.lit(3))).isNull(), "duration")
        .when((F.col("n_columns") == 6) & ~F.coalesce(confidence <= 1, F.lit(False)), "confidence")
    )


def strict_load(df: DataFrame) -> DataFrame:
    """Typed records of the conforming lines only."""

    def record(f: Column) -> Column:
        # A file of five columns states no confidence; it counts as 1.
        confidence = F.when(F.col("n_columns") == 5, F.lit(1.0)).otherwise(_number(F.get(f, F.lit(5))))
        fits = F.coalesce(F.col("n_columns").isin(5, 6) & (F.size(f) == F.col("n_columns")), F.lit(False))
        text = lambda i: _unquoted(F.get(f, F.lit(i)))
        return F.when(
            fits,
            F.struct(text(0).alias("recording"), text(1).alias("channel"), _number(F.get(f, F.lit(2))).alias("start_time_secs"), _number(F.get(f, F.lit(3))).alias("duration_secs"), text(4).alias("word"), confidence.alias("confidence")),
        )

    conforms = lambda r: r.isNotNull() & r["start_time_secs"].isNotNull() & r["duration_secs"].isNotNull() & F.coalesce(r["confidence"] <= 1, F.lit(False))
    # The fields are bound once per line; the generator keeps later filters from repeating them.
    records = F.filter(F.transform(F.array(_fields()), record), conforms)
    return raw_offsets(df).select("line_id", F.inline(records))


def rejected(df: DataFrame) -> DataFrame:
    """``line_id, reason`` of the lines that fail: the raw offsets less the loaded ones, diagnosed."""
    left = raw_offsets(df).join(strict_load(df).select("line_id"), "line_id", "left_anti")
    return left.select("line_id", F.get(F.transform(F.array(_fields()), _diagnosis), F.lit(0)).alias("reason"))
