"""Repeated consecutive events in sequences (problem 7).

Method: on canonicalised events, the row number within the entity less the row number within
entity and value is constant along a run, so grouping by the difference gives count and
duration of each run.  ``blocks.stitched_runs`` does this per block of positions and joins
the runs at block edges, so that one recording may hold a third of all rows.

The event of a row is the number of its entity, else its token without regard to case,
look-alike characters and marks or blanks at its ends.

Defined cases: copies (same recording and position) count once; rows without recording or
position have no place and are left out; a row without entity and without letter or digit
(null and empty tokens too) is no event and ends a run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.charforms import plain
from wordloom.operators.blocks import BLOCK, one_per_place, stitched_runs

_OUTER = r"^[^\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}]+$"


def core_of(text: Column) -> Column:
    """A plain text in lower case without marks and blanks at its ends; null if nothing is left."""
    core = F.lower(F.regexp_replace(text, _OUTER, ""))
    return F.when(core != "", core)


def entity_number(label: Column, label_id: Column) -> Column:
    """The entity's number from either field, without leading zeros; null if there is none."""
    by_id = F.regexp_extract(plain(label_id), r"^0*([0-9]+)(?:\.0*)?$", 1)
    by_label = F.regexp_extract(plain(label), r"^0*([0-9]+)\s*:", 1)
    return F.coalesce(F.when(by_id != "", by_id), F.when(by_label != "", by_label))


def seconds(text: Column) -> Column:
    """A time of the token table in seconds: ``12.5``, ``12,5`` or ``00:00:12.500``; else null."""
    t = F.regexp_replace(F.trim(text), ",", ".")
    p = F.split(t, ":")
    part = lambda i: F.get(p, F.lit(i)).try_cast("double")
    clock = F.when(F.size(p) == 3, part(0) * 3600 + part(1) * 60 + part(2)).when(F.size(p) == 2, part(0) * 60 + part(1)).otherwise(part(0))
    return F.when(t.rlike(r"^[0-9]+(:[0-9]+){0,2}(\.[0-9]*)?$"), clock)


def event_runs(tokens: DataFrame, least: int = 2, times: bool = False, size: int = BLOCK) -> DataFrame:
    """``recording, event, first_pos, last_pos, n_events`` of each run; with ``times`` also ``start_secs, end_secs, duration_secs``."""
    number = entity_number(F.col("best_label"), F.col("best_label_id"))
    # A core begins with a letter or digit, so no token reads like an entity.
    event = F.coalesce(F.concat(F.lit("#"), number), core_of(plain(F.col("token"))))
    spans = {"start_secs": seconds(F.col("ts")), "end_secs": seconds(F.col("end_ts"))} if times else {}
    rows = tokens.select("recording", "pos", event.alias("event"), *[c.alias(n) for n, c in spans.items()])
    placed = one_per_place(rows, "recording", "pos", ["event", *spans], size)
    bounds = {"low": ("start_secs",), "high": ("end_secs",)} if times else {}
    runs = stitched_runs(placed, "recording", "pos", "event", least, **bounds).withColumnRenamed("n", "n_events")
    return runs.withColumn("duration_secs", F.col("end_secs") - F.col("start_secs")) if times else runs
