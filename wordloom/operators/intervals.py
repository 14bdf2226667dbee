"""Overlapping and gapped time intervals (problem 4).

Method: a two-level merge.  Intervals are clipped into time shards of fixed width; within a
shard one running maximum merges them.  Only coverage that touches a shard's border can go on
in the next shard, so only that is stitched, with the last piece of each shard, whose gap
reaches into a later one: first within blocks of shards, then what touches a block's border
among blocks.  An entity may hold a third of all rows: equal starts are reduced to the longest
interval before anything is grouped, so a shard holds at most ``SHARD_MS`` rows whatever the
data; a block holds a few rows per shard, and the last level a few per block.

An interval is cut at the shards of the blocks it begins and ends in; the whole blocks between
are one stretch, which swallows what lies in them.

Defined cases: rows without entity, whose start is not a finite number of at least 0 or
whose duration is not a finite number above 0 take no part; touching intervals are one
period; silences of ``session_ms`` or more are no gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_MS = 600_000
#: Shards in a block.
BLOCK = 256


def _millis(seconds: Column) -> Column:
    return F.round(seconds * 1000).cast("long")


def clean_intervals(df: DataFrame, entity: str, start: str, duration: str) -> DataFrame:
    """``entity, _s, _e`` in whole milliseconds for the rows that take part."""
    s, d, inf = F.col(start).cast("double"), F.col(duration).cast("double"), F.lit(float("inf"))
    ok = F.col(entity).isNotNull() & ~F.isnan(s) & (s >= 0) & (s < inf) & ~F.isnan(d) & (d > 0) & (d < inf)
    return df.where(ok).select(F.col(entity).alias("entity"), _millis(s).alias("_s"), (_millis(s) + _millis(d)).alias("_e"))


def _ends(shard: int, block: int) -> tuple[Column, Column, Column, Column]:
    """The first and last shard of an interval, and the blocks that hold them."""
    first, last = F.floor(F.col("_s") / shard), F.floor((F.col("_e") - 1) / shard)
    return first, last, F.floor(first / block), F.floor(last / block)


def _clip(intervals: DataFrame, shard: int, block: int) -> DataFrame:
    """Each interval cut at the shard borders of its first and last block."""
    first, last, a, z = _ends(shard, block)
    shards = F.when(z - a <= 1, F.sequence(first, last)).otherwise(F.concat(F.sequence(first, (a + 1) * block - 1), F.sequence(z * block, last)))
    parts = intervals.select("entity", "_s", "_e", F.explode(shards).alias("_k"))
    return parts.select("entity", "_k", F.greatest("_s", F.col("_k") * shard).alias("_s"), F.least("_e", (F.col("_k") + 1) * shard).alias("_e"))


def _stretches(intervals: DataFrame, shard: int, block: int) -> DataFrame:
    """``entity, _b, _to``: the whole blocks from ``_b`` to before ``_to`` inside an interval; of equal starts the farthest."""
    _, _, a, z = _ends(shard, block)
    return intervals.where(z - a > 1).groupBy("entity", (a + 1).alias("_b")).agg(F.max(z).alias("_to"))


def _swallowed(blocks: DataFrame, stretches: DataFrame) -> DataFrame:
    """``entity, _b``: those of ``blocks`` that lie in a stretch, by a running maximum over one row per block."""
    told = blocks.select("entity", "_b", F.lit(None).cast("long").alias("_to")).unionByName(stretches)
    order = Window.partitionBy("entity").orderBy("_b", F.col("_to").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    return told.withColumn("_reach", F.max("_to").over(order)).where(F.col("_to").isNull() & (F.col("_reach") > F.col("_b"))).select("entity", "_b")


def _stitched(pieces: DataFrame, key: list[str]) -> DataFrame:
    """Pieces of ``key`` that touch or overlap joined to runs: ``key, _s, _e, _next, _head``.

    ``_next`` is where coverage goes on behind a piece, if that is known; else the head of the
    piece that follows, if there is one.
    """
    order = Window.partitionBy(*key).orderBy("_s", "_e")
    reach = F.max("_e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    chained = pieces.withColumns({"_new": F.when(F.col("_s") <= reach, 0).otherwise(1), "_next": F.coalesce("_next", F.lead("_head").over(order))})
    chained = chained.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy(*key, "_run").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.max_by(F.struct("_next"), F.struct("_e", "_s"))["_next"].alias("_next"), F.min("_head").alias("_head")).drop("_run")


def periods_and_gaps(df: DataFrame, entity: str, start: str, duration: str, session_ms: int = 3_600_000, shard_ms: int = SHARD_MS, block: int = BLOCK) -> DataFrame:
    """``entity, piece, start_ms, end_ms``: continuous periods and the gaps between them."""
    intervals = clean_intervals(df, entity, start, duration)
    # Longest interval per start, combined before the shuffle.
    longest = _clip(intervals, shard_ms, block).groupBy("entity", "_k", "_s").agg(F.max("_e").alias("_e"))

    # Level 1: merge within a shard.
    by_shard = Window.partitionBy("entity", "_k").orderBy("_s")
    opens = F.when(F.col("_s") <= F.col("_reach"), 0).otherwise(1)
    marked = longest.withColumn("_reach", F.max("_e").over(by_shard.rowsBetween(Window.unboundedPreceding, -1)))
    marked = marked.withColumn("_piece", F.sum(opens).over(by_shard.rowsBetween(Window.unboundedPreceding, 0)))
    local = marked.groupBy("entity", "_k", "_piece").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"))
    shard = Window.partitionBy("entity", "_k")
    local = local.withColumns({"_head": F.min("_s").over(shard), "_next": F.lead("_s").over(shard.orderBy("_piece")), "_b": F.floor(F.col("_k") / block)})

    # What lies in blocks that an interval covers whole is part of that stretch.
    stretches = _stretches(intervals, shard_ms, block)
    kept = local.join(_swallowed(local.select("entity", "_b").distinct(), stretches), ["entity", "_b"], "left_anti")

    # Level 2: what touches a shard's border, and the last piece of each shard, within the block; the others are alone.
    border = (F.col("_s") == F.col("_k") * shard_ms) | (F.col("_e") == (F.col("_k") + 1) * shard_ms)
    laned = kept.select("entity", "_b", F.when(border | F.col("_next").isNull(), F.lit(-1)).otherwise(F.col("_k")).alias("_lane"), "_s", "_e", "_next", F.when(border | F.col("_next").isNull(), F.col("_head")).alias("_head"))
    runs = _stitched(laned, ["entity", "_b", "_lane"])

    # Level 3: what touches a block's border, and the last of each block, among blocks.
    wide = shard_ms * block
    head = F.min(F.when(F.col("_lane") == -1, F.col("_head"))).over(Window.partitionBy("entity", "_b", "_lane"))
    outer = (F.col("_lane") == -1) & ((F.col("_s") == F.col("_b") * wide) | (F.col("_e") == (F.col("_b") + 1) * wide) | F.col("_next").isNull())
    runs = runs.withColumns({"_head": head, "_far": F.when(outer, F.lit(-1)).otherwise(F.col("_b"))})
    whole = stretches.select("entity", F.lit(-1).cast("long").alias("_far"), F.lit(-1).cast("long").alias("_lane"), (F.col("_b") * wide).alias("_s"), (F.col("_to") * wide).alias("_e"), F.lit(None).cast("long").alias("_next"), (F.col("_b") * wide).alias("_head"))
    far = runs.select("entity", "_far", F.when(outer, F.lit(-1)).otherwise(F.col("_lane")).alias("_lane"), "_s", "_e", "_next", "_head").unionByName(whole)
    # Runs that stay with their block are whole already; they keep lanes of their own.
    merged = _stitched(far, ["entity", "_far", "_lane"])

    silent = F.col("_next") - F.col("_e")
    period = F.struct(F.lit("period").alias("piece"), F.col("_s").alias("start_ms"), F.col("_e").alias("end_ms"))
    gap = F.struct(F.lit("gap").alias("piece"), F.col("_e").alias("start_ms"), F.col("_next").alias("end_ms"))
    both = F.when((silent > 0) & (silent < session_ms), F.array(period, gap)).otherwise(F.array(period))
    return merged.select("entity", F.explode(both).alias("_p")).select("entity", "_p.*")
