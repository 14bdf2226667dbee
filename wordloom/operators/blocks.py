"""Two-level processing of long ordered sequences.

A sequence (a recording) may hold a third of all rows, so no operator here puts a whole
one into a single task.  Rows are cut into blocks of a fixed range of positions; windows
run inside a block, and what a block needs from its neighbours travels as one summary
row per block.  A block has at most ``BLOCK`` distinct positions, so after copies are
dropped its size is bounded.  Summaries are worked out in the same way again, by groups of
``FAN`` blocks, which have one row for some millions of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096
#: Blocks whose summaries are worked out together.
FAN = 1024


def block_no(pos: Column, size: int = BLOCK) -> Column:
    """The number of the block that holds position ``pos``."""
    return F.floor(pos / F.lit(size)).cast("long")


def one_per_place(df: DataFrame, key: str, pos: str, values: list[str], size: int = BLOCK) -> DataFrame:
    """One row per ``(key, pos)`` with ``values`` and ``_block``, partitioned by key and block.

    Copies agree in ``values``; should they not, the least tuple wins, so the result does
    not depend on the order of rows.  Rows without ``key`` or ``pos`` have no place and are
    left out.
    """
    placed = df.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).select(key, pos, block_no(F.col(pos), size).alias("_block"), *values)
    # The order by position serves the windows that follow, so copies are dropped without a sort of their own.
    order = Window.partitionBy(key, "_block").orderBy(pos, *values)
    told = placed.repartition(key, "_block").withColumn("_copy", F.coalesce(F.lag(pos).over(order) == F.col(pos), F.lit(False)))
    return told.where(~F.col("_copy")).drop("_copy")


def stitched_runs(df: DataFrame, key: str, pos: str, value: str, least: int = 1, low: tuple[str, ...] = (), high: tuple[str, ...] = (), by_difference: bool = True) -> DataFrame:
    """Maximal runs of neighbouring rows with equal ``value``.

    ``df`` is partitioned by ``(key, _block)`` and has one row per place; rows whose
    ``value`` is null belong to no run and end one.  Within a block the row number less the
    row number among rows of the same value is constant along a run and only there, so
    grouping by that difference finds the runs.  A run that touches the first or last row of
    its block may go on in the next one: only such edge runs, at most two per block, meet in
    a window over ``FAN`` blocks, and of these the outermost in one per key, where neighbours of equal value are joined.  Without ``by_difference``
    changes of value are counted instead, which spares a sort and finds the same runs.

    Returns ``key, value, first_pos, last_pos, n`` for runs of at least ``least`` rows, with the
    least of each column in ``low`` and the greatest of each in ``high``.
    """
    in_block = Window.partitionBy(key, "_block")
    ordered = in_block.orderBy(pos)
    if by_difference:
        run = F.row_number().over(ordered) - F.row_number().over(Window.partitionBy(key, "_block", value).orderBy(pos))
    else:
        df = df.withColumn("_new", F.when(F.col(value).eqNullSafe(F.lag(value).over(ordered)), 0).otherwise(1))
        run = F.sum("_new").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    numbered = df.select(
        key,
        "_block",
        pos,
        value,
        F.row_number().over(ordered).alias("_rn"),
        run.alias("_d"),
        F.count(F.lit(1)).over(in_block).alias("_rows"),
        *low,
        *high,
    )
    bounds = [F.min(c).alias(c) for c in low] + [F.max(c).alias(c) for c in high]
    runs = numbered.groupBy(key, "_block", value, "_d", "_rows").agg(
        F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count(F.lit(1)).alias("n"), F.min("_rn").alias("_a"), F.max("_rn").alias("_z"), *bounds
    )
    runs = runs.withColumns({"_head": F.col("_a") == 1, "_tail": F.col("_z") == F.col("_rows")})
    edge = F.col("_head") | F.col("_tail")
    kept = runs.where(edge | (F.col(value).isNotNull() & (F.col("n") >= least)))
    # Edge runs share a lane with those of the blocks around them, the others stay alone.
    near = kept.withColumns({"_far": F.floor(F.col("_block") / FAN), "_first": F.col("_block"), "_last": F.col("_block"), "_lane": F.when(edge, F.lit(-1)).otherwise(F.col("_block"))})
    near = _chained(near, key, value, low, high)
    # Then the first and last of such a lane share one with those of the lanes around it.
    lane = Window.partitionBy(key, "_far", "_lane")
    rim = (F.col("_lane") == -1) & ((F.col("first_pos") == F.min("first_pos").over(lane)) | (F.col("last_pos") == F.max("last_pos").over(lane)))
    far = near.withColumn("_rim", rim).withColumns({"_first": F.col("_far"), "_last": F.col("_far"), "_lane": F.when(F.col("_rim"), F.lit(-2)).otherwise(F.col("_lane")), "_far": F.when(F.col("_rim"), F.lit(-1)).otherwise(F.col("_far"))})
    out = _chained(far, key, value, low, high)
    return out.where(F.col(value).isNotNull() & (F.col("n") >= least)).select(key, value, "first_pos", "last_pos", "n", *low, *high)


def _chained(runs: DataFrame, key: str, value: str, low: tuple[str, ...], high: tuple[str, ...]) -> DataFrame:
    """Runs of a lane joined where one that ends its part meets one of equal value that begins a later part (``_first``, ``_last``)."""
    lanes = [key, "_far", "_lane"]
    order = Window.partitionBy(*lanes).orderBy("first_pos")
    go = F.col("_head") & F.lag("_tail").over(order) & (F.lag("_last").over(order) < F.col("_first")) & (F.lag(value).over(order) == F.col(value))
    chained = runs.withColumn("_go", F.coalesce(go, F.lit(False))).withColumn("_run", F.sum(F.when(F.col("_go"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bounds = [F.min(c).alias(c) for c in low] + [F.max(c).alias(c) for c in high]
    ends = [F.min_by("_head", "first_pos").alias("_head"), F.max_by("_tail", "last_pos").alias("_tail"), F.min("_first").alias("_first"), F.max("_last").alias("_last")]
    return chained.groupBy(*lanes, "_run").agg(F.first(value).alias(value), F.min("first_pos").alias("first_pos"), F.max("last_pos").alias("last_pos"), F.sum("n").alias("n"), *ends, *bounds).drop("_run")


def block_carry(df: DataFrame, key: str, pos: str, before: dict[str, str], after: dict[str, str]) -> DataFrame:
    """What each block takes over from the blocks around it.

    ``before`` maps an output column to a column of ``df``: its last non-null value in any
    earlier block of the key.  ``after`` likewise: the first non-null value in any later
    block.  One row per block enters the window over a key.
    """
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_b_{o}") for o, c in before.items()]
    aggs += [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(pos))).alias(f"_a_{o}") for o, c in after.items()]
    blocks = df.groupBy(key, "_block").agg(*aggs)
    wanted = {o: ("last", f"_b_{o}", False) for o in before} | {o: ("last", f"_a_{o}", True) for o in after}
    return _around(blocks, key, wanted)


def _around(blocks: DataFrame, key: str, wanted: dict[str, tuple[str, str, bool]]) -> DataFrame:
    """``key, _block`` and what each block takes from the others: ``wanted`` maps a column to the kind, the source and whether later blocks give it.

    The kind is ``last``, the nearest non-null value, or ``sum``.  ``blocks`` has a row per block; windows run over ``FAN`` of
    them, and then over a row for each such group.
    """
    far = blocks.withColumn("_far", F.floor(F.col("_block") / FAN))

    def taken(kind: str, c: str, later: bool, parts: list[str], order: str) -> Column:
        # Later blocks are earlier ones in falling order, which Spark evaluates as a running frame too.
        w = Window.partitionBy(*parts).orderBy(F.desc(order) if later else F.asc(order)).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(c).over(w), F.lit(0)) if kind == "sum" else F.last(c, ignorenulls=True).over(w)

    near = far.withColumns({f"_n{o}": taken(k, c, later, [key, "_far"], "_block") for o, (k, c, later) in wanted.items()})
    whole = {c: F.sum(c) if kind == "sum" else (F.min_by if later else F.max_by)(c, F.when(F.col(c).isNotNull(), F.col("_block"))) for kind, c, later in wanted.values()}
    # A group carries its blocks, at most ``FAN``, along, so that the blocks are worked out once.
    groups = near.groupBy(key, "_far").agg(*[x.alias(c) for c, x in whole.items()], F.collect_list(F.struct("_block", *[f"_n{o}" for o in wanted])).alias("_rows"))
    outer = groups.select(key, "_rows", *[taken(k, c, later, [key], "_far").alias(f"_o{o}") for o, (k, c, later) in wanted.items()])
    each = outer.select(key, F.explode("_rows").alias("_x"), *[f"_o{o}" for o in wanted])
    joined = [(F.col(f"_x._n{o}") + F.col(f"_o{o}") if k == "sum" else F.coalesce(f"_x._n{o}", f"_o{o}")).alias(o) for o, (k, _, _) in wanted.items()]
    return each.select(key, F.col("_x._block").alias("_block"), *joined)


def running(df: DataFrame, key: str, pos: str, sums: dict[str, Column] | None = None, fills: dict[str, Column] | None = None, before: dict[str, Column] | None = None, size: int = BLOCK) -> DataFrame:
    """``df`` with running values over each key in order of ``pos``, in two levels.

    ``sums``: sums up to and with the row; ``fills``: the last non-null value up to and with
    the row; ``before``: the last non-null value ahead of the row.  Windows run inside
    blocks; one row per block carries totals and last values on.  Rows without key or
    position are left out.
    """
    sums, fills, before = sums or {}, fills or {}, before or {}
    values = {f"_s_{o}": c for o, c in sums.items()} | {f"_f_{o}": c for o, c in (fills | before).items()}
    rows = df.where(F.col(key).isNotNull() & F.col(pos).isNotNull()).withColumns({"_block": block_no(F.col(pos), size), **values})
    totals = rows.groupBy(key, "_block").agg(*[F.sum(f"_s_{o}").alias(f"_t_{o}") for o in sums], *[F.max_by(f"_f_{o}", F.when(F.col(f"_f_{o}").isNotNull(), F.col(pos))).alias(f"_l_{o}") for o in fills | before], F.count(F.lit(1)).alias("_rows"))
    carried = _around(totals, key, {f"_t_{o}": ("sum", f"_t_{o}", False) for o in sums} | {f"_l_{o}": ("last", f"_l_{o}", False) for o in fills | before})
    order = Window.partitionBy(key, "_block").orderBy(pos)
    here, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    told = rows.join(carried, [key, "_block"]).withColumns(
        {o: F.col(f"_t_{o}") + F.coalesce(F.sum(f"_s_{o}").over(here), F.lit(0)) for o in sums}
        | {o: F.coalesce(F.last(f"_f_{o}", ignorenulls=True).over(here), F.col(f"_l_{o}")) for o in fills}
        | {o: F.coalesce(F.last(f"_f_{o}", ignorenulls=True).over(ahead), F.col(f"_l_{o}")) for o in before}
    )
    return told.drop("_block", *values, *[c for c in carried.columns if c not in (key, "_block")])
