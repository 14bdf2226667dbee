"""Mixing sources to target weights (problem 9).

Method: Pfair scheduling.  The mix is cut into blocks of equal size; block i of a source of
weight w may not start before ``floor((i - 1) / w)`` and must be done by ``ceil(i / w)``.
Earliest deadline first then interleaves the sources so that each, at any time, is less than
one block from its share.  Records fill the blocks of their source in an order of their own.

A block has at most ``BLOCK_TOKENS`` tokens.  A large mix is cut into frames, in each of which every
source has the same part of its budget, and one schedule of at most about ``BLOCKS`` slots serves
every frame.

Sizes are tokens of a public tokenizer.  Only totals per source and the schedule, whose
length is a parameter, are on the driver; the places of records are prefix sums in two
levels, over buckets of bounded size and within them.

Defined cases: case and outer blanks of a source do not matter; records of unlisted or null
sources, and those without tokens, are not drawn; a listed source without documents gets
nothing, and its share is spread over the others in proportion; rows of one source in the
targets are added up, with the greater number of repeats; a share or number of repeats that
is null or not above 0 asks for nothing.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.bpe import BYTE_BPE_50K, count_tokens
from wordloom.session import checkpointed

#: Blocks of a frame; a source with less than a block has one of its own. The mix is off its shares by less than a block at any point.
BLOCKS = 4096
#: Most tokens of a block.
BLOCK_TOKENS = 1 << 20
#: Records in a bucket of the prefix sums, on average, and the most sources that may be listed.
BUCKET_ROWS = 50_000
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Plan:
    """What is drawn of a source: its target and capacity, and the tokens to draw."""

    source: str
    target_share: float
    max_repeats: int
    available: int
    budget: int


def source_name(source: Column) -> Column:
    name = F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))
    return F.when(name != "", name)


def read_targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Share and most repeats by source; the table is small by its nature, which is checked."""
    rows = targets.select(source_name(F.col("source")).alias("s"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r"))
    wanted = rows.where(F.col("s").isNotNull() & (F.col("w") > 0) & ~F.isnan("w") & (F.col("r") > 0)).groupBy("s").agg(F.sum("w").alias("w"), F.max("r").alias("r"))
    found = wanted.orderBy("s").take(MAX_SOURCES + 1)
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources are listed")
    return {x.s: (x.w, x.r) for x in found}


def budgets(targets: dict[str, tuple[float, int]], available: dict[str, int], total: int | None = None) -> list[Plan]:
    """Tokens to draw of each source.

    Without ``total``: the largest mix in which every source that has documents keeps its
    proportion.  With it: shares of ``total``, where a source that has not enough gives all
    its repeats allow and the others make up for it in proportion.
    """
    most = {s: available.get(s, 0) * r for s, (_, r) in targets.items()}
    open_ = {s: Fraction(w) for s, (w, _) in targets.items() if most[s] > 0}
    given = dict.fromkeys(targets, Fraction(0))
    if open_ and total is None:
        size = min(most[s] / w for s, w in open_.items())
        given |= {s: size * w for s, w in open_.items()}
    left = Fraction(total or 0)
    while open_ and left > 0:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= most[s]]
        if not full:
            given |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in full:
            given[s] = Fraction(most[s])
            left -= most[s]
            del open_[s]
    return [Plan(s, w, r, available.get(s, 0), min(round(given[s]), most[s])) for s, (w, r) in targets.items()]


def pfair(weights: dict[str, int], slots: int) -> list[str]:
    """The source of each slot, by earliest deadline among the blocks released."""
    total = sum(weights.values())
    if total == 0:
        return []
    release = lambda s, i: (i - 1) * total // weights[s]
    deadline = lambda s, i: -(-i * total // weights[s])
    waiting = [(0, s, 1) for s, w in weights.items() if w > 0]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    order: list[str] = []
    for slot in range(slots):
        while waiting and waiting[0][0] <= slot:
            _, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(s, i), s, i))
        if not ready:  # all released blocks are done
            continue
        _, s, i = heapq.heappop(ready)
        order.append(s)
        heapq.heappush(waiting, (max(slot + 1, release(s, i + 1)), s, i + 1))
    return order


def _draw(documents: DataFrame, targets: DataFrame, total: int | None, blocks: int, path: str, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, list[Plan]]:
    spark = documents.sparkSession
    wanted = read_targets(targets)
    listed = documents.select("doc_id", source_name(F.col("source")).alias("source"), "text").where(F.col("source").isin(list(wanted)))
    # Counting tokens is the costly part and its result is narrow: it is kept in the shared folder.
    sized = checkpointed(count_tokens(listed, "text", ["doc_id", "source"], path=path).where(F.col("n_tokens") > 0))
    sums = {x.source: x for x in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    plans = budgets(wanted, {s: x.t for s, x in sums.items()}, total)
    mixed = sum(p.budget for p in plans)
    frames = max(1, -(-mixed // (blocks * block_tokens)))
    block = max(1, -(-mixed // (frames * blocks)))
    # Blocks of each source in a frame; the last may be smaller.
    shares_of = {p.source: -(-(-(-p.budget // frames)) // block) for p in plans if p.budget > 0}
    width = sum(shares_of.values())

    turn: dict[str, int] = {}
    slots = []
    for slot, s in enumerate(pfair(shares_of, width)):
        slots.append((s, turn.get(s, 0), slot))
        turn[s] = turn.get(s, 0) + 1
    schedule = spark.createDataFrame(slots, "source string, _block long, _slot long")
    known = spark.createDataFrame([(p.source, p.budget, p.available) for p in plans if p.budget > 0], "source string, _budget long, _available long")

    buckets = 1 + max((x.n for x in sums.values()), default=0) // BUCKET_ROWS
    hashed = sized.withColumn("_h", F.xxhash64("doc_id")).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))
    per_bucket = hashed.groupBy("source", "_bucket").agg(F.sum("n_tokens").alias("_t"))
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "_bucket", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("source", "_bucket").orderBy("_h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = hashed.withColumn("_in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(offsets, ["source", "_bucket"]).join(F.broadcast(known), "source")
    start = F.col("_offset") + F.col("_in")
    # A pass over the source begins where the one before ended; records that start within the budget are drawn.
    passes = F.greatest(F.lit(0), F.ceil((F.col("_budget") - start) / F.col("_available"))).cast("int")
    drawn = placed.withColumn("_passes", passes).where(F.col("_passes") > 0).select("doc_id", "source", "n_tokens", "_available", "_budget", start.alias("_start"), F.explode(F.sequence(F.lit(1), F.col("_passes"))).alias("copy_no"))
    drawn = drawn.withColumn("source_offset", F.col("_start") + (F.col("copy_no") - 1).cast("long") * F.col("_available"))
    # The frame of an offset, and the block from the frame's first offset on; a frame begins at the budget's part, rounded up.
    part = F.ceil(F.col("_budget") / F.lit(frames)).cast("long")
    frame = F.least(F.floor(F.col("source_offset") / part), F.lit(frames - 1)).cast("long")
    timed = drawn.withColumns({"_frame": frame, "_block": F.floor((F.col("source_offset") - frame * part) / block)}).join(F.broadcast(schedule), ["source", "_block"])
    return timed.select("doc_id", "source", "copy_no", "n_tokens", (F.col("_frame") * width + F.col("_slot")).alias("slot"), "source_offset"), plans


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, blocks: int = BLOCKS, path: str = BYTE_BPE_50K, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, source, copy_no, n_tokens, slot, source_offset``: the drawn records.

    Ordered by ``slot, source_offset`` they are the mix; ``slot`` is the block's place.
    """
    return _draw(documents, targets, total, blocks, path, block_tokens)[0]


def shares(documents: DataFrame, targets: DataFrame, total: int | None = None, blocks: int = BLOCKS, path: str = BYTE_BPE_50K) -> DataFrame:
    """``source, target_share, actual_share, n_tokens, n_records, most_copies`` of each listed source."""
    drawn, plans = _draw(documents, targets, total, blocks, path)
    spark = documents.sparkSession
    listed = spark.createDataFrame([(p.source, p.target_share) for p in plans], "source string, target_share double")
    got = drawn.groupBy("source").agg(F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_records"), F.max("copy_no").cast("long").alias("most_copies"))
    rows = listed.join(got, "source", "left").fillna(0, ["n_tokens", "n_records", "most_copies"])
    whole = F.sum("n_tokens").over(Window.partitionBy())  # one row per listed source
    return rows.select("source", "target_share", F.when(whole > 0, F.col("n_tokens") / whole).otherwise(0.0).alias("actual_share"), "n_tokens", "n_records", "most_copies")
