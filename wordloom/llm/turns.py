"""Speech transcripts into clean speaker turns (problem 1).

Method: line templates are mined by fixed-depth token trees (``layouts``) from all tokens and
all speaker labels; the timestamp and speaker slots inferred per layout then drive the
extraction: the number in the speaker slot is the speaker, rows of a time layout and
marked-off annotations are no words.  The merge rules join words to turns.

Long recordings are cut into blocks; a block takes over from its neighbours the last speaker
and the nearest annotation mark, and turns at block edges are joined, so no recording is
gathered into one task.

Defined cases: copies (same recording and position) count once; rows without recording or
position are left out; null and blank tokens are no words; a row before any usable label has
no speaker and makes no turn; an opening mark that nothing closes before the next opening
mark is part of a word; empty tables give no turns.  ``speaker_turns`` keeps what it computes
per row in storage until ``clearCache``; a lost executor's part is computed again.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm import layouts
from wordloom.llm.charforms import plain
from wordloom.llm.repeats import core_of, seconds
from wordloom.operators.blocks import BLOCK, block_carry, block_no, one_per_place, running, stitched_runs

# Sounds of hesitation, with letters drawn out.
HESITATION = r"^(?:u+h+m*|u+m+|e+r+m*|e+h+m*|h+m+|m{2,}|ä+h+m*|e+u+h+)$"
# A label of class TIME among packed labels.
_TIME_LABEL = r"(?i)(?:^|[^0-9\p{L}])[0-9]+\s*:\s*TIME(?![\p{L}_>])"
_LOOSE_ENDS = r"""^["'“”‘’\s]+|["'“”‘’\s.,;:!?…-]+$"""


def _framed(token: Column) -> Column:
    """A plain token without quotes around it and punctuation behind it, so that its layout shows."""
    return F.regexp_replace(token, _LOOSE_ENDS, "")


def _counted(tokens: DataFrame, column: str) -> DataFrame:
    """The distinct texts of a column with their counts, kept.

    What is made of a text must come after the count: Spark would otherwise evaluate it for
    every row, since it depends on the grouping key alone.
    """
    return tokens.groupBy(F.col(column).alias("text")).agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)


def _looked_up(rows: DataFrame, small: DataFrame, on: str) -> DataFrame:
    """Rows joined with a table of layouts or labels.

    The table is kept, and sent to every task if its rows are counted to be few.  Else it is
    joined by shuffle, in copies among which the rows of a common layout are spread.
    """
    kept = small.persist(StorageLevel.MEMORY_AND_DISK)
    if kept.count() <= layouts.MAX_SENT:
        return rows.join(F.broadcast(kept), on, "left")
    copies = kept.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(layouts.COPIES - 1))))
    return rows.withColumn("_copy", F.pmod(F.hash("recording", "pos"), F.lit(layouts.COPIES))).join(copies, [on, "_copy"], "left").drop("_copy")


#: What ``detail`` adds to each row.
_DETAIL = ("text", "start_secs", "end_secs")


def classified(tokens: DataFrame, detail: bool = False, size: int = BLOCK) -> DataFrame:
    """One row per place: ``recording, _block, pos, word, mark, speaker_no``; with ``detail`` the clean text and times too.

    ``word`` tells whether the row is a word but for annotations over several rows, whose
    marks are in ``mark`` (``open`` or ``close`` with the mark).
    """
    # Templates and speaker labels are worked out on distinct texts, counted before the shuffle.
    texts = _counted(tokens, "token").select(F.lit("token").alias("field"), _framed(plain(F.col("text"))).alias("text"), "n")
    labels = _counted(tokens, "speaker").select(F.col("text").alias("_label"), layouts.numbered(plain(F.col("text"))).alias("text"), "n")
    roles = layouts.roles(layouts.mine(texts.unionByName(labels.select(F.lit("speaker").alias("field"), "text", "n"))))
    by_token = roles.where(F.col("field") == "token").select(F.col("path").alias("_tp"), F.col("role").alias("_role"))
    slots = roles.where(F.col("field") == "speaker").select(F.col("path").alias("_sp"), F.col("slot").alias("_slot"))
    number = F.get(F.regexp_extract_all("text", F.lit(r"([0-9]+)"), F.lit(1)), F.col("_slot")).try_cast("long")
    by_label = labels.withColumn("_sp", layouts.path(F.col("text"))).join(slots, "_sp").where(F.col("_label").isNotNull()).select("_label", number.alias("speaker_no"))

    rows = tokens.select(
        "recording",
        "pos",
        F.col("speaker").alias("_label"),
        "labels",
        "best_label",
        plain(F.col("token")).alias("text"),
        *([seconds(F.col("ts")).alias("start_secs"), seconds(F.col("end_ts")).alias("end_secs")] if detail else []),
    ).withColumn("_simple", F.col("text").rlike("^[A-Za-z]+$"))
    # Most tokens are bare letters, for which framing and masking change nothing.
    path = F.when(F.col("_simple"), layouts.path(F.lit("a"))).otherwise(layouts.path(_framed(F.col("text"))))
    told = _looked_up(_looked_up(rows.withColumn("_tp", path), by_token, "_tp"), by_label, "_label")

    said = F.col("_simple") | F.coalesce(F.col("text").rlike(r"[\p{L}\p{N}]"), F.lit(False))
    core = F.when(F.col("_simple"), F.lower("text")).otherwise(core_of(F.col("text")))
    hesitates = F.coalesce(core.rlike(HESITATION), F.lit(False))
    timed = F.coalesce(F.col("labels").rlike(_TIME_LABEL), F.lit(False)) | F.coalesce(F.col("best_label").rlike(_TIME_LABEL), F.lit(False))
    off = F.col("_role").isin("note", "none") | ((F.col("_role") == "time") & ~timed)
    word = F.coalesce(said, F.lit(False)) & ~hesitates & ~F.coalesce(off, F.lit(False))
    mark = F.when(F.col("_role").startswith("open") | F.col("_role").startswith("close"), F.col("_role"))
    flat = told.select("recording", "pos", word.alias("word"), mark.alias("mark"), "speaker_no", *(_DETAIL if detail else ()))
    return one_per_place(flat, "recording", "pos", ["word", "mark", "speaker_no", *(_DETAIL if detail else ())], size)


def turn_words(tokens: DataFrame, detail: bool = False, size: int = BLOCK) -> DataFrame:
    """The words of all recordings with their speaker: ``recording, _block, pos, speaker_no`` and what ``detail`` adds."""
    rows = classified(tokens, detail, size).persist(StorageLevel.MEMORY_AND_DISK)
    carried = block_carry(rows, "recording", "pos", {"_spoke": "speaker_no"}, {}).join(_notes(rows, size), ["recording", "_block"], "left")
    order = Window.partitionBy("recording", "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    full = rows.join(carried, ["recording", "_block"]).withColumn("_who", F.coalesce(F.last("speaker_no", ignorenulls=True).over(order), F.col("_spoke")))
    noted = F.col("_notes").isNotNull() & F.exists("_notes", lambda n: F.col("pos").between(n["a"], n["z"]))
    return full.where(F.col("word") & ~noted).select("recording", "_block", "pos", F.col("_who").alias("speaker_no"), *(_DETAIL if detail else ()))


def _notes(rows: DataFrame, size: int) -> DataFrame:
    """Annotations over several rows, by block: ``recording, _block, _notes`` (places ``a`` to ``z``).

    An opening mark whose next mark closes it makes one.  Only rows with marks are looked at;
    the next mark of the last in a block is the first of a later block.
    """
    order = Window.partitionBy("recording", "_block").orderBy("pos")
    shut = F.create_map(*[F.lit(x) for o, c in layouts.ENCLOSING.items() for x in (f"open{o}", f"close{c}")])
    marks = rows.where(F.col("mark").isNotNull()).select("recording", "_block", "pos", "mark", F.struct("pos", "mark").alias("_self"))
    after = block_carry(marks, "recording", "pos", {}, {"_after": "_self"})
    told = marks.join(after, ["recording", "_block"]).withColumn("_next", F.coalesce(F.lead("_self").over(order), F.col("_after")))
    pairs = told.where(F.col("mark").startswith("open") & (F.col("_next.mark") == shut[F.col("mark")])).select("recording", "pos", F.col("_next.pos").alias("z"))
    by_block = pairs.select("recording", F.explode(F.sequence(block_no(F.col("pos"), size), block_no(F.col("z"), size))).alias("_block"), F.struct(F.col("pos").alias("a"), "z").alias("_n"))
    return by_block.groupBy("recording", "_block").agg(F.collect_list("_n").alias("_notes"))


def speaker_turns(tokens: DataFrame, detail: bool = False, size: int = BLOCK) -> DataFrame:
    """``recording, speaker_no, first_pos, last_pos, n``: the turns of all recordings; with ``detail`` their times too."""
    bounds = {"low": ("start_secs",), "high": ("end_secs",)} if detail else {}
    return stitched_runs(turn_words(tokens, detail, size), "recording", "pos", "speaker_no", by_difference=False, **bounds)


def turn_texts(tokens: DataFrame, piece: int = 256, size: int = BLOCK) -> DataFrame:
    """``recording, speaker_no, first_pos, piece, text``: the clean words of each turn in order.

    A turn of more than ``piece`` words comes in pieces numbered from 1, so that a monologue
    of any length is never one row.
    """
    words = turn_words(tokens, True, size).where(F.col("speaker_no").isNotNull()).select("recording", "pos", "speaker_no", "text").persist(StorageLevel.MEMORY_AND_DISK)
    # A word opens a turn if the one ahead is by another speaker; its place is carried on to those that follow.
    told = running(words, "recording", "pos", before={"_prev": F.col("speaker_no")}, size=size)
    opens = F.when(~F.coalesce(F.col("_prev") == F.col("speaker_no"), F.lit(False)), F.col("pos"))
    placed = running(told, "recording", "pos", fills={"first_pos": opens}, size=size)
    cut = placed.withColumn("piece", F.floor((F.col("pos") - F.col("first_pos")) / piece) + 1)
    texts = cut.groupBy("recording", "speaker_no", "first_pos", "piece").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("_w"))
    return texts.select("recording", "speaker_no", "first_pos", "piece", F.array_join(F.transform("_w", lambda w: w["text"]), " ").alias("text"))
