"""Line templates by fixed-depth token trees, with their timestamp and speaker slots.

A text is masked (runs of digits, letters) and cut into pieces.  The tree has fixed depth:
field, number of pieces, the first ``DEPTH`` pieces, the last piece; a leaf is one layout.
Distinct texts are counted before they enter the tree, so mining shuffles each text once.
What a layout's slots mean is inferred from all values seen in them, weighed by how often they
occur, so that single bad rows change nothing: the slot whose number varies most along the
labels of a layout is the speaker; slots parted by colons, of which all but the first nearly
always stay under 60, are a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEPTH = 8
#: Up to so many layouts are sent to every task; with more, they are joined by shuffle, each in so many copies, since one
#: layout may be that of nearly all rows.
MAX_SENT = 20_000
COPIES = 64
#: A slot is a part of a time if at least this share of its values is under 60.
TIME_SHARE = 0.9

# Numbers in words, as speaker labels write them.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()
#: Marks that enclose an annotation.
ENCLOSING = {"[": "]", "(": ")", "<": ">", "{": "}", "*": "*"}


def numbered(label: Column) -> Column:
    """A speaker label in lower case with numbers in words as digits."""
    low = F.lower(label)
    out = low
    for n, word in enumerate(NUMBER_WORDS):
        out = F.regexp_replace(out, rf"(?<![\p{{L}}]){word}(?![\p{{L}}])", str(n))
    # Most labels hold no such word and skip the replacements.
    return F.when(low.rlike(rf"(?<![\p{{L}}])(?:{'|'.join(NUMBER_WORDS)})(?![\p{{L}}])"), out).otherwise(low)


def pieces(text: Column) -> Column:
    """The masked pieces of a text: 9 for digits, a for letters, every other mark, one blank for blanks."""
    masked = F.regexp_replace(F.regexp_replace(text, r"\p{N}+", "9"), r"[\p{L}\p{M}]+", "a")
    return F.split(F.regexp_replace(masked, r"\s+", " "), "")


def path(text: Column) -> Column:
    """The leaf of the tree that a text falls into."""
    p = pieces(text)
    leaf = F.concat_ws("\u0001", F.size(p).cast("string"), F.array_join(F.slice(p, 1, DEPTH), ""), F.when(F.size(p) > DEPTH, F.element_at(p, -1)).otherwise(""))
    # Most texts are a single run of letters or digits, whose leaf needs no masking.
    return F.when(text.rlike(r"^\p{L}+$"), F.lit("1\u0001a\u0001")).when(text.rlike(r"^[0-9]+$"), F.lit("1\u00019\u0001")).otherwise(leaf)


def mine(texts: DataFrame) -> DataFrame:
    """Layouts of ``field, text, n`` rows (texts with their counts): ``field, path, shape, closing, n, slots``.

    ``slots`` has, for each numeric slot, the share of values under 60 and of the commonest value.
    """
    distinct = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).groupBy("field", "text").agg(F.sum("n").alias("n"))
    leaves = distinct.select("field", path(F.col("text")).alias("path"), "n", F.regexp_extract_all("text", F.lit(r"([0-9]+)"), F.lit(1)).alias("numbers"))
    slots = leaves.select("field", "path", "n", F.posexplode_outer("numbers").alias("slot", "value"))
    values = slots.groupBy("field", "path", F.coalesce("slot", F.lit(-1)).alias("slot"), F.col("value").try_cast("long").alias("value")).agg(F.sum("n").alias("n"))
    each = values.groupBy("field", "path", "slot").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("value") < 60, F.col("n")).otherwise(0)) / F.sum("n")).alias("low"), (F.max("n") / F.sum("n")).alias("same"))
    parts = F.split("path", "\u0001")
    return (
        each.groupBy("field", "path")
        .agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", "low", "same")))).alias("slots"))
        .withColumns({"shape": F.get(parts, F.lit(1)), "closing": F.coalesce(F.nullif(F.get(parts, F.lit(2)), F.lit("")), F.substring(F.get(parts, F.lit(1)), -1, 1))})
    )


def roles(layouts: DataFrame) -> DataFrame:
    """What each layout means: ``field, path, role, slot``.

    Roles of tokens: ``time``, ``note`` (marked off), ``open`` and ``close`` with the mark,
    ``none`` (no letter or digit) and ``text``.  A speaker layout has role ``speaker`` and the
    slot of the number, or ``none``.
    """
    shape, closing, slots = F.col("shape"), F.col("closing"), F.col("slots")
    opening = F.substring(shape, 1, 1)
    opens = opening.isin(*ENCLOSING)
    shuts = closing.isin(*ENCLOSING.values())
    counterpart = F.create_map(*[F.lit(x) for kv in ENCLOSING.items() for x in kv])
    matched = opens & (counterpart[opening] == closing)
    under_60 = F.forall(F.filter(slots, lambda s: (s["slot"] > 0) & (s["slot"] < F.size(F.split(shape, ":")))), lambda s: s["low"] >= TIME_SHARE)
    token = (
        F.when(matched & (F.length(shape) > 1), F.lit("note"))
        .when(~shape.contains("9") & ~shape.contains("a") & (closing != "a") & (closing != "9"), "none")
        .when(shape.rlike(r"^9(:9){1,2}(\.9)?$") & under_60, "time")
        .when(opens & (opening != "*"), F.concat(F.lit("open"), opening))
        .when(shuts & (closing != "*"), F.concat(F.lit("close"), closing))
        .otherwise("text")
    )
    # The least share of one value, the first of equal ones.
    slot = F.array_min(F.transform(slots, lambda s: F.struct(s["same"].alias("same"), s["slot"].alias("slot"))))["slot"]
    by_speaker = F.col("field") == "speaker"
    return layouts.select(
        "field",
        "path",
        F.when(by_speaker, F.when(F.size(slots) > 0, "speaker").otherwise("none")).otherwise(token).alias("role"),
        F.when(by_speaker & (F.size(slots) > 0), slot).alias("slot"),
    )
