r"""Several values packed in one field (problem 2).

Method: the delimiter is inferred per source.  A source is a field together with the layout
of its punctuation (brackets, quotes and separators with the values masked), since writers
differ within a field.  For each source every candidate delimiter splits every value; a
candidate scores by the regularity of piece types (the share of pieces quoted as a whole, or of
the shape that dominates the field), then by the consistency of piece counts: texts that fall
into the same number L of pieces make a pattern, each pattern weighs its texts by (L - 1) / L,
and the sum is divided by the number of patterns, so that few and long patterns score high and
one-piece texts nothing.  The best candidate then splits the rows, and the pieces are exploded
with their position.

All of it is expressions in the JVM: the split is a regular expression that steps over
quoted text, so a delimiter inside quotes belongs to the value.

Defined cases: null, empty, blank and bracket-only fields hold no value; empty pieces are no
values and take no position; repeated values stay; a text without any candidate delimiter is
one value; if two candidates score alike the earlier of ``DELIMITERS`` wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate delimiters by name, each as the inside of a character class.
DELIMITERS = {"comma": ",", "semicolon": ";", "bar": "|", "slash": "/", "tab": r"\t", "blank": r" \t "}

_SINGLE = r"'(?:[^'\\]|\\.|'')*'"
_DOUBLE = r'"(?:[^"\\]|\\.|"")*"'
_MAY_HOLD_MORE = r"[,;|/\s]"


def _bare(field: Column) -> Column:
    """The text without outer blanks and one pair of enclosing brackets."""
    text = F.regexp_replace(field, r"^[\s ]+|[\s ]+$", "")
    inner = F.regexp_extract(text, r"(?s)^[\[({](.*)[\])}]$", 1)
    return F.when(text.rlike(r"(?s)^(\[.*\]|\(.*\)|\{.*\})$"), inner).otherwise(text)


def _pieces(bare: Column, delimiter: str) -> Column:
    """Pieces of ``bare`` between delimiters outside quotes, blank ones dropped."""
    cls = DELIMITERS[delimiter]
    edge = f"[{cls}]" if delimiter != "blank" else r"\s"
    pattern = rf"(?s)(?:^|(?<={edge}))\s*(?:{_SINGLE}|{_DOUBLE})\s*(?=[{cls}]|$)|[^{cls}]+"
    found = F.regexp_extract_all(bare, F.lit(pattern), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.regexp_replace(p, r"^[\s ]+|[\s ]+$", "")), lambda p: p != "")


def _value(piece: Column) -> Column:
    """A piece without enclosing quotes, escapes and outer blanks."""
    inner = F.substring(piece, F.lit(2), F.greatest(F.length(piece) - 2, F.lit(0)))
    single = F.regexp_replace(F.regexp_replace(inner, "''", "'"), r"(?s)\\(.)", "$1")
    double = F.regexp_replace(F.regexp_replace(inner, '""', '"'), r"(?s)\\(.)", "$1")
    text = F.when(piece.rlike(f"(?s)^{_SINGLE}$"), single).when(piece.rlike(f"(?s)^{_DOUBLE}$"), double).otherwise(piece)
    return F.regexp_replace(text, r"^[\s ]+|[\s ]+$", "")


def _masked_value(piece: Column) -> Column:
    """The shape of a value: runs of digits become 9, runs of other characters but colons A."""
    return F.regexp_replace(F.regexp_replace(piece, r"[^0-9:]+", "A"), r"[0-9]+", "9")


def _layout(bare: Column) -> Column:
    """The punctuation of a text: quoted values become Q, unquoted ones V, blanks one blank; repeats collapse."""
    masked = F.regexp_replace(F.regexp_replace(bare, f"(?s){_DOUBLE}", "\u0001"), f"(?s){_SINGLE}", "\u0002")
    masked = F.regexp_replace(masked, r"[^\u0001\u0002,;|/\s]+", "V")
    masked = F.regexp_replace(masked, r"[\r\n  ]+", " ")
    # Which marks occur matters, how often and in what order does not.
    return F.array_join(F.array_sort(F.array_distinct(F.split(masked, ""))), "")


def long_form(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """One row ``row_id, field, _bare`` per row and field that has a text."""
    packed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields])
    rows = df.select(F.col(row_id).alias("row_id"), F.explode(packed).alias("_p")).select("row_id", F.col("_p.field").alias("field"), F.col("_p.text").alias("_text"))
    return rows.where(F.col("_text").isNotNull()).select("row_id", "field", _bare(F.col("_text")).alias("_bare")).where(F.col("_bare") != "")


def infer_delimiters(rows: DataFrame) -> DataFrame:
    """The best delimiter of each source (``field``, ``_layout``) of ``long_form`` rows, with its score.

    Distinct texts are counted first, so the candidates split each text once however often
    it occurs, and a field whose rows all look alike still spreads over many groups.
    """
    texts = rows.groupBy("field", "_bare").agg(F.count(F.lit(1)).alias("_n"))
    simple = ~F.col("_bare").rlike(_MAY_HOLD_MORE)
    # One row per field: the shape that most of its undivided values have.
    shapes = (
        texts.where(simple)
        .groupBy("field", _masked_value(_value(F.col("_bare"))).alias("_shape"))
        .agg(F.sum("_n").alias("_n"))
        .groupBy("field")
        .agg(F.max_by("_shape", F.struct("_n", "_shape")).alias("_main"))
    )
    many = texts.where(~simple).join(F.broadcast(shapes), "field", "left").withColumn("_layout", _layout(F.col("_bare")))

    def regular(p: Column) -> Column:
        quoted = p.rlike(f"(?s)^(?:{_SINGLE}|{_DOUBLE})$")
        return quoted | F.coalesce(_masked_value(p) == F.col("_main"), F.lit(False)) & ~p.rlike(_MAY_HOLD_MORE)

    tried = []
    for rank, name in enumerate(DELIMITERS):
        p = _pieces(F.col("_bare"), name)
        tried.append(F.struct(F.lit(name).alias("name"), F.lit(-rank).alias("rank"), F.size(p).alias("pieces"), F.size(F.filter(p, regular)).alias("regular")))
    each = many.select("field", "_layout", "_n", F.explode(F.array(*tried)).alias("_t"))
    source = ["field", "_layout", F.col("_t.name").alias("delimiter"), F.col("_t.rank").alias("_rank")]
    patterns = each.groupBy(*source, F.col("_t.pieces").alias("_l")).agg(F.sum("_n").alias("_n"), F.sum(F.col("_t.regular") * F.col("_n")).alias("_regular"))
    # A source has a pattern for each number of pieces that occurs, so the second count is of few rows.
    scored = patterns.groupBy("field", "_layout", "delimiter", "_rank").agg(
        (F.sum("_regular") / F.greatest(F.sum(F.col("_l") * F.col("_n")), F.lit(1))).alias("regularity"),
        (F.sum(F.col("_n") * (F.col("_l") - 1) / F.greatest("_l", F.lit(1))) / (F.count(F.lit(1)) * F.sum("_n"))).alias("consistency"),
    )
    return scored.groupBy("field", "_layout").agg(F.max_by(F.struct("delimiter", "regularity", "consistency"), F.struct("regularity", "consistency", "_rank")).alias("_b")).select("field", "_layout", "_b.*")


def unpack(df: DataFrame, row_id: str, fields: list[str], least: int = 2) -> DataFrame:
    """``row_id, field, idx, val``: each value of each field that holds at least ``least`` values.

    ``least`` of 1 gives single values too.  Extra columns of ``df`` are ignored.
    """
    rows = long_form(df, row_id, fields)
    simple = ~F.col("_bare").rlike(_MAY_HOLD_MORE)
    best = infer_delimiters(rows).select("field", "_layout", "delimiter")
    many = rows.where(~simple).withColumn("_layout", _layout(F.col("_bare"))).join(best, ["field", "_layout"])
    split = reduce(lambda c, n: c.when(F.col("delimiter") == n, _pieces(F.col("_bare"), n)), DELIMITERS, F.when(F.lit(False), F.array().cast("array<string>")))
    split_rows = many.select("row_id", "field", split.alias("_pieces"))
    if least < 2:
        split_rows = split_rows.unionByName(rows.where(simple).select("row_id", "field", F.array("_bare").alias("_pieces")))
    values = split_rows.select("row_id", "field", F.filter(F.transform("_pieces", _value), lambda v: v != "").alias("_values")).where(F.size("_values") >= least)
    return values.select("row_id", "field", F.posexplode("_values").alias("_i", "val")).select("row_id", "field", (F.col("_i") + 1).cast("long").alias("idx"), "val")
