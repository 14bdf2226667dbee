"""Hypotheses with known errors, made from references by arithmetic on places.

The decisions depend on a number of the utterance and the place only, so any engine that can
take remainders makes the same errors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decision(utterance: Column, pos: Column) -> Column:
    """A number from 0 to 99 for each place."""
    return F.pmod(pos * 31 + utterance * 17, F.lit(100))


def inject_errors(tokens: DataFrame, utterance: Column, dels: int = 10, subs: int = 10, ins: int = 10) -> DataFrame:
    """Stitches ``utt_id, seq, class_label, span, ref_tok, hyp_tok, op, pos`` with percentages of known errors.

    A word is deleted, substituted by ``sub`` and its place, or followed by an insertion
    ``ins`` and its place.
    """
    r = decision(utterance, F.col("pos"))
    p = F.col("pos").cast("string")
    row = lambda part, ref, hyp, op: F.struct(F.lit(part).alias("part"), ref.alias("ref_tok"), hyp.alias("hyp_tok"), F.lit(op).alias("op"))
    t = F.col("token")
    inserted = row(1, F.lit("<ins>"), F.concat(F.lit("ins"), p), "ins")
    parts = (
        F.when(r < dels, F.array(row(0, t, F.lit("<del>"), "del")))
        .when(r < dels + subs, F.array(row(0, t, F.concat(F.lit("sub"), p), "sub")))
        .when(r < dels + subs + ins, F.array(row(0, t, t, "cor"), inserted))
        .otherwise(F.array(row(0, t, t, "cor")))
    )
    rest = [c for c in tokens.columns if c not in ("utt_id", "pos", "token")]
    out = tokens.select("utt_id", "pos", *rest, F.explode(parts).alias("x"))
    # A fixed place for each row: two per word.
    return out.select("utt_id", (F.col("pos") * 2 + F.col("x.part")).alias("seq"), "pos", *rest, F.lit("global").alias("class_label"), F.lit(None).cast("long").alias("span"), "x.ref_tok", "x.hyp_tok", "x.op")


def hypothesis(stitches: DataFrame) -> DataFrame:
    """The hypothesis words of stitches: ``utt_id, pos, token``."""
    return stitches.where(F.col("op") != "del").select("utt_id", F.col("seq").alias("pos"), F.col("hyp_tok").alias("token"))


def synthetic_pairs(spark, utterances: int, length: int, dels: int = 10, subs: int = 10, ins: int = 10, vocabulary: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """References of made-up words ``w000000`` and their stitches with known errors."""
    rows = spark.range(utterances * length).select((F.col("id") / length).cast("long").alias("utt_id"), (F.pmod("id", F.lit(length)) + 1).alias("pos"))
    ref = rows.withColumn("token", F.concat(F.lit("w"), F.lpad(F.pmod(F.xxhash64("utt_id", "pos"), F.lit(vocabulary)).cast("string"), 6, "0")))
    return ref, inject_errors(ref, F.col("utt_id"), dels, subs, ins)
