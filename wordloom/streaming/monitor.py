"""Error rates of a stream of pairs: each pair is aligned as it comes, rates are kept per window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.operators.align import align_pairs


def stream_wer(pairs: DataFrame, window: str = "10 minutes", late: str = "1 hour", rules: list | None = None) -> DataFrame:
    """``window, ins, del, sub, n_ref`` of streamed pairs ``utt_id, at, ref, hyp``.

    The alignment has no state; the rates have one row per open window, and rows later than
    the watermark are left out.  ``at`` travels with the pair's key.
    """
    keyed = pairs.withColumn("utt_id", F.to_json(F.struct(F.col("at").cast("string").alias("at"), F.col("utt_id").cast("string").alias("utt_id"))))
    stitches = align_pairs(keyed, rules).withColumn("at", F.get_json_object("utt_id", "$.at").cast("timestamp"))
    op = F.col("op")
    return stitches.withWatermark("at", late).groupBy(F.window("at", window)).agg(F.count_if(op == "ins").alias("ins"), F.count_if(op == "del").alias("del"), F.count_if(op == "sub").alias("sub"), F.count_if(op.isin("cor", "del", "sub")).alias("n_ref"))
