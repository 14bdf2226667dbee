"""The aligner as a table function of SQL: ``SELECT * FROM pairs, LATERAL wer_align(ref, hyp)``."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession


class WerAlign:
    """A row per step of the best alignment of two arrays of words; null arrays are empty."""

    def eval(self, ref: list, hyp: list) -> Iterator[tuple]:
        from wordloom.operators.align import align_words

        for seq, s in enumerate(align_words([w for w in ref or [] if w is not None], [w for w in hyp or [] if w is not None]), 1):
            yield seq, s.ref, s.hyp, s.op


def register(spark: SparkSession, name: str = "wer_align") -> None:
    """Makes the function known to SQL."""
    from pyspark.sql.functions import udtf

    from wordloom.session import ship

    ship(spark)
    spark.udtf.register(name, udtf(WerAlign, returnType="seq int, ref_tok string, hyp_tok string, op string"))
