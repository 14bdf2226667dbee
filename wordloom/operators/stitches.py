"""Stitches: the alignment joined with hypothesis timings and reference rows.

The k-th stitch that has a hypothesis word belongs to the k-th hypothesis word; a stitch
outside spans to its reference row; inside a span the rows are spread over the words.  Both
are equi-joins on an index from a running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.blocks import running

#: Columns of a reference row that a stitch takes over.
ROW_COLUMNS = ["token", "speaker", "ts", "end_ts", "punctuation", "prepunctuation", "casing", "labels", "wer_tags", "confidence"]


def comment() -> Column:
    """What the operation says of itself: ``ins``, ``del``, ``sub(word)`` or nothing."""
    op = F.col("op")
    return F.when(op == "sub", F.concat(F.lit("sub("), F.col("hyp_tok"), F.lit(")"))).when(op.isin("ins", "del"), op).otherwise("")


def numbered(tokens: DataFrame, key: str = "utt_id", name: str = "idx") -> DataFrame:
    """Tokens with their index from 0 in order of ``pos``."""
    return running(tokens, key, "pos", sums={name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("long"))


def with_timings(stitches: DataFrame, hyp: DataFrame) -> DataFrame:
    """Stitches with ``start_ts, end_ts, duration, conf, hyp_orig`` of their hypothesis word.

    ``hyp``: ``utt_id, pos, token`` and, if timed, ``start_ts, duration, confidence`` (timed
    words) or ``start_ts, end_ts``.  A missing start counts as 0 where only an end is given
    and the other way round; without any the times are 0.
    """
    told = stitches
    if "hyp_idx" not in stitches.columns:  # the aligner tells it
        heard = F.col("op").isin("cor", "sub", "ins").cast("long")
        told = running(stitches, "utt_id", "seq", sums={"hyp_idx": heard}).withColumn("hyp_idx", F.when(heard == 1, F.col("hyp_idx") - 1))
    have = set(hyp.columns)
    col = lambda c: F.col(c).cast("string").try_cast("double") if c in have else F.lit(None).cast("double")
    start = F.coalesce(col("start_ts"), col("end_ts"), F.lit(0.0))
    if "duration" in have:
        duration = F.coalesce(col("duration"), F.lit(0.0))
        end = start + duration
    else:
        end = F.coalesce(col("end_ts"), col("start_ts"), F.lit(0.0))
        duration = end - start
    words = numbered(hyp.withColumns({"_start": start, "_end": end, "_duration": duration, "_conf": col("confidence")}), name="hyp_idx")
    words = words.select("utt_id", "hyp_idx", F.col("token").alias("hyp_orig"), F.col("_start").alias("start_ts"), F.col("_end").alias("end_ts"), F.col("_duration").alias("duration"), F.col("_conf").alias("conf"))
    return told.join(words, ["utt_id", "hyp_idx"], "left")


def with_rows(stitches: DataFrame, rows: DataFrame) -> DataFrame:
    """Stitches with the reference row of each word in ``nlp`` (null for insertions outside spans) and ``suffix``.

    ``rows``: ``utt_id, pos`` and ``ROW_COLUMNS``; ``stitches`` as ``align_pairs`` gives them.
    Inside a span of r rows and w words: one and one, attach; r = w, in order (``,direct``);
    one row, copied to all, with its case on the first word and its punctuation on the last
    (``,push_last``); else first row to first word, last to last (``,split_worst``).
    """
    first = rows.select("utt_id", "pos", *[(F.col(c) if c in rows.columns else F.lit(None)).cast("string").alias(c) for c in ROW_COLUMNS])
    indexed = numbered(first).select("utt_id", "idx", F.struct(*ROW_COLUMNS).alias("nlp"))
    in_span = F.col("span").isNotNull()
    # Insertions inside a span share in its rows.
    said = F.col("op").isin("cor", "sub", "del", "noop") | ((F.col("op") == "ins") & in_span)
    # Words of a span, numbered; a span is as long as one rule or entity, and what is outside spans goes by blocks.
    span = Window.partitionBy("utt_id", "span", "_lane")
    laned = stitches.where(F.col("op") != "empty").withColumn("_lane", F.when(~in_span, F.floor(F.col("seq") / 4096)))
    told = laned.withColumns({"_w": F.when(in_span & said, F.sum(said.cast("int")).over(span)), "_k": F.when(in_span & said, F.sum(said.cast("int")).over(span.orderBy("seq")) - 1)})
    w, k, r = F.col("_w"), F.col("_k"), F.col("span_rows")
    row = (
        F.when(~said, F.lit(None))
        .when(~in_span, F.col("ref_row"))
        .when(r == w, F.col("span_row") + k)
        .when(r == 1, F.col("span_row"))
        .when(k == 0, F.col("span_row"))
        .when(k == w - 1, F.col("span_row") + r - 1)
    )
    suffix = F.when(~said | ~in_span | ((r == 1) & (w == 1)), "").when(r == w, ",direct").when(r == 1, ",push_last").otherwise(",split_worst")
    told = told.withColumns({"_row": row.cast("long"), "suffix": suffix, "_lead": F.when(in_span & said, F.col("span_row"))})
    # The first and last rows of a span lend their fields to rows in between.
    a = indexed.select("utt_id", F.col("idx").alias("_row"), F.col("nlp").alias("_own"))
    b = indexed.select("utt_id", F.col("idx").alias("_lead"), F.col("nlp").alias("_head"))
    c = indexed.select("utt_id", F.col("idx").alias("_last"), F.col("nlp.punctuation").alias("_mark"))
    full = told.withColumn("_last", F.when((r > 1) & (w == 1), F.col("span_row") + r - 1)).join(a, ["utt_id", "_row"], "left").join(b, ["utt_id", "_lead"], "left").join(c, ["utt_id", "_last"], "left")
    blank = F.lit("")
    pushed = F.col("_own").withField("casing", F.when(k == 0, F.col("_own.casing")).otherwise("LC")).withField("punctuation", F.when(k == w - 1, F.col("_own.punctuation")).otherwise(blank)).withField("prepunctuation", F.when(k == w - 1, F.col("_own.prepunctuation")).otherwise(blank))
    between = F.struct(
        blank.alias("token"), F.col("_head.speaker").alias("speaker"), blank.alias("ts"), blank.alias("end_ts"), blank.alias("punctuation"), blank.alias("prepunctuation"), F.lit("LC").alias("casing"), F.col("_head.labels").alias("labels"), F.col("_head.wer_tags").alias("wer_tags"), blank.alias("confidence")
    )
    nlp = (
        F.when(~said, F.lit(None))
        .when(F.col("suffix") == ",push_last", pushed)
        .when((F.col("suffix") == ",split_worst") & (w == 1), F.col("_own").withField("punctuation", F.col("_mark")))
        .when((F.col("suffix") == ",split_worst") & (k > 0) & (k < w - 1), between)
        .otherwise(F.col("_own"))
    )
    return full.withColumn("nlp", nlp).drop("_w", "_k", "_lane", "_row", "_lead", "_last", "_own", "_head", "_mark")


def flat(stitches: DataFrame) -> DataFrame:
    """Stitches with the fields of their row as columns: ``speaker, punctuation, casing, nlp_token, tags``."""
    return stitches.withColumns({"speaker": F.col("nlp.speaker"), "punctuation": F.col("nlp.punctuation"), "casing": F.col("nlp.casing"), "nlp_token": F.col("nlp.token"), "tags": F.regexp_extract_all(F.coalesce("nlp.wer_tags", F.lit("")), F.lit("'([^']*)'"), F.lit(1))})


def out_of_step(stitches: DataFrame) -> DataFrame:
    """``utt_id, seq, why``: stitches that do not fit what they were joined with.

    ``heard``: the hypothesis word is another one or missing; ``row``: a reference word has no
    row.  A sound join gives none.
    """
    heard = F.col("op").isin("cor", "sub", "ins") & ~F.coalesce(F.lower("hyp_orig") == F.lower("hyp_tok"), F.lit(False))
    why = F.when(heard, "heard")
    if "nlp" in stitches.columns:
        why = why.when(F.col("op").isin("cor", "sub", "del") & F.col("nlp").isNull(), "row")
    return stitches.select("utt_id", "seq", why.alias("why")).where(F.col("why").isNotNull())
