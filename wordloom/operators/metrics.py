"""Error rates and n-gram statistics over stitches.

Every function is a grouped aggregate with combining before the shuffle.  Where a value
depends on order (speaker, sentence, place), it comes from running values in two levels, so
one utterance may hold a third of all rows.

``stitches`` has ``utt_id, seq, class_label, ref_tok, hyp_tok, op`` and, for the breakdowns,
``speaker, punctuation, casing, nlp_token, hyp_orig, tags``.  ``op`` is ``cor``, ``ins``,
``del``, ``sub``, ``noop`` (an optional span left out) or ``empty`` (a span without words).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.tokens import DEL, GLOBAL, INS, NOOP, UNCOUNTED, error_rate, is_countable_ngram, label_name, precision, recall, upper_count
from wordloom.operators.blocks import running, stitched_runs


def _op(name: str) -> Column:
    return F.count_if(F.col("op") == name)


def _counts(n_ref: Column) -> list[Column]:
    return [_op("ins").alias("ins"), _op("del").alias("del"), _op("sub").alias("sub"), n_ref.alias("n_ref")]


def _rated(df: DataFrame, empty: Column | None = None) -> DataFrame:
    errors = F.col("ins") + F.col("del") + F.col("sub")
    return df.withColumn("errors", errors).withColumn("wer", error_rate(F.col("errors"), F.col("n_ref"), empty))


def _words() -> Column:
    return F.count_if(F.col("op").isin("cor", "sub", "del") & ~F.col("ref_tok").isin(*UNCOUNTED))


def _rows(stitches: DataFrame) -> DataFrame:
    return stitches.where(F.col("op") != "empty")


def best_wer(stitches: DataFrame, utterances: DataFrame | None = None) -> DataFrame:
    """``utt_id, ins, del, sub, n_ref, errors, wer, precision, recall``.

    Utterances without any word have no stitch; ``utterances`` (``utt_id``) adds them with
    nothing counted and a rate of 0.
    """
    got = stitches.groupBy("utt_id").agg(*_counts(_words()))
    if utterances is not None:
        got = utterances.select("utt_id").distinct().join(got, "utt_id", "left").fillna(0, ["ins", "del", "sub", "n_ref"])
    correct = F.col("n_ref") - F.col("del") - F.col("sub")
    return _rated(got, F.lit(0.0)).withColumns({"precision": precision(correct, F.col("ins"), F.col("sub")), "recall": recall(correct, F.col("del"), F.col("sub"))})


def class_wer(stitches: DataFrame) -> DataFrame:
    """Per class of entity or synonym spans; a class seen only in empty spans has no words and a null rate."""
    return _rated(stitches.where(F.col("class_label") != GLOBAL).groupBy("utt_id", label_name(F.col("class_label")).alias("class_name")).agg(*_counts(_words())))


def with_speakers(stitches: DataFrame) -> DataFrame:
    """Stitches with ``who``: the speaker carried forward, and for what comes first the first speaker; ``who_before``: ahead of the row."""
    own = F.when(F.col("speaker") != "", F.col("speaker"))
    told = running(_rows(stitches), "utt_id", "seq", fills={"_who": own}, before={"who_before": own})
    first = stitches.groupBy("utt_id").agg(F.min_by("speaker", F.when(F.col("speaker") != "", F.col("seq"))).alias("_first"))
    return told.join(first, "utt_id").withColumn("who", F.coalesce("_who", "_first")).drop("_who", "_first")


def speaker_wer(stitches: DataFrame) -> DataFrame:
    """Per speaker; insertions belong to the speaker before them, leading ones to the first."""
    spoken = F.count_if(F.col("speaker").isNotNull() & (F.col("speaker") != ""))
    return _rated(with_speakers(stitches).groupBy("utt_id", F.coalesce("who", F.lit("")).alias("speaker_id")).agg(*_counts(spoken)))


def speaker_switch_wer(stitches: DataFrame, context: int = 5) -> DataFrame:
    """Errors within ``context`` reference words of a change of speaker; contexts that overlap count once.

    Each change tells the 2 * ``context`` word places around it, and a place keeps its first
    change; rows find theirs by an equi-join, whatever the length of an utterance.
    """
    if context <= 0:
        raise ValueError("the context must be above 0")
    told = running(with_speakers(stitches), "utt_id", "seq", sums={"_upto": (F.col("op") != "ins").cast("long")})
    told = told.withColumn("idx", F.col("_upto") - (F.col("op") != "ins").cast("long"))
    changed = (F.col("op") != "ins") & (F.col("speaker") != "") & F.col("who_before").isNotNull() & (F.col("speaker") != F.col("who_before"))
    near = told.where(changed).select("utt_id", F.col("idx").alias("_at"), F.explode(F.sequence(F.col("idx") - context, F.col("idx") + context - 1)).alias("idx"))
    near = near.groupBy("utt_id", "idx").agg(F.min("_at").alias("_at"))
    inside = told.join(near, ["utt_id", "idx"])
    counted = (F.col("op") != "ins") | (F.col("idx") != F.col("_at") - context)
    return _rated(inside.where(counted).groupBy("utt_id").agg(*_counts(F.count_if(F.col("op") != "ins")), F.lit(context).cast("long").alias("window_size")))


def sentence_wer(stitches: DataFrame) -> DataFrame:
    """Per sentence from 0, which a word with ``.``, ``?`` or ``!`` ends; what follows the last counts if it has words."""
    stop = F.coalesce(F.col("punctuation").isin(".", "?", "!"), F.lit(False)).cast("long")
    told = running(_rows(stitches), "utt_id", "seq", sums={"_stops": stop}).withColumn("sentence", F.col("_stops") - stop)
    got = told.groupBy("utt_id", "sentence").agg(*_counts(F.count_if(F.col("op") != "ins")), F.max(stop).alias("_closed"))
    return _rated(got.where((F.col("_closed") == 1) | (F.col("n_ref") > 0)).drop("_closed"))


def tag_wer(stitches: DataFrame) -> DataFrame:
    """Per tag of the words' rows."""
    each = _rows(stitches).select("utt_id", "op", F.explode("tags").alias("tag_id"))
    return _rated(each.groupBy("utt_id", "tag_id").agg(*_counts(F.count_if(F.col("op") != "ins"))))


def case_stats(stitches: DataFrame) -> DataFrame:
    """Casing of the hypothesis against the reference: matching words, and all with substitutions."""
    ref, hyp = upper_count(F.coalesce("nlp_token", F.lit(""))), upper_count(F.coalesce("hyp_orig", F.lit("")))
    low = F.coalesce(F.col("casing") == "LC", F.lit(False))
    verdict = F.when(low, F.when(hyp > 0, "fp")).when(ref == hyp, "tp").when(ref > hyp, "fn").otherwise("fp")
    told = _rows(stitches).where((F.col("hyp_tok") != DEL) & (F.col("ref_tok") != INS)).select("utt_id", verdict.alias("v"), (F.col("ref_tok") == F.col("hyp_tok")).alias("same"))
    n = lambda v, same: F.count_if((F.col("v") == v) & F.col("same") if same else F.col("v") == v)
    got = told.groupBy("utt_id").agg(*[n(v, s).alias(f"{name}_{v}") for name, s in (("matching", True), ("all", False)) for v in ("tp", "fp", "fn")])
    p = lambda k: F.when(F.col(f"{k}_tp") + F.col(f"{k}_fp") > 0, F.col(f"{k}_tp") / (F.col(f"{k}_tp") + F.col(f"{k}_fp"))).alias(f"{k}_precision")
    r = lambda k: F.when(F.col(f"{k}_tp") + F.col(f"{k}_fn") > 0, F.col(f"{k}_tp") / (F.col(f"{k}_tp") + F.col(f"{k}_fn"))).alias(f"{k}_recall")
    return got.select("*", p("matching"), r("matching"), p("all"), r("all"))


def _gram_stats(roles: DataFrame, threshold: int) -> DataFrame:
    names = ["correct", "del", "subst_fp", "subst_fn", "ins"]
    got = roles.groupBy("utt_id", "gram").agg(*[F.count_if(F.col("role") == r).alias(r) for r in names])
    c, d, fp, fn, i = (F.col(x) for x in names)
    kept = got.where(c + d + fp + fn + i >= threshold)
    # As percentages; 0 where nothing was heard or said.
    return kept.withColumns({"precision": F.when(c + i + fp > 0, c / (c + i + fp) * 100).otherwise(0.0), "recall": F.when(c + d + fn > 0, c / (c + d + fn) * 100).otherwise(0.0)})


def unigram_stats(stitches: DataFrame, threshold: int = 0) -> DataFrame:
    """Per word: correct, deleted, substituted (as heard, as said), inserted; precision and recall in percent."""
    op = F.col("op")
    roles = F.array_compact(
        F.array(
            F.when(op == "cor", F.struct(F.col("ref_tok").alias("gram"), F.lit("correct").alias("role"))),
            F.when(op == "del", F.struct(F.col("ref_tok").alias("gram"), F.lit("del").alias("role"))),
            F.when(op == "ins", F.struct(F.col("hyp_tok").alias("gram"), F.lit("ins").alias("role"))),
            F.when(op == "sub", F.struct(F.col("ref_tok").alias("gram"), F.lit("subst_fn").alias("role"))),
            F.when(op == "sub", F.struct(F.col("hyp_tok").alias("gram"), F.lit("subst_fp").alias("role"))),
        )
    )
    return _gram_stats(stitches.select("utt_id", F.explode(roles).alias("x")).select("utt_id", "x.*"), threshold)


def bigrams(stitches: DataFrame) -> DataFrame:
    """``utt_id, seq, ref_gram, hyp_gram``: neighbouring words of both sides."""
    # A neighbour is the next row: numbers without holes make it an equi-join with the row itself.
    told = running(_rows(stitches), "utt_id", "seq", sums={"_n": F.lit(1)}).select("utt_id", "seq", "_n", "ref_tok", "hyp_tok")
    after = told.select("utt_id", (F.col("_n") - 1).alias("_n"), F.col("ref_tok").alias("_r"), F.col("hyp_tok").alias("_h"))
    return told.join(after, ["utt_id", "_n"]).select("utt_id", "seq", F.concat_ws(" ", "ref_tok", "_r").alias("ref_gram"), F.concat_ws(" ", "hyp_tok", "_h").alias("hyp_gram"))


def bigram_stats(stitches: DataFrame, threshold: int = 0) -> DataFrame:
    """As ``unigram_stats`` for pairs of neighbours; only pairs of real words on one side have a row."""
    r, h = F.col("ref_gram"), F.col("hyp_gram")
    one = lambda gram, role, when: F.when(when & is_countable_ngram(gram), F.struct(gram.alias("gram"), F.lit(role).alias("role")))
    differ = (r != h) & is_countable_ngram(r) & is_countable_ngram(h)
    roles = F.array_compact(
        F.array(
            one(r, "correct", r == h),
            one(r, "subst_fn", differ),
            one(h, "subst_fp", differ),
            one(r, "del", (r != h) & h.contains(DEL)),
            one(h, "ins", (r != h) & r.contains(INS)),
            # A pair without a role still has a row.
            one(r, "seen", F.lit(True)),
            one(h, "seen", F.lit(True)),
        )
    )
    return _gram_stats(bigrams(stitches).select("utt_id", F.explode(roles).alias("x")).select("utt_id", "x.*"), threshold)


def ranked(stats: DataFrame) -> DataFrame:
    """N-gram statistics by rising precision, recall and text, with their place per utterance."""
    order = Window.partitionBy("utt_id").orderBy("precision", "recall", "gram")
    return stats.withColumn("place", F.row_number().over(order))


def error_groups(stitches: DataFrame) -> DataFrame:
    """``utt_id, line_no, ref, hyp``: maximal stretches of errors with the line of the report they begin on."""
    rows = running(_rows(stitches).where(F.col("ref_tok") != NOOP), "utt_id", "seq", sums={"_n": F.lit(1)}).withColumns({"line_no": F.col("_n").cast("long") + 1, "_block": F.floor(F.col("_n") / 4096).cast("long"), "_err": F.when(F.col("ref_tok") != F.col("hyp_tok"), 1)})
    runs = stitched_runs(rows.repartition("utt_id", "_block"), "utt_id", "line_no", "_err").select("utt_id", F.col("first_pos").alias("_from"), F.col("last_pos").alias("_to"))
    each = runs.select("utt_id", "_from", F.explode(F.sequence("_from", "_to")).alias("line_no"))
    side = lambda c: F.filter(F.transform(F.sort_array(F.collect_list(F.struct("line_no", c))), lambda x: x[c]), lambda w: ~w.isin("<ins>", "<del>", "<sub>", ""))
    words = each.join(rows.where(F.col("_err") == 1).select("utt_id", "line_no", "ref_tok", "hyp_tok"), ["utt_id", "line_no"])
    got = words.groupBy("utt_id", "_from").agg(side("ref_tok").alias("r"), side("hyp_tok").alias("h"))
    return got.select("utt_id", F.col("_from").alias("line_no"), F.array_join("r", " ").alias("ref"), F.array_join("h", " ").alias("hyp"))
