"""Reports and files from stitches: side by side, aligned token tables, JSON and log lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.tokens import GLOBAL, NOOP, ascii_equal, is_noise_code
from wordloom.operators import metrics, stitches as st
from wordloom.operators.blocks import running

# The header of an aligned token table, and of the side-by-side report.
ALIGNED_HEADER = "token|speaker|ts|endTs|punctuation|prepunctuation|case|tags|wer_tags|oldTs|oldEndTs|ali_comment|confidence"
SBS_HEADER = ("ref_token", "hyp_token", "IsErr", "Class", "Wer_Tag_Entities")


def _padded(left: Column, right: Column) -> Column:
    return F.concat(F.when(F.length(left) < 20, F.lpad(left, 20, " ")).otherwise(left), F.lit("\t"), F.when(F.length(right) < 20, F.rpad(right, 20, " ")).otherwise(right))


def sbs_rows(stitches: DataFrame, tag_types: DataFrame | None = None) -> DataFrame:
    """``utt_id, line_no, line``: a row per stitch, the first being line 2 of its report.

    With ``tags`` in the stitches each word's tags are listed, with their type from
    ``tag_types`` (``tag_id, entity_type`` and, if they differ by utterance, ``utt_id``).
    """
    shown = running(stitches.where((F.col("op") != "empty") & (F.col("ref_tok") != NOOP)), "utt_id", "seq", sums={"_n": F.lit(1)}).withColumn("line_no", F.col("_n").cast("long") + 1)
    shown = shown.withColumns({"_err": F.when(F.col("ref_tok") != F.col("hyp_tok"), "ERR").otherwise(""), "_class": F.when(F.col("class_label") != GLOBAL, F.col("class_label")).otherwise("")})
    if "tags" in stitches.columns:
        each = shown.select("utt_id", "line_no", F.posexplode("tags").alias("_i", "tag_id"))
        if tag_types is not None:
            on = ["utt_id", "tag_id"] if "utt_id" in tag_types.columns else ["tag_id"]
            each = each.join(tag_types.select(*on, "entity_type").dropDuplicates(on), on, "left")
        else:
            each = each.withColumn("entity_type", F.lit(""))
        one = F.concat(F.lit("###"), "tag_id", F.lit("_"), F.coalesce("entity_type", F.lit("")), F.lit("###|"))
        listed = each.groupBy("utt_id", "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_i", one.alias("t")))), lambda x: x["t"]), "").alias("_tags"))
        shown = shown.join(listed, ["utt_id", "line_no"], "left")
    else:
        shown = shown.withColumn("_tags", F.lit(""))
    line = F.concat(_padded(F.col("ref_tok"), F.col("hyp_tok")), F.lit("\t"), "_err", F.lit("\t"), "_class", F.lit("\t"), F.coalesce("_tags", F.lit("")))
    return shown.select("utt_id", "line_no", line.alias("line"))


def sbs_report(stitches: DataFrame, tag_types: DataFrame | None = None) -> DataFrame:
    """``utt_id, part, line_no, line``: the whole report; ordered by part and line it is the file."""
    rows = sbs_rows(stitches, tag_types).select("utt_id", F.lit(1).alias("part"), "line_no", "line")
    # A side without words shows asterisks, with the blank that words have around them.
    ref = F.when(F.col("ref") == "", "*** ").otherwise(F.concat("ref", F.lit(" ")))
    hyp = F.when(F.col("hyp") == "", " ***").otherwise(F.concat(F.lit(" "), "hyp"))
    groups = metrics.error_groups(stitches).select("utt_id", F.lit(3).alias("part"), "line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 20, " "), F.lit("\t"), ref, F.lit("<->"), hyp).alias("line"))
    head = "{:>20}\t{:20}\t{}\t{}\t{}".format(*SBS_HEADER)
    fixed = [(0, 1, head), (2, 0, "-" * 60), (2, 1, "{:>20}\t{:20}".format("Line", "Group"))]
    frame = stitches.select("utt_id").distinct().select("utt_id", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(n).cast("long").alias("line_no"), F.lit(t).alias("line")) for p, n, t in fixed])).alias("x")).select("utt_id", "x.*")
    return rows.unionByName(frame).unionByName(groups)


def aligned_rows(stitches: DataFrame, add_inserts: bool = False) -> DataFrame:
    """``utt_id, seq, line``: the lines of an aligned token table, from stitches with timings and rows.

    Words keep the case of the original row where only ASCII case differs, and noise codes
    stay; deleted words have no times; insertions are left out unless asked for.
    """
    op, nlp = F.col("op"), F.col("nlp")
    token = F.coalesce(nlp["token"], F.lit(""))
    keeps = ascii_equal(F.col("ref_tok"), token) | is_noise_code(token)
    inserted = op == "ins"
    shown = stitches.where((op != "empty") & (op != "noop") & (F.lit(add_inserts) | ~inserted))
    field = lambda c: F.coalesce(nlp[c], F.lit(""))
    time = lambda c: F.when(op == "del", "").otherwise(F.format_string("%.4f", F.coalesce(c, F.lit(0.0))))
    comment = F.when(inserted, F.concat(F.lit("ins("), "hyp_tok", F.lit(")"))).otherwise(F.concat(st.comment(), F.coalesce("suffix", F.lit(""))))
    tags = F.concat(F.lit("["), F.array_join(F.transform(F.regexp_extract_all(field("wer_tags"), F.lit("'([^']*)'"), F.lit(1)), lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    cells = [
        F.when(inserted, "").when(keeps, token).otherwise(F.col("ref_tok")),
        field("speaker"), time(F.col("start_ts")), time(F.col("end_ts")), field("punctuation"), field("prepunctuation"), field("casing"), field("labels"), tags,
        field("ts"), field("end_ts"), comment, field("confidence"),
    ]
    return shown.select("utt_id", "seq", F.concat_ws("|", *cells).alias("line"))


def write_lines(lines: DataFrame, path: str, order: list[str], header: str | None = None) -> None:
    """Writes ``line`` of each utterance, in order, as text files under ``path/utt_id=…``.

    Lines are sorted inside the utterance's partition; nothing is collected.
    """
    out = lines.select("utt_id", *order, "line")
    if header is not None:
        heads = out.select("utt_id").distinct().select("utt_id", *[F.lit(-1).cast(lines.schema[c].dataType).alias(c) for c in order], F.lit(header).alias("line"))
        out = out.unionByName(heads)
    out.repartition("utt_id").sortWithinPartitions("utt_id", *order).select("utt_id", "line").write.mode("overwrite").partitionBy("utt_id").text(path)


_RATE = ["insertions", "deletions", "substitutions", "numWordsInReference", "numErrors", "wer"]


def _rate(*more: Column) -> Column:
    cols = [F.col(a).alias(b) for a, b in zip(["ins", "del", "sub", "n_ref", "errors", "wer"], _RATE, strict=True)]
    return F.struct(*cols, *more)


#: An utterance's JSON is in parts of so many stitches, so that no row holds all words of a long one.
PART = 50_000


def json_log(stitches: DataFrame, utterances: DataFrame | None = None, breakdowns: bool = True, context: int = 5, case: bool = False, threshold: int = 0) -> DataFrame:
    """``utt_id, part, json``: all rates and n-gram statistics of each utterance as JSON.

    Nearly every utterance is one object, of part 0.  A longer one has an object for each ``PART`` of its
    stitches, with a share of the keys each and the sentences in order; ``merged_json`` makes one of them.
    """
    # Only the long ones are listed: at most one for so many stitches.
    long = F.broadcast(stitches.groupBy("utt_id").count().where(F.col("count") > PART).select("utt_id", F.ceil(F.col("count") / PART).cast("long").alias("_parts")))

    def parted(df: DataFrame, part: Column) -> DataFrame:
        return df.join(long, "utt_id", "left").withColumn("part", F.when(F.col("_parts").isNull(), 0).otherwise(part).cast("long"))

    def keyed(df: DataFrame, key: str, name: str, value: Column) -> DataFrame:
        return parted(df, F.pmod(F.xxhash64(key), "_parts")).groupBy("utt_id", "part").agg(F.map_from_entries(F.collect_list(F.struct(F.col(key).alias("k"), value.alias("v")))).alias(name))

    def whole(df: DataFrame, *cols: str | Column) -> DataFrame:
        return df.select("utt_id", F.lit(0).cast("long").alias("part"), *cols)

    gram = F.struct("correct", F.col("ins").alias("insertions"), F.col("del").alias("deletions"), F.col("subst_fp").alias("substitutions_fp"), F.col("subst_fn").alias("substitutions_fn"), "precision", "recall")
    meta = F.create_map().cast("map<string,string>").alias("meta")
    best = metrics.best_wer(stitches, utterances).select("utt_id", _rate(F.col("precision"), F.col("recall"), meta).alias("bestWER"))
    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))
    out = best.join(long, "utt_id", "left").select("utt_id", numbers.alias("part"), "bestWER").withColumn("bestWER", F.when(F.col("part") == 0, F.col("bestWER")))
    parts = [
        keyed(metrics.class_wer(stitches), "class_name", "classWER", _rate(meta)),
        keyed(metrics.unigram_stats(stitches, threshold), "gram", "unigrams", gram),
        keyed(metrics.bigram_stats(stitches, threshold), "gram", "bigrams", gram),
    ]
    if breakdowns:
        each = parted(metrics.sentence_wer(stitches), F.floor(F.col("sentence") / PART))
        sentences = each.groupBy("utt_id", "part").agg(F.sort_array(F.collect_list(F.struct("sentence", _rate().alias("r")))).alias("s"))
        parts += [
            keyed(metrics.speaker_wer(stitches), "speaker_id", "speakerWER", _rate(meta)),
            sentences.select("utt_id", "part", F.transform("s", lambda x: x["r"]).alias("sentenceWer")),
            keyed(metrics.tag_wer(stitches), "tag_id", "wer_tag", _rate(meta)),
        ]
    if breakdowns and context > 0:
        parts.append(whole(metrics.speaker_switch_wer(stitches, context), _rate(F.struct(F.col("window_size").alias("windowSize")).alias("meta")).alias("speakerSwitchWER")))
    if case:
        side = lambda k: F.struct(F.col(f"{k}_precision").alias("precision"), F.col(f"{k}_recall").alias("recall"), F.col(f"{k}_tp").alias("true_positive"), F.col(f"{k}_fp").alias("false_positive"), F.col(f"{k}_fn").alias("false_negative"))
        parts.append(whole(metrics.case_stats(stitches), F.struct(side("matching").alias("matching"), side("all").alias("all")).alias("caseWER")))
    for p in parts:
        out = out.join(p, ["utt_id", "part"], "left")
    names = [c for c in out.columns if c not in ("utt_id", "part")]
    return out.select("utt_id", "part", F.to_json(F.struct(F.struct(*names).alias("wer"))).alias("json"))


def merged_json(parts: list[str]) -> str:
    """One object of the parts of an utterance's JSON, in order; a single part stays as it is."""
    if len(parts) == 1:
        return parts[0]
    out: dict = {}
    for section, held in (x for p in parts for x in json.loads(p)["wer"].items()):
        if section not in out:
            out[section] = held
        elif isinstance(held, list):
            out[section] += held
        else:
            out[section] |= held
    return json.dumps({"wer": out}, ensure_ascii=False, separators=(",", ":"))


def log_lines(best: DataFrame) -> DataFrame:
    """``utt_id, line``: the summary line of each utterance."""
    rate = F.when(F.isnan("wer") | F.col("wer").isNull(), "nan").otherwise(F.format_string("%.4f", "wer"))
    return best.select("utt_id", F.format_string("WER: %d/%d = %s (INS:%d DEL:%d SUB:%d)", "errors", "n_ref", rate, "ins", "del", "sub").alias("line"))
