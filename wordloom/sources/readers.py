"""Readers of transcript files.  Every reader gives one canonical table with explicit positions.

Rows carry ``utt_id`` (the file's path unless one is given) and ``pos`` in the order of the
file, taken from the whole text, since splits of a file have no common row numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.tokens import words_of

# The columns of a token table, by their names in the file.
NLP_COLUMNS = {
    "token": "token", "speaker": "speaker", "ts": "ts", "endTs": "end_ts", "punctuation": "punctuation", "prepunctuation": "prepunctuation",
    "case": "casing", "tags": "labels", "wer_tags": "wer_tags", "oldTs": "old_ts", "oldEndTs": "old_end_ts", "ali_comment": "ali_comment", "confidence": "confidence",
}
NLP_SCHEMA = "utt_id string, pos long, " + ", ".join(f"{c} string" for c in NLP_COLUMNS.values())
HYP_SCHEMA = "utt_id string, pos long, token string, start_ts double, duration double, confidence double"


def _files(spark: SparkSession, path: str, utt_id: str | None) -> DataFrame:
    texts = spark.read.text(path, wholetext=True)
    return texts.select(F.lit(utt_id).alias("utt_id") if utt_id is not None else F.col("_metadata.file_path").alias("utt_id"), F.col("value").alias("_text"))


def _lines(files: DataFrame) -> DataFrame:
    """Lines with their number from 1, without line ends."""
    rows = files.select("utt_id", F.posexplode(F.split(F.regexp_replace("_text", "^﻿", ""), r"\r?\n|\r")).alias("_i", "line"))
    return rows.select("utt_id", (F.col("_i") + 1).cast("long").alias("line_no"), "line")


def read_text(spark: SparkSession, path: str, utt_id: str | None = None) -> DataFrame:
    """``utt_id, pos, token``: words between white space; lines do not matter."""
    return text_tokens(_files(spark, path, utt_id), "_text")


def text_tokens(df: DataFrame, text: str) -> DataFrame:
    """``utt_id, pos, token`` of texts in a column."""
    rows = df.select("utt_id", F.posexplode(words_of(F.col(text))).alias("_i", "token"))
    return rows.select("utt_id", (F.col("_i") + 1).cast("long").alias("pos"), "token")


def read_nlp(spark: SparkSession, path: str, utt_id: str | None = None) -> DataFrame:
    """A token table: parted by bars, columns by name in any order, no quoting; missing columns are empty, others ignored."""
    lines = _lines(_files(spark, path, utt_id))
    cells = F.transform(F.split("line", r"\|"), lambda c: F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""))
    header = lines.where(F.col("line_no") == 1).select("utt_id", cells.alias("_names"))
    # One header per file.
    rows = lines.where((F.col("line_no") > 1) & (F.trim("line") != "")).select("utt_id", "line_no", cells.alias("_cells")).join(header, "utt_id")

    def cell(name: str) -> Column:
        at = F.array_position("_names", name)
        return F.coalesce(F.when(at > 0, F.get("_cells", at.cast("int") - 1)), F.lit(""))

    return rows.select("utt_id", (F.col("line_no") - 1).alias("pos"), *[cell(n).alias(c) for n, c in NLP_COLUMNS.items()])


def read_ctm(spark: SparkSession, path: str, utt_id: str | None = None) -> DataFrame:
    """Timed words of five or six columns; the first line of a file tells how many. Bad times are null."""
    lines = _lines(_files(spark, path, utt_id)).where(F.trim("line") != "").withColumn("_f", F.filter(F.split("line", r"[ \t]+"), lambda c: c != ""))
    wide = lines.groupBy("utt_id").agg((F.min_by(F.size("_f"), "line_no") > 5).alias("_wide"))
    number = lambda i: F.get("_f", F.lit(i)).try_cast("double")
    rows = lines.join(wide, "utt_id")
    return rows.select("utt_id", F.col("line_no").alias("pos"), F.get("_f", F.lit(4)).alias("token"), number(2).alias("start_ts"), number(3).alias("duration"), F.when(F.col("_wide"), number(5)).otherwise(1.0).alias("confidence"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """``symbol, id`` of a symbol table."""
    p = F.filter(F.split("value", r"\s+"), lambda c: c != "")
    return spark.read.text(path).select(p.alias("p")).where(F.size("p") == 2).select(F.col("p")[0].alias("symbol"), F.col("p")[1].try_cast("long").alias("id"))


def read_arcs(spark: SparkSession, path: str, symbols: DataFrame | None = None, utt_id: str | None = None) -> DataFrame:
    """A word lattice as text arcs ``src dst ilabel [olabel [weight]]``; a line of one or two fields ends there.

    ``utt_id, src, dst, token, weight, final``.  With ``symbols`` the labels are ids.
    """
    p = F.filter(F.split("line", r"\s+"), lambda c: c != "")
    rows = _lines(_files(spark, path, utt_id)).select("utt_id", "line_no", p.alias("p")).where(F.size("p") > 0)
    arc = F.size("p") >= 3
    out = rows.select(
        "utt_id",
        "line_no",
        F.get("p", F.lit(0)).try_cast("long").alias("src"),
        F.when(arc, F.get("p", F.lit(1)).try_cast("long")).alias("dst"),
        F.when(arc, F.get("p", F.lit(2))).alias("token"),
        F.coalesce(F.when(arc, F.get("p", F.lit(4)).try_cast("double")), F.lit(0.0)).alias("weight"),
        (~arc).alias("final"),
    )
    if symbols is None:
        return out
    named = out.join(symbols.select(F.col("id").cast("string").alias("token"), "symbol"), "token", "left")
    return named.select("utt_id", "line_no", "src", "dst", F.coalesce("symbol", "token").alias("token"), "weight", "final")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, raw_line`` of a file of synonym rules."""
    return _lines(_files(spark, path, "")).select("line_no", F.col("line").alias("raw_line"))


def read_json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``key, value`` of a JSON object whose members have the type ``value``; a missing file is an error."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("_m"))
    return parsed.select(F.explode("_m").alias("key", "value"))


def read_normalisations(spark: SparkSession, path: str) -> DataFrame:
    """``label_id, class, candidates`` of a normalisation file."""
    rows = read_json_map(spark, path, "struct<candidates:array<struct<probability:double,verbalization:array<string>>>,class:string>")
    return rows.select(F.col("key").alias("label_id"), F.col("value.class").alias("class"), F.transform("value.candidates", lambda c: c["verbalization"]).alias("candidates"))


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """``tag_id, entity_type`` of a sidecar of tags."""
    rows = read_json_map(spark, path, "struct<entity_type:string>")
    return rows.select(F.col("key").alias("tag_id"), F.col("value.entity_type").alias("entity_type"))


def read_transcript(spark: SparkSession, path: str, utt_id: str | None = None, symbols: str | None = None) -> DataFrame:
    """A transcript by the suffix of its path: ``.nlp``, ``.ctm``, ``.fst`` (text arcs, needs ``symbols``), else plain text."""
    low = path.lower()
    if low.endswith(".nlp"):
        return read_nlp(spark, path, utt_id)
    if low.endswith(".ctm"):
        return read_ctm(spark, path, utt_id)
    if low.endswith(".fst"):
        if symbols is None:
            raise ValueError("a lattice needs a symbol table")
        return read_arcs(spark, path, read_symbols(spark, symbols), utt_id)
    return read_text(spark, path, utt_id)
