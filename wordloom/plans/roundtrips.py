"""Queries for readers, reports, spans on rows, graphs, the quick look ahead, the SQL function and the stream, with SQL that checks them.

What a reader reads is first written from the given tables into the shared folder.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordloom.functions import tokens as fn, udtf
from wordloom.operators import graphs, metrics, nested, prepass, stitches as st
from wordloom.operators.align import graph_of, spread
from wordloom.operators.blocks import running
from wordloom.plans import catalog as c, wer as plan
from wordloom.session import shared_dir, table
from wordloom.sinks import reports
from wordloom.sources import readers
from wordloom.streaming.monitor import stream_wer


def _folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"wordloom-{name}-{uuid.uuid4().hex}")


def _of_path(df: DataFrame) -> DataFrame:
    """Rows of files that ``write_lines`` wrote, with the utterance in place of the path."""
    return df.withColumn("utt_id", F.regexp_extract("utt_id", "utt_id=([^/]+)/", 1))


def _no_bar(column: str) -> Column:
    return F.translate(F.coalesce(F.col(column), F.lit("")), "|\r\n", "/  ")


# --- readers -----------------------------------------------------------------------------

_FILE_COLUMNS = {"token": "token", "speaker": "speaker", "ts": "ts", "endTs": "end_ts", "punctuation": "punctuation", "prepunctuation": "prepunctuation", "case": "casing", "tags": "labels", "wer_tags": "wer_tags", "confidence": "confidence"}


def read_nlp_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token tables of all recordings, written and read again; bars in fields are slashes there."""
    path = _folder(spark, "nlp")
    rows = c.token_rows(spark, sf_dir).select("utt_id", "pos", F.concat_ws("|", *[_no_bar(x) for x in _FILE_COLUMNS.values()]).alias("line"))
    reports.write_lines(rows, path, ["pos"], "|".join(_FILE_COLUMNS))
    return _of_path(readers.read_nlp(spark, path)).select("utt_id", "pos", *_FILE_COLUMNS.values())


def read_ctm_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "ctm")
    rows = c.hyp_words(spark, sf_dir).select("utt_id", "pos", F.format_string("%s 1 %.3f %.3f %s %.2f", "utt_id", F.coalesce("start_ts", F.lit(0.0)), F.coalesce("duration", F.lit(0.0)), F.concat(F.lit("w"), F.translate("token", " \t\r\n", "____")), F.coalesce(F.when(~F.isnan("confidence"), F.col("confidence")), F.lit(0.0))).alias("line"))
    reports.write_lines(rows, path, ["pos"])
    return _of_path(readers.read_ctm(spark, path)).select("utt_id", "pos", "token", "start_ts", "duration", "confidence")


def read_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "text")
    reports.write_lines(c.token_rows(spark, sf_dir).select("utt_id", "pos", F.translate(F.coalesce("token", F.lit("")), "\r\n", "  ").alias("line")), path, ["pos"])
    return _of_path(readers.read_text(spark, path)).select("utt_id", "pos", "token")


def read_lattice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of arcs with symbol ids, and the symbol table, written and read again."""
    path, names = _folder(spark, "fst"), _folder(spark, "symbols")
    rows = c.token_rows(spark, sf_dir).select("utt_id", "pos", F.concat(F.lit("w"), F.translate(F.lower(F.coalesce("token", F.lit(""))), " \t\r\n ", "_____")).alias("w"))
    words = rows.select("w").distinct().withColumn("id", F.xxhash64("w"))
    words.select(F.concat_ws(" ", "w", F.col("id").cast("string"))).write.mode("overwrite").text(names)
    arcs = running(rows, "utt_id", "pos", sums={"n": F.lit(1)}).select("utt_id", "pos", F.concat_ws(" ", (F.col("n") - 1).cast("string"), F.col("n").cast("string"), F.xxhash64("w").cast("string")).alias("line"))
    reports.write_lines(arcs, path, ["pos"])
    read = readers.read_arcs(spark, path, readers.read_symbols(spark, names))
    return _of_path(read).select("utt_id", "src", "dst", "token", "final")


def read_rule_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "rules")
    lines = table(spark, sf_dir, "synonym_rules").select(F.lit("rules").alias("utt_id"), "line_no", F.coalesce("raw_line", F.lit("")).alias("line"))
    reports.write_lines(lines, path, ["line_no"])
    rules = graphs.parse_rules(readers.read_rules(spark, path))
    return rules.select(F.array_join("lhs", " ").alias("lhs"), F.posexplode("alts").alias("i", "alt")).select("lhs", (F.col("i") + 1).cast("long").alias("alt_no"), F.array_join("alt", " ").alias("alt"))


def read_json_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sidecars of tags and normalisation files, one per recording or document, written as JSON and read again."""
    tags, norms = _folder(spark, "tags"), _folder(spark, "norms")
    types = table(spark, sf_dir, "wer_sidecar").where(F.col("recording").isNotNull() & F.col("tag_id").isNotNull()).groupBy("recording", "tag_id").agg(F.min("entity_type").alias("entity_type"))
    side = types.groupBy(F.col("recording").alias("utt_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tag_id", F.struct("entity_type"))))).alias("line"))
    reports.write_lines(side.withColumn("n", F.lit(1)), tags, ["n"])
    flat = nested.flat_tables(table(spark, sf_dir, "norm_docs"))
    words = nested.words(table(spark, sf_dir, "norm_docs")).where(F.col("cand_no") > 0)
    said = words.groupBy("norm_id", "label_id", "cand_no").agg(F.filter(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]), lambda w: w != "").alias("verbalization"))
    ways = said.groupBy("norm_id", "label_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("cand_no", "verbalization"))), lambda x: F.struct(x["verbalization"].alias("verbalization"))).alias("candidates"))
    entities = flat["entities"].select("norm_id", "label_id", "class").join(ways, ["norm_id", "label_id"], "left")
    docs = entities.groupBy(F.col("norm_id").cast("string").alias("utt_id")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label_id", F.struct("class", "candidates"))))).alias("line"))
    reports.write_lines(docs.withColumn("n", F.lit(1)), norms, ["n"])
    one = readers.read_sidecar(spark, tags).select(F.lit("tag").alias("kind"), F.col("tag_id").alias("name"), F.coalesce("entity_type", F.lit("")).alias("value"))
    two = readers.read_normalisations(spark, norms).select(F.lit("norm").alias("kind"), F.col("label_id").alias("name"), F.concat_ws("|", F.coalesce("class", F.lit("")), F.array_join(F.transform(F.coalesce("candidates", F.array().cast("array<array<string>>")), lambda w: F.array_join(w, "+")), "/")).alias("value"))
    return one.unionByName(two).groupBy("kind", "name", "value").agg(F.count(F.lit(1)).alias("n"))


# --- reports -----------------------------------------------------------------------------


def sbs_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole side-by-side report of each recording, with its tags and their types."""
    types = table(spark, sf_dir, "wer_sidecar").where(F.col("recording").isNotNull() & F.col("tag_id").isNotNull()).groupBy(F.col("recording").alias("utt_id"), "tag_id").agg(F.min("entity_type").alias("entity_type"))
    return reports.sbs_report(c.injected(spark, sf_dir), types).select("utt_id", F.col("part").cast("long").alias("part"), "line_no", "line")


def log_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.log_lines(metrics.best_wer(c.injected(spark, sf_dir)))


def json_log_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON of each recording, read again: its rates, and how much its parts hold."""
    rate = "insertions long, deletions long, substitutions long, numWordsInReference long, numErrors long"
    gram = "correct long, insertions long, deletions long, substitutions_fp long, substitutions_fn long"
    kind = f"struct<wer:struct<bestWER:struct<{rate}>,classWER:map<string,struct<{rate}>>,speakerWER:map<string,struct<{rate}>>,sentenceWer:array<struct<{rate}>>,wer_tag:map<string,struct<{rate}>>,unigrams:map<string,struct<{gram}>>,bigrams:map<string,struct<{gram}>>>>".replace(" long", ":bigint").replace(", ", ",")
    told = c.json_log(spark, sf_dir).select("utt_id", F.from_json("json", kind)["wer"].alias("w"))
    total = lambda part, field: F.aggregate(F.map_values(F.col(f"w.{part}")), F.lit(0).cast("bigint"), lambda a, x: a + x[field])
    each = told.select(
        "utt_id", F.col("w.bestWER.numErrors").alias("errors"), F.col("w.bestWER.numWordsInReference").alias("n_ref"), total("speakerWER", "numErrors").alias("speaker_errors"),
        F.aggregate("w.sentenceWer", F.lit(0).cast("bigint"), lambda a, x: a + x["numWordsInReference"]).alias("sentence_words"), F.size("w.sentenceWer").cast("long").alias("sentences"),
        F.size("w.unigrams").cast("long").alias("unigrams"), total("unigrams", "correct").alias("correct"), total("unigrams", "substitutions_fp").alias("subst_fp"), F.size("w.bigrams").cast("long").alias("bigrams"),
    )
    # A long recording has several parts, with a share of the keys each.
    return each.groupBy("utt_id").agg(*[F.sum(c).alias(c) for c in each.columns if c != "utt_id"])


# --- alignment's parts -------------------------------------------------------------------


def spans_on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of entity spans on the rows of the span: as many, one more, one, or twice as many, by turns."""
    rows = st.numbered(c.token_rows(spark, sf_dir).withColumn("_label", F.nullif(F.trim(F.coalesce("best_label", F.lit(""))), F.lit(""))))
    spans = graphs.entity_spans(rows, "utt_id", "_label").select("utt_id", "first", F.col("n").cast("long").alias("r"))
    w = F.element_at(F.array(F.col("r"), F.col("r") + 1, F.lit(1).cast("long"), F.col("r") * 2), (F.pmod("first", F.lit(4)) + 1).cast("int"))
    inside = spans.select("utt_id", (F.col("first") + 1).alias("span"), F.col("first").alias("span_row"), F.col("r").alias("span_rows"), F.explode(F.sequence(F.lit(0).cast("long"), w - 1)).alias("k"))
    inside = inside.select("utt_id", (F.col("span_row") * 1000 + F.col("k")).alias("seq"), "span", F.lit(None).cast("long").alias("ref_row"), "span_row", "span_rows")
    none = F.lit(None).cast("long")
    outside = rows.where(F.col("_label").isNull()).select("utt_id", (F.col("idx") * 1000).alias("seq"), none.alias("span"), F.col("idx").alias("ref_row"), none.alias("span_row"), none.alias("span_rows"))
    stitched = inside.unionByName(outside).withColumns({"op": F.lit("cor"), "ref_tok": F.lit("w"), "hyp_tok": F.lit("w")})
    told = st.with_rows(stitched, rows.drop("_label", "idx"))
    return told.select("utt_id", "seq", F.coalesce("nlp.token", F.lit("")).alias("token"), *[F.coalesce(f"nlp.{x}", F.lit("")).alias(x) for x in ("speaker", "ts", "punctuation", "prepunctuation", "casing", "labels")], "suffix")


def punctuated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows with a row for each mark behind a word, which has nothing but its speaker."""
    rows = c.token_rows(spark, sf_dir).withColumns({"token": F.coalesce("token", F.lit("")), "speaker": F.coalesce("speaker", F.lit(""))})
    return plan.normalised(rows, plan.WerOptions(use_punctuation=True)).select("utt_id", "pos", "token", "row_token", "speaker", "punctuation")


def sanity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stitches joined with hypothesis words of which some were changed: each of those is told."""
    made = c.injected(spark, sf_dir)
    heard = made.where(F.col("op") != "del").select("utt_id", F.col("seq").alias("pos"), F.when(F.col("pos") % 50 == 7, F.concat("hyp_tok", F.lit("!"))).otherwise(F.col("hyp_tok")).alias("token"))
    return st.out_of_step(st.with_timings(made.drop("hyp_orig"), heard))


def graph_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arcs of each sentence's reference graph: its printed lines, those with words, and those within spans."""
    ref, heard, rules, norms = c._entity_inputs(spark, sf_dir, True)
    pairs, static = plan.pairs_of(ref, heard, rules, norms, plan.WerOptions())
    common = {tuple(lhs): alts for lhs, alts in static}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for utt_id, said, spans, own in zip(pdf["utt_id"], pdf["ref"], pdf["spans"], pdf["rules"], strict=True):
                listed = [s | {"candidates": [list(x) for x in s["candidates"]] if s["candidates"] is not None else None} for s in spans] if spans is not None else None
                table_ = {tuple(r["lhs"]): [list(a) for a in r["alts"]] for r in own} if own is not None else {}
                graph = graph_of(list(said) if said is not None else [], listed, table_ | common)
                out.append((utt_id, len(graph.lines(1 << 30)), sum(a.word is not None for a in graph.arcs), sum(a.span >= 0 for a in graph.arcs)))
            yield pd.DataFrame(out, columns=["utt_id", "arcs", "words", "in_spans"])

    return spread(pairs.select("utt_id", "ref", "spans", "rules")).mapInPandas(run, "utt_id string, arcs long, words long, in_spans long")


def _sentence_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ref, heard = c._sides(spark, sf_dir, True)
    return plan.pairs_of(ref.select("utt_id", "pos", "token"), heard, None, None, c._PLAIN)[0].select("utt_id", *[F.coalesce(x, F.array().cast("array<string>")).alias(x) for x in ("ref", "hyp")])


def match_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quick look at each sentence: its distance, the words it matched on both sides, and whether a long row of mismatches stands before a match."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for utt_id, a, b in zip(pdf["utt_id"], pdf["ref"], pdf["hyp"], strict=True):
                errors, left, right = prepass.match_maps(list(a), list(b))
                out.append((utt_id, errors, left.count(1), right.count(1), prepass.has_error_streak(right, 3)))
            yield pd.DataFrame(out, columns=["utt_id", "distance", "ref_matched", "hyp_matched", "streak"])

    return spread(_sentence_pairs(spark, sf_dir)).mapInPandas(run, "utt_id string, distance long, ref_matched long, hyp_matched long, streak boolean")


def wer_align_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of operations of each sentence by the table function of SQL."""
    udtf.register(spark)
    _sentence_pairs(spark, sf_dir).createOrReplaceTempView("wordloom_sentence_pairs")
    return spark.sql("SELECT p.utt_id, t.op, count(*) AS n FROM wordloom_sentence_pairs p, LATERAL wer_align(p.ref, p.hyp) t GROUP BY p.utt_id, t.op")


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates by hour of a stream of sentences, each at the hour of its number; the stream runs until its source is read."""
    source, sink = _folder(spark, "pairs"), _folder(spark, "rates")
    number = F.regexp_extract("utt_id", "#([0-9]+)$", 1).cast("long")
    at = F.timestamp_seconds(F.lit(1_700_000_000 // 3600 * 3600) + (number % 48) * 3600)
    _sentence_pairs(spark, sf_dir).withColumn("at", at).write.parquet(source)
    schema = "utt_id string, ref array<string>, hyp array<string>, at timestamp"
    rates = stream_wer(spark.readStream.schema(schema).parquet(source), "1 hour", "1000 days")

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(sink)

    rates.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", _folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select(F.unix_timestamp("window.start").alias("hour"), "ins", "del", "sub", "n_ref")


QUERIES = {
    f.__name__: f
    for f in (read_nlp_files, read_ctm_files, read_text_files, read_lattice_files, read_rule_file, read_json_files, sbs_report, log_summary, json_log_read, spans_on_rows, punctuated_words, sanity_checks, graph_sizes, match_maps, wer_align_function, stream_rates)
}

_CELL = "regexp_replace(translate(coalesce({}, ''), chr(124) || chr(13) || chr(10), '/  '), '^[ \\t]+|[ \\t]+$', '', 'g') AS {}"
_CELLS = ", ".join(_CELL.format(x, x) for x in _FILE_COLUMNS.values())
_TYPES = "ty AS (SELECT recording AS utt_id, tag_id, coalesce(min(entity_type), '') AS entity_type FROM wer_sidecar WHERE recording IS NOT NULL AND tag_id IS NOT NULL GROUP BY ALL)"

SQL = {
    "read_nlp_files": f"WITH {c._ROWS} SELECT recording AS utt_id, row_number() OVER (PARTITION BY recording ORDER BY pos) AS pos, {_CELLS} FROM rows_ QUALIFY true",
    "read_ctm_files": r"""SELECT recording AS utt_id, row_number() OVER (PARTITION BY recording ORDER BY row_id) AS pos, 'w' || translate(coalesce(word, ''), ' ' || chr(9) || chr(13) || chr(10), '____') AS token,
      printf('%.3f', coalesce(CASE WHEN NOT isnan(start_time_secs) THEN start_time_secs END, 0.0))::DOUBLE AS start_ts, printf('%.3f', coalesce(CASE WHEN NOT isnan(duration_secs) THEN duration_secs END, 0.0))::DOUBLE AS duration,
      printf('%.2f', coalesce(CASE WHEN NOT isnan(confidence) THEN confidence END, 0.0))::DOUBLE AS confidence FROM ctm_words WHERE recording IS NOT NULL""",
    "read_text_files": rf"""WITH {c._ROWS}, w AS (SELECT recording AS utt_id, pos, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS token FROM (SELECT recording, pos, list_filter(regexp_split_to_array(coalesce(token, ''), '\s+'), lambda x: x <> '') AS l FROM rows_))
      SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY pos, i) AS pos, token FROM w""",
    "read_lattice_files": f"""WITH {c._ROWS} SELECT recording AS utt_id, row_number() OVER o - 1 AS src, row_number() OVER o AS dst, 'w' || translate(lower(coalesce(token, '')), ' ' || chr(9) || chr(13) || chr(10) || chr(160), '_____') AS token, false AS final
      FROM rows_ WINDOW o AS (PARTITION BY recording ORDER BY pos)""",
    "read_rule_file": rf"WITH {c._RULES}, x AS (SELECT lhs, unnest(range(1, len(alts) + 1)) AS alt_no, unnest(alts) AS a FROM rules) SELECT lhs, alt_no, array_to_string(list_filter(regexp_split_to_array(a, '\s+'), lambda y: y <> ''), ' ') AS alt FROM x",
    "read_json_files": f"""WITH {c.NESTED}, {_TYPES}, cw AS (SELECT norm_id, label_id, cand_no, coalesce(string_agg(word, '+' ORDER BY word_no) FILTER (word <> ''), '') AS w FROM c LEFT JOIN v USING (norm_id, label_id, cand_no) GROUP BY ALL),
      ew AS (SELECT e.norm_id, e.label_id, any_value(CASE WHEN json_type(e.x, 'class') NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN e.x ->> 'class' END) AS cls, coalesce(string_agg(cw.w, '/' ORDER BY cand_no), '') AS ways FROM e LEFT JOIN cw USING (norm_id, label_id) GROUP BY ALL),
      a AS (SELECT 'tag' AS kind, tag_id AS name, entity_type AS value FROM ty UNION ALL SELECT 'norm', label_id, coalesce(cls, '') || '|' || ways FROM ew) SELECT kind, name, value, count(*) AS n FROM a GROUP BY ALL""",
    "sbs_report": f"""WITH {c._STITCHES}, {_TYPES}, l AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY seq) + 1 AS line_no FROM st),
      tg AS (SELECT utt_id, line_no, string_agg('###' || tag_id || '_' || coalesce(entity_type, '') || '###|', '' ORDER BY i) AS tags FROM (SELECT utt_id, line_no, unnest(tags) AS tag_id, unnest(range(len(tags))) AS i FROM l) LEFT JOIN ty USING (utt_id, tag_id) GROUP BY ALL),
      d AS (SELECT *, line_no - row_number() OVER (PARTITION BY utt_id ORDER BY seq) AS grp FROM l WHERE ref_tok <> hyp_tok),
      g AS (SELECT utt_id, min(line_no) AS line_no, coalesce(string_agg(ref_tok, ' ' ORDER BY line_no) FILTER (ref_tok NOT IN ('<ins>', '<del>', '<sub>', '')), '') AS r, coalesce(string_agg(hyp_tok, ' ' ORDER BY line_no) FILTER (hyp_tok NOT IN ('<ins>', '<del>', '<sub>', '')), '') AS h FROM d GROUP BY utt_id, grp)
      SELECT utt_id, 1::BIGINT AS part, line_no, CASE WHEN length(ref_tok) < 20 THEN lpad(ref_tok, 20, ' ') ELSE ref_tok END || chr(9) || CASE WHEN length(hyp_tok) < 20 THEN rpad(hyp_tok, 20, ' ') ELSE hyp_tok END || chr(9) || CASE WHEN ref_tok <> hyp_tok THEN 'ERR' ELSE '' END || chr(9) || CASE WHEN class_label <> 'global' THEN class_label ELSE '' END || chr(9) || coalesce(tg.tags, '') AS line FROM l LEFT JOIN tg USING (utt_id, line_no)
      UNION ALL SELECT utt_id, 0, 1, lpad('ref_token', 20, ' ') || chr(9) || rpad('hyp_token', 20, ' ') || chr(9) || 'IsErr' || chr(9) || 'Class' || chr(9) || 'Wer_Tag_Entities' FROM (SELECT DISTINCT utt_id FROM st)
      UNION ALL SELECT utt_id, 2, 0, repeat('-', 60) FROM (SELECT DISTINCT utt_id FROM st) UNION ALL SELECT utt_id, 2, 1, lpad('Line', 20, ' ') || chr(9) || rpad('Group', 20, ' ') FROM (SELECT DISTINCT utt_id FROM st)
      UNION ALL SELECT utt_id, 3, line_no, lpad(line_no::VARCHAR, 20, ' ') || chr(9) || CASE WHEN r = '' THEN '*** ' ELSE r || ' ' END || '<->' || CASE WHEN h = '' THEN ' ***' ELSE ' ' || h END FROM g""",
    "log_summary": f"""WITH {c._STITCHES}, g AS (SELECT utt_id, {c._COUNTS}, {c._N_REF} FROM st GROUP BY utt_id)
      SELECT utt_id, printf('WER: %d/%d = %s (INS:%d DEL:%d SUB:%d)', ins + del + sub, n_ref, CASE WHEN n_ref > 0 THEN printf('%.4f', (ins + del + sub) / n_ref + 1e-12) WHEN ins + del + sub > 0 THEN 'Infinity' ELSE '0.0000' END, ins, del, sub) AS line FROM g""",
    "json_log_read": f"""WITH {c._STITCHES}, {c._UNIGRAMS} u AS (SELECT utt_id, count(DISTINCT gram) AS unigrams, count(*) FILTER (role = 'correct') AS correct, count(*) FILTER (role = 'subst_fp') AS subst_fp FROM roles GROUP BY utt_id),
      n AS (SELECT utt_id, ref_tok || ' ' || lead(ref_tok) OVER p AS r, hyp_tok || ' ' || lead(hyp_tok) OVER p AS h FROM st WINDOW p AS (PARTITION BY utt_id ORDER BY seq)),
      bi AS (SELECT utt_id, count(DISTINCT x) AS bigrams FROM (SELECT utt_id, unnest([r, h]) AS x FROM n WHERE r IS NOT NULL) WHERE NOT regexp_matches(x, '<ins>|<del>|<eps>|___') GROUP BY utt_id),
      s AS (SELECT utt_id, count(*) AS sentences, sum(n_ref)::BIGINT AS sentence_words FROM (SELECT utt_id, upto - stop::INT AS k, count(*) FILTER (op <> 'ins') AS n_ref, bool_or(stop) AS closed FROM (SELECT *, coalesce(punctuation IN ('.', '?', '!'), false) AS stop, sum(coalesce(punctuation IN ('.', '?', '!'), false)::INT) OVER (PARTITION BY utt_id ORDER BY seq) AS upto FROM st) GROUP BY ALL) WHERE closed OR n_ref > 0 GROUP BY utt_id)
      SELECT utt_id, count(*) FILTER (op <> 'cor') AS errors, {c._N_REF}, count(*) FILTER (op <> 'cor') AS speaker_errors, any_value(sentence_words) AS sentence_words, any_value(sentences) AS sentences, any_value(unigrams) AS unigrams, any_value(correct) AS correct, any_value(subst_fp) AS subst_fp, any_value(bigrams) AS bigrams
      FROM st LEFT JOIN u USING (utt_id) LEFT JOIN bi USING (utt_id) LEFT JOIN s USING (utt_id) GROUP BY utt_id""",
    "spans_on_rows": f"""WITH {c._ROWS}, i AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY pos) - 1 AS idx, nullif(trim(coalesce(best_label, ''), ' '), '') AS la FROM rows_),
      sp AS (SELECT recording, min(idx) AS f, count(*) AS r FROM (SELECT *, idx - row_number() OVER (PARTITION BY recording, la ORDER BY idx) AS d FROM i WHERE la IS NOT NULL) GROUP BY recording, la, d),
      w AS (SELECT *, CASE f % 4 WHEN 0 THEN r WHEN 1 THEN r + 1 WHEN 2 THEN 1 ELSE r * 2 END AS w FROM sp), k AS (SELECT *, unnest(range(w)) AS k FROM w),
      t AS (SELECT *, CASE WHEN r = 1 AND w = 1 THEN '' WHEN r = w THEN ',direct' WHEN r = 1 THEN ',push_last' ELSE ',split_worst' END AS suffix, CASE WHEN r = w THEN f + k WHEN r = 1 OR k = 0 THEN f WHEN k = w - 1 THEN f + r - 1 END AS own FROM k)
      SELECT i.recording AS utt_id, idx * 1000 AS seq, coalesce(token, '') AS token, coalesce(speaker, '') AS speaker, coalesce(ts, '') AS ts, coalesce(punctuation, '') AS punctuation, coalesce(prepunctuation, '') AS prepunctuation, coalesce(casing, '') AS casing, coalesce(labels, '') AS labels, '' AS suffix FROM i WHERE la IS NULL
      UNION ALL SELECT t.recording, f * 1000 + k, coalesce(o.token, ''), coalesce(CASE WHEN own IS NULL THEN h.speaker ELSE o.speaker END, ''), coalesce(o.ts, ''),
        coalesce(CASE WHEN suffix = ',push_last' THEN CASE WHEN k = w - 1 THEN o.punctuation END WHEN suffix = ',split_worst' AND w = 1 THEN z.punctuation ELSE o.punctuation END, ''), coalesce(CASE WHEN suffix <> ',push_last' OR k = w - 1 THEN o.prepunctuation END, ''),
        coalesce(CASE WHEN own IS NULL OR (suffix = ',push_last' AND k > 0) THEN 'LC' ELSE o.casing END, ''), coalesce(CASE WHEN own IS NULL THEN h.labels ELSE o.labels END, ''), suffix
        FROM t LEFT JOIN i o ON o.recording = t.recording AND o.idx = own JOIN i h ON h.recording = t.recording AND h.idx = f JOIN i z ON z.recording = t.recording AND z.idx = f + r - 1""",
    "punctuated_words": f"""WITH {c._ROWS}, t AS (SELECT recording AS utt_id, pos, coalesce(token, '') AS tok, coalesce(speaker, '') AS speaker, punctuation FROM rows_)
      SELECT utt_id, pos * 2 AS pos, lower(CASE WHEN regexp_matches(tok, '^<[^:>]*:[^>]*>$') THEN '<unk>' ELSE tok END) AS token, tok AS row_token, speaker, punctuation FROM t UNION ALL SELECT utt_id, pos * 2 + 1, lower(punctuation), '', speaker, '' FROM t WHERE punctuation <> ''""",
    "sanity_checks": f"WITH {c._STITCHES} SELECT utt_id, seq, 'heard' AS why FROM st WHERE op <> 'del' AND pos % 50 = 7",
    "graph_sizes": f"""WITH {c.NESTED}, {c._SENTENCES.replace("pos, t, la", "pos, CASE WHEN regexp_matches(t, '^<[^:>]*:[^>]*>$') THEN '<unk>' ELSE t END AS t, la")}, {c._RULES}, {c._LABELS}, {c._GRAPH},
      sy AS (SELECT DISTINCT utt_id, src, dst, r FROM ma WHERE n = len(l)), x AS (SELECT utt_id, count(*) AS arcs, count(word) AS words, 0 AS ins FROM arc GROUP BY utt_id UNION ALL SELECT utt_id, 1 + greatest(len(r), 1), len(r), 0 FROM sy UNION ALL SELECT utt_id, 0, 0, -count(*) FROM lw WHERE best = '' GROUP BY utt_id)
      SELECT pr.utt_id, coalesce(sum(arcs), 0)::BIGINT AS arcs, coalesce(sum(words), 0)::BIGINT AS words, coalesce(sum(arcs) + sum(ins), 0)::BIGINT AS in_spans FROM pr LEFT JOIN x USING (utt_id) GROUP BY pr.utt_id""",
    "match_maps": f"""WITH RECURSIVE {c._SENTENCES}, {c._TABLE}, m AS (SELECT utt_id, seq, o, o = 'M' AND a[x] = b[y] AS hit FROM g),
      l AS (SELECT utt_id, hit AND NOT coalesce(NOT lag(hit) OVER w AND NOT lead(hit) OVER w, false) AS hit FROM m WHERE o <> 'I' WINDOW w AS (PARTITION BY utt_id ORDER BY seq)),
      r AS (SELECT utt_id, seq, hit AND NOT coalesce(NOT lag(hit) OVER w AND NOT lead(hit) OVER w, false) AS hit FROM m WHERE o <> 'D' WINDOW w AS (PARTITION BY utt_id ORDER BY seq)),
      e AS (SELECT utt_id, bool_or(gap > 4) AS streak FROM (SELECT utt_id, i - coalesce(lag(i) OVER (PARTITION BY utt_id ORDER BY i), 0) AS gap FROM (SELECT utt_id, hit, row_number() OVER (PARTITION BY utt_id ORDER BY seq) AS i FROM r) WHERE hit) GROUP BY utt_id)
      SELECT p2.utt_id, (SELECT count(*) FROM m WHERE m.utt_id = p2.utt_id AND NOT hit) AS distance, (SELECT count(*) FROM l WHERE l.utt_id = p2.utt_id AND hit) AS ref_matched, (SELECT count(*) FROM r WHERE r.utt_id = p2.utt_id AND hit) AS hyp_matched, coalesce(e.streak, false) AS streak FROM p2 LEFT JOIN e USING (utt_id)""",
    "wer_align_function": f"""WITH RECURSIVE {c._SENTENCES}, {c._TABLE} SELECT utt_id, CASE o WHEN 'I' THEN 'ins' WHEN 'D' THEN 'del' ELSE CASE WHEN a[x] = b[y] THEN 'cor' ELSE 'sub' END END AS op, count(*) AS n FROM g GROUP BY ALL""",
    "stream_rates": f"""WITH RECURSIVE {c._SENTENCES}, {c._TABLE}, o AS (SELECT (1700000000 // 3600 + regexp_extract(utt_id, '#([0-9]+)$', 1)::BIGINT % 48) * 3600 AS hour, CASE o WHEN 'I' THEN 'ins' WHEN 'D' THEN 'del' ELSE CASE WHEN a[x] = b[y] THEN 'cor' ELSE 'sub' END END AS op FROM g)
      SELECT hour, count(*) FILTER (op = 'ins') AS ins, count(*) FILTER (op = 'del') AS del, count(*) FILTER (op = 'sub') AS sub, count(*) FILTER (op <> 'ins') AS n_ref FROM o GROUP BY hour""",
}
