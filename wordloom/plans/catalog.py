"""Queries over the given tables for the operators of transcript comparison, with SQL that checks them.

The tables hold no pairs of transcripts, so the hypothesis of a recording or document is its
reference with errors injected by arithmetic on places, which SQL repeats.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import tokens as fn
from wordloom.functions.synth import inject_errors, synthetic_pairs
from wordloom.operators import graphs, metrics, nested, stitches as st
from wordloom.operators.blocks import running
from wordloom.plans import wer as plan
from wordloom.session import table
from wordloom.sinks import reports


def _number(recording: Column) -> Column:
    """A number of the recording for the injected errors."""
    return F.coalesce(F.regexp_extract(recording, "([0-9]+)", 1).try_cast("long"), F.lit(0))


_COLUMNS = ("token", "speaker", "ts", "end_ts", "punctuation", "prepunctuation", "casing", "labels", "best_label", "wer_tags", "confidence")


def token_rows(spark: SparkSession, sf_dir: str, cols: tuple[str, ...] = _COLUMNS) -> DataFrame:
    """Token rows as references: ``utt_id, pos`` and the row's columns, copies once; what is not in ``cols`` is not shuffled."""
    rows = table(spark, sf_dir, "nlp_tokens").where(F.col("recording").isNotNull() & F.col("pos").isNotNull())
    one = rows.groupBy("recording", "pos").agg(F.min_by(F.struct(*cols), "row_id").alias("r"))
    return one.select(F.col("recording").alias("utt_id"), "pos", "r.*")


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stitches of token rows with injected errors and the fields that breakdowns need."""
    r = token_rows(spark, sf_dir)
    text = F.coalesce("token", F.lit(""))
    label = F.trim(F.coalesce("best_label", F.lit("")))
    ready = r.select("utt_id", "pos", F.lower(text).alias("token"), text.alias("_row_token"), "speaker", "punctuation", "casing", "wer_tags", label.alias("_label"))
    out = inject_errors(ready, _number(F.col("utt_id")))
    said = F.col("op") != "ins"
    only = lambda c: F.when(said, F.trim(F.coalesce(c, F.lit(""))))
    # A heard word keeps the case of the row at even places and is in capitals elsewhere.
    heard = F.when(F.col("op") == "cor", F.when(F.col("pos") % 2 == 0, F.col("_row_token")).otherwise(F.upper("_row_token"))).otherwise(F.col("hyp_tok"))
    return out.select(
        "utt_id", "seq", "pos", "span", "ref_tok", "hyp_tok", "op",
        F.when(F.col("_label") != "", fn.class_marker(F.col("_label"))).otherwise("global").alias("class_label"),
        only("speaker").alias("speaker"), only("punctuation").alias("punctuation"), only("casing").alias("casing"),
        F.when(said, F.col("_row_token")).alias("nlp_token"), heard.alias("hyp_orig"),
        F.when(said, fn.tag_ids(F.col("wer_tags"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


_ROWS = "rows_ AS (SELECT * FROM nlp_tokens WHERE recording IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording, pos ORDER BY row_id) = 1)"
_STITCHES = f"""{_ROWS},
base AS (SELECT recording AS utt_id, pos, lower(coalesce(token, '')) AS t, coalesce(token, '') AS row_token, trim(coalesce(speaker, ''), ' ') AS sp, trim(coalesce(punctuation, ''), ' ') AS pu,
  trim(coalesce(casing, ''), ' ') AS ca, trim(coalesce(best_label, ''), ' ') AS la, wer_tags,
  (pos * 31 + coalesce(try_cast(nullif(regexp_extract(recording, '([0-9]+)', 1), '') AS BIGINT), 0) * 17) % 100 AS r FROM rows_),
st AS (
  SELECT utt_id, pos * 2 AS seq, pos, t AS ref_tok, CASE WHEN r < 10 THEN '<del>' WHEN r < 20 THEN 'sub' || pos ELSE t END AS hyp_tok, CASE WHEN r < 10 THEN 'del' WHEN r < 20 THEN 'sub' ELSE 'cor' END AS op,
    CASE WHEN la <> '' THEN '___' || replace(la, ':', '_') || '___' ELSE 'global' END AS class_label, sp AS speaker, pu AS punctuation, ca AS casing, row_token AS nlp_token,
    CASE WHEN r < 10 THEN '<del>' WHEN r < 20 THEN 'sub' || pos WHEN pos % 2 = 0 THEN row_token ELSE upper(row_token) END AS hyp_orig, coalesce(regexp_extract_all(wer_tags, '''([^'']*)''', 1), []) AS tags FROM base
  UNION ALL
  SELECT utt_id, pos * 2 + 1, pos, '<ins>', 'ins' || pos, 'ins', CASE WHEN la <> '' THEN '___' || replace(la, ':', '_') || '___' ELSE 'global' END, NULL, NULL, NULL, NULL, 'ins' || pos, [] FROM base WHERE r >= 20 AND r < 30)"""
_COUNTS = "count(*) FILTER (op = 'ins') AS ins, count(*) FILTER (op = 'del') AS del, count(*) FILTER (op = 'sub') AS sub"
_RATED = "ins, del, sub, n_ref, ins + del + sub AS errors, CASE WHEN n_ref > 0 THEN (ins + del + sub) / n_ref WHEN ins + del + sub > 0 THEN 'inf'::DOUBLE END AS wer"
_N_REF = "count(*) FILTER (op IN ('cor', 'sub', 'del') AND ref_tok NOT IN ('<eps>', '<del>', '<ins>', '<sub>', '<oov>')) AS n_ref"


def tokenize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(fn.words_of(F.col("text"))).alias("i", "t"))
    return docs.select("doc_id", (F.col("i") + 1).cast("long").alias("pos"), F.lower("t").alias("token"))


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("token")
    rows = table(spark, sf_dir, "nlp_tokens").where(t.isNotNull())
    return rows.select(
        "row_id", fn.lowercase(t).alias("low"), fn.ends_with_any_case(t, "ING").alias("is_ing"), fn.ascii_equal(t, F.lit("The")).alias("is_the"), fn.left_trimmed(t).alias("l"), fn.right_trimmed(t).alias("r"),
        fn.trimmed(t).alias("both"), fn.is_noise_code(t).alias("noise"), fn.trimmed_noise_code(t).alias("noise_code"), fn.upper_count(t).cast("long").alias("uppers"), fn.is_countable_ngram(t).alias("countable"),
        fn.joined(fn.split_on(t, "-"), "+").alias("parts"),
    )


def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nlp_tokens").where(F.col("labels").startswith("['") | F.col("labels").startswith('["'))
    best = fn.best_label(F.col("labels"))
    told = rows.select("row_id", best.alias("best")).where(F.col("best").contains(":"))
    marker = fn.class_marker(F.col("best"))
    return told.select("row_id", "best", fn.label_number(F.col("best")).alias("number"), marker.alias("marker"), fn.label_id(marker).alias("marker_id"), fn.label_name(marker).alias("name"), fn.is_entity_label(marker).alias("entity"), fn.is_synonym_label(marker).alias("synonym"))


def label_functions_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row; ``best`` is empty and the rest null without a label, ``number`` is null without a colon."""
    found = table(spark, sf_dir, "nlp_tokens").select("row_id", fn.cleaned_label(fn.first_label(F.col("labels"))).alias("best"))
    told = found.withColumn("marker", F.when(F.col("best") != "", fn.class_marker(F.col("best"))))
    best, marker = F.col("best"), F.col("marker")
    number = F.when(best.contains(":"), F.substring_index(best, ":", 1))
    return told.select("row_id", "best", number.alias("number"), "marker", fn.label_id(marker).alias("marker_id"), fn.label_name(marker).alias("name"), fn.is_entity_label(marker).alias("entity"), fn.is_synonym_label(marker).alias("synonym"))


def inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir).select("utt_id", "seq", "ref_tok", "hyp_tok", "op")


def wer_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_wer(injected(spark, sf_dir))


def class_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_wer(injected(spark, sf_dir))


def speaker_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.speaker_wer(injected(spark, sf_dir))


def speaker_switch_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.speaker_switch_wer(injected(spark, sf_dir), 5)


def sentence_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sentence_wer(injected(spark, sf_dir))


def tag_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tag_wer(injected(spark, sf_dir))


def case_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.case_stats(injected(spark, sf_dir))


def unigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.unigram_stats(injected(spark, sf_dir), 2)


def bigram_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bigram_stats(injected(spark, sf_dir), 2)


def unigrams_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked(metrics.unigram_stats(injected(spark, sf_dir), 3)).select("utt_id", "gram", "place")


def unigram_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word, as counted without a threshold; ``unigram_stats`` shows the filter."""
    return metrics.unigram_stats(injected(spark, sf_dir))


def bigram_stats_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.bigram_stats(injected(spark, sf_dir))


def unigrams_ranked_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked(unigram_stats_all(spark, sf_dir)).select("utt_id", "gram", "place")


def error_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.error_groups(injected(spark, sf_dir))


def sbs_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sbs_rows(injected(spark, sf_dir).drop("tags"))


def hyp_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed words in order of start; copies count each."""
    rows = table(spark, sf_dir, "ctm_words").where(F.col("recording").isNotNull())
    start = F.when(~F.isnan("start_time_secs"), F.col("start_time_secs"))
    duration = F.when(~F.isnan("duration_secs"), F.col("duration_secs"))
    # Places come from the row's own number, so no recording is sorted in one task.
    return rows.select(F.col("recording").alias("utt_id"), F.col("row_id").alias("pos"), F.coalesce("word", F.lit("")).alias("token"), start.alias("start_ts"), duration.alias("duration"), "confidence")


def stitch_hyp_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = st.with_timings(injected(spark, sf_dir).drop("hyp_orig"), hyp_words(spark, sf_dir))
    return told.select("utt_id", "seq", "hyp_idx", "hyp_orig", F.round("start_ts", 3).alias("start_ts"), F.round("end_ts", 3).alias("end_ts"))


def entity_span_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of equal labels, with their words in order; a span is found in two levels, like any run."""
    rows = token_rows(spark, sf_dir).select("utt_id", "pos", F.nullif(F.trim(F.coalesce("best_label", F.lit(""))), F.lit("")).alias("label"))
    return graphs.entity_spans(rows, "utt_id", "label", "pos").withColumnsRenamed({"first": "first_pos", "last": "last_pos", "n": "n_rows"})


def tag_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "nlp_tokens").select("row_id", "recording", F.posexplode(fn.tag_ids(F.col("wer_tags"))).alias("i", "tag_id"))
    types = table(spark, sf_dir, "wer_sidecar").groupBy("recording", "tag_id").agg(F.min("entity_type").alias("entity_type"))
    out = each.join(types, ["recording", "tag_id"], "left")
    return out.select("row_id", (F.col("i") + 1).cast("long").alias("place"), "tag_id", F.coalesce("entity_type", F.lit("")).alias("entity_type"))


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.parse_rules(table(spark, sf_dir, "synonym_rules"))


def synonym_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rules(spark, sf_dir).select("line_no", F.array_join("lhs", " ").alias("lhs"), F.posexplode("alts").alias("i", "alt")).select("line_no", "lhs", (F.col("i") + 1).cast("long").alias("alt_no"), F.array_join("alt", " ").alias("alt"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.vocabulary(table(spark, sf_dir, "nlp_tokens").select(F.lower("token").alias("token")), table(spark, sf_dir, "ctm_words").select(F.lower("word").alias("token")))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


def cutoff_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.cutoff_rules(_vocabulary(spark, sf_dir)).select(F.col("lhs")[0].alias("cut"), F.col("alts")[0][0].alias("word"))


def compound_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.compound_rules(_vocabulary(spark, sf_dir)).select(F.array_join("lhs", " ").alias("lhs"), F.array_join(F.col("alts")[0], " ").alias("alt"))


def synonym_match_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokenize_text(spark, sf_dir).withColumnRenamed("doc_id", "utt_id")
    return graphs.rule_matches(words, _rules(spark, sf_dir)).select(F.col("utt_id").alias("doc_id"), "pos", F.array_join("lhs", " ").alias("lhs"))


def aligned_nlp_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = st.with_timings(injected(spark, sf_dir).drop("hyp_orig"), hyp_words(spark, sf_dir))
    rows = token_rows(spark, sf_dir).select("utt_id", "pos", F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in st.ROW_COLUMNS]).alias("nlp"))
    joined = told.join(rows, ["utt_id", "pos"], "left").withColumns({"nlp": F.when(F.col("op") != "ins", F.col("nlp")), "suffix": F.lit("")})
    return reports.aligned_rows(joined)


def json_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Ten tables come from the same stitches; they are kept until clearCache.
    return reports.json_log(injected(spark, sf_dir).persist(StorageLevel.MEMORY_AND_DISK), case=True)


def edit_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of 16 places, which SQL can check; ``edit_distance_recordings`` has whole recordings."""
    rows = token_rows(spark, sf_dir).where(F.coalesce("token", F.lit("")) != "").select("utt_id", "pos", F.col("utt_id").alias("recording"), F.lower("token").alias("token"))
    small = rows.withColumn("utt_id", F.concat_ws("#", "recording", F.floor(F.col("pos") / 16).cast("string")))
    return _distances(inject_errors(small, _number(F.col("recording"))))


def edit_distance_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole recordings; ``edit_distance`` has the pieces that SQL can check."""
    rows = token_rows(spark, sf_dir).select("utt_id", "pos", F.lower(F.coalesce("token", F.lit(""))).alias("token")).where(F.col("token") != "")
    return _distances(inject_errors(rows, _number(F.col("utt_id"))))


def _distances(stitched: DataFrame) -> DataFrame:
    side = lambda c, miss: F.transform(F.sort_array(F.collect_list(F.when(F.col("op") != miss, F.struct("seq", c)))), lambda x: x[c])
    return stitched.groupBy("utt_id").agg(fn.token_distance(side("ref_tok", "ins"), side("hyp_tok", "del")).cast("long").alias("distance"))


def align_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents against themselves with injected errors: the aligner's counts and the injected ones."""
    ref = tokenize_text(spark, sf_dir).withColumnRenamed("doc_id", "utt_id")
    made = inject_errors(ref, F.col("utt_id"))
    heard = made.where(F.col("op") != "del").select("utt_id", F.col("seq").alias("pos"), F.col("hyp_tok").alias("token"))
    out = metrics.best_wer(plan.align(ref, heard, options=plan.WerOptions(disable_cutoffs=True, disable_hyphen_ignore=True)))
    known = metrics.best_wer(made).select("utt_id", F.col("errors").alias("injected"))
    return out.join(known, "utt_id").withColumnRenamed("utt_id", "doc_id")


def _normalisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways to say each entity of a recording, from the nested documents."""
    docs = table(spark, sf_dir, "norm_docs")
    words = nested.words(docs).where(F.col("cand_no") > 0).join(docs.select("norm_id", "recording"), "norm_id")
    said = words.groupBy("recording", "norm_id", "label_id", "cand_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("word_no", "word"))), lambda x: x["word"]).alias("w"))
    ways = said.select("recording", "label_id", F.filter("w", lambda x: x != "").alias("w"))
    return ways.groupBy("recording", "label_id").agg(F.array_sort(F.collect_set("w")).alias("candidates"))


def _sides(spark: SparkSession, sf_dir: str, sentences: bool = False, cols: tuple[str, ...] = _COLUMNS) -> tuple[DataFrame, DataFrame]:
    """Token rows as references, and hypothesis words with injected errors; by recording or by sentence.

    A sentence ends with a row of ``.``, ``?`` or ``!``; its ``utt_id`` is the recording and its number.
    Columns of the rows that are not in ``cols`` are blank and not shuffled.
    """
    rows = token_rows(spark, sf_dir, cols).withColumns({c: F.lit("") for c in _COLUMNS if c not in cols}).withColumns({"recording": F.col("utt_id"), "token": F.coalesce("token", F.lit(""))})
    if sentences:
        stop = F.coalesce(F.trim("punctuation").isin(".", "?", "!"), F.lit(False)).cast("long")
        rows = running(rows, "utt_id", "pos", sums={"_stops": stop})
        rows = rows.withColumn("utt_id", F.concat_ws("#", "recording", (F.col("_stops") - stop).cast("string"))).drop("_stops")
    # A row without its best label has the first of its labels.
    own = fn.cleaned_label(F.coalesce("best_label", F.lit("")))
    label = fn.bound(own, lambda best: fn.label_literal(F.when(best != "", best).otherwise(fn.cleaned_label(fn.first_label(F.col("labels"))))))
    ref = rows.select("utt_id", "recording", "pos", *[label.alias("labels") if c == "labels" else F.coalesce(c, F.lit("")).alias(c) for c in st.ROW_COLUMNS])
    made = inject_errors(rows.select("utt_id", "pos", "recording", F.lower("token").alias("token")), _number(F.col("recording")))
    return ref, made.where(F.col("op") != "del").select("utt_id", F.col("seq").alias("pos"), F.col("hyp_tok").alias("token"))


#: What an alignment needs of the token rows, beside their places.
_ALIGNED = ("token", "labels", "best_label")


def _entity_inputs(spark: SparkSession, sf_dir: str, sentences: bool = False, cols: tuple[str, ...] = _COLUMNS) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """References with entities, hypotheses with injected errors, synonyms, and verbalisations."""
    ref, heard = _sides(spark, sf_dir, sentences, cols)
    by_utterance = ref.where(F.col("labels") != "[]").select("utt_id", "recording", fn.label_number(fn.first_label(F.col("labels"))).alias("label_id")).distinct()
    norms = by_utterance.join(_normalisations(spark, sf_dir), ["recording", "label_id"]).select("utt_id", "label_id", "candidates")
    return ref.drop("recording"), heard, _rules(spark, sf_dir), norms


_PLAIN = plan.WerOptions(disable_cutoffs=True, disable_hyphen_ignore=True)


def align_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of the alignment of each sentence's plain words."""
    ref, heard = _sides(spark, sf_dir, True)
    out = plan.align(ref.select("utt_id", "pos", "token"), heard, options=_PLAIN)
    return out.select("utt_id", "seq", "ref_tok", "hyp_tok", "op", "ref_row")


def align_sentence_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least rate of each sentence over all its verbalisations and synonyms."""
    return metrics.best_wer(plan.align(*_entity_inputs(spark, sf_dir, True))).select("utt_id", "wer")


def align_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain words of whole recordings."""
    ref = token_rows(spark, sf_dir, ("token",)).withColumn("token", F.coalesce("token", F.lit("")))
    made = inject_errors(ref.select("utt_id", "pos", F.lower("token").alias("token")), _number(F.col("utt_id")))
    heard = made.where(F.col("op") != "del").select("utt_id", F.col("seq").alias("pos"), F.col("hyp_tok").alias("token"))
    return metrics.best_wer(plan.align(ref, heard, options=_PLAIN))


def align_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole recordings with their entities and synonyms."""
    return metrics.best_wer(plan.align(*_entity_inputs(spark, sf_dir, cols=_ALIGNED)))


def align_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``align_entities`` by the greedy approach, with its beam and its quick look ahead, a result for each sentence."""
    return metrics.best_wer(plan.align(*_entity_inputs(spark, sf_dir, True), plan.WerOptions(composition_approach="adapted")))


def align_entity_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_wer(plan.align(*_entity_inputs(spark, sf_dir, cols=_ALIGNED)))


def align_entity_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.wer(*_entity_inputs(spark, sf_dir)).aligned()


def oracle_lattice_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattices that offer each word and a wrong one: the right path has no error but for what the lattice lacks."""
    rows = token_rows(spark, sf_dir, ("token",)).select("utt_id", "pos", F.lower(F.coalesce("token", F.lit(""))).alias("token"))
    order = running(rows, "utt_id", "pos", sums={"n": F.lit(1)})
    lost = F.pmod(F.col("pos") * 31 + _number(F.col("utt_id")) * 17, F.lit(100)) < 10
    state = F.col("n").cast("long")
    arcs = order.select("utt_id", state.alias("n"), F.explode(F.filter(F.array(F.when(~lost, F.col("token")), F.concat(F.lit("x"), F.col("pos").cast("string"))), lambda t: t.isNotNull())).alias("token"))
    arcs = arcs.select("utt_id", F.col("n").alias("line_no"), (F.col("n") - 1).alias("src"), F.col("n").alias("dst"), "token", F.lit(False).alias("final"))
    ends = order.groupBy("utt_id").agg(F.max(state).alias("src")).select("utt_id", (F.col("src") + 1).alias("line_no"), "src", F.lit(None).cast("long").alias("dst"), F.lit(None).cast("string").alias("token"), F.lit(True).alias("final"))
    return plan.oracle_wer(rows, arcs.unionByName(ends)).select("utt_id", "n_ref", "errors")


def synthetic_wer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_wer(synthetic_pairs(spark, 200, 1_000)[1])


_BOTH_SIDES = "rate AS (SELECT *, CASE WHEN correct + ins + subst_fp > 0 THEN correct / (correct + ins + subst_fp) * 100 ELSE 0.0 END AS precision, CASE WHEN correct + del + subst_fn > 0 THEN correct / (correct + del + subst_fn) * 100 ELSE 0.0 END AS recall FROM c)"
_UNIGRAMS = """roles AS (
  SELECT utt_id, ref_tok AS gram, CASE op WHEN 'cor' THEN 'correct' WHEN 'del' THEN 'del' ELSE 'subst_fn' END AS role FROM st WHERE op <> 'ins'
  UNION ALL SELECT utt_id, hyp_tok, CASE op WHEN 'ins' THEN 'ins' ELSE 'subst_fp' END FROM st WHERE op IN ('ins', 'sub')),"""
_GRAM_COUNTS = "c AS (SELECT utt_id, gram, count(*) FILTER (role = 'correct') AS correct, count(*) FILTER (role = 'del') AS del, count(*) FILTER (role = 'subst_fp') AS subst_fp, count(*) FILTER (role = 'subst_fn') AS subst_fn, count(*) FILTER (role = 'ins') AS ins FROM roles GROUP BY ALL HAVING count(*) FILTER (role <> 'seen') >= {})"
_WHO = "w AS (SELECT *, last_value(nullif(speaker, '') IGNORE NULLS) OVER (PARTITION BY utt_id ORDER BY seq) AS f, last_value(nullif(speaker, '') IGNORE NULLS) OVER (PARTITION BY utt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, first_value(nullif(speaker, '') IGNORE NULLS) OVER (PARTITION BY utt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS a FROM st)"
_VOCABULARY = "v AS (SELECT DISTINCT lower(token) AS token FROM nlp_tokens WHERE token IS NOT NULL UNION SELECT DISTINCT lower(word) FROM ctm_words WHERE word IS NOT NULL)"
_RULES = r"""lines AS (SELECT line_no, string_split(raw_line, '|') AS p FROM synonym_rules WHERE raw_line IS NOT NULL AND NOT regexp_matches(raw_line, '^\s*(#|$)')),
parts AS (SELECT line_no, array_to_string(list_filter(regexp_split_to_array(p[1], '\s+'), lambda x: x <> ''), ' ') AS lhs, string_split(p[2], ';') AS alts FROM lines WHERE len(p) = 2),
rules AS (SELECT * FROM parts WHERE lhs <> '' QUALIFY row_number() OVER (PARTITION BY lhs ORDER BY line_no) = 1)"""
_HEARD = """hyp AS (SELECT recording AS utt_id, row_number() OVER (PARTITION BY recording ORDER BY row_id) - 1 AS hyp_idx, coalesce(word, '') AS hyp_orig,
  coalesce(CASE WHEN NOT isnan(start_time_secs) THEN start_time_secs END, 0.0) AS s, coalesce(CASE WHEN NOT isnan(duration_secs) THEN duration_secs END, 0.0) AS d FROM ctm_words WHERE recording IS NOT NULL),
k AS (SELECT *, CASE WHEN op <> 'del' THEN sum((op <> 'del')::INT) OVER (PARTITION BY utt_id ORDER BY seq) - 1 END AS hyp_idx FROM st)"""

# The nested bodies: wrappers, entities, candidates and words.
NESTED = r"""RECURSIVE b AS (SELECT norm_id, body::JSON AS x FROM norm_docs WHERE json_valid(body)),
w AS (SELECT norm_id, x FROM b UNION ALL SELECT norm_id, m.value FROM w, json_each(x) AS m WHERE json_type(m.value) IN ('OBJECT', 'ARRAY')
  AND (json_type(x) = 'ARRAY' OR (NOT list_has_any(json_keys(x), ['candidates', 'class', 'verbalization', 'probability']) AND NOT regexp_matches(m.key, '^\s*[0-9]+\s*$')))),
e AS (SELECT norm_id, m.key AS label_id, m.value AS x FROM w, json_each(x) AS m WHERE json_type(x) = 'OBJECT' AND regexp_matches(m.key, '^\s*[0-9]+\s*$') AND NOT list_has_any(json_keys(x), ['candidates', 'class', 'verbalization', 'probability'])),
cf AS (SELECT norm_id, label_id, []::UBIGINT[] AS o, json_extract(x, 'candidates') AS x FROM e UNION ALL SELECT norm_id, label_id, list_append(o, m.id), m.value FROM cf, json_each(x) AS m WHERE json_type(x) = 'ARRAY'),
c AS (SELECT norm_id, label_id, row_number() OVER (PARTITION BY norm_id, label_id ORDER BY o) AS cand_no, x FROM cf WHERE json_type(x) NOT IN ('ARRAY', 'NULL')),
vf AS (SELECT norm_id, label_id, cand_no, []::UBIGINT[] AS o, CASE WHEN json_type(x) = 'OBJECT' THEN json_extract(x, 'verbalization') ELSE x END AS x FROM c
  UNION ALL SELECT norm_id, label_id, cand_no, list_append(o, m.id), m.value FROM vf, json_each(x) AS m WHERE json_type(x) = 'ARRAY'),
v AS (SELECT norm_id, label_id, cand_no, row_number() OVER (PARTITION BY norm_id, label_id, cand_no ORDER BY o) AS word_no, x ->> '$' AS word FROM vf WHERE json_type(x) NOT IN ('ARRAY', 'NULL', 'OBJECT'))"""
# Sentences and their words on both sides; the best alignment by rows of the table, a row of the reference at a time.
_SENTENCES = f"""{_STITCHES}, sn AS (SELECT utt_id AS rec, pos, t, la, utt_id || '#' || coalesce(sum((pu IN ('.', '?', '!'))::INT) OVER (PARTITION BY utt_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS utt_id FROM base),
pr AS (SELECT * FROM (SELECT utt_id, any_value(rec) AS rec, list(t ORDER BY pos) AS a FROM sn GROUP BY utt_id) LEFT JOIN (SELECT sn.utt_id, list(hyp_tok ORDER BY seq) AS b FROM st JOIN sn ON st.utt_id = rec AND st.pos = sn.pos WHERE op <> 'del' GROUP BY sn.utt_id) USING (utt_id))"""
_TABLE = """p2 AS (SELECT utt_id, a, coalesce(b, []) AS b FROM pr),
c AS (SELECT utt_id, 0 AS i, j, j * 1001 AS w, repeat('I', j) AS p FROM (SELECT utt_id, unnest(range(len(b) + 1)) AS j FROM p2)
  UNION ALL SELECT utt_id, i, j, x.k + j * 1001, x.p || repeat('I', (j + x.n)) FROM (SELECT utt_id, i, j, min(struct_pack(k := y.w - j * 1001, n := -j, p := y.p)) OVER (PARTITION BY utt_id ORDER BY j) AS x
    FROM (SELECT utt_id, i + 1 AS i, j, least(struct_pack(w := coalesce(lag(w) OVER o + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1000 END, 1000000000), r := 0, p := coalesce(lag(p) OVER o, '') || 'M'), struct_pack(w := w + 1001, r := 1, p := p || 'D')) AS y
      FROM c JOIN p2 USING (utt_id) WHERE i < len(a) WINDOW o AS (PARTITION BY utt_id ORDER BY j)))),
f AS (SELECT utt_id, a, b, p, unnest(range(1, length(p) + 1)) AS seq FROM c JOIN p2 USING (utt_id) WHERE i = len(a) AND j = len(b)),
g AS (SELECT utt_id, seq, substr(p, seq, 1) AS o, length(replace(substr(p, 1, seq), 'I', '')) AS x, length(replace(substr(p, 1, seq), 'D', '')) AS y, a, b FROM f)"""
# The label of each row: its best label, else the first of its labels, as ``cleaned_label`` gives it.
_LABELS = r"""l0 AS (SELECT recording AS utt_id, pos, coalesce(best_label, '') AS x, coalesce(nullif(regexp_extract(labels, '^\s*[\[(]?\s*''((?:[^''\\]|\\.|'''')*)''', 1), ''), nullif(regexp_extract(labels, '^\s*[\[(]?\s*"((?:[^"\\]|\\.|"")*)"', 1), ''), regexp_extract(labels, '^\s*[\[(]?\s*([^''",;|/\t\])]*)', 1), '') AS y FROM rows_),
l1 AS (SELECT utt_id, pos, list_transform([x, y], lambda z: upper(regexp_replace(regexp_replace(regexp_replace(z, '^[\s\x{a0}\x{3000}]+|[\s\x{a0}\x{3000}]+$', '', 'g'), '^0+([0-9])', '\1'), '(?s)^([^:\x{ff1a}\x{fe55}\x{2236}]*?)[\s\x{a0}\x{3000}]*[:\x{ff1a}\x{fe55}\x{2236}][\s\x{a0}\x{3000}]*(.*)$', '\1:\2'))) AS z FROM l0),
lab AS (SELECT utt_id, pos, coalesce(nullif(z[1], ''), z[2]) AS best FROM l1)"""
# The reference graph of each sentence: words, candidates of entities, synonyms; and all its paths.
_GRAPH = r"""lw AS (SELECT s.utt_id, s.rec, s.pos, s.t, row_number() OVER (PARTITION BY s.utt_id ORDER BY s.pos) - 1 AS i, n.best FROM sn s JOIN lab n ON n.utt_id = s.rec AND n.pos = s.pos),
sp AS (SELECT utt_id, rec, best, regexp_extract(best, '^([^:]*):', 1) AS label_id, min(i) AS f, max(i) + 1 AS z, list(t ORDER BY i) AS own FROM (SELECT *, i - row_number() OVER (PARTITION BY utt_id, best ORDER BY i) AS d FROM lw) WHERE best <> '' GROUP BY utt_id, rec, best, d),
cw AS (SELECT norm_id, label_id, cand_no, coalesce(list(lower(word) ORDER BY word_no) FILTER (word <> ''), []) AS w FROM (SELECT * FROM v UNION ALL SELECT norm_id, label_id, cand_no, 0, '' FROM c ANTI JOIN v USING (norm_id, label_id, cand_no)) GROUP BY ALL),
al AS (SELECT utt_id, f, z, own AS w FROM sp UNION SELECT sp.utt_id, f, z, w FROM sp JOIN norm_docs d ON d.recording = sp.rec JOIN cw ON cw.norm_id = d.norm_id AND cw.label_id = sp.label_id),
an AS (SELECT *, row_number() OVER (PARTITION BY utt_id, f ORDER BY w) AS k FROM al),
arc AS (SELECT utt_id, i::VARCHAR AS src, (i + 1)::VARCHAR AS dst, t AS word FROM lw WHERE best = ''
  UNION ALL SELECT utt_id, CASE WHEN q = 1 THEN f::VARCHAR ELSE f || '.' || k || '.' || (q - 1) END, CASE WHEN q = len(w) THEN z::VARCHAR ELSE f || '.' || k || '.' || q END, w[q] FROM (SELECT *, unnest(range(1, len(w) + 1)) AS q FROM an) UNION ALL SELECT utt_id, f::VARCHAR, z::VARCHAR, NULL FROM an WHERE len(w) = 0),
vw AS (SELECT DISTINCT utt_id, unnest(a || coalesce(b, [])) AS w FROM pr),
rs AS (SELECT string_split(lhs, ' ') AS l, list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '') AS r FROM (SELECT lhs, unnest(alts) AS x FROM rules)),
ru AS (SELECT utt_id, [w] AS l, [regexp_replace(w, '-$', '')] AS r FROM vw WHERE regexp_matches(w, '^[^-]+-$') AND w NOT IN (SELECT lhs FROM rules) UNION SELECT utt_id, [w], string_split(w, '-') FROM vw WHERE regexp_matches(w, '^[^-]+(-[^-]+)+$') AND w NOT IN (SELECT lhs FROM rules)
  UNION SELECT utt_id, string_split(w, '-'), [w] FROM vw WHERE regexp_matches(w, '^[^-]+(-[^-]+)+$') AND replace(w, '-', ' ') NOT IN (SELECT lhs FROM rules)),
ma AS (SELECT arc.utt_id, src, dst, l, r, 1 AS n FROM arc JOIN ru ON arc.utt_id = ru.utt_id AND arc.word = l[1] UNION ALL SELECT utt_id, src, dst, l, r, 1 FROM arc JOIN rs ON arc.word = l[1]
  UNION ALL SELECT ma.utt_id, ma.src, arc.dst, l, r, n + (arc.word IS NOT NULL)::INT FROM ma JOIN arc ON arc.utt_id = ma.utt_id AND arc.src = ma.dst WHERE n < len(l) AND (arc.word IS NULL OR arc.word = l[n + 1])),
ed AS (SELECT utt_id, src, dst, CASE WHEN word IS NULL THEN [] ELSE [word] END AS w FROM arc UNION SELECT utt_id, src, dst, r FROM ma WHERE n = len(l)),
pa AS (SELECT utt_id, '0' AS nd, []::VARCHAR[] AS w FROM pr UNION SELECT pa.utt_id, ed.dst, pa.w || ed.w FROM pa JOIN ed ON ed.utt_id = pa.utt_id AND ed.src = pa.nd),
co AS (SELECT utt_id, pa.w, b, list_distinct(list_filter(pa.w, lambda x: list_contains(b, x))) AS k FROM pa JOIN (SELECT utt_id, len(a)::VARCHAR AS nd, coalesce(b, []) AS b FROM pr) USING (utt_id, nd)),
di AS (SELECT utt_id, len(w) AS n, levenshtein(array_to_string(list_transform(w, lambda x: chr(coalesce(35 + list_position(k, x), 33)::INT)), ''), array_to_string(list_transform(b, lambda x: chr(coalesce(35 + list_position(k, x), 34)::INT)), '')) AS e FROM co)"""

QUERIES = {
    "tokenize_text": tokenize_text, "string_functions": string_functions, "label_functions": label_functions, "label_functions_all": label_functions_all, "inject_errors": inject, "wer_best": wer_best, "class_wer": class_wer,
    "speaker_wer": speaker_wer, "speaker_switch_wer": speaker_switch_wer, "sentence_wer": sentence_wer, "tag_wer": tag_wer, "case_stats": case_stats, "unigram_stats": unigram_stats,
    "bigram_stats": bigram_stats, "unigrams_ranked": unigrams_ranked, "unigram_stats_all": unigram_stats_all, "bigram_stats_all": bigram_stats_all,
    "unigrams_ranked_all": unigrams_ranked_all, "error_groups": error_groups, "sbs_lines": sbs_lines, "stitch_hyp_timing": stitch_hyp_timing,
    "entity_span_fusion": entity_span_fusion, "tag_resolution": tag_resolution, "synonym_rules_parse": synonym_rules, "vocabulary_union": vocabulary, "cutoff_synonyms": cutoff_synonyms,
    "compound_synonyms": compound_synonyms, "synonym_match_positions": synonym_match_positions, "aligned_nlp_rows": aligned_nlp_rows, "edit_distance": edit_distance, "edit_distance_recordings": edit_distance_recordings, "json_log": json_log,
    "align_documents": align_documents, "align_sentences": align_sentences, "align_sentence_wer": align_sentence_wer, "align_recordings": align_recordings, "align_entities": align_entities, "align_greedy": align_greedy, "align_entity_classes": align_entity_classes, "align_entity_rows": align_entity_rows,
    "oracle_lattice_wer": oracle_lattice_wer, "synthetic_wer": synthetic_wer,
}

SQL = {
    "synthetic_wer": """WITH d AS (SELECT u.utt_id, (p.pos * 31 + u.utt_id * 17) % 100 AS r FROM (SELECT unnest(range(200)) AS utt_id) u, (SELECT unnest(range(1, 1001)) AS pos) p),
      g AS (SELECT utt_id, count(*) FILTER (r >= 20 AND r < 30) AS ins, count(*) FILTER (r < 10) AS del, count(*) FILTER (r >= 10 AND r < 20) AS sub, count(*) AS n_ref, count(*) FILTER (r >= 20) AS c FROM d GROUP BY utt_id)
      SELECT utt_id, ins, del, sub, n_ref, ins + del + sub AS errors, (ins + del + sub) / n_ref AS wer, c / (c + ins + sub) AS precision, c / (c + del + sub) AS recall FROM g""",
    "align_sentences": f"""WITH RECURSIVE {_SENTENCES}, {_TABLE} SELECT utt_id, seq, CASE o WHEN 'I' THEN '<ins>' ELSE a[x] END AS ref_tok, CASE o WHEN 'D' THEN '<del>' ELSE b[y] END AS hyp_tok,
      CASE o WHEN 'I' THEN 'ins' WHEN 'D' THEN 'del' ELSE CASE WHEN a[x] = b[y] THEN 'cor' ELSE 'sub' END END AS op, CASE WHEN o <> 'I' THEN x - 1 END AS ref_row FROM g""",
    "align_sentence_wer": f"""WITH {NESTED}, {_SENTENCES.replace("pos, t, la", "pos, CASE WHEN regexp_matches(t, '^<[^:>]*:[^>]*>$') THEN '<unk>' ELSE t END AS t, la")}, {_RULES}, {_LABELS}, {_GRAPH}
      SELECT utt_id, min(CASE WHEN n > 0 THEN e / n WHEN e > 0 THEN 'inf'::DOUBLE ELSE 0 END) AS wer FROM di GROUP BY utt_id""",
    "oracle_lattice_wer": f"WITH {_STITCHES} SELECT utt_id, count(*) AS n_ref, count(*) FILTER (r < 10) AS errors FROM base GROUP BY utt_id",
    "tokenize_text": r"WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, lower(unnest(l)) AS token FROM w",
    "string_functions": r"""SELECT row_id, lower(token) AS low, ends_with(lower(token), 'ing') AS is_ing, translate(token, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'the' AS is_the,
      regexp_replace(token, '^\s+', '') AS l, regexp_replace(token, '\s+$', '') AS r, regexp_replace(token, '^\s+|\s+$', '', 'g') AS both, regexp_matches(token, '^<[^>]*>$') AS noise,
      regexp_replace(token, '^(<[^:>]*):[^>]*>$', '\1>') AS noise_code, len(regexp_extract_all(token, '[A-Z]')) AS uppers, NOT regexp_matches(token, '<ins>|<del>|<eps>|___') AS countable,
      array_to_string(CASE WHEN ends_with(token, '-') OR token = '' THEN string_split(token, '-')[:-2] ELSE string_split(token, '-') END, '+') AS parts FROM nlp_tokens WHERE token IS NOT NULL""",
    "label_functions": r"""WITH b AS (SELECT row_id, regexp_extract(labels, '^\s*\[\s*[''"]([^''"]*)[''"]', 1) AS best FROM nlp_tokens WHERE starts_with(labels, '[''') OR starts_with(labels, '["')),
      m AS (SELECT row_id, best, split_part(best, ':', 1) AS number, '___' || replace(best, ':', '_') || '___' AS marker FROM b WHERE contains(best, ':'))
      SELECT *, regexp_extract(marker, '^___([^_]+)', 1) AS marker_id, regexp_extract(marker, '^___[^_]*_(.*)___$', 1) AS name, starts_with(marker, '___') AS entity, starts_with(marker, '___') AND contains(marker, '_SYN_') AS synonym FROM m""",
    "inject_errors": f"WITH {_STITCHES} SELECT utt_id, seq, ref_tok, hyp_tok, op FROM st",
    "wer_best": f"""WITH {_STITCHES}, g AS (SELECT utt_id, {_COUNTS}, {_N_REF} FROM st GROUP BY utt_id), e AS (SELECT *, n_ref - del - sub AS c FROM g)
      SELECT utt_id, ins, del, sub, n_ref, ins + del + sub AS errors, CASE WHEN n_ref > 0 THEN (ins + del + sub) / n_ref WHEN ins + del + sub > 0 THEN 'inf'::DOUBLE ELSE 0.0 END AS wer,
      CASE WHEN c + ins + sub > 0 THEN c / (c + ins + sub) END AS precision, CASE WHEN c + del + sub > 0 THEN c / (c + del + sub) END AS recall FROM e""",
    "class_wer": f"WITH {_STITCHES}, g AS (SELECT utt_id, regexp_extract(class_label, '^___[^_]*_(.*)___$', 1) AS class_name, {_COUNTS}, {_N_REF} FROM st WHERE class_label <> 'global' GROUP BY ALL) SELECT utt_id, class_name, {_RATED} FROM g",
    "speaker_wer": f"WITH {_STITCHES}, {_WHO}, g AS (SELECT utt_id, coalesce(f, a, '') AS speaker_id, {_COUNTS}, count(*) FILTER (speaker <> '') AS n_ref FROM w GROUP BY ALL) SELECT utt_id, speaker_id, {_RATED} FROM g",
    "speaker_switch_wer": f"""WITH {_STITCHES}, {_WHO}, i AS (SELECT *, coalesce(sum((op <> 'ins')::INT) OVER (PARTITION BY utt_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idx, op <> 'ins' AND speaker <> '' AND b IS NOT NULL AND speaker <> b AS sw FROM w),
      x AS (SELECT *, min(CASE WHEN sw THEN idx END) OVER (PARTITION BY utt_id ORDER BY idx RANGE BETWEEN 4 PRECEDING AND 5 FOLLOWING) AS s FROM i),
      g AS (SELECT utt_id, {_COUNTS}, count(*) FILTER (op <> 'ins') AS n_ref FROM x WHERE s IS NOT NULL AND (op <> 'ins' OR idx <> s - 5) GROUP BY utt_id) SELECT utt_id, {_RATED}, 5::BIGINT AS window_size FROM g""",
    "sentence_wer": f"""WITH {_STITCHES}, i AS (SELECT *, coalesce(punctuation IN ('.', '?', '!'), false) AS stop, sum(coalesce(punctuation IN ('.', '?', '!'), false)::INT) OVER (PARTITION BY utt_id ORDER BY seq) AS upto FROM st),
      g AS (SELECT utt_id, (upto - stop::INT)::BIGINT AS sentence, {_COUNTS}, count(*) FILTER (op <> 'ins') AS n_ref, bool_or(stop) AS closed FROM i GROUP BY ALL) SELECT utt_id, sentence, {_RATED} FROM g WHERE closed OR n_ref > 0""",
    "tag_wer": f"WITH {_STITCHES}, t AS (SELECT utt_id, op, unnest(tags) AS tag_id FROM st), g AS (SELECT utt_id, tag_id, {_COUNTS}, count(*) FILTER (op <> 'ins') AS n_ref FROM t GROUP BY ALL) SELECT utt_id, tag_id, {_RATED} FROM g",
    "case_stats": f"""WITH {_STITCHES}, u AS (SELECT utt_id, ref_tok = hyp_tok AS same, casing = 'LC' AS low, len(regexp_extract_all(coalesce(nlp_token, ''), '[A-Z]')) AS r, len(regexp_extract_all(coalesce(hyp_orig, ''), '[A-Z]')) AS h FROM st WHERE hyp_tok <> '<del>' AND ref_tok <> '<ins>'),
      v AS (SELECT utt_id, same, CASE WHEN low THEN CASE WHEN h > 0 THEN 'fp' END WHEN r = h THEN 'tp' WHEN r > h THEN 'fn' ELSE 'fp' END AS v FROM u),
      g AS (SELECT utt_id, count(*) FILTER (v = 'tp' AND same) AS matching_tp, count(*) FILTER (v = 'fp' AND same) AS matching_fp, count(*) FILTER (v = 'fn' AND same) AS matching_fn, count(*) FILTER (v = 'tp') AS all_tp, count(*) FILTER (v = 'fp') AS all_fp, count(*) FILTER (v = 'fn') AS all_fn FROM v GROUP BY utt_id)
      SELECT *, CASE WHEN matching_tp + matching_fp > 0 THEN matching_tp / (matching_tp + matching_fp) END AS matching_precision, CASE WHEN matching_tp + matching_fn > 0 THEN matching_tp / (matching_tp + matching_fn) END AS matching_recall,
      CASE WHEN all_tp + all_fp > 0 THEN all_tp / (all_tp + all_fp) END AS all_precision, CASE WHEN all_tp + all_fn > 0 THEN all_tp / (all_tp + all_fn) END AS all_recall FROM g""",
    "unigram_stats": f"WITH {_STITCHES}, {_UNIGRAMS} {_GRAM_COUNTS.format(2)}, {_BOTH_SIDES} SELECT * FROM rate",
    "unigrams_ranked": f"WITH {_STITCHES}, {_UNIGRAMS} {_GRAM_COUNTS.format(3)}, {_BOTH_SIDES} SELECT utt_id, gram, row_number() OVER (PARTITION BY utt_id ORDER BY precision, recall, gram)::INT AS place FROM rate",
    "bigram_stats": f"""WITH {_STITCHES}, n AS (SELECT utt_id, ref_tok || ' ' || lead(ref_tok) OVER p AS r, hyp_tok || ' ' || lead(hyp_tok) OVER p AS h FROM st WINDOW p AS (PARTITION BY utt_id ORDER BY seq)),
      b AS (SELECT *, NOT regexp_matches(r, '<ins>|<del>|<eps>|___') AS rv, NOT regexp_matches(h, '<ins>|<del>|<eps>|___') AS hv FROM n WHERE r IS NOT NULL),
      roles AS (SELECT utt_id, r AS gram, 'correct' AS role FROM b WHERE r = h AND rv UNION ALL SELECT utt_id, r, 'subst_fn' FROM b WHERE r <> h AND rv AND hv UNION ALL SELECT utt_id, h, 'subst_fp' FROM b WHERE r <> h AND rv AND hv
      UNION ALL SELECT utt_id, r, 'del' FROM b WHERE r <> h AND rv AND contains(h, '<del>') UNION ALL SELECT utt_id, h, 'ins' FROM b WHERE r <> h AND hv AND contains(r, '<ins>')), {_GRAM_COUNTS.format(2)}, {_BOTH_SIDES} SELECT * FROM rate""",
    "unigram_stats_all": f"WITH {_STITCHES}, {_UNIGRAMS} {_GRAM_COUNTS.format(0)}, {_BOTH_SIDES} SELECT * FROM rate",
    "unigrams_ranked_all": f"WITH {_STITCHES}, {_UNIGRAMS} {_GRAM_COUNTS.format(0)}, {_BOTH_SIDES} SELECT utt_id, gram, row_number() OVER (PARTITION BY utt_id ORDER BY precision, recall, gram)::INT AS place FROM rate",
    "bigram_stats_all": f"""WITH {_STITCHES}, n AS (SELECT utt_id, ref_tok || ' ' || lead(ref_tok) OVER p AS r, hyp_tok || ' ' || lead(hyp_tok) OVER p AS h FROM st WINDOW p AS (PARTITION BY utt_id ORDER BY seq)),
      b AS (SELECT *, NOT regexp_matches(r, '<ins>|<del>|<eps>|___') AS rv, NOT regexp_matches(h, '<ins>|<del>|<eps>|___') AS hv FROM n WHERE r IS NOT NULL),
      roles AS (SELECT utt_id, r AS gram, 'correct' AS role FROM b WHERE r = h AND rv UNION ALL SELECT utt_id, r, 'subst_fn' FROM b WHERE r <> h AND rv AND hv UNION ALL SELECT utt_id, h, 'subst_fp' FROM b WHERE r <> h AND rv AND hv
      UNION ALL SELECT utt_id, r, 'del' FROM b WHERE r <> h AND rv AND contains(h, '<del>') UNION ALL SELECT utt_id, h, 'ins' FROM b WHERE r <> h AND hv AND contains(r, '<ins>') UNION ALL SELECT utt_id, r, 'seen' FROM b WHERE rv UNION ALL SELECT utt_id, h, 'seen' FROM b WHERE hv), {_GRAM_COUNTS.format(0)}, {_BOTH_SIDES} SELECT * FROM rate""",
    "error_groups": f"""WITH {_STITCHES}, l AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY seq) + 1 AS line_no, ref_tok <> hyp_tok AS err FROM st), d AS (SELECT *, line_no - row_number() OVER (PARTITION BY utt_id ORDER BY seq) AS grp FROM l WHERE err)
      SELECT utt_id, min(line_no) AS line_no, coalesce(string_agg(ref_tok, ' ' ORDER BY line_no) FILTER (ref_tok NOT IN ('<ins>', '<del>', '<sub>', '')), '') AS ref, coalesce(string_agg(hyp_tok, ' ' ORDER BY line_no) FILTER (hyp_tok NOT IN ('<ins>', '<del>', '<sub>', '')), '') AS hyp FROM d GROUP BY utt_id, grp""",
    "sbs_lines": f"""WITH {_STITCHES} SELECT utt_id, row_number() OVER (PARTITION BY utt_id ORDER BY seq) + 1 AS line_no, CASE WHEN length(ref_tok) < 20 THEN lpad(ref_tok, 20, ' ') ELSE ref_tok END || chr(9) || CASE WHEN length(hyp_tok) < 20 THEN rpad(hyp_tok, 20, ' ') ELSE hyp_tok END || chr(9) ||
      CASE WHEN ref_tok <> hyp_tok THEN 'ERR' ELSE '' END || chr(9) || CASE WHEN class_label <> 'global' THEN class_label ELSE '' END || chr(9) AS line FROM st""",
    "stitch_hyp_timing": f"WITH {_STITCHES}, {_HEARD} SELECT utt_id, seq, k.hyp_idx::BIGINT AS hyp_idx, hyp.hyp_orig, round(s, 3) AS start_ts, round(s + d, 3) AS end_ts FROM k LEFT JOIN hyp USING (utt_id, hyp_idx)",
    "entity_span_fusion": f"""WITH {_ROWS}, l AS (SELECT recording AS utt_id, pos, nullif(trim(coalesce(best_label, ''), ' '), '') AS label FROM rows_), n AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY pos) - row_number() OVER (PARTITION BY utt_id, label ORDER BY pos) AS d FROM l)
      SELECT utt_id, label, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_rows FROM n WHERE label IS NOT NULL GROUP BY utt_id, label, d""",
    "tag_resolution": """WITH t AS (SELECT row_id, recording, regexp_extract_all(wer_tags, '''([^'']*)''', 1) AS l FROM nlp_tokens), e AS (SELECT row_id, recording, unnest(range(1, len(l) + 1)) AS place, unnest(l) AS tag_id FROM t),
      s AS (SELECT recording, tag_id, min(entity_type) AS entity_type FROM wer_sidecar GROUP BY ALL) SELECT row_id, place, tag_id, coalesce(entity_type, '') AS entity_type FROM e LEFT JOIN s USING (recording, tag_id)""",
    "synonym_rules_parse": rf"WITH {_RULES}, x AS (SELECT line_no, lhs, unnest(range(1, len(alts) + 1)) AS alt_no, unnest(alts) AS a FROM rules) SELECT line_no, lhs, alt_no, array_to_string(list_filter(regexp_split_to_array(a, '\s+'), lambda y: y <> ''), ' ') AS alt FROM x",
    "vocabulary_union": f"WITH {_VOCABULARY} SELECT token FROM v",
    "cutoff_synonyms": f"WITH {_VOCABULARY} SELECT token AS cut, regexp_replace(token, '-$', '') AS word FROM v WHERE regexp_matches(token, '^[^-]+-$')",
    "compound_synonyms": f"""WITH {_VOCABULARY}, c AS (SELECT token, string_split(token, '-') AS p FROM v WHERE contains(token, '-') AND NOT starts_with(token, '___') AND NOT regexp_matches(token, '^[^-]+-$')), d AS (SELECT token, array_to_string(p, ' ') AS apart FROM c WHERE len(p) > 1 AND NOT list_contains(p, ''))
      SELECT token AS lhs, apart AS alt FROM d UNION ALL SELECT apart, token FROM d""",
    "synonym_match_positions": rf"""WITH {_RULES}, w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL), t AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, lower(unnest(l)) AS token FROM w),
      a AS (SELECT doc_id, pos, token, token || ' ' || lead(token, 1) OVER o AS two, token || ' ' || lead(token, 1) OVER o || ' ' || lead(token, 2) OVER o AS three, token || ' ' || lead(token, 1) OVER o || ' ' || lead(token, 2) OVER o || ' ' || lead(token, 3) OVER o AS four FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
      SELECT doc_id, pos, lhs FROM (SELECT doc_id, pos, unnest([token, two, three, four]) AS lhs FROM a) JOIN rules USING (lhs)""",
    "aligned_nlp_rows": f"""WITH {_STITCHES}, {_HEARD}, j AS (SELECT k.*, s, d FROM k LEFT JOIN hyp USING (utt_id, hyp_idx) WHERE op <> 'ins')
      SELECT j.utt_id, j.seq, array_to_string([CASE WHEN translate(ref_tok, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = translate(coalesce(r.token, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') OR regexp_matches(coalesce(r.token, ''), '^<[^>]*>$') THEN coalesce(r.token, '') ELSE ref_tok END,
      coalesce(r.speaker, ''), CASE WHEN op = 'del' THEN '' ELSE printf('%.4f', coalesce(s, 0.0)) END, CASE WHEN op = 'del' THEN '' ELSE printf('%.4f', coalesce(s + d, 0.0)) END, coalesce(r.punctuation, ''), coalesce(r.prepunctuation, ''), coalesce(r.casing, ''), coalesce(r.labels, ''),
      '[' || array_to_string(list_transform(coalesce(regexp_extract_all(r.wer_tags, '''([^'']*)''', 1), []), lambda x: '''' || x || ''''), ', ') || ']', coalesce(r.ts, ''), coalesce(r.end_ts, ''), CASE op WHEN 'sub' THEN 'sub(' || hyp_tok || ')' WHEN 'del' THEN 'del' ELSE '' END, coalesce(r.confidence, '')], '|') AS line
      FROM j JOIN rows_ r ON r.recording = j.utt_id AND r.pos = j.pos""",
    "edit_distance": f"""WITH {_STITCHES}, q AS (SELECT utt_id || '#' || (pos // 16) AS utt_id, seq, ref_tok, hyp_tok, op FROM st JOIN (SELECT utt_id AS u, pos AS p FROM base WHERE row_token <> '') ON u = utt_id AND p = pos),
      l AS (SELECT utt_id, coalesce(list(ref_tok ORDER BY seq) FILTER (op <> 'ins'), []) AS a, coalesce(list(hyp_tok ORDER BY seq) FILTER (op <> 'del'), []) AS b FROM q GROUP BY utt_id), v AS (SELECT *, list_distinct(a || b) AS v FROM l)
      SELECT utt_id, levenshtein(array_to_string(list_transform(a, lambda x: chr(33 + list_position(v, x)::INT)), ''), array_to_string(list_transform(b, lambda x: chr(33 + list_position(v, x)::INT)), ''))::BIGINT AS distance FROM v""",
}
