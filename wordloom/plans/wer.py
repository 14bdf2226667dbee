"""The two plans: error rates of pairs, and hypothesis times on reference rows; and the oracle of a lattice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import tokens as fn
from wordloom.functions.tokens import class_marker, first_label, label_number
from wordloom.operators import graphs, metrics, stitches as st
from wordloom.operators.align import align_pairs, spread
from wordloom.sinks import reports


@dataclass(frozen=True)
class WerOptions:
    """What may be asked of a comparison; the names follow the usual command line.

    ``composition_approach``: ``exact`` and ``standard`` give the least errors per word, and need
    none of what follows; ``adapted`` gives the greedy alignment.  For that, ``numbests`` ends
    the search when so many paths have reached the end, the best of which is taken; ``beam``
    keeps that many states when the search is pruned (none: nothing is given up);
    ``disable_approx_alignment`` leaves out the quick look ahead, which otherwise forbids errors
    on words that it matched, unless the hypothesis has more than
    ``levenstein_max_error_streak`` mismatches in a row.  A ``speaker_switch_context`` of 0 or
    less leaves out the rates at changes of speaker.
    """

    disable_cutoffs: bool = False
    disable_hyphen_ignore: bool = False
    disable_approx_alignment: bool = False
    numbests: int = 100
    levenstein_max_error_streak: int = 100
    pr_threshold: int = 0
    composition_approach: str = "exact"
    speaker_switch_context: int = 5
    record_case_stats: bool = False
    use_punctuation: bool = False
    use_case: bool = False
    add_inserts_nlp: bool = False
    beam: int | None = 20

    def __post_init__(self) -> None:
        if self.composition_approach not in ("exact", "standard", "adapted"):
            raise ValueError(f"unknown composition approach: {self.composition_approach}")


def normalised(tokens: DataFrame, options: WerOptions) -> DataFrame:
    """Tokens in lower case unless case counts, and with punctuation rows if it counts."""
    out = tokens
    if options.use_punctuation and "punctuation" in tokens.columns:
        parts = F.when(F.coalesce(F.col("punctuation"), F.lit("")) != "", F.array(F.col("token"), F.col("punctuation"))).otherwise(F.array("token"))
        rest = [c for c in tokens.columns if c not in ("token", "pos")]
        out = tokens.select("pos", *rest, F.col("token").alias("_orig"), F.posexplode(parts).alias("_i", "token"))
        added = F.col("_i") == 1
        # The row of a mark has nothing but its speaker; marks stay on the row of the word.
        blank = [c for c in ("prepunctuation", "casing", "labels", "wer_tags", "punctuation", "ts", "end_ts") if c in rest]
        out = out.withColumns({c: F.when(added, F.lit("")).otherwise(F.col(c)) for c in blank} | {"row_token": F.when(added, F.lit("")).otherwise(F.col("_orig")), "pos": F.col("pos") * 2 + F.col("_i")}).drop("_i", "_orig")
    else:
        out = out.withColumn("row_token", F.col("token"))
    out = out.withColumn("spoken", F.col("token"))
    if "speaker" in tokens.columns:
        # A noise code with an argument is no known word; its row keeps it.
        out = out.withColumn("token", F.when(F.col("token").rlike(r"^<[^:>]*:[^>]*>$"), fn.UNK).otherwise(F.col("token")))
    return out if options.use_case else out.withColumn("token", F.lower("token"))


def _arrays(tokens: DataFrame, name: str) -> DataFrame:
    """One array of words per utterance, the unit that an alignment needs whole."""
    return tokens.groupBy("utt_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias(name))


def _span_arrays(ref: DataFrame, normalisations: DataFrame | None) -> DataFrame:
    """Entity spans per utterance with their candidates."""
    rows = st.numbered(ref.select("utt_id", "pos", F.nullif(first_label(F.col("labels")), F.lit("")).alias("_label")))
    spans = graphs.entity_spans(rows, "utt_id", "_label").select("utt_id", "first", "last", "_label")
    spans = spans.withColumns({"marker": class_marker(F.col("_label")), "label_id": label_number(F.col("_label"))})
    if normalisations is not None:
        on = ["utt_id", "label_id"] if "utt_id" in normalisations.columns else ["label_id"]
        spans = spans.join(normalisations.select(*on, "candidates").dropDuplicates(on), on, "left")
    else:
        spans = spans.withColumn("candidates", F.lit(None).cast("array<array<string>>"))
    return spans.groupBy("utt_id").agg(F.sort_array(F.collect_list(F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "marker", "candidates"))).alias("spans"))


def pairs_of(ref: DataFrame, hyp: DataFrame, rules: DataFrame | None, normalisations: DataFrame | None, options: WerOptions) -> tuple[DataFrame, list]:
    """Pairs ``utt_id, ref, hyp[, spans][, rules]`` as the aligner takes them, and the static rules."""
    r, h = normalised(ref, options), normalised(hyp, options)
    pairs = _arrays(r, "ref").join(_arrays(h, "hyp"), "utt_id", "full")
    if "labels" in ref.columns:
        lower = F.transform("candidates", lambda c: F.transform(c, F.lower)) if not options.use_case else F.col("candidates")
        norms = None if normalisations is None else normalisations.withColumn("candidates", lower)
        pairs = pairs.join(_span_arrays(r, norms), "utt_id", "left")
    # Rules of cut-off words and compounds come from the pair's own words, inside its row.
    own = _own_rules(options)
    if own is not None:
        pairs = pairs.withColumn("rules", own)
    static: list = []
    if rules is not None:
        found = rules.select("lhs", "alts").take(graphs.MAX_RULES + 1)
        if len(found) > graphs.MAX_RULES:
            raise ValueError(f"more than {graphs.MAX_RULES} rules")
        static = [(list(x.lhs), [list(a) for a in x.alts]) for x in found]
    return pairs, static


def align(ref: DataFrame, hyp: DataFrame, rules: DataFrame | None = None, normalisations: DataFrame | None = None, options: WerOptions | None = None) -> DataFrame:
    """Stitches of all utterances of ``ref`` or ``hyp`` (``utt_id, pos, token``; ``labels`` make entity spans).

    ``rules`` (``lhs, alts``) are static synonyms, ``normalisations`` (``label_id,
    candidates``, perhaps ``utt_id``) the ways to say an entity.
    """
    options = options or WerOptions()
    pairs, static = pairs_of(ref, hyp, rules, normalisations, options)
    greedy = options.composition_approach == "adapted"
    search = {"beam": options.beam, "most": options.numbests, "streak": None if options.disable_approx_alignment else options.levenstein_max_error_streak}
    return align_pairs(pairs, static, greedy, greedy and "duration" not in hyp.columns, search)


def _own_rules(options: WerOptions) -> Column | None:
    words = F.array_distinct(F.concat(F.coalesce("ref", F.array().cast("array<string>")), F.coalesce("hyp", F.array().cast("array<string>"))))
    rule = lambda lhs, alts: F.struct(lhs.alias("lhs"), alts.alias("alts"))
    cut = F.transform(F.filter(words, lambda w: w.rlike("^[^-]+-$")), lambda w: rule(F.array(w), F.array(F.array(F.regexp_replace(w, "-$", "")))))
    whole = F.filter(words, lambda w: w.rlike("^[^-]+(-[^-]+)+$"))
    apart = F.transform(whole, lambda w: rule(F.array(w), F.array(F.split(w, "-"))))
    together = F.transform(whole, lambda w: rule(F.split(w, "-"), F.array(F.array(w))))
    kinds = ([] if options.disable_cutoffs else [cut]) + ([] if options.disable_hyphen_ignore else [apart, together])
    return F.concat(*kinds) if kinds else None


@dataclass(frozen=True)
class WerResult:
    """The tables of a comparison, each computed when it is asked for."""

    stitches: DataFrame
    utterances: DataFrame
    options: WerOptions
    has_rows: bool

    def best(self) -> DataFrame:
        return metrics.best_wer(self.stitches, self.utterances)

    def classes(self) -> DataFrame:
        return metrics.class_wer(self.stitches)

    def speakers(self) -> DataFrame:
        return metrics.speaker_wer(self._told())

    def speaker_switches(self) -> DataFrame:
        return metrics.speaker_switch_wer(self._told(), self.options.speaker_switch_context)

    def sentences(self) -> DataFrame:
        return metrics.sentence_wer(self._told())

    def tags(self) -> DataFrame:
        return metrics.tag_wer(self._told())

    def casing(self) -> DataFrame:
        return metrics.case_stats(self._told())

    def unigrams(self) -> DataFrame:
        return metrics.unigram_stats(self.stitches, self.options.pr_threshold)

    def bigrams(self) -> DataFrame:
        return metrics.bigram_stats(self.stitches, self.options.pr_threshold)

    def side_by_side(self, tag_types: DataFrame | None = None) -> DataFrame:
        return reports.sbs_report(self.stitches, tag_types)

    def aligned(self) -> DataFrame:
        return reports.aligned_rows(self._told(), self.options.add_inserts_nlp)

    def json(self) -> DataFrame:
        return reports.json_log(self.stitches, self.utterances, self.has_rows, self.options.speaker_switch_context, self.options.record_case_stats and self.has_rows, self.options.pr_threshold)

    def _told(self) -> DataFrame:
        if not self.has_rows:
            raise ValueError("this needs a reference with token rows")
        return self.stitches


def wer(ref: DataFrame, hyp: DataFrame, rules: DataFrame | None = None, normalisations: DataFrame | None = None, options: WerOptions | None = None) -> WerResult:
    """Compares hypotheses with references.

    Token rows (a column ``speaker``) allow the breakdowns.  The stitches feed every table:
    persist them (``result.stitches.persist()``) before asking for several.
    """
    options = options or WerOptions()
    out = st.with_timings(align(ref, hyp, rules, normalisations, options), normalised(hyp, options).withColumn("token", F.col("spoken")))
    rows = "speaker" in ref.columns
    if rows:
        told = normalised(ref, options)
        out = st.flat(st.with_rows(out, told.withColumn("token", F.col("row_token"))))
    utterances = ref.select("utt_id").unionByName(hyp.select("utt_id")).distinct()
    return WerResult(out, utterances, options, rows)


def align_times(ref: DataFrame, hyp: DataFrame, rules: DataFrame | None = None, normalisations: DataFrame | None = None, options: WerOptions | None = None) -> WerResult:
    """Hypothesis times on reference rows; both sides need what that takes."""
    if "speaker" not in ref.columns or "start_ts" not in hyp.columns:
        raise ValueError("token rows as reference and timed words as hypothesis are needed")
    return wer(ref, hyp, rules, normalisations, options)


def oracle_wer(ref: DataFrame, arcs: DataFrame, use_case: bool = False) -> DataFrame:
    """``utt_id, ins, del, sub, n_ref, errors``: the least errors over all paths of each word lattice.

    ``arcs``: ``utt_id, line_no, src, dst, token, final``; the first line's state is the start.
    """
    import pandas as pd

    from wordloom.operators.align import counts, oracle_words

    words = _arrays(ref if use_case else ref.withColumn("token", F.lower("token")), "ref")
    token = F.col("token") if use_case else F.lower("token")
    lattices = arcs.groupBy("utt_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "src", "dst", token.alias("token"), "final"))).alias("arcs"))

    def run(batches):
        for pdf in batches:
            out = []
            for utt_id, said, links in zip(pdf["utt_id"], pdf["ref"], pdf["arcs"], strict=True):
                ends = {a["src"] for a in links if a["final"]}
                c = counts(oracle_words(list(said) if said is not None else [], [(a["src"], a["dst"], a["token"]) for a in links if not a["final"]], links[0]["src"], ends))
                out.append((utt_id, c["ins"], c["del"], c["sub"], c["n_ref"], c["ins"] + c["del"] + c["sub"]))
            yield pd.DataFrame(out, columns=["utt_id", "ins", "del", "sub", "n_ref", "errors"])

    kind = ref.schema["utt_id"].dataType.simpleString()
    return spread(lattices.join(words, "utt_id", "left").select("utt_id", "ref", "arcs")).mapInPandas(run, f"utt_id {kind}, ins long, del long, sub long, n_ref long, errors long")
