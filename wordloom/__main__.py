"""Command line: ``python -m wordloom wer|align --ref R --hyp H [...]``."""

from __future__ import annotations

import argparse
import logging
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from wordloom import __version__
from wordloom.operators.graphs import parse_rules
from wordloom.plans.wer import WerOptions, align_times, oracle_wer, wer
from wordloom.session import checkpointed, ship
from wordloom.sinks.reports import ALIGNED_HEADER, log_lines, merged_json
from wordloom.sources import readers

log = logging.getLogger("wordloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wordloom")
    p.add_argument("--version", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("wer", "align"):
        c = sub.add_parser(name)
        c.add_argument("-r", "--ref", required=True)
        c.add_argument("--hyp", required=True)
        c.add_argument("--ref-json")
        c.add_argument("-s", "--syn")
        c.add_argument("--disable-cutoffs", action="store_true")
        c.add_argument("--disable-hyphen-ignore", action="store_true")
        c.add_argument("--disable-approx-alignment", action="store_true")
        c.add_argument("--output-nlp")
        c.add_argument("--output-sbs")
        c.add_argument("--log")
        c.add_argument("--numbests", type=int, default=100)
        c.add_argument("--levenstein-max-error-streak", type=int, default=100)
        c.add_argument("--pr_threshold", type=int, default=0)
        c.add_argument("--beam", type=int, default=20, help="states that the adapted search keeps when it is pruned; 0: nothing is given up")
        c.add_argument("--symbols")
        c.add_argument("--composition-approach", default="adapted", choices=("exact", "standard", "adapted"))
    w = sub.choices["wer"]
    w.add_argument("--wer-sidecar")
    w.add_argument("--speaker-switch-context", type=int, default=5)
    w.add_argument("--json-log")
    w.add_argument("--record-case-stats", action="store_true")
    w.add_argument("--use-punctuation", action="store_true")
    w.add_argument("--use-case", action="store_true")
    w.add_argument("--add-inserts-nlp", action="store_true")
    return p


def _save(lines: DataFrame, order: list[str], path: str, header: str | None = None) -> None:
    """One utterance's lines as one local file."""
    with Path(path).open("w", encoding="utf-8") as f:
        if header is not None:
            f.write(header + "\n")
        for r in lines.orderBy(*order).toLocalIterator():
            f.write(r.line + "\n")


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="[+++] [%(asctime)s] [%(name)s] %(message)s", filename=args.log)
    # Hundreds of tasks would be idle over one pair.
    spark = SparkSession.builder.appName("wordloom").config("spark.sql.shuffle.partitions", "4").getOrCreate()
    ship(spark)
    get = lambda name, default=False: getattr(args, name, default)
    options = WerOptions(
        disable_cutoffs=args.disable_cutoffs, disable_hyphen_ignore=args.disable_hyphen_ignore, disable_approx_alignment=args.disable_approx_alignment, numbests=args.numbests,
        levenstein_max_error_streak=args.levenstein_max_error_streak, pr_threshold=args.pr_threshold, composition_approach=args.composition_approach, speaker_switch_context=get("speaker_switch_context", 5),
        record_case_stats=get("record_case_stats"), use_punctuation=get("use_punctuation"), use_case=get("use_case"), add_inserts_nlp=get("add_inserts_nlp"), beam=args.beam or None,
    )
    ref = readers.read_transcript(spark, args.ref, "pair")
    hyp = readers.read_transcript(spark, args.hyp, "pair", args.symbols)
    if args.hyp.lower().endswith(".fst"):
        r = oracle_wer(ref, hyp, options.use_case).head()
        log.info("WER: %d/%d (INS:%d DEL:%d SUB:%d)", r.errors, r.n_ref, r["ins"], r["del"], r["sub"])
        return 0
    rules = parse_rules(readers.read_rules(spark, args.syn)) if args.syn else None
    norms = readers.read_normalisations(spark, args.ref_json) if args.ref_json else None
    result = (align_times if args.command == "align" else wer)(ref, hyp, rules, norms, options)
    # What follows starts from the stitches; cut from how they came about, its plans stay small.
    result = replace(result, stitches=checkpointed(result.stitches))
    for line in log_lines(result.best()).collect():  # one pair
        log.info(line.line)
    if args.output_nlp:
        if result.has_rows:
            _save(result.aligned(), ["seq"], args.output_nlp, ALIGNED_HEADER)
        else:
            log.warning("aligned rows need a reference with token rows")
    if args.command == "wer":
        if args.output_sbs:
            tags = readers.read_sidecar(spark, args.wer_sidecar) if args.wer_sidecar else None
            _save(result.side_by_side(tags), ["part", "line_no"], args.output_sbs)
        if args.json_log:
            parts = [r.json for r in result.json().orderBy("part").toLocalIterator()]  # one pair
            Path(args.json_log).write_text(merged_json(parts) + "\n", encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
