"""Queries of this subpackage over the given tables, with the SQL that checks them where SQL can."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import bpe, charforms, layouts, mixing, readability, repeats, turns
from wordloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(table(spark, sf_dir, "nlp_tokens")).select("recording", "speaker_no", "first_pos", "last_pos")


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.turn_texts(table(spark, sf_dir, "nlp_tokens"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = charforms.changed(table(spark, sf_dir, "nlp_tokens"), "row_id", "token", "nlp_tokens")
    return tokens.unionByName(charforms.changed(table(spark, sf_dir, "ctm_words"), "row_id", "word", "ctm_words"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.event_runs(table(spark, sf_dir, "nlp_tokens")).select("recording", "first_pos", "last_pos", "n_events")


def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.event_runs(table(spark, sf_dir, "nlp_tokens"), times=True)


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readability.grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "grade_labels")).select("doc_id", "grade")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_turns, p6_found, p7_found, p7_runs, p8_ids, p9_mix, p9_shares, p10_found)}


def _plain(x: str) -> str:
    """SQL for the plain form of a text, by the database's own Unicode functions and the fixed values of ``charforms``."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)).replace("'", "''")
    seen = rf"regexp_replace({x}, '[\p{{Cf}}\x{{FE00}}-\x{{FE0F}}{charforms.UNSEEN}]|[\x{{00}}-\x{{08}}\x{{0E}}-\x{{1B}}\x{{7F}}-\x{{84}}\x{{86}}-\x{{9F}}]', '', 'g')"
    even = f"translate(regexp_replace(translate({seen}, '{charforms.HYPHENS}', '{'-' * len(charforms.HYPHENS)}'), '\\p{{Zs}}', ' ', 'g'), '{wide}', '{narrow}')"
    for c in [*range(0xFB00, 0xFB07), 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), 0x13F, 0x140]:
        even = f"replace({even}, '{chr(c)}', '{unicodedata.normalize('NFKC', chr(c))}')"
    other, latin = "".join(charforms.LOOK_ALIKES), "".join(charforms.LOOK_ALIKES.values())
    words = f"list_transform(string_split(nfc_normalize({even}), ' '), lambda w: CASE WHEN regexp_matches(w, '\\p{{Latin}}') THEN translate(w, '{other}', '{latin}') ELSE w END)"
    return rf"regexp_replace(nfc_normalize(array_to_string({words}, ' ')), '^\s+|\s+$', '', 'g')"


_EVENTS = rf"""e AS (SELECT recording, pos, ts, end_ts, row_id, {_plain("best_label_id")} AS i, {_plain("best_label")} AS l, {_plain("token")} AS t FROM nlp_tokens WHERE recording IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording, pos ORDER BY row_id) = 1),
v AS (SELECT recording, pos, ts, end_ts, coalesce('#' || coalesce(nullif(regexp_extract(i, '^0*([0-9]+)(?:\.0*)?$', 1), ''), nullif(regexp_extract(l, '^0*([0-9]+)\s*:', 1), '')), nullif(lower(regexp_replace(t, '^[^\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{L}}\p{{N}}\p{{M}}]+$', '', 'g')), '')) AS event FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY pos) - row_number() OVER (PARTITION BY recording, event ORDER BY pos) AS run FROM v)"""
_SECONDS = r"""CASE WHEN regexp_matches(x, '^[0-9]+(:[0-9]+){0,2}(\.[0-9]*)?$') THEN list_reduce(list_transform(string_split(x, ':'), lambda y: y::DOUBLE), lambda a, b: a * 60 + b) END"""

def _speaker(x: str) -> str:
    """SQL for the first number of a speaker label, numbers in words among them."""
    for n, word in enumerate(layouts.NUMBER_WORDS):
        x = rf"regexp_replace({x}, '(^|[^\p{{L}}]){word}($|[^\p{{L}}])', '\1{n}\2')"
    return f"try_cast(nullif(regexp_extract({x}, '([0-9]+)', 1), '') AS BIGINT)"


_TIME = r"'(?i)(?:^|[^0-9\p{L}])[0-9]+\s*:\s*TIME(?:[^\p{L}_>]|$)'"
# Words and marks by plain patterns; a mark that the next one closes takes the rows between; speakers are carried forward.
_TURNS = rf"""e AS (SELECT recording, pos, {_speaker(f'lower({_plain("speaker")})')} AS sp, {_plain("token")} AS t, coalesce(regexp_matches(labels, {_TIME}), false) OR coalesce(regexp_matches(best_label, {_TIME}), false) AS timed
  FROM nlp_tokens WHERE recording IS NOT NULL AND pos IS NOT NULL QUALIFY row_number() OVER (PARTITION BY recording, pos ORDER BY row_id) = 1),
f AS (SELECT *, regexp_replace(t, '^["''“”‘’\s]+|["''“”‘’\s.,;:!?…-]+$', '', 'g') AS x, lower(regexp_replace(t, '^[^\p{{L}}\p{{N}}\p{{M}}]+|[^\p{{L}}\p{{N}}\p{{M}}]+$', '', 'g')) AS core FROM e),
r AS (SELECT *, regexp_matches(x, '(?s)^(\[.*\]|\(.*\)|<.*>|\{{.*\}}|\*.*\*)$') AS note, regexp_matches(x, '^\p{{N}}+(:\p{{N}}+){{1,2}}(\.\p{{N}}+)?$') AS clock FROM f),
k AS (SELECT *, coalesce(regexp_matches(t, '[\p{{L}}\p{{N}}]') AND NOT regexp_matches(core, '{turns.HESITATION}') AND NOT note AND NOT (clock AND NOT timed), false) AS word,
  CASE WHEN note OR clock OR NOT regexp_matches(x, '[\p{{L}}\p{{M}}\p{{N}}]') THEN NULL WHEN x[1] IN ('[', '(', '<', '{{') THEN x[1] WHEN x[-1] IN (']', ')', '>', '}}') THEN x[-1] END AS mark, last_value(sp IGNORE NULLS) OVER (PARTITION BY recording ORDER BY pos) AS who FROM r),
m AS (SELECT recording, pos, lead(pos) OVER o AS z, mark || lead(mark) OVER o AS pair FROM k WHERE mark IS NOT NULL WINDOW o AS (PARTITION BY recording ORDER BY pos)),
w AS (SELECT k.recording, k.pos, who, t FROM k ASOF LEFT JOIN (SELECT * FROM m WHERE pair IN ('[]', '()', '<>', '{{}}')) n ON n.recording = k.recording AND n.pos <= k.pos WHERE word AND who IS NOT NULL AND (n.z IS NULL OR n.z < k.pos)),
g AS (SELECT *, sum(new) OVER (PARTITION BY recording ORDER BY pos) AS run FROM (SELECT *, (who IS DISTINCT FROM lag(who) OVER (PARTITION BY recording ORDER BY pos))::INT AS new FROM w))"""

SQL: dict[str, str] = {
    "p1_found": f"WITH {_TURNS} SELECT recording, who AS speaker_no, min(pos) AS first_pos, max(pos) AS last_pos FROM g GROUP BY recording, run, who",
    "p1_turns": f"WITH {_TURNS}, c AS (SELECT *, min(pos) OVER (PARTITION BY recording, run) AS first_pos FROM g) SELECT recording, who AS speaker_no, first_pos, (pos - first_pos) // 256 + 1 AS piece, string_agg(t, ' ' ORDER BY pos) AS text FROM c GROUP BY ALL",
    "p6_found": f"""WITH a AS (SELECT 'nlp_tokens' AS tbl, row_id, token AS x FROM nlp_tokens UNION ALL SELECT 'ctm_words', row_id, word FROM ctm_words), b AS (SELECT tbl, row_id, x, {_plain("x")} AS plain FROM a WHERE x IS NOT NULL)
      SELECT tbl, row_id, plain FROM b WHERE plain <> trim(x, ' ')""",
    "p7_found": f"WITH {_EVENTS} SELECT recording, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_events FROM d WHERE event IS NOT NULL GROUP BY recording, event, run HAVING count(*) > 1",
    "p7_runs": f"""WITH {_EVENTS}, s AS (SELECT recording, event, run, pos, list_transform([ts, end_ts], lambda z: replace(trim(z, ' '), ',', '.')) AS z FROM d WHERE event IS NOT NULL),
      c AS (SELECT recording, event, run, pos, list_transform(z, lambda x: {_SECONDS}) AS z FROM s)
      SELECT recording, event, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_events, min(z[1]) AS start_secs, max(z[2]) AS end_secs, max(z[2]) - min(z[1]) AS duration_secs FROM c GROUP BY recording, event, run HAVING count(*) > 1""",
}
