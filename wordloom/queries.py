"""Queries over the given tables, by name, with the SQL that checks them where SQL can.

Each query takes ``(spark, sf_dir)`` and returns a DataFrame over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wordloom.operators import intervals, nested, packed, rejects
from wordloom.plans import catalog, roundtrips
from wordloom.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.unpack(table(spark, sf_dir, "nlp_tokens"), "row_id", ["labels", "wer_tags"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(table(spark, sf_dir, "ctm_lines"))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.strict_load(table(spark, sf_dir, "ctm_lines"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.periods_and_gaps(table(spark, sf_dir, "ctm_words"), "recording", "start_time_secs", "duration_secs").withColumnRenamed("entity", "recording")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.words(table(spark, sf_dir, "norm_docs"))


def p5_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_tables(table(spark, sf_dir, "norm_docs"))["entities"].drop("n_candidates")


def p5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.flat_tables(table(spark, sf_dir, "norm_docs"))["candidates"].drop("n_words")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p2_found, p3_found, p3_loaded, p4_found, p5_found, p5_entities, p5_candidates)} | catalog.QUERIES | roundtrips.QUERIES

_FIELDS = r"""l AS (SELECT line_id, n_columns, regexp_replace(raw_line, '^\s+|\s+$', '', 'g') AS t FROM ctm_lines WHERE raw_line IS NOT NULL),
f AS (SELECT line_id, n_columns, t, length(regexp_replace(t, '[^"]', '', 'g')) % 2 = 0 AS paired, list_transform(regexp_extract_all(t, '(?:"[^"]*"|[^ \t"])+'), lambda x: replace(x, '"', '')) AS f FROM l WHERE t <> ''),
n AS (SELECT *, list_transform(f, lambda x: CASE WHEN regexp_matches(x, '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN try_cast(x AS DOUBLE) END) AS v FROM f),
d AS (SELECT *, CASE WHEN NOT paired THEN 'quoting' WHEN NOT coalesce(n_columns IN (5, 6) AND len(f) = n_columns, false) THEN 'columns' WHEN NOT coalesce(v[3] >= 0 AND isfinite(v[3]), false) THEN 'start'
  WHEN NOT coalesce(v[4] >= 0 AND isfinite(v[4]), false) THEN 'duration' WHEN n_columns = 6 AND NOT coalesce(v[6] >= 0 AND v[6] <= 1, false) THEN 'confidence' END AS reason FROM n)"""

SQL: dict[str, str] = catalog.SQL | roundtrips.SQL | {
    "p2_found": r"""WITH f AS (SELECT row_id, 'labels' AS field, labels AS x FROM nlp_tokens UNION ALL SELECT row_id, 'wer_tags', wer_tags FROM nlp_tokens),
t AS (SELECT row_id, field, regexp_replace(x, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g') AS x FROM f WHERE x IS NOT NULL),
b AS (SELECT row_id, field, CASE WHEN regexp_matches(x, '(?s)^(\[.*\]|\(.*\)|\{.*\})$') THEN x[2:-2] ELSE x END AS x FROM t),
q AS (SELECT row_id, field, CASE WHEN regexp_matches(x, '^\s*[''"]') THEN list_transform(regexp_extract_all(x, '(?s)''(?:[^''\\]|\\.|'''')*''|"(?:[^"\\]|\\.|"")*"'), lambda y: regexp_replace(replace(y[2:-2], repeat(y[1], 2), y[1]), '(?s)\\(.)', '\1', 'g'))
  WHEN regexp_matches(x, '[;|/\t]') THEN regexp_split_to_array(x, '[;|/\t]') WHEN contains(x, ',') THEN string_split(x, ',') ELSE regexp_split_to_array(x, '\s+') END AS l FROM b),
v AS (SELECT row_id, field, list_filter(list_transform(l, lambda y: regexp_replace(y, '^[\s\x{a0}]+|[\s\x{a0}]+$', '', 'g')), lambda y: y <> '') AS l FROM q)
SELECT row_id, field, unnest(range(1, len(l) + 1)) AS idx, unnest(l) AS val FROM v WHERE len(l) > 1""",
    "p5_found": f"""WITH {catalog.NESTED} SELECT * FROM v UNION ALL SELECT norm_id, label_id, cand_no, 0, '' FROM c ANTI JOIN v USING (norm_id, label_id, cand_no)
      UNION ALL SELECT norm_id, label_id, 0, 0, '' FROM e ANTI JOIN c USING (norm_id, label_id)""",
    "p5_entities": f"WITH {catalog.NESTED} SELECT norm_id, label_id, CASE WHEN json_type(x, 'class') NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN x ->> 'class' END AS class FROM e",
    "p5_candidates": f"WITH {catalog.NESTED}, p AS (SELECT norm_id, label_id, cand_no, CASE WHEN json_type(x) = 'OBJECT' AND json_type(x, 'probability') NOT IN ('NULL', 'OBJECT', 'ARRAY') THEN try_cast(x ->> 'probability' AS DOUBLE) END AS p FROM c) SELECT norm_id, label_id, cand_no, CASE WHEN isfinite(p) THEN p END AS probability FROM p",
    "p3_found": f"WITH {_FIELDS} SELECT line_id, reason FROM d WHERE reason IS NOT NULL",
    "p3_loaded": f"WITH {_FIELDS} SELECT line_id, f[1] AS recording, f[2] AS channel, v[3] AS start_time_secs, v[4] AS duration_secs, f[5] AS word, CASE WHEN n_columns = 5 THEN 1.0 ELSE v[6] END AS confidence FROM d WHERE reason IS NULL",
    "p4_found": """WITH i AS (SELECT recording, round(start_time_secs * 1000)::BIGINT AS s, round(start_time_secs * 1000)::BIGINT + round(duration_secs * 1000)::BIGINT AS e FROM ctm_words
  WHERE recording IS NOT NULL AND isfinite(start_time_secs) AND start_time_secs >= 0 AND isfinite(duration_secs) AND duration_secs > 0),
m AS (SELECT *, max(e) OVER (PARTITION BY recording ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
g AS (SELECT *, sum(CASE WHEN s <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY recording ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
p AS (SELECT recording, min(s) AS start_ms, max(e) AS end_ms FROM g GROUP BY recording, k),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY recording ORDER BY start_ms) AS after FROM p)
SELECT recording, 'period' AS piece, start_ms, end_ms FROM n UNION ALL SELECT recording, 'gap', end_ms, after FROM n WHERE after - end_ms > 0 AND after - end_ms < 3600000""",
}
