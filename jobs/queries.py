"""The jobs as registered queries: each runs twice into one new shared folder and returns what
stands there after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldlab.session import shared_folder

from . import log_literals, probe_monitor

LITERALS = {"limits.low": -1000.0, "limits.high": 10000.0}
MONITOR = {"limits.low": 0.0, "limits.high": 300.0, "limits.rms": 45.0, "grid.dx": 0.5, "time.dt": 0.0012}


def job1_log_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "job1")
    log_literals.run(spark, f"{sf_dir}/documents.parquet", out, **LITERALS)
    return log_literals.run(spark, f"{sf_dir}/documents.parquet", out, **LITERALS)


def job2_probe_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = shared_folder(spark, "job2")
    source = f"{sf_dir}/{{events.parquet}}"  # a pattern: a file stream takes a single file only by one
    probe_monitor.run(spark, source, f"{at}/out", f"{at}/mark", **MONITOR)
    return probe_monitor.run(spark, source, f"{at}/out", f"{at}/mark", **MONITOR)


JOB1_SQL = r"""
WITH l AS (SELECT doc_id, source, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT *, len([x for x in w if lower(x) IN ('true', 'false', 'yes', 'no')]) AS n_bool,
    len([x for x in w if regexp_full_match(x, '[+-]?[0-9]+')]) AS n_int,
    [CAST(x AS DOUBLE) for x in w if regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')] AS numbers,
    len([x for x in w if regexp_full_match(x, '\[.*\]')]) AS n_array FROM l),
c AS (SELECT *, len(w) AS n_words, len(numbers) - n_int AS n_float, list_min(numbers) AS least, list_max(numbers) AS greatest FROM t)
SELECT doc_id, source, lang, n_words, n_bool, n_int, n_float, n_array, least, greatest,
  CASE WHEN n_words > 0 THEN round((n_bool + n_int + n_float + n_array) / n_words, 6) ELSE 0.0 END AS density,
  coalesce(least >= -1000 AND greatest <= 10000, true) AS in_range,
  CASE WHEN source = '' THEN '_' ELSE coalesce(regexp_replace(source, '[^A-Za-z0-9._-]', '_', 'g'), 'none') END AS origin FROM c
"""

JOB2_SQL = """
WITH d AS (
  SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'none') AS day, coalesce(event_type, 'none') AS field, count(*) AS n, avg(value) AS mean, sqrt(avg(value * value)) AS rms,
    min(value) AS least, max(value) AS greatest, bool_and(value BETWEEN 0 AND 300) AS bounded FROM events GROUP BY 1, 2),
j AS (SELECT *, greatest(abs(least), abs(greatest)) * 0.0012 / 0.5 AS cfl, rms / 45 AS growth FROM d),
c AS (SELECT *, CASE WHEN cfl > 1 THEN 'Unstable' WHEN cfl > 0.8 THEN 'Warning' WHEN NOT bounded THEN 'Unstable' ELSE 'Stable' END AS s FROM j)
SELECT field, n, round(mean, 6) AS mean, round(rms, 6) AS rms, least, greatest,
  CASE WHEN growth > 2 THEN 'Unstable' WHEN growth > 1.6 AND s = 'Stable' THEN 'Warning' ELSE s END AS status, day FROM c
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_log_literals, job2_probe_monitor)}
ORACLE_SQL: dict[str, str] = {"job1_log_literals": JOB1_SQL, "job2_probe_monitor": JOB2_SQL}
