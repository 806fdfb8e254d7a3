"""The registered queries of the corpus operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, media, minhash, mixing, phrases, quality, repair, search, suffixes, toxicity, urls
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "word_bpe_49k.json"

#: The rules that op8 judges by: action, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_media_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(table(spark, sf_dir, "documents")))


def op2_toxicity_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.5)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"), size=5)


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(table(spark, sf_dir, "documents"), length=400)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, epochs=2)


def op7_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup(table(spark, sf_dir, "documents"), size=13)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = repair.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return repair.read_ids(spark, path)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op11_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4)


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_media_flac, op2_toxicity_ftrl, op3_jaccard_join, op4_suffix_array, op5_decontaminate, op6_mix_sources, op7_repeated_phrases, op8_url_filter, op9_token_ids, op10_quality_classifier, op11_minhash_join, op12_ranked_search)}

OP6_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (
  SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM per),
levels AS (
  SELECT *, CAST(source_size AS DOUBLE) / w AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY CAST(source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
line AS (SELECT level FROM levels WHERE w * level <= 2 * source_size ORDER BY ratio, source ASC NULLS LAST LIMIT 1),
goal AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM line) IS NULL OR w * (SELECT level FROM line) > 2 * source_size
    THEN CAST(2 * source_size AS DOUBLE) ELSE w * (SELECT level FROM line) END AS target FROM levels),
placed AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_it
  FROM sizes s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(floor(floor(target) / greatest(source_size, 1)) * size
    + greatest(0, least(size, floor(target) - floor(floor(target) / greatest(source_size, 1)) * source_size - before_it)) AS BIGINT) AS taken
FROM placed
"""

OP8_SQL = r"""
WITH RECURSIVE rest AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, html, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(action, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
ruled AS (
  SELECT page_id, host, path, host || path AS node,
    (SELECT h || p FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, action LIMIT 1) AS rule,
    (SELECT action FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, action LIMIT 1) AS action
  FROM parts),
hrefs AS (
  SELECT host, host || path AS u, unnest([
    regexp_extract(regexp_extract(html, '(?i)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*>'), '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(regexp_extract(html, '(?i)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'), '(?i)url\s*=\s*''?([^"''\s>]+)', 1)]) AS href FROM parts),
goals AS (
  SELECT u, CASE WHEN starts_with(href, '//') THEN substr(href, 3) WHEN starts_with(href, '/') THEN host || href WHEN contains(href, '://') THEN substr(href, strpos(href, '://') + 3) END AS r FROM hrefs),
edges AS (
  SELECT u, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS v FROM goals WHERE r IS NOT NULL),
both_ways AS (SELECT u, v FROM edges WHERE u <> '' AND v <> '' AND u <> v UNION SELECT v, u FROM edges WHERE u <> '' AND v <> '' AND u <> v),
reach(a, b) AS (SELECT u, u FROM both_ways UNION SELECT reach.a, both_ways.v FROM reach JOIN both_ways ON reach.b = both_ways.u),
nodes AS (SELECT DISTINCT b AS node, regexp_extract(b, '^[^/]*') AS host, regexp_extract(b, '(?s)^[^/]*(.*)', 1) AS path FROM reach),
node_rules AS (
  SELECT node, (SELECT action FROM rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) ORDER BY length(h || p) DESC, action LIMIT 1) AS action FROM nodes),
inherited AS (SELECT a AS node, min(action) AS action FROM reach JOIN node_rules ON reach.b = node_rules.node WHERE action IS NOT NULL GROUP BY a)
SELECT page_id, host, path, rule, coalesce(ruled.action, inherited.action, 'allow') AS verdict
FROM ruled LEFT JOIN inherited ON ruled.node = inherited.node
"""

OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT r, unnest(CASE WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] || ' ' || ws[k + 3] for k in range(1, len(ws) - 2)] END) AS g
  FROM w WHERE len(ws) > 0),
sets AS (SELECT r, list_sort(list_distinct(list(g))) AS s FROM grams GROUP BY r),
firsts AS (SELECT min(r) AS f, s, len(s) AS n FROM sets GROUP BY s),
elements AS (SELECT f, n, unnest(s) AS g FROM firsts),
overlap AS (
  SELECT a.f AS u, b.f AS v, count(*) AS x FROM elements a JOIN elements b ON a.g = b.g
  WHERE a.f < b.f AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.f, b.f, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT u, v FROM overlap UNION SELECT v, u FROM overlap),
reach(a, b) AS (SELECT f, f FROM firsts UNION SELECT reach.a, edges.v FROM reach JOIN edges ON reach.b = edges.u),
lowest AS (SELECT s, min(w.doc_id) AS d FROM sets JOIN w USING (r) GROUP BY s),
named AS (SELECT reach.a AS f, min(d) AS component_id FROM reach JOIN firsts o ON o.f = reach.b JOIN lowest USING (s) GROUP BY reach.a)
SELECT w.doc_id, CAST(coalesce(len(sets.s), 0) AS BIGINT) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id,
  w.doc_id IS NOT DISTINCT FROM coalesce(component_id, w.doc_id) AS kept
FROM w LEFT JOIN sets USING (r) LEFT JOIN firsts USING (s) LEFT JOIN named USING (f)
"""

OP12_SQL = r"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark)),
wanted AS (
  SELECT item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items),
repeats AS (SELECT item, item_id, term, count(*) AS c FROM wanted GROUP BY ALL),
docs AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
totals AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(len(ts)) AS BIGINT) AS ll FROM docs WHERE len(ts) > 0),
found AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS term FROM docs WHERE len(ts) > 0),
tfs AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM found WHERE term IN (SELECT term FROM repeats) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM dfs, totals),
scored AS (
  SELECT item, item_id, r, doc_id, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM repeats JOIN tfs USING (term) JOIN weights USING (term), totals GROUP BY ALL),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op6_mix_sources": OP6_SQL, "op8_url_filter": OP8_SQL, "op11_minhash_join": OP11_SQL, "op12_ranked_search": OP12_SQL}
