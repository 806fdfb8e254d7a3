"""URL filters with redirect equivalence, in DataFrame operations only.

A rule (action, host, path) fits its host and all subdomains where the url's path starts
with the rule's; the longest fitting rule decides.  Pages that no rule fits take their
alias group's decision: groups are the connected components over redirect and canonical
links between (host, path) nodes.  Within a group an explicit allow outranks a block, and a
block reaches every other alias; a page's own rule always outranks its group.

Cases: a null url, or one without ``://``, has empty host and path, fits no rule and is
nobody's alias; repeated rows get equal verdicts; an empty table or no edges at all work;
links to urls outside the table still join groups, and rules judge those urls too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

#: Rules are literals of the plan, so there may not be more of them than this.
MAX_RULES = 10_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty where there is none."""
    at = F.locate("://", url)
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest fitting rule, allow before block among equals."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """(u, v) between host+path nodes, from canonical links and refresh redirects in html.

    Absolute targets, ``//host/...`` and ``/path`` are understood; others are no links.
    """
    tag = lambda pattern: F.regexp_extract("html", pattern, 0)
    canonical = F.regexp_extract(tag("(?i)<link\\s[^>]*rel\\s*=\\s*[\"']?canonical[^>]*>"), "(?i)href\\s*=\\s*[\"']?([^\"'\\s>]+)", 1)
    refresh = F.regexp_extract(tag("(?i)<meta\\s[^>]*http-equiv\\s*=\\s*[\"']?refresh[^>]*>"), "(?i)url\\s*=\\s*'?([^\"'\\s>]+)", 1)
    some = pages.where(F.col("html").rlike("(?i)canonical|http-equiv")).select(F.col("url"), F.explode(F.array(canonical, refresh)).alias("to"))
    some = some.where("to <> ''").withColumn("host", host_of(F.col("url")))
    target = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).when(F.col("to").startswith("/"), F.concat(F.lit("x://"), "host", "to")).when(F.col("to").contains("://"), F.col("to"))
    some = some.select((F.concat("host", path_of(F.col("url")))).alias("u"), F.concat(host_of(target), path_of(target)).alias("v"))
    return some.where("u <> '' and v <> '' and u <> v").distinct()


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages(page_id, url, html).

    ``edges`` (u, v), if given, are further redirect pairs of host+path nodes.
    """
    url = F.col("url")
    ruled = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = ruled.withColumn("best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("node", F.concat("host", "path"))
    found = links(pages) if edges is None else links(pages).union(edges.select("u", "v"))
    groups = components(found)
    own = best_rule(F.regexp_extract("node", "^[^/]*", 0), F.regexp_extract("node", "(?s)^[^/]*(.*)", 1), rules)
    decided = groups.select("root", own.getField("action").alias("action")).where("action is not null").groupBy("root").agg(F.min("action").alias("action"))  # 'allow' sorts before 'block'
    inherited = groups.join(decided, "root").select("node", F.col("action").alias("inherited"))
    out = ruled.join(inherited, "node", "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", "inherited", F.lit("allow")).alias("verdict"))
