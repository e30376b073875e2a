"""URL filter: host and path rules, carried to aliases by redirect equivalence.

URLs joined by a canonical link or a refresh redirect are one resource. Their
classes are the connected components of those edges, found by distributed
star contraction; a block rule that fits any URL of a class blocks the class's
URLs that no rule of their own decides. A rule that fits the URL itself always
wins, so an explicit allow is never overturned by a blocked alias, and it
protects only the URLs it fits.

A URL's key in the graph is its lower-cased host, path and query (scheme and
fragment don't tell resources apart). Relative targets are resolved against
the page. Nulls or URLs without ``://`` have empty host and path, fit no rule,
take no part in the graph and are allowed. Repeated rows are judged one by one;
no pages give an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.components import components
from riskweave.llm.scratch import materialize

# (verdict, host, path prefix): the rules of the query's contract
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"
_TAG = r"(?i)<(?:link|meta)\s[^<>]*>?"  # up to the next < or >, so that a page is passed over once
_CANONICAL = r"(?i)^<link\s.*rel\s*=\s*[\"']?canonical[\"'\s>]"
_REFRESH = r"(?i)^<meta\s.*http-equiv\s*=\s*[\"']?refresh[\"'\s]"


def _part(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, group), F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(_part(url, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return _part(url, 2)


def url_key(url: Column) -> Column:
    """Node of the redirect graph; null for what is no absolute URL."""
    return F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), path_of(url), _part(url, 3)))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits, both null if none does.

    Rules are configuration, written into the plan as one CASE from the longest
    on (ties by text, block before allow).
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own_host, own_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2], r[0] == "block")):
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(own_path)
        name = F.when(fits, F.lit(own_host + own_path)).otherwise(name)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _absolute(url: Column, target: Column) -> Column:
    scheme, host, path = F.regexp_extract(url, r"(?s)^(.*?)://", 1), _part(url, 1), _part(url, 2)
    root = F.concat(scheme, F.lit("://"), host)
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(root, target))
            .when(target.startswith("?") | target.startswith("#") | (target == ""), F.concat(root, path, target))
            .otherwise(F.concat(root, F.regexp_replace(F.concat(F.lit("/"), F.ltrim(path, F.lit("/"))), r"[^/]*$", ""), target)))


def redirect_edges(pages: DataFrame) -> DataFrame:
    """(a, b): keys of a page and of what its canonical link or refresh redirect names.

    ``pages`` has url and html; any page without such an element yields none.
    """
    def first(tags: Column, pattern: str) -> Column:
        return F.coalesce(F.get(F.filter(tags, lambda t: t.rlike("(?s)" + pattern)), F.lit(0)), F.lit(""))

    tags = F.regexp_extract_all("html", F.lit(_TAG), F.lit(0))
    href = F.regexp_extract(first(F.col("tags"), _CANONICAL), r"(?is)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", 0)
    goal = F.regexp_extract(first(F.col("tags"), _REFRESH), r"(?is)url\s*=\s*([^\"'>]+)", 1)
    bare = F.regexp_replace(F.regexp_replace(href, r"(?is)^href\s*=\s*", ""), "^[\"']|[\"']$", "")
    found = pages.where(F.contains("url", F.lit("://")) & F.col("html").isNotNull()).withColumn("tags", tags).select(
        "url", F.explode(F.filter(F.array(F.when(href != "", F.trim(bare)), F.when(goal != "", F.trim(goal))),
                                  lambda t: t.isNotNull())).alias("target"))
    decoded = F.replace(F.col("target"), F.lit("&amp;"), F.lit("&"))
    return found.select(url_key(F.col("url")).alias("a"), url_key(_absolute(F.col("url"), decoded)).alias("b"))


def judge(pages: DataFrame, edges: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``pages`` (its columns page_id and url) with host, path, rule, verdict and ``via`` (rule, alias or default).

    ``edges`` (a, b) are pairs of url keys that stand for one resource.
    """
    linked = components(edges, "a", "b")
    host = F.regexp_extract("node", r"(?s)^[^/?]*", 0)
    path = F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1)
    _, verdict = rule_of(host, path, rules)
    marked = linked.select("node", "component", verdict.alias("verdict"))
    blocked = marked.where(F.col("verdict") == "block").select("component").distinct()
    # URLs of a blocked class that no rule of their own decides
    aliases = materialize(marked.where(F.col("verdict").isNull()).join(blocked, "component", "left_semi")
                          .select(F.col("node").alias("_key")), "aliases")
    url = F.col("url")
    own = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), url_key(url).alias("_key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = own.select("*", rule.alias("rule"), verdict.alias("_own"))
    judged = ruled.join(aliases.withColumn("_alias", F.lit(True)), "_key", "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("_own", F.when(F.col("_alias"), F.lit("block")), F.lit("allow")).alias("verdict"),
        F.when(F.col("_own").isNotNull(), "rule").when(F.col("_alias"), "alias").otherwise("default").alias("via"))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's url: page_id, host, path, rule, verdict, via."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages.select("page_id", "url"), redirect_edges(pages.select("url", "html")))


_SQL_RULE = """list_extract(list_filter(
    [{what: 'www.example.com/en/', h: 'www.example.com', p: '/en/', v: 'allow'}, {what: 'example.com/en/', h: 'example.com', p: '/en/', v: 'block'},
     {what: 'net/fr/', h: 'net', p: '/fr/', v: 'block'}, {what: 'net/es/', h: 'net', p: '/es/', v: 'block'}, {what: 'com/', h: 'com', p: '/', v: 'allow'}],
    lambda r: (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p)), 1)"""

# the given pages name no canonical or refresh target, so SQL covers the rules; tests cover propagation by brute force
OP5_SQL = rf"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {_SQL_RULE} AS r FROM parts)
SELECT page_id, host, path, r.what AS rule, coalesce(r.v, 'allow') AS verdict,
       CASE WHEN r IS NULL THEN 'default' ELSE 'rule' END AS via FROM ruled
"""
