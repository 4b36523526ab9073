"""Operator 9, URL filters by redirect equivalence, in DataFrame functions only.

Urls that redirect to, or name as canonical, one another are aliases: connected components over
those edges. A url with a rule of its own (longest fitting rule) takes that rule's verdict.
Any other url takes the verdict of its aliases' rules: ``allow`` if one of them is explicitly
allowed (an explicit allow always precedes), else ``block`` if one is blocked, else the default.

Null urls or urls without ``://`` have an empty host and path, no rule and no alias. Repeated rows
get equal verdicts. An empty table gives no rows. Edges with a missing end are ignored.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.graph import connected_components
from ..session import durable

#: (verdict, host, path) of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(_ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def vertex_of(url: Column) -> Column:
    """A url's identity among aliases: host, path and query, without scheme and fragment."""
    rest = F.regexp_extract(_rest(url), r"^([^/?#]*)([^#]*)", 2)
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules (verdict, host, path) as a table; a large rule set can be read from anywhere instead."""
    return spark.range(1).select(F.inline(F.array(*[F.struct(
        F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])))


def with_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` (host, path, ...) with ``own`` (struct<rule, verdict> of the longest rule that fits, or
    null; at equal length an allow comes first). Each distinct host is joined once with the rules
    of itself and its parent domains; rows then look through their host's list, longest first."""
    r = rules.select(F.col("host").alias("__on"), F.struct(
        (-F.char_length(F.concat("host", "path"))).alias("order"), (F.col("verdict") != "allow").alias("late"),
        F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    parents = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    hosts = df.select("host").where("host <> ''").distinct().withColumn("__on", F.explode(parents))
    fits = (hosts.join(r, "__on").groupBy("host").agg(F.array_sort(F.collect_list("r")).alias("__rules")))
    first = F.get(F.filter("__rules", lambda x: F.startswith(F.col("path"), x["path"])), F.lit(0))
    return (df.join(fits, "host", "left")
            .withColumn("own", F.when(first.isNotNull(), F.struct(first["rule"].alias("rule"), first["verdict"].alias("verdict"))))
            .drop("__rules"))


def _resolve(target: Column, url: Column) -> Column:
    """An absolute url for a link target found on ``url``."""
    scheme = F.regexp_extract(url, r"^([^:]*)://", 1)
    host = host_of(url)
    base = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(scheme, F.lit("://"), host, target))
            .when((target != "") & ~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") & (host != ""),
                  F.concat(scheme, F.lit("://"), host, F.when(base == "", F.lit("/")).otherwise(base), target)))


def page_edges(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst) urls from ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``."""
    html, url = F.coalesce(F.col(html_col), F.lit("")), F.col(url_col)
    unquote = lambda c: F.replace(F.trim(c), F.lit("&amp;"), F.lit("&"))
    canonical = F.regexp_extract(html, r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(html, r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    found = F.when(html.rlike(r"(?i)canonical|http-equiv"), F.array(unquote(canonical), unquote(refresh)))
    return (pages.select(url.alias("src"), F.explode(found).alias("target")).where("target <> '' and src is not null")
            .select("src", _resolve(F.col("target"), F.col("src")).alias("dst")).where("dst is not null"))


def judge(urls: DataFrame, url_col: str, edges: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule and verdict added (input columns of these names are
    replaced). ``edges`` (src, dst) are redirects or canonical links between urls."""
    own = ("host", "path", "rule", "verdict", "own")
    keep = [F.col(f"`{c}`") for c in urls.columns if c.lower() not in own or c == url_col]
    url = F.col(f"`{url_col}`")
    base = urls.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"), vertex_of(url).alias("__v"))
    ends = edges.select(vertex_of(F.col("src")).alias("a"), vertex_of(F.col("dst")).alias("b"),
                        F.struct(host_of(F.col("src")).alias("host"), path_of(F.col("src")).alias("path")).alias("pa"),
                        F.struct(host_of(F.col("dst")).alias("host"), path_of(F.col("dst")).alias("path")).alias("pb"))
    ends = durable(ends.where("a <> b"))
    comp = connected_components(ends, "a", "b", "__v", "__c")
    # verdicts of the rules of all urls in a component, those that are only linked to included
    nodes = (ends.select(F.col("a").alias("__v"), "pa.*").unionByName(ends.select(F.col("b").alias("__v"), "pb.*"))
             .dropDuplicates(["__v"]))
    told = (with_rule(nodes, rules).where("own is not null").join(comp, "__v")
            .groupBy("__c").agg(F.max(F.col("own.verdict") == "allow").alias("allowed")))
    alias = comp.join(told, "__c").select("__v", F.when(F.col("allowed"), F.lit("allow")).otherwise(F.lit("block")).alias("__alias"))
    return (with_rule(base, rules).join(alias, "__v", "left")
            .withColumn("rule", F.col("own.rule"))
            .withColumn("verdict", F.coalesce(F.col("own.verdict"), F.col("__alias"), F.lit(default)))
            .drop("__v", "own", "__alias"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    """Contract of query 9 over all of ``pages``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    edges = durable(page_edges(pages, "url", "html"))    # found by one pass over the pages
    return judge(pages.select("page_id", "url"), "url", edges, rule_table(spark)).select(
        "page_id", "host", "path", "rule", "verdict")


SQL_URLS = r"""
WITH RECURSIVE e0 AS (
  SELECT url AS src, replace(trim(unnest([
    regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1),
    regexp_extract(html, '(?i)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b', 1),
    regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)', 1)])), '&amp;', '&') AS dst
  FROM pages WHERE url IS NOT NULL),
e1 AS (SELECT src, dst FROM e0 WHERE dst LIKE '%://%'),
u AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT dst FROM e1) WHERE url IS NOT NULL),
p AS (SELECT url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM u),
h AS (SELECT url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
        regexp_extract(rest, '^([^/?#]*)([^#]*)', 2) AS tail FROM p),
r AS (SELECT url, host, path, CASE WHEN host <> '' THEN host || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END END AS v, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM h),
j AS (SELECT DISTINCT a.v AS x, b.v AS y FROM e1 JOIN r a ON a.url = e1.src JOIN r b ON b.url = e1.dst WHERE a.v <> b.v),
b AS (SELECT x, y FROM j UNION SELECT y, x FROM j),
reach AS (SELECT x, y FROM b UNION SELECT reach.x, b.y FROM reach JOIN b ON reach.y = b.x),
al AS (SELECT reach.x AS v, bool_or(r.rule IN ('com/', 'www.example.com/en/')) AS allowed
       FROM (SELECT x, y FROM reach UNION SELECT x, x FROM reach) reach JOIN r ON r.v = reach.y WHERE r.rule IS NOT NULL GROUP BY 1)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN allowed THEN 'allow' WHEN allowed IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM pages LEFT JOIN r USING (url) LEFT JOIN al USING (v)"""
