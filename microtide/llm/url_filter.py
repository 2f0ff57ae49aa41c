"""URL verdicts by rules, carried along redirects and canonical links.

Native DataFrame functions only. A rule names a host and a path: it fits that host and its
subdomains where the url's path starts with the rule's, and the longest rule that fits decides.
Urls that no rule fits take the decision of their aliases: redirects and canonical links are the
edges of a graph over urls, and within a connected component an allow rule that fits any url
goes before block rules, these before the default.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from microtide.llm.common import lookup_join, materialize, release, table
from microtide.llm.jaccard import components

ALLOW, BLOCK = "allow", "block"
#: (verdict, host, path) of the registered query.
RULES = [
    (ALLOW, "com", "/"),
    (BLOCK, "example.com", "/en/"),
    (ALLOW, "www.example.com", "/en/"),
    (BLOCK, "net", "/es/"),
    (BLOCK, "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TAG = r"(?i)<(?:link|meta)\b[^<>]*>"


def _after_scheme(url: Column) -> Column:
    """What follows the first ://; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment. Null without a host."""
    query = F.regexp_extract(_after_scheme(url), r"^[^?#]*(\?[^#]*)?", 1)
    return F.when(host_of(url) != "", F.concat(host_of(url), path_of(url), query))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value in quotes or bare, with &amp; decoded; empty if it isn't there."""
    found = F.regexp_extract(tag, rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.replace(F.trim(F.regexp_replace(found, r"""^["']|["']$""", "")), F.lit("&amp;"), F.lit("&"))


def resolved(target: Column, url: Column) -> Column:
    """A link's target as a whole url, seen from the page at ``url``. Dots in relative paths stay."""
    scheme = F.regexp_extract(url, r"^[^:/?#]*:", 0)
    site = F.concat(scheme, F.lit("//"), host_of(url))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .when(target.startswith("?"), F.concat(site, path_of(url), target))
        .when((target == "") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(site, F.regexp_replace(path_of(url), r"[^/]*$", ""), F.when(F.instr(path_of(url), "/") == 0, F.lit("/")).otherwise(F.lit("")), target))
    )


def aliases(url: Column, html: Column) -> Column:
    """Urls that a page names as its own: canonical links and refresh redirects, whole and in order."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TAG), F.lit(0))

    def target(tag: Column) -> Column:
        canonical = F.concat(F.lit(" "), F.lower(_attribute(tag, "rel")), F.lit(" ")).rlike(r"\scanonical\s") & tag.rlike(r"(?i)^<link")
        refresh = (F.lower(_attribute(tag, "http-equiv")) == "refresh") & tag.rlike(r"(?i)^<meta")
        moved = F.regexp_extract(_attribute(tag, "content"), r"""(?i)^[\s\d.]*[;,]\s*url\s*=\s*["']?([^"']*)""", 1)
        return F.when(canonical, _attribute(tag, "href")).when(refresh, F.trim(moved)).otherwise(F.lit(""))

    return F.filter(F.transform(tags, lambda t: resolved(target(t), url)), lambda t: t.isNotNull())


def edges_of(pages: DataFrame) -> DataFrame:
    """(source, target) urls of the links that pages (url, html) declare."""
    return pages.where("url is not null").select(F.col("url").alias("source"), F.explode(aliases(F.col("url"), F.col("html"))).alias("target"))


def _by_host(hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, rules): the rules of every host that has any, by the domains that it is within."""
    spark = hosts.sparkSession
    listed = spark.createDataFrame(sorted({(h, p, v == ALLOW) for v, h, p in rules}), "domain string, path string, allow boolean")
    listed = listed.groupBy("domain").agg(F.collect_list(F.struct(F.length(F.concat("domain", "path")).alias("length"), "allow", "path", F.concat("domain", "path").alias("rule"))).alias("some"))
    labels = F.split("host", r"\.", -1)
    domain = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    within = hosts.select("host").distinct().select("host", F.explode(domain).alias("domain"))
    return within.join(listed, "domain").groupBy("host").agg(F.flatten(F.collect_list("some")).alias("rules"))


def _ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (id, host, path, ...) with rule and allow of the longest rule that fits, null without one; of equally long ones allow."""
    known = materialize(_by_host(urls, rules))
    both = lookup_join(urls, known, ["host"], ["id"])
    best = F.array_max(F.filter(F.col("rules"), lambda r: F.col("path").startswith(r["path"])))
    return both.withColumn("best", best).select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.allow").alias("allow"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, default: str = ALLOW) -> DataFrame:
    """page_id, host, path, rule and verdict per row of ``pages`` (page_id, url, html).

    ``redirects`` (source, target: urls) adds edges to those that the pages declare by canonical
    links and refresh redirects. A page that a rule fits has that rule's verdict. Others take an
    allow from any alias that an allow rule fits, else a block, else ``default``; rules are applied
    to aliases whether or not they are pages. Null urls and those without :// have an empty host
    and path, no rule and no alias; null html has no links; rows with an equal url have an equal
    verdict and are returned each; an empty table gives no rows. ``rules`` is a list of the size of a
    configuration.
    """
    seen = pages.select(F.monotonically_increasing_id().alias("id"), "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), key_of(F.col("url")).alias("key"), F.transform(aliases(F.col("url"), F.col("html")), key_of).alias("others"))
    seen = materialize(seen)
    ruled = _ruled(seen.drop("others"), rules)

    pairs = seen.where("key is not null").select(F.col("key").alias("a"), F.explode("others").alias("b"))
    if redirects is not None:
        pairs = pairs.union(redirects.select(key_of(F.col("source")), key_of(F.col("target"))))
    pairs = materialize(pairs.where("a is not null and b is not null and a != b").distinct())
    members = components(pairs)
    url = F.concat(F.lit("://"), F.col("v"))
    vertices = materialize(members.select(F.col("v").alias("id"), "root", host_of(url).alias("host"), path_of(url).alias("path")))
    decided = _ruled(vertices, rules)
    by_root = decided.groupBy("root").agg(F.max(F.col("allow")).alias("group_allow")).where("group_allow is not null")
    inherited = materialize(decided.select("id", "root").join(by_root, "root").select(F.col("id").alias("key"), "group_allow"))
    both = lookup_join(ruled, inherited, ["key"], ["id"])
    word = lambda c: F.when(c, ALLOW).when(~c, BLOCK)
    verdict = F.coalesce(word(F.col("allow")), word(F.col("group_allow")), F.lit(default))
    out = materialize(both.select("page_id", "host", "path", "rule", verdict.alias("verdict")))
    release(seen, pairs, members, vertices, inherited)
    return out


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


ORACLE_SQL = r"""
WITH RECURSIVE u AS (
  SELECT row_number() OVER () AS id, page_id, url, html, instr(url, '://') > 0 AS ok, substr(url, instr(url, '://') + 3) AS rest FROM pages),
p AS (
  SELECT id, page_id, html, split_part(url, ':', 1) || ':' AS scheme,
    CASE WHEN ok THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN ok THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
    CASE WHEN ok THEN regexp_extract(rest, '^[^?#]*(\?[^#]*)?', 1) ELSE '' END AS query
  FROM u),
k AS (SELECT id, page_id, html, scheme, host, path, CASE WHEN host <> '' THEN host || path || query END AS key FROM p),
tags AS (SELECT key, scheme, host, path, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^<>]*>')) AS tag FROM k WHERE key IS NOT NULL),
href AS (
  SELECT key, scheme, host, path, CASE
    WHEN regexp_matches(tag, '(?i)^<link\b.*[\s"'']rel\s*=\s*["'']?([^"''>]*\s)?canonical["''\s>/]') THEN trim(regexp_extract(tag, '(?i)[\s"'']href\s*=\s*["'']?([^"''>\s]*)', 1))
    WHEN regexp_matches(tag, '(?i)^<meta\b.*http-equiv\s*=\s*["'']?refresh') THEN trim(regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''>]*)', 1))
    END AS t FROM tags),
target AS (
  SELECT key AS a, CASE WHEN t LIKE '%://%' THEN t WHEN t LIKE '//%' THEN scheme || t WHEN t LIKE '/%' THEN scheme || '//' || host || t END AS b0
  FROM (SELECT key, scheme, host, path, replace(t, '&amp;', '&') AS t FROM href WHERE t <> '')),
edge AS (
  SELECT DISTINCT a, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(r, '^[^/?#]*([^#]*)', 1) AS b
  FROM (SELECT a, substr(b0, instr(b0, '://') + 3) AS r FROM target WHERE b0 IS NOT NULL)),
edges AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach(v, w) AS (SELECT a, a FROM edges UNION SELECT r.v, b.b FROM reach r JOIN edges b ON r.w = b.a),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
place AS (SELECT DISTINCT host, path FROM k UNION SELECT regexp_extract(w, '^[^/?#]*'), regexp_extract(w, '^[^/?#]*([^?#]*)', 1) FROM reach),
hit AS (
  SELECT host, path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM place JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
got AS (
  SELECT v, min(verdict) AS verdict
  FROM reach JOIN hit ON hit.host = regexp_extract(w, '^[^/?#]*') AND hit.path = regexp_extract(w, '^[^/?#]*([^?#]*)', 1) GROUP BY v)
SELECT page_id, k.host, k.path, hit.rule, coalesce(hit.verdict, got.verdict, 'allow') AS verdict
FROM k LEFT JOIN hit ON k.host = hit.host AND k.path = hit.path LEFT JOIN got ON got.v = k.key
"""
