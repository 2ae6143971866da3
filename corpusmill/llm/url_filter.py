"""URL filter with redirect equivalence, in DataFrame functions only.

A rule names a host (it also fits the subdomains) and the start of a path; the longest rule that fits a url decides.
Urls that no rule fits take part in an equivalence: pages that redirect to, or name as canonical, another url are its
aliases. Connected components over these links are found in a distributed way; a block of any member reaches every
member, except those that a rule allows explicitly. Everything else is allowed.

A url and the same without its empty path's slash are one node; a page's own rule is still that of its path as it stands.

Defined cases: a null url, or one without "://", has an empty host and path, fits no rule, has no aliases and is
allowed; null html has no links; repeated rows each get their row; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import table

#: (verdict, host, start of the path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Up to so many rules are one CASE over the row; more are a table that is joined by host.
CASE_RULES = 256
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host, path and node: host, path (an empty one is /) and query string, the name of the url in the link graph (null: none)."""
    rest = urls.withColumn("_at", F.instr(F.col(url), "://")).withColumn("_rest", F.when(F.col("_at") > 0, F.expr(f"substr(`{url}`, _at + 3)")).otherwise(""))
    host = rest.withColumn("_host", F.regexp_extract("_rest", r"^[^/?#]*", 0))
    host = host.withColumn("_after", F.expr("substr(_rest, length(_host) + 1)")).withColumn("host", F.translate("_host", _UP, _LOW))
    out = host.withColumn("path", F.regexp_extract("_after", r"^[^?#]*", 0))
    return out.withColumn("node", F.when(F.col("host") != "", F.concat("host", F.when(F.col("path") == "", "/").otherwise(""), F.regexp_extract("_after", r"^[^#]*", 0)))).drop("_at", "_rest", "_host", "_after")


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)


def with_rule(urls: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds rule (host and path of the longest rule that fits host and path, allow before block) and ruled (its verdict)."""
    order = sorted({(v, h, p) for v, h, p in rules}, key=lambda r: (-len(r[1] + r[2]), r[0], r[1:]))
    if not order:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "ruled": F.lit(None).cast("string")})
    if len(order) <= CASE_RULES:
        found = None
        for verdict, host, path in order:
            hit = F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("ruled"))
            found = (F if found is None else found).when(_fits(host, path), hit)
        return urls.withColumn("_hit", found).withColumn("rule", F.col("_hit.rule")).withColumn("ruled", F.col("_hit.ruled")).drop("_hit")
    spark = urls.sparkSession
    listed = spark.createDataFrame([(i, *r) for i, r in enumerate(order)], "_i long, _v string, _h string, _p string")
    pairs = urls.select("host", "path").where("host <> ''").distinct().withColumn("_h", F.explode(F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, 9999), '.'))")))
    best = pairs.join(listed, "_h").where("startswith(path, _p)").groupBy("host", "path").agg(F.min_by(F.struct(F.concat("_h", "_p").alias("rule"), F.col("_v").alias("ruled")), "_i").alias("_hit"))
    return urls.join(best, ["host", "path"], "left").withColumn("rule", F.col("_hit.rule")).withColumn("ruled", F.col("_hit.ruled")).drop("_hit")


#: Tags that may name another url, and what they must hold: a canonical among the words of rel, a refresh.
_LINK, _META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
_CANONICAL, _REFRESH = r"""(?is)\brel\s*=\s*(?:"[^">]*|'[^'>]*|)\bcanonical\b""", r"""(?is)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
_HREF, _URL = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]*)""", r"""(?is)\burl\s*=\s*["']?([^"'\s>]*)"""


def _named(tag: str, holds: str, url: str) -> Column:
    """The urls of all tags that hold the pattern; ampersands are written out in html."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(holds))
    return F.transform(tags, lambda t: F.regexp_replace(F.regexp_extract(t, url, 1), "(?i)&(?:amp|#38|#x26);", "&"))


def page_links(pages: DataFrame) -> DataFrame:
    """a, b: nodes of pages and of all urls that they name as canonical or refresh to."""
    p = with_parts(pages.where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", "html")).where("node IS NOT NULL")
    p = p.withColumn("named", F.array_distinct(F.concat(_named(_LINK, _CANONICAL, _HREF), _named(_META, _REFRESH, _URL))))
    p = p.select("host", "path", F.col("node").alias("a"), F.explode("named").alias("to")).where("to <> '' AND NOT startswith(to, '#')")
    full = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), "to"))
        .when(F.col("to").startswith("/"), F.concat(F.lit("http://"), "host", "to"))
        .otherwise(F.concat(F.lit("http://"), "host", F.regexp_replace(F.when(F.col("path") == "", "/").otherwise(F.col("path")), "[^/]*$", ""), "to"))
    )
    return with_parts(p.select("a", full.alias("url"))).where("node IS NOT NULL").select("a", F.col("node").alias("b"))


def url_filter(pages: DataFrame, links: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule and verdict; links: a, b of nodes (page_links, or redirects that a crawler logged)."""
    judged = with_rule(with_parts(pages), rules)
    parts = connected_components(links)
    nodes = with_rule(with_parts(parts.withColumn("url", F.concat(F.lit("http://"), "node")).withColumnRenamed("node", "_node")), rules)
    blocked = nodes.groupBy("component").agg(F.max((F.col("ruled") == "block").cast("int")).alias("hit")).where("hit = 1")
    aliases = parts.join(blocked, "component", "left_semi").select("node").withColumn("_aliased", F.lit(True))
    if aliases.isEmpty():
        judged = judged.withColumn("_aliased", F.lit(None).cast("boolean"))
    else:
        judged = judged.join(aliases, "node", "left")
    verdict = F.coalesce("ruled", F.when(F.col("_aliased"), "block"), F.lit("allow"))
    return judged.withColumn("verdict", verdict).drop("node", "ruled", "_aliased")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter(pages.select("page_id", "url"), page_links(pages)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH RECURSIVE p AS (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM p),
q AS (SELECT page_id, html, lower(raw) AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, lower(raw) || CASE WHEN regexp_matches(substr(rest, length(raw) + 1), '^[^?#]') THEN '' ELSE '/' END || regexp_extract(substr(rest, length(raw) + 1), '^[^#]*') AS node FROM h),
rules(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
t0 AS (SELECT host, path, node, regexp_replace(unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?is)<link\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\brel\s*=\s*(?:"[^">]*|''[^''>]*|)\bcanonical\b')), lambda t: regexp_extract(t, '(?is)\bhref\s*=\s*["'']?([^"''\s>]*)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\b[^>]*>'), lambda t: regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b')), lambda t: regexp_extract(t, '(?is)\burl\s*=\s*["'']?([^"''\s>]*)', 1)))), '(?i)&(?:amp|#38|#x26);', '&', 'g') AS target FROM q WHERE host <> ''),
t AS (SELECT node, CASE WHEN contains(target, '://') THEN substr(target, instr(target, '://') + 3) WHEN starts_with(target, '//') THEN substr(target, 3)
    WHEN starts_with(target, '/') THEN host || target ELSE host || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || target END AS rest
    FROM t0 WHERE target <> '' AND NOT starts_with(target, '#')),
e AS (SELECT node AS a, lower(regexp_extract(rest, '^[^/?#]*')) || CASE WHEN regexp_matches(rest, '^[^/?#]*/') THEN '' ELSE '/' END || regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^#]*') AS b FROM t),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
names AS (SELECT node, host, path FROM q UNION SELECT a, regexp_extract(a, '^[^/?#]*'), regexp_extract(substr(a, length(regexp_extract(a, '^[^/?#]*')) + 1), '^[^?#]*') FROM sym),
hit AS (SELECT node, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY node, path ORDER BY length(rhost || rpath) DESC, verdict) AS k
    FROM names JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT node, path, rule, verdict FROM hit WHERE k = 1),
reach(node) AS (SELECT node FROM best WHERE verdict = 'block' UNION SELECT b FROM reach JOIN sym ON a = reach.node)
SELECT page_id, q.host, q.path, rule, coalesce(verdict, CASE WHEN q.node IN (SELECT node FROM reach) THEN 'block' END, 'allow') AS verdict FROM q LEFT JOIN best ON best.node = q.node AND best.path = q.path
"""
