"""URL filters: rules by host and path, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from ..plans.components import components


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (UrlRule("net", "/", "block"), UrlRule("example.net", "/en/", "allow"), UrlRule("example.com", "/de/", "block"), UrlRule("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Links that make two urls one page: canonical links, and meta refreshes as redirects; attributes in either order.
CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?[^"'>]*?url\s*=\s*["']?([^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(_parts(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _parts(url, 2)


def _parts(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls. A rule fits its host and all subdomains if the path begins with its path."""
    ordered = sorted(rules, key=lambda r: -len(str(r)))
    name = verdict = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, str(r)) if name is None else name.when(fits, str(r))
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return (name, verdict) if ordered else (F.lit(None).cast("string"), F.lit(None).cast("string"))


#: Scheme, host, path and the rest of an absolute url; a scheme alone; a host after a scheme.
_ABSOLUTE, _SCHEME = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(.*)$", r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"
_ORIGIN = r"(?s)^.*?://[^/?#]*"


def dotless(path: Column) -> Column:
    """A path without its segments . and .., each of which takes back the one before it."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    parts = F.when(last.isin(".", ".."), F.concat(parts, F.array(F.lit("")))).otherwise(parts)
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, 1, 1), step)
    return F.array_join(kept, "/")


def normalised(url: Column) -> Column:
    """A url as aliases know it: no fragment, scheme and host in lower case, a path without dot segments, at least /."""
    path = F.regexp_extract(url, _ABSOLUTE, 3)
    rest = F.regexp_replace(F.regexp_extract(url, _ABSOLUTE, 4), "(?s)#.*$", "")
    whole = F.concat(F.translate(F.regexp_extract(url, _ABSOLUTE, 1), UPPER, LOWER), F.lit("://"), F.translate(F.regexp_extract(url, _ABSOLUTE, 2), UPPER, LOWER), F.when(path == "", "/").when(path.contains("/."), dotless(path)).otherwise(path), rest)
    return F.when(url.rlike(_ABSOLUTE), whole).otherwise(F.regexp_replace(url, "(?s)#.*$", ""))


def absolute(base: Column, link: Column) -> Column:
    """A link as written on the page ``base``, made absolute and normalised. References are decoded as far as &amp;.

    A link has a scheme only if it begins with one: a query may hold ://. Null for other schemes than those with //,
    such as mailto, and for a base without a host if it is needed.
    """
    link = F.regexp_replace(F.regexp_replace(link, "&amp;", "&"), "(?s)#.*$", "")
    origin = F.regexp_extract(base, _ORIGIN, 0)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)?", 1)
    joined = (
        F.when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link == "", base)
        .when(link.startswith("?"), F.concat(F.regexp_extract(base, r"(?s)^[^?#]*", 0), link))
        .otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), link))
    )
    return normalised(F.when(link.rlike(_ABSOLUTE), link).when(~link.rlike(_SCHEME) & (origin != ""), joined))


def alias_edges(pages: DataFrame) -> DataFrame:
    """url, target, both normalised: what a page's canonical links and refreshes point to; a page without a url has none."""
    html = F.coalesce("html", F.lit(""))
    found = F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(REFRESH), F.lit(1)))
    some = pages.where("url IS NOT NULL").where(html.rlike("(?i)canonical|http-equiv"))
    return some.select("url", F.explode(found).alias("link")).select(normalised(F.col("url")).alias("url"), absolute(F.col("url"), F.col("link")).alias("target")).where("target != url").distinct()


def verdicts(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, edges: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, alias_of_block.

    A page's own rule decides. Else its aliases do, all urls that redirect and canonical edges connect with it, whether
    or not they have a page: allow if one of them is allowed by a rule, else block if one is blocked, else allow. A null
    url, or one without ://, has an empty host and path, fits no rule and is allowed. Repeated pages are judged alike.
    Aliases are matched as ``normalised`` has them. ``edges`` (url, target) stands in for what the pages' html says.
    Further columns, whatever their names, are not read.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, own = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", "url").select("page_id", "url", host.alias("host"), path.alias("path")).select("*", name.alias("rule"), own.alias("own"))
    links = settle(alias_edges(pages) if edges is None else edges.select(normalised(F.col("url")).alias("url"), normalised(F.col("target")).alias("target")), "aliases")
    if links.isEmpty():
        return judged.select("page_id", "host", "path", "rule", F.coalesce("own", F.lit("allow")).alias("verdict"), F.lit(False).alias("alias_of_block"))
    urls = links.select("url").unionByName(links.select(F.col("target").alias("url"))).where("url IS NOT NULL").distinct()
    nodes = settle(urls.select("url", F.monotonically_increasing_id().alias("node")), "urls")  # written once, so numbers hold
    ends = links.join(nodes.select("url", F.col("node").alias("a")), "url").join(nodes.select(F.col("url").alias("target"), F.col("node").alias("b")), "target")
    grouped = nodes.join(components(ends.select("a", "b")), "node").select("url", "component")
    ruled = grouped.select("component", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).select("component", rule_of(F.col("host"), F.col("path"), rules)[1].alias("own"))
    said = ruled.groupBy("component").agg(F.bool_or(F.col("own") == "allow").alias("allowed"), F.bool_or(F.col("own") == "block").alias("blocked"))
    carried = grouped.join(said, "component").where("blocked AND NOT coalesce(allowed, false)").select(F.col("url").alias("alias"), F.lit(True).alias("by_alias"))
    by_alias = F.coalesce("by_alias", F.lit(False)) & F.col("own").isNull()
    return judged.withColumn("alias", normalised(F.col("url"))).join(carried, "alias", "left").select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("by_alias"), "block"), F.lit("allow")).alias("verdict"), by_alias.alias("alias_of_block"))


def _rule_sql(host: str, path: str, value: str) -> str:
    """The rules as a CASE over SQL expressions; ``value``: name or verdict."""
    out = "".join(f" WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r if value == 'name' else r.verdict}'" for r in sorted(RULES, key=lambda r: -len(str(r))))
    return f"CASE{out} END"


_HOST = f"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}')"
_PATH = "coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
_DOTLESS = """array_to_string(list_reduce(list_transform(string_split({0}, '/') || CASE WHEN regexp_matches({0}, '(^|/)[.][.]?$') THEN [''] ELSE [] END, lambda x: [x]),
  lambda acc, x: CASE WHEN x[1] = '.' THEN acc WHEN x[1] = '..' THEN acc[1:greatest(len(acc) - 1, 1)] ELSE acc || x END), '/')"""


def _normalised_sql(url: str) -> str:
    bare = f"regexp_replace({url}, '(?s)#.*$', '')"
    m = rf"regexp_extract({bare}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(.*)$', ['scheme', 'host', 'path', 'rest'])"
    lower = lambda part: f"translate(({m})['{part}'], '{UPPER}', '{LOWER}')"
    return f"CASE WHEN regexp_matches({bare}, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN {lower('scheme')} || '://' || {lower('host')} || coalesce(nullif({_DOTLESS.format(f'({m}).path')}, ''), '/') || ({m}).rest ELSE {bare} END"


SQL = rf"""
WITH RECURSIVE j AS (SELECT page_id, url, {_normalised_sql('url')} AS alias, {_HOST} AS host, {_PATH} AS path FROM pages),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages WHERE url IS NOT NULL),
found AS (SELECT url, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS link FROM tags WHERE regexp_matches(tag, '(?is)^<link.*\brel\s*=\s*["'']?canonical\b')
          UNION ALL SELECT url, regexp_extract(tag, '(?is)\bcontent\s*=\s*["'']?[^"''>]*?url\s*=\s*["'']?([^"''\s>]+)', 1) FROM tags WHERE regexp_matches(tag, '(?is)^<meta.*\bhttp-equiv\s*=\s*["'']?refresh\b')),
clean AS (SELECT url, regexp_replace(replace(link, '&amp;', '&'), '(?s)#.*$', '') AS link FROM found WHERE link <> ''),
whole AS (SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR NOT contains(url, '://') THEN NULL
                 WHEN starts_with(link, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || link
                 WHEN starts_with(link, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || link WHEN link = '' THEN url WHEN starts_with(link, '?') THEN regexp_extract(url, '(?s)^[^?#]*') || link
                 ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*') || coalesce(nullif(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*/)?', 1), ''), '/') || link END AS target FROM clean),
edges AS (SELECT {_normalised_sql('url')} AS a, {_normalised_sql('target')} AS b FROM whole WHERE target IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, root) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT b, root FROM reach JOIN both_ways ON a = node),
said AS (SELECT node, bool_or(own = 'allow') AS allowed, bool_or(own = 'block') AS blocked FROM (SELECT node, {_rule_sql('host', 'path', 'verdict')} AS own FROM (SELECT node, {_HOST} AS host, {_PATH} AS path FROM (SELECT node, root AS url FROM reach))) GROUP BY node),
o AS (SELECT page_id, host, path, {_rule_sql('host', 'path', 'name')} AS rule, {_rule_sql('host', 'path', 'verdict')} AS own, coalesce(blocked AND NOT coalesce(allowed, false), false) AS by_alias FROM j LEFT JOIN said ON node = alias)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN by_alias THEN 'block' ELSE 'allow' END) AS verdict, own IS NULL AND by_alias AS alias_of_block FROM o
"""
