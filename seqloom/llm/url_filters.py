"""URL filters with redirect equivalence.

A rule is a host and a path prefix, and fits the host and all its subdomains; the longest rule wins.
Pages that redirect to, or name as canonical, another address are aliases of it: connected components
over those edges carry a block to every alias, also from an address that is only linked to and isn't
among the pages. An explicit allow on a page's own address has precedence
over a block that comes from an alias.

Edges are a page's canonical links and meta refreshes, all that it has, of tags of any length; comments and
scripts are no source of them. Conventional redirects (scheme, www., closing slash ...) are a guess and only
used on request.

Null urls and urls without "://" have empty host and path, fit no rule and have no aliases: they are
allowed. Null and empty html gives no edges, and very long html is scanned once. Repeated pages are judged
alike, each row on its own; of rules that are equally long an allow wins. An empty table gives no rows. Other
columns than page_id, url and html aren't read, so their names can't clash.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]  # verdict, host, path prefix
#: Up to so many rules are one expression; more become a table that is joined by host.
INLINE_RULES = 64


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")


def with_host_path(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path to rows with a `url`."""
    rest = F.coalesce(_rest(F.col("url")), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def with_rule(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds `rule` and `rule_verdict` of the longest rule that fits (of equal length: allow first); null where none does."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    if len(ranked) > INLINE_RULES:
        return _with_rule_table(pages, ranked)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in reversed(ranked):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, what).otherwise(verdict)
    return pages.withColumns({"rule": name, "rule_verdict": verdict})


def _with_rule_table(pages: DataFrame, ranked: list[Rule]) -> DataFrame:
    spark = pages.sparkSession
    table = spark.createDataFrame([(h, p, w, i) for i, (w, h, p) in enumerate(ranked)], "rule_host string, rule_path string, rule_verdict string, place int")
    sites = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tail = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = sites.select("host", "path", F.explode(tail).alias("rule_host")).join(table, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    best = fits.groupBy("host", "path").agg(F.min(F.struct("place", F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict")).alias("best"))
    return pages.join(best.select("host", "path", "best.rule", "best.rule_verdict"), ["host", "path"], "left")


#: What a scan stops at: comments, elements whose content is no markup, and the two elements that name addresses.
_MARK = re.compile(r"<!--|<(link|meta|script|style|title|textarea|template|noscript)(?=[\s/>])", re.I)
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']*))?""")
_TARGET = re.compile(r"""url\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'][^\s]*))""", re.I)


def _attributes(text: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes of the tag whose name ends at `at`, in lower case, the first of a name; and where the tag ends."""
    out: dict[str, str] = {}
    while m := _ATTRIBUTE.match(text, at):
        value = m[2] or ""
        out.setdefault(m[1].lower(), entities.unescape(value[1:-1] if value[:1] in ("'", '"') else value))
        at = m.end()
    end = text.find(">", at)
    return out, len(text) if end < 0 else end + 1


def named_addresses(text: str) -> list[str]:
    """Targets of the canonical links and refreshes of a page, as written, in order."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        name = (m[1] or "").lower()
        if not name:
            at = text.find("-->", m.end())
            at = len(text) if at < 0 else at + 3
            continue
        got, at = _attributes(text, m.end())
        if name == "link":
            if "canonical" in got.get("rel", "").lower().split():
                out.append(got.get("href", "").strip())
        elif name == "meta":
            if got.get("http-equiv", "").strip().lower() == "refresh" and (t := _TARGET.search(got.get("content", ""))):
                out.append((t[1] or t[2] or t[3] or "").strip())
        elif name not in ("template", "noscript"):
            close = re.compile(f"</{name}", re.I).search(text, at)
            at = close.end() if close else len(text)
    return [x for x in out if x]


def _absolute(link: Column) -> Column:
    """A link as written on the page at `url`, as a whole address."""
    scheme = F.regexp_extract("url", r"^([^:/?#]+)://", 1)
    site = F.regexp_extract("url", r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_extract(F.regexp_extract("url", r"^[^:/?#]+://[^?#]*", 0), r"^([^:/?#]+://[^/]*(?:/.*/|/)?)", 1)
    return (
        F.when(link == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.rlike(r"^[?#]"), None)
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    )


def address(url: Column) -> Column:
    """An address without its fragment, scheme and host in lower case."""
    head = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    return F.concat(F.lower(head), F.regexp_replace(F.substring(url, F.length(head) + 1, F.length(url)), r"#[\s\S]*$", ""))


def plain_address(url: Column) -> Column:
    """Where sites by convention redirect to: no scheme, no www. or m. label, no tracking query, no closing slash."""
    bare = F.regexp_replace(address(url), r"^[^:/?#]+://(?:www\.|m\.)?", "")
    no_track = F.regexp_replace(F.regexp_replace(bare, r"(?<=[?&])(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*(?:&|$)", ""), r"[?&]$", "")
    return F.regexp_replace(no_track, r"(?<=[^/])/$|/index\.html?$", "")


def link_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) from a page's address to those that its refreshes and canonical links name. Pages without these words aren't scanned."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, x) for u, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in named_addresses(t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in range(2)], names=["url", "link"])

    some = pages.where(F.col("html").rlike("(?i)canonical|refresh") & (F.instr("url", "://") > 0)).select("url", "html")
    found = some.mapInArrow(links, "url string, link string")
    return found.select(address(F.col("url")).alias("a"), address(_absolute(F.col("link"))).alias("b")).where("b is not null")


def alias_edges(pages: DataFrame, linked: DataFrame, conventions: bool = False) -> DataFrame:
    """Edges (a, b) between addresses: those of link_edges and, if asked for, conventional redirects."""
    if conventions:
        own = pages.where("instr(url, '://') > 0").select(address(F.col("url")), plain_address(F.col("url")))
        linked = linked.union(linked.select("b", plain_address(F.col("b")))).union(own)
    return linked.where("a <> b").distinct()


def judge(pages: DataFrame, rules: Sequence[Rule], conventions: bool = False) -> DataFrame:
    """page_id, host, path, rule, verdict, and alias_class (a number that aliases share; null where there are none).

    Addresses are nodes by their 64-bit hash. What a join has on its smaller side is a written table, so that
    the rows of a frequent address or component can be split; rows without address aren't joined.
    """
    scratch = Scratch(pages.sparkSession)
    ruled = with_rule(with_host_path(pages.select("page_id", "url", "html")), rules)
    own = F.when(F.instr("url", "://") > 0, F.xxhash64(address(F.col("url"))))
    judged = scratch.cut(ruled.select("page_id", "host", "path", "rule", "rule_verdict", own.alias("node")))
    linked = scratch.cut(link_edges(pages.select("url", "html")))
    edges = alias_edges(pages.select("url"), linked, conventions).select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"))
    rows = linked.count() + (2 * judged.count() if conventions else 0)
    groups = scratch.cut(connected_components(edges, scratch, rows), 2 * rows)
    aims = with_rule(with_host_path(linked.select(F.col("b").alias("url")).distinct()), rules).withColumn("node", F.xxhash64("url"))
    blocked = judged.select("node", "rule_verdict").union(aims.select("node", "rule_verdict")).where("rule_verdict = 'block' and node is not null")
    blocked = scratch.cut(blocked.join(groups.select(F.col("node").alias("n")), F.col("node") == F.col("n"), "left_semi").select("node").distinct(), 2 * rows)
    spread = scratch.cut(groups.join(blocked, "node", "left_semi").select("component").distinct().withColumn("hit", F.lit(True)), 2 * rows)
    known = groups.join(spread, "component", "left").select("node", F.col("component").alias("alias_class"), F.coalesce("hit", F.lit(False)).alias("hit"))
    known = scratch.cut(known, 2 * rows)
    none = judged.where("node is null").withColumns({"alias_class": F.lit(None).cast("long"), "hit": F.lit(False)})
    every = judged.where("node is not null").join(known, "node", "left").unionByName(none)
    verdict = F.coalesce("rule_verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    return every.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "alias_class")


def sql(rules: Sequence[Rule]) -> str:
    """host, path, rule and verdict in DuckDB, with the spread of blocks as a recursion over plain link tags."""
    listed = ", ".join(f"('{w}', '{h}', '{p}')" for w, h, p in rules)
    parts = f"""translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"""
    rest = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest"
    address = "lower(regexp_extract({0}, '^[^:/?#]+://[^/?#]*')) || regexp_replace(substr({0}, length(regexp_extract({0}, '^[^:/?#]+://[^/?#]*')) + 1), '#(?s:.*)$', '')"
    return rf"""
WITH RECURSIVE rules(what, h, p) AS (VALUES {listed}),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?i)<(?:link|meta)\s[^>]*>')) AS tag FROM pages WHERE contains(url, '://')),
links AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?i)<link') THEN regexp_extract(tag, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1) ELSE regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1) END AS link
  FROM tags WHERE regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical') OR regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh')),
whole AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN link LIKE '//%' THEN regexp_extract(url, '^([^:/?#]+:)', 1) || link
    WHEN link LIKE '/%' THEN regexp_extract(url, '^[^:/?#]+://[^/?#]*') || link END AS link FROM links WHERE link <> ''),
edges AS (SELECT {address.format('url')} AS a, {address.format('link')} AS b FROM whole WHERE link IS NOT NULL),
own AS (SELECT page_id, CASE WHEN contains(url, '://') THEN {address.format('url')} END AS node, {parts} FROM (SELECT *, {rest} FROM pages)),
sites AS (SELECT DISTINCT host, path FROM own UNION SELECT {parts} FROM (SELECT {rest} FROM (SELECT b AS url FROM edges))),
ruled AS (
  SELECT host, path, h || p AS rule, what, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, what) AS k
  FROM sites JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT host, path, rule, what FROM ruled WHERE k = 1),
sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
blocked(n) AS (
  SELECT node FROM own JOIN best USING (host, path) WHERE what = 'block' AND node IS NOT NULL
  UNION SELECT url FROM (SELECT url, {parts} FROM (SELECT url, {rest} FROM (SELECT b AS url FROM edges))) JOIN best USING (host, path) WHERE what = 'block'
  UNION SELECT sym.b FROM blocked JOIN sym ON sym.a = blocked.n)
SELECT page_id, own.host, own.path, rule, coalesce(what, CASE WHEN node IN (SELECT n FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM own LEFT JOIN best ON best.host = own.host AND best.path = own.path"""
