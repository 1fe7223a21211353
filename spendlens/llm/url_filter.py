"""URL filter with redirect equivalence.

Host and path rules decide a url directly; the longest matching rule wins.
Urls without a rule take the decision of their aliases: urls joined by redirect
edges (``<meta http-equiv="refresh">``) and canonical-link edges
(``<link rel="canonical">``) are equivalent, and equivalence classes are the
connected components of those edges.  In a class an explicit allow of any url
takes precedence over any block; with neither, a url is allowed.

Edges are read from the pages that hold such a mark; only urls that occur in an
edge enter the component search, and every table there is distributed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendlens.llm.components import connected_components
from spendlens.llm.html_scan import next_tag
from spendlens.llm.store import cut, ship

#: Fixed values: (verdict, rule); a rule is a host and a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_CASE = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HIDING = {tag: re.compile(rf"(?i)</{tag}\s*>") for tag in ("template", "textarea", "noscript")}  # up to the end tag, if there is one
_ATTRIBUTE = re.compile(r"(?s)([^\s\"'<>/=]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_REFRESH = re.compile(r"(?is)\s*[\d.]*\s*[;,]?\s*url\s*=\s*(.*)$")


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), *_CASE)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest matching rule as struct (rule, verdict), or null.

    A rule fits its host and all subdomains if the path starts with its path;
    of two verdicts for the same rule the allow stands.
    """
    fits = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1], r[0])):
        own, _, tail = rule.partition("/")
        match = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{tail}")
        this = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits = F.when(match, this) if fits is None else fits.when(match, this)
    return fits if fits is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def node_of(url: Column) -> Column:
    """A url as a node: scheme and host in lower case, without its fragment; null if it isn't absolute."""
    parts = F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rest = F.when(rest == "", F.lit("/")).when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(parts != "", F.concat(F.translate(parts, *_CASE), rest))


def _attributes(tag: str) -> dict[str, str]:
    """Attributes of a tag, the first of each name; character references are decoded."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(tag):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" and value else value).strip())
    return out


def alias_targets(url: str, html: str) -> list[str]:
    """Absolute urls that a page redirects to or names as canonical."""
    goals = []
    at, endless = 0, set()
    while found := next_tag(html, at):
        at, tag = found.end, found.name
        if tag in _HIDING and not found.closing and tag not in endless:
            end = _HIDING[tag].search(html, at)
            if end:
                at = end.end()
            else:
                endless.add(tag)
        if tag not in ("link", "meta") or found.closing:
            continue
        own = _attributes(found.attributes)
        if tag == "link":
            if "canonical" in own.get("rel", "").lower().split():
                goals.append(own.get("href", ""))
        elif own.get("http-equiv", "").lower() == "refresh":
            goal = _REFRESH.match(own.get("content", ""))
            goals.append(goal[1].strip("\"' ") if goal else "")
    out = []
    for goal in goals:
        try:
            whole = urljoin(url, goal) if goal and not goal.startswith("#") else ""
        except ValueError:  # such as a broken IPv6 host
            continue
        if "://" in whole:
            out.append(whole)
    return out


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = [(url, goal) for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist())
                 for goal in alias_targets(url, html)]
        a, b = zip(*pairs) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["a", "b"])


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and the url that it redirects to or names as canonical; distinct."""
    ship(pages.sparkSession)
    marked = (pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
              .filter(F.col("url").isNotNull() & F.col("html").rlike("(?i)canonical|http-equiv")))
    found = marked.mapInArrow(_targets, "a string, b string")
    return (found.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b"))
            .filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())


def equivalence(edges: DataFrame) -> DataFrame:
    """(url, class): every url in an edge and the smallest url of its class."""
    urls = edges.select(F.col("a").alias("url")).union(edges.select(F.col("b").alias("url"))).distinct()
    label = connected_components(edges, "a", "b").withColumnRenamed("node", "url")
    return urls.join(label, "url", "left").select("url", F.coalesce("component", "url").alias("class"))


def judge_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES,
               edges: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, alias_class) for each row of ``pages`` (page_id, url, html).

    ``edges`` (a, b) replaces the edges read from the pages.  A null url, or one
    without ``://``, has an empty host and path, no rule, no aliases and is
    allowed.  Null html has no edges.  Repeated rows get equal rows; the lowest
    and highest page_id play no role; other columns are ignored.  alias_class is
    null for a url without aliases.
    """
    edges = cut(alias_edges(pages) if edges is None else edges, "alias")
    classes = cut(equivalence(edges), "classes")
    own = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    decided = (classes.withColumn("_r", own).groupBy("class")
               .agg(F.max(F.when(F.col("_r.verdict") == "allow", 1).otherwise(0)).alias("allows"),
                    F.max(F.when(F.col("_r.verdict") == "block", 1).otherwise(0)).alias("blocks")))
    decided = cut(decided.select("class", F.when((F.col("allows") == 0) & (F.col("blocks") == 1), "block")
                                 .otherwise("allow").alias("inherited")), "decided")
    inherited = cut(classes.join(decided, "class").select(F.col("url").alias("node"), "class", "inherited"), "inherited")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    judged = (pages.select("page_id", "url").withColumn("host", host).withColumn("path", path)
              .withColumn("_r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("node", node_of(F.col("url"))))
    return (judged.join(inherited, "node", "left")
            .select("page_id", "host", "path", F.col("_r.rule").alias("rule"),
                    F.coalesce("_r.verdict", "inherited", F.lit("allow")).alias("verdict"),
                    F.col("class").alias("alias_class")))
