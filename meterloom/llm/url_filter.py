"""URL rules, and block decisions carried over to URLs that redirect to each other."""

from __future__ import annotations

import html
import re
import string
from collections.abc import Iterator, Sequence
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .components import connected_components

#: Host and rest of the path after the first ``://``.
_PARTS = r"://([^/?#]*)([^?#]*)"
_QUERY = r"://[^/?#]*[^?#]*(\?[^#]*)"
#: Elements that hold links (a ">" inside quotes ends none), their attributes, and the target in a refresh.
_ELEMENT = re.compile(r"""<(link|meta)\b((?:"[^"<]*"|'[^'<]*'|[^>])*+)""", re.I)
#: A name starts where no name character stands before it and is taken whole, so a long run of letters is read once.
_ATTRIBUTE = re.compile(r"""(?<![\w:-])([\w:-]++)\s*=\s*(?:"([^"]*)"|'([^']*)'|["']?([^"'\s>]+))""")
_REFRESH = re.compile(r"""\burl\s*=\s*["']?([^"'\s>]+)""", re.I)


def links_of(url: str, text: str) -> list[str]:
    """The absolute targets of all canonical links and refreshes in a page. Relative ones need a URL with ``://``."""
    out = []
    for kind, rest in _ELEMENT.findall(text):
        own = {}
        for name, *values in _ATTRIBUTE.findall(rest):
            own.setdefault(name.lower(), html.unescape("".join(values)).strip())
        if kind.lower() == "link":
            target = own.get("href") if "canonical" in own.get("rel", "").lower().split() else None
        else:
            found = _REFRESH.search(own.get("content", "")) if own.get("http-equiv", "").lower() == "refresh" else None
            target = found and found[1]
        if not target:
            continue
        if "://" in url and not re.match(r"[A-Za-z][\w+.-]*:", target):
            try:
                # schemes make no difference to what a URL is here, and urljoin knows this one
                target = urljoin("http" + url[url.index("://") :], target)
            except ValueError:
                continue
        if "://" in target:
            out.append(target)
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """What makes two URLs one: host, path and query, not scheme or fragment. Null without host."""
    node = F.concat(host_of(url), path_of(url), F.coalesce(F.regexp_extract(url, _QUERY, 1), F.lit("")))
    return F.when(host_of(url) != "", node)


def links_in_pages(pages: DataFrame) -> DataFrame:
    """``a, b``: the URL of each page and the absolute URL of each canonical link and refresh in it."""
    c = F.col
    rows = pages.select(c("url").cast("string").alias("a"), c("html").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(x, b) for x, text in zip(*(batch.column(i).to_pylist() for i in (0, 1))) for b in links_of(x, text)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["a", "b"])

    return rows.where(c("a").isNotNull() & c("html").rlike("(?i)canonical|refresh|&#")).mapInArrow(run, "a string, b string")


def _ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` for those ``host, path`` that a rule fits: the longest, of these an allowing one."""
    c = F.col
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = urls.where(c("host") != "").distinct().withColumn("rule_host", F.explode(suffixes)).join(rules, "rule_host").where(c("path").startswith(c("rule_path")))
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("n"), (c("rule_verdict") == "allow").alias("allowed"), rule.alias("rule"), c("rule_verdict").alias("verdict")))
    return fits.groupBy("host", "path").agg(best.alias("r")).select("host", "path", "r.rule", "r.verdict")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Per row of ``pages`` (``page_id, url, html``): ``page_id, host, path, rule, verdict, by_alias``.

    ``rules`` are (host, path, allow or block); a rule fits its host and all subdomains if the path
    starts with the rule's. The longest that fits decides. Where none fits, a URL is blocked if any URL
    is blocked by its own rule to which redirects (``a, b``) and canonical links connect it, over any number of
    steps; else it is allowed. So an explicit allow outranks the blocks of its aliases, and does not spread.

    Null URLs and those without ``://`` have empty host and path, no rule, no aliases, and are allowed. Hosts are
    joined by their suffixes, so the number of rules is not limited. Rows that repeat a page are judged each.
    Other columns are not read. An empty table gives no rows.
    """
    spark, c = pages.sparkSession, F.col
    fields = "rule_host string, rule_path string, rule_verdict string"
    rules = rules.toDF("rule_host", "rule_path", "rule_verdict") if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), fields)
    url = c("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"))
    links = links_in_pages(pages)
    if redirects is not None:
        links = links.union(redirects.select("a", "b"))
    scratch = Scratch(spark, "urls")
    links = scratch.keep(links.select("a", "b", node_of(c("a")).alias("u"), node_of(c("b")).alias("v")))
    ends = [links.select(host_of(c(x)).alias("host"), path_of(c(x)).alias("path"), c(n).alias("node")) for x, n in (("a", "u"), ("b", "v"))]
    ends = ends[0].union(ends[1]).where(c("node").isNotNull()).distinct()
    own = scratch.keep(_ruled(rows.select("host", "path").union(ends.select("host", "path")), rules))
    parts = connected_components(links, "u", "v")
    blocked = ends.join(own.where(c("verdict") == "block"), ["host", "path"]).select("node").distinct()
    bad = parts.join(blocked, "node", "left_semi").select("component").distinct()
    aliases = parts.join(bad, "component", "left_semi").select("node").withColumn("alias", F.lit(True))
    judged = rows.join(own, ["host", "path"], "left").join(aliases, "node", "left")
    by_alias = c("verdict").isNull() & F.coalesce("alias", F.lit(False))
    verdict = F.when(by_alias, F.lit("block")).otherwise(F.coalesce("verdict", F.lit("allow")))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), by_alias.alias("by_alias"))
