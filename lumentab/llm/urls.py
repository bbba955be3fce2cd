"""URL filter with redirect equivalence.

Pages that redirect to each other, or name each other as canonical, are aliases.
Distributed connected components over those edges carry a block decision of one
alias to all others; an explicit allow of any alias takes precedence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumentab.llm.common import connected_components, written

# fixed values: verdict, host and path of the query's rules
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: parameters that do not change what a page holds
TRACKING = r"(?i)^(?:utm_[a-z]+|ref|gclid|fbclid|sessionid)(?:=|$)"


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; of equal lengths an allow wins.

    A rule fits its host, all subdomains, and paths that start with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow")):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def settled(url: Column) -> Column:
    """Where the usual redirects of a URL end.

    Scheme, a leading ``www.`` or ``m.``, fragment, tracking parameters, a
    trailing slash, ``index.html`` and ``.html`` do not make another page; other
    parameters do, in any order.
    """
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"(?:/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def link_targets(url: Column, html: Column) -> Column:
    """Absolute targets of canonical links and meta refreshes of a page."""
    body = F.coalesce(html, F.lit(""))
    tags = F.concat(
        F.when(body.rlike("(?i)canonical"), F.regexp_extract_all(
            body, F.lit(r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), F.lit(0))).otherwise(F.array().cast("array<string>")),
        F.when(body.rlike("(?i)http-equiv"), F.regexp_extract_all(
            body, F.lit(r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), F.lit(0))).otherwise(F.array().cast("array<string>")))
    named = F.transform(tags, lambda t: F.replace(F.regexp_extract(
        t, r"""(?i)(?:\bhref\s*=\s*["']?|\burl\s*=\s*["']?)\s*([^"'\s>;]+)""", 1), F.lit("&amp;"), F.lit("&")))
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return F.filter(F.transform(named, lambda h: F.when(h.contains("://"), h)
                                .when(h.startswith("//"), F.concat(F.lit("http:"), h))
                                .when(h.startswith("/"), F.concat(root, h))
                                .when(h != "", F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), h)).otherwise("")),
                    lambda h: h.contains("://"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None,
                page_id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, component.

    ``redirects`` may add known edges (``source``, ``target``) of absolute URLs.
    A rule decides its own pages.  Other pages follow their component: allow if
    any alias is allowed by a rule, else block if any is blocked, else allow.
    Targets that are no pages are aliases too and rules look at them as well.

    A null URL or one without ``://`` has no host, no rule and no aliases, and is
    allowed; null html has no links; repeated rows are judged alike; other
    columns are not looked at.  ``rules`` is a hand-written list that becomes an
    expression; edges, components and decisions stay distributed, and every join
    is one on a URL or a component, whose hot keys the session may split.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                        (F.col(html) if html else F.lit(None).cast("string")).alias("html"))
    linked = base.where(F.col("url").contains("://")).select("url", link_targets(F.col("url"), F.col("html")).alias("to"))
    direct = linked.where(F.size("to") > 0).select("url", F.explode("to").alias("target")).distinct()
    if redirects is not None:
        direct = direct.union(redirects.select(F.col("source"), F.col("target")).where(
            F.col("source").contains("://") & F.col("target").contains("://"))).distinct()
    known = linked.select("url").union(direct.select("url")).union(direct.select("target")).distinct()
    urls = written(known.select("url", settled(F.col("url")).alias("s"), rule_for(
        host_of(F.col("url")), path_of(F.col("url")), rules).alias("r")), "urls")
    # a node of the graph is a settled address, so the many spellings of one page meet without a round
    ends = direct.select(settled(F.col("url")).alias("u"), settled(F.col("target")).alias("v"))
    spelled = urls.select(F.concat(F.lit("="), "url").alias("u"), F.col("s").alias("v"))
    parts = connected_components(ends.union(spelled))
    placed = urls.join(parts, urls["s"] == parts["node"]).select("url", "r", "component")
    verdicts = placed.groupBy("component").agg(F.max(F.col("r.verdict") == "allow").alias("allowed"),
                                               F.max(F.col("r.verdict") == "block").alias("blocked"))
    judged = placed.join(verdicts, "component").select(
        F.col("url").alias("known"), "component", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").otherwise("allow").alias("method"))
    out = base.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.withColumn("r", rule_for(F.col("host"), F.col("path"), rules))
    return out.join(judged, out["url"] == judged["known"], "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.col("method"), F.lit("allow")).alias("verdict"), "component")


def keep_allowed(pages: DataFrame, url: str = "url", **options) -> DataFrame:
    """``pages`` that are not blocked, columns as they are; decisions are taken once per distinct URL."""
    judged = filter_urls(pages, url=url, page_id=url, **options).where("verdict = 'block'").select(F.col("page_id").alias("__url")).distinct()
    return pages.join(judged, pages[url] == judged["__url"], "left_anti")


def op5(pages: DataFrame) -> DataFrame:
    return filter_urls(pages)
