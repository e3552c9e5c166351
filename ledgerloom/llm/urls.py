"""URL filters with redirect equivalence.

Rules allow or block a host with its subdomains and a path prefix; the longest rule that fits a URL decides. Pages tell of redirects and
of canonical links; these edges make URLs aliases, found as connected components over all pages. A URL that no rule fits takes over from
its aliases: allow if any alias is allowed by a rule (allow takes precedence), else block if any is blocked by a rule, else allow. A
rule that fits the URL itself always decides, so an allowed URL stays allowed whatever its aliases are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import components, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest fitting rule as a struct (text, verdict), or null. Of rules of one length the first in alphabetical order wins."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute URL without its fragment, relative to the URL of its page; null if empty."""
    link = F.regexp_replace(F.trim(link), r"(?s)#.*$", "")
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    return (
        F.when(link == "", F.lit(None))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def same_case(url: Column) -> Column:
    """A URL with A-Z of its scheme and host in lower case, as rules compare hosts; unchanged without ://."""
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.concat(F.translate(site, UPPER, LOWER), F.substring(url, F.length(site) + 1, F.length(url)))


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) of all canonical links and redirects by meta refresh, as URLs without fragments."""
    tag = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
    refresh = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[0-9.]+\s*[;,]\s*url\s*=\s*["']?\s*([^"'\s>]+)"""
    page = pages.select(F.col(url).alias("u"), F.col(html).alias("h")).filter(F.col("u").isNotNull() & F.col("h").isNotNull())
    page = page.filter(F.col("h").rlike(r"(?i)canonical|http-equiv"))
    found = page.select("u", F.explode(F.concat(*(F.regexp_extract_all("h", F.lit(x), 1) for x in (tag, refresh)))).alias("link")).filter("link <> ''")
    return found.select(F.regexp_replace("u", r"(?s)#.*$", "").alias("src"), resolved(F.col("u"), F.col("link")).alias("dst")).filter("dst is not null")


def judge(pages: DataFrame, rules: list[Rule], redirects: DataFrame | None = None, url: str = "url", html: str | None = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of ``pages`` that have those names are replaced.

    redirects: more edges (src, dst) of URLs. Null URLs and URLs without :// have an empty host and path, fit no rule, have no aliases
    and are allowed. Null, empty and very long html is read like any other; an empty table gives an empty result. Repeated rows are judged alike. Decisions travel along edges by joins on URLs, of which only those with an edge take part.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, place = unused("__rule", pages), unused("__url", pages)
    given = unused("inherited", pages)
    judged = pages.select(*kept, host.alias("host"), path.alias("path")).withColumn(rule, rule_of(F.col("host"), F.col("path"), rules))
    edges = alias_edges(pages, url, html) if html else None
    if redirects is not None:
        clean = redirects.select(*(F.regexp_replace(c, r"(?s)#.*$", "").alias(c) for c in ("src", "dst")))
        edges = clean if edges is None else edges.unionByName(clean)
    if edges is not None:
        edges = edges.select(*(same_case(F.col(c)).alias(c) for c in ("src", "dst")))
    if edges is None:
        return judged.select(*kept, "host", "path", F.col(f"{rule}.text").alias("rule"), F.coalesce(f"{rule}.verdict", F.lit("allow")).alias("verdict"))
    alias = components(edges)
    own = alias.select("id", "component", rule_of(host_of(F.col("id")), path_of(F.col("id")), rules).verdict.alias("v"))
    group = own.groupBy("component").agg(F.when(F.max(F.col("v") == "allow"), "allow").when(F.max(F.col("v") == "block"), "block").otherwise("allow").alias("inherited"))
    moved = own.join(group, "component").filter("inherited = 'block'").select(F.col("id").alias(place), F.col("inherited").alias(given))
    judged = judged.withColumn(place, F.when(F.col(url).contains("://"), same_case(F.regexp_replace(url, r"(?s)#.*$", ""))))
    return judged.join(moved, place, "left").select(*kept, "host", "path", F.col(f"{rule}.text").alias("rule"), F.coalesce(f"{rule}.verdict", given, F.lit("allow")).alias("verdict"))
