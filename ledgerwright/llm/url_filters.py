"""URL block rules that follow redirects.

Rules judge a URL by host and path. A URL without a rule takes the decision of its
aliases: all URLs connected by redirect and canonical-link edges form a component, and a
component that holds a blocked URL blocks its other members, unless it also holds a URL
that a rule allows by name - an explicit allow takes precedence.

Only DataFrame functions are used. Rules are matched on distinct URLs alone where a URL
is a graph node; pages meet the graph's decisions in one join on the URL, of which the
other side holds only the URLs blocked through aliases.

Defined cases: a null URL, or one without `://`, has empty host and path, fits no rule
and is allowed. Links that are null, empty or not absolute make no edge. Repeated pages
are judged one by one; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwright.llm.components import components
from ledgerwright.session import freeze

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_REL_FIRST = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*\bhref\s*=\s*["']([^"']+)["']"""
_HREF_FIRST = r"""(?is)<link\b[^>]*\bhref\s*=\s*["']([^"']+)["'][^>]*\brel\s*=\s*["']?canonical\b"""
_REFRESH = r"""(?is)<meta\b[^>]*http-equiv\s*=\s*["']?refresh\b[^>]*\burl\s*=\s*([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct `name, verdict` of the longest rule that fits, null without one."""
    chosen = F.lit(None).cast("struct<name:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value).otherwise(chosen)
    return chosen


def canonical_form(url: Column) -> Column:
    """Where a site sends the usual variants of an address: https, no `www.` or `m.`
    label, no fragment, no query, no closing slash and no `.html`."""
    host = F.regexp_replace(host_of(url), r"^(www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(\.html|/)$", "")
    return F.concat(F.lit("https://"), host, path)


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges `src, dst` that the pages themselves state or imply.

    The canonical link, an immediate refresh, and the redirect of a URL variant to its
    canonical form. An address from the root is completed with the page's host.
    """
    here = pages[url]
    body = F.coalesce(pages[html], F.lit(""))
    stated = F.array(
        F.regexp_extract(body, _REL_FIRST, 1),
        F.regexp_extract(body, _HREF_FIRST, 1),
        F.regexp_extract(body, _REFRESH, 1),
    )
    site = F.regexp_extract(F.coalesce(here, F.lit("")), r"(?s)^(.*?://[^/?#]*)", 1)
    whole = F.transform(
        stated, lambda x: F.when(x.startswith("/") & ~x.startswith("//"), F.concat(site, x)).otherwise(x)
    )
    targets = F.concat(whole, F.array(canonical_form(here)))
    return (
        pages.filter(F.contains(here, F.lit("://")))
        .select(here.alias("src"), F.explode(targets).alias("dst"))
        .filter(F.contains("dst", F.lit("://")))
        .distinct()
    )


def alias_blocks(links: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """`url` of every node without a rule that its component blocks; distinct."""
    nodes = freeze(components(links, "src", "dst"), "aliases")
    ruled = nodes.withColumn(
        "_rule", rule_for(host_of(F.col("node")), path_of(F.col("node")), rules)
    )
    decided = freeze(
        ruled.groupBy("component")
        .agg(
            F.max((F.col("_rule.verdict") == "block").cast("int")).alias("blocks"),
            F.max((F.col("_rule.verdict") == "allow").cast("int")).alias("allows"),
        )
        .filter("blocks = 1 and allows = 0")
        .select("component"),
        "blocked",
    )
    return (
        ruled.filter("_rule is null")
        .join(decided, "component", "left_semi")
        .select(F.col("node").alias("url"))
    )


def judge(
    pages: DataFrame,
    links: DataFrame,
    rules: Sequence[Rule] = RULES,
    key: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """`key, host, path, rule, verdict` of every page; `links` has columns src and dst."""
    blocked = freeze(alias_blocks(links, rules), "alias-blocks").select(
        F.col("url").alias("_alias"), F.lit(True).alias("_blocked")
    )
    address = pages[url]
    ruled = pages.select(
        key,
        address.alias("_url"),
        host_of(address).alias("host"),
        path_of(address).alias("path"),
    ).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    return ruled.join(
        blocked, (F.col("_url") == F.col("_alias")) & F.col("_rule").isNull(), "left"
    ).select(
        key,
        "host",
        "path",
        F.col("_rule.name").alias("rule"),
        F.coalesce(
            F.col("_rule.verdict"), F.when(F.col("_blocked"), "block").otherwise("allow")
        ).alias("verdict"),
    )
