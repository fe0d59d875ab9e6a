"""URL rules with redirect equivalence: block decisions reach every alias of a blocked address.

DataFrame functions only: no Python runs in tasks.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.components import components
from metricloom.session import materialize

c = F.col
# Parameters that name a visit, not a page (fixed values).
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|msclkid)(=.*)?$"
MIRRORS = r"^(www|m|mobile|amp)\."  # host labels of mirrors of the same site (fixed values)
PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    raw = F.coalesce(F.regexp_extract(url, PATTERN, 1), F.lit(""))
    return F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, PATTERN, 2), F.lit(""))


def normal_form(url: Column) -> Column:
    """One name for addresses that sites redirect to each other: scheme, mirror host label,
    fragment, visit parameters, index file, ``.html`` and final slash do not count."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    plain = F.regexp_replace(path(url), r"(?i)(/index)?(\.html?)?/*$", "")
    name = F.concat_ws("?", F.concat(F.regexp_replace(host(url), MIRRORS, ""), plain), F.nullif(F.array_join(kept, "&"), F.lit("")))
    return F.when(F.coalesce(url, F.lit("")).contains("://"), name).otherwise(F.concat(F.lit("?"), F.coalesce(url, F.lit(""))))


def node(url: Column) -> Column:
    """128-bit name of the normal form, short enough to shuffle."""
    return F.md5(normal_form(url))


def resolve(link: Column, url: Column) -> Column:
    """Absolute address of ``link`` found on page ``url``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), host(url))
    folder = F.regexp_replace(path(url), r"[^/]*$", "")
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, target): canonical links and immediate redirects that pages declare."""
    text = F.coalesce(c(html), F.lit(""))
    tags = [
        F.transform(F.regexp_extract_all(text, F.lit(CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, HREF, 1)),
        F.transform(F.regexp_extract_all(text, F.lit(REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, REFRESH_URL, 1)),
    ]
    found = pages.select(c(url).alias("url"), F.explode(F.concat(*tags)).alias("link")).where("link <> '' and url is not null")
    return found.select("url", resolve(F.replace(c("link"), F.lit("&amp;"), F.lit("&")), c("url")).alias("target"))


def matched_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, rule, verdict) for every different host and path that a rule fits.

    Every host suffix is paired with every path prefix whose length some rule has, and the pairs
    meet the rules in an equi join; of several rules the longest wins, then the longer host. Only
    the set of different rule path lengths reaches the driver.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    labels = F.split(c("host"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = [F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]
    prefixes = F.array_compact(F.array(*fits)) if fits else F.array().cast("array<string>")
    candidates = (
        addresses.select("host", "path").distinct()
        .withColumn("rule_host", F.explode(suffixes))
        .withColumn("rule_path", F.explode(prefixes))
    )
    named = rules.select(c("host").alias("rule_host"), c("path").alias("rule_path"), "verdict").distinct()
    hits = candidates.join(named, ["rule_host", "rule_path"])
    rule = F.concat("rule_host", "rule_path")
    best = F.max(F.struct(F.length(rule), F.length("rule_host"), (c("verdict") == "allow").alias("allow"), rule.alias("rule"), "verdict"))
    return hits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``component`` and ``verdict``.

    ``rules`` has host, path and verdict (``allow`` or ``block``). A page's own longest rule
    decides. A page without a rule takes part in its component of aliases: addresses of one normal
    form, joined by the canonical links and redirects that pages declare. If any alias is explicitly
    allowed, or none is blocked, it is allowed; else it is blocked. Null and malformed urls have empty
    host and path and are aliases of nothing but themselves. Repeated pages get repeated rows; an
    empty table gives an empty result; existing columns of the five names are replaced.
    """
    names = ("host", "path", "rule", "component", "verdict")
    pages = pages.drop(*[x for x in names if x not in (url, html)])
    links = materialize(
        page_links(pages, url, html).select(
            node(c("url")).alias("a"), node(c("target")).alias("b"), host(c("target")).alias("host"), path(c("target")).alias("path")
        ),
        "url-links",
    )
    own = pages.select(node(c(url)).alias("node"), host(c(url)).alias("host"), path(c(url)).alias("path")).distinct()
    seen = materialize(own.union(links.select(c("b").alias("node"), "host", "path")).distinct(), "url-seen")
    found = materialize(matched_rules(seen, rules), "url-rules")
    flags = seen.join(found, ["host", "path"]).groupBy("node").agg(
        F.max(c("verdict") == "allow").alias("allow"), F.max(c("verdict") == "block").alias("block")
    )
    groups = components(links, name="url-components")
    flags = flags.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    decided = flags.groupBy("component").agg((F.max("block") & ~F.max("allow")).alias("blocked")).where("blocked")
    rest = [x for x in pages.columns if x != html]
    keyed = pages.select(*[c(f"`{x}`") for x in rest], node(c(url)).alias("_node"), host(c(url)).alias("host"), path(c(url)).alias("path"))
    out = (
        keyed.join(found, ["host", "path"], "left")
        .join(groups.withColumnRenamed("node", "_node"), "_node", "left")
        .withColumn("component", F.coalesce("component", "_node"))
        .join(decided, "component", "left")
    )
    verdict = F.coalesce("verdict", F.when(c("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(*[c(f"`{x}`") for x in rest], "host", "path", "rule", "component", verdict.alias("verdict"))
