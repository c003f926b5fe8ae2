"""URL rules whose block decisions spread over redirect and canonical-link equivalence (DataFrame functions only)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

#: (host, path prefix, decision)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_AFTER = r"^[\s\S]*?://"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): the host ends at the first ``/ ? #``; the path at the first ``? #``. Without ``://`` both are empty."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_replace(url, _AFTER, "")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, lower_ascii(host)).otherwise(""), F.when(has, path).otherwise("")


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule text, decision) of the longest rule that fits, else nulls. A rule fits its host, all subdomains, and paths that start with its own."""
    found, decision = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        found = F.when(fits, F.lit(rule_host + prefix)).otherwise(found)
        decision = F.when(fits, F.lit(verdict)).otherwise(decision)
    return found, decision


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Equivalence edges ``a, b`` between urls.

    * canonical: ``<link rel=canonical href=...>`` of the page;
    * redirect: ``<meta http-equiv=refresh content="0; url=...">``;
    * address variants that servers redirect to one address: scheme, ``www.``
      or ``m.``, fragment, query, ``.html`` and a closing slash.

    Links are resolved against the page's own address: ``//host/x``, ``/x``,
    ``?q``, ``x``, ``./x`` and ``../x``, of the latter as many as there are; a
    link of a page without ``://`` only if it is a whole address. A null url
    has no edges, a null html only its address variant, a url without ``://``
    has none.
    """
    at = F.col(url)
    origin, scheme = F.regexp_extract(at, r"^([\s\S]*?://[^/?#]*)", 1), F.regexp_extract(at, r"^([\s\S]*?:)//", 1)
    rel = F.regexp_extract(html, r"""(?i)<link\b[^>]*?\brel\s*=\s*["']?canonical\b[^>]*>""", 0)
    meta = F.regexp_extract(html, r"""(?i)<meta\b[^>]*?\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0)
    links = F.array(
        F.regexp_extract(rel, r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)""", 1),
        F.regexp_extract(meta, r"""(?i)\burl\s*=\s*["']?([^"'\s>;]+)""", 1),
    )
    host, path = url_parts(at)
    plain = F.concat(F.lit("page://"), F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))
    # only a url with a host has an address to vary: one without would be joined with all others
    variant = F.when((host != "") & (F.instr(at, "://") > 0), plain).otherwise("")
    whole = F.regexp_extract(at, r"^([^?#]*)", 1)
    tagged = pages.select(at.alias("a"), origin.alias("origin"), scheme.alias("scheme"), whole.alias("whole"), path.alias("path"), F.explode(F.array_append(links, variant)).alias("link"))
    tagged = tagged.where("a IS NOT NULL AND link <> ''")
    link, based = F.col("link"), F.instr("a", "://") > 0
    ups = F.length(F.regexp_extract(link, r"^((?:\.\./)*)", 1)) / 3
    # the folders of the path that are left when each ../ has gone up one
    folders = F.filter(F.split(F.regexp_extract("path", r"^((?:.*/)?)", 1), "/"), lambda x: x != "")
    left = F.slice(folders, 1, F.greatest(F.size(folders) - ups.cast("int"), F.lit(0)))
    folder = F.concat(F.col("origin"), F.lit("/"), F.when(F.size(left) > 0, F.concat(F.array_join(left, "/"), F.lit("/"))).otherwise(""))
    b = (
        F.when(link.startswith("//"), F.when(based, F.concat("scheme", "link")))
        .when(link.startswith("/"), F.when(based, F.concat("origin", "link")))
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.when(F.instr("link", "://") > 0, link))
        .when(F.instr("link", "://") > 0, link)
        .when(link.startswith("#"), F.lit(None).cast("string"))
        .when(link.startswith("?"), F.when(based, F.concat("whole", "link")))
        .when(based, F.concat(folder, F.regexp_replace(link, r"^(?:\./|(?:\.\./)+)", "")))
    )
    return tagged.select("a", b.alias("b")).where("b IS NOT NULL AND a <> b").distinct()


def judge_pages(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow", page_id: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Verdict of every page, one row per input row: ``page_id, host, path, rule, verdict, alias_verdict``.

    A page with a rule of its own gets that rule's decision. Any other page gets
    its equivalence class's (connected components over ``link_edges``): allow if
    a member is explicitly allowed, else block if one is explicitly blocked,
    else ``default``. Null urls, and urls without ``://``, have empty host and
    path and the default. Repeated rows agree; an empty table gives no rows;
    other columns are ignored.
    """
    base = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    host, path = url_parts(F.col("url"))
    labels = connected_components(link_edges(base))
    judged = base.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, own = match_rule(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "own": own})
    members = judged.where("own IS NOT NULL").select(F.col("url").alias("node"), "own")
    classes = (
        members.join(labels, "node")
        .groupBy("label")
        .agg(F.max(F.when(F.col("own") == "allow", 1).otherwise(0)).alias("allowed"))
        .select("label", F.when(F.col("allowed") == 1, F.lit("allow")).otherwise("block").alias("alias_verdict"))
    )
    spread = labels.join(classes, "label").select(F.col("node").alias("url"), "alias_verdict")
    return judged.join(spread, "url", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("own", "alias_verdict", F.lit(default)).alias("verdict"), "alias_verdict"
    )
