"""URL filters with redirect equivalence.

Block decisions spread over redirect and canonical-link aliases: pages and the targets they declare
are nodes of a graph, its connected components are computed in Spark, and a page without a rule of
its own is blocked when its component holds a blocked address and no explicitly allowed one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nestq.llm.common import components, cut, ready

#: (verdict, host, path)
DEFAULT_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without a ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null when none does.

    A rule fits its host and all subdomains when the path starts with the rule's. Ties in length go
    to allow, then to the rule's text.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in reversed(order):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """The form under which two spellings are one address: host, path and query, without scheme and fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.concat(host_of(url), path_of(url), query)


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("([^"]*)"|'([^']*)'|([^\s"'>]+))""", 1)
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def link_targets(html: Column) -> Column:
    """Array of the targets that a page declares: ``<link rel=canonical href>`` and ``<meta http-equiv=refresh>``.

    Only pages that hold one of these words are searched.
    """
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), F.lit(1))
    canonical = F.filter(tags, lambda t: t.rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"))
    refresh = F.filter(tags, lambda t: t.rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"))
    to = F.concat(
        F.transform(canonical, lambda t: _attribute(t, "href")),
        F.transform(refresh, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"\s]+)", 1)),
    )
    return F.when(html.rlike(r"(?i)canonical|http-equiv"), F.filter(to, lambda t: t != ""))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = DEFAULT_RULES,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """Verdicts for every row of ``pages`` (page_id, url, html).

    ``redirects`` may give more edges (``from_url``, ``to_url``), e.g. of a crawl's HTTP redirects.
    Returns page_id, host, path, rule, verdict, and ``alias_group`` (id of the group of addresses
    that redirect or name one another canonical; null for an address without aliases).

    Two addresses that differ in scheme or fragment only are one. Relative targets are
    resolved against the page's host when they start with ``/``; other relative targets are ignored.
    A null url, or one without ``://``, has empty host and path, fits no rule, has no aliases and is
    allowed. Null html declares nothing. Repeated rows are judged alike; further columns of
    ``pages`` are ignored. An empty table gives an empty result.
    """
    spark = ready(pages.sparkSession)
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(address(F.col("url"))).alias("node"))
    declared = pages.select("url", F.explode(link_targets(F.col("html"))).alias("target"))
    relative = F.col("target").startswith("/") & ~F.col("target").startswith("//")
    full = (
        F.when(relative, F.concat(F.lit("http://"), host_of(F.col("url")), F.col("target")))
        .when(F.col("target").startswith("//"), F.concat(F.lit("http:"), F.col("target")))
        .otherwise(F.col("target"))
    )
    links = declared.select("url", full.alias("target"))
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))
    ends = links.select(address(F.col("url")).alias("x"), address(F.col("target")).alias("y"))
    ends = cut(ends.where("x <> '' and y <> '' and x <> y").distinct(), "aliases")
    group = components(ends.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b")))

    names = ends.select("x").union(ends.select(F.col("y").alias("x"))).distinct()
    host, path = F.regexp_extract("x", r"(?s)^[^/?]*", 0), F.regexp_extract("x", r"(?s)^[^/?]*([^?]*)", 1)
    judged = names.select(F.xxhash64("x").alias("node"), best_rule(host, path, rules)["verdict"].alias("v"))
    held = judged.join(group.df, "node").groupBy("component")
    held = held.agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    verdict = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    decided = cut(held.select("component", verdict.alias("alias_verdict")), "decided")
    nodes = cut(group.df.join(decided, "component"), "alias_nodes")

    rule = best_rule(F.col("host"), F.col("path"), rules)
    known = own.withColumn("r", rule)
    return known.join(nodes, "node", "left").select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.col("alias_verdict"), F.lit("allow")).alias("verdict"),
        F.col("component").alias("alias_group"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return found.drop("alias_group")
