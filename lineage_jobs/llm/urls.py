"""URL rules whose decisions spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lineage_jobs.components import connected_components
from lineage_jobs.runtime import broadcast_if_small, materialize, spread_join

#: Rules, and rules of hosts, up to which their tables are broadcast, at some 100 bytes each.
MAX_RULES = 100_000


def url_host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url):
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url):
    """What two spellings of one address share: host, path and query; no scheme, no fragment. Null without a host."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    path = F.when(url_path(url) == "", F.lit("/")).otherwise(url_path(url))
    return F.when(url_host(url) != "", F.concat(url_host(url), path, query))


def _rule_table(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """``(rule_host, starts)``: for each host that rules name the starts of paths, the longest first, with their rules and
    verdicts. Of a rule that is given twice the last verdict stands."""
    hosts: dict[str, list] = {}
    for rule, verdict in dict(rules).items():
        name, _, start = rule.partition("/")
        hosts.setdefault(name, []).append(("/" + start, rule, verdict))
    rows = [(name, sorted(found, key=lambda x: (-len(x[0]), x[0]))) for name, found in sorted(hosts.items())]
    return spark.createDataFrame(rows, "rule_host string, starts array<struct<start:string,rule:string,verdict:string>>")


def with_rule(rows: DataFrame, host: str, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """``rows`` with ``hit``, a ``struct(rule, verdict)`` of the longest rule that fits, or null.

    A rule ``host/path`` fits its host and all subdomains where the url's path starts with ``/path``. The distinct hosts
    are joined with the rules by each of their suffixes; the rows, with the rules of their hosts, whose number is
    checked before they are broadcast.
    """
    parts = F.split("rule_for", r"\.")
    suffix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), ".")))
    hosts = rows.select(F.col(host).alias("rule_for")).where("rule_for <> ''").distinct()
    table = broadcast_if_small(_rule_table(rows.sparkSession, rules), len(rules), MAX_RULES)
    known = materialize(
        hosts.select("rule_for", suffix.alias("rule_host")).join(table, "rule_host").groupBy("rule_for").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    )
    named = rows.withColumn("rule_for", F.when(F.col(host) != "", F.col(host)))
    entries = known.agg(F.sum(F.size("starts"))).head()[0] or 0
    joined = named.join(F.broadcast(known), "rule_for", "left") if entries <= MAX_RULES else spread_join(materialize(named), known, "rule_for", "left")
    longest = F.aggregate(
        F.filter("starts", lambda s: F.startswith(F.col(path), s["start"])), F.lit(None).cast("struct<start:string,rule:string,verdict:string>"),
        lambda best, x: F.when(best.isNull() | (F.length(x["rule"]) > F.length(best["rule"])), x).otherwise(best),
    )
    return joined.withColumn("hit", longest).withColumn("hit", F.when(F.col("hit").isNotNull(), F.struct("hit.rule", "hit.verdict"))).drop("starts", "rule_for")


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` address keys: each page to the targets that its HTML names as the same page.

    Read are ``<link rel="canonical">`` and ``<meta http-equiv="refresh">``; a target may be absolute, start with ``//``
    (the page's scheme) or ``/`` (its host), or be relative to the page's directory (``./`` at its start is dropped, ``..``
    isn't followed). A page without any gives no row.
    """
    tags = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:link|meta)\b[^>]*+>"), F.lit(0))
    same = F.filter(
        tags,
        lambda t: t.rlike(r"""(?is)\brel\s*=\s*["']?canonical\b""") | t.rlike(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""),
    )
    target = F.explode(
        F.transform(same, lambda t: F.regexp_extract(t, r"""(?is)\b(?:href\s*=\s*["']?|url\s*=\s*'?)([^"'\s>]+)""", 1))
    )
    page = F.regexp_extract("url", r"(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract(url_path(F.col("url")), r"(?s)^(.*/)", 1)
    absolute = (
        F.when(F.col("target").rlike(r"(?i)^https?://"), F.col("target"))
        .when(F.col("target").rlike(r"(?i)^[a-z][a-z0-9+.-]*:") | (F.col("target") == ""), None)
        .when(F.startswith("target", F.lit("//")), F.concat(F.lit("x:"), "target"))
        .when(F.startswith("target", F.lit("/")), F.concat(page, "target"))
        .otherwise(F.concat(page, F.when(folder == "", F.lit("/")).otherwise(folder), F.regexp_replace("target", r"^(?:\./)+", "")))
    )
    named = F.col(html).rlike(r"(?i)canonical|http-equiv")
    return (
        pages.where(named)
        .select(F.col(url).alias("url"), target.alias("target"))
        .select("url", absolute.alias("target"))
        .select(url_key(F.col("url")).alias("src"), url_key(F.col("target")).alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
    )


def url_verdicts(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    edges: DataFrame | None = None,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, alias_of)``, one row for each page.

    A page that a rule fits gets the longest rule's verdict. The others get that of their aliases: pages and named
    targets are joined by redirect and canonical links (``edges``, address keys; by default :func:`link_edges`),
    and each connected component in which a rule allows some address is allowed, else one in which a rule blocks
    some address is blocked; an address without either is allowed. ``alias_of`` names the component, null if there
    is none. Null or hostless urls have an empty host and path, no rule, and are allowed. Repeated rows stay.
    """
    edges = link_edges(pages, url, html) if edges is None else edges
    members = connected_components(edges)
    named = members.select("component", url_host(F.concat(F.lit("x://"), "node")).alias("host"), url_path(F.concat(F.lit("x://"), "node")).alias("path"))
    spread = (
        with_rule(named, "host", "path", rules)
        .select("component", F.col("hit.verdict").alias("hit"))
        .groupBy("component")
        .agg(F.max(F.col("hit") == "allow").alias("allowed"), F.max(F.col("hit") == "block").alias("blocked"))
    )
    aliases = members.join(spread, "component").select(
        F.col("node").alias("key"),
        F.col("component").alias("alias_of"),
        F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("spread"),
    )
    judged = pages.select(
        F.col(page_id).alias("page_id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), url_key(F.col(url)).alias("key")
    )
    judged = with_rule(judged, "host", "path", rules)
    return judged.join(aliases, "key", "left").select(
        "page_id",
        "host",
        "path",
        F.col("hit.rule").alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.col("spread"), F.lit("allow")).alias("verdict"),
        "alias_of",
    )
