"""URL filter with redirect equivalence, in DataFrame and SQL functions only.

A rule decides the URLs that it fits. Pages that no rule fits take the decision of their aliases: pages and link targets
are nodes, redirects and canonical links edges, and in a component with a blocked member all undecided members are
blocked, unless a member is explicitly allowed, which takes precedence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barwright.llm.components import connected_components
from barwright.plans.shared import stage


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``; ``allow`` or else block."""

    allow: bool
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query, fixed values.
RULES = (Rule(True, "org", "/"), Rule(False, "example.org", "/es/"), Rule(False, "example.org", "/en/1"), Rule(True, "com", "/fr/"), Rule(False, "com", "/de/"))
#: Rules that are written into the plan; more are a table that pages are joined with.
PLAN_RULES = 500
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that do not change the page.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"
_LINK = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path after the first ``://``; both empty for null and where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def decision(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule that fits, as (rule, allow); null if none does. Of equally long ones allow comes first."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), not r.allow, r.name))
    out = F.lit(None).cast("struct<rule:string,allow:boolean>")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


def decided_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(url)`` with the rule that fits each, as (url, d), d null if none does: the same decision over a table of rules.

    A host's suffixes, as many labels as a rule's host has at most, meet the rules' hosts; of a host with rules
    the lengths of their paths say which prefixes of a page's path to look up. All joins are on equal keys.
    """
    host, path = host_and_path(F.col("url"))
    urls = urls.where("url is not null").distinct().select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    rules = rules.selectExpr("allow", "host as rule_host", "path as prefix").where("allow is not null and rule_host is not null and prefix is not null").distinct()
    labels = rules.agg(F.max(F.size(F.split("rule_host", r"\."))).alias("n")).first()["n"] or 0
    parts = F.slice(F.split("host", r"\."), -F.least(F.lit(labels), F.size(F.split("host", r"\."))), labels) if labels else F.array()
    suffixes = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", i, F.size("parts")), "."))
    named = urls.withColumn("parts", parts).where("size(parts) > 0").withColumn("rule_host", F.explode(suffixes))
    lengths = rules.groupBy("rule_host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    near = named.join(lengths, "rule_host").withColumn("n", F.explode("lengths")).where("n <= length(path)").select("url", "rule_host", F.expr("substring(path, 1, n)").alias("prefix"))
    fits = near.join(rules, ["rule_host", "prefix"]).withColumn("rule", F.concat("rule_host", "prefix"))
    first = F.struct(F.length("rule"), F.col("allow"))
    # (of equally long rules with one decision the first by name, as in a plan)
    best = fits.groupBy("url").agg(F.max(first).alias("m"), F.collect_set(F.struct(first.alias("o"), "rule")).alias("all"))
    rule = F.array_min(F.transform(F.filter("all", lambda x: x["o"] == F.col("m")), lambda x: x["rule"]))
    return best.select("url", F.struct(rule.alias("rule"), F.col("m.allow").alias("allow")).alias("d"))


def node(url: Column) -> Column:
    """The key of a page: host, path without a last slash, and the parameters that are not for tracking; no scheme, no fragment."""
    host, path = host_and_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^(?:{TRACKING})(?:=|$)")), "&")
    key = F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host != "", key)


def _absolute(target: Column, url: Column) -> Column:
    """A link target seen from a page."""
    target = F.replace(target, F.lit("&amp;"), F.lit("&"))
    host, path = host_and_path(url)
    scheme = F.coalesce(F.regexp_extract(url, r"^([^:]*)://", 1), F.lit("http"))
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(root, F.lit("/"), F.regexp_extract(path, r"^/?(.*/)?[^/]*$", 1), target))
    )


def links(pages: DataFrame) -> DataFrame:
    """Canonical links and immediate redirects in ``pages(url, html)``, as (source, target) URLs."""
    html = F.coalesce("html", F.lit(""))
    canonical = F.transform(F.regexp_extract_all(html, F.lit(_LINK), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1))
    refresh = F.transform(F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, _URL, 1))
    found = pages.select("url", F.explode(F.concat(canonical, refresh)).alias("target")).where("target <> '' and url is not null")
    return found.select(F.col("url").alias("source"), _absolute(F.col("target"), F.col("url")).alias("target"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES, redirects: DataFrame | None = None, default: str = "allow") -> DataFrame:
    """One row per row of ``pages(page_id, url, html)``: page_id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of equally long ones an
    allowing one. ``rules`` may be a table (allow, host, path) of any size; up to ``PLAN_RULES`` rules are written into the plan,
    more are joined. Pages without a rule are judged by their aliases (see above), which are found over canonical links and
    immediate redirects in ``html`` and the optional table ``redirects(source, target)``; URLs that differ in scheme,
    fragment, a last slash or tracking parameters are one node. Link targets that are no page are judged by the rules
    as well and pass decisions on. What nothing decides gets ``default``.

    A null url, or one without ``://``, has empty host and path, fits no rule, has no alias and gets ``default``. Null
    html has no links; urls and html of any length are read whole. Repeated rows and null page_ids are rows like any
    other; other columns are not looked at. No rows give no rows.
    """
    pages = pages.select("page_id", "url", "html")
    if isinstance(rules, DataFrame):
        few = rules.select("allow", "host", "path").dropna().distinct().limit(PLAN_RULES + 1).collect()
        table, listed = rules, [Rule(r["allow"], r["host"], r["path"]) for r in few]
    else:
        listed, table = list(rules), None
    if len(listed) > PLAN_RULES and table is None:
        table = pages.sparkSession.createDataFrame([(r.allow, r.host, r.path) for r in listed], "allow boolean, host string, path string")

    def with_decision(df: DataFrame, url: str) -> DataFrame:
        h, p = host_and_path(F.col(url))
        if len(listed) <= PLAN_RULES:
            return df.withColumn("d", decision(h, p, listed))
        found = stage(decided_by_table(df.select(F.col(url).alias("url")), table), "decided")
        return df.join(found.withColumnRenamed("url", url), url, "left")

    host, path = host_and_path(F.col("url"))
    judged = with_decision(pages.select("page_id", "url"), "url").select("page_id", host.alias("host"), path.alias("path"), node(F.col("url")).alias("node"), "d")
    edges = links(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = stage(edges.distinct(), "links")

    def decided(url: str, df: DataFrame) -> DataFrame:
        return with_decision(df.select(url), url).select(node(F.col(url)).alias("node"), F.col("d.allow").alias("allow"))

    nodes = judged.select("node", F.col("d.allow").alias("allow")).union(decided("source", edges)).union(decided("target", edges)).where("node is not null")
    nodes = nodes.groupBy("node").agg(F.max("allow").alias("allow"), F.max(~F.col("allow")).alias("block"))
    labels = connected_components(edges.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")))
    grouped = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    # only components that decide something are kept: allow if a member is, else block
    said = grouped.groupBy("label").agg(F.max("allow").alias("allow"), F.max("block").alias("block")).where("allow or block")
    said = grouped.select("node", "label").join(said.select("label", F.coalesce("allow", F.lit(False)).alias("alias_allow")), "label").select("node", "alias_allow")
    out = judged.join(said, "node", "left")
    allow = F.coalesce(F.col("d.allow"), F.col("alias_allow"))
    return out.select("page_id", "host", "path", F.col("d.rule").alias("rule"), F.when(allow, "allow").when(~allow, "block").otherwise(default).alias("verdict"))
