"""URL filters with redirect equivalence.

Rules judge a url by host and path. Urls that redirect to each other, or that
name one another as canonical, are aliases: connected components over those links
carry a block to every alias. A rule of the url's own comes first, so that an
explicit allow holds whatever its aliases are.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.components import connected
from quarry.llm.shared import ascii_lower, materialize

@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules that op3 states.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: tuple[Rule, ...] | DataFrame) -> DataFrame:
    """(verdict, host, path) of rules given as such, or as a table of any size."""
    if isinstance(rules, DataFrame):
        return rules.select("verdict", "host", "path").filter("verdict IS NOT NULL AND host IS NOT NULL AND path IS NOT NULL").distinct()
    of = {k: pa.array([getattr(r, k) for r in rules], pa.string()) for k in ("verdict", "host", "path")}
    return spark.createDataFrame(pa.table(of)).distinct()


def best_rules(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule and verdict of every distinct (host, path) of sites that a rule
    fits: the longest rule, of equally long ones the last by code point.

    Each parent domain of a host meets the lengths that the paths of its rules have,
    and then, by a prefix of the path of each such length, the rules themselves. All
    joins are of equal keys, so the work for a site follows the depth of its host and
    those lengths, not the number of rules; Spark broadcasts rules that are small."""
    sites = sites.select("host", "path").filter("host <> ''").distinct()
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lengths = rules.select(F.col("host").alias("parent"), F.length("path").alias("n")).distinct()
    met = sites.select("host", "path", F.explode(F.array_distinct(parents)).alias("parent")).join(lengths, "parent")
    met = met.filter(F.length("path") >= F.col("n")).withColumn("start", F.expr("substring(path, 1, n)"))
    by = rules.select(F.col("host").alias("parent"), F.col("path").alias("start"), "verdict", F.concat("host", "path").alias("rule"))
    best = F.max(F.struct(F.length("rule").alias("size"), "rule", "verdict")).alias("best")
    return met.join(by, ["parent", "start"]).groupBy("host", "path").agg(best).select("host", "path", "best.rule", "best.verdict")


def page_links(pages: DataFrame) -> DataFrame:
    """(a, b): a page's url and the url it redirects to or names as canonical.

    Read from <link rel=canonical href=...> and <meta http-equiv=refresh
    content="0; url=...">, attributes in any order, quoted or not. Relative
    targets are resolved against the page's url.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    wanted = F.filter(tags, lambda t: F.regexp_like(t, F.lit(r"(?is)rel\s*=\s*[\"']?[^\"'>]*\bcanonical\b")) | F.regexp_like(t, F.lit(r"(?is)http-equiv\s*=\s*[\"']?\s*refresh\b")))
    found = pages.select(F.col("url").alias("a"), F.explode(wanted).alias("tag"))
    quoted = r"(?is)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    href = F.concat(*(F.regexp_extract("tag", quoted, k) for k in (1, 2, 3)))
    refresh = F.regexp_extract("tag", r"(?is)\bcontent\s*=\s*[\"']?[^\"'>]*?\burl\s*=\s*[\"']?([^\"'>\s]+)", 1)
    target = F.trim(F.replace(F.when(F.lower("tag").startswith("<link"), href).otherwise(refresh), F.lit("&amp;"), F.lit("&")))
    return found.select("a", resolved(F.col("a"), target).alias("b")).filter("a IS NOT NULL AND b <> ''")


def resolved(base: Column, target: Column) -> Column:
    """target as an absolute url, or '' if base has no host to start from."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:[^?#]*/)?)", 1)
    slash = F.when(folder == site, F.lit("/")).otherwise(F.lit(""))
    return (
        F.when((target == "") | target.contains("://"), target)
        .when(site == "", F.lit(""))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(folder, slash, target))
    )


def alias_key(url: Column) -> Column:
    """What aliases are compared by: the url without fragment, host in lower case."""
    scheme, rest = F.regexp_extract(url, r"(?s)^(.*?://)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(ascii_lower(scheme), url_host(url), rest)).otherwise(F.regexp_extract(url, r"(?s)^([^#]*)", 1))


def judge(pages: DataFrame, *, rules: tuple[Rule, ...] | DataFrame = RULES, links: DataFrame | None = None, keep: list[str] = ("page_id",)) -> DataFrame:
    """keep columns, host, path, rule, verdict and aliased (a block came from an
    alias) of every row of pages (url, html).

    rules: Rule objects, or a table (verdict, host, path) of any size; rows with a
    null are no rule. links: (a, b) redirects and canonical links besides those in
    the pages. A page with a rule has the rule's verdict. Another one is blocked if a
    rule blocks the url of any alias, in pages or only linked to, and allowed if not.
    A null url, or one without ://, has an empty host and path, no rule and no
    aliases, and is allowed. Repeated rows each give a row; an empty table gives
    none; other columns are left out.
    """
    table = rules_table(pages.sparkSession, rules)
    edges = page_links(pages)
    if links is not None:
        edges = edges.unionByName(links.select("a", "b"))
    ends = materialize(edges.select(F.xxhash64(alias_key(F.col("a"))).alias("a"), F.xxhash64(alias_key(F.col("b"))).alias("b"), F.col("a").alias("a_url"), F.col("b").alias("b_url")).distinct(), "links")
    rows = pages.select(*(F.col(c).alias(f"__{k}") for k, c in enumerate(keep)), "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.join(best_rules(rows, table), ["host", "path"], "left")
    if ends.isEmpty():
        rows = rows.withColumn("aliased", F.lit(False))
    else:
        member = materialize(connected(ends.select("a", "b")), "aliases")
        urls = ends.select(F.col("a").alias("node"), F.col("a_url").alias("url")).unionByName(ends.select(F.col("b").alias("node"), F.col("b_url").alias("url"))).distinct()
        urls = urls.select("node", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        # pages whose url is a node are ends of links already: their rule is the url's
        blocked = urls.join(best_rules(urls, table).filter("verdict = 'block'"), ["host", "path"], "left_semi").select("node").distinct()
        bad = member.join(blocked.join(member, "node").select("root").distinct(), "root").select(F.col("node").alias("__node"), F.lit(True).alias("__blocked"))
        rows = rows.withColumn("__key", F.when(F.instr("url", "://") > 0, F.xxhash64(alias_key(F.col("url")))))
        rows = rows.join(bad, F.col("__key") == F.col("__node"), "left").withColumn("aliased", F.col("verdict").isNull() & F.coalesce("__blocked", F.lit(False)))
    kept = [F.col(f"__{k}").alias(c) for k, c in enumerate(keep)]
    return rows.select(*kept, "host", "path", "rule", F.coalesce("verdict", F.when(F.col("aliased"), "block").otherwise("allow")).alias("verdict"), "aliased")
