"""URL rules and, where none fits, trust and distrust along the link graph of hosts.

Nodes are hosts, edges the links from one host's pages to another host, each pair once with its count.
Trust is a personalised PageRank from the hosts of pages that a rule allows; distrust is one along
the reversed edges from those of blocked pages: who links to the blocked is distrusted. What a host without
links has goes back to the seeds, so that ranks always sum to 1. A host is
blocked if its distrust exceeds its trust by a factor; a host that neither reaches is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseek.llm.common import durable, lower_ascii

#: (verdict, host, beginning of the path). A rule also fits all subdomains of its host.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Links with a scheme, and those that take the page's.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
#: Ranks that differ by less count as equal, whatever the order of their sums.
MARGIN = 1.000000001


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z in lower case. Path: from there up to ?, # or the end. Both empty without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits, like `net/` (null without one), and its verdict. The longest wins, of equally long ones the first by code point."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # from the weakest to the strongest: the last condition that is tested first wins
    for kind, name, start in sorted(sorted(rules, key=lambda r: r[1] + r[2], reverse=True), key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, name + start).otherwise(rule)
        verdict = F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _spread(edges: DataFrame, seeds: DataFrame, rounds: int, damping: float) -> DataFrame:
    """host and rank: a PageRank along edges (a, b, n) that restarts at the seeds (host, weight; weights sum to 1)."""
    rank = seeds.select("host", F.col("weight").alias("rank"))
    if edges.isEmpty():  # all stays with the seeds
        return rank
    # made once, not in each round
    shares = durable(edges.join(edges.groupBy("a").agg(F.sum("n").alias("all")), "a").select("a", "b", (F.col("n") / F.col("all")).alias("share")))
    for _ in range(rounds):
        # each host's shares are summed before and after the shuffle, so that a hot host takes one row from a task
        sent = durable(shares.join(rank.withColumnRenamed("host", "a"), "a").groupBy(F.col("b").alias("host")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank")))
        back = 1 - (sent.agg(F.sum("rank")).first()[0] or 0.0)
        rank = durable(sent.unionByName(seeds.select("host", (F.col("weight") * back).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank")))
    return rank


def judged(pages: DataFrame, rules=RULES, rounds: int = 10, damping: float = 0.85, factor: float = 1.0) -> DataFrame:
    """page_id, host, path, rule, verdict and method of each row of pages.

    A null url, or one without ://, has an empty host and path, which no rule fits; its verdict is
    the method's for a host without links: allow. A null html has no links. Links count once for each
    occurrence; those within a host, and paths without a host, are no edges. Repeated rows stay. Other columns take
    no part.
    """
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = parsed.withColumns({"rule": rule, "ruled": verdict})

    target, _ = host_and_path(F.when(F.col("link").startswith("//"), F.concat(F.lit("x:"), "link")).otherwise(F.col("link")))
    links = pages.select(host.alias("a"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("link")).select("a", target.alias("b"))
    edges = durable(links.where("a != b and a != '' and b != ''").groupBy("a", "b").agg(F.count("*").alias("n")))

    seeds = durable(own.where("ruled is not null").groupBy("host").agg(F.sum((F.col("ruled") == "allow").cast("double")).alias("allow"), F.sum((F.col("ruled") == "block").cast("double")).alias("block")))
    totals = seeds.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()

    def ranks(kind: str, along: DataFrame) -> DataFrame:
        weighted = seeds.where(F.col(kind) > 0).select("host", (F.col(kind) / F.lit(totals[kind] or 1.0)).alias("weight"))
        return _spread(along, weighted, rounds, damping).withColumnRenamed("rank", kind)

    trust = ranks("allow", edges)
    distrust = ranks("block", edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    blocked = trust.join(distrust, "host", "full").where(F.coalesce("block", F.lit(0.0)) > factor * MARGIN * F.coalesce("allow", F.lit(0.0))).select(F.col("host").alias("bad"))
    # only pages that no rule fits need the hosts' ranks
    open_ = own.where("ruled is null").join(blocked, F.col("host") == F.col("bad"), "left")
    free = open_.withColumn("verdict", F.when(F.col("bad").isNotNull(), "block").otherwise("allow")).drop("bad")
    fixed = own.where("ruled is not null").withColumn("verdict", F.col("ruled"))
    return fixed.unionByName(free).select("page_id", "host", "path", "rule", "verdict", F.when(F.col("ruled").isNull(), "graph").otherwise("rule").alias("method"))
