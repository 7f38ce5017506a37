"""URL filter: rules first, then trust and distrust spread over the host graph.

Hosts link to hosts through the absolute links of their pages.  Trust starts
from hosts with allowed pages and follows links; distrust starts from hosts with
blocked pages and follows links backwards, to those who link there.  Both are
personalised PageRank, run as one loop of joins and sums over edges; a threshold
per host then decides the pages that no rule fits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from . import web
from .store import Workspace

#: Links of anchors that name a host.
_LINK = r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains and paths that start with ``path``."""

    verdict: str
    host: str
    path: str


#: The rules of the contract (fixed values).
RULES = (
    Rule("block", "com", "/en/"),
    Rule("allow", "example.com", "/en/7"),
    Rule("allow", "net", "/de/"),
    Rule("block", "example.net", "/de/8"),
    Rule("block", "org", "/es/"),
)


def match_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, or null.

    The rules are a short list by contract and stay inside the expression.  Of
    two that fit with one length the later by code point wins.
    """
    if not rules:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    found = []
    for r in rules:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found.append(F.when(fits, F.struct(F.lit(len(r.host + r.path)).alias("size"), F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))))
    return F.array_max(F.array(*found))


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst and number of links between different hosts."""
    link = F.explode(F.regexp_extract_all(F.col("html").cast("string"), F.lit(_LINK), F.lit(1)))
    rows = pages.where("html is not null and url is not null").select(web.host(F.col("url")).alias("src"), link.alias("to"))
    rows = rows.select("src", web.host(F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))).alias("dst"))
    return rows.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, ws: Workspace, damping: float = 0.85, tolerance: float = 1e-6) -> DataFrame:
    """Rank (kind, node, rank) from seeds, for every kind apart, summing to 1.

    ``edges``: kind, src, dst, share (of src's outgoing weight, summing to 1).
    ``seeds``: kind, node, weight (summing to 1 for each kind).  The mass of
    nodes without links returns to the seeds: the rank is the sum over all paths
    from the seeds, each step damped, in proportion.  A step's mass is at most
    ``damping`` times the last one's, so what all later steps can add is known;
    the loop ends when that is below ``tolerance`` of the whole for every kind,
    after a number of steps that damping and tolerance bound.
    """
    shares = ws.save(edges, "shares")
    mass = ws.save(seeds.select("kind", "node", F.col("weight").alias("rank")), "mass")
    parts, total = [mass], {r["kind"]: r["s"] for r in mass.groupBy("kind").agg(F.sum("rank").alias("s")).collect()}
    while total:
        step = mass.select("kind", F.col("node").alias("src"), "rank").join(shares, ["kind", "src"])
        mass = ws.save(step.groupBy("kind", F.col("dst").alias("node")).agg((F.sum(F.col("rank") * F.col("share")) * damping).alias("rank")), "mass")
        moved = {r["kind"]: r["s"] for r in mass.groupBy("kind").agg(F.sum("rank").alias("s")).collect()}
        for kind, s in moved.items():
            total[kind] += s
        parts.append(mass)
        if all(s * damping / (1 - damping) <= tolerance * total[kind] for kind, s in moved.items()):
            break
        if len(parts) == 12:
            # The last one goes on, the others are one table again.
            old, parts = parts[:-1], [ws.save(_added(parts[:-1]), "added"), mass]
            ws.drop(*old)
    ranks = _added(parts)
    whole = F.lit(1.0)
    for kind, s in total.items():
        whole = F.when(F.col("kind") == kind, F.lit(float(s))).otherwise(whole)
    return ranks.select("kind", "node", (F.col("rank") / whole).alias("rank"))


def _added(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("kind", "node", "rank")
    for p in parts[1:]:
        out = out.unionByName(p.select("kind", "node", "rank"))
    return out.groupBy("kind", "node").agg(F.sum("rank").alias("rank"))


def judge(pages: DataFrame, ws: Workspace, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, host_score.

    The longest rule that fits decides.  Where none fits, the host does: its
    distrust less its trust, counted in pages (a rank times all blocked or
    allowed pages), blocks if above ``threshold`` of the host's own pages.  A
    null url, or one without "://", has an empty host and path, takes part in no
    graph and is allowed unless a rule fits.  A null html has no links; a very
    long one gives all of its links.  Repeated rows count as pages; an empty table
    gives an empty result; further columns are ignored.
    """
    rows = pages.select("page_id", web.host(F.col("url")).alias("host"), web.path(F.col("url")).alias("path"))
    rows = rows.withColumn("m", match_rule(F.col("host"), F.col("path"), rules))
    hosts = ws.save(rows.where("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("m.verdict") == "allow").alias("allowed"), F.count_if(F.col("m.verdict") == "block").alias("blocked")), "hosts")
    totals = hosts.agg(F.sum("allowed"), F.sum("blocked")).first()
    seeds = []
    for kind, col, total in (("trust", "allowed", totals[0]), ("distrust", "blocked", totals[1])):
        if total:
            seeds.append(hosts.where(F.col(col) > 0).select(F.lit(kind).alias("kind"), F.col("host").alias("node"), (F.col(col) / F.lit(total)).alias("weight")))
    score = hosts.select("host", F.lit(0.0).alias("host_score"))
    if seeds:
        links = ws.save(host_edges(pages), "links")
        ways = []
        for kind, a, b in (("trust", "src", "dst"), ("distrust", "dst", "src")):
            out = links.groupBy(a).agg(F.sum("links").alias("all"))
            ways.append(links.join(out, a).select(F.lit(kind).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), (F.col("links") / F.col("all")).alias("share")))
        start = seeds[0] if len(seeds) == 1 else seeds[0].unionByName(seeds[1])
        rank = personalised_pagerank(ways[0].unionByName(ways[1]), start, ws)
        sign = F.when(F.col("kind") == "trust", F.lit(-float(totals[0] or 0))).otherwise(F.lit(float(totals[1] or 0)))
        mass = rank.groupBy(F.col("node").alias("host")).agg(F.sum(F.col("rank") * sign).alias("mass"))
        score = hosts.join(mass, "host", "left").select("host", (F.coalesce("mass", F.lit(0.0)) / F.col("pages")).alias("host_score"))
    score = ws.save(score, "score")
    own = F.when(F.coalesce("host_score", F.lit(0.0)) > threshold, "block").otherwise("allow")
    return rows.join(score, "host", "left").select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", own).alias("verdict"), F.coalesce("host_score", F.lit(0.0)).alias("host_score"))
