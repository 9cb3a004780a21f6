"""URL filters: rules for hosts and paths, and for the rest the host's place in the link graph.

Trust starts at hosts whose pages the rules allow and follows links; distrust starts at hosts whose pages the rules block
and follows links backwards. Both are personalised PageRanks over host edges, computed by joins until they stand still. A host
is blocked if its distrust is above its trust and above `bound` times what a start from all hosts alike would give it: all of
these shrink alike as hosts are added, so the verdict doesn't depend on how many there are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: Fixed rules of the query.
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: Chance to follow a link, and the least distrust of a blocked host as a share of its rank from a uniform start.
DAMPING, BOUND = 0.85, 0.05
#: Rounds end when no host's rank moves by more than this share of the mean rank; that is tested every STRIDE rounds.
TOLERANCE, STRIDE = 1e-4, 4
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host and path of a URL column; both empty where the URL is null or has no "://"."""
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(rules: tuple[Rule, ...], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (null: none). Rules are a short list that the plan holds."""
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules don't belong in an expression")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r)):
        fits = ((F.col(host) == r.host) | F.col(host).endswith(f".{r.host}")) & F.col(path).startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.host + r.path)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links from pages(host, html) to other hosts; links without a host stay on their own and aren't edges."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), F.lit(1))
    found = pages.select(F.col("host").alias("src"), F.explode(links).alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    return found.where("src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int | None = None) -> DataFrame:
    """(host, rank): personalised PageRank from seeds(host, seed), whose seeds sum to 1, along edges(src, dst, n). Hosts without
    out-links give their rank back to the seeds; as that is where the jumps go, too, it is the rank without it, brought to the sum 1.

    Without `rounds` it goes on until the ranks stand still. A round moves at most the damping's share of what the last one
    moved, so the rounds end.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    flow = materialise(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")))
    rank = seeds.select("host", F.col("seed").alias("rank"))
    if not flow.limit(1).count():  # no links: each round leaves the seeds' own part
        return rank
    hosts = flow.select("src").union(flow.select("dst")).distinct().count() if rounds is None else 0
    done, last = 0, rank
    while rounds is None or done < rounds:
        last = rank
        moved = flow.join(rank, flow["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"))
        rank = moved.unionByName(seeds.select("host", (F.col("seed") * (1 - damping)).alias("rank"))).groupBy("host").agg(F.sum("rank").alias("rank"))
        done += 1
        if done % STRIDE == STRIDE - 1:
            rank = materialise(rank)
        elif done % STRIDE == 0 and rounds is None:  # `last` is stored, so this is one round
            rank = materialise(rank)
            both = rank.join(last.withColumnRenamed("rank", "before"), "host", "full").fillna(0.0, ["rank", "before"])
            if (both.agg(F.max(F.abs(F.col("rank") - F.col("before")))).first()[0] or 0.0) <= TOLERANCE / hosts:
                break
    rank = materialise(rank)
    total = rank.agg(F.sum("rank")).first()[0]
    return rank.withColumn("rank", F.col("rank") / F.lit(total)) if total else rank


def host_scores(pages: DataFrame) -> DataFrame:
    """(host, trust, distrust, neutral) of pages(host, html, ruled); neutral is the rank backwards from all hosts alike."""
    edges = materialise(host_edges(pages))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    hosts = materialise(pages.groupBy("host").agg(F.count(F.when(F.col("ruled") == "allow", 1)).alias("allowed"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")))
    known = materialise(hosts.select("host").union(edges.select("dst")).where("host <> ''").distinct().withColumn("every", F.lit(1)))
    out = hosts.select("host")
    for name, table, column, links in (("trust", hosts, "allowed", edges), ("distrust", hosts, "blocked", back), ("neutral", known, "every", back)):
        seeds = table.where(f"{column} > 0 and host <> ''")
        total = seeds.agg(F.sum(column)).first()[0]
        rank = propagated(links, materialise(seeds.select("host", (F.col(column) / F.lit(total or 1)).alias("seed"))))
        out = out.join(rank.withColumnRenamed("rank", name), "host", "left")
    return out.fillna(0.0, ["trust", "distrust", "neutral"])


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, bound: float = BOUND) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, trust, distrust.

    A null url, or one without "://", has an empty host and path, fits no rule and is allowed. A null html has no links.
    Repeated rows are judged each; extra columns are ignored; an empty table gives an empty result.
    """
    host, path = host_and_path()
    name, verdict = matching_rule(rules)
    found = pages.select("page_id", "url", "html").withColumn("host", host).withColumn("path", path).withColumn("rule", name).withColumn("ruled", verdict)
    scores = host_scores(found.select("host", "html", "ruled"))
    out = found.drop("html").join(scores, "host", "left")
    own = F.when((F.col("distrust") > bound * F.col("neutral")) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
