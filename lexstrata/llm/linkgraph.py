"""Operator 5: url filter by link-graph propagation, DataFrame functions only.

Rules (host, path, verdict) judge the urls they fit: a rule fits its host and all subdomains if the url's path starts with the
rule's; the longest rule wins. Hosts are then scored on the graph of links between hosts: personalised PageRank spreads trust
from hosts whose pages the rules allow, along links; distrust spreads from hosts whose pages they block, against the links
(who links to a blocked host is distrusted). A url that no rule fits gets its host's verdict: block if distrust is more than
BLOCK_SHARE of both scores, else allow.

Links are counted per pair of hosts before anything is joined, with partial counts in the tasks, so a host with a third of
all links is a few rows of the graph. Each round joins the scores to the edges and sums per host; its result is written to the
shared folder. A link to the page's own host carries nothing.

Defined results: a null url, or one without ://, has empty host and path and is allowed by the method (no host is ever
scored by the empty name); a null html has no links; without rules all is allowed; repeated rows get a row each and count
as often in the graph; an empty table gives an empty result; extra columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Rules are a parameter held in the plan; at most so many.
MOST_RULES = 10_000
ROUNDS = 8
DAMPING = 0.85
BLOCK_SHARE = 0.6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ://, up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none does. rules: (verdict, host/path)."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    split = [(text, text.partition("/")[0], text[len(text.partition("/")[0]) :], verdict) for verdict, text in rules]
    table = F.array(*(F.struct(F.lit(len(text)).alias("size"), F.lit(text).alias("rule"), F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for text, h, p, v in split))
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    best = F.array_max(fits)
    return best["rule"], best["verdict"]


def links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts, counted."""
    target = F.explode(F.regexp_extract_all(F.col("html"), F.lit(r"(?i)href\s*=\s*[\"']?\s*(?:https?:)?//([^/?#\"'\s<>]+)"), F.lit(1)))
    pairs = pages.where("host != ''").select(F.col("host").alias("src"), target.alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return pairs.where("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))



def scores(judged: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) after some rounds from the hosts that rules judge (host, verdict)."""
    count = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0))
    seeds = judged.where("host != '' AND verdict IS NOT NULL").groupBy("host").agg(count("allow").alias("trust"), count("block").alias("distrust"))
    seeds = shared.written(seeds, "seeds")
    trust, distrust = (max(x or 0, 1) for x in seeds.agg(F.sum("trust"), F.sum("distrust")).first())
    seeds = seeds.select("host", (F.col("trust") / trust).alias("trust"), (F.col("distrust") / distrust).alias("distrust"))
    out, into = edges.groupBy("src").agg(F.sum("n").alias("out")), edges.groupBy("dst").agg(F.sum("n").alias("into"))
    graph = shared.written(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("out")).alias("ahead"), (F.col("n") / F.col("into")).alias("back")), "graph")
    if graph.isEmpty():
        return seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    base = seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    now, none = seeds, F.lit(0.0)
    for _ in range(rounds):
        ahead = graph.join(now.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (damping * F.col("ahead") * F.col("trust")).alias("trust"), none.alias("distrust"))
        back = graph.join(now.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), none.alias("trust"), (damping * F.col("back") * F.col("distrust")).alias("distrust"))
        now = reduce(DataFrame.unionByName, [base, ahead, back]).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        now = shared.written(now, "scores")
    return now


def judged(pages: DataFrame, rules: list[tuple[str, str]], block_share: float = BLOCK_SHARE) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, and its host's share of distrust."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html").withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("own", verdict)
    hosts = scores(rows.select("host", F.col("own").alias("verdict")), shared.written(links(rows.select("host", "html")), "host-links"))
    share = hosts.select("host", F.try_divide("distrust", F.col("trust") + F.col("distrust")).alias("share"))
    out = rows.drop("html", "url").join(share, "host", "left")
    method = F.when(F.round("share", 9) > block_share, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("own", method).alias("verdict"), F.round("share", 9).alias("distrust_share"))
