"""URL filter: rules first, then trust and distrust that flow over the links between hosts.

A rule is a host and a path; it fits that host and its subdomains where the url's path starts with the rule's path; the longest rule wins.
Urls that no rule fits get their host's verdict. Trust is a personalised PageRank from hosts by their allowed pages, along links; distrust is one from
hosts by their blocked pages, against the direction of links (who links to a blocked host earns distrust). A host with both kinds of pages seeds both, and the comparison decides. A host is blocked if its
distrust exceeds its trust and its exposure is at least BLOCK_AT. Distrust is split among all who link to a blocked host; exposure is not, so a farm of any number of hosts is caught: it is the
share of the host's own personalised PageRank that ends at urls which rules block, (1 - DAMPING) * DAMPING = 0.1275 where each of its links goes to one, so 0.1 asks for 79 % of them or as much by longer ways. Blocked pages of its own are no exposure: a rule about a path says nothing about the host's other paths.

A walk that comes to a host without links goes back to the seeds. That only scales all scores alike (x = c (I - d M)^-1 s for some c), so it is done by dividing by their sum in the end. Exposure is a probability and is not scaled.

Links come from the pages' href values; edges are counted per pair of hosts before anything is joined, so a host with a third of all pages is one row. A hub's edges are dealt over parts of HUB each, and its score is repeated for
them, so no task joins more of one host. Blocked hosts are broadcast to the pages up to BROADCAST bytes, else repeated for SALTS parts of each host's pages.
Everything is DataFrame expressions; scores live in a table of hosts and are never collected. Lineage is cut every CUT_EVERY rounds. A round shrinks the distance (L1) to the
settled scores by DAMPING and it is 2 at most at the start, so ROUNDS rounds bring it below TOLERANCE; scores that stand still before that end the rounds.

Nulls: a null url, or one without ://, has empty host and path, no rule, and is allowed; null html has no links.
Repeated rows are judged each, and their links count each. Empty tables give empty results. Other columns pass through `judge`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST, ascii_lower, cut, hinted

#: (verdict, host, path): fixed values of the contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DAMPING, TOLERANCE, CUT_EVERY, BLOCK_AT = 0.85, 1e-4, 4, 0.1
ROUNDS = math.ceil(math.log(TOLERANCE / 2) / math.log(DAMPING))
#: The change over CUT_EVERY rounds up to which scores stand still: what rounding leaves.
STILL = 1e-13
#: Edges of a host in a part, and the parts of a host's pages where blocked hosts are not broadcast.
HUB, SALTS = 100_000, 16
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def _after_scheme(url: Column) -> Column:
    return F.when(url.contains("://"), F.substring_index(F.regexp_replace(url, r"^[\s\S]*?://", ""), "#", 1)).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, rule_host: str) -> Column:
    return (host == rule_host) | host.endswith(f".{rule_host}")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = _fits(host, h) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def host_links(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """src, dst, n, bad (how many go to urls that rules block): links between different hosts; a link without a host of its own stays on its page's and makes no edge."""
    found = F.filter(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda x: x.contains("//"))
    links = pages.where(F.col("html").contains("//")).select(host_of(F.col("url")).alias("src"), F.explode(found).alias("to"))
    to = F.regexp_replace("to", "^//", "x://")
    links = links.select("src", host_of(to).alias("dst"), path_of(to).alias("path")).where("src <> '' and dst <> '' and src <> dst")
    _, verdict = rule_for(F.col("dst"), F.col("path"), rules)
    return links.withColumn("bad", F.coalesce((verdict == "block").cast("long"), F.lit(0))).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))


def propagate(hosts: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust, exposure from hosts (host, trusted, blocked: the teleport's weights) and edges (src, dst, n, and bad where it is known)."""
    edges = edges if "bad" in edges.columns else edges.withColumn("bad", F.lit(0))
    both = edges.select("src", "dst", "n", "bad", F.lit("trust").alias("kind")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", "bad", F.lit("distrust").alias("kind")))
    total = both.groupBy("src", "kind").agg(F.sum("n").alias("out"))
    both = both.join(total, ["src", "kind"]).withColumn("share", F.col("n") / F.col("out"))
    # Exposure flows against the links too, but by their share of their source's links: links to blocked urls are where it starts, the others carry it on.
    back = both.where("kind = 'trust'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("exposure").alias("kind"), ((F.col("n") - F.col("bad")) / F.col("out")).alias("share"), (F.col("bad") / F.col("out")).alias("bad"))
    both = cut(both.select("src", "dst", "kind", "share", F.lit(0.0).alias("bad")).unionByName(back))
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trusted"), F.lit("distrust"), F.col("blocked"))).alias("kind", "weight"))
    mass = seeds.groupBy("kind").agg(F.greatest(F.sum("weight"), F.lit(1e-300)).alias("mass"))
    # Hosts that are linked but have no page of their own score too.
    ends = both.select(F.col("dst").alias("host"), "kind", (F.col("bad") * DAMPING).alias("weight"))
    n_edges = both.count()
    hubs = cut(both.groupBy(F.col("src").alias("host"), "kind").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1"))  # n_edges / HUB rows at most
    few = n_edges // HUB
    dealt = both.drop("bad").withColumnRenamed("src", "host")
    if few:
        dealt = dealt.join(hinted(hubs, few), ["host", "kind"], "left").withColumn("part", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int")).drop("parts")
    else:
        dealt = dealt.withColumn("part", F.lit(0))
    dealt = cut(dealt)
    seeds = cut(seeds.join(F.broadcast(mass), "kind").select("host", "kind", (F.col("weight") / F.col("mass")).alias("weight")).unionByName(ends).groupBy("host", "kind").agg(F.sum("weight").alias("seed")))
    score = last = seeds.select("host", "kind", F.col("seed").alias("score"))
    start = seeds.select("host", "kind", (F.col("seed") * (1 - DAMPING)).alias("flow"))

    def told(score: DataFrame) -> DataFrame:
        """score with a row for each part of a host's edges."""
        if not few:
            return score.withColumn("part", F.lit(0))
        return score.join(hinted(hubs, few), ["host", "kind"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    for i in range(rounds if n_edges else 0):  # without an edge nothing flows: the teleport is the score
        flow = told(score).join(dealt, ["host", "kind", "part"]).select(F.col("dst").alias("host"), "kind", (F.col("score") * F.col("share") * DAMPING).alias("flow"))
        score = flow.unionByName(start).groupBy("host", "kind").agg(F.sum("flow").alias("score"))
        if (i + 1) % CUT_EVERY == 0:
            score = cut(score)
            moved = score.unionByName(last.withColumn("score", -F.col("score"))).groupBy("host", "kind").agg(F.abs(F.sum("score")).alias("by"))
            if (moved.agg(F.sum("by")).first()[0] or 0.0) <= STILL:
                break
            last = score
    score = cut(score)
    sums = score.where("kind <> 'exposure'").groupBy("kind").agg(F.sum("score").alias("sum"))  # two rows
    score = score.join(F.broadcast(sums), "kind", "left").withColumn("score", F.when(F.col("sum") > 0, F.col("score") / F.col("sum")).otherwise(F.col("score")))
    return score.groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust", "exposure")])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """pages with host, path, rule, verdict."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    parsed = pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "ruled": verdict})
    pages_of = lambda kind: F.sum(F.coalesce((F.col("ruled") == kind).cast("double"), F.lit(0.0)))
    hosts = parsed.where("host <> ''").groupBy("host").agg(pages_of("allow").alias("trusted"), pages_of("block").alias("blocked"))
    hosts = cut(hosts)
    scores = propagate(hosts, host_links(pages, rules))
    bad = cut(scores.where((F.col("exposure") >= BLOCK_AT) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("judged")))
    size = int(bad.agg(F.sum(F.octet_length("host").cast("long") + 16)).first()[0] or 0)
    if size <= BROADCAST:
        out = parsed.join(F.broadcast(bad), "host", "left")
    else:
        parts = bad.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = parsed.withColumn("_part", F.pmod(F.xxhash64("path", "url"), F.lit(SALTS)).cast("int")).join(parts, ["host", "_part"], "left").drop("_part")
    return out.withColumn("verdict", F.coalesce("ruled", "judged", F.lit("allow"))).drop("ruled", "judged")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return judge(pages).select("page_id", "host", "path", "rule", "verdict")
