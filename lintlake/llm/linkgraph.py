"""URL filters by rules and, where no rule speaks, by trust propagated over the links between hosts.

Two personalised PageRanks run over host edges, as joins and sums in Spark: trust flows from hosts with allowed pages along
links; distrust flows from hosts with blocked pages against them (who links to a bad host is suspect). A host is blocked if
its share of distrust exceeds its share of trust by more than a threshold. Edges are the links in pages to other hosts; a
subdomain and its parent domain count as linked both ways, since the parent delegates the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, drop, materialise, sweep

#: (action, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-6  #: of all trust, and of all distrust, that may still be on its way when the propagation ends
STEPS = 5  #: along the links between two looks at what is left
THRESHOLD = 0.0  #: log2 of distrust to trust above which a host is blocked
LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/?#"'\s<>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits (ties: the first by its text) and its action; null where none does."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True):  # the last set wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n) of the links between different hosts. pages: host, html."""
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("dst"))
    links = links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("n"))


def domain_edges(hosts: DataFrame) -> DataFrame:
    """(src, dst, n) between each host and the domains above it, both ways."""
    parts = F.split("host", r"\.")
    up = hosts.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("src")).distinct()
    up = up.where(F.instr("src", ".") > 0).select("src", F.regexp_extract("src", r"\A[^.]*\.(.*)\z", 1).alias("dst")).where("src <> '' and dst <> ''")
    return up.select("src", "dst", F.lit(1.0).alias("n")).unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1.0).alias("n")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, steps: int = STEPS) -> DataFrame:
    """(kind, host, score): a personalised PageRank for each kind. edges: kind, src, dst, n; seeds: kind, host, weight, summing to 1 for each kind.

    What reaches a host without links goes back to the seeds. That only scales the scores, so it is left to the end: what flows from the seeds, damped
    at every step, is added up until no kind has more than ``tolerance`` of its weight still flowing, which takes log(tolerance) / log(damping) steps at most,
    however long the paths are.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    ways = edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out") * damping).alias("p"))
    # a way of each host to itself, on which its sum travels: so a step is one join and one aggregation
    hosts = edges.select("kind", F.col("src").alias("host")).union(edges.select("kind", "dst")).union(seeds.select("kind", "host")).distinct()
    ways = materialise(ways.unionByName(hosts.select("kind", "host", F.col("host").alias("dst"), F.lit(None).cast("double").alias("p"))), "rank-edges")
    state = materialise(seeds.select("kind", "host", F.col("weight").alias("flowing"), F.col("weight").alias("score")), "rank")
    while state.groupBy("kind").agg(F.sum("flowing").alias("left")).where(F.col("left") > tolerance).limit(1).count():
        new = state
        for _ in range(steps):
            flow = F.coalesce(F.col("flowing") * F.col("p"), F.lit(0.0))
            kept = F.when(F.col("p").isNull(), F.col("score")).otherwise(0.0)
            new = new.join(ways, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(flow).alias("flowing"), F.sum(kept + flow).alias("score"))
        before, state = state, materialise(new, "rank")
        drop(before)
        del new, before
        sweep(edges.sparkSession)
    sums = state.groupBy("kind").agg(F.sum("score").alias("sum"))
    out = materialise(state.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("score") / F.col("sum")).alias("score")).where("score > 0"), "rank-scores")  # sums: a row per kind
    drop(ways, state)
    return out


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, threshold: float = THRESHOLD, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict (allow or block), trust and distrust of the host.

    A null url, or one without ``://``, has an empty host and path; no rule and no link concerns it, and it is allowed. A null
    html has no links; html of any length is searched in whole. Hosts that neither rank reaches are allowed, and so are those with as much trust as distrust.
    Repeated rows are judged each. Columns other than key, url and html are not read, so their names can't clash. An empty table gives no rows.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    base = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "action": action})
    per_host = materialise(base.where("host <> ''").groupBy("host").agg(F.sum(F.when(F.col("action") == "allow", 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("action") == "block", 1).otherwise(0)).alias("bad")), "hosts")
    links = host_edges(pages.select(host.alias("host"), F.col(html).alias("html")))
    links = materialise(links.unionByName(domain_edges(per_host.select("host"))).groupBy("src", "dst").agg(F.sum("n").alias("n")), "links")
    good, bad = per_host.agg(F.sum("good"), F.sum("bad")).first()
    kinds = (("good", good, "src", "dst"), ("bad", bad, "dst", "src"))  # distrust flows against the links
    seeds = [per_host.where(F.col(k) > 0).select(F.lit(k).alias("kind"), "host", (F.col(k) / float(n or 1)).alias("weight")) for k, n, _, _ in kinds]
    edges = [links.select(F.lit(k).alias("kind"), F.col(a).alias("src"), F.col(b).alias("dst"), "n") for k, _, a, b in kinds]
    ranks = propagate(edges[0].unionByName(edges[1]), seeds[0].unionByName(seeds[1]), damping, tolerance)
    trust, distrust = (ranks.where(F.col("kind") == k).select("host", F.col("score").alias(n)) for k, n in (("good", "trust"), ("bad", "distrust")))
    scores = per_host.select("host").join(trust, "host", "left").join(distrust, "host", "left").na.fill(0.0, ["trust", "distrust"])
    tiny = 1e-15
    scores = materialise(scores.withColumn("bad_host", F.log2((F.col("distrust") + tiny) / (F.col("trust") + tiny)) > threshold), "host-scores")
    verdict = F.coalesce("action", F.when(F.col("bad_host"), F.lit("block")).otherwise(F.lit("allow")))
    out = base.join(scores, "host", "left").select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
    drop(per_host, links, ranks)
    return out
