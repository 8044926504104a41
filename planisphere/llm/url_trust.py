"""Operator 1, URL filter by link-graph propagation. DataFrame functions only.

Rules name a host and a path prefix; pages that a rule fits take its verdict. The
pages so judged are seeds: trusted pages give their hosts trust, blocked pages
distrust. Personalised PageRank carries trust along the links between hosts, and
carries distrust against them (who links to bad hosts is suspect). What hosts without
further links would lose goes back to the seeds, so trust and distrust each sum to 1 and
can be compared. A host whose share of distrust exceeds the threshold has its other
pages blocked.

A link leads to another host if its address begins with a scheme and "://", or with "//";
an address inside a query string is none.

Defined cases: a null url, or one without "://", has empty host and path, fits no
rule, and the empty host takes no part in the graph, so such pages are allowed; links
inside a host carry nothing; a host without evidence is allowed; repeated rows are
judged each on its own; null html has no links; an empty table gives no rows. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, stage

#: (verdict, host, path prefix): fixed by the query's contract.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
DAMPING = 0.85
#: A host is blocked if distrust / (trust + distrust) is above this.
THRESHOLD = 0.5
#: Scores rest when each host's last changed by at most TOLERANCE of itself; LIMIT iterations without rest are an error.
LIMIT, EVERY, TOLERANCE = 10_000, 4, 1e-8
#: Scores below this, thousands of links from any seed, are near the end of doubles and need not rest.
_LEAST = 1e-300
_FAR = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule(rules: list[tuple[str, str, str]], host: Column, path: Column) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does. Of equal rules, block wins."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2], r[0] != "block"))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    return F.coalesce(*(F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ranked), F.lit(None))


def links(pages: DataFrame) -> DataFrame:
    """src, dst, n: pages of host src with links to host dst, other than src."""
    hrefs = F.regexp_extract_all(F.col("html"), F.lit(_HREF), F.lit(1))
    far = F.filter(hrefs, lambda h: h.rlike(_FAR))
    whole = F.transform(far, lambda h: F.concat(F.lit("x:"), F.regexp_replace(h, r"^[^/]*", "")))  # from the "//" on
    out = pages.select(host(F.col("url")).alias("src"), F.explode(F.array_distinct(F.transform(whole, host))).alias("dst"))
    return out.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, limit: int = LIMIT) -> DataFrame:
    """host, trust, distrust, from edges (src, dst, n) and seeds (host, trust, distrust).

    One table of flows holds both directions, so that an iteration is one join and
    one sum. Lineage is cut every few iterations; the loop ends when the scores
    rest: no host gains a score and none changes by more than TOLERANCE of its own.
    Hosts without outgoing flow lose their mass meanwhile. Giving it back to the seeds
    in each iteration would scale all scores of a kind alike, so that is done once, at
    the end: the scores of either kind are made to sum to 1.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("all")).withColumnRenamed("src", "h")
    into = edges.groupBy("dst").agg(F.sum("n").alias("all")).withColumnRenamed("dst", "h")
    ahead = edges.join(out, F.col("src") == F.col("h")).select(F.lit(True).alias("good"), F.col("src").alias("origin"), F.col("dst").alias("host"), (F.col("n") / F.col("all")).alias("share"))
    back = edges.join(into, F.col("dst") == F.col("h")).select(F.lit(False).alias("good"), F.col("dst").alias("origin"), F.col("src").alias("host"), (F.col("n") / F.col("all")).alias("share"))
    flows = stage(ahead.unionByName(back), "flows")
    seed = seeds.select("host", F.explode(F.create_map(F.lit(True), F.col("trust"), F.lit(False), F.col("distrust"))).alias("good", "seed")).where("seed > 0")
    start = stage(seed, "seeds")
    score, done = start.select("host", "good", F.col("seed").alias("score")), 0
    if not flows.isEmpty():
        base = start.select("host", "good", (F.col("seed") * (1 - damping)).alias("score"))
        while True:
            before = score
            for _ in range(EVERY):
                moved = flows.join(score.select(F.col("host").alias("origin"), "good", "score"), ["origin", "good"]).select("host", "good", (F.col("share") * F.col("score") * damping).alias("score"))
                score = moved.unionByName(base).groupBy("host", "good").agg(F.sum("score").alias("score"))
            score, done = stage(score, "scores"), done + EVERY
            both = score.select("host", "good", "score", F.lit(0.0).alias("was")).unionByName(before.select("host", "good", F.lit(0.0).alias("score"), F.col("score").alias("was")))
            both = both.groupBy("host", "good").agg(F.sum("score").alias("score"), F.sum("was").alias("was"))
            change = both.agg(F.max(F.abs(F.col("score") - F.col("was")) / F.greatest("score", "was", F.lit(_LEAST)))).first()[0]
            discard(before)
            if (change or 0.0) <= TOLERANCE:
                break
            if done >= limit:
                raise RuntimeError(f"trust does not rest after {done} iterations: a host still changes by {change:.1e} of its score")
    of = lambda good: F.sum(F.when(F.col("good") == good, F.col("score")).otherwise(0.0))
    total = score.agg(of(True).alias("trust"), of(False).alias("distrust")).first()
    part = lambda good, name: (of(good) / F.lit(float(total[name] or 0.0) or 1.0)).alias(name)
    return score.groupBy("host").agg(part(True, "trust"), part(False, "distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust of every page."""
    parsed = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = parsed.withColumn("r", rule(rules, F.col("host"), F.col("path")))
    counts = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("r.verdict") == "allow").alias("good"), F.count_if(F.col("r.verdict") == "block").alias("bad"))
    counts = stage(counts, "hosts")
    total = counts.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).first()
    part = lambda c: (F.col(c) / F.lit(float(total[c] or 1) or 1.0)).cast("double")
    hosts = stage(propagate(links(pages), counts.select("host", part("good").alias("trust"), part("bad").alias("distrust"))), "host_scores")
    seen = ruled.join(hosts, "host", "left")
    share = F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0))
    own = F.when(F.coalesce(share, F.lit(0.0)) > threshold, F.lit("block")).otherwise(F.lit("allow"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return seen.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), own).alias("verdict"), zero("trust"), zero("distrust"))
