"""URL filter by link-graph propagation. DataFrame functions only.

Rules (host and path prefix, longest wins) decide the urls that they fit. All others are judged by host: links between hosts
form a graph; hosts with allowed pages seed a personalised PageRank along the links, hosts with blocked pages seed distrust,
which runs against the links, from a blocked host to those that link to it. A host is blocked when its distrust reaches
`threshold` times an even share and exceeds its trust.

The walk's lost mass (hosts without links onwards) would return to the seeds; that only scales the vector, so both vectors are
summed without it and normalised once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let_go, pick, written

#: The contract's rules.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
#: Rounds go on until both vectors move by less than TOLERANCE (sum of changes; 1 is the mass of a vector). Every round shrinks the change by
#: DAMPING at least, so that ROUNDS, 0.85 ** 120 = 3.4e-9, is never what ends them.
DAMPING, TOLERANCE, ROUNDS, THRESHOLD = 0.85, 1e-6, 120, 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of an absolute or scheme-relative link.
_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null if none; of equally long ones a block wins. Rules are a short
    configured list, so they are a chain of conditions."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[0] != "block", r[1])):
        cut = rule.index("/") if "/" in rule else len(rule)
        own = rule[:cut].translate(str.maketrans(_UPPER, _LOWER))
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(rule[cut:])
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<verdict: string, rule: string>") if out is None else out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from pages (host, html)."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1))).alias("to"))
    links = links.select("src", F.translate("to", _UPPER, _LOWER).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """seeds (host, trust, distrust: seed weights), edges (src, dst, links) -> (host, trust, distrust), each summing to 1 over all
    hosts (0 if there is no seed of the kind). Hosts that are only linked to are included. Each round is a written table, and the
    one before it goes."""
    edges = written(edges, "host-edges")
    every = seeds.select("host").union(edges.select("src")).union(edges.select("dst")).distinct()
    sums = seeds.agg(F.sum("trust").alias("all_trust"), F.sum("distrust").alias("all_distrust"))
    share = lambda c: F.coalesce(F.col(c) / F.expr(f"nullif(all_{c}, 0)"), F.lit(0.0))
    start = every.join(seeds, "host", "left").crossJoin(F.broadcast(sums)).select("host", share("trust").alias("trust"), share("distrust").alias("distrust"))
    start = written(start, "host-seeds")
    if edges.isEmpty():
        return start
    out = edges.groupBy(F.col("src").alias("host")).agg(F.sum("links").alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("host")).agg(F.sum("links").alias("n_in"))
    forth = edges.join(out.toDF("src", "n_out"), "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("links") / F.col("n_out")).alias("t"), F.lit(0.0).alias("d"))
    back = edges.join(into.toDF("dst", "n_in"), "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("links") / F.col("n_in")).alias("d"))
    steps = written(forth.union(back), "host-steps")
    let_go(edges)
    now = start.select("host", "trust", "distrust", F.col("trust").alias("seed_t"), F.col("distrust").alias("seed_d"))
    for _ in range(rounds):
        moved = steps.join(now.select("host", "trust", "distrust"), "host").groupBy(F.col("to").alias("host")).agg(F.sum(F.col("t") * F.col("trust")).alias("t"), F.sum(F.col("d") * F.col("distrust")).alias("d"))
        step = lambda seed, m: F.col(seed) * (1 - damping) + damping * F.coalesce(m, F.lit(0.0))
        new = now.join(moved, "host", "left").withColumns({"new_t": step("seed_t", "t"), "new_d": step("seed_d", "d")})
        change = (F.abs(F.col("new_t") - F.col("trust")) + F.abs(F.col("new_d") - F.col("distrust"))).alias("change")
        new = written(new.select("host", F.col("new_t").alias("trust"), F.col("new_d").alias("distrust"), "seed_t", "seed_d", change), "host-rank")
        let_go(now)
        now = new
        if (now.agg(F.sum("change")).first()[0] or 0.0) < tolerance:
            break
    let_go(steps)
    ends = now.agg(F.sum("trust").alias("all_trust"), F.sum("distrust").alias("all_distrust"))
    return now.crossJoin(F.broadcast(ends)).select("host", share("trust").alias("trust"), share("distrust").alias("distrust"))


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD, damping: float = DAMPING, rounds: int = ROUNDS, tolerance: float = TOLERANCE,
) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule (null if none fits), verdict, trust, distrust (of the
    host).

    A host seeds trust by the share of its pages that rules allow, distrust by the share that they block. Edge cases: a null url or
    one without :// has empty host and path, belongs to no host of the graph and is allowed; null html has no links; repeated pages
    count as often as they are there; null ids are kept; an empty table gives an empty one; other columns are left out whatever
    their names. The two broadcast sums are one row each."""
    x = pick(pages, "page_id", "url", "html").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "html")
    fate = rule_for(F.col("host"), F.col("path"), rules)
    x = x.withColumn("fate", fate)
    n = F.col("n").cast("double")
    marks = x.where("host <> ''").groupBy("host").agg(F.sum(F.when(F.col("fate.verdict") == "allow", 1).otherwise(0)).alias("allowed"), F.sum(F.when(F.col("fate.verdict") == "block", 1).otherwise(0)).alias("blocked"), F.count("*").alias("n"))
    seeds = marks.select("host", (F.col("allowed") / n).alias("trust"), (F.col("blocked") / n).alias("distrust"))
    ranks = propagate(seeds, host_edges(x.select("host", "html")), damping, rounds, tolerance)
    even = ranks.agg(F.count("*").alias("hosts"))
    verdicts = ranks.crossJoin(F.broadcast(even)).select("host", "trust", "distrust", ((F.col("distrust") * F.col("hosts") >= threshold) & (F.col("distrust") > F.col("trust"))).alias("blocked"))
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    judged = x.drop("html").join(verdicts, "host", "left")
    return judged.select("page_id", "host", "path", F.col("fate.rule").alias("rule"), F.coalesce("fate.verdict", own).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
