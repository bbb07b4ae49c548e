"""URL filtering: written rules first, then link-graph propagation, in DataFrame functions only.

Host edges come from the pages' links (absolute and protocol-relative; relative links stay on
their host) and from the host names themselves: a host and its parent domain are linked both
ways, since they share an owner. Personalised PageRank spreads trust along the edges from the
hosts of rule-allowed pages, and distrust along the reversed edges from the hosts of rule-blocked
pages (a host that links to blocked hosts is suspect); both walks restart at their seeds. A page
without a rule is blocked if distrust exceeds ``threshold`` of its host's trust and distrust.

Edges and seeds are summed by host before they meet anything, so a host with a third of all pages
is one row; the rows of a hot host are split by AQE in the last join.

Null urls and urls without ``://`` have empty host and path and take no part in the graph: allow.
Null html has no links. Repeated rows and null ids pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: (verdict, host and path prefix)
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"),
         ("block", "com/de/"))
DAMPING, THRESHOLD = 0.85, 0.6
TOLERANCE, MOST_ROUNDS, STORE_ROUNDS = 1e-4, 10_000, 4
LEVELS, ROWS_A_TASK = 16, 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w) between different hosts, from rows with host and html."""
    link = F.explode(F.array_distinct(F.regexp_extract_all(
        F.col("html"), F.lit(r"""(?i)\bhref\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""), 1)))
    links = (pages.filter("host <> '' and html is not null").select("host", link.alias("link"))
             .withColumn("dst", host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link"))
                                        .otherwise(F.col("link"))))
             .filter("dst <> '' and dst <> host").groupBy(F.col("host").alias("src"), "dst")
             .agg(F.count(F.lit(1)).cast("double").alias("w")))
    # every level of the name up to two labels: a.b.c.d -> (a.b.c.d, b.c.d), (b.c.d, c.d); some levels a time, so
    # that the deep names above them are made once
    names = pages.select("host").distinct().select(F.split("host", "\\.").alias("l")).filter("size(l) >= 3")
    up = None
    while True:
        some = names.select(F.explode(F.expr(
            f"transform(sequence(1, least(size(l) - 2, {LEVELS})), i -> struct(array_join(slice(l, i, size(l)), '.') as src,"
            " array_join(slice(l, i + 1, size(l)), '.') as dst))")).alias("e")).select("e.src", "e.dst")
        up = some if up is None else up.unionByName(some)
        names = stored(names.filter(f"size(l) >= {LEVELS + 3}").select(F.expr(f"slice(l, {LEVELS + 1}, size(l))").alias("l")).distinct(),
                       "url-names")
        if names.isEmpty():
            break
    up = up.distinct()
    family = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("w", F.lit(1.0))
    return links.unionByName(family).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE,
              most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, w) and seeds (host, trust, distrust), whose
    columns sum to 1 (or 0). Mass at hosts without an edge out is not passed on. A round is one join and one
    aggregate; the rank is stored every ``STORE_ROUNDS`` rounds, which all have the same plan, until no host's trust or
    distrust has grown by more than ``tolerance`` of itself since the last store (a host first reached has grown by
    all of it). Both only grow from round to round, so that bound holds whatever the number of hosts."""
    both = edges.select("src", "dst", "w", F.lit(True).alias("ahead")).unionByName(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit(False).alias("ahead")))
    out = both.groupBy("src", "ahead").agg(F.sum("w").alias("all"))
    steps = stored(both.join(out, ["src", "ahead"]).select("src", "dst", "ahead", (F.col("w") / F.col("all")).alias("p")),
                   "url-steps")
    restart = stored(seeds.select("host", (F.col("trust") * (1 - damping)).alias("trust"),
                                  (F.col("distrust") * (1 - damping)).alias("distrust")), "url-restart")
    # a round's rows in as few tasks as hold them, or each round writes a file a task
    tasks = 1 + (steps.count() + restart.count()) // ROWS_A_TASK
    rank, zero = restart, F.lit(0.0)
    for _ in range(0, most_rounds, STORE_ROUNDS):
        now = rank
        for k in range(STORE_ROUNDS):
            moved = now.hint("merge").join(steps, F.col("host") == F.col("src")).select(
                F.col("dst").alias("host"), F.when(F.col("ahead"), F.col("trust") * F.col("p") * damping).otherwise(0.0).alias("trust"),
                F.when(~F.col("ahead"), F.col("distrust") * F.col("p") * damping).otherwise(0.0).alias("distrust"))
            parts = moved.unionByName(restart)
            if k < STORE_ROUNDS - 1:
                now = parts.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        before = rank.select("host", zero.alias("trust"), zero.alias("distrust"), F.col("trust").alias("t0"), F.col("distrust").alias("d0"))
        now = parts.select("*", zero.alias("t0"), zero.alias("d0")).unionByName(before).groupBy("host").agg(
            *(F.sum(c).alias(c) for c in ("trust", "distrust", "t0", "d0"))).coalesce(tasks)
        now = stored(now, "url-rank")
        grown = now.agg(F.max(F.greatest(F.coalesce((F.col("trust") - F.col("t0")) / F.nullif(F.col("trust"), F.lit(0.0)), zero),
                                         F.coalesce((F.col("distrust") - F.col("d0")) / F.nullif(F.col("distrust"), F.lit(0.0)), zero)))).first()[0]
        rank = now.select("host", "trust", "distrust")
        if (grown or 0.0) <= tolerance:
            return rank
    raise RuntimeError(f"no convergence to {tolerance} in {most_rounds} rounds")


def judge_urls(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id",
               url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust (of the host)."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"),
                       F.col(html_col).cast("string").alias("html"))
    src = src.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = src.withColumn("rule", rule).withColumn("ruled", verdict)
    by_host = judged.filter("host <> ''").groupBy("host").agg(
        F.sum(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("a"),
        F.sum(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("b"))
    by_host = stored(by_host, "url-hosts")
    total = by_host.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    seeds = by_host.select("host", (F.col("a") / max(total["a"] or 0.0, 1.0)).alias("trust"),
                           (F.col("b") / max(total["b"] or 0.0, 1.0)).alias("distrust"))
    rank = propagate(host_edges(judged), seeds)
    suspect = F.col("distrust") > threshold * (F.col("trust") + F.col("distrust"))
    final = F.coalesce(F.col("ruled"), F.when(suspect, F.lit("block")).otherwise(F.lit("allow")))
    return judged.drop("html").join(rank, "host", "left").select("page_id", "host", "path", "rule", final.alias("verdict"), "trust", "distrust")
