"""URL filtering by link-graph propagation, in DataFrame operations only.

Host edges come from absolute links in the pages' html. Trust spreads by
personalised PageRank from hosts that allow rules cover, distrust by the same
walk over reversed edges from hosts that block rules cover. A host is blocked
where distrust outweighs trust by more than the threshold. A page's own rule, if
one fits, always decides before its host's score does.

Null or odd urls have an empty host and path, fit no rule and are allowed. An
empty table gives an empty result. Repeated rows are judged each for itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: An absolute or scheme-relative link's host.
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of its text and action; null where none does.

    A rule ``(action, "host/path")`` fits its host and all subdomains if the url's
    path starts with the rule's path.
    """
    out = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, w): how often pages of one host link to another host.

    The links of a page are counted before the shuffle, so a host with a third of
    all pages sends one row per task and target.
    """
    return (
        pages.select(host_of(F.col(url)).alias("src"), F.explode(F.regexp_extract_all(F.col(html), F.lit(LINK), F.lit(1))).alias("dst"))
        .select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
        .filter((F.col("src") != "") & (F.col("dst") != "") & (F.col("src") != F.col("dst")))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, most_steps: int = 2000, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust): both personalised walks, advanced together.

    ``edges``: src, dst, w. ``seeds``: host, t0, d0 >= 0. Each kind's seeds are scaled to sum to 1;
    a kind without seeds stays 0. What a host without links to pass on holds leaves the walk.
    Stops when no host's score moves by more than ``tolerance`` of itself; raises if ``most_steps`` don't get there.
    Links are walked to any distance from a seed.
    """
    scratch = Scratch(edges.sparkSession, "url")
    edges = scratch.save(edges, "edges")
    total = seeds.agg(F.sum("t0").alias("t"), F.sum("d0").alias("d")).first()
    tele = scratch.save(
        seeds.select("host", (F.col("t0") / F.lit(total["t"] or 1.0)).alias("t0"), (F.col("d0") / F.lit(total["d"] or 1.0)).alias("d0")), "seeds"
    )
    if edges.limit(1).count() == 0:  # nothing to walk over: what the seeds hold stays
        return tele.select("host", (F.col("t0") * (1 - damping)).alias("trust"), (F.col("d0") * (1 - damping)).alias("distrust"))
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("total"))
    steps = scratch.save(
        edges.join(out, "src").select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("w") / F.col("total")).alias("t"), F.lit(0.0).alias("d"))
        .unionByName(edges.join(into, "dst").select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("w") / F.col("total")).alias("d"))),
        "steps",
    )
    start = tele.select("host", (F.col("t0") * (1 - damping)).alias("t0"), (F.col("d0") * (1 - damping)).alias("d0"))
    scores = start.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    for i in range(most_steps):
        moved = steps.join(scores, steps["at"] == scores["host"]).select(
            F.col("to").alias("host"), (F.col("t") * F.col("trust") * damping).alias("t0"), (F.col("d") * F.col("distrust") * damping).alias("d0")
        )
        new = moved.unionByName(start).groupBy("host").agg(F.sum("t0").alias("trust"), F.sum("d0").alias("distrust"))
        new = scratch.save(new, f"scores-{i}")
        old = scores.select("host", F.col("trust").alias("t1"), F.col("distrust").alias("d1"))
        moved_by = lambda a, b: F.when(F.col(a) > 0, F.abs(F.col(a) - F.coalesce(b, F.lit(0.0))) / F.col(a)).otherwise(0.0)
        gap = new.join(old, "host", "left").agg(F.max(F.greatest(moved_by("trust", "t1"), moved_by("distrust", "d1"))).alias("gap")).first()["gap"]
        if i:
            scratch.drop(f"scores-{i - 1}")
        scores = new
        if (gap or 0.0) <= tolerance:
            return scores
    raise RuntimeError(f"the walk has not settled in {most_steps} steps")


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], threshold: float = 0.5, damping: float = 0.85,
                page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust.

    ``verdict`` is the fitting rule's action; without a rule it is ``block`` if the host's
    distrust is more than ``threshold`` of its trust and distrust together, else ``allow``.
    """
    judged = pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    judged = judged.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    seeds = (
        judged.filter(F.col("fit").isNotNull() & (F.col("host") != ""))
        .groupBy("host")
        .agg(F.avg((F.col("fit.action") == "allow").cast("double")).alias("t0"), F.avg((F.col("fit.action") == "block").cast("double")).alias("d0"))
    )
    scores = propagate(host_edges(pages, url, html), seeds, damping)
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    method = F.when((F.coalesce("distrust", F.lit(0.0)) > 0) & (share > threshold), "block").otherwise("allow")
    return judged.join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.action"), method).alias("verdict"), "trust", "distrust"
    )
