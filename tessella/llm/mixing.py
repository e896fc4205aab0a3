"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of domains, languages and sources. A child that can't use
its share, all its tokens in ``most_epochs`` epochs, passes the shortage to its
siblings first; what no sibling can take goes to the siblings of its ancestors.
A leaf with a budget of k whole epochs and a rest takes each document k times, and
of one more epoch, in an order seeded for that epoch, the longest prefix of
documents whose tokens fit the rest.

Null domains, languages and sources are a leaf named by the empty string. Empty and
null texts have no tokens and cost nothing: they are in each epoch's prefix that
reaches them. An empty table gives an empty result. Repeated rows are rows of their own. Rows that
tie in the seeded order, being of one id, follow hashes of their text and then of all their columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch

#: Order buckets of a leaf; only the bucket in which its budget ends is sorted.
BUCKETS = 4096


def split_budget(budget: float, weights: list[float], room: list[float]) -> list[float]:
    """Shares of a budget by weight, none above its room; what is cut off goes to the others by weight."""
    out, open_ = [0.0] * len(weights), [i for i, w in enumerate(weights) if w > 0 and room[i] > 0]
    left = min(budget, sum(room[i] for i in open_))
    while open_ and left > 1e-9:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if room[i] - out[i] <= left * weights[i] / total + 1e-9]
        if not full:
            for i in open_:
                out[i] += left * weights[i] / total
            break
        for i in full:
            left -= room[i] - out[i]
            out[i] = room[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def leaf_budgets(tokens: Mapping[tuple, int], budget: float, weights: Mapping[tuple, float], most_epochs: int, default: float = 1.0) -> dict[tuple, int]:
    """Token budget of each leaf, a tuple of names from the root down.

    ``weights`` has the weight of a node by its path; a node without one has ``default``.
    """
    room: dict[tuple, float] = {}
    children: dict[tuple, list[tuple]] = {}
    for leaf, n in tokens.items():
        for k in range(len(leaf) + 1):
            room[leaf[:k]] = room.get(leaf[:k], 0.0) + float(n) * most_epochs
    for path in sorted(room):
        if path:
            children.setdefault(path[:-1], []).append(path)
    given = {(): min(budget, room.get((), 0.0))}
    for path in sorted(room, key=len):
        kids = children.get(path, [])
        for kid, x in zip(kids, split_budget(given[path], [weights.get(k, default) for k in kids], [room[k] for k in kids]), strict=True):
            given[kid] = x
    return {leaf: int(given[leaf] + 1e-6) for leaf in tokens}


def mix(docs: DataFrame, domain: Column, weights: Mapping[tuple, float], budget: float | None = None, share: float = 1.0, most_epochs: int = 4, seed: int = 42,
        id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", epoch: str | None = None, most_leaves: int = 1_000_000) -> DataFrame:
    """The chosen rows with their columns, one row for each epoch that has them.

    ``budget``: tokens in all; else ``share`` of what the input has. ``epoch`` names a column
    for the epoch's number, from 0. Leaves, not documents, are counted on the driver; more than ``most_leaves`` raise.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    names = [F.coalesce(c.cast("string"), F.lit("")) for c in (domain, F.col(lang), F.col(source))]
    leaf = F.struct(*(c.alias(n) for c, n in zip(names, ("d", "l", "s"), strict=True)))
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    slim = scratch.save(docs.select(F.col(id_col).alias("id"), leaf.alias("leaf"), tokens.alias("n")), "slim")
    rows = slim.groupBy("leaf").agg(F.sum("n").alias("n")).limit(most_leaves + 1).collect()
    if len(rows) > most_leaves:
        raise ValueError(f"more than {most_leaves} leaves")
    have = {tuple(r["leaf"]): r["n"] for r in rows}
    given = leaf_budgets(have, share * sum(have.values()) if budget is None else budget, weights, most_epochs)
    plan = [(*k, *(divmod(given[k], n) if n else (1, 0))) for k, n in sorted(have.items())]
    plan = spark.createDataFrame(plan, "d string, l string, s string, whole bigint, rest bigint").select(F.struct("d", "l", "s").alias("leaf"), "whole", "rest")

    def order(id_: Column) -> Column:
        return F.xxhash64(F.lit(seed), F.col("whole"), id_)

    def bucket(id_: Column) -> Column:
        return F.shiftrightunsigned(order(id_), 64 - (BUCKETS - 1).bit_length())

    # where each leaf's rest ends: sums of buckets, then the running sum over at most BUCKETS rows a leaf
    sums = slim.join(plan, "leaf").filter("rest > 0").groupBy("leaf", bucket(F.col("id")).alias("bucket")).agg(F.sum("n").alias("n"))
    run = Window.partitionBy("leaf").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    end = (
        sums.withColumn("upto", F.sum("n").over(run)).join(plan, "leaf").filter(F.col("upto") > F.col("rest"))
        .groupBy("leaf").agg(F.min("bucket").alias("end"), F.min_by(F.col("upto") - F.col("n"), "bucket").alias("before"))
    )
    plan = scratch.save(plan.join(end, "leaf", "left").select("leaf", "whole", "rest", F.coalesce("end", F.lit(BUCKETS)).alias("end"), F.coalesce("before", F.lit(0)).alias("before")), "plan")
    columns = docs.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    staged = docs.select(row.alias("row"), F.col(id_col).alias("id"), F.col(text).alias("t"), leaf.alias("leaf")).join(plan, "leaf")
    staged = staged.withColumn("bucket", bucket(F.col("id")))
    more = (F.col("rest") > 0) & (F.col("bucket") < F.col("end"))
    sure = staged.select("row", (F.col("whole") + more.cast("bigint")).alias("times"), "whole", F.lit(False).alias("edge")).filter("times > 0")
    # equal rows of the bucket in which a leaf's rest ends are one; only their order, not their texts, is sorted by leaf
    key = ["leaf", "h", "id", "th", "rh"]
    last = staged.filter((F.col("rest") > 0) & (F.col("bucket") == F.col("end"))).withColumns({"h": order(F.col("id")), "th": F.xxhash64("t"), "rh": F.xxhash64("row")})
    last = last.groupBy(*key, "whole", "rest", "before").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("c"), F.first(F.coalesce(F.regexp_count("t", F.lit(WORD)), F.lit(0)).cast("bigint")).alias("n"))
    last = scratch.save(last, "last")
    within = Window.partitionBy("leaf").orderBy("h", "id", "th", "rh").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("c") * F.col("n")).over(within), F.lit(0))
    fit = last.select(*key, "rest", "before", "c", "n").withColumn("left", left).filter("left >= n")
    fit = fit.select(*key, F.when(F.col("n") == 0, F.col("c")).otherwise(F.least(F.col("c"), F.floor(F.col("left") / F.greatest("n", F.lit(1))))).alias("times"))
    same = [last[k].eqNullSafe(fit[k]) for k in key]
    edge = last.join(fit, same).select("row", "times", "whole", F.lit(True).alias("edge"))
    out = sure.unionByName(edge).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("times") - 1)))
    fields = [F.col("row").getField(c).alias(c) for c in columns]
    return out.select(*fields, *([F.when(F.col("edge"), F.col("whole")).otherwise(F.col("k")).alias(epoch)] if epoch else []))
