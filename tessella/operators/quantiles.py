"""Exact medians and other ranks of groups of any size.

A value is mapped to a whole number of the same order. A pass counts, for each group, how many rows fall into each
of ``BINS`` equal bins of the range that still holds the wanted rank, and the range shrinks to one bin. So a group's state is at most
``BINS`` counts, added up in each task before anything is shuffled; no group is sorted or gathered, and a hot one is
spread over all tasks. Ranges up to 65,536 take one pass, up to 2^32 two, doubles four at most.

Nulls don't count; NaN is larger than all numbers; -0.0 equals 0.0. A null group is a group; one without values gives null. An empty table has no groups and gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from . import storage

BINS = 1 << 16
#: Groups whose ranges are sent to all tasks; more are joined.
FEW_GROUPS = 100_000


@cache
def _order_bits():
    @F.pandas_udf("bigint")
    def run(x: pd.Series) -> pd.Series:
        v = x.to_numpy(np.float64, copy=True)
        v[v == 0] = 0.0  # both zeros
        v[np.isnan(v)] = np.nan  # one NaN, the largest
        bits = v.view(np.int64)
        return pd.Series(np.where(bits < 0, -(bits & np.int64((1 << 63) - 1)), bits))

    return run


def _key(x: Column, real: bool) -> Column:
    """A whole number that rises with the value; a double's 64 bits, in order."""
    return F.when(x.isNotNull(), _order_bits()(F.coalesce(x.cast("double"), F.lit(0.0)))) if real else x.cast("bigint")


def ranked(df: DataFrame, value: str, keys: Sequence[str], ranks: dict[str, Column]) -> DataFrame:
    """keys, n and one column a rank: the value at that place (from 0) among a group's values in order. Ranks are columns over ``n``, the group's number of values."""
    real = isinstance(df.schema[value].dataType, DoubleType | FloatType)
    if not real and df.schema[value].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{value}: whole or real numbers only")
    names = [f"__g{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(g) for k, g in zip(keys, names, strict=True)), F.col(value).alias("__v")).withColumn("__x", _key(F.col("__v"), real))
    group = F.struct(*(F.col(g) for g in names)) if names else F.struct(F.lit(1).alias("one"))
    rows = rows.withColumn("__k", F.to_json(group))  # never null, null or not
    state = rows.groupBy("__k", *names).agg(F.count("__v").alias("n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("rank"), at.cast("bigint").alias("at")) for name, at in ranks.items())))
    # lo and hi hold the wanted value; at is its place inside them
    state = storage.cut(state.select("*", wanted.alias("w")).select("__k", *names, "n", "lo", "hi", "w.rank", "w.at"))
    groups = state.select("__k").distinct().count()
    while True:
        open_ = state.filter("lo < hi and at >= 0 and at < n")
        if not open_.limit(1).count():
            break
        width = F.expr(f"(cast(hi as decimal(20,0)) - lo) div {BINS} + 1")  # decimals, as a range may exceed 64 bits; div is exact
        ranges = open_.select("__k", "rank", "lo", "hi", "at", width.alias("width"))
        distinct = ranges.select("__k", "lo", "hi", "width").distinct()
        inside = rows.select("__k", "__x").join(F.broadcast(distinct) if groups <= FEW_GROUPS else distinct, "__k").filter("__x between lo and hi")
        bins = inside.groupBy("__k", "lo", "hi", F.expr("(cast(__x as decimal(20,0)) - lo) div width").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
        hist = bins.groupBy("__k", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("bins"))  # BINS at most
        j = ranges.join(hist, ["__k", "lo", "hi"])
        start = F.struct(F.lit(-1).cast("bigint").alias("bin"), F.col("at").alias("left"), F.lit(False).alias("done"))
        walk = F.aggregate("bins", start, lambda a, b: F.when(a["done"], a).when(a["left"] < b["c"], F.struct(b["bin"].alias("bin"), a["left"].alias("left"), F.lit(True).alias("done"))).otherwise(F.struct(a["bin"].alias("bin"), (a["left"] - b["c"]).alias("left"), F.lit(False).alias("done"))))
        lo = F.col("lo") + F.col("f.bin").cast("decimal(20,0)") * F.col("width").cast("decimal(18,0)")
        moved = j.withColumn("f", walk).select("__k", "rank", lo.cast("bigint").alias("__lo"), F.least(F.col("hi").cast("decimal(38,0)"), (lo + F.col("width") - 1).cast("decimal(38,0)")).cast("bigint").alias("__hi"), F.col("f.left").alias("__at"))
        state = state.join(moved, ["__k", "rank"], "left")
        state = storage.cut(state.select("__k", *names, "n", F.coalesce("__lo", "lo").alias("lo"), F.coalesce("__hi", "hi").alias("hi"), "rank", F.coalesce("__at", "at").alias("at")))
    found = state.filter("at >= 0 and at < n")
    if real:  # the number itself, of the rows that have it
        exact = rows.join(F.broadcast(found.select("__k", "lo").distinct()) if groups <= FEW_GROUPS else found.select("__k", "lo").distinct(), "__k").filter("__x = lo").groupBy("__k", "lo").agg(F.first("__v").alias("__value"))
        found = found.join(exact, ["__k", "lo"])
    else:
        found = found.withColumn("__value", F.col("lo").cast(df.schema[value].dataType))
    wide = state.groupBy("__k", *names).agg(F.first("n").alias("n")).join(found.groupBy("__k").agg(*(F.max(F.when(F.col("rank") == name, F.col("__value"))).alias(name) for name in ranks)), "__k", "left")
    return wide.select(*(F.col(g).alias(k) for g, k in zip(names, keys, strict=True)), "n", *ranks)


def medians(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "median") -> DataFrame:
    """keys, n, ``name``: the exact median as a double, the mean of the two middle values of an even number."""
    n = F.col("n")
    out = ranked(df, value, keys, {"__low": F.floor((n - 1) / 2), "__high": F.floor(n / 2)})
    return out.select(*keys, "n", ((F.col("__low").cast("double") + F.col("__high").cast("double")) / 2).alias(name))


def length_summary(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, min, max, mean, median of a column."""
    facts = df.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    middle = medians(df, value, keys)
    same = F.lit(True)
    right = middle.select(*(F.col(k).alias(f"__m{i}") for i, k in enumerate(keys)), "n", "median")
    for i, k in enumerate(keys):
        same &= facts[k].eqNullSafe(right[f"__m{i}"])
    return facts.join(right, same, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "min", "max", "mean", "median")
