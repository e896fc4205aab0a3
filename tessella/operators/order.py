"""Ordered and seeded selection: positions, keyed de-duplication, top-k, samples, prefixes.

Order is by explicit columns, never by arrival. Seeded orders are md5(seed, key), which any SQL engine can follow.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import permute
from . import storage


def seeded(seed: int | str, *keys: Column) -> Column:
    """A seeded shuffle's sort key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys)).cast("binary"))


def with_position(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """Dense positions from 0 in the given order, without a single-task window.

    Rows are range-partitioned and sorted; each partition's count gives the offset of the next.
    """
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed = storage.cut(placed)  # the ranges are sampled: they must be drawn once only
    placed = placed.withColumn("__part", F.shiftright("__id", 33)).withColumn("__seq", F.col("__id").bitwiseAND((1 << 33) - 1))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    offsets = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__off"))  # a row a partition
    return placed.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__seq") + F.col("__off")).drop("__id", "__part", "__seq", "__off")


def shuffled(df: DataFrame, seed: int | str, *order_by: Column, name: str = "place") -> DataFrame:
    """Each row's place, from 0, in a seeded global order (X1, X3, X5): computed from its position in ``order_by``, not sorted.

    Write it with ``repartitionByRange(name)`` and ``sortWithinPartitions(name)``, or read any part of the order by a filter on it.
    """
    placed = with_position(df, *order_by, name="__pos")
    return placed.withColumn(name, permute.place(F.col("__pos"), placed.count(), seed)).drop("__pos")


def last_wins(df: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """One row a key: the last by position."""
    w = Window.partitionBy(*keys).orderBy(F.desc(pos))
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def sample_rows(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Up to n rows without replacement, the first in seeded order (X4). No task gathers the sample."""
    return budget_prefix(df, F.lit(1), n, [], seed, key)


def stratified_sample(df: DataFrame, group: str, n: int, seed: int, key: str) -> DataFrame:
    """Up to n rows of each group, by seeded order."""
    w = Window.partitionBy(group).orderBy(seeded(seed, F.col(key)), F.col(key))
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows in order."""
    return df.orderBy(*order).limit(k)


def slice_rows(df: DataFrame, skip: int, take: int, *order: Column) -> DataFrame:
    """Rows skip to skip + take in order (S14); filters come after. No task gathers what is skipped."""
    at = F.col("__at")
    return with_position(df, *order, name="__at").filter((at >= skip) & (at < skip + take)).drop("__at")


def head_fraction(df: DataFrame, fraction: float, *order: Column) -> DataFrame:
    """The first max(1, int(n * fraction)) rows in order."""
    return slice_rows(df, 0, max(1, int(df.count() * fraction)), *order)


def package_prefix(df: DataFrame, package: str, *order: Column) -> DataFrame:
    """full, deci or centi: all, a tenth or a hundredth of the rows in order, one at least."""
    return slice_rows(df, 0, max(1, df.count() // {"full": 1, "deci": 10, "centi": 100}[package]), *order)


def budget_prefix(df: DataFrame, size: Column, budget: Column | int, group: Sequence[str], seed: int, key: str, digits: int = 4) -> DataFrame:
    """Of each group, in seeded order, rows while the running size is within budget.

    A null group is a group. The order is cut into 16^``digits`` buckets. Only the one in which a group's budget ends is summed row by row, so a large group is no single task's window.
    """
    b = F.lit(budget) if isinstance(budget, int) else budget
    h = seeded(seed, F.col(key))
    rows = df.withColumns({"__h": h, "__n": size, "__b": F.conv(F.substring(h, 1, digits), 16, 10).cast("int"), "__budget": b})
    sums = rows.groupBy(*group, "__b").agg(F.sum("__n").alias("__s"))
    run = Window.partitionBy(*(group or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    starts = sums.withColumn("__from", F.sum("__s").over(run) - F.col("__s"))
    starts = starts.select(*(F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group)), F.col("__b").alias("__bucket"), "__from", "__s")
    same = rows["__b"] == starts["__bucket"]
    for i, g in enumerate(group):
        same &= rows[f"`{g}`"].eqNullSafe(starts[f"__g{i}"])
    placed = rows.join(starts, same)
    sure = placed.filter(F.col("__from") + F.col("__s") <= F.col("__budget")).select(*df.columns)
    edge = placed.filter((F.col("__from") <= F.col("__budget")) & (F.col("__from") + F.col("__s") > F.col("__budget")))
    w = Window.partitionBy(*group, "__b").orderBy("__h", key).rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("__run", F.col("__from") + F.sum("__n").over(w)).filter(F.col("__run") <= F.col("__budget"))
    return sure.unionByName(edge.select(*df.columns))


def sequential_ids(df: DataFrame, prefix: str, start: int, *order: Column) -> DataFrame:
    """Ids prefix-00000 on, in order, continuing from start."""
    return with_position(df, *order, name="__at").withColumn("id", F.format_string(f"{prefix}-%05d", F.col("__at") + start)).drop("__at")


def oversample(df: DataFrame, weight: int, key: str = "id") -> DataFrame:
    """weight copies of each row, with ids x, x-dup1, ... (X6); none where the weight is 0 or less."""
    if weight <= 0:
        return df.withColumn(key, F.col(key).cast("string")).limit(0)
    out = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.lit(weight - 1))))
    return out.withColumn(key, F.when(F.col("__k") == 0, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("-dup"), F.col("__k").cast("string")))).drop("__k")


def normalize_ratios(ratios: Mapping[str, float]) -> dict[str, float]:
    """Ratios that sum to 1 (A4); empty, negative or all-zero ones raise."""
    if not ratios or any(v < 0 for v in ratios.values()) or sum(ratios.values()) <= 0:
        raise ValueError("ratios must be non-negative and not all zero")
    total = sum(ratios.values())
    return {k: v / total for k, v in ratios.items()}


def language_volume(df: DataFrame, group: str, unit: str = "documents", tokens: str = "n_tokens") -> DataFrame:
    """Documents or tokens of each group (A2)."""
    if unit not in ("documents", "tokens"):
        raise ValueError(f"unknown unit: {unit}")
    if unit == "tokens" and tokens not in df.columns:
        raise ValueError(f"no field {tokens}")
    return df.groupBy(group).agg((F.count(F.lit(1)) if unit == "documents" else F.sum(tokens)).alias("available"))


def mix(df: DataFrame, ratios: Mapping[str, float], seed: int = 42, group: str = "language", unit: str = "documents", key: str = "id", tokens: str = "n_tokens", place: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, stats): groups in the given ratios, the scarcest capping the total (X1, X2, A3, A5); with ``place`` a column of that name has each row's place in a global shuffle."""
    share = normalize_ratios(ratios)
    have = {r[group]: r["available"] for r in language_volume(df, group, unit, tokens).filter(F.col(group).isin(list(share))).collect()}
    total = min((have.get(g, 0) / s for g, s in share.items() if s > 0), default=0)
    target = {g: int(total * s) for g, s in share.items()}
    wanted = F.create_map(*[x for g, n in target.items() for x in (F.lit(g), F.lit(n))])
    rows = df.filter(F.col(group).isin(list(share)))
    if unit == "documents":
        out = budget_prefix(rows, F.lit(1), wanted[F.col(group)], [group], seed, key)
    else:
        out = budget_prefix(rows, F.col(tokens), wanted[F.col(group)], [group], seed, key)
    size = F.count(F.lit(1)) if unit == "documents" else F.sum(tokens)
    got = out.groupBy(group).agg(size.alias("selected"))
    facts = df.sparkSession.createDataFrame([(g, int(have.get(g, 0)), float(share[g])) for g in share], f"{group} string, available bigint, target_ratio double")
    stats = facts.join(got, group, "left").withColumn("selected", F.coalesce("selected", F.lit(0)).cast("bigint"))
    return out if place is None else shuffled(out, seed, F.col(key), name=place), stats
