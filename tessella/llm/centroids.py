"""Centroid clustering in whole numbers, with annulus search for the nearest centroid.

Centroids are sorted by norm. A vector's distance to the centroid next to it in norm bounds its nearest distance, u; by
the triangle inequality only centroids whose norm is within u of the vector's can be as near. A binary search
finds that annulus, bounds included, and its members are compared exactly. The ``FIRST`` centroids next to the vector
in norm are compared first, and u is the least of their distances, which narrows the annulus.

A round is one pass: each task assigns its vectors and adds up each cluster's components, and one row
a cluster and task is shuffled. Only centroids come to the driver: their number times their length, at most ``MOST_NUMBERS``.

Vectors that are null, of another length, or hold null or non-finite components are left out. Component x
becomes floor(scale * x); those beyond 2^25 in size, whose squared distances may not fit 64 bits, are an error. Rows of
one id are vectors of their own; where they tie for a start they are taken by their components. With fewer
vectors than ``k`` all of them start a cluster; without any the result is empty. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, chunks, tidied

#: Numbers in all centroids together.
MOST_NUMBERS = 20_000_000
#: Sizes up to which products add up exactly in doubles, and squared distances in 64 bits.
EXACT_DOUBLE, EXACT_LONG = 1 << 22, 1 << 25
#: Centroids next to a vector in norm that are compared first.
FIRST = 4
CHUNK_BYTES = 4_000_000


class Annulus:
    """Exact nearest centroids; ``compared`` counts distances, ``asked`` vectors."""

    def __init__(self, centroids: np.ndarray):
        c = np.asarray(centroids, np.int64)
        self.square = (c * c).sum(axis=1)
        self.order = np.lexsort((np.arange(len(c)), self.square))
        self.c, self.square = c[self.order], self.square[self.order]
        self.norm = np.sqrt(self.square.astype(np.float64))
        self.small = not c.size or np.abs(c).max() < EXACT_DOUBLE
        self.compared = self.asked = 0

    def _distance(self, x: np.ndarray, xx: np.ndarray, at: int | np.ndarray, doubles: bool) -> np.ndarray:
        """Squared distances of vectors to one centroid, or of each to its own."""
        c = self.c[at]
        if doubles:
            dot = x @ c.astype(np.float64) if c.ndim == 1 else np.einsum("ij,ij->i", x, c.astype(np.float64))
            return xx + self.square[at] - 2 * dot.astype(np.int64)
        d = x - c
        return (d * d).sum(axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each vector's nearest centroid, ties to the smaller number."""
        x = np.asarray(x, np.int64)
        n, k = len(x), len(self.c)
        xx = (x * x).sum(axis=1)
        doubles = self.small and (not x.size or np.abs(x).max() < EXACT_DOUBLE)
        y = x.astype(np.float64) if doubles else x
        norm = np.sqrt(xx.astype(np.float64))
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k, np.int64)

        def compare(rows: np.ndarray, at) -> None:
            d = self._distance(y[rows], xx[rows], at, doubles)
            name = self.order[at]
            better = (d < best[rows]) | ((d == best[rows]) & (name < number[rows]))
            to = rows[better]
            best[to], number[to] = d[better], name if np.ndim(name) == 0 else name[better]
            self.compared += len(rows)

        begin = np.clip(np.searchsorted(self.norm, norm) - FIRST // 2, 0, max(0, k - FIRST))
        everyone = np.arange(n)
        first = min(FIRST, k)
        for j in range(first):
            compare(everyone, begin + j)
        u = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (u + norm) + 1e-6  # beyond what rounding can move: ties at the bound stay inside
        low = np.searchsorted(self.norm, norm - u - slack, side="left")
        high = np.searchsorted(self.norm, norm + u + slack, side="right")
        for j in range(k):
            rows = np.flatnonzero((low <= j) & (j < high) & ((j < begin) | (j >= begin + first)))
            if len(rows):
                compare(rows, j)
        self.asked += n
        return number, best


def start_key(seed: int, id_: Column) -> Column:
    """The order in which vectors start clusters."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")), 256)


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, dim)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: float = 256.0, seed: int = 2, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per kept vector: its id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    if k * dim > MOST_NUMBERS:
        raise ValueError(f"{k} centroids of {dim} components are more than the driver and each task may hold")
    spark = vectors.sparkSession
    arrow_rows(spark)
    scratch = Scratch(spark, "clusters")
    x = F.col(vec_col).cast("array<double>")
    fine = F.coalesce((F.size(x) == dim) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))
    fits = F.forall(x, lambda c: F.abs(F.lit(scale) * c) < EXACT_LONG)
    whole = F.when(fits, F.transform(x, lambda c: F.floor(F.lit(scale) * c).cast("bigint"))).otherwise(F.raise_error(F.lit("a component is too large for exact squared distances")).cast("array<bigint>"))
    rows = scratch.save(vectors.filter(fine).select(F.col(id_col).alias("id"), whole.alias("x")), "vectors")
    start = rows.select(start_key(seed, F.col("id")).alias("key"), "x").orderBy("key", "x").limit(k).collect()  # k rows
    centres = np.array([r["x"] for r in start], np.int64).reshape(-1, dim)

    def sums(c: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find, total, n = Annulus(c), np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64)
            for t in chunks(batches, "x", CHUNK_BYTES):
                v = _matrix(t.column("x"), dim)
                number, _ = find.nearest(v)
                np.add.at(total, number, v)
                n += np.bincount(number, minlength=len(c))
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(n[there]), pa.array(list(total[there]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

        return run

    for _ in range(rounds if len(centres) else 0):
        part = rows.select("x").mapInArrow(tidied(sums(centres)), "cluster int, n bigint, total array<bigint>")
        added = part.select("cluster", "n", F.posexplode("total").alias("i", "s")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        centres = centres.copy()
        for r in added.collect():  # k rows for each component
            centres[r["cluster"], r["i"]] = r["s"] // r["n"]

    kind = rows.schema["id"].dataType.simpleString()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Annulus(centres)
        for t in chunks(batches, "x", CHUNK_BYTES):
            number, d = find.nearest(_matrix(t.column("x"), dim))
            yield pa.RecordBatch.from_arrays([t.column("id").combine_chunks(), pa.array(number.astype(np.int32)), pa.array(d)], ["id", "cluster", "distance"])

    if len(centres):
        told = scratch.save(rows.mapInArrow(tidied(assign), f"id {kind}, cluster int, distance bigint"), "assigned")
    else:
        told = rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
    if len(centres):
        scratch.drop("vectors")
    each = {r["cluster"]: r["s"] for r in told.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    total = sum(each.values())
    facts = [(i, each.get(i, 0), total, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres.tolist())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
