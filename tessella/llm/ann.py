"""Approximate nearest neighbours by collision-counting hashing.

Largest inner product is turned into least distance by one more component (what
a vector's norm lacks of the greatest norm), queries scaled to that norm. Each of many
single projections keeps a shard's vectors in a sorted array. Around a query's own
value a window is opened, as wide as the query's radius asks for; a vector inside the windows
of enough projections is verified by its exact inner product.

A query's first radius comes from a sample of at most ``sample`` vectors: where as many of all are to
be expected as are asked for. A query whose k-th verified vector is within its radius is done. For the others
the same arrays are read again by virtual rehashing, with windows widened to the distance
of the k-th vector found, which no true neighbour exceeds. A vector at a query's radius is verified with
the probability ``recall`` if projections were independent; as they are orthogonal, counts vary less and more is found
(0.98 for 0.83), and still more inside the radius. Where fewer than k were found, all are verified.

Every vector is indexed; shards hold about ``shard_rows`` vectors, and each sees all queries of its vectors' length,
in blocks. The greatest norm, counts and the sample reach the driver, by vector length; more than
``MOST_LENGTHS`` lengths raise.

Null, empty and zero vectors and vectors with null or non-finite components take no
part. Vectors of another length than the query's are no candidates of it. Equal
scores go to the smaller id. Rows are told apart by themselves: a query bars its own row only, and rows that
repeat a query's id are candidates of it; each row of a repeated query has ranks of its own.
An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, tidied
from .embedding_dedup import usable

QUERY_BLOCK = 128
MOST_LENGTHS = 1000
#: No two points of the unit sphere are farther apart.
ALL = 2.1


class Projections:
    """Seeded directions, orthogonal within each group of as many as there are dimensions."""

    def __init__(self, dim: int, count: int, half_width: float, recall: float, seed: int):
        if count > 255:
            raise ValueError("collisions are counted in 8 bits")
        rng = np.random.default_rng(seed)
        groups = []
        while sum(len(g) for g in groups) < count:
            q, _ = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))
            groups.append(q * sqrt(dim + 1))
        self.axes = np.concatenate(groups)[:count].T
        self.half = half_width
        p = erf(half_width / sqrt(2))
        #: Collisions that a vector at the radius reaches with probability ``recall``.
        self.threshold = int(np.floor(count * p - NormalDist().inv_cdf(recall) * sqrt(count * p * (1 - p))))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of norm 1, norms), whatever the size of the components."""
    most = np.abs(x).max(axis=1, keepdims=True)
    unit = x / most
    norm = np.sqrt((unit**2).sum(axis=1, keepdims=True))
    return unit / norm, (most * norm)[:, 0]


class Shard:
    """A part of the vectors with its sorted arrays, in units of the greatest norm."""

    def __init__(self, uid: np.ndarray, ids: np.ndarray, x: np.ndarray, top: float, proj: Projections):
        self.uid, self.ids, self.x, self.top, self.proj = uid, ids, x, top, proj
        y = x / top
        h = np.column_stack([y, np.sqrt(np.maximum(1 - (y**2).sum(axis=1), 0.0))]) @ proj.axes
        order = np.argsort(h, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(h, order, axis=0).T)  # a sorted array each
        n = len(x)
        self.place = np.empty(h.shape[::-1], np.uint8)  # in which 256th of it each vector stands
        for j in range(h.shape[1]):
            self.place[j, order[:, j]] = np.arange(n) * 256 // n

    def collisions(self, unit: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """(queries, vectors): in how many projections a vector's 256th meets the query's window."""
        n = len(self.x)
        hq = np.column_stack([unit, np.zeros(len(unit))]) @ self.proj.axes
        half = self.proj.half * radius
        count, gap, inside = (np.zeros((len(unit), n), t) for t in (np.uint8, np.uint8, bool))
        for place, row, h in zip(self.place, self.sorted, hq.T, strict=True):
            lo = np.searchsorted(row, h - half, side="left") * 256 // n
            last = (np.maximum(np.searchsorted(row, h + half, side="right"), 1) - 1) * 256 // n
            lo = np.minimum(lo, last)
            np.subtract(place, lo.astype(np.uint8)[:, None], out=gap)
            np.less_equal(gap, (last - lo).astype(np.uint8)[:, None], out=inside)
            count += inside.view(np.uint8)
        return count

    def search(self, uid: np.ndarray, q: np.ndarray, radius: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score, distance) of the k best verified of each query."""
        unit, norm = scaled(q)
        met = (self.collisions(unit, radius) >= self.proj.threshold) | (radius >= ALL)[:, None]
        met &= uid[:, None] != self.uid[None, :]
        row, col = np.nonzero(met)
        near = np.empty(len(row))
        for at in range(0, len(row), 65536):
            part = slice(at, at + 65536)
            near[part] = np.einsum("ij,ij->i", q[row[part]], self.x[col[part]])
        order = np.lexsort((self.ids[col], -near, row))
        row, col, near = row[order], col[order], near[order]
        first = np.searchsorted(row, np.arange(len(q)))
        keep = np.arange(len(row)) - first[row] < k
        row, col, near = row[keep], col[keep], near[keep]
        return row, col, near, np.sqrt(np.maximum(2 - 2 * (near / norm[row]) / self.top, 0.0))


def _matrix(col: pa.Array) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, projections: int = 128, half_width: float = 1.4, recall: float = 0.83, shard_rows: int = 4096, sample: int = 2048, seed: int = 7,
            id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that ``is_query`` marks, nearest first."""
    spark = vectors.sparkSession
    arrow_rows(spark)
    scratch = Scratch(spark, "ann")
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.filter(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("id"), v.alias("v"), F.size(vec_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.greatest(F.array_max(v), -F.array_min(v)).alias("most"),
    )
    rows = scratch.save(rows, "rows")
    norm = F.col("most") * F.sqrt(F.aggregate(F.transform("v", lambda x: x / F.col("most")), F.lit(0.0), lambda a, x: a + x * x))
    facts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("top")).orderBy("dim").limit(MOST_LENGTHS + 1).collect()
    if len(facts) > MOST_LENGTHS:
        raise ValueError(f"more than {MOST_LENGTHS} vector lengths")
    if not facts:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    top, n, first, shards = {}, {}, {}, 0
    for r in facts:
        top[r["dim"]], n[r["dim"]], first[r["dim"]] = r["top"], r["n"], (shards, -(-r["n"] // shard_rows))
        shards += first[r["dim"]][1]
    of = lambda get: F.create_map(*[F.lit(x) for d in first for x in (d, get(d))])[F.col("dim")]
    start, many = of(lambda d: first[d][0]), of(lambda d: first[d][1])
    # a tenth of the vectors, ``sample`` at most: what a query's first radius is read from
    share = of(lambda d: min(0.1, sample / n[d]))
    drawn: dict[int, list] = {}
    for r in rows.filter(F.pmod(F.xxhash64("uid", F.lit(seed)), F.lit(1_000_003)) < share * 1_000_003).select("dim", "v").toLocalIterator():
        drawn.setdefault(r["dim"], []).append(r["v"])
    known = spark.sparkContext.broadcast({d: np.array(x) / top[d] for d, x in drawn.items()})  # bounded by ``sample``

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            radius = np.full(b.num_rows, ALL)
            dims = b.column(2).to_numpy()
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                if (x := known.value.get(d)) is not None:
                    unit, _ = scaled(_matrix(b.column(3).take(pa.array(at))))
                    got = np.sort(unit @ x.T, axis=1)[:, ::-1]
                    place = min(len(x) - 1, int(np.ceil(k * len(x) / n[d])))  # one more than expected: the query may be in the sample
                    radius[at] = np.sqrt(np.maximum(2 - 2 * got[:, place], 0.0))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(radius)], [*b.schema.names, "radius"])

    asks = scratch.save(rows.filter("asks").select("uid", "id", "dim", "v").mapInArrow(tidied(open_), "uid bigint, id bigint, dim int, v array<double>, radius double"), "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, shard, held = None, None, []
        for b in batches:
            code = b.column(0).to_numpy() * 2 + b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if code[lo] // 2 != key:
                    key, shard, held = code[lo] // 2, None, []
                if code[lo] % 2 == 0:
                    held.append(part)
                    continue
                if shard is None and held:
                    x = np.concatenate([_matrix(p.column(4)) for p in held])
                    d = x.shape[1]
                    shard = Shard(*(np.concatenate([p.column(i).to_numpy() for p in held]) for i in (2, 3)), x, top[d], Projections(d, projections, half_width, recall, seed))
                    held = []
                for at in range(0, part.num_rows if shard else 0, QUERY_BLOCK):
                    q = part.slice(at, QUERY_BLOCK)
                    uid, radius = q.column(2).to_numpy(), q.column(5).to_numpy()
                    r, c, s, far = shard.search(uid, _matrix(q.column(4)), radius, k)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (uid[r], q.column(3).to_numpy()[r], shard.uid[c], shard.ids[c], s, far, radius[r])], ["uid", "query_id", "at", "vec_id", "score", "far", "radius"])

    best = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id", "at")
    data = rows.select((start + F.pmod(F.xxhash64("uid"), many)).cast("int").alias("place"), F.lit(0).alias("kind"), "uid", "id", "v", F.lit(0.0).alias("radius"))

    def read(queries: DataFrame, name: str) -> DataFrame:
        """The k best of all shards for each query."""
        sent = queries.select(F.explode(F.sequence(start, start + many - 1)).alias("place"), F.lit(1).alias("kind"), "uid", "id", "v", "radius")
        both = data.unionByName(sent).repartitionById(shards, F.col("place")).sortWithinPartitions("place", "kind")
        found = both.mapInArrow(tidied(run), "uid bigint, query_id bigint, at bigint, vec_id bigint, score double, far double, radius double")
        return scratch.save(found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k), name)

    found = read(asks, "found")
    state = found.groupBy("uid").agg(F.count(F.lit(1)).alias("found"), F.max("far").alias("far"), F.max("radius").alias("radius"))
    # a millionth more than the k-th distance, for rounding
    wider = asks.drop("radius").join(state, "uid", "left").filter(F.col("found").isNull() | (F.col("found") < k) | (F.col("far") > F.col("radius")))
    wider = wider.withColumn("radius", F.when(F.col("found") >= k, F.least(F.col("far") * 1.000001 + 1e-9, F.lit(ALL))).otherwise(ALL))
    wider = scratch.save(wider.select("uid", "id", "dim", "v", "radius"), "wider")
    again = read(wider, "again")
    out = found.join(wider.select("uid"), "uid", "left_anti").unionByName(again)
    return out.select("query_id", "rank", "vec_id", "score")
