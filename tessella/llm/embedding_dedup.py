"""Near-duplicate vectors by cross-polytope hashing.

Each of several tables turns a vector by three rounds of random signs and a fast
Hadamard transform, cuts the result into blocks, and names the nearest signed axis of each:
the cross-polytope hash. Besides its own bucket a vector probes those with a block's second
nearest axis (multiprobe). Vectors that meet in a bucket are candidates; their cosine is
computed in double precision, and a pair counts once, in the first table where it met.

As many tables are made as a simulation of pairs at the threshold asks for, so that the chance to
miss one, ``miss``, doesn't move with the number of vectors; pairs above the threshold are missed far less.
Codes go about without vectors first; only what shares a bucket with another's own code is sent with its vector.

Equal vectors are one class, so copies are never paired. A bucket is read in blocks
of bounded size, pair of blocks by pair of blocks, with links summed and components
contracted inside each, so what leaves a bucket grows with its rows, not its pairs.

Null and zero vectors and vectors with null or non-finite components link with
nothing. Vectors of different length never link. Repeated ids are rows of their own.
An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, tidied
from .components import components

#: Rows of a bucket's block.
BLOCK = 512


def usable(v: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    d = v.cast("array<double>")
    bad = F.exists(d, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(d, lambda x: x != 0.0), F.lit(False))


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to a rotation; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


class CrossPolytope:
    """``tables`` hashes of ``blocks`` signed axes each."""

    def __init__(self, dim: int, tables: int, blocks: int, seed: int = 1):
        self.dim, self.tables, self.blocks = dim, tables, blocks
        self.width = 1 << max(3, (max(1, dim) - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice([-1.0, 1.0], (tables, blocks, 3, self.width))

    def hash(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(own, probes): (tables, rows) bucket codes, and (tables, blocks, rows) codes with one block's second axis."""
        n = len(x)
        p = np.zeros((n, self.width))
        p[:, : self.dim] = x
        own = np.zeros((self.tables, n), np.int64)
        probes = np.zeros((self.tables, self.blocks, n), np.int64)
        for t in range(self.tables):
            code, step = np.zeros((self.blocks, n), np.int64), np.zeros((self.blocks, n), np.int64)
            for b in range(self.blocks):
                y = p
                for k in range(3):
                    y = hadamard(y * self.signs[t, b, k])
                a = np.abs(y)
                top = np.argpartition(a, -2, axis=1)[:, -2:]
                swap = a[np.arange(n), top[:, 0]] > a[np.arange(n), top[:, 1]]
                first, second = np.where(swap, top[:, 0], top[:, 1]), np.where(swap, top[:, 1], top[:, 0])
                axis = [2 * i + (y[np.arange(n), i] < 0) for i in (first, second)]
                code[b], step[b] = axis[0], axis[1] - axis[0]
            scale = (2 * self.width) ** np.arange(self.blocks, dtype=np.int64)
            own[t] = (code * scale[:, None]).sum(axis=0)
            probes[t] = own[t] + step * scale[:, None]
        return own, probes


def tables_for(dim: int, blocks: int, threshold: float, miss: float, pairs: int = 4000) -> int:
    """Tables with which a pair at the threshold meets in none with a probability of ``miss``."""
    rng = np.random.default_rng(0)
    a, b = (rng.standard_normal((pairs, dim)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    norm = np.linalg.norm(b, axis=1, keepdims=True)
    b = threshold * a + np.sqrt(max(0.0, 1 - threshold**2)) * np.divide(b, norm, out=np.zeros_like(b), where=norm > 0)
    lsh = CrossPolytope(dim, 2, blocks, 2)
    (own_a, more_a), (own_b, more_b) = lsh.hash(a), lsh.hash(b)
    met = (own_a == own_b) | (more_a == own_b[:, None]).any(axis=1) | (more_b == own_a[:, None]).any(axis=1)
    p = min(0.999, max(0.01, met.mean()))
    return max(2, int(np.ceil(np.log(miss) / np.log(1 - p))))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    while (root[root] != root).any():
        root = root[root]
    return root


def near_vectors(vectors: DataFrame, threshold: float = 0.95, miss: float = 1e-4, id_col: str = "vec_id", vec_col: str = "embedding", seed: int = 1) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    arrow_rows(spark)
    scratch = Scratch(spark, "vectors")
    vec = F.col(vec_col).cast("array<double>")
    src = vectors.select(F.col(id_col).alias("vec_id"), F.when(usable(F.col(vec_col)), vec).alias("v"))
    # classes of equal vectors, each named by a 128-bit digest of its components
    src = scratch.save(src.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.md5(F.array_join(F.col("v").cast("array<string>"), ",").cast("binary"))).alias("cls")), "rows")
    classes = src.filter("cls is not null").groupBy("cls").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = scratch.save(classes.select("cls", "id", "copies", "v", F.size("v").alias("dim"), F.xxhash64("cls").alias("e")), "classes")
    sizes = classes.groupBy("dim").count().collect()  # one row for each vector length
    parts = []
    for r in sorted(sizes, key=lambda r: r["dim"]):
        d, n = r["dim"], r["count"]
        width = 1 << max(3, (d - 1).bit_length())
        blocks = max(1, min(60 // (2 * width).bit_length(), int(np.ceil(np.log(8.0 * n) / np.log(2 * width)))))  # eight codes a vector
        tables = tables_for(d, blocks, threshold, miss)
        parts.append(_linked(classes.filter(F.col("dim") == d), CrossPolytope(d, tables, blocks, seed), threshold, scratch, f"codes-{d}"))
    if not parts:
        return src.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = scratch.save(found, "found")
    links = found.groupBy("e").agg(F.sum("links").alias("links"))
    edges = found.filter("root is not null and root <> e").select(F.col("e").alias("a"), F.col("root").alias("b")).distinct()
    comp = components(edges, scratch, "c")
    named = classes.join(comp, F.col("e") == F.col("node"), "left").select("cls", "id", "copies", "e", F.coalesce("root", "e").alias("root"))
    label = named.groupBy("root").agg(F.min("id").alias("label"))
    named = scratch.save(named.join(label, "root").join(links, "e", "left").select("cls", "label", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    out = src.select("vec_id", "cls").join(named, "cls", "left")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("label", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _linked(classes: DataFrame, lsh: CrossPolytope, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    """(e, links, root) rows: sums of e's links by bucket, counted in copies, and a smaller set linked in the bucket."""
    tables, probes = lsh.tables, lsh.blocks
    kind = np.int32 if (2 * lsh.width) ** lsh.blocks < 1 << 31 else np.int64

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            own, more = lsh.hash(x)
            codes = np.ascontiguousarray(np.concatenate([own[:, None], more], axis=1).transpose(2, 0, 1).reshape(len(x), -1))  # a row: tables, 1 + probes
            flat = pa.array([r.tobytes() for r in codes.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary()), flat, pa.array(list(codes), pa.list_(pa.int64()))], ["e", "copies", "x", "codes", "list"])

    wide = scratch.save(classes.select("e", "copies", "v").mapInArrow(tidied(hashed), "e bigint, copies bigint, x binary, codes binary, list array<bigint>"), name)
    rows = wide.select("e", F.posexplode("list").alias("i", "code")).select("e", F.floor(F.col("i") / (1 + probes)).cast("int").alias("t"), "code", ((F.col("i") % (1 + probes)) == 0).alias("own"))
    # a bucket matters if a vector's own code meets another there; over BLOCK rows it is read as pairs of blocks
    met = rows.groupBy("t", "code").agg(F.count(F.lit(1)).alias("m"), F.max("own").alias("own")).filter(F.col("own") & (F.col("m") > 1))
    rows = rows.join(met.select("t", "code", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), ["t", "code"])
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("e", F.lit(5)), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("mine")).alias("p"), F.greatest(o, F.col("mine")).alias("q")))
    rows = rows.withColumn("pq", F.explode(pairs)).select("t", "code", "pq.p", "pq.q", "mine", "own", "e").join(wide.select("e", "copies", "x", "codes"), "e")
    rows = rows.select("t", "code", "p", "q", "mine", "own", "e", "copies", "x", "codes")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        key = None
        out: dict[int, list] = {}

        def settle():
            t, code, p, q = key
            if len(held) < 2 or not any(r[1] for r in held):
                return
            e = np.array([r[2] for r in held])
            mine = np.array([r[0] for r in held])
            own = np.array([r[1] for r in held])
            x = np.frombuffer(b"".join(r[4] for r in held), np.float64).reshape(len(held), -1)
            sim = x @ x.T >= threshold
            # a pair meets where one's own bucket is the other's own or probed bucket
            sim &= own[:, None] | own[None, :]
            if p != q:
                sim &= mine[:, None] != mine[None, :]
            a, b = np.nonzero(np.triu(sim, 1))
            if not len(a):
                return
            c = np.frombuffer(b"".join(r[5] for r in held), kind).reshape(len(held), tables, 1 + probes)
            ok = e[a] != e[b]
            a, b = a[ok], b[ok]
            first = _first_meeting(c, a, b, t, code)
            a, b = a[first], b[first]
            if not len(a):
                return
            copies = np.array([r[3] for r in held])
            links = np.bincount(a, copies[b], len(held)) + np.bincount(b, copies[a], len(held))
            order = np.argsort(e)
            rank = np.argsort(order)
            root = e[order[_roots(len(e), rank[a], rank[b])]][rank]
            for i in np.flatnonzero(links).tolist():
                # sums go out by (set, root)
                k = (int(e[i]), int(root[i]))
                out[k] = out.get(k, 0) + int(links[i])

        def flush():
            ks = list(out)
            r = pa.RecordBatch.from_arrays([pa.array([k[0] for k in ks], pa.int64()), pa.array([out[k] for k in ks], pa.int64()), pa.array([k[1] for k in ks], pa.int64())], ["e", "links", "root"])
            out.clear()
            return r

        for b in batches:
            for t, code, p, q, mine, own, e, copies, x, codes in zip(*(b.column(i).to_pylist() for i in range(10)), strict=True):
                if (t, code, p, q) != key:
                    if held:
                        settle()
                    held, key = [], (t, code, p, q)
                held.append((mine, own, e, copies, x, codes))
            if len(out) > 50_000:
                yield flush()
        if held:
            settle()
        yield flush()

    rows = rows.repartition("t", "code", "p", "q").sortWithinPartitions("t", "code", "p", "q")
    return rows.mapInArrow(tidied(check), "e bigint, links bigint, root bigint")


def _first_meeting(c: np.ndarray, a: np.ndarray, b: np.ndarray, t: int, code: int) -> np.ndarray:
    """Whether (table t, bucket code) is the first place where each pair meets; c: (rows, tables, 1 + probes) codes."""
    first = np.ones(len(a), bool)
    for s in range(t):
        own_a, own_b = c[a, s, 0], c[b, s, 0]
        first &= ~((c[b, s] == own_a[:, None]).any(axis=1) | (c[a, s] == own_b[:, None]).any(axis=1))
    # within a table a pair may meet in both own buckets: the smaller counts
    own_a, own_b = c[a, t, 0], c[b, t, 0]
    in_a, in_b = (c[b, t] == own_a[:, None]).any(axis=1), (c[a, t] == own_b[:, None]).any(axis=1)
    where = np.where(in_a & in_b, np.minimum(own_a, own_b), np.where(in_a, own_a, own_b))
    return first & (where == code)
