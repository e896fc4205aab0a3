"""N-gram Jaccard join: near-duplicate documents by their sets of word shingles.

Adaptive multi-match prefixes: shingles have one global order, rare ones first. Two
sets of Jaccard similarity t share l shingles among the first n - ceil(t n) + l of
each, for any l. A document takes the l of least estimated cost, that is reading the
postings of its longer prefix plus verifying the partners that share l of it, and a
pair is verified once it shares as many prefix shingles as the smaller l of the two.

The frequencies that the order needs are found without an inverted index of the
corpus: shingle hashes go to shards by range, five bytes each, and only those that
occur twice come back, so a shingle in a third of all documents is sent once per
document and never multiplied. Equal sets are one class with one representative.
Documents that are linked with the most central one of a posting list need no other pair of
that list: only pairs across components that remain apart are compared. Before a pair leaves that
comparison, a bound on its overlap must allow a link: shingles that only one set has, and
the differing bits of two parity sketches, differ for certain. The bound loses no link.
Short lists are joined row by row. Long ones, as templates and licences make them, are compared in arrays: by classes of size,
in blocks that meet block by block, once for all shingles that stand behind the same other one in every prefix. That
is still a comparison of sketches for each pair of a long list whose sets link with none, at some nanoseconds each.

Shingles are compared by 64-bit hashes cut to 40 bits and their shard's; sets by a
64-bit sum. Null and empty texts have no shingles and are linked with nothing; texts
with fewer words than a shingle are one shingle. Rows with one id are rows of their
own, whose component is named by that id. Extra columns are ignored. A chunk holds one text at
least, so memory follows the longest text: about 60 bytes for each byte of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, binary_values, chunks, mix64, tidied, word_hashes
from .components import components

_U = np.uint64
_Q = mix64(np.arange(101, 117, dtype=np.uint64))
#: Text and rows in one chunk; documents in it are numbered with 16 bits.
CHUNK_BYTES, CHUNK_ROWS = 1_500_000, 60_000
LOCAL_BITS = 20
#: 64-bit words of a set's parity sketch.
SKETCH = 16
#: Shingles that one shard takes, about.
SHARD_ROWS = 2_000_000
LONGEST = 6
#: Posting lists of more sets are compared in arrays, in blocks of at most so many.
SHORT, BLOCK = 64, 1024


def shingle_sets(raw: np.ndarray, offs: np.ndarray, words: int = 5) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    h, _, _, row = word_hashes(raw, offs)
    n_texts = len(offs) - 1
    n_words = np.bincount(row, minlength=n_texts)
    first = np.concatenate([[0], np.cumsum(n_words)])
    out: list[np.ndarray] = [np.zeros(0, np.uint64)] * n_texts
    if len(h) >= words:
        g = np.zeros(len(h) - words + 1, np.uint64)
        for k in range(words):
            g += h[k : len(h) - words + 1 + k] * _Q[k]
        g = mix64(g)
    for d in np.flatnonzero(n_words).tolist():
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= words:
            out[d] = np.unique(g[a : b - words + 1])
        else:
            out[d] = mix64(np.array([np.add.reduce(h[a:b] * _Q[: b - a])]) + _Q[words] * np.array([b - a], np.uint64))
    return out


def signature(s: np.ndarray) -> int:
    """A 64-bit name of a set of hashes."""
    return int(mix64(np.array([np.add.reduce(mix64(s ^ _Q[9])) + _U(len(s))]))[0].view(np.int64))


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, list[np.ndarray]]]:
    task = TaskContext.get()
    part = task.partitionId() if task else 0
    for i, t in enumerate(chunks(batches, "text", CHUNK_BYTES, CHUNK_ROWS)):
        yield (part << 20) | i, t, shingle_sets(*binary_values(t.column("text")))


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    """Arrays packed one after another, each after its length."""
    out, at = [], 0
    for kind in kinds.split():
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, kind, n, at + 8))
        at += 8 + out[-1].nbytes
    return out


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(x for a in arrays for x in (len(a).to_bytes(8, "little"), a.tobytes()))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """Rows of (key, sub, blob) sorted by key, key by key."""
    key, held = None, []
    for b in batches:
        for k, s, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if k != key and held:
                yield key, held
                held = []
            key = k
            held.append((s, blob))
    if held:
        yield key, held


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, lengths) of the runs of equal rows in rising 16-bit numbers, in runs of at most 255."""
    start = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(row)))
    parts = -(-n // 255)
    last = np.cumsum(parts) - 1
    size = np.full(int(parts.sum()), 255, np.uint8)
    size[last] = n - 255 * (parts - 1)
    return np.repeat(row[start], parts).astype(np.uint16), size


def _sketch(keys: np.ndarray) -> list[int]:
    """For each of 64 * SKETCH bits, whether an odd number of the keys falls on it."""
    odd = np.bincount((mix64(keys) >> _U(20)).astype(np.int64) & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _narrow(k: np.ndarray, width: int) -> bytes:
    """Hashes in as many bytes as they have."""
    return np.ascontiguousarray(k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()


def _width(shards: int) -> int:
    return (40 + (shards - 1).bit_length() + 7) // 8


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(names), types, strict=True)], names)


def _prefix(n: int, keys: np.ndarray, df: np.ndarray, need: int, verify_cost: float) -> tuple[int, np.ndarray]:
    """(l, repeated shingles of the l-prefix in order).

    ``keys`` are those that other sets have too; the n - len(keys) others stand before them.
    """
    order = np.lexsort((keys, df))
    alone, base = n - len(keys), n - need + 1
    if base <= alone:
        return 1, keys[:0]
    best, out = None, 1
    cost = np.cumsum(df[order].astype(np.float64) - 1)
    for ell in range(1, min(LONGEST, need) + 1):
        k = min(len(keys), base + ell - 1 - alone)
        total = cost[k - 1] * (1 + verify_cost / ell)
        if best is None or total < best:
            best, out = total, ell
    return out, keys[order[: min(len(keys), base + out - 1 - alone)]]


def _candidates(docs: DataFrame, shards: int, num: int, den: int, words: int, verify_cost: float) -> DataFrame:
    """Sets that may have a partner: e, sig, n, alone (its own shingles), own (mean of 1 / frequency), ell, prefix (repeated ones, rare first), bits (their sketch), keys (all repeated ones)."""
    bits = (shards - 1).bit_length()
    low, width = _U((1 << 40) - 1), _width(shards)

    def send(batches):
        for uid, _, sets in _tables(batches):
            sigs: dict[int, int] = {}
            for i, s in enumerate(sets):
                if len(s):
                    sigs.setdefault(signature(s), i)  # copies within a chunk go once
            kept = list(sigs.values())
            if not kept:
                continue
            size = np.array([len(sets[i]) for i in kept], np.uint32)
            yield _batch([(-1 - (uid % 61), uid, _pack(np.array(list(sigs), np.int64), size))], ["shard", "chunk", "blob"], [pa.int32(), pa.int64(), pa.binary()])
            flat, row = np.concatenate([sets[i] for i in kept]), np.repeat(np.arange(len(kept)), size)
            shard = (flat >> _U(64 - bits)).astype(np.uint32) if bits else np.zeros(len(flat), np.uint32)
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            rows = []
            for s in range(shards):
                at = order[cut[s] : cut[s + 1]]
                if len(at):
                    key = (flat[at] >> _U(24 - bits)) & low  # the 40 bits after the shard's: rising within a set
                    rows.append((s, uid, _pack(*_runs(row[at]), (key & _U(0xFFFFFFFF)).astype(np.uint32), (key >> _U(32)).astype(np.uint8))))
            yield _batch(rows, ["shard", "chunk", "blob"], [pa.int32(), pa.int64(), pa.binary()])

    def count(batches):
        for shard, rows in _grouped(batches):
            if shard < 0:  # what each chunk holds passes through
                yield _batch([(c, -1, blob) for c, blob in rows], ["chunk", "shard", "blob"], [pa.int64(), pa.int32(), pa.binary()])
                continue
            parts = [_unpack(blob, "u2 u1 u4 u1") for _, blob in rows]
            key = np.concatenate([lo.astype(np.uint64) | (hi.astype(np.uint64) << _U(32)) for _, _, lo, hi in parts])
            order = np.argsort(key)
            k = key[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            start = np.flatnonzero(new)
            df = np.empty(len(k), np.uint16)
            df[order] = np.repeat(np.minimum(np.diff(np.append(start, len(k))), 65535), np.diff(np.append(start, len(k))))
            at = 0
            for (chunk, _), (docs_, sizes, lo, hi) in zip(rows, parts, strict=True):
                d = df[at : at + len(lo)]
                at += len(lo)
                many = d > 1
                if many.any():
                    yield _batch([(chunk, shard, _pack(*_runs(np.repeat(docs_, sizes)[many]), lo[many], hi[many], d[many]))], ["chunk", "shard", "blob"], [pa.int64(), pa.int32(), pa.binary()])

    names = ["e", "sig", "n", "alone", "own", "ell", "prefix", "bits", "keys"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def gather(batches):
        for chunk, rows in _grouped(batches):
            rows.sort(key=lambda r: r[0])
            if rows[0][0] != -1 or len(rows) == 1:
                continue
            sigs, sizes = _unpack(rows[0][1], "i8 u4")
            row, key, df = [], [], []
            for shard, blob in rows[1:]:
                docs_, per, lo, hi, d = _unpack(blob, "u2 u1 u4 u1 u2")
                row.append(np.repeat(docs_, per))
                key.append((_U(shard) << _U(40)) | lo.astype(np.uint64) | (hi.astype(np.uint64) << _U(32)))
                df.append(d)
            row, key, df = np.concatenate(row), np.concatenate(key), np.concatenate(df)
            order = np.argsort(row, kind="stable")
            cut = np.searchsorted(row[order], np.arange(len(sigs) + 1))
            out = []
            for i in range(len(sigs)):
                at, n = order[cut[i] : cut[i + 1]], int(sizes[i])
                need = -(-num * n // den)
                if not len(at) or n - len(at) >= n - need + 1:
                    continue
                k = key[at]  # rising: shards come in order, and hashes rise within each
                ell, prefix = _prefix(n, k, df[at], need, verify_cost)
                if len(prefix):
                    out.append(((chunk << LOCAL_BITS) | i, int(sigs[i]), n, n - len(at), (n - len(at) + float((1.0 / df[at]).sum())) / n, ell, prefix.astype(np.int64), _sketch(k), _narrow(k, width)))
                if len(out) >= 256:
                    yield _batch(out, names, types)
                    out = []
            if out:
                yield _batch(out, names, types)

    sent = docs.mapInArrow(tidied(send), "shard int, chunk bigint, blob binary")
    counted = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidied(count), "chunk bigint, shard int, blob binary")
    return counted.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(tidied(gather), "e bigint, sig bigint, n bigint, alone bigint, own double, ell int, prefix array<bigint>, bits array<bigint>, keys binary")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int, width: int, per_group: int = 256) -> DataFrame:
    """The pairs (a, b) that link. Each set goes once to each group of ``per_group`` partners of its leader a."""
    groups = pairs.groupBy("a").agg((F.floor(F.count(F.lit(1)) / per_group) + 1).cast("int").alias("groups"))
    members = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("g"), F.lit(1).alias("kind"), F.col("b").alias("e"))
    leaders = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("g"), F.lit(0).alias("kind"), F.col("a").alias("e"))
    rows = members.unionByName(leaders).join(sets.select("e", "n", "keys"), "e").select("a", "g", "kind", "e", "n", "keys")

    def check(batches):
        mine, me = None, None
        for b in batches:
            found = []
            for a, kind, other, n, keys in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                k = _widen(keys, width)
                if kind == 0:
                    me, mine, size = a, k, n
                elif me == a:
                    at = np.searchsorted(mine, k)
                    at[at == len(mine)] = 0
                    both = int((mine[at] == k).sum()) if len(mine) else 0
                    if den * both >= num * (n + size - both):
                        found.append((a, other))
            yield _batch(found, ["a", "b"], [pa.int64(), pa.int64()])

    rows = rows.repartition("a", "g").sortWithinPartitions("a", "g", "kind")
    return rows.mapInArrow(tidied(check), "a bigint, b bigint")


def _may_link(num: int, den: int) -> Column:
    """Whether sets _a and _b that meet at a shingle are a pair to count, and bounds on their overlap allow a link."""
    n = F.col("n_a") + F.col("n_b")
    smaller = F.struct("n_a", "e_a") < F.struct("n_b", "e_b")
    index, probe = F.when(smaller, F.col("index_a")).otherwise(F.col("index_b")), F.when(smaller, F.col("probe_b")).otherwise(F.col("probe_a"))
    met = (F.col("comp_a") != F.col("comp_b")) & (~F.col("apart_b") | (F.col("e_a") < F.col("e_b")))  # two sets apart meet once
    met &= (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num) & (F.greatest(index, probe) <= F.least("ell_a", "ell_b"))
    # shingles before the place, at most, and those behind it must reach the overlap asked for
    reach = F.least("at_a", "at_b") + F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
    met &= reach * (num + den) >= n * num
    differ = F.col("alone_a") + F.col("alone_b")
    for i in range(SKETCH):
        differ += F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i]))
    return met & (differ * (num + den) <= n * (den - num))


def _long_lists(rows: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(e_a, e_b) of sets that meet in a long list at the first level, where a link's sets always share a shingle, and may link.

    A shingle whose every set has the same long one next before it adds no pair and is left out.
    """
    before = Window.partitionBy("e").orderBy("at")  # a prefix
    rows = rows.filter("probe <= 1").withColumn("ahead", F.lag("token").over(before))
    kept = rows.groupBy("token").agg(F.min("ahead").alias("low"), F.max("ahead").alias("high"), F.count_if(F.col("ahead").isNull()).alias("none")).filter("none > 0 or low <> high").select("token")
    rows = rows.join(kept, "token").drop("ahead", "size", "ell")
    # sizes of sets that link are in one class or in two that follow
    rows = scratch.save(rows.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / float(np.log(den / num) * (1 + 1e-9))).cast("int")), "long")
    counts = rows.groupBy("token", "class").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    up = counts.select("token", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
    down = counts.select("token", (F.col("class") + 1).alias("class"), F.col("blocks").alias("below"))
    counts = counts.join(up, ["token", "class"], "left").join(down, ["token", "class"], "left").na.fill(0, ["above", "below"])
    own = F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int")
    pair = lambda c1, i, c2, j, side: F.struct(c1.alias("c"), i.alias("i"), c2.alias("d"), j.alias("j"), side.alias("side"))
    each = lambda n: F.slice(F.sequence(F.lit(0), n), 1, n)  # noqa: E731  0 to n - 1, none for 0
    c = F.col("class")
    same = F.transform(each(F.col("blocks")), lambda j: pair(c, F.least("own", j), c, F.greatest("own", j), (F.col("own") > j).cast("int")))
    above = F.transform(each(F.col("above")), lambda j: pair(c, F.col("own"), c + 1, j, F.lit(0)))
    below = F.transform(each(F.col("below")), lambda j: pair(c - 1, j, c, F.col("own"), F.lit(1)))
    dealt = rows.join(counts, ["token", "class"]).withColumn("own", own).withColumn("p", F.explode(F.concat(same, above, below)))
    key = F.xxhash64("token", "p.c", "p.i", "p.d", "p.j")
    words = [F.col("bits")[i].alias(f"w{i}") for i in range(SKETCH)]
    dealt = dealt.select(key.alias("key"), F.col("p.side").alias("side"), ((F.col("p.c") == F.col("p.d")) & (F.col("p.i") == F.col("p.j"))).alias("inner"), "e", "n", "alone", "at", "index", "probe", "comp", "apart", *words)

    def compare(batches):
        for _, t in _runs_of_key(batches):
            side = t["side"]
            inner = bool(t["inner"][0])
            a, b = (t, t) if inner else ({c: v[side == 0] for c, v in t.items()}, {c: v[side == 1] for c, v in t.items()})
            for x, y in _near(a, b, inner, num, den):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["e_a", "e_b"])

    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(tidied(compare), "e_a bigint, e_b bigint").distinct()


def _runs_of_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Columns of the rows of each key; a key has two blocks at most."""
    held: list[dict] = []
    for b in batches:
        cols = {n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)}
        key = cols["key"]
        cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for x, y in zip(cut[:-1], cut[1:], strict=True):
            if held and x < y and held[0]["key"][0] != key[x]:
                yield int(held[0]["key"][0]), {n: np.concatenate([h[n] for h in held]) for n in held[0]}
                held = []
            if x < y:
                held.append({n: v[x:y] for n, v in cols.items()})
    if held:
        yield int(held[0]["key"][0]), {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _near(a: dict, b: dict, inner: bool, num: int, den: int, cells: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(e, e) of the pairs of two blocks that may link, some hundred thousand cells at a time."""
    if not len(a["e"]) or not len(b["e"]):
        return
    bits = [np.stack([t[f"w{i}"] for i in range(SKETCH)]).view(np.uint64) for t in (a, b)]
    step = max(1, cells // len(b["e"]))
    for at in range(0, len(a["e"]), step):
        x = {c: v[at : at + step, None] for c, v in a.items()}
        n, m = x["n"], b["n"][None]
        ok = (x["comp"] != b["comp"]) & (x["apart"] | b["apart"]) & (n * den >= m * num) & (m * den >= n * num)
        if inner:
            ok &= x["e"] < b["e"]
        smaller = (n < m) | ((n == m) & (x["e"] < b["e"]))
        ok &= np.where(smaller, np.maximum(x["index"], b["probe"]), np.maximum(b["index"], x["probe"])) <= 1
        ok &= (np.minimum(x["at"], b["at"]) + np.minimum(n - x["at"], m - b["at"])) * (num + den) >= (n + m) * num
        i, j = np.nonzero(ok)
        if not len(i):
            continue
        i += at
        left = (a["n"][i] + b["n"][j]) * (den - num) // (num + den) - a["alone"][i] - b["alone"][j]  # bits that may differ
        for w in range(0, SKETCH, 2):
            left = left - sum(np.bitwise_count(bits[0][k, i] ^ bits[1][k, j]).astype(np.int64) for k in (w, w + 1))
            may = left >= 0
            i, j, left = i[may], j[may], left[may]
            if not len(i):
                break
        if len(i):
            yield a["e"][i], b["e"][j]


def near_duplicates(docs: DataFrame, threshold: tuple[int, int] = (75, 100), words: int = 5, id_col: str = "doc_id", text: str = "text", verify_cost: float = 8.0) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link where den * |A and B| >= num * |A or B|, in whole numbers, for ``threshold`` (num, den).
    """
    num, den = threshold
    spark = docs.sparkSession
    arrow_rows(spark)
    scratch = Scratch(spark, "jaccard")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def describe(batches):
        for _, t, sets in _tables(batches):
            n = [len(s) for s in sets]
            yield from pa.table([t.column("doc_id").combine_chunks(), pa.array(n, pa.int64()), pa.array([signature(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n", "sig"]).to_batches()

    meta = scratch.save(src.mapInArrow(tidied(describe), f"doc_id {kind}, n bigint, sig bigint"), "meta")
    total = meta.agg(F.sum("n").alias("n")).first()["n"] or 0
    shards = 1 << max(3, min(20, int(total / SHARD_ROWS).bit_length()))
    sets = scratch.save(_candidates(src.select("text"), shards, num, den, words, verify_cost), "sets")
    # one representative of each class of equal sets
    first = sets.groupBy("sig").agg(F.min("e").alias("e"))
    reps = scratch.save(sets.select("e", "sig", "n", "alone", "own", "ell", "prefix", "bits").join(first.select("e"), "e", "left_semi"), "reps")
    # where each shingle stands, and from which l on it is in the prefix: against smaller sets, and against larger ones,
    # which share more of this one
    place = F.col("alone") + F.col("i")
    level = lambda need: F.greatest(F.lit(1), place - (F.col("n") - F.ceil(need)) + 1).cast("int")
    tokens = reps.select("e", "n", "alone", "own", "ell", F.posexplode("prefix").alias("i", "token")).select(
        "token", "e", "n", "own", "ell", place.alias("at"), level(F.col("n") * num / den).alias("probe"), level(F.col("n") * (2 * num) / (num + den)).alias("index")
    )
    fits = lambda a, b: (a * den >= b * num) & (b * den >= a * num)
    # a list's first is the set whose shingles are the most common: what its near copies come from
    base = tokens.filter("probe = 1").select("token", "e", "n", "own")
    lead = base.groupBy("token").agg(F.min(F.struct("own", "e", "n")).alias("lead"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    stars = base.join(lead, "token").filter((F.col("e") != F.col("lead.e")) & fits(F.col("n"), F.col("lead.n"))).select(F.col("lead.e").alias("a"), F.col("e").alias("b")).distinct()
    links = scratch.save(_verify(scratch.save(stars, "stars"), sets, num, den, _width(shards)), "links")
    comp = scratch.save(components(links, scratch, "c"), "comp")
    # what the first pairs of each list have left apart: sets outside a list's largest component, against all others of the list
    named = tokens.join(comp, F.col("e") == F.col("node"), "left").select("token", "e", "n", "ell", "at", "probe", "index", F.coalesce("root", "e").alias("comp"))
    held = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"), F.min(F.col("index") - F.col("ell")).alias("first"))
    open_ = held.groupBy("token").agg(F.max_by("comp", F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("k"), F.min("first").alias("first"), F.sum("m").alias("size")).filter("k > 1 and first <= 0").select("token", "most", "size")
    named = named.join(open_, "token").withColumn("apart", F.col("comp") != F.col("most")).drop("most")
    named = scratch.save(named.join(reps.select("e", "alone", "bits"), "e"), "open")
    rare, long_ = named.filter(F.col("size") <= SHORT), named.filter(F.col("size") > SHORT)
    in_long = long_.groupBy("e").agg(F.count(F.lit(1)).alias("long"))
    rare = rare.join(in_long, "e", "left").withColumn("long", F.coalesce("long", F.lit(0)))
    left, right = (x.select("token", *(F.col(c).alias(f"{c}_{tag}") for c in rare.columns if c != "token")) for x, tag in ((rare.filter("apart"), "a"), (rare, "b")))
    met = left.join(right, (left["token"] == right["token"]) & _may_link(num, den))
    # shingles of long lists are not counted here: as many as either set has may be shared
    met = met.select(F.least("e_a", "e_b").alias("e_a"), F.greatest("e_a", "e_b").alias("e_b"), (F.least("ell_a", "ell_b") - F.least("long_a", "long_b")).alias("need"))
    more = met.groupBy("e_a", "e_b").agg(F.count(F.lit(1)).alias("k"), F.min("need").alias("need")).filter("k >= need").select("e_a", "e_b")
    more = more.unionByName(_long_lists(long_, num, den, scratch)).distinct()
    more = scratch.save(more.select(F.col("e_a").alias("a"), F.col("e_b").alias("b")), "more")
    new = scratch.save(_verify(more, sets, num, den, _width(shards)), "new")
    if new.limit(1).count():
        comp = scratch.save(components(links.unionByName(new), scratch, "d"), "comp-2")
    # components of sets, named by their smallest document
    whole = meta.filter("sig is not null")
    of_set = whole.groupBy("sig").agg(F.min("doc_id").alias("id"))
    linked = reps.select("e", "sig").join(comp, F.col("e") == F.col("node")).select("sig", "root").join(of_set, "sig")
    label = linked.groupBy("root").agg(F.min("id").alias("label"))
    names = scratch.save(of_set.join(linked.join(label, "root").select("sig", "label"), "sig", "left").select("sig", F.coalesce("label", "id").alias("label")), "names")
    out = whole.join(names, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("label", "doc_id").alias("component_id"))
    return out.unionByName(meta.filter("sig is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
