"""Corpus cleaning: normalise, length, language, near duplicates, contamination, with stage statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions import batches as arrow
from ..functions import text as T
from . import order, storage


def normalise(c: Column | str) -> Column:
    """NFKC, then without control characters."""
    return T.remove_control_chars(T.nfkc(c))


def gram_hashes(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's character n-grams; a shorter text is its own."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k = min(n, len(cp))
    if not k:
        return cp
    h = np.full(len(cp) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + cp[i : len(cp) - k + 1 + i] + np.uint64(1)
        h ^= h >> np.uint64(29)
    return np.unique(h * np.uint64(0xBF58476D1CE4E5B9))


def contamination(docs: DataFrame, evals: DataFrame, n: int = 13, key: str = "id", text: str = "text", most_pool: int = 8_000_000) -> DataFrame:
    """key, overlap: the share of a document's distinct n-grams that an evaluation text has.

    Grams are hashed to 64 bits, in time linear in the text. The evaluation set's distinct grams go to all tasks where they are
    ``most_pool`` at most, so documents are read once and nothing is shuffled; a larger pool is joined by gram.
    A text without grams has overlap 0. Rows of one key, or of none, are rows of their own.
    """
    spark = docs.sparkSession
    arrow.small(spark)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                g = pa.array(gram_hashes(b.column(b.num_columns - 1)[at].as_py(), n).view(np.int64))
                keys = [b.column(i).take(pa.array(np.full(len(g), at, np.int64))) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*keys, g], [*b.schema.names[:-1], "g"])

    pool = storage.cut(evals.select(F.col(text).cast("string")).mapInArrow(grams, "g bigint").distinct())
    kind = docs.select(key).schema
    rows = docs.select(key, F.col(text).cast("string").alias("__text"))
    if pool.count() > most_pool:
        # by text, whatever its rows' keys are
        digest = F.md5(F.coalesce("__text", F.lit("")).cast("binary"))
        texts = rows.select(digest.alias("__d"), "__text").dropDuplicates(["__d"])
        found = texts.mapInArrow(grams, "__d string, g bigint").join(pool.withColumn("hit", F.lit(1)), "g", "left")
        found = found.groupBy("__d").agg((F.count("hit") / F.count(F.lit(1))).alias("overlap"))
        return rows.select(key, digest.alias("__d")).join(found, "__d", "left").select(key, F.coalesce("overlap", F.lit(0.0)).alias("overlap"))
    known = spark.sparkContext.broadcast(np.sort(pool.toArrow()["g"].to_numpy().view(np.uint64)))  # most_pool at most

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = known.value
        for b in batches:
            out = []
            for t in b.column(1):
                g = gram_hashes(t.as_py(), n)
                at = np.searchsorted(p, g)
                at[at == len(p)] = 0
                out.append(float((p[at] == g).mean()) if len(g) and len(p) else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], [key, "overlap"])

    return rows.mapInArrow(share, StructType([*kind, StructField("overlap", DoubleType())]))


def banding(threshold: float, perms: int) -> tuple[int, int]:
    """(bands, rows) of least false positives plus false negatives."""
    x = (np.arange(2000) + 0.5) / 2000
    best = None
    for b in range(1, perms + 1):
        for r in range(1, perms // b + 1):
            p = 1 - (1 - x**r) ** b
            loss = p[x < threshold].sum() + (1 - p)[x >= threshold].sum()
            if best is None or loss < best[0]:
                best = loss, b, r
    return best[1], best[2]


def signature(t: str, perms: int, ngram: int, fill: np.ndarray) -> np.ndarray | None:
    """The smallest gram hash of each of ``perms`` equal ranges of hashes; an empty range takes that of the first filled one in its row of ``fill``."""
    h = gram_hashes(t, ngram)  # distinct and rising
    if not len(h):
        return None
    edge = np.arange(perms, dtype=np.uint64) * np.uint64((1 << 64) // perms)
    at = np.searchsorted(h, edge)
    full = at < np.append(at[1:], len(h))
    value = (h[np.minimum(at, len(h) - 1)] >> np.uint64(3)).astype(np.int64) & 0x7FFFFFFF
    if not full.all():
        bare = np.flatnonzero(~full)
        value[bare] = value[fill[bare, full[fill[bare]].argmax(axis=1)]]
    return value.astype(np.int32)


def minhash(c: Column | str, perms: int = 128, ngram: int = 5, seed: int = 1) -> Column:
    """The MinHash signature over distinct character n-grams (D1); null for an empty text.

    One hash a gram: its range of hashes names a place, and each place keeps its least. Empty places borrow from filled ones, each
    in an order of its own, so that the share of equal places still estimates the Jaccard similarity: over 60 to 400
    grams and 128 places, on average within 0.04.
    """
    arrow.small()
    fill = np.argsort(np.random.default_rng(seed).random((perms, perms)), axis=1)

    @F.pandas_udf("array<int>")
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([None if not t else signature(t, perms, ngram, fill) for t in s], dtype=object)

    return sign(T.as_column(c))


def lsh_buckets(docs: DataFrame, group: str, pos: str, text: str = "text", perms: int = 128, threshold: float = 0.8, ngram: int = 5) -> tuple[DataFrame, DataFrame]:
    """(buckets, copies): buckets (group, key, p) hold the documents of one group that share a band (J11, D2), two at least;
    copies (group, p) have the signature of an earlier document.

    Whatever keeps or drops the first of equal signatures drops the later ones, so they need no bucket: a
    group of exact copies costs nothing here. Documents of a bucket are never paired.
    """
    bands, rows = banding(threshold, perms)
    signed = storage.cut(storage.deal(docs).select(group, F.col(pos).alias("p"), minhash(text, perms, ngram).alias("s")).filter("s is not null").withColumn("d", F.md5(F.array_join("s", ",").cast("binary"))))
    first = signed.groupBy(group, "d").agg(F.min("p").alias("first"))
    signed = signed.join(first, [group, "d"])
    keys = F.array(*(F.concat(F.lit(f"{k}/"), F.md5(F.array_join(F.slice("s", k * rows + 1, rows), ",").cast("binary"))) for k in range(bands)))
    members = storage.cut(signed.filter("p = first").select(group, "p", F.explode(keys).alias("key")))
    shared = members.groupBy(group, "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return members.join(shared, [group, "key"], "left_semi").select(group, "key", "p"), signed.filter("p > first").select(group, "p")


def _keep_in_blocks(left: DataFrame, group: str, block: int) -> DataFrame:
    """(group, p) of the documents kept as far as buckets tell inside blocks of consecutive undecided documents.

    A task reads its block in order and holds only the block's keys. The first block is always decided whole.
    """
    placed = storage.cut(order.with_position(left.select(group, "p").distinct(), F.col(group), F.col("p"), name="at"))
    rows = storage.cut(left.join(placed, [group, "p"]).withColumn("k", F.floor(F.col("at") / block)))
    earliest = rows.groupBy(group, "key").agg(F.min("k").alias("k0"))
    rows = rows.join(earliest, [group, "key"]).select("k", "at", F.md5(F.to_json(F.struct(group, "key")).cast("binary")).alias("key"), (F.col("k0") < F.col("k")).alias("outer"))

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, keys, open_, kept, undecided = None, [], False, set(), set()

        def close() -> bool:
            if any(k in kept for k in keys):
                return False
            if open_ or any(k in undecided for k in keys):
                undecided.update(keys)
                return False
            kept.update(keys)
            return True

        for f in frames:
            out = []
            for x, key, outer in zip(f["at"].tolist(), f["key"], f["outer"].tolist(), strict=True):
                if x != at:
                    if at is not None:
                        if close():
                            out.append(at)
                        if at // block != x // block:
                            kept, undecided = set(), set()
                    at, keys, open_ = x, [], False
                keys.append(key)
                open_ = open_ or outer
            yield pd.DataFrame({"at": out}, dtype="int64")
        if at is not None and close():
            yield pd.DataFrame({"at": [at]}, dtype="int64")

    told = rows.repartition("k").sortWithinPartitions("at").select("at", "key", "outer").mapInPandas(decide, "at bigint")
    return placed.join(told, "at").select(group, "p")


def keep_first_in_buckets(nodes: DataFrame, buckets: DataFrame, group: str, most_rounds: int = 20, block: int = 1 << 15) -> DataFrame:
    """(group, p, kept): kept iff no kept earlier document is in one of its buckets (group, key, p), as a pass in order decides (D3).

    Round by round: documents that are the first undecided one of all their buckets are kept, others of these buckets
    dropped. A round takes a minimum a bucket, so it is linear in the buckets' rows, however large one is. After ``most_rounds``
    rounds each round also decides whole blocks of what is left, so chains of any length end.
    """
    left = storage.cut(buckets.select(group, "key", "p").distinct())
    dropped, rounds, n = None, 0, left.count()
    while n:
        rounds += 1
        if rounds > most_rounds:
            kept = _keep_in_blocks(left, group, block)
        else:
            firsts = left.groupBy(group, "key").agg(F.min("p").alias("first"))
            kept = left.join(firsts, [group, "key"]).groupBy(group, "p").agg(F.bool_and(F.col("p") == F.col("first")).alias("ok")).filter("ok").drop("ok")
        kept = storage.cut(kept)
        taken = left.join(kept, [group, "p"], "left_semi").select(group, "key").distinct()
        rest = left.join(kept, [group, "p"], "left_anti")
        gone = storage.cut(rest.join(taken, [group, "key"], "left_semi").select(group, "p").distinct())
        left = storage.cut(rest.join(gone, [group, "p"], "left_anti"))
        dropped = gone if dropped is None else dropped.unionByName(gone)
        if (m := left.count()) >= n:
            raise RuntimeError(f"{n} memberships stay undecided")
        n = m
    if dropped is None:
        return nodes.select(group, "p", F.lit(True).alias("kept"))
    return nodes.join(dropped.withColumn("__gone", F.lit(True)), [group, "p"], "left").select(group, "p", F.col("__gone").isNull().alias("kept"))


def greedy_keep_first(nodes: DataFrame, edges: DataFrame, group: str, most_rounds: int = 20, block: int = 1 << 15) -> DataFrame:
    """keep_first_in_buckets for given links (group, a, b) of an earlier and a later document."""
    if edges.filter("not coalesce(a < b, false)").limit(1).count():
        raise RuntimeError("documents stay undecided: an edge must join an earlier document to a later one")
    pairs = edges.select(group, F.concat_ws("/", "a", "b").alias("key"), F.explode(F.array("a", "b")).alias("p"))
    return keep_first_in_buckets(nodes, pairs, group, most_rounds, block)


def drop_stage(docs: DataFrame, min_chars: int = 50, max_chars: int = 50_000, threshold: float = 0.5, languages: tuple[str, ...] = ("ja", "en")) -> DataFrame:
    """docs with normalised text, language and stage: the first of length and language that removes it, or null (F1, F2)."""
    d = docs.withColumn("text", normalise("text"))
    d = d.withColumn("language", T.detect_language("text", threshold))
    stage = F.when(~F.length("text").between(min_chars, max_chars), "length").when(~F.col("language").isin(*languages), "language")
    return d.withColumn("stage", stage)


def clean_corpus(docs: DataFrame, evals: DataFrame | None = None, corpus: str = "corpus", pos: str = "pos", min_chars: int = 50, max_chars: int = 50_000, lang_threshold: float = 0.5,
                 languages: tuple[str, ...] = ("ja", "en"), perms: int = 128, minhash_threshold: float = 0.8, ngram: int = 5, eval_ngram: int = 13, eval_threshold: float = 0.5) -> DataFrame:
    """docs with text, language and stage (null: kept), all four stages in order and each corpus by itself (O1).

    A null corpus is a corpus. ``pos`` is unique in its corpus and not null.
    """
    own = "__corpus"  # never null
    d = storage.cut(drop_stage(storage.deal(docs), min_chars, max_chars, lang_threshold, languages).withColumn(own, F.to_json(F.struct(F.col(corpus).alias("c")))))
    left = d.filter("stage is null")
    buckets, copies = lsh_buckets(left, own, pos, "text", perms, minhash_threshold, ngram)
    first = left.select(own, F.col(pos).alias("p")).join(copies, [own, "p"], "left_anti")
    gone = keep_first_in_buckets(first, buckets, own).filter("not kept").select(own, "p").unionByName(copies)
    late = gone.select(own, F.col("p").alias(pos), F.lit("dedup").alias("late"))
    if evals is not None:  # keys and stages move, not texts: a duplicate is compared too, and stays a duplicate
        hit = contamination(left.select(F.struct(own, pos).alias("key"), "text"), evals, eval_ngram, "key").filter(F.col("overlap") >= eval_threshold)
        late = late.unionByName(hit.select("key.*", F.lit("contamination").alias("late"))).groupBy(own, pos).agg(F.max("late").alias("late"))  # "dedup" is the greater
    d = d.join(storage.cut(late), [own, pos], "left").withColumn("stage", F.coalesce("stage", "late")).drop("late")
    return d.select(*docs.columns, *(c for c in ("language", "stage") if c not in docs.columns))


def stage_stats(cleaned: DataFrame, corpus: str = "corpus") -> DataFrame:
    """corpus, stage, before, removed, remaining, removal_rate of each stage in order, from one pass (A1)."""
    stages = ("length", "language", "dedup", "contamination")
    counts = cleaned.groupBy(corpus).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.coalesce(F.col("stage") == s, F.lit(False))).alias(s) for s in stages))
    rows, before = [], F.col("n")
    for s in stages:
        rows.append(F.struct(F.lit(s).alias("stage"), before.alias("before"), F.col(s).alias("removed"), (before - F.col(s)).alias("remaining"), F.coalesce(F.try_divide(F.col(s), before), F.lit(0.0)).alias("removal_rate")))
        before = before - F.col(s)
    return counts.select(corpus, F.inline(F.array(*rows)))
