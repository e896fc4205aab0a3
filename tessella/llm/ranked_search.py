"""Ranked lexical search: document-at-a-time merges over compressed postings, shard by shard.

``build`` turns each task's documents into shards. A shard numbers its documents in ascending order of
their ids; each of its terms has one row with its postings: documents' numbers as gaps, and counts, in as few bytes as the
largest needs. Corpus facts (documents, terms, a term's document frequency) are sums over all shards.

``search`` answers a set of queries in blocks. A shard's task merges a query's postings with a heap of cursors, one a
term, keyed by the next document's number: the cursors that stand inside the heap's next window of numbers move together, their
postings are merged by document, and each document's score is complete before the next window. A bounded heap keyed by score,
then id, keeps the best; its last score is the bar. Terms whose best scores together stay under
the bar open no documents: they are only looked up for documents that others opened, while these can still reach the bar. The bar is kept
from shard to shard of a task. A task's best rows per query then meet in one global merge.

A term's text is known by a 64-bit hash; with 10^4 query terms against 10^9 terms a false match has a chance of 10^-6. Null and empty texts have no term and don't
count as documents; a query without terms, or without a document that scores above 0, has no rows; without documents the result is
empty. Texts are read whole: a text of n bytes takes some 60 n bytes of memory in its task, one text at a time. Rows of one id are documents (or queries) of their own; null ids come
first among equal scores. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, binary_values, chunks, run_hashes, tidied

#: Documents and postings of a shard.
SHARD_DOCS, SHARD_POSTINGS = 1 << 16, 2_000_000
#: Documents that cursors move over together.
WINDOW = 1 << 13
#: Terms of all queries of one block.
BLOCK_TERMS = 200_000
#: What ends a term: all ASCII characters that are neither letters nor digits.
GAPS = np.array([c for c in range(128) if not chr(c).isalnum()])
_PARTS = "u1", "u2", "u4"


def pack(term: np.ndarray, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(each term once, its postings) of postings in order of term and document number; counts are at least 1.

    A posting list is a byte that says both widths, then gaps between numbers, then counts less 1.
    """
    start = np.flatnonzero(np.append(True, term[1:] != term[:-1])) if len(term) else np.zeros(0, np.int64)
    n = np.diff(np.append(start, len(term)))
    gaps, less = np.diff(numbers, prepend=0), counts - 1
    gaps[start] = numbers[start]
    widths = [np.searchsorted([1 << 8, 1 << 16], np.maximum.reduceat(x, start) if len(start) else start, side="right") for x in (gaps, less)]
    size = 1 + n * ((1 << widths[0]) + (1 << widths[1]))
    at = np.concatenate([[0], np.cumsum(size)])
    data = np.zeros(int(at[-1]), np.uint8)
    data[at[:-1]] = widths[0] | widths[1] << 4
    which = np.repeat(np.arange(len(start)), n)
    place = np.arange(len(term)) - start[which]
    begin = at[:-1] + 1
    for x, kind in zip((gaps, less), widths, strict=True):
        width = (1 << kind)[which]
        to = begin[which] + place * width
        for byte in range(4):
            there = np.flatnonzero(width > byte)
            if len(there):
                data[to[there] + byte] = (x[there] >> (8 * byte)) & 255
        begin = begin + n * (1 << kind)
    return start, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(rising document numbers, counts) of a posting list."""
    gap, kind = _PARTS[blob[0] & 15], _PARTS[blob[0] >> 4]
    n = (len(blob) - 1) // (int(gap[1]) + int(kind[1]))
    numbers = np.cumsum(np.frombuffer(blob, gap, n, 1), dtype=np.int64)
    return numbers, np.frombuffer(blob, kind, n, 1 + n * int(gap[1])).astype(np.int64) + 1


def _shards(batches: Iterator[pa.RecordBatch], most_docs: int = SHARD_DOCS, most_postings: int = SHARD_POSTINGS) -> Iterator[tuple]:
    """(ids, lengths, terms, numbers, counts) of each shard, by term and then number."""
    held, docs, postings = [], 0, 0

    def close():
        ids = pa.chunked_array([x for x, *_ in held]).combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else ids.chunk(0)
        by = pc.array_sort_indices(ids, null_placement="at_start").to_numpy()
        number = np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        size = np.concatenate([n for _, n, *_ in held])
        at = np.cumsum([0, *(len(n) for _, n, *_ in held[:-1])])
        term = np.concatenate([t for _, _, t, _, _ in held])
        doc = number[np.concatenate([r + a for (_, _, _, r, _), a in zip(held, at, strict=True)])]
        count = np.concatenate([c for *_, c in held])
        order = np.lexsort((doc, term))
        return ids.take(pa.array(by)), size[by], term[order], doc[order], count[order]

    for t in chunks(batches, "text", 1_500_000, most_docs):
        if docs and docs + t.num_rows > most_docs:
            yield close()
            held, docs, postings = [], 0, 0
        h, _, _, row = run_hashes(*binary_values(t.column("text")), GAPS)
        order = np.argsort(h, kind="stable")  # rows rise inside a term
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        start = np.flatnonzero(new)
        key = t.column("doc_id").combine_chunks()
        held.append((key.chunk(0) if isinstance(key, pa.ChunkedArray) else key, np.bincount(row, minlength=t.num_rows).astype(np.int64), h[start], row[start], np.diff(np.append(start, len(h)))))
        docs, postings = docs + t.num_rows, postings + len(start)
        if postings >= most_postings:
            yield close()
            held, docs, postings = [], 0, 0
    if held:
        yield close()


class Index:
    """Tables of an index: ``docs`` (shard, docs, terms, ids, lengths), ``postings`` (shard, term, df, blob); n: documents with a term; total: their terms."""

    def __init__(self, docs: DataFrame, postings: DataFrame):
        self.docs, self.postings = docs, postings
        got = docs.agg(F.sum("docs").alias("n"), F.sum("terms").alias("l")).first()
        self.n, self.total = int(got["n"] or 0), int(got["l"] or 0)


def build(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", most_docs: int = SHARD_DOCS, most_postings: int = SHARD_POSTINGS) -> Index:
    """Indexes every row of ``docs``; one pass, nothing is shuffled. Ids are whole numbers."""
    spark = docs.sparkSession
    arrow_rows(spark)
    names = ["shard", "term", "df", "docs", "terms", "blob", "ids", "lengths"]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for i, (ids, size, term, doc, count) in enumerate(_shards(batches, most_docs, most_postings)):
            shard = task << 20 | i
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((shard, None, None, int((size > 0).sum()), int(size.sum()), None, ids.to_pylist(), size.tolist()), kinds, strict=True)], names)
            start, blobs = pack(term, doc, count)
            df = np.diff(np.append(start, len(term)))
            for at in range(0, len(start), 8192):
                part = start[at : at + 8192]
                none = [pa.nulls(len(part), k) for k in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), shard)), pa.array(term[part].view(np.int64)), pa.array(df[at : at + 8192]), none[3], none[4], blobs.slice(at, 8192).cast(pa.binary()), none[6], none[7]], names)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = scratch.save(src.mapInArrow(tidied(index), "shard bigint, term bigint, df bigint, docs bigint, terms bigint, blob binary, ids array<bigint>, lengths array<bigint>"), "index")
    return Index(made.filter("term is null").select("shard", "docs", "terms", "ids", "lengths"), made.filter("term is not null").select("shard", "term", "df", "blob"))


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(q, id, term, times) of each query row's different terms; q is the row's own number."""
    src = queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, "text", 1_500_000):
            h, _, _, row = run_hashes(*binary_values(t.column("text")), GAPS)
            pairs, times = np.unique(np.stack([row.astype(np.uint64), h]), axis=1, return_counts=True)
            at = pa.array(pairs[0].astype(np.int64))
            yield from pa.table([t.column("q").take(at), t.column("id").take(at), pa.array(pairs[1].view(np.int64)), pa.array(times)], ["q", "id", "term", "times"]).to_batches()

    return src.mapInArrow(tidied(split), "q bigint, id bigint, term bigint, times bigint")


def weight(n: int, df: np.ndarray) -> np.ndarray:
    """A term's weight, from the number of documents and those that hold it."""
    return np.floor(1000.0 * np.log((2.0 * n + 2.0) / (2.0 * np.asarray(df, np.float64) + 1.0))).astype(np.int64)


def length_factor(size: np.ndarray, n: int, total: int) -> np.ndarray:
    """A document's m, by its length."""
    if size.size and int(size.max()) * 75 * n >= 1 << 63:
        return np.array([25 + 75 * int(x) * n // total for x in size], np.int64)
    return 25 + size * (75 * n) // total


def gain(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one occurrence of a term in a query adds to a document's score, over its weight."""
    return 1_000_000_000 * counts // (1000 * counts + 8 * m)


class Best:
    """A query's best documents: a bounded heap keyed by score, then smaller id first."""

    def __init__(self, k: int):
        self.k, self.heap, self.bar = k, [], 1  # a score of 0 never enters

    def offer(self, scores: list[int], ids: list[int | None]) -> None:
        for s, i in zip(scores, ids, strict=True):
            if s < self.bar:
                continue
            key = (s, i is None, -(i or 0))
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, key)
            elif key > self.heap[0]:
                heapq.heapreplace(self.heap, key)
        if len(self.heap) == self.k:
            self.bar = self.heap[0][0]

    def rows(self) -> list[tuple[int | None, int]]:
        return [(None if none else -i, s) for s, none, i in self.heap]


def merge(lists: list[tuple[np.ndarray, np.ndarray, int]], best: Best, ids: list, window: int = WINDOW) -> int:
    """Offers ``best`` every document of a shard that may enter; lists: (numbers, points, most points) of each term. Returns how many postings were read.

    A document with the bar's score still enters by a smaller id, so only what stays under the bar is left out.
    """
    lists = sorted(lists, key=lambda x: x[2])
    tops = np.cumsum([x[2] for x in lists])
    cursor = [0] * len(lists)
    idle = 0  # lists[:idle] open no documents
    heap = [(int(x[0][0]), j) for j, x in enumerate(lists)]
    heapq.heapify(heap)
    read = 0
    while heap:
        while idle < len(lists) and tops[idle] < best.bar:
            idle += 1
        begin = heap[0][0]
        end = begin + window
        numbers, points = [], []
        while heap and heap[0][0] < end:
            _, j = heapq.heappop(heap)
            if j < idle:
                continue
            own = lists[j][0]
            to = cursor[j] + int(np.searchsorted(own[cursor[j] :], end))
            numbers.append(own[cursor[j] : to])
            points.append(lists[j][1][cursor[j] : to])
            cursor[j] = to
            if to < len(own):
                heapq.heappush(heap, (int(own[to]), j))
        if not numbers:
            continue
        if len(numbers) == 1:
            doc, score = numbers[0], points[0]
        else:
            flat = np.concatenate(numbers)
            order = np.argsort(flat, kind="stable")  # a merge of rising runs
            flat = flat[order]
            start = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
            doc, score = flat[start], np.add.reduceat(np.concatenate(points)[order], start)
        read += sum(map(len, numbers))
        for j in range(idle - 1, -1, -1):  # the best of the idle first
            may = score + tops[j] >= best.bar
            if not may.all():
                doc, score = doc[may], score[may]
            if not len(doc):
                break
            own = lists[j][0]
            at = np.searchsorted(own, doc)
            at[at == len(own)] = 0
            score = score + np.where(own[at] == doc, lists[j][1][at], 0)
            read += len(doc)
        if len(doc) > best.k:
            least = max(best.bar, np.partition(score, -best.k)[-best.k])
            doc, score = doc[score >= least], score[score >= least]
        best.offer(score.tolist(), [ids[d] for d in doc.tolist()])
    return read


def search(index: Index, queries: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text", scratch: Scratch | None = None, block_terms: int = BLOCK_TERMS, window: int = WINDOW) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query, equal scores by ascending id."""
    spark = queries.sparkSession
    scratch = scratch or Scratch(spark, "search")
    found = None
    wanted = scratch.save(query_terms(queries, id_col, text_col), "queries")
    df = index.postings.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    wanted = scratch.save(wanted.join(df, "term"), "weighted")
    for number, block in enumerate(_blocks(wanted, block_terms)):
        part = scratch.save(_answer(index, block.select("q", "id", "term", "times", "df"), k, window), f"found-{number}")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select(F.col("id").alias("item_id"), F.col("rank").cast("int"), "doc_id", "score")


def _blocks(wanted: DataFrame, most: int) -> Iterator[DataFrame]:
    """The queries in blocks of about ``most`` terms; a query is in one block."""
    total = wanted.count()
    n = -(-total // most)
    for i in range(n):
        yield wanted.filter(F.pmod(F.xxhash64("q"), F.lit(n)) == i) if n > 1 else wanted


def _answer(index: Index, block: DataFrame, k: int, window: int) -> DataFrame:
    """(q, id, doc_id, score): each task's best documents of each query of a block."""
    spark = block.sparkSession
    rows = block.toArrow()  # about BLOCK_TERMS rows
    q, id_, term, times, df = (rows.column(c).to_numpy() if c != "id" else rows.column(c).to_pylist() for c in rows.column_names)
    terms, which = np.unique(term, return_inverse=True)
    n, total = index.n, index.total
    weights = np.zeros(len(terms), np.int64)
    weights[which] = weight(n, df)
    order = np.argsort(q, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(q[order]) != 0)).tolist() + [len(q)]
    asked = [(int(q[order[a]]), id_[order[a]], which[order[a:b]], times[order[a:b]]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    shared = spark.sparkContext.broadcast((terms, weights, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights, asked = shared.value
        best = [Best(k) for _ in asked]
        for ids, size, known, blobs in _by_shard(batches):
            m = length_factor(size, n, total)
            lists = {}
            for t, blob in zip(np.searchsorted(terms, known).tolist(), blobs, strict=True):
                numbers, counts = unpack(blob)
                points = weights[t] * gain(counts, m[numbers])
                lists[t] = numbers, points, int(points.max())
            for b, (_, _, which, times) in zip(best, asked, strict=True):
                own = [(lists[t][0], lists[t][1] * x if x > 1 else lists[t][1], lists[t][2] * x) for t, x in zip(which.tolist(), times.tolist(), strict=True) if t in lists and lists[t][2]]
                if own:
                    merge(own, b, ids, window)
        out = [(q, i, d, s) for (q, i, _, _), b in zip(asked, best, strict=True) for d, s in b.rows()]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], ["q", "id", "doc_id", "score"])

    words = spark.createDataFrame(pa.table({"term": pa.array(terms)})) if len(terms) else spark.createDataFrame([], "term bigint")
    postings = index.postings.join(F.broadcast(words), "term").select("shard", "term", "blob", F.lit(None).cast("array<bigint>").alias("ids"), F.lit(None).cast("array<bigint>").alias("lengths"))
    heads = index.docs.select("shard", F.lit(None).cast("bigint").alias("term"), F.lit(None).cast("binary").alias("blob"), "ids", "lengths")
    both = heads.unionByName(postings).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("term"))
    return both.mapInArrow(tidied(run), "q bigint, id bigint, doc_id bigint, score bigint")


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(ids, lengths, terms, blobs) of each shard; its head comes first."""
    ids = size = None
    known, blobs = [], []
    for b in batches:
        for t, blob, i, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4), strict=True):
            if t is None:
                if known:
                    yield ids, size, np.array(known, np.int64), blobs
                ids, size = i.as_py(), np.array(n.as_py(), np.int64)
                known, blobs = [], []
            else:
                known.append(t)
                blobs.append(blob)
    if known:
        yield ids, size, np.array(known, np.int64), blobs
