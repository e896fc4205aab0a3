"""Byte-level BPE: encoding whole texts and decoding ids back.

Two tiers: a minimal perfect hash over the vocabulary answers pre-tokens that are
themselves tokens; any other pre-token is merged with a heap of adjacent pairs over
a doubly linked list of its bytes. Texts are split in numpy arrays where the pattern is the usual one, else by
the pattern itself. Each worker remembers the answers of a bounded number of pre-tokens, so a batch asks once for each
that it hasn't met. The vocabulary is given, never trained here.

A null text is empty; an empty text has no ids and decodes to nothing. Texts are
encoded whole, whatever their length, and rows keep their order and repeats; an empty table gives an empty result. Long texts are
split in parts cut where no pre-token crosses; one without a blank between letters or digits is one part, some 100 bytes
of memory for each character. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from . import pretokens
from .common import arrow_rows, chunks, tidied
from .pretokens import PieceIds


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file of lines: base64 token, space, rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash by displacement: n keys in n slots, with the keys kept for verification."""

    def __init__(self, keys: dict[bytes, int]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        self.slot_key: list[bytes | None] = [None] * n
        self.slot_value = np.full(n, -1, np.int64)
        self.seed = [0] * self.buckets
        groups: dict[int, list[tuple[int, bytes]]] = {}
        for k in keys:
            h = xxhash.xxh64_intdigest(k)
            groups.setdefault((h >> 40) % self.buckets, []).append((h, k))
        free = np.ones(n, bool)
        singles = []
        for b, members in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            d = 1
            while True:
                at = [self._slot(h, d) for h, _ in members]
                if len(set(at)) == len(at) and all(free[s] for s in at):
                    break
                d += 1
            self.seed[b] = d
            self._put(at, members, keys, free)
        for (b, member), s in zip(singles, np.flatnonzero(free).tolist(), strict=False):
            self.seed[b] = -1 - s  # alone in its bucket: sent to a slot directly
            self._put([s], [member], keys, free)

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & 0xFFFFFFFFFFFFFFFF
        x = ((x ^ (x >> 29)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
        return (x >> 20) % self.n

    def _put(self, at, members, keys, free):
        for s, (_, k) in zip(at, members, strict=True):
            free[s] = False
            self.slot_key[s], self.slot_value[s] = k, keys[k]

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.seed[(h >> 40) % self.buckets]
        s = -1 - d if d < 0 else self._slot(h, d)
        return int(self.slot_value[s]) if self.slot_key[s] == key else -1


class BpeCodec:
    """Encodes and decodes with a table of ranks and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = 6_000_000):
        self.ranks, self.pattern, self.memo_limit = ranks, pattern, memo  # memo: ids and pre-tokens remembered
        self.perfect = PerfectHash(ranks)
        self._ready()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("ranks", "pattern", "memo_limit", "perfect")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self):
        import regex

        self.find = regex.compile(self.pattern).findall
        self.memo = PieceIds(lambda pieces: [self.piece_ids(p.encode()) for p in pieces], self.memo_limit)
        top = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * top
        for t, r in self.ranks.items():
            tokens[r] = t
        self.token_table = _table(tokens)
        self.digit_table = _table([b"%d," % i for i in range(top)])

    def piece_ids(self, piece: bytes) -> list[int]:
        """The ids of one pre-token: the perfect hash first, else merges."""
        whole = self.perfect.get(piece)
        return [whole] if whole >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties: a heap of pairs over linked parts."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # of the part that starts here; 0 once merged away
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = ranks.get(piece[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= n or end[mid] != stop:
                continue  # a part of this pair has changed since
            end[i], end[mid] = stop, 0
            if stop < n:
                before[stop] = i
                r = ranks.get(piece[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0:
                r = ranks.get(piece[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode_all(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if self.pattern != pretokens.PATTERN:
            return [np.array([x for p in self.find(t or "") for x in self.piece_ids(p.encode())], np.int32) for t in texts]
        ids, at = self.memo.encode(texts)
        return [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text."""
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        return _gather(ids, *self.token_table).tobytes()

    def joined(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return _gather(ids, *self.digit_table).tobytes()[:-1]


def _table(items: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in items], np.int32)
    return np.frombuffer(b"".join(items), np.uint8), np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int32) if items else size, size


def _gather(ids: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    if not len(ids):
        return np.zeros(0, np.uint8)
    n = size[ids]
    stop = np.cumsum(n)
    shift = at[ids] - (stop - n).astype(np.int32)
    return data[np.repeat(shift, n) + np.arange(stop[-1], dtype=np.int32)]


def bpe_tokenize(docs: DataFrame, codec: BpeCodec, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digests: bool = True, raw: bool = False) -> DataFrame:
    """One row per document: its id, n_tokens and, as asked, token_ids, the digests, and the decoded bytes.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the bytes that the ids
    decode to. A narrow transformation: nothing is shuffled.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    shared = spark.sparkContext.broadcast(codec)  # the vocabulary: of fixed size, whatever the input
    kind = src.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint" + ", token_ids array<int>" * ids + ", ids_sha256 string, decoded_sha256 string" * digests + ", decoded binary" * raw

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for t in chunks(batches, "text", 1_500_000):
            counts, lists, a, d, out = [], [], [], [], []
            for x in c.encode_all(t.column("text").to_pylist()):
                counts.append(len(x))
                if ids:
                    lists.append(x)
                if digests or raw:
                    back = c.decode(x)
                if digests:
                    a.append(hashlib.sha256(c.joined(x)).hexdigest())
                    d.append(hashlib.sha256(back).hexdigest())
                if raw:
                    out.append(back)
            key = t.column("doc_id").combine_chunks()
            cols = [key.chunk(0) if isinstance(key, pa.ChunkedArray) else key, pa.array(counts, pa.int64())]
            if ids:
                cols.append(pa.array(lists, pa.list_(pa.int32())))
            if digests:
                cols += [pa.array(a, pa.string()), pa.array(d, pa.string())]
            if raw:
                cols.append(pa.array(out, pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", *["token_ids"] * ids, *["ids_sha256", "decoded_sha256"] * digests, *["decoded"] * raw])

    return src.mapInArrow(tidied(run), schema)
