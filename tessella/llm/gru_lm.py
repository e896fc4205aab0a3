"""LM scoring: a gated recurrent language model over a whole corpus.

Counts of all training tokens, by 64-bit hash, give the unigram base and the word
probabilities below the network. The network is a gated recurrent unit with
truncated backpropagation, written in numpy, and a class-factored softmax. Its
symbols are the most frequent words and, for all others, buckets by a word's ends;
within a bucket a word has its smoothed unigram share, so every text has a proper
probability. The state is carried across windows over the whole document.

Training is one pass over all training documents, so it grows with the corpus. They are dealt
into a few rounds; in each, replicas train on parts of the round's documents from common weights, which
are then averaged.

Null and empty texts are one end token. Words unseen in training have the base's
smoothed share. Without training documents the base is uniform, and the network is
its initial self. Repeated rows are scored each. Long texts are scored whole. An empty table gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, binary_values, chunks, mix64, tidied, word_hashes

_U = np.uint64
#: The end token's hash.
END = int(mix64(np.array([0x9E3779B97F4A7C15], np.uint64))[0])
WORDS, BUCKETS, CLASS_SIZE = 2047, 128, 48
SYMBOLS = WORDS + 1 + BUCKETS
#: Words whose counts every task knows.
TOP = 131_072
TEXT_BYTES = 1_500_000


def buckets_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word's bucket, from its last two bytes and whether it is short."""
    low = np.arange(256, dtype=np.uint32)
    low[65:91] += 32
    last, before = low[raw[end - 1]], low[raw[np.maximum(end - 2, start)]]
    return ((last * np.uint32(31) + before * np.uint32(7) + (end - start < 5)) % BUCKETS).astype(np.uint8)


class Vocabulary:
    """What every task knows of the training counts: the most frequent words, and sums."""

    def __init__(self, h: np.ndarray, c: np.ndarray, u: np.ndarray, n: int, v: int, ends: int, by_bucket: np.ndarray):
        """by_bucket: (BUCKETS, 2) tokens and words of all words, by bucket."""
        order = np.lexsort((h, -c))
        short = order[:WORDS]
        self.n, self.v, self.ends = n, v, ends
        rest = by_bucket.astype(np.float64).copy()
        np.subtract.at(rest[:, 0], u[short], c[short])
        np.subtract.at(rest[:, 1], u[short], 1)
        self.log_z = np.log10(np.maximum(rest[:, 0], 0) + 0.1 * (np.maximum(rest[:, 1], 0) + 1))
        by_hash = np.argsort(h)
        self.h, self.c = h[by_hash], c[by_hash]
        symbol = np.full(len(h), -1, np.int16)
        symbol[short] = np.arange(len(short)) + 1
        self.symbol = symbol[by_hash]
        self.lead = _U(64 - max(1, len(h).bit_length()))
        self.start = np.searchsorted(self.h, np.arange(1 << (64 - int(self.lead)), dtype=np.uint64) << self.lead).astype(np.int32)  # where each leading bits' words begin
        self.counts = np.full(SYMBOLS, 0.5)
        self.counts[0] += ends
        self.counts[1 : 1 + len(short)] += c[short]
        self.counts[WORDS + 1 :] += np.maximum(rest[:, 0], 0)
        self.log_total = np.log10(n + 0.1 * (v + 1))

    def find(self, h: np.ndarray) -> np.ndarray:
        """``searchsorted`` of hashes: hashes are even, so few words share their leading bits."""
        words = np.append(self.h, _U(2**64 - 1))
        at = self.start.take((h >> self.lead).view(np.int64)).astype(np.int64)
        left = np.flatnonzero(words.take(at) < h)
        while len(left):
            at[left] += 1
            left = left[words.take(at[left]) < h[left]]
        return at

    def symbols(self, raw, offs) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, count or -1 if not among the frequent words, hash, bucket, row) of each word."""
        h, start, end, row = word_hashes(raw, offs)
        u = buckets_of(raw, start, end) if len(h) else np.zeros(0, np.uint8)
        if not len(self.h):
            return WORDS + 1 + u.astype(np.int16), np.full(len(h), -1, np.int64), h, u, row
        at = self.find(h)
        at[at == len(self.h)] = 0
        new = self.h.take(at) != h
        c, s = self.c.take(at), self.symbol.take(at)
        c[new] = s[new] = -1
        return np.where(s >= 0, s, WORDS + 1 + u.astype(np.int16)), c, h, u, row


#: Logits of class and symbol that together stay within this need no shift before ``exp``: the product of their sums is a float32.
SAFE_LOGIT = 80.0


class GatedUnit:
    """A GRU over symbols with a class-factored softmax, in float32."""

    def __init__(self, counts: np.ndarray, hidden: int = 24, embed: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.hidden, self.embed = hidden, embed
        order = np.argsort(-counts, kind="stable")
        self.place = np.empty(SYMBOLS, np.int32)  # symbols by falling count: classes are runs of places
        self.place[order] = np.arange(SYMBOLS)
        self.classes = -(-SYMBOLS // CLASS_SIZE)
        mass = np.full(self.classes * CLASS_SIZE, 1e-6)
        mass[: SYMBOLS] = counts[order]
        mass = mass.reshape(self.classes, CLASS_SIZE)
        self.p = {
            "e": f(SYMBOLS, embed) * np.float32(np.sqrt(SYMBOLS) * 0.3), "wx": f(embed, 3 * hidden), "wh": f(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32),
            "wc": f(hidden, self.classes) * np.float32(0.1), "bc": np.log(mass.sum(axis=1) / mass.sum()).astype(np.float32),
            "wo": np.zeros((self.classes, hidden, CLASS_SIZE), np.float32), "bo": np.log(mass / mass.sum(axis=1, keepdims=True)).astype(np.float32),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.p):
            n = self.p[k].size
            self.p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n

    def states(self, x: np.ndarray, h: np.ndarray, table: list[np.ndarray], keep: list | None = None) -> np.ndarray:
        """The state after each step's rows x of ``table``: (steps, rows); h: (rows, hidden) before them. ``keep`` gets (z and r, c, c's part from the state) of all steps."""
        n, rows, steps = self.hidden, len(h), len(x)
        x = x.astype(np.intp)
        wh = np.ascontiguousarray(self.p["wh"].reshape(n, 3, n).transpose(1, 0, 2))
        np.negative(wh[:2], out=wh[:2])  # as in ``table``: 1 / (1 + exp(-a))
        out = np.empty((steps, rows, n), np.float32)
        held = steps if keep is not None else 1
        zr, cs, acs = np.empty((held, 2, rows, n), np.float32), np.empty((held, rows, n), np.float32), np.empty((held, rows, n), np.float32)
        az = np.empty((2, rows, n), np.float32)
        for t in range(steps):
            i = t if keep is not None else 0
            both, c, ac = zr[i], cs[i], acs[i]
            z, r = both
            for own, into in zip(table, (z, r, c), strict=True):
                np.take(own, x[t], axis=0, out=into, mode="clip")  # the default mode copies ``out``
            np.matmul(h, wh[:2], out=az)
            np.matmul(h, wh[2], out=ac)
            both += az
            np.exp(both, out=both)
            both += 1
            np.reciprocal(both, out=both)
            c += np.multiply(r, ac, out=az[0])
            np.tanh(c, out=c)
            now = np.subtract(h, c, out=out[t])
            now *= z
            now += c
            h = now
        if keep is not None:
            keep.extend((zr, cs, acs))
        return out

    def log_probs(self, h: np.ndarray, y: np.ndarray, grad: dict | None = None) -> np.ndarray:
        """Natural log probability of symbol y after state h; with ``grad``, its sum's gradient too.

        Rows are put in order of their classes once, so a class is a slice; logits stand with rows last, where sums over a class's symbols are fast.
        """
        p, at, n = self.p, self.place[y], len(y)
        cls, at = at // CLASS_SIZE, at % CLASS_SIZE
        order = np.argsort(cls.astype(np.uint8), kind="stable")
        h, cls, at = h.take(order, axis=0), cls[order], at[order]
        cut = np.searchsorted(cls, np.arange(self.classes + 1))
        full = [(k, a, b) for k, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if a < b]
        at = at * np.diff(cut)[cls] + np.arange(n) - cut[cls]  # in the class's logits
        most = max(float(h.max()), -float(h.min())) if n else 0.0
        lc = p["wc"].T @ h.T
        lc += p["bc"][:, None]
        reach = (most * np.abs(p["wc"]).sum(axis=0) + np.abs(p["bc"])).max()
        if reach > SAFE_LOGIT / 2:
            lc -= lc.max(axis=0)
            reach = 0.0
        shift = (most * np.abs(p["wo"]).sum(axis=1) + np.abs(p["bo"])).max(axis=1) > SAFE_LOGIT - reach
        out = np.empty(n, np.float32)
        for k, a, b in full:
            out[a:b] = lc[k, a:b]
        np.exp(lc, out=lc)
        total = lc.sum(axis=0)
        if grad is not None:
            lc *= np.divide(-1, total)
            for k, a, b in full:
                lc[k, a:b] += 1
            grad["wc"], grad["bc"] = h.T @ lc.T, lc.sum(axis=1)
            gh = lc.T @ p["wc"].T
            grad["wo"], grad["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
        for k, a, b in full:
            hk, w, j = h[a:b], p["wo"][k], at[a:b]
            lo = w.T @ hk.T
            lo += p["bo"][k][:, None]
            if shift[k]:
                lo -= lo.max(axis=0)
            every = lo.reshape(-1)
            out[a:b] += every.take(j)
            np.exp(lo, out=lo)
            own = lo.sum(axis=0)
            total[a:b] *= own
            if grad is not None:
                lo *= np.divide(-1, own, out=own)
                every[j] += 1
                np.matmul(hk.T, lo.T, out=grad["wo"][k])
                lo.sum(axis=1, out=grad["bo"][k])
                gh[a:b] += lo.T @ w.T
        out -= np.log(total)
        back = np.empty(n, np.float32)
        back[order] = out
        if grad is not None:
            grad["h"] = np.empty_like(gh)
            grad["h"][order] = gh
        return back

    def table(self, symbols: np.ndarray | slice = slice(None)) -> list[np.ndarray]:
        """What symbols give to -z, -r and c, as ``states`` takes it."""
        e, n, p = self.p["e"][symbols], self.hidden, self.p
        return [sign * (e @ p["wx"][:, k : k + n] + p["b"][k : k + n]) for k, sign in ((0, np.float32(-1)), (n, np.float32(-1)), (2 * n, np.float32(1)))]

    def score(self, ids: np.ndarray, offs: np.ndarray, window: int = 32, rows: int = 512) -> np.ndarray:
        """Natural log probability of each sequence; the state goes on from window to window. Sequences of like length are taken ``rows`` at a time."""
        size = np.diff(offs)
        out = np.zeros(len(size))
        order = np.argsort(-size, kind="stable")
        table = self.table()
        for i in range(0, len(order), rows):
            block = order[i : i + rows]
            out[block] = self._score(ids, offs[:-1][block], size[block], window, table)
        return out

    def _score(self, ids: np.ndarray, first: np.ndarray, size: np.ndarray, window: int, table: list[np.ndarray]) -> np.ndarray:
        """``score`` of the sequences that begin at ``first``, by falling size."""
        out, h = np.zeros(len(size)), np.zeros((len(size), self.hidden), np.float32)
        longest, at = int(size[0]), 0
        while at < longest:
            live = int(np.searchsorted(-size, -at, side="left"))  # sequences longer than ``at``
            steps = min(window, longest - at)
            if live < 64:
                steps = min(longest - at, 2048)
            pos = at + np.arange(steps)[:, None]
            src = first[None, :live] + pos
            whole = size[live - 1] >= at + steps
            if not whole:
                inside = pos < size[None, :live]
                src[~inside] = 0
            y = ids[src]
            x = np.zeros_like(y)
            x[1:] = y[:-1]
            if at:
                x[0] = ids[first[:live] + at - 1]
            # the symbol before the first is the end of a text: 0
            states = self.states(x, h[:live], table)
            h[:live] = states[-1]
            if whole:
                out[:live] += self.log_probs(states.reshape(-1, self.hidden), y.ravel()).reshape(steps, live).sum(axis=0, dtype=np.float64)
            else:
                out_w = np.zeros(inside.shape)
                out_w[inside] = self.log_probs(states[inside], y[inside])
                out[:live] += out_w.sum(axis=0)
            at += steps
        return out

    def train(self, ids: np.ndarray, rows: int = 256, window: int = 32, rate: float = 0.02, clip: float = 5.0) -> int:
        """One pass of truncated backpropagation over a stream of texts cut into ``rows`` parallel parts, fewer for a short stream."""
        most, rows = rows, max(1, min(rows, max(8, len(ids) // (64 * window)), len(ids) // window))
        rate *= np.sqrt(rows / most)
        steps = -(-len(ids) // rows)
        if steps < 2:
            return 0
        y = np.append(ids, np.zeros(steps * rows - len(ids), ids.dtype)).reshape(rows, steps).T  # the last part ends in end tokens
        n, h = self.hidden, np.zeros((rows, self.hidden), np.float32)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        row = np.zeros(SYMBOLS, np.intp)
        done, updates = 0, 0
        for at in range(0, steps, window):
            yt = y[at : at + window]
            xt = np.concatenate([y[at - 1][None] if at else np.zeros((1, rows), y.dtype), yt[:-1]])
            sort = np.argsort(xt, axis=None, kind="stable")
            used = xt.ravel()[sort]
            start = np.flatnonzero(np.append(True, used[1:] != used[:-1]))
            used = used[start]
            row[used] = np.arange(len(used))
            xt = row[xt]  # among the window's symbols
            keep: list = []
            states = self.states(xt, h, self.table(used), keep)
            g: dict = {}
            self.log_probs(states.reshape(-1, n), yt.ravel(), g)
            gh, dh = g.pop("h").reshape(states.shape), np.zeros_like(h)
            back, d = np.ascontiguousarray(self.p["wh"].reshape(n, 3, n).transpose(1, 2, 0)), np.empty((4, len(xt), rows, n), np.float32)
            u, v = np.empty_like(h), np.empty_like(h)
            for t in range(len(xt) - 1, -1, -1):  # back through the window only; a step's arrays stay in the cache
                (z, r), c, ac = (x[t] for x in keep)
                dz, dr, dcr, dc = d[:, t]
                dh += gh[t]
                np.multiply(np.subtract(1, z, out=u), dh, out=u)
                np.multiply(np.subtract(1, np.multiply(c, c, out=v), out=v), u, out=dc)
                np.multiply(np.subtract(states[t - 1] if t else h, c, out=dz), z, out=dz)
                dz *= u
                np.multiply(dc, r, out=dcr)
                np.multiply(np.multiply(np.subtract(1, r, out=v), ac, out=v), dcr, out=dr)
                dh *= z
                for k in range(3):
                    dh += np.matmul(d[k, t], back[k], out=v)
            d = d.reshape(4, -1, n)
            before = np.concatenate([h[None], states[:-1]]).reshape(-1, n)
            g["wh"] = np.concatenate([before.T @ x for x in d[:3]], axis=1)
            flat = d[0], d[1], d[3]
            ones = np.ones(yt.size, np.float32)
            g["b"] = np.concatenate([ones @ x for x in flat])
            wx, given = self.p["wx"], self.p["e"][used].take(xt.ravel(), axis=0).T
            dx = sum(x @ wx[:, k * n : (k + 1) * n].T for k, x in enumerate(flat))
            g["wx"] = np.concatenate([given @ x for x in flat], axis=1)
            g["e"] = np.zeros_like(self.p["e"])
            g["e"][used] = np.add.reduceat(dx.take(sort, axis=0), start, axis=0)
            h = states[-1]
            updates += 1
            scale = 1.0 / yt.size
            norm = np.sqrt(sum(float(v.ravel() @ v.ravel()) for v in g.values())) * scale
            scale *= min(1.0, clip / (norm + 1e-9))
            step = rate * np.sqrt(1 - 0.999**updates) / (1 - 0.9**updates) * min(1.0, updates / 10)
            for k, v in g.items():
                v *= np.float32(scale)
                u = v - first[k]
                u *= np.float32(0.1)
                first[k] += u
                np.multiply(v, v, out=v)
                v -= second[k]
                v *= np.float32(0.001)
                second[k] += v
                np.sqrt(second[k], out=v)
                v += np.float32(1e-8)
                np.divide(first[k], v, out=v)
                v *= np.float32(step)
                self.p[k] += v
            done += yt.size
        return done


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(x for a in arrays for x in (len(a).to_bytes(8, "little"), a.tobytes()))


def _unpack(blob: bytes, kinds: str) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds.split():
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(np.frombuffer(blob, kind, n, at + 8))
        at += 8 + out[-1].nbytes
    return out


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _blobs(values: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary for each row: its ``size`` next values."""
    offs = np.concatenate([[0], np.cumsum(size)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _shard_rows(shards: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by shard, cuts): shards are ranges of the hash."""
    s = (h >> _U(64 - (shards - 1).bit_length())).astype(np.uint16)
    order = np.argsort(s, kind="stable")
    return order, np.searchsorted(s[order], np.arange(shards + 1))


def _level(c: np.ndarray) -> np.ndarray:
    """Counts in steps: each its own up to 4095, then of about a hundredth. So levels are few, and no step holds many frequent words."""
    high = 4096 + np.floor(64 * np.log2(np.maximum(c, 4096) / 4096.0)).astype(np.int64)
    return np.where(c < 4096, c, high)


LEVELS = 4096 + 64 * 52


def count_tokens(docs: DataFrame, scratch: Scratch, shards: int, held_tokens: int = 3_000_000) -> DataFrame:
    """(shard, blob, hist, tokens, words): the counts of all words of column ``text``, in shards by hash.

    Each task counts its words before it sends them; blob: hashes, counts, buckets, sorted by hash.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, us, held, texts = [], [], 0, 0

        def out():
            h, u = np.concatenate(hs), np.concatenate(us)
            hs.clear()
            us.clear()
            at = np.argsort(h)  # faster than a stable sort; any of a word's places tells its bucket
            h = h[at]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            key, u, n = h[first], u[at[first]], np.diff(np.append(first, len(h)))
            order, cut = _shard_rows(shards, key)
            rows = [(s, _pack(key[i], n[i].astype(np.int64), u[i])) for s in range(shards) if len(i := order[cut[s] : cut[s + 1]])]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "blob"])

        for t in chunks(batches, "text", TEXT_BYTES):
            raw, offs = binary_values(t.column("text"))
            h, a, b, _ = word_hashes(raw, offs)
            texts += t.num_rows
            if len(h):
                hs.append(h)
                us.append(buckets_of(raw, a, b))
                held += len(h)
            if held >= held_tokens:
                yield out()
                held = 0
        if held:
            yield out()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(shard, parts):
            h, n, u = (np.concatenate(x) for x in zip(*(_unpack(b, "u8 i8 u1") for b in parts), strict=True))
            key, at, inv = np.unique(h, return_index=True, return_inverse=True)
            c = np.zeros(len(key), np.int64)
            np.add.at(c, inv, n)
            return _pack(key, c, u[at]), c, u[at]

        key, held = None, []

        def row(shard, parts):
            blob, c, u = out(shard, parts)
            few = np.bincount(_level(c), minlength=LEVELS)  # how many words have each count
            at = np.flatnonzero(few)
            by = np.column_stack([np.bincount(u, c, BUCKETS), np.bincount(u, minlength=BUCKETS)]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary()), pa.array([_pack(at.astype(np.int64), few[at].astype(np.int64))], pa.binary()), pa.array([by.tobytes()], pa.binary()), pa.array([int(c.sum())], pa.int64()), pa.array([len(c)], pa.int64())], ["shard", "blob", "hist", "buckets", "tokens", "words"])

        for b in batches:
            for shard, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if shard != key and held:
                    yield row(key, held)
                    held = []
                key = shard
                held.append(blob)
        if held:
            yield row(key, held)

    sent = docs.select("text").mapInArrow(tidied(send), "shard int, blob binary")
    return scratch.save(sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidied(add), "shard int, blob binary, hist binary, buckets binary, tokens bigint, words bigint"), "counts")


def learn_vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """The most frequent words, all of those with the least count that keeps them under TOP, and sums over all words."""
    few, by, n, v = np.zeros(LEVELS, np.int64), np.zeros((BUCKETS, 2), np.int64), 0, 0
    for r in counts.select("hist", "buckets", "tokens", "words").toLocalIterator():  # a row a shard, of bounded size
        at, k = _unpack(r["hist"], "i8 i8")
        few[at] += k
        by += np.frombuffer(r["buckets"], np.int64).reshape(BUCKETS, 2)
        n, v = n + r["tokens"], v + r["words"]
    above = np.cumsum(few[::-1])[::-1]
    least = int(np.flatnonzero(np.append(above, 0) <= TOP)[0])  # words with a TOP-th of all tokens each are TOP at most

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                h, c, u = _unpack(blob, "u8 i8 u1")
                k = _level(c) >= least
                yield pa.RecordBatch.from_arrays([pa.array([_pack(h[k], c[k], u[k])], pa.binary())], ["blob"])

    parts = [_unpack(r["blob"], "u8 i8 u1") for r in counts.select("blob").mapInArrow(tidied(frequent), "blob binary").toLocalIterator()]
    h, c, u = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8))
    return Vocabulary(h, c, u, n + ends, v + (ends > 0), ends, by)


#: Tasks of a round; more replicas than that are several a task, one after another.
MOST_TASKS = 4096


def encode(docs: DataFrame, vocab: Broadcast, seed: int, first: int = 0) -> DataFrame:
    """(row, id, part, n, known, base, below, seq, far) of each document: its number from ``first`` on, its part's hash, tokens, frequent tokens, their base, the symbols' share below buckets, the symbols, and the hashes of its rare words.

    What later steps need of a text, which is split here and nowhere else after counting.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.value
        row0 = first + ((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        for t in chunks(batches, "text", TEXT_BYTES):
            raw, offs = binary_values(t.column("text"))
            s, c, h, u, row = v.symbols(raw, offs)
            n = t.num_rows
            words = np.bincount(row, minlength=n)
            seq = np.zeros(len(s) + n, np.int16)
            seq[np.arange(len(s)) + row] = s
            # below a bucket: the word's smoothed share of it; a rare word's count comes from its shard
            far = c < 0
            log_c = np.where(far, 0.0, np.log10(np.maximum(c, 0) + 0.1))
            below = np.bincount(row, np.where(s > WORDS, log_c - v.log_z[u], 0.0), minlength=n)
            known = np.bincount(row, ~far, minlength=n) + (v.ends > 0)
            base = np.bincount(row, log_c, minlength=n) + np.log10(v.ends + 0.1) - (words + 1) * v.log_total
            yield pa.RecordBatch.from_arrays(
                [pa.array(row0 + np.arange(n)), _whole(t.column("id")), _whole(t.column("part")), pa.array(words + 1), pa.array(known.astype(np.int64)), pa.array(base), pa.array(below), _blobs(seq, words + 1), _blobs(h[far], np.bincount(row[far], minlength=n))],
                ["row", "id", "part", "n", "known", "base", "below", "seq", "far"],
            )
            row0 += n

    dealt = docs.select("id", F.xxhash64("id", F.length("text"), F.lit(seed)).alias("part"), "text")
    return dealt.mapInArrow(tidied(run), f"row bigint, id {docs.schema['id'].dataType.simpleString()}, part bigint, n bigint, known bigint, base double, below double, seq binary, far binary")


def train_network(seqs: DataFrame, vocab: Vocabulary, shared: Broadcast, rounds: int | None, replica_tokens: int) -> GatedUnit:
    """One pass over all documents, as ``encode`` gives them, in ``rounds`` parts: weights averaged over replicas, each trained on some of the round's documents.

    Without ``rounds`` there are four, and one more whenever the corpus doubles beyond 256 replicas' tokens.
    """
    spark = seqs.sparkSession
    total = seqs.agg(F.sum("n").alias("n")).first()["n"] or 0
    model = GatedUnit(vocab.counts)
    if not total:
        return model
    rounds = rounds or max(4, int(np.ceil(np.log2(max(1.0, total / replica_tokens)))) - 4)
    replicas = max(1, round(total / rounds / replica_tokens))
    tasks = min(replicas, MOST_TASKS)
    for k in range(rounds):
        weights = spark.sparkContext.broadcast(model.flat())
        rate = 0.02 / (1 + k) ** 0.5

        def fit(batches: Iterator[pa.RecordBatch], weights=weights, rate=rate) -> Iterator[pa.RecordBatch]:
            m, held, size, sums, done = GatedUnit(shared.value.counts), [], 0, None, 0

            def step():
                nonlocal sums, done
                m.load(weights.value)
                n = m.train(np.concatenate(held), rate=rate)
                if n:
                    sums = n * m.flat().astype(np.float64) if sums is None else sums + n * m.flat()
                    done += n

            for b in batches:
                for blob in b.column(0).to_pylist():
                    held.append(np.frombuffer(blob, np.int16))
                    size += len(held[-1])
                    if size >= 2 * replica_tokens:  # a replica of bounded size, whatever the partition
                        step()
                        held, size = [], 0
            if held:
                step()
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["n", "w"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, w = 0, 0.0
            for b in batches:
                for k_, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    n, w = n + k_, w + np.frombuffer(blob)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["n", "w"])

        mine = seqs.filter(F.pmod("part", F.lit(rounds)) == k).select("seq")
        got = (mine.repartition(tasks) if tasks > 1 else mine.coalesce(1)).mapInArrow(tidied(fit), "n bigint, w binary")
        if tasks > 16:  # sums meet in a few tasks first
            got = got.repartition(max(1, int(tasks**0.5))).mapInArrow(tidied(average), "n bigint, w binary")
        n, w = 0, 0.0
        for r in got.toLocalIterator():
            n, w = n + r["n"], w + np.frombuffer(r["w"])
        if n:
            model.load((w / n).astype(np.float32))
    return model


def score(docs: DataFrame, trains: Column, id_col: str = "doc_id", text: str = "text", shards: int | None = None, rounds: int | None = None, replica_tokens: int = 600_000, seed: int = 3) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of each document; ``trains`` marks what to learn from."""
    spark = docs.sparkSession
    arrow_rows(spark)
    scratch = Scratch(spark, "lm")
    src = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    learn = src.filter("trains")
    ends = learn.count()
    shards = shards or 1 << max(4, min(16, (ends >> 14).bit_length()))  # a shard's words stay as many as the corpus grows
    counts = count_tokens(learn, scratch, shards)
    vocab = learn_vocabulary(counts, ends)
    words = spark.sparkContext.broadcast(vocab)  # at most TOP words
    seqs, others = scratch.save(encode(learn, words, seed), "sequences"), scratch.save(encode(src.filter("not trains"), words, seed, 1 << 62), "others")
    model = train_network(seqs, vocab, words, rounds, replica_tokens)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value

        def docs_out():
            t = pa.concat_tables(held)
            n, base, below = (t.column(k).to_numpy() for k in ("n", "base", "below"))
            lp = m.score(np.concatenate(symbols), np.concatenate([[0], np.cumsum(n)])) / np.log(10.0)
            return pa.RecordBatch.from_arrays([*(_whole(t.column(k)) for k in ("row", "id", "n", "known", "base")), pa.array(lp + below)], ["row", "id", "n", "known", "base", "score"])

        held, symbols, size = [], [], 0
        for t in chunks(batches, "seq", TEXT_BYTES):
            symbols.append(binary_values(t.column("seq"))[0].view(np.int16))
            held.append(t.drop_columns(["seq"]))
            size += len(symbols[-1])
            if size > 6_000_000:
                yield docs_out()
                held, symbols, size = [], [], 0
        if held:
            yield docs_out()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rare words of many rows by shard; rows as a common part and the rest."""
        for t in chunks(batches, "far", TEXT_BYTES):
            h, offs = binary_values(t.column("far"))
            h, row = h.view(np.uint64), np.repeat(t.column("row").to_numpy(), np.diff(offs) // 8)
            for part in np.unique(row >> 32):
                mine = row >> 32 == part
                hf, rf = h[mine], (row[mine] & 0xFFFFFFFF).astype(np.uint32)
                order, cut = _shard_rows(shards, hf)
                rows = [(k, _pack(hf[i], rf[i])) for k in range(shards) if len(i := order[cut[k] : cut[k + 1]])]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([int(part) << 32] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["shard", "part", "blob"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, c = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for b in batches:
            for shard, kind_, part, blob in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if shard != key:
                    key, h, c = shard, np.zeros(0, np.uint64), np.zeros(0, np.int64)
                if kind_ == 0:
                    h, c, _ = _unpack(blob, "u8 i8 u1")
                    continue
                hf, rf = _unpack(blob, "u8 u4")
                at = np.searchsorted(h, hf)
                at[at == len(h)] = 0
                ok = h[at] == hf if len(h) else np.zeros(len(hf), bool)
                n = np.zeros(len(hf))
                n[ok] = c[at[ok]]
                first = int(rf.min())
                of = (rf - first).astype(np.int64)
                seen = np.bincount(of)
                rows = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array(part + first + rows), pa.array(np.bincount(of, np.log10(n + 0.1))[rows]), pa.array(np.bincount(of, ok)[rows].astype(np.int64))], ["row", "far", "far_known"])

    every = seqs.unionByName(others)
    out = scratch.save(every.select("row", "id", "n", "known", "base", "below", "seq").mapInArrow(tidied(run), f"row bigint, id {src.schema['id'].dataType.simpleString()}, n bigint, known bigint, base double, score double"), "scored")
    asked = every.select("row", "far").mapInArrow(tidied(ask), "shard int, part bigint, blob binary").select("shard", F.lit(1).alias("kind"), "part", "blob")
    told = counts.select("shard", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("part"), "blob")
    far = told.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInArrow(tidied(look_up), "row bigint, far double, far_known bigint")
    far = far.groupBy("row").agg(F.sum("far").alias("far"), F.sum("far_known").alias("far_known"))
    zero = F.coalesce(F.col("far"), F.lit(0.0))
    return (
        out.join(far, "row", "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("far_known", F.lit(0))).alias("n_known"), F.lit(vocab.n).cast("bigint").alias("train_tokens"), (F.col("base") + zero).alias("base_score"), (F.col("score") + zero).alias("score"))
    )
