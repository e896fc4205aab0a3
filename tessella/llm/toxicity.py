"""Toxicity scoring: gradient-boosted trees over dense features, with isotonic calibration.

A bounded sample of labelled training rows is split by a hash of the text into
three folds: the first gives a lexicon (words and word stems that toxic texts
prefer), the second the trees, the third the calibration. Features of a text are
lexicon densities, second-person words near lexicon words, capitals, punctuation
and obfuscation rates. Label, language, source and id are never features.

Null and empty texts have the features of no words and get the score that those
give. Without labelled rows of both kinds all texts score the toxic share (0 if no
rows). Repeated labels of one document count as toxic if one says so. Long texts are
read whole. Rows keep their order, repeats and extra columns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, arrow_rows, tidied, tidy

#: Second-person words of the languages at hand.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur thou thee thy du dich dir dein deine deiner deinem ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus vosotros usted ustedes vuestro".split()
)
#: Characters that stand for letters in obfuscated words.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "#": "", "+": "t", "|": "l"})

_WORD = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"(?<![\w@$*#.!\-])(?=[\w@$*#.!\-]*[^\W\d_])(?=[\w@$*#.!\-]*[@$*#0-9_.!\-][^\W\d_])[^\W_]?[\w@$*#.!\-]*[^\W_](?!\w)")
_CAPS = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_UPPER = bytes(i for i in range(256) if chr(i).isupper())
_PUNCT = b"\"#$%&'()*+,-./:;<=>@[\\]^_`{|}~"

FEATURES = (
    "log_words", "hits", "hit_density", "score_sum", "score_max", "score_top3", "window_hits", "distinct_hits", "second_density", "near_hits", "near_density",
    "upper_share", "caps_words", "bangs", "questions", "bang_runs", "punctuation", "digits", "repeats", "odd_words", "odd_hits",
)


def keys_of(word: str) -> tuple[str, ...]:
    """The lexicon keys of a word: itself and its stems of four and five letters."""
    n = len(word)
    return (word,) if n < 4 else (word, "4" + word[:4]) if n < 5 else (word, "4" + word[:4], "5" + word[:5])


class _Scores(dict):
    """Word -> lexicon score, plus 1000 for a second-person word; bounded."""

    def __init__(self, lexicon: dict[str, float], limit: int = 100_000):
        self.lexicon, self.limit = lexicon, limit

    def __missing__(self, word: str) -> float:
        out = max((self.lexicon.get(k, 0.0) for k in keys_of(word)), default=0.0) + 1000.0 * (word in SECOND_PERSON)
        if len(self) >= self.limit:
            self.clear()
        self[word] = out
        return out


def features(text: str | None, scores: _Scores) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    text = text or ""
    low = text.lower()
    words = _WORD.findall(low)
    n, chars = max(1, len(words)), max(1, len(text))
    raw = text.encode("latin-1", "replace")
    s = np.fromiter(map(scores.__getitem__, words), np.float64, len(words))
    you = s >= 500
    s = s - 1000.0 * you
    hit = s > 0
    hits = int(hit.sum())
    near = window = distinct = 0
    top3 = peak = 0.0
    if hits:
        at = np.flatnonzero(hit)
        c = np.concatenate([[0], np.cumsum(you)])
        near = int(((c[np.minimum(at + 6, len(words))] - c[np.maximum(at - 5, 0)]) > 0).sum())
        window = int((np.searchsorted(at, at + 50) - np.arange(hits)).max())
        v = np.sort(s[at])[::-1]
        peak, top3 = float(v[0]), float(v[:3].sum())
        distinct = len({words[i] for i in at.tolist()})
    odd = _ODD.findall(low) if any(c in low for c in "@$*#0123456789_.!-") else []
    odd_hits = sum(1 for w in odd if scores.lexicon and max((scores.lexicon.get(k, 0.0) for k in keys_of(w.translate(LEET))), default=0.0) > 0)
    a = np.frombuffer(raw, np.uint8)
    same = a[1:] == a[:-1]
    runs = int((same[2:] & same[1:-1] & same[:-2] & (a[3:] != 32)).sum()) if len(a) > 3 else 0
    count = lambda chars_: len(raw) - len(raw.translate(None, chars_))
    return [
        math.log1p(len(words)), hits, hits / n, float(s.sum()) / n, peak, top3, window, distinct, float(you.sum()) / n, near, near / n,
        count(_UPPER) / chars, len(_CAPS.findall(text)) / n, raw.count(b"!") / n, raw.count(b"?") / n, raw.count(b"!!") / n, count(_PUNCT) / chars, count(b"0123456789") / chars, runs / chars, len(odd) / n, odd_hits,
    ]


class BoostedTrees:
    """Gradient-boosted depth-limited trees on binned features, logistic loss."""

    def __init__(self, trees: int = 80, depth: int = 4, rate: float = 0.12, bins: int = 48, least: float = 2.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.cuts, self.nodes = 0.0, [], []

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)]) if len(self.cuts) else np.zeros((len(x), 0), int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        for j in range(x.shape[1]):  # rare non-zero values have a cut of their own
            v = x[:, j][x[:, j] > self.cuts[j][-1]] if len(self.cuts[j]) else x[:, j]
            if len(v):
                self.cuts[j] = np.unique(np.concatenate([self.cuts[j], np.quantile(v, [0, 0.25, 0.5, 0.75])]))
        b = self._bin(x)
        wide = max((len(c) for c in self.cuts), default=0) + 1
        f = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), int)
            feature, cut, value = np.full(2 ** self.depth - 1, -1), np.zeros(2 ** self.depth - 1, int), np.zeros(2 ** self.depth)
            for level in range(self.depth):
                first, k = 2**level - 1, 2**level
                best = np.full(k, 1e-6)
                total_g, total_h = (np.bincount(node - first, v, minlength=k) for v in (g, h))
                for j in range(b.shape[1]):
                    at = (node - first) * wide + b[:, j]
                    cg, ch = (np.bincount(at, v, minlength=k * wide).reshape(k, wide).cumsum(axis=1) for v in (g, h))
                    rg, rh = total_g[:, None] - cg, total_h[:, None] - ch
                    gain = cg**2 / (ch + self.ridge) + rg**2 / (rh + self.ridge) - (total_g**2 / (total_h + self.ridge))[:, None]
                    gain[(ch < self.least) | (rh < self.least)] = 0
                    at = gain.argmax(axis=1)
                    up = gain[np.arange(k), at] > best
                    best[up] = gain[np.arange(k), at][up]
                    feature[first : first + k][up], cut[first : first + k][up] = j, at[up]
                fj, fc = feature[node], cut[node]
                right = (fj >= 0) & (b[np.arange(len(y)), np.maximum(fj, 0)] > fc)
                node = 2 * node + 1 + right
            leaf = node - (2**self.depth - 1)
            lg, lh = (np.bincount(leaf, v, minlength=2**self.depth) for v in (g, h))
            value = self.rate * lg / (lh + self.ridge)
            f += value[leaf]
            self.nodes.append((feature, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._bin(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.nodes:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                fj = feature[node]
                node = 2 * node + 1 + ((fj >= 0) & (b[rows, np.maximum(fj, 0)] > cut[node]))
            f += value[node - (2**self.depth - 1)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (x, y) of the best rising fit, for linear interpolation."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    xs, inv = np.unique(x[order], return_inverse=True)
    for v, s, w in zip(xs, np.bincount(inv, y[order]), np.bincount(inv), strict=True):
        blocks.append([s, w, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, _, hi = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += w2
            blocks[-1][3] = hi
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] / b[1] for b in blocks for _ in (0, 1)])


class ToxicityModel:
    def __init__(self, lexicon: dict[str, float], trees: BoostedTrees | None, knots: tuple[np.ndarray, np.ndarray] | None, rate: float):
        self.lexicon, self.trees, self.knots, self.rate = lexicon, trees, knots, rate
        self.scores = None

    def __getstate__(self):
        return {**self.__dict__, "scores": None}

    def table(self, texts: list[str | None]) -> np.ndarray:
        if self.scores is None:
            self.scores = _Scores(self.lexicon)
        return np.array([features(t, self.scores) for t in texts], np.float64).reshape(-1, len(FEATURES))

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.rate)
        m = self.trees.margin(self.table(texts))
        p = 1 / (1 + np.exp(-m))
        if self.knots is None:
            return p
        # a touch of the raw score keeps order within the calibration's steps
        return np.clip(0.98 * np.interp(m, *self.knots) + 0.02 * p, 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = 24_000, lexicon_size: int = 4_000, least_docs: int = 4,
          id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Learns from the documents that ``labels`` covers, both already cut to training rows.

    The classifier is fitted on a bounded sample: about ``sample`` labelled rows, chosen by a
    hash of the id. Exact copies count once.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).filter("y is not null").groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    share = min(1.0, sample / n) if n else 1.0
    picked = F.broadcast(known.filter(F.pmod(F.xxhash64(F.col("id"), F.lit(11)), F.lit(1_000_003)) < share * 1_000_003))  # bounded by ``sample``
    scratch = Scratch(spark, "toxicity")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(picked, "id")
    # all copies of a text are in one fold, and count once
    rows = rows.select("text", "y", F.pmod(F.xxhash64("text", F.lit(3)), F.lit(20)).alias("part"))
    rows = scratch.save(rows.groupBy("text", "part").agg(F.max("y").alias("y")), "sample")
    sizes = {(r["a"], r["y"]): r["count"] for r in rows.groupBy((F.col("part") < 9).alias("a"), "y").count().collect()}
    n_toxic, n_clean = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    total = sum(sizes.values())
    rate = sum(v for (_, y), v in sizes.items() if y == 1) / total if total else 0.0
    if not (n_toxic and n_clean and sizes.get((False, 1), 0) and sizes.get((False, 0), 0)):
        return ToxicityModel({}, None, None, rate)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            keys = list(held[0] | held[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([held[i][k] for k in keys], pa.int64()) for i in (1, 0))], ["key", "toxic", "clean"])
            held[0].clear()
            held[1].clear()

        for b in batches:
            for text_, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[1 if y else 0].update({k for w in set(_WORD.findall(text_.lower())) for k in keys_of(w)})
            if len(held[0]) + len(held[1]) > 200_000:
                yield from out()
        yield from out()

    counted = rows.filter("part < 9").select("text", "y").mapInArrow(tidied(count), "key string, toxic bigint, clean bigint").groupBy("key").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    weight = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    best = counted.filter(F.col("t") >= least_docs).withColumn("w", weight).filter("w > 1.0").orderBy(F.desc(F.col("w") * F.sqrt("t")), "key").limit(lexicon_size)
    lexicon = {r["key"]: float(r["w"]) for r in best.select("key", "w").collect()}
    model = ToxicityModel(lexicon, None, None, rate)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(model.table(b.column(0).to_pylist()))), b.column(1), b.column(2)], ["x", "y", "part"])

    got = rows.filter("part >= 9").select("text", "y", "part").mapInArrow(tidied(vectors), "x array<double>, y int, part bigint").toArrow()
    x, y, part = np.array(got["x"].to_pylist()), got["y"].to_numpy().astype(float), got["part"].to_numpy()
    order = np.lexsort((*x.T, y, part))  # the same fit however rows were dealt
    x, y, part = x[order], y[order], part[order]
    fit, held = part < 16, part >= 16
    if len(set(y[fit])) < 2:
        return model
    model.trees = BoostedTrees().fit(x[fit], y[fit])
    if len(set(y[held])) == 2:
        model.knots = isotonic(model.trees.margin(x[held]), y[held])
    return model


def toxicity(df: DataFrame, model: ToxicityModel, text: Column) -> Column:
    """The score column, 0 to 1."""
    arrow_rows(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the lexicon's and the trees' size

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for b in batches:
            yield pa.array(m.score(b.to_pylist()), pa.float64())
        tidy()

    return score(text.cast("string"))
