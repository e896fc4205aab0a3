"""Language identification by interpolated Kneser-Ney character models.

One model of character n-grams per language, each in sorted arrays of its own of n-gram
hashes, with interpolated log probabilities and back-off weights, looked up by
binary search: the distinct n-grams of a batch of texts once a language, so memory and time grow with the
languages' n-grams, never with languages times n-grams. A text gets the language of lowest cross-entropy per character, a
score calibrated on held-back training texts, and a rejection flag where even the
best model finds it more surprising than calibration texts allow.

A null text, or one without a letter, is ``und`` with score 0 and rejected. Case,
digits, punctuation and white space don't matter beyond separating words. Equal
cross-entropies go to the alphabetically first language. Without training rows
every text is ``und``. Repeated rows and extra columns are carried as they are. Texts are read whole: a very
long one takes about 60 bytes of memory for each character, however many languages there are.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import Scratch, arrow_rows, tidied, tidy

ORDER = 4
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """1 for letters, 2 for combining marks, by code point."""
    if not _LETTER:
        t = np.zeros(0x110000, np.uint8)
        for cp in range(0x30000):
            c = unicodedata.category(chr(cp))
            t[cp] = 1 if c[0] == "L" else 2 if c[0] == "M" else 0
        t[0x30000:0x323B0] = 1
        _LETTER.append(t)
    return _LETTER[0]


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, start of each text, letters in each text).

    Lower-cased; each run of other characters becomes one space; ORDER - 1 spaces stand before each text.
    """
    low = [(t or "").lower() for t in texts]
    size = np.array([len(t) for t in low], np.int64)
    raw = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low)), size)
    kind = _letters()[raw]
    inside = kind > 0
    first = np.ones(len(raw), bool)
    if len(raw):
        first[1:] = inside[:-1] | (row[1:] != row[:-1])
    keep = inside | first
    raw, row, inside, kind = np.where(inside, raw, 32)[keep], row[keep], inside[keep], kind[keep]
    n = np.bincount(row, minlength=len(low))
    pad = ORDER - 1
    out = np.full(len(raw) + pad * len(low), 32, np.uint64)
    out[np.arange(len(raw)) + pad * (row + 1)] = raw
    start = np.concatenate([[0], np.cumsum(n + pad)])
    return out, start, np.bincount(row[kind == 1], minlength=len(low))


def gram_hash(cp: np.ndarray, at: np.ndarray | None, n: int, skip: int = 0) -> np.ndarray:
    """Hash of the n characters that end ``skip`` before each position of ``at`` (None: of each from ORDER - 1 on)."""
    if at is None:
        lo = ORDER - 1
        s = cp[lo - skip : len(cp) - skip] * _A[0]
        for k in range(1, n):
            s += cp[lo - skip - k : len(cp) - skip - k] * _A[k]
        return s
    s = cp[at - skip] * _A[0]
    for k in range(1, n):
        s += cp[at - skip - k] * _A[k]
    return s


def _find(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Index of each hash in the sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    at[keys[at] != h] = -1
    return at


class Store:
    """One language's model: for each order sorted n-gram hashes with log probabilities, and sorted contexts with log back-off weights."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, floor: float, rare: tuple[int, int] | None = None):
        """``rare``: how many n-grams occur once and twice, where ``grams`` are only the most frequent ones."""
        self.keys, self.logp, self.ctx, self.backoff = {}, {}, {}, {}
        tables = {ORDER: (grams.astype(np.uint64), counts.astype(np.float64))}
        for n in range(ORDER - 1, 0, -1):  # lower orders count the distinct characters before
            row, c = np.unique(tables[n + 1][0][:, 1:], axis=0, return_counts=True)
            tables[n] = row, c.astype(np.float64)
        below = None
        for n in range(1, ORDER + 1):
            g, c = tables[n]
            h = _hash_rows(g)
            order = np.argsort(h)
            g, c, keys = g[order], c[order], h[order]
            cx = _hash_rows(g[:, :-1]) if n > 1 else np.zeros(len(g), np.uint64)
            ckeys, at = np.unique(cx, return_inverse=True)
            total, types = np.bincount(at, c, len(ckeys)), np.bincount(at, minlength=len(ckeys))
            n1, n2 = rare if rare is not None and n == ORDER else ((c == 1).sum(), (c == 2).sum())
            d = min(0.95, max(0.1, n1 / max(1.0, n1 + 2.0 * n2)))
            lam = d * types / total
            lower = np.exp(floor) if below is None else below[1][np.searchsorted(below[0], _hash_rows(g[:, 1:]))]
            p = np.maximum(c - d, 0.0) / total[at] + lam[at] * lower
            self.keys[n], self.logp[n] = keys, np.log(p).astype(np.float32)
            self.ctx[n], self.backoff[n] = ckeys, np.log(lam).astype(np.float32)
            below = keys, p

    def log_probs(self, batch: Distinct, floor: float) -> np.ndarray:
        """Log probabilities of the batch's distinct n-grams of the highest order, from the lowest order up."""
        below = np.full(1, floor, np.float32)
        for n in range(1, ORDER + 1):
            at = _find(self.keys[n], batch.hash[n])
            out = np.empty(len(at), np.float32)
            ok = at >= 0
            out[ok] = self.logp[n][at[ok]]
            miss = np.flatnonzero(~ok)
            if len(miss):
                c = _find(self.ctx[n], batch.context[n][miss])
                weight = np.where(c >= 0, self.backoff[n][np.maximum(c, 0)], np.float32(0)) if len(self.ctx[n]) else np.zeros(len(miss), np.float32)
                out[miss] = weight + below[batch.suffix[n][miss]]
            below = out
        return below


class Distinct:
    """The distinct n-grams of a batch of texts, of each order: hash, context's hash, and where their suffix stands one order lower."""

    def __init__(self, cp: np.ndarray):
        self.hash, self.context, self.suffix = {}, {}, {}
        at = np.arange(ORDER - 1, len(cp))
        which = {}
        for n in range(ORDER, 0, -1):
            self.hash[n], first, which[n] = np.unique(gram_hash(cp, at, n), return_index=True, return_inverse=True)
            at = at[first]
            self.context[n] = gram_hash(cp, at, n - 1, 1) if n > 1 else np.zeros(len(at), np.uint64)
            if n < ORDER:
                self.suffix[n + 1] = which[n]
        self.suffix[1] = np.zeros(len(at), np.int64)
        self.which = which[ORDER]  # of each position


def _hash_rows(g: np.ndarray) -> np.ndarray:
    h = np.zeros(len(g), np.uint64)
    for k in range(g.shape[1]):
        h += g[:, g.shape[1] - 1 - k] * _A[k]
    return h


class KneserNey:
    """Interpolated Kneser-Ney models, one store a language."""

    def __init__(self, langs: list[str], lang: np.ndarray, grams: np.ndarray, counts: np.ndarray, rare: dict[int, tuple[int, int]] | None = None):
        """grams: (k, ORDER) code points, counted by language; ``rare`` as in Store, by language."""
        self.langs, n_lang = langs, len(langs)
        self.sharp, self.limit, self.mean = 1.0, np.full(n_lang, np.inf), np.zeros(n_lang)
        self.floor = -np.log(len(np.unique(grams[:, -1])) + 1.0) if len(grams) else 0.0
        order = np.argsort(lang, kind="stable")
        cut = np.searchsorted(lang[order], np.arange(n_lang + 1))
        self.stores = [Store(grams[order[a:b]], counts[order[a:b]], self.floor, (rare or {}).get(k)) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]

    def cross_entropy(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """((texts, languages) nats a character, characters counted, letters) of each text."""
        cp, start, letters = letters_of(texts)
        n_lang, pad = len(self.langs), ORDER - 1
        if len(cp) < ORDER or not n_lang:
            return np.zeros((len(texts), n_lang)), np.zeros(len(texts)), letters
        batch = Distinct(cp)
        size = np.diff(start) - pad
        own = batch.which[np.repeat(start[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]  # of positions that are a text's own
        out = np.zeros((len(texts), n_lang))
        full = np.flatnonzero(size > 0)
        if len(full):
            first = (np.cumsum(size) - size)[full]
            for k, store in enumerate(self.stores):
                out[full, k] = -np.add.reduceat(store.log_probs(batch, self.floor).astype(np.float64)[own], first) / size[full]
        return out, size, letters

    def calibrate(self, lang: np.ndarray, xent: np.ndarray, size: np.ndarray, slack: float = 1.5) -> None:
        """Fits the score's sharpness and each language's limit of surprise on held-back texts."""
        ok = size > 0
        lang, xent, size = lang[ok], xent[ok], size[ok]
        if not len(lang):
            return
        best = None
        for sharp in (0.5, 1, 2, 4, 8, 16, 32, 64):
            z = -sharp * xent
            z -= z.max(axis=1, keepdims=True)
            loss = np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(lang)), lang])
            if best is None or loss < best[0]:
                best = loss, float(sharp)
        self.sharp = best[1]
        for k in range(len(self.langs)):
            if (own := lang == k).any():
                x, n = xent[own, k], size[own]
                s = (x - np.average(x, weights=n)) * np.sqrt(n)
                low, high = np.quantile(s, (0.25, 0.75))
                usual = s <= high + 3 * (high - low)  # a text far out, of no or another language, sets no limit
                x, n = x[usual], n[usual]
                self.mean[k] = np.average(x, weights=n)
                self.limit[k] = slack * max(0.0, np.max((x - self.mean[k]) * np.sqrt(n)))

    def predict(self, texts: list[str | None], least_gap: float = 1.2) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, rejected, cross-entropy of the language) of each text."""
        xent, size, letters = self.cross_entropy(texts)
        if not self.langs:
            z = np.zeros(len(texts))
            return ["und"] * len(texts), z, np.ones(len(texts), bool), z
        und = letters == 0
        best = xent.argmin(axis=1)
        low = xent[np.arange(len(texts)), best]
        score = 1.0 / np.exp(-self.sharp * (xent - low[:, None])).sum(axis=1)
        over = low - self.mean[best]
        odd = (over > least_gap) & (over * np.sqrt(np.maximum(size, 1)) > self.limit[best])
        return [("und" if u else self.langs[b]) for u, b in zip(und, best, strict=True)], np.where(und, 0.0, score), und | odd, np.where(und, 0.0, low)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", texts_per_language: int = 3000, grams_per_language: int = 200_000, max_languages: int = 200, most_grams: int = 6_000_000) -> KneserNey:
    """Learns the models from whole texts of rows with a language.

    The classifier is fitted on a bounded sample: about ``texts_per_language`` texts of each of the
    ``max_languages`` most frequent languages, chosen by a hash of the text, and the
    ``grams_per_language`` most frequent n-grams, fewer where all languages together had more than ``most_grams`` (some 40 bytes
    each on the driver and in a task); a tenth of the texts is held back to calibrate. Discounts are taken before n-grams are cut.
    """
    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = sorted(rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect(), key=lambda r: r["lang"])
    langs = [r["lang"] for r in sizes]
    if not langs:
        return KneserNey([], np.zeros(0, int), np.zeros((0, ORDER), np.uint32), np.zeros(0))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, texts_per_language / r["count"])))])
    draw = F.pmod(F.xxhash64("text"), F.lit(1_000_003))
    sample = rows.filter(F.col("lang").isin(langs) & (draw < share[F.col("lang")] * 1_000_003))
    sample = sample.dropDuplicates(["lang", "text"])  # a text's copies are drawn together: they count once
    held = F.pmod(F.xxhash64("text", F.lit(7)), F.lit(10)) == 0

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, names = b.column(0).to_pylist(), b.column(1).to_pylist()
            for name in sorted(set(names)):
                own = [t for t, x in zip(texts, names, strict=True) if x == name]
                for at in range(0, len(own), 256):
                    cp, start, _ = letters_of(own[at : at + 256])
                    if len(cp) < ORDER:
                        continue
                    ends = np.ones(len(cp), bool)
                    for s in start[:-1]:
                        ends[s : s + ORDER - 1] = False  # the padding itself
                    pos = np.flatnonzero(ends[ORDER - 1 :]) + ORDER - 1
                    if not len(pos):
                        continue
                    _, first, n = np.unique(gram_hash(cp, pos, ORDER), return_index=True, return_counts=True)
                    g = cp[pos[first][:, None] + np.arange(1 - ORDER, 1)].astype(np.uint32)
                    whole = g.tobytes().decode("utf-32-le", "surrogatepass")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(n)), pa.array([whole[i : i + ORDER] for i in range(0, len(whole), ORDER)]), pa.array(n, pa.int64())], ["lang", "gram", "n"]
                    )

    index = {x: i for i, x in enumerate(langs)}
    scratch = Scratch(docs.sparkSession, "langid")
    grams = sample.filter(~held).mapInArrow(tidied(count), "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    grams_per_language = min(grams_per_language, max(1, most_grams // len(langs)))
    grams = scratch.save(grams, "grams")
    top = grams.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("r") <= grams_per_language)
    got = top.select("lang", "gram", "n").toArrow()
    rare = {index[r["lang"]]: (r["n1"], r["n2"]) for r in grams.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}  # a row a language
    cp = np.frombuffer("".join(got["gram"].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
    model = KneserNey(langs, np.array([index[x] for x in got["lang"].to_pylist()], int), cp, got["n"].to_numpy(), rare)
    scratch.drop("grams")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for at in range(0, len(texts), 64):
                x, size, _ = model.cross_entropy(texts[at : at + 64])
                yield pa.RecordBatch.from_arrays([b.column(1).slice(at, 64), pa.array(list(x)), pa.array(size.astype(float))], ["lang", "xent", "size"])

    cal = sample.filter(held).mapInArrow(tidied(score), "lang string, xent array<double>, size double").toArrow()
    if cal.num_rows:
        model.calibrate(np.array([index[x] for x in cal["lang"].to_pylist()]), np.array(cal["xent"].to_pylist()), cal["size"].to_numpy())
    return model


def language(df: DataFrame, model: KneserNey, text: Column) -> Column:
    """A struct column: lang_pred, score, rejected, cross_entropy."""
    arrow_rows(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample it was fitted on

    @arrow_udf("lang_pred string, score double, rejected boolean, cross_entropy double")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        for b in batches:
            parts, texts, held, size = [], b.to_pylist(), [], 0
            for i, t in enumerate(texts):
                held.append(t)
                size += len(t or "")
                if size > 350_000 or i == len(texts) - 1:
                    lang, score, odd, x = m.predict(held)
                    parts.append(pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(odd), pa.array(x, pa.float64())], ["lang_pred", "score", "rejected", "cross_entropy"]))
                    held, size = [], 0
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("cross_entropy", pa.float64())]))
        tidy()

    return predict(text.cast("string"))
