"""The language model's passes: which texts each reads, and what replaces plain look-ups and shifts."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import gru_lm
from tessella.llm.gru_lm import CLASS_SIZE, SYMBOLS


def vocabulary(h):
    n = len(h)
    return gru_lm.Vocabulary(h, np.arange(n, 0, -1, dtype=np.int64), np.zeros(n, np.uint8), n, n, 1, np.zeros((gru_lm.BUCKETS, 2), np.int64))


def test_texts_are_split_once_after_counting(spark, tmp_path, monkeypatch):
    """Scoring works on the symbols that training read, not on the texts again."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.4, 80) % 5000) for _ in range(60)] + ["", None]
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(path)
    read, saved, save = {}, {}, gru_lm.Scratch.save

    def noted(self, df, name):
        read[name] = df.inputFiles()
        saved[name] = save(self, df, name)
        return saved[name]

    monkeypatch.setattr(gru_lm.Scratch, "save", noted)
    out = gru_lm.score(spark.read.parquet(path), F.col("doc_id") % 10 != 0, rounds=2)
    assert any(path in f for f in read["sequences"]) and read["scored"] and not any(path in f for f in read["scored"])
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(texts) and all(got[i]["n_tokens"] == len((t or "").split()) + 1 for i, t in enumerate(texts))
    numbers = [r["row"] for r in saved["scored"].collect()]
    assert len(set(numbers)) == len(texts)


def test_rare_words_reach_their_own_documents(spark, monkeypatch):
    """With no frequent word but the few kept, counts come from shards: known and unknown ones alike."""
    monkeypatch.setattr(gru_lm, "TOP", 0)
    docs = spark.createDataFrame([(i, f"a{i} common a{i // 2} new{i}") for i in range(40)], "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r for r in gru_lm.score(docs, F.col("doc_id") % 10 != 0, rounds=1).collect()}
    seen = {w for i in range(40) if i % 10 for w in (f"a{i}", "common", f"a{i // 2}", f"new{i}")}
    for i in range(40):
        assert got[i]["n_known"] == 1 + sum(w in seen for w in (f"a{i}", "common", f"a{i // 2}", f"new{i}")), i


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 131_072])
def test_words_are_found_as_by_binary_search(n):
    rng = np.random.default_rng(n)
    h = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    v = vocabulary(h)
    asked = np.concatenate([h, h + np.uint64(1), h - np.uint64(1), rng.integers(0, 2**64, 100_000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    assert (v.find(asked) == np.searchsorted(v.h, asked)).all()
    if n > 100_000:
        took = {}
        for f in (v.find, lambda x: np.searchsorted(v.h, x)):
            took[f] = []
            for _ in range(5):
                t = time.thread_time()
                f(asked)
                took[f].append(time.thread_time() - t)
        new, plain = (min(x) for x in took.values())
        assert new < 0.7 * plain


@pytest.mark.parametrize("size", [0.05, 1.0, 4.0, 30.0])
def test_log_probs_of_small_and_large_logits(size):
    m = gru_lm.GatedUnit(1e6 / np.arange(1.0, SYMBOLS + 1))
    rng = np.random.default_rng(7)
    for k in ("wo", "wc"):
        m.p[k] = (size * rng.standard_normal(m.p[k].shape)).astype(np.float32)
    h, y = np.tanh(rng.standard_normal((600, m.hidden))).astype(np.float32), rng.integers(0, SYMBOLS, 600).astype(np.int16)
    p, at = {k: v.astype(np.float64) for k, v in m.p.items()}, m.place[y]
    lc, lo = h @ p["wc"] + p["bc"], np.einsum("ij,ijk->ik", h.astype(np.float64), p["wo"][at // CLASS_SIZE]) + p["bo"][at // CLASS_SIZE]
    want = sum(x[np.arange(600), w] - x.max(axis=1) - np.log(np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1)) for x, w in ((lc, at // CLASS_SIZE), (lo, at % CLASS_SIZE)))
    grad = {}
    got = m.log_probs(h, y, grad)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-4 * max(1, size))
    assert all(np.isfinite(g).all() for g in grad.values())
