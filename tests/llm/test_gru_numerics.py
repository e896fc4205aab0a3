"""The network's arithmetic: the values of plain formulas, at less of their cost."""

import time

import numpy as np
import pytest

from tessella.llm import gru_lm
from tessella.llm.gru_lm import CLASS_SIZE, SYMBOLS


@pytest.fixture
def model():
    m = gru_lm.GatedUnit(1e6 / np.arange(1.0, SYMBOLS + 1))
    rng = np.random.default_rng(2)
    m.p["wo"] += 0.1 * rng.standard_normal(m.p["wo"].shape).astype(np.float32)
    return m


def plain(m, h, y, grad):
    """``log_probs`` row by row: logits with classes last, a class's rows picked one by one."""
    p, at = m.p, m.place[y]
    cls, rows = at // CLASS_SIZE, np.arange(len(y))
    lc = h @ p["wc"] + p["bc"]
    lc -= lc.max(axis=1, keepdims=True)
    own = lc[rows, cls].copy()
    np.exp(lc, out=lc)
    total = lc.sum(axis=1)
    out = own - np.log(total)
    lc /= -total[:, None]
    lc[rows, cls] += 1
    grad["wc"], grad["bc"], gh = h.T @ lc, lc.sum(axis=0), lc @ p["wc"].T
    grad["wo"], grad["bo"] = np.zeros_like(p["wo"]), np.zeros_like(p["bo"])
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    cut = np.searchsorted(cls[order], np.arange(m.classes + 1))
    for k in range(m.classes):
        i = order[cut[k] : cut[k + 1]]
        if len(i):
            hk, w, j = h[i], at[i] - k * CLASS_SIZE, np.arange(len(i))
            lo = hk @ p["wo"][k]
            lo += p["bo"][k]
            lo -= lo.max(axis=1, keepdims=True)
            own = lo[j, w].copy()
            np.exp(lo, out=lo)
            total = lo.sum(axis=1)
            out[i] += own - np.log(total)
            lo /= -total[:, None]
            lo[j, w] += 1
            grad["wo"][k], grad["bo"][k] = hk.T @ lo, lo.sum(axis=0)
            gh[i] += lo @ p["wo"][k].T
    grad["h"] = gh
    return out


def test_softmax_equals_the_plain_one_and_costs_less(model):
    rng = np.random.default_rng(3)
    h = rng.standard_normal((8192, model.hidden)).astype(np.float32)
    y = model.place.argsort()[np.minimum(rng.zipf(1.3, len(h)) - 1, SYMBOLS - 1)].astype(np.int16)
    took, grads, outs = {plain: [], gru_lm.GatedUnit.log_probs: []}, [], []
    for _ in range(12):
        grads.clear()
        outs.clear()
        for f, s in took.items():
            grads.append({})
            t = time.thread_time()
            outs.append(f(model, h, y, grads[-1]))
            s.append(time.thread_time() - t)
    assert np.allclose(*outs, atol=1e-4)
    assert grads[0].keys() == grads[1].keys()
    for k, v in grads[0].items():
        assert np.allclose(v, grads[1][k], rtol=1e-3, atol=2e-3), k
    best = [min(s) for s in took.values()]
    assert best[1] < 0.85 * best[0], best


def test_training_follows_the_gradient(model):
    ids = np.random.default_rng(4).integers(0, SYMBOLS, 64).astype(np.int16)
    offs = np.array([0, 32, 64])  # two rows of one window: one update
    slopes = {}
    for k in ("wh", "wx", "b"):
        flat = model.p[k].reshape(-1)
        for i in range(0, flat.size, 7):
            was, got = flat[i], []
            for step in (0.02, -0.02):
                flat[i] = was + np.float32(step)
                got.append(model.score(ids, offs).sum())
            flat[i] = was
            slopes[k, i] = (got[0] - got[1]) / 0.04
    before = model.p["wh"].copy(), model.p["wx"].copy(), model.p["b"].copy()
    model.train(ids)
    moved = {k: (model.p[k] - b).reshape(-1) for k, b in zip(("wh", "wx", "b"), before, strict=True)}
    steep = {x: s for x, s in slopes.items() if abs(s) > 0.02}
    assert len(steep) > 100
    assert all(np.sign(moved[k][i]) == np.sign(s) for (k, i), s in steep.items())


@pytest.mark.parametrize("rows", [1, 3, 512])
def test_scores_do_not_depend_on_how_many_are_taken_at_once(model, rows):
    rng = np.random.default_rng(5)
    size = np.concatenate([rng.integers(1, 90, 200), [1, 700, 32, 64, 33]])
    ids = rng.integers(0, SYMBOLS, size.sum()).astype(np.int16)
    offs = np.concatenate([[0], np.cumsum(size)])
    alone = np.concatenate([model.score(ids[a:b], np.array([0, b - a])) for a, b in zip(offs[:-1], offs[1:], strict=True)])
    assert np.allclose(model.score(ids, offs, rows=rows), alone, rtol=1e-4, atol=1e-3)
    assert len(model.score(ids[:0], np.array([0]))) == 0
