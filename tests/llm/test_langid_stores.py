"""Language models of many languages, each in arrays of its own; templated documents in the n-gram join."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import langid, ngram_jaccard


def word(rng, k):
    return "".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(rng.randint(2, 4)))


def test_two_hundred_languages_fit(spark):
    rng, rows = random.Random(1), []
    for k in range(200):
        words = [word(rng, k) for _ in range(60)]
        rows += [(" ".join(rng.choice(words) for _ in range(40)), f"l{k:03d}") for _ in range(12)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(8).cache()
    model = langid.train(df, most_grams=100_000)
    assert len(model.stores) == 200
    grams = sum(len(s.keys[langid.ORDER]) for s in model.stores)
    size = sum(x.nbytes for s in model.stores for t in (s.keys, s.logp, s.ctx, s.backoff) for x in t.values())
    assert grams <= 100_000 and size < 80 * grams  # linear in n-grams, whatever the number of languages
    out = df.limit(400).select("lang", langid.language(df, model, F.col("text")).alias("p")).select("lang", "p.lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in out) > 390


def test_a_store_sums_to_one():
    """Over all characters that follow a context, and the one unseen share, probabilities add up."""
    rng = np.random.default_rng(1)
    cp = np.concatenate([[32, 32, 32], rng.integers(97, 103, 4000)]).astype(np.uint32)
    g = np.stack([cp[i : len(cp) - 3 + i] for i in range(4)], axis=1)
    grams, n = np.unique(g, axis=0, return_counts=True)
    letters = np.unique(grams[:, -1])
    floor = -np.log(len(letters) + 1.0)
    store = langid.Store(grams, n, floor)
    for context in ([97, 98, 99], [98, 98, 98], [120, 121, 122]):
        total = 0.0
        for x in letters:
            p = store.log_probs(langid.Distinct(np.array([*context, x], np.uint64)), floor)
            total += float(np.exp(p[0]))
        lost = float(np.exp(store.log_probs(langid.Distinct(np.array([*context, 0x3042], np.uint64)), floor)[0]))
        assert abs(total + lost - 1) < 1e-3


def templated(n, seed=1):
    rng = random.Random(seed)
    passages = [" ".join(f"p{i}w{j}" for j in range(30)) for i in range(40)]
    return [(i, " ".join(passages[x] for x in rng.sample(range(40), 25))) for i in range(n)]


def test_templated_documents_equal_brute_force(spark):
    from .test_text_operators import brute_components

    rows = templated(220)
    rows += [(1000 + i, rows[i][1] + " some more words") for i in range(20)] + [(2000 + i, rows[i][1].replace("p3w", "q3w")) for i in range(20)]
    rows += [(3000 + i, " ".join(rows[i][1].split()[: 600 + 5 * i])) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(df).collect()}
    assert out == brute_components(sorted(rows))
    assert sum(k != c for k, (_, c) in out.items()) >= 40


def test_blocks_of_long_lists(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "SHORT", 3)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 16)
    test_templated_documents_equal_brute_force(spark)
