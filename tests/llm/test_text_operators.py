"""Operators on documents against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.llm import bpe, gru_lm, langid, mixing, ngram_jaccard, toxicity

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")


def words(text):
    return (text or "").encode().lower().split()


def brute_components(rows, num=75, den=100, n=5):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(sets[a][0]), find(sets[b][0])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def test_ngram_jaccard_equals_brute_force(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(docs).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_ngram_jaccard_near_copies_of_a_base(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        w[i % 60] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, f"a b c d e f g only {i} here") for i in range(20)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_ngram_jaccard_equals_brute_force_on_mutated_families(spark):
    rng, rows = random.Random(3), []
    for f in range(6):
        base = [f"f{f}w{i}" for i in range(80)]
        for k in range(45):
            w = list(base)
            for _ in range(k % 7):  # from none to more changes than a link allows
                w[rng.randrange(80)] = f"x{rng.randrange(50)}"
            rows.append((1000 * f + k, " ".join(w)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == brute_components(rows)


def test_ngram_jaccard_reads_very_long_texts(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(900_000))), (2, " ".join(f"w{i}" for i in range(890_000))), (3, "a b"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.near_duplicates(df).collect()}
    assert got == {1: (899_996, 1), 2: (889_996, 1), 3: (1, 3), 4: (0, 4)}


def test_ngram_jaccard_runs_keep_counts():
    import numpy as np

    row = np.sort(np.random.default_rng(0).integers(0, 40, 60_000))
    docs_, size = ngram_jaccard._runs(row)
    assert (np.repeat(docs_, size) == row).all() and len(ngram_jaccard._runs(row[:0])[0]) == 0


def test_ngram_jaccard_empty_table(docs):
    assert ngram_jaccard.near_duplicates(docs.filter("false")).count() == 0


def test_bpe_equals_library_and_round_trips(docs):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    codec = bpe.BpeCodec(ranks, P.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    out = bpe.bpe_tokenize(docs, codec, raw=True).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = lib.encode_ordinary(texts[r["doc_id"]])
        assert r["token_ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == texts[r["doc_id"]].encode()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    for t in ("", "a" * 3000, "日本語🎉 x\n\n  y", "it's <|endoftext|>"):
        assert codec.encode(t).tolist() == lib.encode_ordinary(t)


def test_perfect_hash_is_minimal_and_verifies():
    keys = {f"k{i}".encode(): i for i in range(1000)}
    h = bpe.PerfectHash(keys)
    assert len(h.slot_key) == 1000 and all(h.get(k) == v for k, v in keys.items()) and h.get(b"other") == -1


def test_language_is_found_on_held_out_texts(docs):
    model = langid.train(docs.filter("doc_id % 4 <> 2"))
    out = docs.select("doc_id", "lang", "text", langid.language(docs, model, F.col("text")).alias("p")).select("*", "p.*").collect()
    held = [r for r in out if r["doc_id"] % 4 == 2 and r["doc_id"] < 240]
    assert sum(r["lang"] == r["lang_pred"] for r in held) == len(held)
    odd = {r["doc_id"]: r for r in out}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (300, 301, 302))
    assert not any(r["rejected"] for r in held) and all(0 <= r["score"] <= 1 for r in out)


def test_language_rejects_gibberish_despite_an_odd_calibration_text(docs, spark):
    rng = random.Random(9)
    junk = lambda n: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(n))
    odd = spark.createDataFrame([(junk(40),) for _ in range(80)], "text string").filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(10)) == 0).limit(1).select("text", F.explode(F.array(*map(F.lit, ("en", "de", "fr")))).alias("lang"))
    learn = docs.filter("doc_id % 4 <> 2 and doc_id < 240").select("text", "lang")
    model = langid.train(learn.unionByName(spark.createDataFrame(odd.collect(), "text string, lang string")))
    asked = [junk(10), junk(30), "hyvää huomenta kaikille, tänään aurinko paistaa ja linnut laulavat metsässä joka puolella järveä"]
    assert all(model.predict(asked)[2])
    held = [r["text"] for r in docs.filter("doc_id % 4 = 2 and doc_id < 240").collect()]
    assert not any(model.predict(held)[2])


def test_language_probabilities_sum_to_one(docs):
    import numpy as np

    model = langid.train(docs)
    chars = [chr(c) for c in np.unique([g & 0x10FFFF for t in docs.filter("text is not null").collect() for g in map(ord, t["text"].lower()) if chr(g).isalpha()])]
    total = np.zeros(len(model.langs))
    for c in [*chars, " "]:
        x, n, _ = model.cross_entropy(["the" + c if c != " " else "the "])
        y, m, _ = model.cross_entropy(["the"])
        total += np.exp(-(x[0] * n[0] - y[0] * m[0]))
    assert (total <= 1.0 + 1e-4).all() and (total > 0.5).all()


def test_language_model_equals_plain_kneser_ney():
    import numpy as np

    texts, n = ["the cat sat on the mat", "a dog and the other cat", "that mat"], langid.ORDER
    clean = lambda t: " " * (n - 1) + t
    counts = {n: collections.Counter(clean(t)[i - n + 1 : i + 1] for t in texts for i in range(n - 1, len(clean(t))))}
    for k in range(n - 1, 0, -1):  # in how many ways a shorter n-gram is preceded
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    letters = {g[-1] for g in counts[n]}

    def p(g):
        k = len(g)
        if k == 0:
            return 1 / (len(letters) + 1)
        c = collections.Counter(counts[k].values())
        d = min(0.95, max(0.1, c[1] / max(1, c[1] + 2 * c[2])))
        follow = {x: v for x, v in counts[k].items() if x[:-1] == g[:-1]}
        if not follow:
            return p(g[1:])
        return max(follow.get(g, 0) - d, 0) / sum(follow.values()) + d * len(follow) / sum(follow.values()) * p(g[1:])

    grams = np.array([[ord(x) for x in g] for g in counts[n]], np.uint32)
    model = langid.KneserNey(["en"], np.zeros(len(grams), int), grams, np.array(list(counts[n].values())))
    for t in ("the cat", "a zebra on that", "mat"):
        plain = -sum(math.log(p(clean(t)[i - n + 1 : i + 1])) for i in range(n - 1, len(clean(t)))) / len(t)
        assert model.cross_entropy([t])[0][0, 0] == pytest.approx(plain, rel=1e-4)


def test_language_without_training_rows(docs):
    model = langid.train(docs.filter("false"))
    assert {r["p"]["lang_pred"] for r in docs.select(langid.language(docs, model, F.col("text")).alias("p")).collect()} == {"und"}


def test_toxicity_on_held_out_texts(spark):
    import random

    from .conftest import prose

    rng, rows = random.Random(1), []
    for i in range(900):
        bad = i % 6 == 0
        w = prose(rng, "en", 40).split()
        if bad:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(("grumbo", "Zarkle", "grumbos", "fnord"))
        rows.append((i, " ".join(w), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.filter("doc_id % 5 <> 0").select("doc_id", "toxic"))
    out = df.filter("doc_id % 5 = 0").select("toxic", toxicity.toxicity(df, model, F.col("text")).alias("s")).collect()
    assert sum((r["s"] >= 0.5) == r["toxic"] for r in out) / len(out) > 0.97 and all(0 <= r["s"] <= 1 for r in out)
    assert all(0 <= s <= 1 for s in model.score([None, "", "!!!", "g.r.u.m.b.o " * 5000]))


def test_toxicity_without_labels(docs, spark):
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert {r["s"] for r in docs.select(toxicity.toxicity(docs, model, F.col("text")).alias("s")).collect()} == {0.0}


def test_isotonic_rises():
    import numpy as np

    x, y = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(y) >= 0).all() and y[0] == 0 and y[-1] == 1 and np.interp(2.5, x, y) == 0.5


def test_lm_base_is_exact_and_network_beats_it(docs):
    held = F.col("doc_id") % 10 == 0
    got = {r["doc_id"]: r for r in gru_lm.score(docs, ~held, rounds=2).collect()}
    texts = {r["doc_id"]: words(r["text"]) + [None] for r in docs.collect()}
    c = collections.Counter(w for i, t in texts.items() if i % 10 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        assert got[i]["n_tokens"] == len(t) and got[i]["n_known"] == sum(c[w] > 0 for w in t) and got[i]["train_tokens"] == n
        assert abs(got[i]["base_score"] - base) < 1e-6 * max(1, abs(base))
    assert sum(r["score"] for r in got.values()) > sum(r["base_score"] for r in got.values())


def test_lm_network_sees_every_training_document(docs, monkeypatch):
    saved, save = {}, gru_lm.Scratch.save

    def noted(self, df, name):
        saved[name] = save(self, df, name)
        return saved[name]

    monkeypatch.setattr(gru_lm.Scratch, "save", noted)
    trains = F.col("doc_id") % 10 != 0
    gru_lm.score(docs, trains)
    n = sum(len(words(r["text"])) + 1 for r in docs.filter(trains).collect())
    assert saved["sequences"].count() == docs.filter(trains).count() and saved["sequences"].agg(F.sum("n")).first()[0] == n


def test_lm_state_goes_on_across_windows():
    import numpy as np

    m = gru_lm.GatedUnit(np.arange(gru_lm.SYMBOLS, 0, -1, dtype=float))
    ids = np.random.default_rng(0).integers(0, gru_lm.SYMBOLS, 500).astype(np.int16)
    offs = np.array([0, 300, 301, 500])
    a, b = m.score(ids, offs, window=7), m.score(ids, offs, window=64)
    assert np.allclose(a, b, atol=1e-3)
    h = np.zeros((1, m.hidden), np.float32)
    y = np.arange(gru_lm.SYMBOLS)
    assert abs(np.exp(m.log_probs(np.repeat(h, len(y), 0), y)).sum() - 1) < 1e-4


def test_lm_network_equals_plain_recurrence():
    import numpy as np

    m = gru_lm.GatedUnit(np.arange(gru_lm.SYMBOLS, 0, -1, dtype=float))
    ids = np.random.default_rng(1).integers(0, gru_lm.SYMBOLS, 3000).astype(np.int16)
    m.train(ids, rows=8)
    p, n, h, total = {k: v.astype(np.float64) for k, v in m.p.items()}, m.hidden, np.zeros(m.hidden), 0.0
    for before, y in zip([0, *ids[:39]], ids[:40], strict=True):
        g, a = p["e"][before] @ p["wx"] + p["b"], h @ p["wh"]
        z, r = (1 / (1 + np.exp(-(g[k : k + n] + a[k : k + n]))) for k in (0, n))
        c = np.tanh(g[2 * n :] + r * a[2 * n :])
        h = (1 - z) * c + z * h
        at = int(m.place[y])
        lc = h @ p["wc"] + p["bc"]
        lo = h @ p["wo"][at // gru_lm.CLASS_SIZE] + p["bo"][at // gru_lm.CLASS_SIZE]
        total += lc[at // gru_lm.CLASS_SIZE] - np.log(np.exp(lc).sum()) + lo[at % gru_lm.CLASS_SIZE] - np.log(np.exp(lo).sum())
    assert m.score(ids[:40], np.array([0, 40]))[0] == pytest.approx(total, rel=1e-4)


def test_lm_levels_bound_the_frequent_words():
    import numpy as np

    c = np.array([1, 4095, 4096, 70_000, 70_100, 10**12, 2**62])
    x = gru_lm._level(c)
    assert (np.diff(x) >= 0).all() and x[0] == 1 and x[-1] < gru_lm.LEVELS and x[5] > x[4]


def test_lm_without_documents(docs):
    assert gru_lm.score(docs.filter("false"), F.lit(True)).count() == 0


def test_budgets_redistribute_among_siblings_first():
    assert mixing.split_budget(100, [1, 1, 2], [10, 100, 100]) == pytest.approx([10, 30, 60])
    assert mixing.split_budget(100, [1, 1], [10, 20]) == [10, 20]
    have = {("a", "x", "1"): 10, ("a", "y", "1"): 1000, ("b", "x", "1"): 1000}
    got = mixing.leaf_budgets(have, 400, {("a",): 1, ("b",): 1}, 1)
    assert got == {("a", "x", "1"): 10, ("a", "y", "1"): 190, ("b", "x", "1"): 200}  # a's shortage stays in a
    got = mixing.leaf_budgets({("a", "x", "1"): 10, ("b", "x", "1"): 1000}, 400, {}, 2)
    assert got == {("a", "x", "1"): 20, ("b", "x", "1"): 380}


def test_mixing_takes_whole_epochs_and_a_prefix(docs):
    weights = {("d",): 1.0}
    out = mixing.mix(docs, F.lit("d"), weights, budget=9000, most_epochs=3, epoch="epoch").collect()
    again = mixing.mix(docs.repartition(3), F.lit("d"), weights, budget=9000, most_epochs=3, epoch="epoch").collect()
    assert sorted((r["doc_id"], r["epoch"]) for r in out) == sorted((r["doc_id"], r["epoch"]) for r in again)
    assert set(out[0].asDict()) == {*docs.columns, "epoch"}
    have = collections.Counter()
    for r in docs.collect():
        have["d", r["lang"] or "", r["source"] or ""] += len(words(r["text"]))
    given = mixing.leaf_budgets(have, 9000, weights, 3)
    used = collections.Counter()
    for r in out:
        used["d", r["lang"] or "", r["source"] or ""] += len(words(r["text"]))
    for leaf, n in given.items():
        assert used[leaf] <= n
        top = max(len(words(r["text"])) for r in docs.collect() if (r["lang"] or "", r["source"] or "") == leaf[1:])
        assert used[leaf] > n - top or used[leaf] == n


def test_mixing_equals_a_plain_prefix(docs, spark):
    extra = docs.filter("doc_id < 6").withColumn("score", F.lit("other"))  # ids and texts again, other columns
    rows = docs.unionByName(docs.filter("doc_id < 4")).unionByName(extra).withColumn("row", F.monotonically_increasing_id())
    weights, budget, seed = {("d",): 1.0}, 5000, 42
    out = mixing.mix(docs.unionByName(docs.filter("doc_id < 4")).unionByName(extra), F.lit("d"), weights, budget=budget, most_epochs=2, seed=seed, epoch="epoch").collect()
    have, leaves = collections.Counter(), collections.defaultdict(list)
    for r in rows.collect():
        leaf = ("d", r["lang"] or "", r["source"] or "")
        have[leaf] += len(words(r["text"]))
        leaves[leaf].append(r)
    want = collections.Counter()
    for leaf, given in mixing.leaf_budgets(have, budget, weights, 2).items():
        whole, rest = divmod(given, have[leaf]) if have[leaf] else (1, 0)
        own = spark.createDataFrame(leaves[leaf], rows.schema)
        order = own.select("*", F.xxhash64(F.lit(seed), F.lit(whole).cast("bigint"), "doc_id").alias("h"), F.xxhash64("text").alias("th"), F.xxhash64(F.struct(*docs.columns)).alias("rh"))
        order = order.withColumn("first", F.shiftrightunsigned("h", 64 - (mixing.BUCKETS - 1).bit_length())).orderBy("first", "h", "doc_id", "th", "rh").collect()
        for r in order:
            for e in range(whole):
                want[r["doc_id"], r["score"], e] += 1
        used = 0
        for r in order:
            used += len(words(r["text"]))
            if rest and used <= rest:
                want[r["doc_id"], r["score"], whole] += 1
    assert collections.Counter((r["doc_id"], r["score"], r["epoch"]) for r in out) == want


def test_mixing_empty_table(docs):
    assert mixing.mix(docs.filter("false"), F.lit("d"), {}).count() == 0
