"""Token spans, progressive quotas, exact ranks and counters against plain Python."""

import math
import random
import statistics
import time

import pytest
from pyspark.sql import functions as F


from tessella.operators import chat, order, prompts, quantiles, recipes


def chars(s):
    return [ord(c) for c in s], range(len(s))


def test_spans_equal_encoded_prefixes(spark):
    rng, rows = random.Random(1), []
    for i in range(40):
        rows.append((i, [(rng.choice(["user", "assistant", "system"]), "".join(rng.choice("aé日 \n") for _ in range(rng.randint(0, 9)))) for _ in range(rng.randint(0, 6))]))
    rows += [(90, None), (91, [("assistant", None), ("assistant", "x")])]
    df = spark.createDataFrame(rows, f"id int, messages {chat.MESSAGES}")
    for most in (10_000, 20):
        one = {r["id"]: r for r in chat.sft_example(df, None, most, spans=chars).collect()}
        old = {r["id"]: r for r in chat.sft_example(df, lambda s: chars(s)[0], most).collect()}
        assert one == old
    assert one[90]["input_ids"] == []
    with pytest.raises(ValueError, match="either"):
        chat.sft_example(df, None, 10)


def test_a_long_chat_takes_linear_time():
    import numpy as np

    def cost(n):
        turns = [("assistant" if i % 2 else "user", "some words here " * 4) for i in range(n)]
        begin = time.process_time()
        text, spans = chat.markup(turns)
        ids, starts = chars(text)
        got = chat.learned(np.asarray(starts), spans)
        assert got.sum() == n // 2 * 64
        return time.process_time() - begin

    cost(100)
    assert cost(2000) < 60 * cost(200) + 0.5 and cost(2000) < 5


def test_quotas_are_met_by_the_first_rows_that_fit(spark):
    rows = [(i, [("user", f"q{i}"), ("assistant", "カメラの説明です。" * (4 if i % 3 else 400))], "a" if i % 2 else "b") for i in range(3000)]
    df = spark.createDataFrame(rows, f"id bigint, messages {chat.MESSAGES}, origin string").repartition(4)
    tried = {}
    quotas = {"char_count": 30, "polite_form": 20, "keyword": 10, "bullet_count": 5, "format_json": 0}
    out = chat.constraint_rows(df, quotas, 42, excluded_polite_origin="a", tried=tried).collect()
    # all rows made, then cut, in the same order
    for name in quotas:
        src = df if name != "polite_form" else df.filter("origin <> 'a'")
        made = src.select(F.col("id"), chat.synthesize(name, "messages", F.col("origin"), 42, F.col("id")).alias("r")).filter("r is not null")
        want = [r["id"] for r in made.orderBy(order.seeded(f"42:{name}", F.col("id")), "id").limit(quotas[name]).collect()]
        assert sorted(r["source_key"] for r in out if r["verifier"] == name) == sorted(want)
    # what is made follows the quota over the share that fits, but for a verifier that nothing fits
    assert tried["char_count"] < 300 and tried["keyword"] < 150 and tried["bullet_count"] == 3000 and "format_json" not in tried


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_medians_equal_pythons(spark, kind):
    rng, rows = random.Random(3), []
    for i in range(6000):
        g = "hot" if i % 10 else rng.choice(["a", "b", None])
        v = rng.choice([rng.randint(-5, 5), rng.randint(-(10**12), 10**12), 7]) if kind == "bigint" else rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e-300), rng.gauss(0, 1e300), 0.0, -0.0, 2.5, float("inf"), -5e-324])
        rows.append((g, None if rng.random() < 0.05 else v))
    rows += [("one", 3 if kind == "bigint" else 3.5), ("none", None), ("two", 1 if kind == "bigint" else 1.0), ("two", 4 if kind == "bigint" else 4.0)]
    df = spark.createDataFrame(rows, f"g string, v {kind}").repartition(6)
    got = {r["g"]: (r["n"], r["median"]) for r in quantiles.medians(df, "v", ["g"]).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([] if v is None else [v])
    assert got == {g: (len(x), float(statistics.median(x)) if x else None) for g, x in groups.items()}
    everything = [v for _, v in rows if v is not None]
    assert quantiles.medians(df, "v").first()["median"] == statistics.median(everything)
    nine = quantiles.ranked(df, "v", ["g"], {"p90": F.floor(F.col("n") * 0.9)})
    assert all(r["p90"] == sorted(groups[r["g"]])[math.floor(r["n"] * 0.9)] for r in nine.collect() if r["n"])


def test_ranks_of_odd_input(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    assert quantiles.ranked(df, "v", [], {"top": F.col("n") - 1, "beyond": F.col("n")}).select(F.isnan("top").alias("x"), "beyond").first()[:] == (True, None)
    assert quantiles.medians(df.limit(0), "v", []).count() == 0 and quantiles.length_summary(df.limit(0), "v").first()[:] == (0, None, None, None, None)
    with pytest.raises(TypeError):
        quantiles.medians(spark.createDataFrame([("a",)], "v string"), "v")
    s = quantiles.length_summary(spark.createDataFrame([(None, 1), (None, 2), ("x", 5)], "g string, v int"), "v", ["g"])
    assert {r["g"]: r[1:] for r in s.collect()} == {None: (2, 1, 2, 1.5, 1.5), "x": (1, 5, 5, 5.0, 5.0)}


def test_external_prompts_and_their_fates(spark):
    rows = [(f"prompt {i % 40}", "x" if i < 50 else "y") for i in range(60)] + [("地震の話", "x"), ("地震の話", "x"), (None, "y"), ("only", None)]
    kept, counts = prompts.source_c(spark.createDataFrame(rows, "prompt string, category string").repartition(3), 5, 1)
    got = {(r["fate"], r["category"]): r["count"] for r in counts.collect()}
    assert got[("banned", "x")] == 2 and got[("banned", "y")] == 1 and got[("kept", None)] == 1
    assert sum(got.values()) == len(rows) and sum(n for (f, _), n in got.items() if f == "repeated") == 20
    assert got[("kept", "x")] == 5 and got[("over", "x")] == 35 and len({r["prompt"] for r in kept.collect()}) == kept.count() == 6
    assert kept.columns == ["prompt", "category"]


def test_instructions_are_counted_from_what_was_written(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        calls.add(1)
        return x

    raw = spark.createDataFrame([(i, f"q{i}", None if i % 5 == 0 else "a", "ja" if i % 2 else "en") for i in range(40)], "id bigint, q string, a string, lang string")
    raw = raw.withColumn("q", seen(F.col("q")))
    rows, counts = recipes.prepare_instructions(raw, "q", "a", F.col("lang") == "ja", 7)
    assert rows.count() == 7 and counts.first().asDict() == {"input_count": 40, "kept_count": 20, "skipped": 4, "output_count": 7}
    assert calls.value <= 40  # the source is read once


def test_a_scope_deletes_its_tables(spark):
    from pathlib import Path

    from tessella.operators import storage

    at = Path(storage.shared_folder(spark).removeprefix("file:"))
    df = spark.createDataFrame([(1, 2.0), (1, 3.0)], "g int, v double")
    kept = storage.cut(df)
    before = set(at.glob("cut-*"))
    with storage.scope(spark):
        assert quantiles.medians(df, "v", ["g"]).first()["median"] == 2.5
        assert set(at.glob("cut-*")) > before
    assert set(at.glob("cut-*")) == before and kept.count() == 2
