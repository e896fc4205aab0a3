"""Settings, caches, sequences, judging and model comparisons on small inputs; the duplicate passes against plain Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import chat, order, prefs, recipes, scoring
from tessella.sources import readers, settings, writers


def test_settings():
    assert settings.pairs(["a=b=c", "x=1"]) == [("a", "b=c"), ("x", "1")] and settings.layers("7, 8") == [7, 8]
    for bad in ("a", "=b", "a="):
        with pytest.raises(ValueError):
            settings.pairs([bad])
    for bad in ("", "7,", "a", "-1"):
        with pytest.raises(ValueError):
            settings.layers(bad)
    assert settings.run_name("x") == "x" and settings.run_name("x", [7, 8], package="centi") == "x-centi-L7-8" and settings.run_name("x", [1], True) == "x-L1"
    assert settings.baseline_name("Fam-1B-Base-JP", "fam-1b-") == "baseline-basejp"
    assert settings.cache_folder("/d/mix.jsonl", "a/b", 8) == "packed/mix__a__b__seq8__full"
    assert settings.addresses("https://host/", "o/r", ["f.json"]) == ["https://host/o/r/resolve/main/f.json"]
    models = [{"name": n} for n in "abc"]
    assert settings.model_plan(models, ["a", "c"], "b") == [{"name": "c"}] and settings.model_plan(models) == models
    with pytest.raises(ValueError):
        settings.model_plan(models, resume_from="z")
    assert settings.parameter_summary([(30, True), (70, False)])["trainable_pct"] == 30 and settings.parameter_summary([])["trainable_pct"] == 0


def test_metric_records(tmp_path):
    assert readers.accuracies({"overall": {"accuracy": 0.5}, "by_domain": {"a": 0.25, "b": {"accuracy": 1}}}) == (0.5, {"a": 0.25, "b": 1.0})
    assert readers.average({"evaluation": {"lang_scores": {"JA": {"AVG": 0.4}}}}) == 0.4
    got = readers.instruction_aggregate({"prompt_strict_acc": 0.9, "prompt_loose_acc": 1, "instruction_strict_acc": 0.8, "by_verifier": {"polite_form": {"instruction_strict_acc": 0.7}}})
    assert got["polite_form"] == 0.7 and got["char_count"] is None
    with pytest.raises(ValueError):
        readers.average({"evaluation": {}})
    (tmp_path / "bad.json").write_text("{")
    with pytest.raises(ValueError):
        readers.json_record(str(tmp_path / "bad.json"))


def test_eval_prompts_come_in_line_order(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text("\n".join(f'{{"id": "{i * 7 % 50}"}}' for i in range(50)) + "\n\n")
    got = readers.eval_prompts(spark, str(tmp_path / "p.jsonl"), "id string", 20).orderBy("at").collect()
    assert [r["id"] for r in got] == [str(i * 7 % 50) for i in range(20)]
    with pytest.raises(FileNotFoundError):
        readers.eval_prompts(spark, str(tmp_path / "none.jsonl"), "id string")


def test_learned_runs_are_marked(spark):
    df = spark.createDataFrame([([104, 105, 33, 97], [-100, 105, 33, -100]), ([], []), ([97], [97])], "input_ids array<int>, labels array<int>")
    got = [r["shown"] for r in chat.decode_for_inspection(df, lambda ids: "".join(map(chr, ids))).collect()]
    assert got == ["h【learned】i!【/learned】a", "", "【learned】a【/learned】"]


def test_sequences_and_their_cache(spark, tmp_path):
    docs = spark.createDataFrame([(i, "ab" * i if i != 2 else None) for i in range(6)], "pos bigint, text string")
    want = [c for i in range(4) for c in [*(b"ab" * (i if i != 2 else 0)), 0]]
    got = chat.build_sequences(docs, lambda t: list(t.encode()), 4, 0, 4).orderBy("chunk_id").collect()
    assert [x for r in got for x in r["input_ids"]] == want[: len(want) // 4 * 4]
    for eos, most in ((None, None), (0, 0)):
        with pytest.raises(ValueError):
            chat.build_sequences(docs, list, 4, eos, most)
    source, folder = tmp_path / "mix.jsonl", str(tmp_path / "packed")
    source.write_text("{}\n")
    built = []
    build = lambda n=4: built.append(1) or chat.build_sequences(docs, lambda t: list(t.encode()), n, 0)
    mark = lambda: writers.fingerprint(spark, str(source), "m/x", 4)
    a = writers.build_or_load(spark, folder, mark(), build).count()
    assert writers.build_or_load(spark, folder, mark(), build).count() == a and len(built) == 1
    source.write_text("{}\n{}\n")
    writers.build_or_load(spark, folder, mark(), build)
    assert len(built) == 2
    with pytest.raises(ValueError):
        writers.build_or_load(spark, folder, mark() | {"seq_len": 999}, lambda: build(999))


def test_judging_goes_on_where_it_stopped(spark, tmp_path):
    path = str(tmp_path / "judged")
    targets = spark.createDataFrame([(f"p{i}", i % 3, "x" * i) for i in range(9)], "prompt_id string, k int, response string")
    judge = lambda f: f.assign(score=f["response"].str.len())[["prompt_id", "k", "score"]]
    args = path, judge, "prompt_id string, k int, score bigint", ("prompt_id", "k")
    assert writers.judge_new(targets.filter("k < 2"), *args) == 6 and writers.judge_new(targets, *args) == 3 and writers.judge_new(targets, *args) == 0
    assert {r["prompt_id"]: r["score"] for r in spark.read.parquet(path).collect()} == {f"p{i}": i for i in range(9)}


def test_models_are_compared_over_all_items(spark):
    items = spark.createDataFrame([(i, "ba"[i % 2], "core") for i in range(6)], "id int, domain string, difficulty string")
    scored = spark.createDataFrame([("base", i, True) for i in range(4)] + [("new", i, i != 0) for i in range(6)], "model string, id int, correct boolean")
    rolls, stats = recipes.compare_models(items, scored, "base")
    overall = {r["model"]: (r["n"], r["correct"]) for r in rolls.filter("level = 'overall'").collect()}
    assert overall == {"base": (6, 4), "new": (6, 5)}
    assert [(r["n"], r["b"], r["c"], r["p"]) for r in stats.collect()] == [(6, 1, 2, 1.0)]
    assert [r["domain"] for r in scoring.in_order(rolls.filter("level = 'by_domain' and model = 'new'"), "domain", ["b", "a"]).collect()] == ["b", "a"]
    gate, drops = recipes.decide(spark, {"overall": 0.7, "by_domain": {"a": 0.5}}, {"overall": 0.7, "by_domain": {"a": 0.52}}, dict.fromkeys(("prompt_strict_acc", "prompt_loose_acc", "instruction_strict_acc"), 0.95), {"AVG": 0.5})
    assert gate["passed"] and drops.count() == 1


@pytest.mark.parametrize("most_rounds", [20, 1])
def test_duplicates_equal_a_pass_in_order(spark, most_rounds):
    rng = random.Random(7)
    pick = lambda n: rng.choice([None, *map(str, range(n))])
    rows = [(i, pick(9), f"a response that is long enough {rng.randrange(4)}" if i % 11 else "short", rng.choice(["keyword", "format_json", None]), pick(5)) for i in range(400)]
    rows += [(400 + i, str(i // 2), "a chain of links that is long enough", "keyword", str((i + 1) // 2)) for i in range(120)]
    x, y, want = set(), set(), {}
    for i, p, r, c, k in rows:
        why = "too_short" if len(r) < 20 else "prompt_response_dup" if (r, p) in x else "category_detail_dup" if (r, c, k) in y else None
        if why is None:
            x.add((r, p))
            y.add((r, c, k))
        want[i] = why
    df = spark.createDataFrame(rows, "pos bigint, prompt string, response string, category string, constraint_detail string")
    got = prefs.degenerate_filters(df, most_rounds=most_rounds)
    assert got.columns == [*df.columns, "reject"] and {r["pos"]: r["reject"] for r in got.collect()} == want
    assert prefs.degenerate_filters(df.limit(0)).count() == 0


def test_topics_equal_substrings(spark):
    prompts = ["東京駅への行き方を説明して", "abcabc", "", None, "😀 smile"]
    topics = ["東京駅", "駅へ", "abcabc", "abcabcabc", "", None, "😀", "smil", "xyz"]
    of = lambda rows, name: spark.createDataFrame([(r,) for r in rows], f"{name} string")
    got = sorted(r["topic"] for r in prefs.topics_in(of(topics, "topic"), of(prompts, "prompt")).collect())
    assert got == sorted(t for t in topics if t and any(p and t in p for p in prompts))
    assert prefs.topics_in(of(topics, "topic"), of([], "prompt")).count() == 0


def test_samples_are_the_first_in_seeded_order(spark):
    df = spark.range(500)
    first = [r["id"] for r in df.orderBy(order.seeded(3, F.col("id")), "id").limit(77).collect()]
    assert sorted(r["id"] for r in order.sample_rows(df, 77, 3, "id").collect()) == sorted(first)
    assert order.sample_rows(df, 0, 3, "id").count() == 0 and order.sample_rows(df, 900, 3, "id").count() == 500
