"""Cleaning, ordering, chats, preferences, scoring, sources, sinks and streams."""

import json
import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import chat, clean, order, prefs, scoring
from tessella.sources import readers, writers
from tessella.streaming import resume

BASE = "日本の四季は美しく、春には桜が咲き、夏には祭りが開かれ、秋には紅葉が山を染め、冬には雪が静かに降り積もる。"


def test_near_duplicates(spark):
    rows = [("c", 0, BASE * 3), ("c", 1, BASE * 3 + "。"), ("c", 2, "まったく異なる内容の文章をここに書いておくことにする。" * 3), ("c", 3, BASE * 3), ("d", 4, BASE * 3)]
    df = spark.createDataFrame(rows, "corpus string, pos bigint, text string")
    buckets, copies = clean.lsh_buckets(df, "corpus", "pos", perms=64, threshold=0.7)
    first = df.select("corpus", F.col("pos").alias("p")).join(copies, ["corpus", "p"], "left_anti")
    kept = {r["p"] for r in clean.keep_first_in_buckets(first, buckets, "corpus").filter("kept").collect()}
    assert kept == {0, 2, 4}


def test_banding():
    assert clean.banding(0.8, 128) == (9, 13) and clean.banding(0.7, 64) == (8, 8)


def test_greedy_is_the_sequential_pass(spark):
    import random

    rng, rows, want = random.Random(2), [], {}
    for g in range(20):
        n = 12
        edges = {(a, b) for b in range(n) for a in range(b) if rng.random() < 0.2}
        kept = []
        for b in range(n):
            if not any((a, b) in edges for a in kept):
                kept.append(b)
        want |= {(str(g), b): b in kept for b in range(n)}
        rows += [(str(g), a, b) for a, b in edges]
    nodes = spark.createDataFrame([k for k in want], "g string, p bigint")
    got = {(r["g"], r["p"]): r["kept"] for r in clean.greedy_keep_first(nodes, spark.createDataFrame(rows, "g string, a bigint, b bigint"), "g").collect()}
    assert got == want


@pytest.mark.parametrize("block", [16, 1 << 15])
def test_greedy_decides_long_chains(spark, block):
    """Each version links to the next only; two groups, and a link across blocks."""
    rows = [(g, i, i + 1) for g, n in (("c", 200), ("d", 33)) for i in range(n - 1)] + [("c", 0, 150)]
    nodes = spark.createDataFrame([("c", i) for i in range(200)] + [("d", i) for i in range(33)], "g string, p bigint")
    before = {(g, b): {a for k, a, c in rows if (k, c) == (g, b)} for g, b in ((r["g"], r["p"]) for r in nodes.collect())}
    want = {}
    for g, b in sorted(before):
        want[g, b] = not any(want[g, a] for a in before[g, b])
    got = clean.greedy_keep_first(nodes, spark.createDataFrame(rows, "g string, a bigint, b bigint"), "g", most_rounds=2, block=block)
    assert {(r["g"], r["p"]): r["kept"] for r in got.collect()} == want


@pytest.mark.parametrize(("most_rounds", "block"), [(20, 1 << 15), (1, 8)])
def test_buckets_are_kept_as_a_pass_in_order_does(spark, most_rounds, block):
    import random

    rng = random.Random(5)
    rows = [("a", f"k{rng.randrange(40)}", p) for p in range(90) for _ in range(rng.randrange(3))] + [("b", "hot", p) for p in range(500)] + [("c", f"{p + d}", p) for p in range(60) for d in (0, 1)]
    nodes, of = [(g, p) for g, n in (("a", 90), ("b", 500), ("c", 60)) for p in range(n)], {}
    for g, k, p in rows:
        of.setdefault((g, p), set()).add((g, k))
    taken, want = set(), {}
    for node in nodes:
        want[node] = not of.get(node, set()) & taken
        if want[node]:
            taken |= of.get(node, set())
    got = clean.keep_first_in_buckets(spark.createDataFrame(nodes, "g string, p bigint"), spark.createDataFrame(rows, "g string, key string, p bigint"), "g", most_rounds, block)
    assert {(r["g"], r["p"]): r["kept"] for r in got.collect()} == want


def test_greedy_raises_rather_than_drops(spark):
    nodes = spark.createDataFrame([("c", 1), ("c", 2)], "g string, p bigint")
    with pytest.raises(RuntimeError, match="undecided"):
        clean.greedy_keep_first(nodes, spark.createDataFrame([("c", 1, 2), ("c", 2, 1)], "g string, a bigint, b bigint"), "g").count()


def test_contamination_and_stages(spark):
    evals = spark.createDataFrame([("e", "評価用の特別な文章がここにあります")], "id string, text string")
    docs = spark.createDataFrame([("c", 0, "評価用の特別な文章がここにあります" * 1), ("c", 1, BASE), ("c", 2, "短い"), ("c", 3, "1234567890" * 10), ("c", 4, BASE)], "corpus string, pos bigint, text string")
    over = {r["pos"]: r["overlap"] for r in clean.contamination(docs, evals, 5, "pos").collect()}
    assert over[0] == 1.0 and over[1] < 0.1
    out = clean.clean_corpus(docs, evals, min_chars=10, eval_ngram=5)
    assert {r["pos"]: r["stage"] for r in out.collect()} == {0: "contamination", 1: None, 2: "length", 3: "language", 4: "dedup"}
    stats = clean.stage_stats(out).collect()
    assert sum(r["removed"] for r in stats) + stats[-1]["remaining"] == 5


def test_order_and_samples(spark):
    df = spark.range(1000).withColumnRenamed("id", "k").repartition(7)
    assert [r["pos"] for r in order.with_position(df, F.desc("k")).orderBy(F.desc("k")).collect()] == list(range(1000))
    a, b, c = (sorted(r["k"] for r in order.sample_rows(df, 50, s, "k").collect()) for s in (1, 1, 2))
    assert a == b != c and len(a) == 50
    assert order.sample_rows(df, 5000, 1, "k").count() == 1000
    assert order.package_prefix(df, "centi", F.col("k")).count() == 10
    up = order.oversample(df.filter("k < 2").select(F.col("k").alias("id")), 3)
    assert sorted(r["id"] for r in up.collect()) == ["0", "0-dup1", "0-dup2", "1", "1-dup1", "1-dup2"]


def test_mix(spark):
    df = spark.createDataFrame([(i, "ja" if i < 85 else "en", i % 7 + 1) for i in range(200)], "id bigint, language string, n_tokens bigint")
    rows, stats = order.mix(df, {"ja": 0.85, "en": 0.15})
    assert {r["language"]: r["selected"] for r in stats.collect()} == {"ja": 85, "en": 15}
    rows, stats = order.mix(df, {"ja": 1, "en": 1}, unit="tokens")
    s = {r["language"]: r["selected"] for r in stats.collect()}
    assert abs(s["ja"] - s["en"]) <= 7
    for bad in ({}, {"ja": -1.0}, {"ja": 0.0}):
        with pytest.raises(ValueError, match="ratios"):
            order.normalize_ratios(bad)


def test_sequential_duplicate_filter(spark):
    r = "a response that is long enough to stay"
    rows = [(0, "p1", r, "c1"), (1, "p2", r, "c1"), (2, "p2", r, "c2"), (3, "p1", r, "c9"), (4, "p2", r, "c1"), (5, "p9", "short", "c1"), (6, "p9", "same line here\n" * 3, "c1")]
    df = spark.createDataFrame([(*x, "keyword") for x in rows], "pos bigint, prompt string, response string, constraint_detail string, category string")
    got = {x["pos"]: x["reject"] for x in prefs.degenerate_filters(df).collect()}
    assert got == {0: None, 1: "category_detail_dup", 2: None, 3: "prompt_response_dup", 4: "prompt_response_dup", 5: "too_short", 6: "repetition"}


def test_pairs(spark):
    prompts = spark.createDataFrame([("p1", "char_count", "q1", (10, 5)), ("p2", "polite_form", "q2", None), ("p3", "keyword", "q3", None)], "id string, category string, prompt string, constraint_detail struct<max:int,min:int>")
    rows = [("p1", 0, "12345678", True, False, 4, 0), ("p1", 1, "123456", True, False, 4, 1), ("p1", 2, "1" * 30, False, False, None, 2), ("p1", 3, "1" * 12, False, False, None, 3), ("p2", 0, "x", True, False, 2, 4), ("p2", 1, "y", False, False, 5, 5)]
    s = spark.createDataFrame([(*r, "") for r in rows], "prompt_id string, k int, response string, rule_pass boolean, degenerate boolean, score int, pos bigint, rule_reason string").withColumn("prompt", F.lit(""))
    got = {r["prompt_id"]: r for r in prefs.build_pairs(s, prompts).collect()}
    assert got["p1"]["status"] == "ok" and got["p1"]["chosen"] == "123456" and got["p1"]["meta"]["rejected_k"] == 3
    assert got["p2"]["status"] == "no_chosen_candidate" and got["p3"]["status"] == "no_generations"


def test_gates(spark):
    df = spark.createDataFrame([("x" * 170,), ("x" * 180,)], "r string")
    assert prefs.length_guard(df, "r", 176, 0.2) == 175
    with pytest.raises(ValueError, match="outside"):
        prefs.length_guard(df, "r", 100, 0.2)
    evals = spark.createDataFrame([("東京駅の説明",)], "prompt string")
    pool = spark.createDataFrame([("char_count", (70, None), "京都")], "category string, constraint_detail struct<max:int,min:int>, topic string")
    prefs.assert_disjoint(pool, evals, [80])
    with pytest.raises(ValueError, match="length bound"):
        prefs.assert_disjoint(pool, evals, [70])
    with pytest.raises(ValueError, match="topic"):
        prefs.assert_disjoint(pool.withColumn("topic", F.lit("東京駅")), evals, [80])


def test_chats(spark):
    m = [("system", "s"), ("user", "q"), ("assistant", "a")]
    df = spark.createDataFrame([(m,)], f"m {chat.MESSAGES}")
    r = df.select(chat.to_chatml("m").alias("c"), chat.question_answer("m").alias("q"), chat.response_length("m").alias("n")).first()
    assert r["c"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n" and tuple(r["q"]) == ("q", "a") and r["n"] == 1
    with pytest.raises(Exception, match="invalid role"):
        spark.createDataFrame([([("robot", "x")],)], f"m {chat.MESSAGES}").select(chat.to_chatml("m")).collect()
    ex = chat.sft_example(df, lambda s: list(s.encode()), 1000, "m").first()
    learned = bytes(x for x in ex["labels"] if x != -100)
    assert learned == b"a" and len(ex["input_ids"]) == len(ex["labels"]) == len(r["c"])


def test_constraint_rows(spark):
    rows = [(i, [("user", f"q{i}"), ("assistant", "カメラの説明です。" * 4)], "a" if i % 2 else "b") for i in range(30)]
    df = spark.createDataFrame(rows, f"id bigint, messages {chat.MESSAGES}, origin string")
    out = chat.constraint_rows(df, {"char_count": 5, "polite_form": 4, "keyword": 3, "bullet_count": 2}, excluded_polite_origin="a").collect()
    n = {v: [r for r in out if r["verifier"] == v] for v in ("char_count", "polite_form", "keyword", "bullet_count")}
    assert [len(x) for x in n.values()] == [5, 4, 3, 0] and all(r["origin"] == "b" for r in n["polite_form"])
    assert "「カメラ」" in n["keyword"][0]["messages"][0]["content"]


def test_pack(spark):
    docs = [(i, list(range(i % 9 + 1))) for i in range(200)]
    flat = [x for _, t in docs for x in [*t, 99]]
    got = chat.pack(spark.createDataFrame(docs, "pos bigint, input_ids array<int>").repartition(5), 16, 99).orderBy("chunk_id").collect()
    assert [r["input_ids"] for r in got] == [flat[i : i + 16] for i in range(0, len(flat) - 15, 16)]
    with pytest.raises(ValueError, match="positive"):
        chat.pack(spark.createDataFrame(docs, "pos bigint, input_ids array<int>"), 0, 99)


def test_statistics(spark):
    from fractions import Fraction

    cases = [(0, 0), (3, 9), (10, 10), (0, 5), (40, 61)]
    df = spark.createDataFrame(cases, "b bigint, c bigint").select("b", "c", scoring.mcnemar_p(F.col("b"), F.col("c")).alias("p"))
    for r in df.collect():
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        want = 1.0 if n == 0 else min(1.0, float(2 * Fraction(sum(math.comb(n, i) for i in range(k + 1)), 2**n)))
        assert abs(r["p"] - want) < 1e-12
    w = spark.createDataFrame([(0, 0), (50, 100)], "k bigint, n bigint").select(scoring.wilson(F.col("k"), F.col("n")).alias("w")).collect()
    assert tuple(w[0]["w"]) == (0.0, 0.0) and abs(w[1]["w"]["lo"] - 0.4038) < 1e-3
    d = spark.createDataFrame([("m", 1 if i % 3 == 0 else 0) for i in range(90)], "model string, diff int")
    r = scoring.bootstrap_interval(d, "model").first()
    assert r["lo"] < 1 / 3 < r["hi"] and r["hi"] - r["lo"] < 0.3


@pytest.mark.parametrize(("drop", "ok"), [(0.03, True), (0.031, False)])
def test_domain_gate(spark, drop, ok):
    base = spark.createDataFrame([("a", 0.8)], "domain string, accuracy double")
    cand = spark.createDataFrame([("a", 0.8 - drop)], "domain string, accuracy double")
    g = scoring.domain_gate(cand, base)
    assert g.first()["passed"] is ok
    assert scoring.decision_gate(0.7, g, 0.95, 0.5)["passed"] is ok
    assert not scoring.decision_gate(0.7, g.filter("false"), 0.95, 0.5)["passed"]


def test_instruction_scores(spark):
    kinds = "struct<max:int,min:int,count:int,include:array<string>,exclude:array<string>,keys:array<string>,start:string,style:string,min_rows:int,allow_units:boolean>"
    d = lambda **k: tuple(k.get(x) for x in ("max", "min", "count", "include", "exclude", "keys", "start", "style", "min_rows", "allow_units"))
    prompts = spark.createDataFrame([("a", "char_count", ["char_count"], {"char_count": d(max=5)}), ("b", "mixed", ["numeric_only", "char_count"], {"numeric_only": d(), "char_count": d(max=3)})], f"id string, category string, instruction_id_list array<string>, kwargs map<string,{kinds}>")
    gens = spark.createDataFrame([("a", "承知しました。\n短い"), ("b", "42")], "id string, response string")
    s = {(r["id"], r["instruction"]): (r["strict"], r["loose"]) for r in scoring.score_instructions(gens, prompts).collect()}
    assert s == {("a", "char_count"): (False, True), ("b", "numeric_only"): (True, True), ("b", "char_count"): (True, True)}
    agg = {(r["level"], r["name"]): (r["n"], r["strict"], r["loose"]) for r in scoring.aggregate_instructions(scoring.score_instructions(gens, prompts)).collect()}
    assert agg["prompt", "all"] == (2, 0.5, 1.0) and agg["instruction", "all"][0] == 3


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\n\n{"id": "2", "text": ""}\n')
    df = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "id string, text string")
    assert df.count() == 2 and readers.line_count(spark, str(tmp_path / "a.jsonl")) == 2 and readers.line_count(spark, str(tmp_path / "none")) == 0
    assert readers.sample_texts(spark, [str(tmp_path / "a.jsonl"), str(tmp_path / "none")], 10).count() == 1
    (tmp_path / "bad.jsonl").write_text('{"id": \n')
    with pytest.raises(Exception):  # noqa: B017
        readers.jsonl(spark, str(tmp_path / "bad.jsonl"), "id string").collect()
    (tmp_path / "d.csv").write_text('﻿id,category,instruction_id_list,constraint_detail,topic,prompt,response,response_char_count\n1,char_count,char_count,"{""max"": 50}",t,p,"line one\nline ""two""",3\n', encoding="utf-8")
    r = readers.distill_csv(spark, str(tmp_path / "d.csv")).first()
    assert r["id"] == "1" and r["detail"]["max"] == 50 and r["response"] == 'line one\nline "two"'
    writers.jsonl(df, str(tmp_path / "out"), "id")
    assert [json.loads(x)["id"] for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()] == ["1", "2"]
    assert writers.append_new(df, str(tmp_path / "t"), ["id"]) == 2 and writers.append_new(df, str(tmp_path / "t"), ["id"]) == 0
    writers.packed_cache(spark.createDataFrame([([1, 2],)], "input_ids array<int>"), str(tmp_path / "p"), {"seq_len": 2})
    assert writers.load_packed(spark, str(tmp_path / "p"), {"seq_len": 2}).count() == 1 and writers.load_packed(spark, str(tmp_path / "p"), {"seq_len": 3}) is None
    assert "| id | text |" in writers.report(df, "T")
    s = readers.Sources()
    s.register("a", lambda spark: df)
    assert list(s.load_all(spark)) == ["a"]
    with pytest.raises(KeyError):
        s.load_all(spark, ["b"])
    assert readers.merge_configs({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}}) == {"a": {"b": 3, "c": 2}}


def test_stream_resumes_by_key(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "1"}\n{"id": "2"}\n')
    run = lambda: resume.process_once(resume.bounded_stream(spark, str(tmp_path / "in"), "id string"), str(tmp_path / "out"), str(tmp_path / "cp"), ["id"])
    run()
    (tmp_path / "in" / "2.json").write_text('{"id": "2"}\n{"id": "3"}\n')
    run()
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "2", "3"]


def test_mcnemar_of_many_pairs(spark):
    from fractions import Fraction

    df = spark.createDataFrame([(1000, 1000), (1150, 1250), (900, 1500), (20_000, 20_300)], "b bigint, c bigint")
    for r in df.select("b", "c", scoring.mcnemar_p(F.col("b"), F.col("c")).alias("p")).collect():
        n, k, t, s = r["b"] + r["c"], min(r["b"], r["c"]), 1, 0
        for i in range(k + 1):
            s, t = s + t, t * (n - i) // (i + 1)
        want = min(1.0, float(Fraction(2 * s, 2**n)))
        assert abs(r["p"] - want) <= 1e-9 * want, r


def test_paired_and_duplicates_take_all_rows(spark, tmp_path):
    import __spark_entry__ as entry

    n = 1400
    spark.range(n).withColumnRenamed("id", "event_id").write.parquet(str(tmp_path / "events.parquet"))
    lines = [(k, j, k * 7 + j, k * 13 % 29 + j, float(k * j % 11)) for k in range(1, 401) for j in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    right = lambda i, m: i * (m + 3) % 7 < 4
    got = {r["model"]: r for r in entry.queries()["e6_e8_j8_paired"](spark, str(tmp_path)).collect()}
    assert sorted(got) == ["m1", "m2"]
    for m in (1, 2):
        b, c = (sum(right(i, 0) is x and right(i, m) is not x for i in range(n)) for x in (True, False))
        r = got[f"m{m}"]
        want = min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c))
        assert (r["n"], r["b"], r["c"]) == (n, b, c) and abs(r["delta"] - (c - b) / n) < 1e-12 and abs(r["p"] - want) <= 1e-9 * want
    first, second, want = set(), set(), {}
    for i, (_, j, _, s, q) in enumerate(sorted(lines), 1):
        p, d = (q % 5, s % 7), (q % 5, j % 3)
        want[i] = "prompt_response_dup" if p in first else "category_detail_dup" if d in second else None
        if want[i] is None:
            first.add(p)
            second.add(d)
    got = {r["pos"]: r["reject"] for r in entry.queries()["d4_d5_d6_sequential_duplicates"](spark, str(tmp_path)).collect()}
    assert got == want


def test_registered_queries_equal_oracle(spark):
    """A few registered queries against DuckDB on the smallest tables, if they are there."""
    import glob
    import os

    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no tables")
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    for name in ("n17_split_bucket", "x1_a3_mix_documents", "w7_x2_budget_prefix", "c9_c10_pack", "w1_w2_w3_w4_o8_pairs", "a14_a15_rollup"):
        df, sql = entry.queries()[name](spark, sf), con.sql(entry.oracle_sql()[name])
        cols = sorted(df.columns)
        show = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
        assert show(df.select(*cols).collect()) == show(sql.select(*cols).fetchall()), name
