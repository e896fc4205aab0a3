"""Whole preparations on small inputs."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import verifiers as V
from tessella.operators import clean, recipes
from tessella.sources import readers


def test_sizes_round_exact_halves_to_even(spark):
    sizes = [0, 512, 1280, 1792, 1023, 1024, 2**20 + 2**18, 5 * 2**40, -1280]
    got = [r["s"] for r in spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n bigint").select("i", T.format_bytes("n").alias("s")).orderBy("i").collect()]

    def plain(n):
        x, units = float(n), ["B", "KiB", "MiB", "GiB", "TiB"]
        while abs(x) >= 1024 and len(units) > 1:
            x, units = x / 1024, units[1:]
        return f"{x:.1f} {units[0]}"

    assert got == [plain(n) for n in sizes]


@pytest.mark.parametrize("most_pool", [10**6, 3])
def test_contamination_equals_sets_of_grams(spark, most_pool):
    rows = [(1, "abcdefghij klmnop"), (2, "xyz"), (3, ""), (4, None), (5, "none of these here"), (6, "日本語のとても長いテキスト🎉です"), (7, "abcdefghij" * 300)]
    evals = ["zzabcdefghij", "xyz", "とても長いテキスト🎉", None]
    grams = lambda t, n=5: {t[i : i + n] for i in range(max(len(t) - n + 1, 1))} if t else set()
    pool = set().union(*(grams(e) for e in evals))
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r["id"]: r["overlap"] for r in clean.contamination(df, spark.createDataFrame([(e,) for e in evals], "text string"), 5, most_pool=most_pool).collect()}
    assert got == {i: pytest.approx(len(grams(t) & pool) / len(grams(t)) if t else 0.0) for i, t in rows}


def test_prepare_data(spark):
    base = "the quick brown fox number {} jumps over the lazy dog again and again, "
    web = spark.createDataFrame([(i, base.format(i * 7919) + "x" * i, "") for i in range(6)] + [(6, base.format(0), ""), (7, "short", "")], "id bigint, text string, title string")
    topical = spark.createDataFrame([(i, "an island in the sea with number " + str(i * 104729) + " and some more words of its own here", "Island" if i else "none") for i in range(3)], "id bigint, text string, title string")
    config = {"corpora": [{"name": "web"}, {"name": "topical", "filter": {"type": "keyword_oversample", "oversample_weight": 2}}], "mix": {"ratios": {"en": 1.0}}, "clean": {"minhash_threshold": 0.9}}
    mixture, facts = recipes.prepare_data({"web": web, "topical": topical}, config, groups={"isle": ["Island"]}, evals=spark.createDataFrame([("nothing shared",)], "text string"))
    keys = {r["key"] for r in mixture.collect()}
    assert {"topical/1", "topical/1-dup1", "topical/2", "topical/2-dup1"} <= keys and "topical/0" not in keys and "web/7" not in keys
    clean_ = {(r["corpus"], r["stage"]): r["removed"] for r in facts["clean"].collect()}
    assert clean_["web", "length"] == 1 and [r["selected"] for r in facts["mix"].collect()] == [len(keys)]
    with pytest.raises(ValueError):
        recipes.prepare_data({"web": web}, config, names=["other"])
    with pytest.raises(ValueError):
        recipes.prepare_data({"web": web}, config, streaming=True)


def test_prepare_instructions_and_sft_mix(spark):
    raw = spark.createDataFrame([(i, f"question {i}", None if i == 3 else f"これは{i}番目の答えです。よろしくお願いします。", "jpn" if i % 2 else "eng") for i in range(12)], "id bigint, q string, a string, code string")
    rows, counts = recipes.prepare_instructions(raw, "q", "a", F.col("code") == "jpn", 4)
    assert rows.count() == 4 and counts.first().asDict() == {"input_count": 12, "kept_count": 6, "skipped": 1, "output_count": 4}
    whole, _ = recipes.prepare_instructions(raw, "q", "a")
    mixed, stats = recipes.prepare_sft_mix({"one": whole, "two": rows}, {"one": 5}, {"char_count": 3, "polite_form": 2})
    assert {r["origin"]: r["count"] for r in stats["origins"].collect()} == {"one": 5, "two": 4, "format": 5}
    assert {r["verifier"]: r["count"] for r in stats["formats"].collect()} == {"char_count": 3, "polite_form": 2} and stats["lengths"].first()["min"] > 0
    with pytest.raises(ValueError):
        recipes.prepare_sft_mix({}, {}, {})


def detail(spark, rows):
    return spark.createDataFrame(rows, "pos bigint, category string, d string, topic string, prompt string, response string").withColumn("detail", F.from_json("d", V.DETAIL)).drop("d")


EVALS = "prompt string, kwargs struct<char_count:struct<min:int,max:int>>"


def test_build_prompt_pool(spark):
    selected = detail(spark, [(i, "char_count", '{"max": %d}' % (50 if i == 2 else 90 + i), f"topic{i}", f"prompt {i}", "r") for i in range(5)]).withColumn("instruction_id_list", F.col("category"))
    evals = spark.createDataFrame([("about something else", ((None, 50),))], EVALS)
    pool, counts = recipes.build_prompt_pool(selected, evals)
    got = pool.collect()
    ids = sorted(r["id"] for r in got)
    assert len(set(ids)) == len(ids) and sum(r["source"] == "a" for r in got) == 4 and {r["topic"] for r in got if r["source"] == "b"} == {f"topic{i}" for i in range(5)}
    assert sum(r["count"] for r in counts.collect()) == len(got)


def test_prepare_distill_mix(spark):
    answer = lambda i: f"答え{i}番の文章はこのように書かれていて十分に長いものですが、それでも短い。"
    rows = detail(spark, [(i, "char_count", '{"max": 50}', f"topic{i}", f"p{i}", answer(i)) for i in range(4)] + [(9, "char_count", '{"max": 5}', "t", "p", answer(9))])
    evals = spark.createDataFrame([("about something else", ((None, 40),))], EVALS)
    base = spark.createDataFrame([(1, "q", "a")], "id bigint, q string, a string").select("id", T.messages("q", "a").alias("messages"))
    mixed, stats = recipes.prepare_distill_mix(rows, evals, base, base_mean=float(len(answer(1))))
    assert sorted(r["id"] for r in mixed.collect()) == ["base/1", "distill/0", "distill/1", "distill/2", "distill/3"]
    assert sum(r["count"] for r in stats["rejects"].collect()) == 1
    with pytest.raises(ValueError):
        recipes.prepare_distill_mix(rows, evals, base, base_mean=1000.0)


def test_configs_and_digests(tmp_path):
    import hashlib

    path = tmp_path / "c.yaml"
    path.write_text("a:\n  b: 1\n")
    assert readers.load_config(str(path)) == {"a": {"b": 1}} and readers.file_md5(str(path)) == hashlib.md5(path.read_bytes()).hexdigest()
    path.write_text("- 1\n")
    with pytest.raises(ValueError):
        readers.load_config(str(path))
    with pytest.raises(FileNotFoundError):
        readers.load_config(str(tmp_path / "none"))


def test_filters_limits_and_failures_are_named(spark):
    text = "This is one of many plain English sentences about an Island and nothing else, told at length. "
    web = spark.createDataFrame([(i, text + " ".join(f"word{i}x{j}" for j in range(40)), "") for i in range(6)], "id bigint, text string, title string")
    config = {"corpora": [{"name": "a"}, {"name": "b", "sample_limit": 2}], "mix": {"ratios": {"en": 1.0}}}
    mixture, _ = recipes.prepare_data({"a": web, "b": web}, config, sample_limit={"a": 3})
    assert sorted(r["corpus"] for r in mixture.collect()) == ["a"] * 3 + ["b"] * 2
    with pytest.raises(RuntimeError, match="corpus b, filter: unknown filter: magic"):
        recipes.prepare_data({"a": web, "b": web}, {"corpora": [{"name": "a"}, {"name": "b", "filter": {"type": "magic"}}]})
    with pytest.raises(RuntimeError, match="corpus b, load"):
        recipes.prepare_data({"a": web, "b": web.drop("text")}, config)
    with pytest.raises(ValueError, match="sample limit"):
        recipes.prepare_data({"a": web, "b": web}, config, streaming=True, sample_limit={"b": 3})
