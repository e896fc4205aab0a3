"""What Python gets at a time is bounded by bytes, whatever the rows are."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessella.functions import batches
from tessella.operators import chat


@pytest.fixture
def plain(spark):
    spark.conf.unset(batches.OPTION)  # as a session begins
    yield spark
    spark.conf.unset(batches.OPTION)


def largest(df):
    """Bytes of the largest batch that a function in Python gets from df."""

    def size(them):
        for b in them:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    return df.mapInArrow(size, "n bigint").agg(F.max("n")).first()[0]


def long_rows(spark, **columns):
    return spark.range(0, 3000, 1, 1).withColumns(columns)


def test_tokens_are_shown_in_bounded_batches(plain):
    ids = F.array_repeat(F.lit(97), 2000)
    df = long_rows(plain, input_ids=ids, labels=ids)
    assert largest(df) > 10 * batches.MOST_BYTES
    shown = chat.decode_for_inspection(df, lambda x: "".join(map(chr, x)))
    assert largest(df) < 2 * batches.MOST_BYTES
    assert shown.filter(F.col("shown") == "a" * 2000).count() == 0
    assert shown.filter(F.col("shown") == ("a" * 2000).join(chat.LEARNED)).count() == 3000


def test_runs_of_learned_tokens(spark):
    rows = [(0, [97, 98, 99], [-100, 98, -100]), (1, [97], [97]), (2, [], []), (3, None, None), (4, [97, 98], [-100, -100])]
    df = spark.createDataFrame(rows, "i int, input_ids array<int>, labels array<int>")
    got = [r["shown"] for r in chat.decode_for_inspection(df, lambda x: "".join(map(chr, x))).orderBy("i").collect()]
    a, b = chat.LEARNED
    assert got == [f"a{a}b{b}c", f"{a}a{b}", "", "", "ab"]


def test_chats_are_encoded_in_bounded_batches(plain):
    messages = F.array(F.struct(F.lit("user").alias("role"), F.repeat(F.lit("q"), 3000).alias("content")), F.struct(F.lit("assistant").alias("role"), F.repeat(F.lit("a"), 3000).alias("content")))
    df = long_rows(plain, messages=messages)
    assert largest(df) > 10 * batches.MOST_BYTES
    out = chat.sft_example(df, None, 1 << 30, spans=lambda s: ([ord(c) for c in s], range(len(s))))
    assert largest(df) < 2 * batches.MOST_BYTES
    assert out.filter(F.size(F.filter("labels", lambda x: x != chat.IGNORED)) == 3000).count() == 3000


def test_verification_has_one_worker_a_task(spark):
    """Checks in Python stand in one node of the plan, as each node has a worker of its own."""
    from tessella.operators import prefs
    from tessella.plans import registry

    p = spark.createDataFrame([("p", "keyword")], "id string, category string").withColumn("constraint_detail", registry._detail(include=F.array(F.lit("a")), min=F.lit(1)))
    g = spark.createDataFrame([("p", 0, "a" * 30), ("p", 1, "a" * 30), ("p", 2, None), ("p", 3, "日本a")], "prompt_id string, k int, response string")
    v = prefs.verify(g, p)
    assert v._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") <= 2
    got = {r["k"]: (r["rule_pass"], r["degenerate_reason"]) for r in v.collect()}
    assert got == {0: (True, "repetition"), 1: (True, "repetition"), 2: (False, "empty"), 3: (True, "too_short")}


def test_lists_that_python_gets_are_not_null(spark):
    """A null list in a batch bounded by bytes makes Spark fill in all rows since the last list, at each row."""
    from tessella.functions import verifiers as V
    from tessella.plans import registry

    rows = spark.range(0, 4).select(F.lit("char_count").alias("c"), F.lit("a" * 30).alias("t"), registry._detail(max=F.lit(9)).alias("d"))
    d, seen = F.col("d"), []
    plans = [V.dispatch(F.col("c"), F.col("t"), d), V.keyword(F.col("t"), registry._detail(include=F.array(F.lit("a")))), V.format_json_detail(F.col("t"), d)]
    for plan in plans:
        node = rows.select(plan.alias("v"))._jdf.queryExecution().optimizedPlan()
        while "ArrowEvalPython" not in node.nodeName():
            node = node.children().head()
        for i in range(node.udfs().size()):
            args = node.udfs().apply(i).children()
            for k in range(args.size()):
                if args.apply(k).dataType().typeName() == "array":
                    seen.append(args.apply(k).nullable())
    assert seen and not any(seen)


def test_normalised_once_as_each_check_does(spark):
    from tessella.functions import verifiers as V
    from tessella.plans import registry

    texts = ["ＡＢＣ です。", "カﾞメラ", "abc", "", None, "・一\n・二", "ﾃﾞｽ"]
    words = [None, ["ABC"], ["Ａ"], ["ガ", "x"]]
    rows = [(c, t, i, e) for c in V.NORMALISED for t in texts for i in words[1:] for e in words[:2]]
    df = spark.createDataFrame(rows, "c string, t string, i array<string>, e array<string>")
    d = registry._detail(include=F.col("i"), exclude=F.col("e"), max=F.lit(5), style=F.lit("polite"))
    alone = F.lit(None)
    for name in V.NORMALISED:
        alone = F.when(F.col("c") == name, V.CATEGORIES[name](F.col("t"), d)).otherwise(alone)
    got = df.select("c", "t", "i", "e", V.dispatch(F.col("c"), F.col("t"), d).alias("a"), alone.alias("b")).collect()
    assert [r for r in got if r["a"] != r["b"]] == []
    assert {r["a"]["ok"] for r in got if r["c"] == "keyword"} == {True, False}
