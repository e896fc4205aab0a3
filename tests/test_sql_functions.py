"""Verifiers by their names in SQL give what their columns give."""

import json

import pytest
from pyspark.sql import functions as F

from tessella.functions import sql
from tessella.functions import verifiers as V

TEXTS = ["", "です。", "これは本です。", "本だ。終わり。", "- a\n- b\n1. c", '{"k": [{"a": 1}, {"a": 2}]}', "```json\n[1]\n```", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", " 12kg ", "+3.5", "one\n\ntwo\n \nthree", "The = end(1)", "it's 'quoted' \\ and=(x)", "x" * 100, None]
DETAILS = [{}, {"min": 2, "max": 50}, {"max": 5}, {"count": 3}, {"count": 2, "keys": ["a"]}, {"style": "polite"}, {"style": "plain"}, {"include": ["本"]}, {"include": ["a"], "exclude": ["b"]}, {"start": "The"}, {"min_rows": 2}, {"allow_units": True}]


@pytest.fixture(scope="module")
def cases(spark):
    rows = [(i, j, t, json.dumps(d)) for i, t in enumerate(TEXTS) for j, d in enumerate(DETAILS)]
    return spark.createDataFrame(rows, "i int, j int, t string, j_ string").withColumn("d", F.from_json("j_", V.DETAIL))


#: Which details have what a verifier needs.
NEEDS = {"char_count": "d.min is not null or d.max is not null", "compound": "d.min is not null or d.max is not null", "bullet_count": "coalesce(d.count, d.min, d.max) is not null", "polite_form": "d.style is not null", "keyword": "size(d.include) > 0", "paragraph_count": "d.count is not null", "start_word": "d.start is not null"}


def test_sql_functions_equal_columns(spark, cases):
    names = sql.register(spark)
    checks = {**V.CATEGORIES, **V.VERIFIERS, "format_json_detail": V.format_json_detail}
    assert names == sorted(f"verify_{n}" for n in checks)
    cases.createOrReplaceTempView("cases")
    for name, check in checks.items():
        where = NEEDS.get(name, "true")
        want = {(r["i"], r["j"]): r["x"] for r in cases.filter(where).select("i", "j", check(F.col("t"), F.col("d")).alias("x")).collect()}
        got = {(r["i"], r["j"]): r["x"] for r in spark.sql(f"SELECT i, j, verify_{name}(t, d) AS x FROM cases WHERE {where}").collect()}
        assert got == want, name
        assert name == "keyword" or len({r["ok"] for r in want.values()}) == 2, name


def test_a_missing_parameter_fails_and_views_work(spark, cases):
    sql.register(spark)
    with pytest.raises(Exception, match="start_word needs start"):
        spark.sql("SELECT verify_start_word('x', constraint_detail('{}')).ok").collect()
    spark.sql("SELECT t, verify_no_constraint(t, constraint_detail('{}')).ok AS ok FROM cases").createOrReplaceTempView("judged")
    assert spark.sql("SELECT count(*) AS n FROM judged WHERE ok").first()["n"] == cases.filter(F.length(F.trim("t")).between(20, 300)).count()
