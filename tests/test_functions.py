"""Text functions and verifiers on Japanese and edge cases."""

import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.functions import verifiers as V


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def detail(**kw):
    kinds = dict(x.split(" ", 1) for x in V.DETAIL.split(", "))
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    return F.struct(*(lit(kw.get(k)).cast(t).alias(k) for k, t in kinds.items()))


def verdicts(spark, check, values, **kw):
    return [y["ok"] for y in column(spark, values, lambda c: check(c, detail(**kw)))]


def test_nfkc_and_control_characters(spark):
    assert column(spark, ["ＡＢＣ１２３", "ﾃｽﾄ", "plain", None, "㍿"], T.nfkc) == ["ABC123", "テスト", "plain", None, "株式会社"]
    assert column(spark, ["a\x00b\x1fc", "a\nb\tc", "x\r\x85y", "pq\U000f0000", "😀"], T.remove_control_chars) == ["abc", "a\nb\tc", "xy", "pq", "😀"]


def test_language(spark):
    assert column(spark, ["これは日本語です", "This is English", "日本 ab", "123 !?", "", "한국어"], T.detect_language) == ["ja", "en", "ja", "other", "other", "other"]


def test_char_ngrams(spark):
    assert [sorted(x) for x in column(spark, ["abcab", "ab", "", "aaaa"], lambda c: T.char_ngrams(c, 3))] == [["abc", "bca", "cab"], ["ab"], [], ["aaa"]]


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb\r\n", "\n", "", "a\x0bb\x0cc\x1cd e\x85f", "a\n\nb", "x\n\n"])
def test_lines_as_python(spark, text):
    assert column(spark, [text], T.lines) == [text.splitlines()]


def test_strip_takes_all_white_space(spark):
    assert column(spark, ["　 a b　\n", " x\xa0"], T.strip) == ["a b", "x"]


def test_bullets_and_nouns(spark):
    assert column(spark, ["- a\n・b\n* c\n 1. d\ntext", "none"], T.count_bullets) == [4, 0]
    assert column(spark, ["東京でカメラとカメラ", "京都と東京都と京都と東京都", "漢字とアア", "ひらがな"], T.keyword_noun) == ["カメラ", "東京都", "アア", None]


def test_preambles(spark):
    given = ["はい、承知しました。\n本文です。", "承知いたしました！以下の通り、\n回答：42", "```json\n{}\n```", "本文だけ。", "かしこまりました。\nお答えします。\nはい"]
    assert column(spark, given, T.strip_preamble) == ["本文です。", "42", "{}", "本文だけ。", "はい"]


def test_answers(spark):
    assert column(spark, ["東京です。質問: 次", "A: x", " 大阪\n\n次", None, "京 都 。続き"], T.answer_segment) == ["東京です。", "", "大阪", "", "京 都 。"]
    pattern = "(?s).*(yes|no|unknown|undef)"
    assert column(spark, ["yes\nthen no", "unknown", "maybe"], lambda c: T.custom_answer(c, pattern)) == ["no", "no", ""]
    assert column(spark, ["x\nyes", "no: 7", "none"], lambda c: T.custom_answer(c, ".*(yes)|no: ([0-9])")) == ["yes", "7", ""]
    assert column(spark, ["a" * 300_000], lambda c: T.custom_answer(c, pattern)) == [""]  # linear in the text


def test_judgements(spark):
    given = ['x {"score": 4, "reason": "r"} y', '{"score": "4"}', '{"score": 4.0}', '{"score": true}', '{"score": 6}', "[1]", "none", '{"score": 3}']
    assert [y["score"] for y in column(spark, given, T.parse_judge_output)] == [4, None, None, None, None, None, None, 3]


def test_split_bucket(spark):
    import hashlib

    ids = [f"jkb-{i}" for i in range(200)]
    assert column(spark, ids, T.split_bucket) == [int(hashlib.sha1(i.encode()).hexdigest(), 16) % 5 for i in ids]


def test_verifiers(spark):
    assert verdicts(spark, V.char_count, ["あいう", "ＡＢＣＤ", ""], min=1, max=3) == [True, False, False]
    assert verdicts(spark, V.bullet_count, ["- a\n- b", "- a"], count=2) == [True, False]
    polite = ["本日は晴れです。明日も晴れでしょう。", "本日は晴れだ。", "件名: 会議\n田中様\nよろしくお願いします！", "件名: 会議", ""]
    assert verdicts(spark, V.polite_form, polite, style="polite") == [True, False, True, False, False]
    assert verdicts(spark, V.polite_form, polite, style="plain") == [False, True, False, True, False]
    assert verdicts(spark, V.keyword, ["ＡＩと桜", "AI", "桜と梅"], include=["AI"], exclude=["梅"]) == [True, True, False]
    assert verdicts(spark, V.format_json, ['{"a": 1}', '```json\n[1]\n```', '{"a": 1} x', '{"a": NaN}', "{'a': 1}"]) == [True, True, False, True, False]
    assert verdicts(spark, V.format_json_detail, ['[{"k": 1}, {"k": 2}]', '{"x": [{"k": 1}, {"k": 2}]}', '[{"k": 1}]', '[{"z": 1}, {"k": 2}]'], count=2, keys=["k"]) == [True, True, False, False]
    table = "| a | b |\n| --- | :-: |\n| 1 | 2 |\n| 3 | 4 |\n"
    assert verdicts(spark, V.format_markdown_table, [table, "x\n" + table + "\n| z |", "| a |\n| --- |\n| 1 |", "no"], min_rows=2) == [True, True, False, False]
    assert verdicts(spark, V.numeric_only, ["42", " -3.5\n", "４２", "42kg", ""]) == [True, True, False, False, False]
    assert verdicts(spark, V.paragraph_count, ["a\n\nb", "a\n \n\nb\n\n", "a"], count=2) == [True, True, False]
    assert verdicts(spark, V.start_word, ["　はい、", "いいえ"], start="はい") == [True, False]
    assert verdicts(spark, V.no_constraint, ["x" * 19, "x" * 20, "x" * 300, "x" * 301]) == [False, True, True, False]


def test_missing_parameters_fail_the_query(spark):
    with pytest.raises(Exception, match="needs"):
        verdicts(spark, V.char_count, ["x"])


@pytest.mark.parametrize(("n", "ok"), [(59, False), (60, True), (90, True), (91, False)])
def test_tight_margin(spark, n, ok):
    assert column(spark, ["あ" * n], lambda c: V.tight_margin(c, detail(max=100))) == [ok]


def test_dispatch(spark):
    assert column(spark, ["x" * 30], lambda c: V.dispatch(F.lit("nobody"), c, detail()))[0]["ok"] is False
    assert column(spark, ["x" * 70], lambda c: V.select(F.lit("char_count"), c, detail(max=100), [100]))[0]["ok"] is False
    assert column(spark, ["x" * 70, "x" * 95], lambda c: V.select(F.lit("char_count"), c, detail(max=100), [80])) == [(True, ""), (False, "outside the band")]


def test_ascii_texts_need_no_python_and_classes_are_counted_by_runs(spark):
    values = ["a1 b", "日本 ab", "", "１２ｱ", None]
    assert column(spark, values, T.is_ascii) == [True, False, True, False, None]
    assert column(spark, values, lambda c: T.count_in(c, T.LATIN)) == [2, 2, 0, 0, None]
    assert column(spark, values, lambda c: T.count_in(c, T.JAPANESE)) == [0, 2, 0, 0, None]
    assert column(spark, values, T.nfkc) == ["a1 b", "日本 ab", "", "12ア", None]


def test_scripts_are_counted_once_over_bytes(spark):
    """One call gives both counts, whatever the language's rule asks for, and they are those of the character classes."""
    edges = "".join(map(chr, (0x303F, 0x3040, 0x309F, 0x30A0, 0x30FF, 0x3100, 0x4DFF, 0x4E00, 0x4FFF, 0x5000, 0x9FFF, 0xA000, 0x1F600, 0xE9, 0x40, 0x5B, 0x60, 0x7B)))
    values = [edges, edges * 3 + "AZaz", "日本のかなabc", "", None, "abc DEF", "é한국어𠀋", "日" * 700_000]
    counts = [None if v is None else (sum(0x3040 <= ord(x) <= 0x30FF or 0x4E00 <= ord(x) <= 0x9FFF for x in v), sum(x.isascii() and x.isalpha() for x in v)) for v in values]
    assert [None if r is None else tuple(r) for r in column(spark, values, T.script_counts)] == counts
    assert column(spark, values, T.detect_language) == ["ja", "ja", "ja", "other", "other", "en", "other", "ja"]
    plan = spark.range(1).select(T.detect_language(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_replace" not in plan
