"""All registered queries of the engine with their oracle SQL.

A query is named by the operators that it shows. Tables play the parts of the
pipeline's data sets: documents as corpora, conversations as chats, orders and lineitem as
prompts and generations, events as scored items.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import permute, sql
from ..functions import text as T
from ..functions import verifiers as V
from ..operators import chat, clean, order, prefs, prompts, quantiles, recipes, scoring, storage
from ..sources import csv_split, shards
from ..sources.ledger import Ledger

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def add(sql: str | None = None):
    def put(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def big(c):
    return c.cast("bigint")


# --- functions -----------------------------------------------------------------


@add("SELECT doc_id, md5(text || 'ガ12') AS digest FROM documents")
def n1_nfkc(spark, sf):
    """Texts in full-width letters and digits come back as they were."""
    plain = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    wide = F.translate("text", plain, "".join(chr(ord(x) + 0xFEE0) for x in plain))
    return t(spark, sf, "documents").select("doc_id", F.md5(T.nfkc(F.concat(wide, F.lit("ｶﾞ１②"))).cast("binary")).alias("digest"))


@add(r"SELECT doc_id, md5(regexp_replace(text || chr(7) || chr(9) || chr(57344) || chr(133) || 'x', '[\x00-\x08\x0B-\x1F\x7F-\x9F\x{E000}-\x{F8FF}]', '', 'g')) AS digest FROM documents")
def n2_remove_control_chars(spark, sf):
    c = F.concat(F.col("text"), F.lit("\x07\t\x85x"))
    return t(spark, sf, "documents").select("doc_id", F.md5(T.remove_control_chars(c).cast("binary")).alias("digest"))


@add(r"""WITH d AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN repeat('日本のかな', n_chars::INT) ELSE '' END AS x FROM documents),
 c AS (SELECT doc_id, length(regexp_replace(x, '[^\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]', '', 'g')) AS ja, length(regexp_replace(x, '[^A-Za-z]', '', 'g')) AS en FROM d)
 SELECT doc_id, CASE WHEN ja + en = 0 THEN 'other' WHEN ja / (ja + en) >= 0.5 THEN 'ja' WHEN en / (ja + en) >= 0.5 THEN 'en' ELSE 'other' END AS language FROM c""")
def n3_detect_language(spark, sf):
    c = F.concat("text", F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("日本のかな"), F.col("n_chars").cast("int"))).otherwise(""))
    return t(spark, sf, "documents").select("doc_id", T.detect_language(c).alias("language"))


@add("SELECT item_id, (SELECT count(DISTINCT substr(text, i::INT, 5)) FROM range(1, greatest(length(text) - 4, 1) + 1) r(i)) AS n_grams FROM benchmark")
def n4_char_ngrams(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", big(F.size(T.char_ngrams("text", 5))).alias("n_grams"))


@add(r"SELECT doc_id, CAST(len(list_filter(string_split(text || chr(10) || '- a' || chr(10) || ' 1. b', chr(10)), lambda x: regexp_matches(x, '^(\s*[-・*]|\s*[0-9]+\.)'))) AS BIGINT) AS bullets FROM documents")
def n6_count_bullets(spark, sf):
    return t(spark, sf, "documents").select("doc_id", big(T.count_bullets(F.concat("text", F.lit("\n- a\n 1. b")))).alias("bullets"))


@add(r"""WITH x AS (SELECT o_orderkey, repeat('カメラと', CAST(o_orderkey % 4 AS INT)) || repeat('京都の', CAST(o_custkey % 4 AS INT)) || repeat('東京都と', CAST(o_custkey % 3 AS INT)) || CASE WHEN o_orderkey % 5 = 0 THEN 'アア' ELSE 'ひらがな' END AS x FROM orders),
 runs AS (SELECT o_orderkey, regexp_extract_all(x, '[ァ-ヴー]{2,}') || regexp_extract_all(x, '[\x{4E00}-\x{9FFF}]{2,4}') AS runs FROM x), r AS (SELECT o_orderkey, unnest(runs) AS r, unnest(range(len(runs))) AS i FROM runs),
 n AS (SELECT o_orderkey, r, count(*) AS n, min(i) AS first FROM r GROUP BY 1, 2)
 SELECT o_orderkey, arg_min(r, (-n, -length(r), first)) AS noun FROM x LEFT JOIN n USING (o_orderkey) GROUP BY 1""")
def n7_keyword_noun(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    x = F.concat(*(F.repeat(F.lit(w), n.cast("int")) for w, n in (("カメラと", k % 4), ("京都の", c % 4), ("東京都と", c % 3))), F.when(k % 5 == 0, "アア").otherwise("ひらがな"))
    return t(spark, sf, "orders").select("o_orderkey", T.keyword_noun(x).alias("noun"))


@add(r"SELECT doc_id, md5(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def n8_strip_preamble(spark, sf):
    """Texts behind none, one or two preambles, half of them in a fence, come back bare."""
    k = F.col("doc_id")
    body = F.when(k % 2 == 0, F.concat(F.lit("```json\n"), "text", F.lit("\n```\n"))).otherwise(F.col("text"))
    c = F.concat(F.when(k % 3 > 0, "はい、承知しました。\n").otherwise(""), F.when(k % 3 > 1, "以下のとおり、\n回答：").otherwise(""), body)
    return t(spark, sf, "documents").select("doc_id", F.md5(T.strip_preamble(c).cast("binary")).alias("digest"))


@add(r"""SELECT doc_id, CAST(len(list_filter(list_transform(regexp_split_to_array(text, '[。!?！？]|\n'), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '' AND NOT regexp_matches(x, '^(\s*[-・*]|\s*[0-9]+\.)'))) AS BIGINT) AS n FROM documents""")
def n9_split_sentences(spark, sf):
    return t(spark, sf, "documents").select("doc_id", big(F.size(T.split_sentences("text"))).alias("n"))


@add(r"SELECT doc_id, CAST(len(list_filter(string_split(replace(text, ',', ':' || chr(10)), chr(10)), lambda x: regexp_matches(left(x, 15), '[：:]'))) AS BIGINT) AS labels FROM documents")
def n10_label_lines(spark, sf):
    """Label lines of each text; every comma ends one."""
    lines = F.split(F.replace("text", F.lit(","), F.lit(":\n")), "\n")
    return t(spark, sf, "documents").select("doc_id", big(F.size(F.filter(lines, T.is_label_line))).alias("labels"))


@add(r"""WITH x AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN replace(text, '. ', '。') WHEN 1 THEN replace(text, ' and ', ' A: ') ELSE replace(text, ' to ', chr(10) || ' ' || chr(10)) END || '質問：x' AS x FROM documents)
 SELECT doc_id, md5(trim(regexp_replace(regexp_extract(regexp_split_to_array(x, 'Question:|質問[:：]|\b[A-E]:|\n\s*\n')[1], '^([^。]*。?)', 1), '\s+', ' ', 'g'))) AS digest FROM x""")
def n11_answer_segment(spark, sf):
    k = F.col("doc_id")
    put = lambda a, b: F.replace("text", F.lit(a), F.lit(b))
    c = F.concat(F.when(k % 3 == 0, put(". ", "。")).when(k % 3 == 1, put(" and ", " A: ")).otherwise(put(" to ", "\n \n")), F.lit("質問：x"))
    return t(spark, sf, "documents").select("doc_id", F.md5(T.answer_segment(c).cast("binary")).alias("digest"))


@add("SELECT doc_id, regexp_extract(text, '(?s).*(the|and|of|der|les)', 1) AS got FROM documents")
def n12_custom_answer(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.custom_answer("text", "(?s).*(the|and|of|der|les)").alias("got"))


@add("""WITH x AS (SELECT o_orderkey, CAST(o_custkey % 8 AS INT) AS s, o_orderkey % 5 AS kind FROM orders)
 SELECT o_orderkey, CASE WHEN kind < 3 AND s BETWEEN 1 AND 5 THEN s END AS score, CASE WHEN kind < 3 AND s BETWEEN 1 AND 5 THEN CASE kind WHEN 2 THEN '' ELSE 'r' || o_orderkey END END AS reason FROM x""")
def n13_parse_judge(spark, sf):
    """Scores 0 to 7 in a reply, as text, behind a broken bracket or without a reason."""
    k, s, kind = F.col("o_orderkey").cast("string"), (F.col("o_custkey") % 8).cast("string"), F.col("o_orderkey") % 5
    whole = F.concat(F.lit('{"score": '), s, F.lit(', "reason": "r'), k, F.lit('"}'))
    c = F.when(kind == 0, F.concat(F.lit("ok "), whole, F.lit(" end"))).when(kind == 1, whole).when(kind == 2, F.concat(F.lit('{"score": '), s, F.lit("}"))).when(kind == 3, F.concat(F.lit('{"score": "'), s, F.lit('"}'))).otherwise(F.concat(F.lit("{"), whole))
    return t(spark, sf, "orders").select("o_orderkey", T.parse_judge_output(c).alias("j")).select("o_orderkey", "j.score", "j.reason")


@add("SELECT doc_id, CAST((SELECT sum(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), i::INT, 1))::INT) FROM range(1, 41) r(i)) % 5 AS INT) AS bucket FROM documents")
def n17_split_bucket(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.split_bucket(F.col("doc_id").cast("string")).cast("int").alias("bucket"))


@add("SELECT p_partkey, p_name || chr(10) || 'A: ' || p_brand || chr(10) || 'B: ' || p_type AS question FROM part")
def n18_question(spark, sf):
    ch = F.array(*(F.struct(F.lit(x).alias("label"), F.col(c).alias("text")) for x, c in (("A", "p_brand"), ("B", "p_type"))))
    return t(spark, sf, "part").select("p_partkey", T.question(F.col("p_name"), ch).alias("question"))


@add("SELECT p_partkey, p_brand AS best FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE '' END FROM part WHERE p_size % 2 = 1")
def n16_best_answer(spark, sf):
    answers = F.when(F.col("p_size") % 2 == 0, F.array("p_brand"))
    choices = F.array(F.struct(F.lit("C").alias("label"), F.col("p_type").alias("text")))
    return t(spark, sf, "part").select("p_partkey", T.best_answer(answers, choices, F.when(F.col("p_size") % 3 == 0, "C").otherwise("D")).alias("best"))


@add("SELECT doc_id, substr(sha256(CAST(n_chars AS VARCHAR)), 1, 16) AS h FROM documents")
def n19_hash_prefix(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.substring(F.sha2(F.col("n_chars").cast("string"), 256), 1, 16).alias("h"))


# --- filters -------------------------------------------------------------------


@add("SELECT doc_id, n_chars FROM documents WHERE length(text) BETWEEN 50 AND 50000")
def f1_length_filter(spark, sf):
    return t(spark, sf, "documents").filter(F.length("text").between(50, 50_000)).select("doc_id", "n_chars")


@add("""SELECT doc_id, list_sort(list_filter(['en', 'license', 'spam'], lambda g: CASE g WHEN 'en' THEN contains(text, ' the ') WHEN 'license' THEN contains(text, 'License') OR contains(text, 'licensed') ELSE contains(text, 'casino') END)) AS cells FROM documents
 WHERE contains(text, ' the ') OR contains(text, 'License') OR contains(text, 'licensed') OR contains(text, 'casino')""")
def f6_keyword_groups(spark, sf):
    d = t(spark, sf, "documents").select("doc_id", T.matched_groups({"en": [" the "], "license": ["License", "licensed"], "spam": ["casino"]}, "text").alias("cells"))
    return d.filter(F.size("cells") > 0)


@add("SELECT doc_id FROM documents WHERE NOT (contains(text, 'http') OR contains(text, '@') OR contains(text, 'License'))")
def f7_banned_substrings(spark, sf):
    return t(spark, sf, "documents").filter(~T.contains_any("text", ("http", "@", "License"))).select("doc_id")


@add("""SELECT item_id, CASE WHEN length(trim(text)) < 20 THEN 'too_short'
  WHEN EXISTS (SELECT 1 FROM (SELECT l, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS l) WHERE trim(l) <> '' GROUP BY l) WHERE n >= 3)
    OR EXISTS (SELECT 1 FROM (SELECT substr(text, i::INT, 10) AS g, count(*) AS n FROM range(1, greatest(length(text) - 9, 0) + 1) r(i) GROUP BY g) WHERE n >= 4) THEN 'repetition' END AS reason FROM benchmark""")
def f9_f10_f11_degenerate(spark, sf):
    return t(spark, sf, "benchmark").select("item_id", prefs.degenerate_reason("text").alias("reason"))


@add("SELECT doc_id, lang, source FROM documents WHERE lang = 'de' OR source = 'src1'")
def f4_language_subset(spark, sf):
    return t(spark, sf, "documents").filter(F.col("lang").eqNullSafe("de") | F.col("source").eqNullSafe("src1")).select("doc_id", "lang", "source")


# --- verifiers -----------------------------------------------------------------


def _detail(**kw):
    kinds = dict(x.split(" ", 1) for x in V.DETAIL.split(", "))
    return F.struct(*(kw[k].cast(v).alias(k) if k in kw else F.lit(None).cast(v).alias(k) for k, v in kinds.items()))


@add("SELECT doc_id, n_chars BETWEEN 500 AND 3000 AS ok FROM documents")
def v1_char_count(spark, sf):
    return t(spark, sf, "documents").select("doc_id", V.char_count(F.col("text"), _detail(min=F.lit(500), max=F.lit(3000)))["ok"].alias("ok"))


@add(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^(\s*[-・*]|\s*[0-9]+\.)'))) = doc_id % 2 AS ok FROM documents")
def v2_bullet_count(spark, sf):
    return t(spark, sf, "documents").select("doc_id", V.bullet_count(F.col("text"), _detail(count=F.col("doc_id") % 2))["ok"].alias("ok"))


@add("""WITH x AS (SELECT o_orderkey, o_orderkey % 3 AS a, o_custkey % 3 AS b FROM orders) SELECT o_orderkey, a > 0 AND b = 0 AS polite, b > 0 AND a = 0 AS plain FROM x""")
def v3_polite_form(spark, sf):
    """Texts of none to two polite and plain sentences below a list item and a letter's opening."""
    said = lambda w, n: F.repeat(F.lit(w), (F.col(n) % 3).cast("int"))
    c = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "- 項目\n").otherwise(""), said("本日は晴れです。", "o_orderkey"), said("明日は雨だ。", "o_custkey"))
    return t(spark, sf, "orders").select("o_orderkey", *(V.polite_form(c, _detail(style=F.lit(s)))["ok"].alias(s) for s in ("polite", "plain")))


@add("SELECT doc_id, contains(text, 'the') AND NOT contains(text, 'License') AS ok FROM documents")
def v4_keyword(spark, sf):
    return t(spark, sf, "documents").select("doc_id", V.keyword(F.col("text"), _detail(include=F.array(F.lit("the")), exclude=F.array(F.lit("License"))))["ok"].alias("ok"))


@add("""WITH x AS (SELECT event_id, '[' || array_to_string(list_transform(range(0, user_id % 4), lambda i: '{"' || CASE WHEN event_id % 7 < 5 THEN 'k' ELSE 'q' END || '": ' || i || '}'), ', ') || CASE WHEN event_id % 5 = 0 THEN '' ELSE ']' END AS x FROM events)
 SELECT event_id, json_valid(x) AS ok, CASE WHEN json_valid(x) THEN json_array_length(x) = 2 AND len(json_extract(x, '$[*].k')) = 2 ELSE false END AS items FROM x""")
def v5_v11_format_json(spark, sf):
    """Lists of none to three objects, some without the key, some unclosed, half of them in a fence."""
    k = F.col("event_id")
    one = lambda i: F.concat(F.lit('{"'), F.when(k % 7 < 5, "k").otherwise("q"), F.lit('": '), i.cast("string"), F.lit("}"))
    x = F.concat(F.lit("["), F.array_join(F.transform(F.slice(F.array(*map(F.lit, range(4))), 1, (F.col("user_id") % 4).cast("int")), one), ", "), F.when(k % 5 == 0, "").otherwise("]"))
    c = F.when(k % 2 == 0, F.concat(F.lit("a\n```json\n"), x, F.lit("\n```\nb"))).otherwise(x)
    return t(spark, sf, "events").select("event_id", V.format_json(c, _detail())["ok"].alias("ok"), V.format_json_detail(c, _detail(count=F.lit(2), keys=F.array(F.lit("k"))))["ok"].alias("items"))


@add(r"""WITH x AS (SELECT event_id, 'x' || chr(10) || '| a | b |' || chr(10) || CASE WHEN user_id % 3 = 0 THEN '| b | c |' ELSE '| --- | :-: |' END || chr(10) || repeat('| 1 | 2 |' || chr(10), CAST(event_id % 5 AS INT)) || 'end' AS x FROM events)
 SELECT event_id, regexp_matches(x, '\|\n\| --- \| :-: \|\n(\|[^\n]*\|\n){2}') AS ok FROM x""")
def v6_markdown_table(spark, sf):
    c = F.concat(F.lit("x\n| a | b |\n"), F.when(F.col("user_id") % 3 == 0, "| b | c |\n").otherwise("| --- | :-: |\n"), F.repeat(F.lit("| 1 | 2 |\n"), (F.col("event_id") % 5).cast("int")), F.lit("end"))
    return t(spark, sf, "events").select("event_id", V.format_markdown_table(c, _detail(min_rows=F.lit(2)))["ok"].alias("ok"))


@add(r"SELECT l_orderkey, l_linenumber, regexp_matches(CAST(l_linenumber AS VARCHAR) || CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'kg' END, '^[+-]?[0-9]+(\.[0-9]+)?$') AS ok FROM lineitem")
def v7_numeric_only(spark, sf):
    c = F.concat(F.lit(" "), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 2 == 0, "").otherwise("kg"), F.lit("\n"))
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.numeric_only(c, _detail())["ok"].alias("ok"))


@add(r"SELECT doc_id, len(list_filter(regexp_split_to_array(text || chr(10) || chr(10) || 'end', '\n\s*\n+'), lambda x: trim(x) <> '')) = 2 AS two, starts_with(text, 'The') AS the, n_chars BETWEEN 20 AND 300 AS short FROM documents")
def v8_v9_v10_shape(spark, sf):
    c = F.col("text")
    return t(spark, sf, "documents").select("doc_id", V.paragraph_count(F.concat(c, F.lit("\n\nend")), _detail(count=F.lit(2)))["ok"].alias("two"), V.start_word(c, _detail(start=F.lit("The")))["ok"].alias("the"), V.no_constraint(c, _detail())["ok"].alias("short"))


@add("""SELECT doc_id, n_chars BETWEEN 500 AND 3000 AS length_ok, contains(text, 'the') AND NOT contains(text, 'License') AS keyword_ok, regexp_matches(trim(CAST(doc_id AS VARCHAR)), '^[0-9]+$') AS number_ok, starts_with(text, 'The') AS start_ok FROM documents""")
def u1_v12_sql_verifiers(spark, sf):
    """Verifiers called in SQL alone, from a view."""
    sql.register(spark)
    t(spark, sf, "documents").createOrReplaceTempView("verified_documents")
    return spark.sql("""SELECT doc_id, verify_char_count(text, constraint_detail('{"min": 500, "max": 3000}')).ok AS length_ok,
      verify_keyword(text, constraint_detail('{"include": ["the"], "exclude": ["License"]}')).ok AS keyword_ok,
      verify_numeric_only(concat(' ', doc_id), constraint_detail('{}')).ok AS number_ok, verify_start_word(text, constraint_detail('{"start": "The"}')).ok AS start_ok FROM verified_documents""")


# --- prompts, generations, verdicts, judgements: orders and lineitem -------------

_PROMPTS_SQL = """prompts AS (SELECT 'p' || o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'char_count' WHEN 1 THEN 'polite_form' WHEN 2 THEN 'no_constraint' ELSE 'keyword' END AS category,
  CAST(10 + o_orderkey % 7 AS INT) AS mx, CAST(4 AS INT) AS mn, 'topic ' || (o_custkey % 50) AS topic, o_orderkey AS pos FROM orders)"""
_GEN_SQL = """gens AS (SELECT 'p' || l_orderkey AS prompt_id, l_linenumber - 1 AS k, repeat('x', CAST(l_quantity AS INT)) AS response, l_orderkey * 10 + l_linenumber AS pos,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_returnflag <> 'R' END AS rule_pass, CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity < 3 END AS degenerate, CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey % 5 + 1 AS INT) END AS score FROM (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag) = 1))"""


def _prompts(spark, sf):
    k = F.col("o_orderkey")
    cat = F.element_at(F.array(*map(F.lit, ("char_count", "polite_form", "no_constraint", "keyword"))), (k % 4 + 1).cast("int"))
    p = t(spark, sf, "orders").select(F.concat(F.lit("p"), k.cast("string")).alias("id"), cat.alias("category"), (10 + k % 7).cast("int").alias("mx"), F.lit(4).alias("mn"), F.concat(F.lit("topic "), (F.col("o_custkey") % 50).cast("string")).alias("topic"), k.alias("pos"))
    return p.withColumn("constraint_detail", _detail(min=F.col("mn"), max=F.col("mx"))).withColumn("prompt", F.concat("topic", F.lit("?")))


def _generations(spark, sf):
    first = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    rows = t(spark, sf, "lineitem").withColumn("r", F.row_number().over(first)).filter("r = 1")
    return rows.select(F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("prompt_id"), (F.col("l_linenumber") - 1).alias("k"), F.repeat(F.lit("x"), F.col("l_quantity").cast("int")).alias("response"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_linenumber", "l_returnflag", "l_quantity", "l_partkey")


def _merged(spark, sf):
    g = _generations(spark, sf)
    v = g.filter(F.col("l_linenumber") % 5 != 0).select("prompt_id", "k", (F.col("l_returnflag") != "R").alias("rule_pass"), (F.col("l_quantity") < 3).alias("degenerate"), F.lit("r").alias("rule_reason"), F.lit(1).alias("pos"))
    v = v.unionByName(v.withColumns({"rule_pass": F.lit(True), "pos": F.lit(0)}))  # an earlier row, which the last replaces
    j = g.filter(F.col("l_partkey") % 3 != 0).select("prompt_id", "k", (F.col("l_partkey") % 5 + 1).cast("int").alias("score"), F.lit(0).alias("pos"))
    return prefs.merge(g.select("prompt_id", "k", "response", "pos", F.lit("").alias("prompt")), v, j)


@add(f"WITH {_GEN_SQL} SELECT prompt_id, k, coalesce(rule_pass, false) AS rule_pass, coalesce(degenerate, false) AS degenerate, score FROM gens")
def j2_d7_merge(spark, sf):
    return _merged(spark, sf).select("prompt_id", "k", "rule_pass", "degenerate", "score")


@add(f"""WITH {_PROMPTS_SQL}, {_GEN_SQL}, s AS (SELECT g.*, p.category, p.mx, p.mn, coalesce(rule_pass, false) AS rp, coalesce(degenerate, false) AS dg FROM gens g JOIN prompts p ON g.prompt_id = p.id),
 c AS (SELECT prompt_id, k, score, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC, length(response), pos) AS r FROM s WHERE rp AND NOT dg AND score IS NOT NULL AND (category <> 'polite_form' OR score >= 3)),
 x AS (SELECT prompt_id, k, score, row_number() OVER (PARTITION BY prompt_id ORDER BY score IS NULL, coalesce(-score, 0), CASE WHEN category = 'char_count' THEN greatest(length(response) - mx, 0) + greatest(mn - length(response), 0) ELSE 0 END, pos) AS r FROM s WHERE NOT rp AND NOT dg),
 n AS (SELECT prompt_id, count(*) AS n FROM gens GROUP BY 1)
 SELECT p.id AS prompt_id, CASE WHEN n.n IS NULL THEN 'no_generations' WHEN c.k IS NULL THEN 'no_chosen_candidate' WHEN x.k IS NULL THEN 'no_rejected_candidate' ELSE 'ok' END AS status, c.k AS chosen_k, c.score AS chosen_score, x.k AS rejected_k, x.score AS rejected_score
 FROM prompts p LEFT JOIN n ON n.prompt_id = p.id LEFT JOIN c ON c.prompt_id = p.id AND c.r = 1 LEFT JOIN x ON x.prompt_id = p.id AND x.r = 1""")
def w1_w2_w3_w4_o8_pairs(spark, sf):
    p = prefs.build_pairs(_merged(spark, sf), _prompts(spark, sf))
    return p.select("prompt_id", "status", "meta.chosen_k", "meta.chosen_score", "meta.rejected_k", "meta.rejected_score")


@add(f"""WITH {_PROMPTS_SQL}, {_GEN_SQL}, m AS (SELECT prompt_id FROM gens WHERE rule_pass IS NOT NULL GROUP BY 1 HAVING bool_or(rule_pass) AND bool_or(NOT rule_pass))
 SELECT g.prompt_id, g.k, p.category FROM gens g JOIN prompts p ON p.id = g.prompt_id WHERE trim(response) <> '' AND (p.category IN ('polite_form', 'no_constraint') OR g.prompt_id IN (SELECT prompt_id FROM m))""")
def j3_j4_f13_a17_judge_targets(spark, sf):
    g = _generations(spark, sf)
    v = g.filter(F.col("l_linenumber") % 5 != 0).select("prompt_id", "k", (F.col("l_returnflag") != "R").alias("rule_pass"))
    return prefs.judge_targets(g, v, _prompts(spark, sf)).select("prompt_id", "k", "category")


@add(f"WITH {_PROMPTS_SQL}, {_GEN_SQL} SELECT id AS prompt_id, CAST(k.k AS INT) AS k FROM prompts, range(0, 6) k(k) WHERE NOT EXISTS (SELECT 1 FROM gens g WHERE g.prompt_id = id AND g.k = k.k)")
def j5_j13_plan(spark, sf):
    return prefs.plan(_prompts(spark, sf), 6, _generations(spark, sf)).select("prompt_id", "k")


@add(f"""WITH {_PROMPTS_SQL}, {_GEN_SQL} SELECT prompt_id, k, CASE category WHEN 'char_count' THEN length(response) BETWEEN mn AND mx ELSE length(response) BETWEEN 20 AND 300 END AS rule_pass,
  CASE WHEN length(response) < 20 THEN 'too_short' WHEN length(response) >= 13 THEN 'repetition' ELSE '' END AS degenerate_reason FROM gens JOIN prompts ON id = prompt_id WHERE category IN ('char_count', 'no_constraint')""")
def j1_v14_v15_v16_verdicts(spark, sf):
    p = _prompts(spark, sf).filter(F.col("category").isin("char_count", "no_constraint"))
    g = _generations(spark, sf).join(p.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi")
    return prefs.verify(g, p).select("prompt_id", "k", "rule_pass", "degenerate_reason")


@add(f"WITH {_GEN_SQL} SELECT count(*) AS total, count(*) FILTER (rule_pass) AS passed, count(*) FILTER (degenerate) AS degenerate, avg(score) AS mean_score FROM gens")
def a18_a19_verdict_totals(spark, sf):
    m = _merged(spark, sf)
    return m.agg(F.count(F.lit(1)).alias("total"), F.count_if("rule_pass").alias("passed"), F.count_if("degenerate").alias("degenerate"), F.avg("score").alias("mean_score"))


@add("""SELECT DISTINCT topic FROM (SELECT n_name AS topic FROM nation) WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT p_name || ' of NATION_' || p_size AS q FROM part) WHERE contains(q, topic))""")
def j10_topic_in_prompts(spark, sf):
    topics = t(spark, sf, "nation").select(F.col("n_name").alias("topic"))
    return prefs.topics_in(topics, t(spark, sf, "part").select(F.concat("p_name", F.lit(" of NATION_"), F.col("p_size").cast("string")).alias("prompt")))


@add("SELECT o_custkey % 50 AS topic, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, min(o_orderkey) LIMIT 5")
def a11_w6_topics(spark, sf):
    return prefs.topic_stats(t(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("topic"), F.col("o_orderkey").alias("pos")))[1].select("topic", "n")


@add()
def d4_d5_d6_sequential_duplicates(spark, sf):
    """The pass over all rows; a recursive CTE takes too long there, so there is no SQL."""
    d = order.with_position(t(spark, sf, "lineitem"), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")))
    words = F.concat(F.lit("a long enough response number "), (F.col("l_quantity") % 5).cast("string"))
    d = d.select((F.col("pos") + 1).alias("pos"), (F.col("l_suppkey") % 7).cast("string").alias("prompt"), words.alias("response"), F.lit("keyword").alias("category"), (F.col("l_linenumber") % 3).cast("string").alias("constraint_detail"))
    return prefs.degenerate_filters(d).select("pos", "reject")


# --- joins -----------------------------------------------------------------------


@add(r"""WITH pool AS (SELECT DISTINCT substr(text, i::INT, 13) AS g FROM benchmark, range(1, 2000) r(i) WHERE i <= greatest(length(text) - 12, 1)),
 d AS (SELECT doc_id, text FROM documents), g AS (SELECT DISTINCT doc_id, substr(text, i::INT, 13) AS g FROM d, LATERAL (SELECT unnest(range(1, greatest(length(text) - 12, 1) + 1)) AS i) WHERE text <> '')
 SELECT d.doc_id, coalesce(x.overlap, 0.0) AS overlap FROM d LEFT JOIN (SELECT g.doc_id, count(pool.g) / count(*) AS overlap FROM g LEFT JOIN pool USING (g) GROUP BY 1) x USING (doc_id)""")
def j9_a25_f3_contamination(spark, sf):
    return clean.contamination(t(spark, sf, "documents").select("doc_id", "text"), t(spark, sf, "benchmark"), 13, "doc_id")


@add("""WITH a AS (SELECT o_custkey AS id, count(*) || '。' || max(o_orderkey) AS raw FROM orders GROUP BY 1)
 SELECT c_custkey AS id, c_mktsegment AS domain, coalesce(contains(split_part(raw, '。', 1), CAST(c_nationkey AS VARCHAR)), false) AS correct FROM customer LEFT JOIN a ON id = c_custkey""")
def j7_left_outer(spark, sf):
    """A customer's nation number is looked for in its number of orders; those without orders are wrong."""
    said = F.concat(F.count(F.lit(1)).cast("string"), F.lit("。"), F.max("o_orderkey").cast("string"))
    items = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("domain"), F.lit("d").alias("difficulty"), F.lit("short").alias("format"), F.array(F.col("c_nationkey").cast("string")).alias("answers"), F.lit(None).cast("string").alias("correct_choice"))
    return scoring.score_items(items, t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(said.alias("raw"))).select("id", "domain", "correct")


@add("""WITH a AS (SELECT source AS domain, avg(CASE WHEN n_chars > 1000 THEN 1.0 ELSE 0.0 END) AS accuracy FROM documents WHERE source <> 'src1' GROUP BY 1), b AS (SELECT source AS domain, avg(CASE WHEN n_chars > 1100 THEN 1.0 ELSE 0.0 END) AS accuracy FROM documents WHERE source <> 'src2' GROUP BY 1)
 SELECT domain, a.accuracy AS candidate, b.accuracy AS base, coalesce(a.accuracy - b.accuracy >= -0.03 - 1e-12, false) AS passed FROM a FULL OUTER JOIN b USING (domain)""")
def j12_g4_domain_gate(spark, sf):
    acc = lambda skip, least: t(spark, sf, "documents").filter(F.col("source") != skip).groupBy(F.col("source").alias("domain")).agg(F.avg((F.col("n_chars") > least).cast("double")).alias("accuracy"))
    return scoring.domain_gate(acc("src1", 1000), acc("src2", 1100)).select("domain", "candidate", "base", "passed")


# --- aggregates, ranks, statistics: events as scored items ------------------------

_SCORED_SQL = "scored AS (SELECT event_id AS id, event_type AS domain, 'd' || (user_id % 3) AS difficulty, value > 40 AS correct FROM events)"


def _scored(spark, sf):
    return t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("domain"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("difficulty"), (F.col("value") > 40).alias("correct"))


@add(f"""WITH {_SCORED_SQL} SELECT CASE WHEN grouping(domain) = 1 AND grouping(difficulty) = 1 THEN 'overall' WHEN grouping(difficulty) = 1 THEN 'by_domain' WHEN grouping(domain) = 1 THEN 'by_difficulty' ELSE 'by_cell' END AS level,
 domain, difficulty, count(*) AS n, CAST(coalesce(sum(correct::INT), 0) AS BIGINT) AS correct, avg(correct::INT) AS accuracy FROM scored GROUP BY GROUPING SETS ((), (domain), (difficulty), (domain, difficulty))""")
def a14_a15_rollup(spark, sf):
    return scoring.rollup(_scored(spark, sf)).select("level", "domain", "difficulty", "n", big(F.col("correct")).alias("correct"), "accuracy")


@add(f"WITH {_SCORED_SQL} SELECT domain, difficulty, count(*) AS n, avg(correct::INT) AS accuracy FROM scored GROUP BY 1, 2 ORDER BY accuracy, n DESC, domain, difficulty LIMIT 5")
def w5_worst_cells(spark, sf):
    return scoring.worst_cells(scoring.rollup(_scored(spark, sf)).filter("level = 'by_cell'"), 5).select("domain", "difficulty", "n", "accuracy")


@add(f"""WITH {_SCORED_SQL}, g AS (SELECT domain, count(*)::DOUBLE AS n, sum(correct::INT)::DOUBLE AS k FROM scored GROUP BY 1), x AS (SELECT domain, n, k / n AS p, 1.959963985 AS z FROM g)
 SELECT domain, round(greatest(((p + z*z/(2*n)) - z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 0), 9) AS lo, round(least(((p + z*z/(2*n)) + z * sqrt(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n), 1), 9) AS hi FROM x""")
def e5_wilson(spark, sf):
    g = _scored(spark, sf).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("int")).alias("k"))
    return g.select("domain", scoring.wilson(F.col("k"), F.col("n")).alias("w")).select("domain", F.round("w.lo", 9).alias("lo"), F.round("w.hi", 9).alias("hi"))


@add("""WITH r AS (SELECT 'm' || m AS model, event_id AS id, (event_id * (m + 3)) % 7 < 4 AS correct FROM events, range(0, 3) q(m)), b AS (SELECT id, correct AS cb FROM r WHERE model = 'm0'),
 g AS (SELECT model, count(*) AS n, avg(correct::INT - cb::INT) AS delta, count(*) FILTER (cb AND NOT correct) AS b, count(*) FILTER (NOT cb AND correct) AS c FROM r JOIN b USING (id) WHERE model <> 'm0' GROUP BY 1)
 SELECT model, n, delta, b, c, least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda i: exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))))) AS p FROM g""")
def e6_e8_j8_paired(spark, sf):
    """All items, with McNemar's p."""
    e = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m"))
    r = e.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "id", ((F.col("id") * (F.col("m") + 3)) % 7 < 4).alias("correct"))
    return scoring.compare_to_base(r, "m0").select("model", "n", "delta", "b", "c", "p")


@add("SELECT event_type, exp(sum(value * (user_id % 50)) / sum(user_id % 50) / 100) AS perplexity FROM events WHERE user_id % 50 >= 1 GROUP BY 1")
def a22_perplexity(spark, sf):
    return scoring.perplexity(t(spark, sf, "events").withColumns({"loss": F.col("value") / 100, "n_tokens": F.col("user_id") % 50 + 1}), keys=["event_type"])


@add("SELECT lang, min(n_chars) AS min, max(n_chars) AS max, avg(n_chars) AS mean, median(n_chars) AS median FROM documents GROUP BY 1")
def a8_length_summary(spark, sf):
    return quantiles.length_summary(t(spark, sf, "documents").select("lang", F.length("text").cast("bigint").alias("n_chars")), "n_chars", ["lang"]).drop("n")


@add("SELECT l_returnflag, count(*) AS n, median(l_extendedprice * (l_discount - 0.05)) AS median FROM lineitem GROUP BY 1 UNION ALL SELECT 'all', count(*), median(l_extendedprice * (l_discount - 0.05)) FROM lineitem")
def a10_medians(spark, sf):
    """Medians of numbers of both signs, by flag and over all rows."""
    x = t(spark, sf, "lineitem").select("l_returnflag", (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("x"))
    return quantiles.medians(x, "x", ["l_returnflag"]).unionByName(quantiles.medians(x, "x").withColumn("l_returnflag", F.lit("all")))


@add("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2")
def a6_a7_group_counts(spark, sf):
    return t(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT event_type, count(*) FILTER (value > 50) AS ok, count(*) FILTER (value <= 50) AS failed, arg_max(event_id, (user_id, value, event_id)) AS best FROM events GROUP BY 1")
def a20_max_by(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("ok"), F.count_if(F.col("value") <= 50).alias("failed"), F.max_by("event_id", F.struct("user_id", "value", "event_id")).alias("best"))


@add("SELECT * FROM (PIVOT (SELECT source, lang FROM documents) ON lang IN ('en', 'de', 'fr', 'es') USING count(*))")
def a24_pivot(spark, sf):
    return t(spark, sf, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).agg(F.count(F.lit(1))).na.fill(0)


# --- order, samples, mixes ---------------------------------------------------------

_SEEDED = "md5('42|' || doc_id)"


@add("SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS pos FROM documents")
def s11_positions(spark, sf):
    return order.with_position(t(spark, sf, "documents").select("doc_id", "n_chars"), F.col("n_chars"), F.col("doc_id")).select("doc_id", "pos")


@add(f"SELECT doc_id FROM documents ORDER BY {_SEEDED}, doc_id LIMIT 100")
def x4_sample(spark, sf):
    return order.sample_rows(t(spark, sf, "documents"), 100, 42, "doc_id").select("doc_id")


@add(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_SEEDED}, doc_id) AS r FROM documents) WHERE r <= 20")
def x8_stratified(spark, sf):
    return order.stratified_sample(t(spark, sf, "documents"), "source", 20, 42, "doc_id").select("doc_id", "source")


@add(f"""WITH t AS (SELECT min(CASE lang WHEN 'en' THEN n / 0.85 ELSE n / 0.15 END) AS total FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY 1)),
 r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SEEDED}, doc_id) AS r FROM documents WHERE lang IN ('en', 'de')) SELECT doc_id, lang FROM r, t WHERE r <= floor(total * CASE lang WHEN 'en' THEN 0.85 ELSE 0.15 END)""")
def x1_a3_mix_documents(spark, sf):
    return order.mix(t(spark, sf, "documents").select("doc_id", "lang"), {"en": 0.85, "de": 0.15}, 42, "lang", key="doc_id")[0].select("doc_id", "lang")


@add(f"SELECT doc_id, lang FROM (SELECT doc_id, lang, sum(n_chars) OVER (PARTITION BY lang ORDER BY {_SEEDED}, doc_id ROWS UNBOUNDED PRECEDING) AS run FROM documents) WHERE run <= 100000")
def w7_x2_budget_prefix(spark, sf):
    return order.budget_prefix(t(spark, sf, "documents").select("doc_id", "lang", "n_chars"), F.col("n_chars"), 100_000, ["lang"], 42, "doc_id").select("doc_id", "lang")


@add("SELECT CASE WHEN k = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '-dup' || k END AS id, n_chars FROM documents, range(0, 3) r(k)")
def x6_x7_oversample(spark, sf):
    return order.oversample(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars"), 3)


@add("SELECT doc_id FROM documents ORDER BY doc_id OFFSET 100 LIMIT 50")
def s14_slice(spark, sf):
    return order.slice_rows(t(spark, sf, "documents").select("doc_id"), 100, 50, F.col("doc_id"))


@add("SELECT doc_id FROM documents ORDER BY doc_id LIMIT (SELECT greatest(1, count(*) // 10) FROM documents)")
def x13_package(spark, sf):
    return order.package_prefix(t(spark, sf, "documents").select("doc_id"), "deci", F.col("doc_id"))


@add("SELECT doc_id FROM documents ORDER BY n_chars, doc_id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.25) AS BIGINT)) FROM documents)")
def x14_fraction(spark, sf):
    return order.head_fraction(t(spark, sf, "documents").select("doc_id", "n_chars"), 0.25, F.col("n_chars"), F.col("doc_id")).select("doc_id")


@add("SELECT 'pref-' || lpad(CAST(row_number() OVER (ORDER BY n_name) + 99 AS VARCHAR), 5, '0') AS id, n_name FROM nation")
def w10_ids(spark, sf):
    return order.sequential_ids(t(spark, sf, "nation").select("n_name"), "pref", 100, F.col("n_name")).select("id", "n_name")


@add("SELECT n_nationkey AS v FROM nation INTERSECT SELECT CAST(s_suppkey % 40 AS INT) FROM supplier")
def x12_intersect(spark, sf):
    return t(spark, sf, "nation").select(F.col("n_nationkey").alias("v")).intersect(t(spark, sf, "supplier").select((F.col("s_suppkey") % 40).cast("int").alias("v")))


@add("SELECT c_custkey AS id, 'a' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT s_suppkey, 'b' FROM supplier")
def x3_x11_components(spark, sf):
    a = t(spark, sf, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"))
    return chat.mix_components({"a": a, "b": t(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))}, {"a": None})


# --- chats and tokens -----------------------------------------------------------


def _chats(spark, sf):
    c = t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    return c.select("conv_id", F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


_TURNS = "(SELECT conv_id, turn, role, text FROM conversations)"


@add(f"SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text)) AS digest FROM {_TURNS} GROUP BY 1")
def c1_chatml(spark, sf):
    return _chats(spark, sf).select("conv_id", F.md5(chat.to_chatml("messages").cast("binary")).alias("digest"))


@add(f"SELECT conv_id, CAST(arg_max(length(text), (turn, role, text)) AS INT) AS n FROM {_TURNS} WHERE role = 'assistant' GROUP BY 1")
def a9_response_length(spark, sf):
    return _chats(spark, sf).select("conv_id", chat.response_length("messages").alias("n")).filter("n is not null")


@add(f"""WITH l AS (SELECT conv_id, arg_max(role, (turn, role, text)) AS r, arg_max(text, (turn, role, text)) AS a FROM {_TURNS} GROUP BY 1), u AS (SELECT conv_id, arg_max(text, (turn, role, text)) AS q FROM {_TURNS} WHERE role = 'user' GROUP BY 1)
 SELECT conv_id, md5(q) AS question, md5(a) AS answer FROM l JOIN u USING (conv_id) WHERE r = 'assistant'""")
def c5_question_answer(spark, sf):
    q = _chats(spark, sf).select("conv_id", chat.question_answer("messages").alias("q")).filter("q is not null")
    return q.select("conv_id", F.md5(F.col("q.question").cast("binary")).alias("question"), F.md5(F.col("q.answer").cast("binary")).alias("answer"))


@add("""WITH d AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS pos, CAST(l_quantity AS INT) AS n FROM lineitem), o AS (SELECT pos, n, sum(n + 1) OVER (ORDER BY pos) - n - 1 AS a FROM d),
 x AS (SELECT a + i AS g, CASE WHEN i = n THEN -1 ELSE i END AS tok FROM o, LATERAL (SELECT unnest(range(0, n + 1)) AS i)), c AS (SELECT g // 64 AS chunk_id, g, tok FROM x)
 SELECT CAST(chunk_id AS BIGINT) AS chunk_id, md5(string_agg(CAST(tok AS VARCHAR), ',' ORDER BY g)) AS digest FROM c GROUP BY 1 HAVING count(*) = 64""")
def c9_c10_pack(spark, sf):
    d = order.with_position(t(spark, sf, "lineitem"), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).select("pos", F.sequence(F.lit(0), F.col("l_quantity").cast("int") - 1).alias("input_ids"))
    return chat.pack(d, 64, -1).select(big(F.col("chunk_id")).alias("chunk_id"), F.md5(F.array_join("input_ids", ",").cast("binary")).alias("digest"))


@add("SELECT n_nationkey, list_transform(range(0, 10), lambda i: CAST(i % (n_nationkey % 4 + 1) AS INT)) AS ids FROM nation")
def c13_repeat(spark, sf):
    return t(spark, sf, "nation").select("n_nationkey", chat.repeat_to_length(F.sequence(F.lit(0), F.col("n_nationkey") % 4), 10).alias("ids"))


@add("SELECT o_orderkey, md5('q' || o_orderkey || chr(10) || chr(10) || 'in') AS q, o_orderpriority AS a FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, md5('q' || o_orderkey), o_orderpriority FROM orders WHERE o_orderkey % 2 = 1")
def c4_instruction(spark, sf):
    m = chat.instruction_messages(F.concat(F.lit("q"), F.col("o_orderkey").cast("string")), F.when(F.col("o_orderkey") % 2 == 0, "in"), F.col("o_orderpriority"))
    return t(spark, sf, "orders").select("o_orderkey", m.alias("m")).select("o_orderkey", F.md5(F.get("m", 0)["content"].cast("binary")).alias("q"), F.get("m", 1)["content"].alias("a"))


@add("""WITH x AS (SELECT o_orderkey, [['human', 'gpt', 'user', 'assistant', 'bot', 'nobody'][o_orderkey % 6 + 1], ['human', 'gpt', 'nobody', 'assistant'][o_custkey % 4 + 1]] AS f FROM orders),
 m AS (SELECT o_orderkey, list_transform(f, lambda x: CASE x WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'nobody' THEN NULL ELSE x END) AS r FROM x)
 SELECT o_orderkey, CASE WHEN r[1] IS NOT NULL AND r[2] IS NOT NULL AND list_contains(r, 'user') AND list_contains(r, 'assistant') THEN r END AS roles FROM m""")
def c3_conversations(spark, sf):
    """Two turns of all pairs of speakers."""
    turn = lambda who, n: F.struct(F.element_at(F.array(*map(F.lit, who)), (F.col(n) % len(who) + 1).cast("int")).alias("from"), F.col("o_orderpriority").alias("value"))
    c = F.array(turn(("human", "gpt", "user", "assistant", "bot", "nobody"), "o_orderkey"), turn(("human", "gpt", "nobody", "assistant"), "o_custkey"))
    return t(spark, sf, "orders").select("o_orderkey", chat.conversation_messages(c)["role"].alias("roles"))


@add("""WITH x AS (SELECT o_orderkey, o_orderkey % 3 AS before, o_custkey % 3 = 0 AS asked, o_orderkey % 5 = o_custkey % 5 AS same FROM orders)
 SELECT o_orderkey, before = 0 AND NOT asked AS short, same AS mcq, NOT asked AS legacy FROM x""")
def e1_e2_e3_e4_answers(spark, sf):
    """The answer behind none to two other sentences, sometimes behind a new question; letters A to E in two forms."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    letter = lambda n: F.element_at(F.array(*map(F.lit, "ABCDE")), (n % 5 + 1).cast("int"))
    raw = F.concat(F.when(c % 3 == 0, "質問:").otherwise(""), F.repeat(F.lit("別。"), (k % 3).cast("int")), k.cast("string"), F.lit("。"))
    m = F.when(k % 2 == 0, F.concat(F.lit(" （"), letter(k), F.lit("）です"))).otherwise(F.concat(F.lit("答えは不明。答え："), letter(k)))
    ans = F.array(k.cast("string"))
    return t(spark, sf, "orders").select("o_orderkey", scoring.score_row(F.lit("short"), raw, ans, F.lit(None)).alias("short"), scoring.score_row(F.lit("mcq"), m, ans, letter(c)).alias("mcq"), scoring.legacy_score(raw, ans).alias("legacy"))


# --- more of the inventory --------------------------------------------------------


@add("""SELECT o_orderkey, md5('{}' || o_orderpriority || '{}' || o_orderstatus || '{}') AS content, 'judge' AS model, 0.0::DOUBLE AS temperature FROM orders""".format(*(x.replace("'", "''") for x in T.JUDGE_PROMPT)))
def n14_n15_judge_requests(spark, sf):
    body = T.judge_request("judge", T.judge_prompt(F.col("o_orderpriority"), F.col("o_orderstatus")))
    got = F.from_json(body, "model string, messages array<struct<role:string,content:string>>, max_tokens int, temperature double")
    return t(spark, sf, "orders").select("o_orderkey", got.alias("x")).filter("x.max_tokens = 96 and x.messages[0].role = 'user'").select("o_orderkey", F.md5(F.col("x.messages")[0]["content"].cast("binary")).alias("content"), "x.model", "x.temperature")


@add("SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.1f B', n_chars::DOUBLE) ELSE printf('%.1f KiB', n_chars / 1024.0) END AS size FROM documents")
def n23_format_bytes(spark, sf):
    return t(spark, sf, "documents").select("doc_id", T.format_bytes("n_chars").alias("size"))


@add("SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END, '<line ' || event_id || '>') AS label FROM events")
def n28_row_labels(spark, sf):
    return t(spark, sf, "events").select("event_id", T.row_label(F.when(F.col("event_id") % 2 == 0, F.col("user_id")), F.col("event_id")).alias("label"))


@add("""WITH s AS (SELECT doc_id, source, n_chars <= 2000 AS a, contains(text, 'the') AS b FROM documents), i AS (SELECT doc_id, source, 'char_count' AS v, a AS ok FROM s UNION ALL SELECT doc_id, source, 'keyword', b FROM s), p AS (SELECT doc_id, source, bool_and(ok) AS ok FROM i GROUP BY 1, 2)
 SELECT 'prompt' AS level, 'all' AS name, count(*) AS n, avg(ok::INT) AS strict FROM p UNION ALL SELECT 'instruction', 'all', count(*), avg(ok::INT) FROM i UNION ALL SELECT 'category', source, count(*), avg(ok::INT) FROM p GROUP BY 2 UNION ALL SELECT 'verifier', v, count(*), avg(ok::INT) FROM i GROUP BY 2""")
def v17_a13_o9_instruction_scores(spark, sf):
    d = t(spark, sf, "documents")
    kwargs = F.create_map(F.lit("char_count"), _detail(max=F.lit(2000)), F.lit("keyword"), _detail(include=F.array(F.lit("the"))))
    prompts = d.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("category"), F.array(F.lit("char_count"), F.lit("keyword")).alias("instruction_id_list"), kwargs.alias("kwargs"))
    scores = scoring.score_instructions(d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("response")), prompts)
    return scoring.aggregate_instructions(scores).select("level", "name", "n", "strict")


@add("SELECT source, lang, count(*) AS n FROM documents WHERE CAST((SELECT sum(('0x' || substr(sha1(CAST(doc_id AS VARCHAR)), i::INT, 1))::INT) FROM range(1, 41) r(i)) AS INT) % 5 = 0 GROUP BY 1, 2")
def x15_a21_split_distribution(spark, sf):
    return t(spark, sf, "documents").filter(T.split_bucket(F.col("doc_id").cast("string")) == 0).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT avg(x) AS mean, max(x) AS max, count(*) FILTER (x >= 0.5) AS over FROM (SELECT value / 100 AS x FROM events)")
def a23_overlap_distribution(spark, sf):
    x = F.col("value") / 100
    return t(spark, sf, "events").agg(F.avg(x).alias("mean"), F.max(x).alias("max"), F.count_if(x >= 0.5).alias("over"))


@add("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def j6_j19_completeness(spark, sf):
    return t(spark, sf, "nation").join(t(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey")), "n_nationkey", "left_anti").select("n_nationkey")


@add("SELECT unnest([5, 8, 13]) AS v INTERSECT SELECT DISTINCT p_size FROM part")
def a12_d8_eval_values(spark, sf):
    e = t(spark, sf, "part").select(F.struct(F.col("p_size").alias("min"), (F.col("p_size") + 0).alias("max")).alias("kwargs"))
    return prefs.eval_bounds(e, "kwargs.min", "kwargs.max").filter(F.col("v").isin(5, 8, 13))


@add()
def x10_j14_template_prompts(spark, sf):
    """Template prompts by bucket over sampled topics; the seeded topic samples are the engine's own."""
    return prompts.source_b(t(spark, sf, "nation").select(F.col("n_name").alias("topic")), 0)


@add()
def c6_x17_constraint_rows(spark, sf):
    """Rows of each verifier's quota, from chats of two turns."""
    m = T.messages(F.col("o_orderpriority"), F.concat(F.lit("カメラの説明です。番号は"), F.col("o_orderkey").cast("string"), F.lit("です。")))
    return chat.constraint_rows(t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), m.alias("messages"), F.lit("a").alias("origin")), {"char_count": 50, "polite_form": 40, "keyword": 30})


@add()
def e7_bootstrap(spark, sf):
    """Percentiles of resampled paired differences."""
    return scoring.bootstrap_interval(t(spark, sf, "events").select("event_type", ((F.col("value") > 50).cast("int") - (F.col("user_id") % 2 == 0).cast("int")).alias("diff")), "event_type")


@add("""WITH m AS (SELECT doc_id, list_sort(list_filter(['en', 'license', 'spam'], lambda g: CASE g WHEN 'en' THEN contains(text, ' the ') WHEN 'license' THEN contains(text, 'License') OR contains(text, 'licensed') ELSE contains(text, 'casino') END)) AS cells FROM documents)
 SELECT CASE WHEN k = 0 THEN CAST(doc_id AS VARCHAR) ELSE doc_id || '-dup' || k END AS id, cells FROM m, range(0, 3) r(k) WHERE len(cells) > 0""")
def x7_filter_and_weight(spark, sf):
    """Documents that match a keyword group, with their groups, three times."""
    kind = recipes.FILTERS["keyword_oversample"]({"oversample_weight": 3}, {"en": [" the "], "license": ["License", "licensed"], "spam": ["casino"]})
    rows = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("").alias("title"))
    return kind.weigh(kind.keep(rows), "id").select("id", "cells")


# --- chats as tokens ---------------------------------------------------------------

_CHATS_SQL = """turns AS (SELECT conv_id, turn, role, text, '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' || chr(10) AS tail FROM conversations),
 placed AS (SELECT *, sum(length(head) + length(tail)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) - length(tail) AS a FROM turns),
 chats AS (SELECT conv_id, string_agg(head || tail, '' ORDER BY turn, role, text) AS x FROM turns GROUP BY 1)"""


def _chats(spark, sf):
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return t(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("x")).select("conv_id", F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def _word_spans(text):
    """(ids, starts): runs of letters, digits and _, or single characters; an id is the first character and the length."""
    found = list(re.finditer(r"[A-Za-z0-9_]+|[^A-Za-z0-9_]", text))
    return [ord(m[0][0]) * 4096 + len(m[0]) for m in found], [m.start() for m in found]


@add(rf"""WITH {_CHATS_SQL}, w AS (SELECT conv_id, regexp_extract_all(x, '[A-Za-z0-9_]+|[^A-Za-z0-9_]') AS w FROM chats), tokens AS (SELECT conv_id, unnest(w) AS w, unnest(range(len(w))) AS i FROM w),
 starts AS (SELECT conv_id, i, unicode(w) * 4096 + length(w) AS id, sum(length(w)) OVER (PARTITION BY conv_id ORDER BY i) - length(w) AS at FROM tokens),
 marked AS (SELECT s.*, EXISTS (SELECT 1 FROM placed p WHERE p.conv_id = s.conv_id AND p.role = 'assistant' AND s.at >= p.a AND s.at < p.a + length(p.text)) AS learned FROM starts s)
 SELECT conv_id, count(*) AS n_tokens, count(*) FILTER (learned) AS n_learned, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i)) AS ids, md5(string_agg(CASE WHEN learned THEN CAST(id AS VARCHAR) ELSE '-100' END, ',' ORDER BY i)) AS labels FROM marked GROUP BY 1""")
def c7_c10_sft_spans(spark, sf):
    """Every conversation as token ids with labels, each encoded once."""
    x = chat.sft_example(_chats(spark, sf), None, 1 << 30, spans=_word_spans)
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ",").cast("binary"))
    return x.select("conv_id", big(F.size("input_ids")).alias("n_tokens"), big(F.size(F.filter("labels", lambda y: y != -100))).alias("n_learned"), digest("input_ids").alias("ids"), digest("labels").alias("labels"))


@add("""SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || CASE WHEN role = 'assistant' AND text <> '' THEN '【learned】' || text || '【/learned】' ELSE text END || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text)) AS shown FROM conversations GROUP BY 1""")
def c8_inspection(spark, sf):
    """Every conversation's tokens as text again, learned ones between marks; a token is a code point."""
    x = chat.sft_example(_chats(spark, sf), None, 1 << 30, spans=lambda s: ([ord(c) for c in s], range(len(s))))
    return chat.decode_for_inspection(x, lambda ids: "".join(map(chr, ids))).select("conv_id", F.md5(F.col("shown").cast("binary")).alias("shown"))


# --- appends, shards, files, global order ------------------------------------------


@add("""WITH x AS (SELECT l_orderkey AS id, CAST(l_linenumber AS INT) AS k, l_linenumber % 3 AS batch, l_quantity AS q FROM lineitem UNION ALL SELECT l_orderkey, CAST(l_linenumber AS INT), 1, l_quantity + 100 FROM lineitem WHERE l_linenumber % 2 = 0)
 SELECT id, k, arg_min(q, (batch, q)) AS q FROM x WHERE batch < 2 GROUP BY 1, 2""")
def k2_k3_st3_ledger(spark, sf):
    """Two overlapping batches and one that fails its gate, appended by key: a key's first batch counts, and in it its least row; the failed batch shows nothing."""
    line = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("int").alias("k"), F.col("l_quantity").alias("q"))
    own = Ledger(spark, f"{storage.shared_folder(spark)}/ledger-{uuid.uuid4().hex}", ["id", "k"], "id bigint, k int, q double")
    again = line.filter("k % 2 = 0").withColumn("q", F.col("q") + 100)
    own.append(line.filter("k % 3 = 0"), [_not_empty])
    own.append(line.filter("k % 3 = 1").unionByName(again), [_not_empty])
    try:
        own.append(line.filter("k % 3 = 2"), [_refused])
    except ValueError:
        pass
    return own.read()


def _not_empty(staged):
    if staged.filter("q is null").limit(1).count():
        raise ValueError("a row without a quantity")


def _refused(staged):
    if staged.filter("k % 3 = 2").limit(1).count():
        raise ValueError("a row of the third batch")


@add("SELECT doc_id, md5(text) AS digest, lang FROM documents WHERE doc_id >= 100 AND lang IN ('en', 'de') AND text LIKE '%the%'")
def s1_s6_s7_shards(spark, sf):
    """All documents as shards of JSON lines, read by the data source; it decides two of the conditions."""
    at = f"{storage.shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    t(spark, sf, "documents").select("doc_id", "text", "lang").write.json(at)
    rows = spark.read.format(shards.register(spark)).schema("doc_id bigint, text string, lang string").option("splitBytes", "4000000").option("where", '[["doc_id", ">=", 100], ["lang", "in", ["en", "de"]]]').load(at)
    return rows.filter("text LIKE '%the%'").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "lang")


@add("SELECT doc_id, md5(text || ',\"' || chr(13) || chr(10) || coalesce(source, '')) AS digest FROM documents")
def s4_csv_ranges(spark, sf):
    """All texts with quotes, commas and line ends in CSV files, read back in ranges of bytes."""
    at = f"{storage.shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    text = F.concat("text", F.lit(',"\r\n'), F.coalesce("source", F.lit("")))
    t(spark, sf, "documents").select("doc_id", text.alias("text")).write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    return csv_split.read(spark, at, "doc_id string, text string", 1 << 20).select(F.col("doc_id").cast("bigint"), F.md5(F.col("text").cast("binary")).alias("digest"))


@add(f"""WITH RECURSIVE t AS (SELECT min(CASE lang WHEN 'en' THEN n / 0.85 ELSE n / 0.15 END) AS total FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY 1)),
 r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_SEEDED}, doc_id) AS r FROM documents WHERE lang IN ('en', 'de')),
 mixed AS (SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM r, t WHERE r <= floor(total * CASE lang WHEN 'en' THEN 0.85 ELSE 0.15 END)),
 {permute.place_sql("position", "n", 42, "mixed")} SELECT doc_id, lang, place FROM mixed JOIN placed ON pos = position""")
def x1_x3_x5_global_order(spark, sf):
    """The mixture with each row's place in one seeded order."""
    return order.mix(t(spark, sf, "documents").select("doc_id", "lang"), {"en": 0.85, "de": 0.15}, 42, "lang", key="doc_id", place="place")[0].select("doc_id", "lang", "place")


#: Topics of one to ten a document: cuts of its text, half of them with their first character moved to the end.
_CUTS = 10


@add(f"""WITH t AS (SELECT doc_id, k, substr(text, CAST(1 + k * 37 AS INT), CAST(6 + (doc_id + k) % 5 AS INT)) AS x FROM documents, range(0, {_CUTS}) r(k)),
 topics AS (SELECT DISTINCT CASE WHEN (doc_id + k) % 2 = 0 THEN x ELSE substr(x, 2) || substr(x, 1, 1) END AS topic FROM t WHERE x <> ''),
 c AS (SELECT CASE WHEN conv_id % 2 = 0 THEN text ELSE reverse(text) END AS text FROM conversations UNION ALL SELECT text FROM documents), sizes AS (SELECT DISTINCT length(topic) AS n FROM topics),
 windows AS (SELECT DISTINCT substr(text, CAST(1 + 200 * j AS INT), 210) AS w FROM (SELECT text, unnest(range(0, length(text) // 200 + 1)) AS j FROM c)),
 cuts AS (SELECT substr(w, CAST(i AS INT), CAST(n AS INT)) AS topic FROM (SELECT w, n, unnest(range(1, least(200, length(w) - n + 1) + 1)) AS i FROM windows, sizes WHERE length(w) >= n))
 SELECT DISTINCT topic FROM cuts SEMI JOIN topics USING (topic)""")
def j10_many_topics(spark, sf):
    """Ten topics a document, 100,000 at sf0.1, against all texts of documents and conversations."""

    def topic(k):
        x = F.substring("text", 1 + k * 37, (6 + (F.col("doc_id") + k) % 5).cast("int"))
        return F.when((F.col("doc_id") + k) % 2 == 0, x).otherwise(F.concat(F.substring(x, 2, 1 << 30), F.substring(x, 1, 1)))

    topics = t(spark, sf, "documents").select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(_CUTS - 1)), topic)).alias("topic")).filter("topic <> ''")
    texts = t(spark, sf, "conversations").select(F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.reverse("text")).alias("prompt"))
    return prefs.topics_in(topics, texts.unionByName(t(spark, sf, "documents").select(F.col("text").alias("prompt"))))


# --- pipelines -------------------------------------------------------------------


def _corpora(spark, sf):
    return t(spark, sf, "documents").select(F.col("lang").alias("corpus"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), "text")


@add()
def o1_clean_corpus_stats(spark, sf):
    """Stage statistics of each corpus; greedy near-duplicate removal over hashed bands has no SQL form."""
    return clean.stage_stats(clean.clean_corpus(_corpora(spark, sf), t(spark, sf, "benchmark")))


@add("SELECT doc_id AS id, CASE WHEN NOT length(text) BETWEEN 50 AND 50000 THEN 'length' WHEN NOT (len(regexp_extract_all(text, '[A-Za-z]')) > 0) THEN 'language' END AS stage FROM documents")
def a1_f2_drop_stage(spark, sf):
    return clean.drop_stage(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")).select("id", "stage")


@add()
def d1_d2_d3_near_duplicates(spark, sf):
    d = _corpora(spark, sf)
    buckets, copies = clean.lsh_buckets(d, "corpus", "pos")
    first = d.select("corpus", F.col("pos").alias("p")).join(copies, ["corpus", "p"], "left_anti")
    return clean.keep_first_in_buckets(first, buckets, "corpus").unionByName(copies.withColumn("kept", F.lit(False)))


@add("""SELECT doc_id AS id, 'Q ' || source AS question, text AS answer FROM documents WHERE lang = 'en' AND source IS NOT NULL AND text IS NOT NULL AND n_chars % 3 <> 0""")
def o3_c2_f5_instructions(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", F.concat(F.lit("Q "), "source").alias("q"), F.when(F.col("n_chars") % 3 != 0, F.col("text")).alias("a"))
    rows, _ = recipes.prepare_instructions(d, "q", "a", F.col("lang") == "en")
    return rows.select("id", F.col("messages")[0]["content"].alias("question"), F.col("messages")[1]["content"].alias("answer"))


@add("""SELECT count(*) AS input_count, count(*) FILTER (lang = 'en') AS kept_count, count(*) FILTER (lang = 'en' AND n_chars % 3 = 0) AS skipped, least(count(*) FILTER (lang = 'en' AND n_chars % 3 <> 0), 100) AS output_count FROM documents""")
def o3_instruction_counts(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "source", F.when(F.col("n_chars") % 3 != 0, F.col("text")).alias("a"))
    return recipes.prepare_instructions(d, "source", "a", F.col("lang") == "en", 100)[1]


@add()
def o2_o11_prepare_data(spark, sf):
    """Two corpora to a mixture; near-duplicate removal over hashed bands has no SQL form."""
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.lit("").alias("title"))
    config = {"corpora": [{"name": "web"}, {"name": "topical", "filter": {"type": "keyword_oversample", "oversample_weight": 2}}], "mix": {"ratios": {"en": 1.0}}}
    corpora = {"web": d.filter("id % 2 = 0"), "topical": d.filter("id % 2 = 1")}
    mixture, _ = recipes.prepare_data(corpora, config, evals=t(spark, sf, "benchmark"), groups={"the": [" the "], "license": ["License"]})
    return mixture.select("key", "corpus", "language")


_MODELS_SQL = "items AS (SELECT event_id AS id, event_type AS domain, 'd' || (user_id % 3) AS difficulty FROM events), scored AS (SELECT 'm' || m AS model, event_id AS id, (user_id * (m + 3) + m) % 7 < 4 - m AS correct FROM events, range(0, 3) q(m) WHERE event_id % 5 <> m)"


def _models(spark, sf):
    e = t(spark, sf, "events")
    items = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("domain"), F.concat(F.lit("d"), (F.col("user_id") % 3).cast("string")).alias("difficulty"))
    s = e.select("event_id", "user_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("m")).filter("event_id % 5 <> m")  # what a model lacks counts as wrong
    return items, s.select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), F.col("event_id").alias("id"), ((F.col("user_id") * (F.col("m") + 3) + F.col("m")) % 7 < 4 - F.col("m")).alias("correct"))


@add(f"""WITH {_MODELS_SQL}, r AS (SELECT q.model, i.*, coalesce(s.correct, false) AS correct FROM items i CROSS JOIN (SELECT DISTINCT model FROM scored) q LEFT JOIN scored s ON s.model = q.model AND s.id = i.id)
 SELECT model, CASE WHEN grouping(domain) = 1 AND grouping(difficulty) = 1 THEN 'overall' WHEN grouping(difficulty) = 1 THEN 'by_domain' WHEN grouping(domain) = 1 THEN 'by_difficulty' ELSE 'by_cell' END AS level,
 domain, difficulty, count(*) AS n, CAST(sum(correct::INT) AS BIGINT) AS correct, avg(correct::INT) AS accuracy FROM r GROUP BY GROUPING SETS ((model), (model, domain), (model, difficulty), (model, domain, difficulty))""")
def o10_j18_model_rollup(spark, sf):
    return recipes.compare_models(*_models(spark, sf), "m0")[0].select("model", "level", "domain", "difficulty", "n", big(F.col("correct")).alias("correct"), "accuracy")


@add(f"""WITH {_MODELS_SQL}, r AS (SELECT q.model, i.id, coalesce(s.correct, false) AS correct FROM items i CROSS JOIN (SELECT DISTINCT model FROM scored) q LEFT JOIN scored s ON s.model = q.model AND s.id = i.id), b AS (SELECT id, correct AS cb FROM r WHERE model = 'm0')
 SELECT model, count(*) AS n, avg(correct::INT - cb::INT) AS delta, count(*) FILTER (cb AND NOT correct) AS b, count(*) FILTER (NOT cb AND correct) AS c FROM r JOIN b USING (id) WHERE model <> 'm0' GROUP BY 1""")
def o10_model_statistics(spark, sf):
    return recipes.compare_models(*_models(spark, sf), "m0")[1].select("model", "n", "delta", "b", "c")


@add(f"""WITH {_PROMPTS_SQL}, {_GEN_SQL} SELECT count(*) AS total, count(*) FILTER (CASE category WHEN 'char_count' THEN length(response) BETWEEN mn AND mx WHEN 'no_constraint' THEN length(response) BETWEEN 20 AND 300
 WHEN 'keyword' THEN length(response) >= 2 ELSE length(response) > 0 END) AS rule_pass, count(*) FILTER (length(response) < 20 OR length(response) >= 13) AS degenerate FROM gens JOIN prompts ON id = prompt_id""")
def o7_verification(spark, sf):
    plain, words = F.when(F.col("category") == "polite_form", "plain"), F.when(F.col("category") == "keyword", F.array(F.lit("xx")))
    p = _prompts(spark, sf).withColumn("constraint_detail", _detail(min=F.col("mn"), max=F.col("mx"), style=plain, include=words))
    g = _generations(spark, sf).join(p.select(F.col("id").alias("prompt_id")), "prompt_id", "left_semi")
    return recipes.run_verification(g, p)[1]


def _said(spark, sf):
    """Chats of two turns from orders."""
    m = T.messages(F.col("o_orderpriority"), F.concat(F.lit("カメラの説明です。番号は"), F.col("o_orderkey").cast("string"), F.lit("です。")))
    return t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), m.alias("messages"))


@add("SELECT 'one' AS origin, 100 AS count UNION ALL SELECT 'two', count(*) FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT 'format', 50 + 40")
def o4_sft_mix_origins(spark, sf):
    """A sample of one component, all of another, and constraint rows made from both."""
    d = _said(spark, sf)
    return recipes.prepare_sft_mix({"one": d.filter("id % 2 = 0"), "two": d.filter("id % 2 = 1")}, {"one": 100}, {"char_count": 50, "polite_form": 40})[1]["origins"]


_EVAL_STRUCT = "struct<char_count:struct<min:int,max:int>>"


def _evals(spark, sf):
    """Benchmark texts as evaluation prompts, with one bound among their constraints."""
    return t(spark, sf, "benchmark").select(F.col("text").alias("prompt"), F.from_json(F.lit('{"char_count": {"max": 50}}'), _EVAL_STRUCT).alias("kwargs"))


@add(f"""SELECT 'a' AS source, 'char_count' AS category, count(*) AS count FROM part WHERE p_size + 10 <> 50
 UNION ALL SELECT 'b', category, CAST(sum(least(n, (SELECT count(DISTINCT p_partkey) FROM part))) AS BIGINT) FROM (VALUES {", ".join(f"('{b[1]}', {b[6]})" for b in prompts.buckets())}) v(category, n) GROUP BY 2""")
def o6_prompt_pool(spark, sf):
    """Rows of the pool by source and category."""
    rows = t(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.lit("char_count").alias("category"), _detail(max=F.col("p_size") + 10).alias("detail"), F.concat(F.lit("品目"), F.col("p_partkey").cast("string")).alias("topic"), F.concat("p_name", F.lit("?")).alias("prompt"), F.lit("r").alias("response"), F.lit("char_count").alias("instruction_id_list"))
    return recipes.build_prompt_pool(rows, _evals(spark, sf))[1]


@add("""WITH x AS (SELECT doc_id, doc_id % 5 AS r, length('答え' || doc_id || '番の文章は' || substr('書かれていて十分に長いものですが、それでも短い', 1, CAST(10 + (doc_id % 7) * 3 AS INT))) AS n FROM documents)
 SELECT 'distill/' || doc_id AS id FROM x WHERE n BETWEEN 0.6 * 40 AND 0.9 * 40 AND r > 0 UNION ALL SELECT 'base/' || n_nationkey FROM nation""")
def o5_distill_mix(spark, sf):
    """Responses of several lengths under one bound; what keeps a tight margin and repeats nothing is mixed with the base rows."""
    k = F.col("doc_id").cast("string")
    more = F.substring(F.lit("書かれていて十分に長いものですが、それでも短い"), F.lit(1), (10 + (F.col("doc_id") % 7) * 3).cast("int"))
    response = F.concat(F.lit("答え"), k, F.lit("番の文章は"), more)
    detail = _detail(max=F.when(F.col("doc_id") % 5 == 0, 5).otherwise(40))
    rows = t(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.lit("char_count").alias("category"), detail.alias("detail"), F.concat(F.lit("品目"), k).alias("topic"), F.concat(F.lit("p"), k).alias("prompt"), response.alias("response"))
    base = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), T.messages("n_name", "n_name").alias("messages"))
    return recipes.prepare_distill_mix(rows, _evals(spark, sf), base, base_mean=30.0)[0].select("id")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
