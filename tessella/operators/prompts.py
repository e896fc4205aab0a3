"""Prompt pools: selected rows, templates over topics, and screened external prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import verifiers as V
from . import order, storage

#: The buckets of template prompts and how many topics each value takes.
MOST_CHARS, MOST_TOPICS = (40, 45, 55, 65, 75), 60
LEAST_CHARS, LEAST_TOPICS = (30, 40, 55, 65, 75), 40
RANGES, RANGE_TOPICS = ((40, 110), (55, 130), (65, 140), (75, 160)), 38
PLAIN = ("{topic}について常体(だ・である調)で簡潔に説明してください。", "{topic}とは何か、常体(だ・である調)で述べてください。", "{topic}について、だ・である調で説明してください。")
PLAIN_TOPICS = 67
#: Topics of the evaluation prompts, which external prompts must not mention.
BANNED = (
    "リモートワーク", "在宅勤務", "東京駅", "日本で一番高い山", "書店", "欠勤", "梅雨", "缶コーヒー", "交通系IC", "朝礼", "蓄電池", "年始のご挨拶",
    "地震", "図書館", "睡眠", "謝罪メール", "風邪の予防", "継続は力なり", "夏祭り", "手土産", "引っ越し", "熱中症", "有給休暇", "桜",
    "節約術", "観光アプリ", "健康的な朝食", "食品トレー", "地球温暖化", "プレゼン資料", "納期", "茶道", "新入社員", "動画配信サービス", "面接のお礼", "サプリメント",
    "送別", "日本の祝日", "回覧板", "放置自転車", "春夏秋冬", "週末の予定", "見積書", "太陽系", "機械学習", "人工知能", "会議資料", "新幹線",
    "関西", "再生可能エネルギー", "新店舗", "防災", "研修", "品質保証", "値上げ", "忘年会", "1ダース", "進捗報告", "アニメフェスタ", "年末年始の営業",
    "夕食メニュー", "値引き", "正方形", "名物料理", "会社説明会", "都道府県", "犬と猫", "フードフェス", "筋トレ", "電動歯ブラシ", "東京タワー", "打ち合わせ",
)
DETAIL = f"struct<{', '.join(x.replace(' ', ':', 1) for x in V.DETAIL.split(', '))}>"


def buckets() -> list[tuple[int, str, int | None, int | None, str | None, str, int]]:
    """(bucket, category, min, max, style, template, topics) in the pool's order."""
    out = [("char_count", None, n, None, f"{{topic}}について{n}字以内で説明してください。", MOST_TOPICS) for n in MOST_CHARS]
    out += [("char_count", n, None, None, f"{{topic}}について{n}字以上で説明してください。", LEAST_TOPICS) for n in LEAST_CHARS]
    out += [("char_count", a, b, None, f"{{topic}}について{a}文字以上{b}文字以内で説明してください。", RANGE_TOPICS) for a, b in RANGES]
    out += [("polite_form", None, None, "plain", t, PLAIN_TOPICS) for t in PLAIN]
    return [(i, *b) for i, b in enumerate(out)]


def source_b(topics: DataFrame, start: int, seed: int = 42) -> DataFrame:
    """Template prompts: each bucket over a seeded sample of the distinct topics."""
    spark = topics.sparkSession
    b = spark.createDataFrame(buckets(), "bucket int, category string, mn int, mx int, style string, template string, n int")  # 17 rows
    rows = topics.select("topic").distinct().crossJoin(F.broadcast(b)).withColumn("__key", F.concat_ws("|", F.col("bucket").cast("string"), "topic"))
    rows = order.budget_prefix(rows, F.lit(1), F.col("n"), ["bucket"], seed, "__key")  # no bucket's topics in one task
    w = Window.partitionBy("bucket").orderBy(order.seeded(seed, F.col("__key")), "topic")  # n rows each
    rows = rows.withColumn("r", F.row_number().over(w))
    rows = order.sequential_ids(rows, "pref", start, F.col("bucket"), F.col("r"))
    kinds = dict(x.split(" ", 1) for x in V.DETAIL.split(", "))
    given = {"max": F.col("mx"), "min": F.col("mn"), "style": F.col("style")}
    detail = F.struct(*(given.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()))
    return rows.select("id", "category", F.col("category").alias("instruction_id_list"), detail.alias("constraint_detail"), "topic", F.replace("template", F.lit("{topic}"), F.col("topic")).alias("prompt"))


def source_a(selected: DataFrame, eval_values: list[int], pos: str = "pos") -> DataFrame:
    """Selected rows without those whose bounds the evaluation set has, newly numbered."""
    hit = F.col("detail.min").isin(eval_values) | F.col("detail.max").isin(eval_values)
    by_length = F.col("category").isin("char_count", "compound")
    kept = selected.filter(~(by_length & F.coalesce(hit, F.lit(False))))
    return order.sequential_ids(kept, "pref", 0, F.col(pos)).select("id", "category", "instruction_id_list", F.col("detail").alias("constraint_detail"), "topic", "prompt")


def source_c(external: DataFrame, per_category: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(external prompts that mention no evaluation topic, each text once, up to ``per_category`` of each category; rows by fate and category).

    Fates: kept, banned (a null prompt too), repeated, over. The bank is read once; its rows are written with their fate and
    counted from there. Of equal prompts the one of the first category stays.
    """
    hit = F.coalesce(T.contains_any("prompt", BANNED), F.lit(True))
    rows = external.withColumns({"__hit": hit, "__at": F.monotonically_increasing_id()})
    same = Window.partitionBy(F.when(F.col("__hit"), F.concat(F.lit("row "), F.col("__at"))).otherwise(F.md5(F.col("prompt").cast("binary")))).orderBy(F.asc_nulls_first("category"), "__at")
    fate = F.when(F.col("__hit"), "banned").when(F.col("__n") > 1, "repeated").otherwise("free")
    told = storage.cut(rows.withColumn("__n", F.row_number().over(same)).withColumn("fate", fate).drop("__hit", "__at", "__n"))
    kept = storage.cut(order.stratified_sample(told.filter("fate = 'free'").drop("fate"), "category", per_category, seed, "prompt"))
    counts = told.groupBy("fate", "category").count().unionByName(kept.groupBy(F.lit("kept").alias("fate"), "category").agg(F.count(F.lit(1)).alias("count")))
    over = counts.filter("fate in ('free', 'kept')").groupBy("category").agg(F.sum(F.when(F.col("fate") == "free", F.col("count")).otherwise(-F.col("count"))).alias("count"))
    counts = counts.filter("fate <> 'free'").unionByName(over.select(F.lit("over").alias("fate"), "category", "count").filter("count > 0"))
    return kept, counts


def pool(*parts: DataFrame) -> DataFrame:
    """The union of the sources (X11)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
