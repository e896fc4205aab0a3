"""Scans: JSON lines, CSV, validated sets, keyed results, and a registry of named sources."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions import verifiers as V
from ..operators import order

DISTILL = "id string, category string, instruction_id_list string, constraint_detail string, topic string, prompt string, response string, response_char_count string"
JKB = "id string, domain string, difficulty string, format string, prompt string, answers array<string>, choices array<struct<label:string,text:string>>, correct_choice string, source_url string, source_quote string"
CONVERSATIONS = "conversations array<struct<from:string,value:string>>, instruction string, input string, output string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def jsonl(spark: SparkSession, path: str | Sequence[str], schema: str | StructType) -> DataFrame:
    """JSON lines, also gzipped and in several shards; blank lines are skipped, a malformed one fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path if isinstance(path, str) else list(path))


def sample_texts(spark: SparkSession, paths: Sequence[str], most: int, schema: str = "id string, text string") -> DataFrame:
    """Non-empty texts of the paths that exist, up to ``most``."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], schema)
    return jsonl(spark, there, schema).filter("text <> ''").limit(most)


def eval_prompts(spark: SparkSession, path: str, schema: str | StructType, limit: int | None = None) -> DataFrame:
    """The prompts with their line's position ``at``, the first ``limit`` of them (S16); a missing file is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    place = ("_metadata.file_path", "_metadata.file_block_start")
    rows = jsonl(spark, path, schema).select("*", *(F.col(c).alias(f"__{i}") for i, c in enumerate(place)), F.monotonically_increasing_id().alias("__2"))
    rows = order.with_position(rows, F.col("__0"), F.col("__1"), F.col("__2"), name="at").drop("__0", "__1", "__2")
    return rows if limit is None else rows.filter(F.col("at") < limit)


def distill_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a byte order mark and quoted line ends; detail is the parsed constraint."""
    df = spark.read.schema(DISTILL).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    return df.withColumn("detail", F.from_json("constraint_detail", V.DETAIL))


def extract_rows(df: DataFrame, order_by: Sequence[str], limit: int | None = None, title: bool = False) -> DataFrame:
    """id (the position as text), text, title: rows in order up to limit; a missing text fails."""
    d = order.with_position(df, *map(F.col, order_by)) if limit is None else order.with_position(df.orderBy(*order_by).limit(limit), *map(F.col, order_by))
    text = F.when(F.col("text").isNull(), F.raise_error(F.lit("row without text")).cast("string")).otherwise(F.col("text"))
    cols = [F.col("pos").cast("string").alias("id"), text.alias("text")]
    if title:
        cols.append(F.coalesce(F.col("title") if "title" in df.columns else F.lit(None).cast("string"), F.lit("")).alias("title"))
    return d.select("pos", *cols)


def heldout(df: DataFrame, skip: int, take: int, *by: str) -> DataFrame:
    """A slice in order, then without empty texts, then normalised; an empty result is an error."""
    out = order.slice_rows(df, skip, take, *map(F.col, by)).filter(F.coalesce("text", F.lit("")) != "").withColumn("text", T.nfkc("text"))
    if not out.limit(1).count():
        raise ValueError("no held-out text")
    return out


def jkb_violations(df: DataFrame) -> DataFrame:
    """id, why of rows that break the benchmark's schema."""
    why = F.when(F.col("id").isNull() | F.col("domain").isNull() | F.col("prompt").isNull(), "missing field")
    why = why.when(~F.coalesce(F.col("difficulty").isin("core", "standard", "advanced"), F.lit(False)), "difficulty")
    why = why.when(~F.coalesce(F.col("format").isin("short", "mcq"), F.lit(False)), "format")
    why = why.when((F.col("format") == "short") & (F.coalesce(F.size("answers"), F.lit(0)) < 1), "answers")
    why = why.when((F.col("format") == "mcq") & ((F.coalesce(F.size("choices"), F.lit(0)) < 2) | ~F.coalesce(F.exists("choices", lambda c: c["label"] == F.col("correct_choice")), F.lit(False))), "choices")
    return df.withColumn("why", why).filter("why is not null").select("id", "why")


def jkb(spark: SparkSession, path: str) -> DataFrame:
    """The validated benchmark; the first bad row is named in the error."""
    df = jsonl(spark, path, JKB)
    bad = jkb_violations(df).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['id']}: {bad[0]['why']}")
    return df


def keyed(spark: SparkSession, path: str, schema: str, keys: Sequence[str]) -> DataFrame:
    """The keys that a result file has; none if it is missing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema).select(*keys)
    return jsonl(spark, path, schema).select(*keys).distinct()


def line_count(spark: SparkSession, path: str) -> int:
    """Non-blank lines; 0 if the file is missing."""
    return spark.read.text(path).filter(T.strip("value") != "").count() if exists(spark, path) else 0


def first_path(record: Mapping, *paths: str) -> float | None:
    """The first of several dotted paths that a small metrics record has."""
    for path in paths:
        at = record
        for part in path.split("."):
            at = at.get(part) if isinstance(at, Mapping) else None
        if at is not None:
            return at
    return None


def json_record(path: str) -> dict:
    """One JSON document of a small file (S21); an unreadable one is named in the error."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise ValueError(f"{path}: {e}") from e


def accuracies(record: Mapping) -> tuple[float, dict[str, float]]:
    """(overall, by domain) of an aggregate whose entries are numbers or mappings with an accuracy."""
    of = lambda x: float(x["accuracy"] if isinstance(x, Mapping) else x)
    return of(record["overall"]), {k: of(v) for k, v in (record.get("by_domain") or {}).items()}


#: Where a benchmark's result may have its average, the first that it has.
AVERAGE_PATHS = ("AVG", "avg", "score", "scores.AVG", "evaluation.scores.AVG", "evaluation.lang_scores.JA.AVG")


def average(record: Mapping) -> float:
    """The average of a benchmark result (S21); none is an error."""
    got = first_path(record, *AVERAGE_PATHS)
    if got is None:
        raise ValueError("a result without an average")
    return float(got)


def instruction_aggregate(record: Mapping) -> dict[str, float | None]:
    """The rates of an instruction-following aggregate, of two verifiers too."""
    out = {k: record[f"{k}_acc"] for k in ("prompt_strict", "prompt_loose", "instruction_strict")}
    return out | {v: first_path(record, f"by_verifier.{v}.instruction_strict_acc") for v in ("polite_form", "char_count")}


def out_of_label(scores: str, tasks: Sequence[str]):
    """The {task}_ool entries of a JSON object column."""
    wanted = [f"{t}_ool" for t in tasks]
    return F.map_filter(F.from_json(scores, "map<string,double>"), lambda k, v: k.isin(wanted))


def latest(folder: str, pattern: str) -> Path | None:
    """The newest match by modification time."""
    return max(Path(folder).glob(pattern), key=lambda p: p.stat().st_mtime, default=None)


class Sources:
    """Named sources: a function from session and options to a DataFrame."""

    def __init__(self):
        self._known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str, read: Callable[..., DataFrame]) -> None:
        self._known[name] = read

    def load(self, spark: SparkSession, name: str, **options) -> DataFrame:
        if name not in self._known:
            raise KeyError(f"unknown source: {name}")
        try:
            return self._known[name](spark, **options)
        except Exception as e:
            raise RuntimeError(f"source {name}: {e}") from e

    def load_all(self, spark: SparkSession, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
        wanted = list(self._known) if names is None else list(names)
        missing = [n for n in wanted if n not in self._known]
        if missing:
            raise KeyError(f"unknown sources: {missing}")
        return {n: self.load(spark, n) for n in wanted}


def merge_configs(base: Mapping, over: Mapping) -> dict:
    """Nested mappings, those of ``over`` first."""
    return {k: merge_configs(base[k], over[k]) if isinstance(base.get(k), Mapping) and isinstance(over.get(k), Mapping) else over.get(k, base.get(k)) for k in {**base, **over}}


def load_config(path: str) -> dict:
    """A YAML file's mapping (S24); a missing file or another kind of content is an error."""
    import yaml

    if not Path(path).exists():
        raise FileNotFoundError(path)
    config = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(config, dict):
        raise ValueError(f"{path} is no mapping")
    return config


def file_md5(path: str, block: int = 1 << 20) -> str:
    """The md5 of a file, read in blocks."""
    import hashlib

    digest = hashlib.md5()
    with open(path, "rb") as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def config_hash(config: Mapping) -> str:
    """sha256 of the sorted JSON, 16 digits."""
    import hashlib

    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
