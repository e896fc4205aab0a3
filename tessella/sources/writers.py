"""Sinks: ordered JSON lines, resumable appends, splits, packed caches and reports."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Gate, Ledger
from .readers import exists


def jsonl(df: DataFrame, path: str, *order_by: str) -> None:
    """JSON lines in order over as many files as partitions, file names rising with the order (K1)."""
    (df.orderBy(*order_by) if order_by else df).write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Appends the rows whose key the table lacks; their number."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    df = df.dropDuplicates(list(keys)).persist()
    n = df.count()
    if n:
        df.write.mode("append").parquet(path)
    df.unpersist()
    return n


def judge_new(targets: DataFrame, path: str, judge: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keys: Sequence[str], order_by: Sequence[str] = ()) -> int:
    """Appends ``judge``'s rows for the targets whose key the table lacks, in order within each file; their number (K3).

    ``judge`` takes and returns a frame; tasks call it side by side, and a lost one calls it again.
    """
    spark = targets.sparkSession
    if exists(spark, path):
        targets = targets.join(spark.read.parquet(path).select(*keys).distinct(), list(keys), "left_anti")
    by = list(order_by or keys)
    before = spark.read.parquet(path).count() if exists(spark, path) else 0
    rows = targets.dropDuplicates(list(keys)).repartitionByRange(*by).sortWithinPartitions(*by)
    rows.mapInPandas(lambda frames: map(judge, frames), schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path).count() - before


def judge_into(ledger: Ledger, targets: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], gates: Sequence[Gate] = (), order_by: Sequence[str] = ()) -> int:
    """As judge_new, with each key once and all rows or none: ``judge``'s rows are staged, gated and published (K2, K3)."""
    by = list(order_by or ledger.keys)
    rows = ledger.new_rows(targets, ledger.known()).dropDuplicates(ledger.keys).repartitionByRange(*by).sortWithinPartitions(*by)
    return ledger.append(rows.mapInPandas(lambda frames: map(judge, frames), ledger.schema), gates)


def split(df: DataFrame, path: str, column: str = "split") -> None:
    """One folder a split (K6)."""
    df.write.mode("overwrite").partitionBy(column).json(path)


def packed_cache(df: DataFrame, path: str, manifest: Mapping) -> None:
    """Sequences as Parquet with a manifest beside them (K7)."""
    df.write.mode("overwrite").parquet(f"{path}/sequences")
    df.sparkSession.createDataFrame([(json.dumps(dict(manifest), sort_keys=True),)], "manifest string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def fingerprint(spark: SparkSession, source: str, model: str, seq_len: int, package: str = "full") -> dict:
    """What a packed cache must have been built from: the source's path, time and size, the model and the settings."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    at = files.getFileStatus(p)
    return {"source": source, "time": at.getModificationTime(), "size": files.getContentSummary(p).getLength(), "model": model, "seq_len": seq_len, "package": package}


def build_or_load(spark: SparkSession, folder: str, manifest: Mapping, build: Callable[[], DataFrame], rebuild: bool = False) -> DataFrame:
    """The cache of this manifest, else ``build``'s sequences, written there (O12); no sequences are an error."""
    got = None if rebuild else load_packed(spark, folder, manifest)
    if got is None:
        rows = build()
        _remove(spark, f"{folder}/manifest")  # a cache half written has no manifest
        packed_cache(rows, folder, manifest)
        got = load_packed(spark, folder, manifest)
        if not got.limit(1).count():
            _remove(spark, f"{folder}/manifest")
            raise ValueError("no packed sequences")
    return got


def _remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder, if it is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def load_packed(spark: SparkSession, path: str, manifest: Mapping) -> DataFrame | None:
    """The cache, if its manifest is there and the one asked for (K8, G5); a file system that fails is an error."""
    if not exists(spark, f"{path}/manifest"):
        return None
    line = spark.read.text(f"{path}/manifest").first()
    try:
        got = json.loads(line[0]) if line else None
    except ValueError:
        return None
    return spark.read.parquet(f"{path}/sequences") if got == dict(manifest) else None


def markdown_table(rows: Sequence[Mapping], columns: Sequence[str] | None = None) -> str:
    """A Markdown table of a small result."""
    columns = list(columns or (rows[0] if rows else ()))
    show = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in rows)])


def report(df: DataFrame, title: str, order_by: Sequence[str] = (), most: int = 1000) -> str:
    """A titled Markdown report of an aggregate."""
    rows = [r.asDict() for r in (df.orderBy(*order_by) if order_by else df).limit(most).collect()]
    return f"# {title}\n\n{markdown_table(rows, df.columns)}\n"


def scores(df: DataFrame, path: str, aggregate: DataFrame) -> None:
    """Scored rows and one aggregate row (K4)."""
    df.write.mode("overwrite").json(f"{path}/scores")
    aggregate.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/aggregate")
