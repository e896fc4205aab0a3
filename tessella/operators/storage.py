"""Intermediate tables in the shared folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_SCOPES: list[list[str]] = []


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        base = sc.getCheckpointDir()
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: lineage ends there, and lost executors cost tasks only."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes, when it ends, the tables that ``cut`` has written inside: results must have been read or written by then.

        with storage.scope(spark):
            queries["o1_clean_corpus_stats"](spark, folder).write.parquet(out)
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
        for path in _SCOPES.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def deal(df: DataFrame) -> DataFrame:
    """df with its rows dealt over all cores, where it comes from fewer files than there are cores: one row group is one task otherwise."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df
