"""Shared helpers of the training-data operators.

Nothing here keeps state on one machine: intermediate tables go to the folder
named by ``spark.checkpoint.dir`` (shared by the driver and all executors), so a
lost executor costs a recomputation of tasks, never a missing file.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the token pattern [^\x20\x09-\x0D]+.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: spark.checkpoint.dir; where that is unset, one of our own in local mode, and an error on a cluster."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tessella-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        sc.setCheckpointDir(base)
        base = sc.getCheckpointDir() or base
    return base.rstrip("/")


class Scratch:
    """Cuts lineage by written Parquet tables below the shared folder."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessella-{what}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            p.getFileSystem(conf).delete(p, True)


def arrow_rows(spark: SparkSession) -> None:
    """Small Arrow batches: whole texts may be long, and Python workers share the executor's memory.

    One size for all operators, as a plan reads the setting when it runs, not when it is built.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", "256")  # 4096 whole texts are arrays of many MB in the executor's heap


def tidy() -> None:
    """Gives freed memory back to the system: Python workers are reused, and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run):
    """An Arrow function over batches that tidies up behind itself."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``: the contract's hold-out folds."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(modulus)).cast("int")


def spread(df: DataFrame, per_row_bytes: int = 0) -> DataFrame:
    """Deals rows of a small, compute-heavy table over all cores."""
    return df.repartition(max(2 * df.sparkSession.sparkContext.defaultParallelism, 12))


def chunks(batches: Iterator, column: str, max_bytes: int, max_rows: int = 1 << 30) -> Iterator:
    """Joins Arrow batches until ``column`` holds about ``max_bytes`` or ``max_rows`` are there; memory stays bounded."""
    held, size, rows = [], 0, 0
    for b in batches:
        # a batch may itself be large: cut it
        step = max(1, int(b.num_rows * min(1.0, max_bytes / max(1, b.column(b.schema.get_field_index(column)).nbytes))))
        step = min(step, max(1, max_rows // 4))
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            if rows + part.num_rows > max_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
            held.append(part)
            size += part.nbytes
            rows += part.num_rows
            if size >= max_bytes:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64 arrays."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_SPACE_BYTES = np.array([0x20, *range(0x09, 0x0E)])
_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        up, down = np.full(size + 1, _P, np.uint64), np.full(size + 1, _P_INV, np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        _POWERS[size] = up, down
    return _POWERS[size]


def binary_values(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column as one array, and row offsets into it; a null is empty."""
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, end byte, row) of each word of many texts at once.

    A word is ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.
    """
    return run_hashes(raw, offs, _SPACE_BYTES)


def run_hashes(raw: np.ndarray, offs: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, first byte, end byte, row) of each longest run of bytes other than ``gaps`` in many texts.

    A-Z count as a-z. A hash depends on its run's bytes alone (a polynomial over a random byte table, finalised), so it
    is the same on every executor.
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, z
    up, down = _powers(n + 1)
    inside = np.ones(256, bool)
    inside[gaps] = False
    word = inside[raw]
    edge = np.zeros(n + 1, bool)  # a text's end ends a word
    edge[offs] = True
    prev = np.concatenate([[False], word[:-1]])
    start = np.flatnonzero(word & (~prev | edge[:-1]))
    nxt = np.concatenate([word[1:], [False]])
    end = np.flatnonzero(word & (~nxt | edge[1:])) + 1
    s = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[raw] * up[:n], out=s[1:])
    h = mix64((s[end] - s[start]) * down[start] + (end - start).astype(np.uint64))
    return h, start, end, np.searchsorted(offs, start, side="right") - 1
