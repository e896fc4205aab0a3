"""CSV files with quoted line ends, read by many tasks.

Whether a byte is inside quotes depends on all quotes before it. Only runs of an odd number of quotes change that:
where a field begins they swap inside and outside; elsewhere they end a quoted field, and mean nothing in an
unquoted one. A range of bytes therefore maps each of the two states at its start to one at its
end, and these maps compose. The first pass reads each range and gives its map; they are composed
in order within each file; the second pass reads each range again, knows its state, and parses the records that
begin in it, each to its true end.

Records are as Python's csv reader gives them with its usual settings: comma, double quote, doubled quotes, quotes kept
as they are inside unquoted fields, line ends LF, CR LF or CR, a byte order mark skipped, blank lines left out. Text is UTF-8. Each file's first record
names its columns; the schema's columns are taken by name, as strings. A missing column, or a record too short, gives null, and
what is too much is ignored. A record is held in memory whole; an empty file has no rows.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from . import files

QUOTE, COMMA, LF, CR = 0x22, 0x2C, 0x0A, 0x0D
MARK = b"\xef\xbb\xbf"
SPLIT = 32 << 20


def _runs(raw: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, whether a field begins there) of the odd runs of quotes; ``before`` is the byte in front of ``raw``, -1 at a file's start."""
    q = raw == QUOTE
    edge = np.diff(np.concatenate([[False], q, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    odd = (end - start) % 2 == 1
    start = start[odd]
    ahead = np.where(start > 0, raw[np.maximum(start, 1) - 1].astype(np.int64), before) if len(start) else start
    return start, np.isin(ahead, (-1, COMMA, LF, CR))


def _inside(begins: np.ndarray, state: int) -> np.ndarray:
    """The state behind each odd run: 1 inside quotes."""
    swaps = np.cumsum(begins)
    last = np.maximum.accumulate(np.where(begins, -1, np.arange(len(begins))))  # the last run that leads outside in any case
    return np.where(last < 0, state + swaps, swaps - swaps[np.maximum(last, 0)]) & 1


def _read(f, begin: int, end: int, size: int) -> tuple[np.ndarray, int]:
    """(bytes from begin to the end of the run of quotes that may cross ``end``, without a run that began before; the byte in front)."""
    f.seek(max(0, begin - 1))
    head = f.read(1) if begin else b""
    raw = f.read(end - begin)
    if raw[-1:] == b'"':
        at = end
        while at < size and (more := f.read(1 << 16)):
            n = len(more) - len(more.lstrip(b'"'))
            raw += more[:n]
            at += len(more)
            if n < len(more):
                break
    return np.frombuffer(raw, np.uint8), head[0] if head else -1


def _mine(raw: np.ndarray, before: int) -> int:
    """How many bytes at the start belong to a run of quotes that began earlier."""
    if before != QUOTE:
        return 0
    other = np.flatnonzero(raw != QUOTE)
    return int(other[0]) if len(other) else len(raw)


def _parts(raw: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    skip = _mine(raw, before)
    start, begins = _runs(raw[skip:], int(raw[skip - 1]) if skip else before)
    return start + skip, begins


def header(uri: str) -> tuple[list[str], int]:
    """(a file's column names, where its records begin)."""
    files_, path = files.place(uri)
    with files_.open_input_file(path) as f:
        raw, size = b"", f.size()
        while len(raw) < size:
            raw += f.read(1 << 16)
            begin = len(MARK) if raw.startswith(MARK) else 0
            ends = _ends(np.frombuffer(raw, np.uint8)[begin:], -1, 0, len(raw) == size)
            if len(ends):
                return next(csv.reader(io.StringIO(raw[begin : begin + int(ends[0])].decode(), newline=""))), begin + int(ends[0])
        begin = len(MARK) if raw.startswith(MARK) else 0
        rows = list(csv.reader(io.StringIO(raw[begin:].decode(), newline="")))
        return (rows[0] if rows else []), size


def _ends(raw: np.ndarray, before: int, state: int, whole: bool = True) -> np.ndarray:
    """Where records end: the places behind line ends outside quotes; one at the very end counts only if nothing can follow its CR."""
    start, begins = _parts(raw, before)
    line = (raw == LF) | (raw == CR)
    line[:-1] &= ~((raw[:-1] == CR) & (raw[1:] == LF))
    if len(raw) and raw[-1] == CR and not whole:
        line[-1] = False
    at = np.flatnonzero(line)
    if len(start):
        which = np.searchsorted(start, at) - 1
        inside = np.where(which < 0, state, _inside(begins, state)[np.maximum(which, 0)])
    else:
        inside = np.full(len(at), state)
    return at[inside == 0] + 1


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for uri, size, begin, end in zip(*(b.column(c).to_pylist() for c in ("uri", "size", "begin", "end")), strict=True):
            files_, path = files.place(uri)
            with files_.open_input_file(path) as f:
                raw, before = _read(f, begin, end, size)
            _, begins = _parts(raw, before if begin != b.column("first")[len(out)].as_py() else -1)
            after = [int(_inside(begins, s)[-1]) if len(begins) else s for s in (0, 1)]
            out.append(after)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32())], [*b.schema.names, "out0", "out1"])


def _text(f, begin: int, end: int, size: int, first: int, state: int) -> bytes:
    """The whole records that begin in a range."""
    f.seek(max(first, begin - 1))
    head = begin - 1 if begin > first else begin
    raw = f.read(end - head)
    data = np.frombuffer(raw, np.uint8)
    if begin > first:
        own, before = data[1:], int(data[0])
    else:
        own, before = data, -1
    if end < size:  # one byte more tells whether a CR at the end has its LF
        after = f.read(1)
        tail = np.frombuffer(after, np.uint8)
    else:
        tail = np.zeros(0, np.uint8)
    ends = _ends(np.concatenate([own, tail]), before, state, whole=end == size)
    ends = ends[ends <= len(own)]
    if begin == first:
        from_ = 0
    else:
        # the byte in front may itself end a record, outside quotes
        at_front = state == 0 and (before == LF or (before == CR and not (len(own) and own[0] == LF)))
        if at_front:
            from_ = 0
        elif len(ends) and ends[0] < len(own):
            from_ = int(ends[0])
        else:
            return b""
    if from_ >= len(own):
        return b""
    out = own[from_:].tobytes()
    if end == size or (len(ends) and ends[-1] == len(own)):
        return out
    # the last record goes on behind the range
    held = tail
    s, b = _parts(own, before)
    inside = int(_inside(b, state)[-1]) if len(b) else state
    trail = len(own) - len(out)
    tailed = own[trail:]
    run = len(tailed) - len(tailed.tobytes().rstrip(b'"'))
    while True:
        got = np.concatenate([held, np.frombuffer(f.read(1 << 16), np.uint8)])
        finished = len(got) == len(held)
        # states behind the range: a run of quotes that crosses its end is counted from its start
        whole = np.concatenate([own[len(own) - run :], got]) if run else got
        front = int(own[len(own) - run - 1]) if len(own) > run else before
        base = inside
        if run:
            s2, b2 = _parts(own[: len(own) - run], before)
            base = int(_inside(b2, state)[-1]) if len(b2) else state
        more = _ends(whole, front if len(own) > run else before, base, whole=finished)
        more = more[more > run]
        if len(more):
            return out + whole[run : int(more[0])].tobytes()
        if finished:
            return out + got.tobytes()
        held = got


def read(spark: SparkSession, paths: str | Sequence[str], schema: str | StructType, split: int = SPLIT) -> DataFrame:
    """The records of the files, many tasks a file."""
    kind = spark.createDataFrame([], schema).schema
    names = kind.names
    rows, heads = [], {}
    for uri, size in files.listed([paths] if isinstance(paths, str) else list(paths)):
        columns, first = header(uri)
        heads[uri] = columns
        rows += [(uri, size, first, first + a, first + b, i) for i, (a, b) in enumerate(files.ranges(size - first, split))]
    parts = spark.createDataFrame(rows, "uri string, size bigint, first bigint, begin bigint, end bigint, number int")
    if not rows:
        return spark.createDataFrame([], kind)
    dealt = parts.repartition(len(rows), "uri", "number")
    told = dealt.mapInArrow(_states, parts.schema.add("out0", IntegerType()).add("out1", IntegerType()))
    # the maps of a file's ranges in order: state behind each from that in front of it
    steps = F.array_sort(F.collect_list(F.struct("number", "begin", "end", "out0", "out1")))
    start = F.struct(F.lit(0).alias("s"), F.array().cast("array<struct<begin:bigint,end:bigint,state:int>>").alias("of"))
    walk = F.aggregate(steps, start, lambda a, x: F.struct(F.when(a["s"] == 0, x["out0"]).otherwise(x["out1"]).alias("s"), F.concat(a["of"], F.array(F.struct(x["begin"].alias("begin"), x["end"].alias("end"), a["s"].alias("state")))).alias("of")))
    placed = told.groupBy("uri", "size", "first").agg(walk["of"].alias("of")).select("uri", "size", "first", F.inline("of"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        for b in batches:
            for uri, size, first, begin, end, state in zip(*(b.column(c).to_pylist() for c in ("uri", "size", "first", "begin", "end", "state")), strict=True):
                at = [heads[uri].index(n) if n in heads[uri] else None for n in names]
                files_, path = files.place(uri)
                with files_.open_input_file(path) as f:
                    text = _text(f, begin, end, size, first, state).decode()
                held = []
                for r in csv.reader(io.StringIO(text, newline="")):
                    if r:
                        held.append(r)
                    if len(held) >= 4096:
                        yield _batch(held, at, names)
                        held = []
                if held:
                    yield _batch(held, at, names)

    return placed.repartition(len(rows), "uri", "begin").mapInArrow(parse, kind)


def _batch(rows: list[list[str]], at: list[int | None], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] if i is not None and i < len(r) else None for r in rows], pa.string()) for i in at], names)
