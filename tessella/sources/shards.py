"""A data source over shards of JSON lines: ``spark.read.format("tessella_shards")`` and ``spark.readStream``.

A shard is a file of JSON lines, plain or gzipped; a path is a file or a folder, several are given as a JSON list in
``paths``. Plain shards are read in byte ranges of ``splitBytes``, gzipped ones whole, each range in a task of its own.

* ``limit``: the first records of the shards in order. They are pulled one by one by one task, so nothing
  behind the last of them is read but the rest of its block.
* ``where``: a JSON list of conditions that all hold, each [column, operator, value] with = <=> in > >= < <= startswith
  endswith contains null, or ["not", condition]. They are decided on the decoded line, before a row is made. A condition on
  ``shardColumn``, which then holds each row's file name, leaves out whole shards when tasks are planned. (Spark 4.1 keeps the
  filters that it pushes into a Python source for later queries over the same DataFrame, which then lose rows; so none are taken from there.)
* A stream's offset is a shard and a byte. New shards must sort behind the old; a batch takes up to ``maxBytesPerTrigger``.
  A query that restarts from its checkpoint, or with ``startShard`` and ``startByte``, goes on at the next line.

Blank lines are skipped. A line that is no JSON object fails the read, with its file and byte; with ``mode`` ``skip`` it is left
out. Fields that a line lacks are null; others than the schema's are ignored. A missing path is an error; an empty shard has no rows.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import DateType, StructType, TimestampType

from . import files

NAME = "tessella_shards"


@dataclass
class Range(D.InputPartition):
    """Bytes of a shard, or with ``limit`` several shards in order."""

    shards: list[tuple[str, int, int | None]]
    limit: int | None = None


_ORDER = {D.GreaterThan: operator.gt, D.GreaterThanOrEqual: operator.ge, D.LessThan: operator.lt, D.LessThanOrEqual: operator.le}
_TEXT = {D.StringStartsWith: str.startswith, D.StringEndsWith: str.endswith, D.StringContains: str.__contains__}


def holds(f: D.Filter, get) -> bool | None:
    """What SQL says of a filter: true, false or null."""
    if isinstance(f, D.Not):
        got = holds(f.child, get)
        return None if got is None else not got
    x = get(f.attribute[0])
    if isinstance(f, D.IsNull):
        return x is None
    if isinstance(f, D.IsNotNull):
        return x is not None
    if isinstance(f, D.EqualNullSafe):
        return x == f.value if x is not None and f.value is not None else x is None and f.value is None
    if x is None:
        return None
    if isinstance(f, D.In):
        return True if x in f.value else None if None in f.value else False
    if f.value is None:
        return None
    if isinstance(f, D.EqualTo):
        return x == f.value
    return (_ORDER.get(type(f)) or _TEXT[type(f)])(x, f.value)


_KINDS = {"=": D.EqualTo, "<=>": D.EqualNullSafe, "in": D.In, ">": D.GreaterThan, ">=": D.GreaterThanOrEqual, "<": D.LessThan, "<=": D.LessThanOrEqual, "startswith": D.StringStartsWith, "endswith": D.StringEndsWith, "contains": D.StringContains}


def condition(x: list) -> D.Filter:
    """A condition of the option ``where``."""
    if len(x) == 2 and x[0] == "not":
        return D.Not(condition(x[1]))
    if x[1:] == ["null"]:
        return D.IsNull((x[0],))
    if len(x) != 3 or x[1] not in _KINDS:
        raise ValueError(f"unknown condition: {x}")
    return _KINDS[x[1]]((x[0],), tuple(x[2]) if x[1] == "in" else x[2])


class _Shards:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options):
        self.schema, self.column = schema, options.get("shardColumn")
        self.skip = {"fail": False, "skip": True}[options.get("mode", "fail")]
        given = options.get("paths")
        self.paths = json.loads(given) if given else [options["path"]]
        self.split = int(options.get("splitBytes", 64 << 20))
        self.filters = [condition(x) for x in json.loads(options.get("where", "[]"))]

    def shards(self) -> list[tuple[str, int]]:
        return files.listed(self.paths)

    def pieces(self, uri: str, begin: int, end: int) -> list[tuple[str, int, int | None]]:
        if uri.endswith(".gz"):
            return [(uri, 0, None)] if begin == 0 else []
        return [(uri, begin + a, begin + b) for a, b in files.ranges(end - begin, self.split)]

    def rows(self, part: Range) -> Iterator[tuple]:
        names, left = self.schema.names, part.limit
        for uri, begin, end in part.shards:
            shard = uri.rsplit("/", 1)[-1]
            for at, line in files.lines(uri, begin, end):
                if not line.strip():
                    continue
                try:
                    record = json.loads(line)
                    if not isinstance(record, dict):
                        raise ValueError("no JSON object")
                except ValueError as e:
                    if self.skip:
                        continue
                    raise ValueError(f"{uri}, byte {at}: {e}") from e
                if self.column:
                    record[self.column] = shard
                if all(holds(f, record.get) for f in self.filters):
                    yield tuple(record.get(n) for n in names)
                if left is not None:
                    left -= 1
                    if left <= 0:
                        return


class ShardReader(_Shards, D.DataSourceReader):
    def __init__(self, schema: StructType, options):
        super().__init__(schema, options)
        self.limit = int(options["limit"]) if "limit" in options else None
        self.start = int(options.get("startShard", 0)), int(options.get("startByte", 0))

    def partitions(self) -> Sequence[Range]:
        first, byte = self.start
        all_ = [(uri, byte if i == first else 0, size) for i, (uri, size) in enumerate(self.shards()) if i >= first]
        if self.limit is not None:
            return [Range([(u, a, None) for u, a, _ in all_] if self.limit > 0 else [], self.limit)]
        own = [f for f in self.filters if self.column and _column(f) == self.column]
        all_ = [x for x in all_ if all(holds(f, {self.column: x[0].rsplit("/", 1)[-1]}.get) for f in own)]
        return [Range([p]) for u, a, b in all_ for p in self.pieces(u, a, b)] or [Range([])]

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)


def _column(f: D.Filter) -> str:
    return _column(f.child) if isinstance(f, D.Not) else f.attribute[0]


class ShardStream(_Shards, D.DataSourceStreamReader):
    def __init__(self, schema: StructType, options):
        super().__init__(schema, options)
        self.most = int(options.get("maxBytesPerTrigger", 1 << 30))
        self.start = {"shard": int(options.get("startShard", 0)), "byte": int(options.get("startByte", 0))}
        self.at = None

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        """At most ``maxBytesPerTrigger`` behind the last offset; a gzipped shard is taken whole."""
        at, left = dict(self.at or self.start), self.most
        shards = self.shards()
        while at["shard"] < len(shards) and left > 0:
            uri, size = shards[at["shard"]]
            rest = size - at["byte"]
            if rest > left and not uri.endswith(".gz"):
                at["byte"] += left
                break
            if at["shard"] == len(shards) - 1 and not uri.endswith(".gz"):  # the last shard may still grow
                at["byte"] = size
                break
            left -= rest
            at = {"shard": at["shard"] + 1, "byte": 0}
        self.at = at
        return at

    def partitions(self, start: dict, end: dict) -> Sequence[Range]:
        self.at = dict(end)  # also after a restart
        out = []
        for i, (uri, size) in enumerate(self.shards()):
            if start["shard"] <= i <= end["shard"]:
                a, b = start["byte"] if i == start["shard"] else 0, end["byte"] if i == end["shard"] else size
                if a < b:
                    out += [Range([p]) for p in self.pieces(uri, a, b)]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)


class ShardSource(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "id string, text string"

    def _checked(self, schema: StructType) -> StructType:
        for f in schema:
            if isinstance(f.dataType, DateType | TimestampType):
                raise ValueError(f"{f.name}: JSON has no dates; read a string and cast it")
        return schema

    def reader(self, schema: StructType) -> ShardReader:
        return ShardReader(self._checked(schema), self.options)

    def streamReader(self, schema: StructType) -> ShardStream:
        return ShardStream(self._checked(schema), self.options)


def register(spark: SparkSession) -> str:
    """Makes the format known to a session; the format's name."""
    spark.dataSource.register(ShardSource)
    return NAME
