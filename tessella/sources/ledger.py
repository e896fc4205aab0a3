"""A table that rows are appended to by key, each key once, whatever fails meanwhile.

An append has three steps. *Stage*: an attempt writes its new rows and their keys to folders
of its own. *Check*: gates read the staged rows, and may fail. *Publish*: a manifest that names all
attempts so far and this one is written beside the table and renamed to the next version, which
fails if that version exists. Readers take the newest version and read only what it names, so a job that is killed, or a
gate that fails, leaves nothing that anyone sees; what it staged is deleted by ``tidy``.

Two writers may stage at once. The one whose rename fails reads the new version, drops the keys that it
brought, and tries the next number, so no key is there twice. The rename must be atomic and must not
replace: HDFS and local folders have that, plain object stores do not.

An attempt may carry a name (a stream's batch number): a name that is published already adds
nothing, so a repeated batch is skipped before any work. Null keys are keys: null equals null here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Gate = Callable[[DataFrame], object]


class Conflict(RuntimeError):
    """The version exists."""


class Ledger:
    """A table of rows with unique ``keys`` below ``root``, a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: str):
        self.spark, self.root, self.keys, self.schema = spark, root.rstrip("/"), list(keys), schema
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # --- files ---

    def _path(self, *names: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _files(self):
        return self._path().getFileSystem(self._conf)

    def _list(self, name: str) -> list[str]:
        p = self._path(name)
        return sorted(s.getPath().getName() for s in self._files().listStatus(p)) if self._files().exists(p) else []

    # --- versions ---

    def version(self) -> int:
        """The newest version; 0 before the first."""
        return max((int(n[:-5]) for n in self._list("versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def attempts(self, version: int | None = None) -> list[dict]:
        """What a version, or the newest, names: attempt, name, rows."""
        version = self.version() if version is None else version
        if not version:
            return []
        source = self._files().open(self._path("versions", f"{version:010d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8"))
        finally:
            source.close()

    def _put(self, version: int, attempts: list[dict]) -> None:
        """Makes a version visible at once, or raises Conflict."""
        made = self._path("versions", f".{uuid.uuid4().hex}.tmp")
        out = self._files().create(made, False)
        out.write(bytearray(json.dumps(attempts).encode()))
        out.close()
        there = self._path("versions", f"{version:010d}.json")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files().getUri(), self._conf)
        kind = self._jvm.org.apache.hadoop.fs.Options
        none = self.spark.sparkContext._gateway.new_array(kind.Rename, 1)
        none[0] = kind.Rename.NONE
        try:
            context.rename(made, there, none)
        except Exception as e:
            self._files().delete(made, False)
            if "FileAlreadyExists" in str(e) or self._files().exists(there):
                raise Conflict(f"version {version} exists") from e
            raise

    # --- reading ---

    def _of(self, attempts: Sequence[str], what: str, schema) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*(f"{self.root}/attempts/{a}/{what}" for a in attempts)) if attempts else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All published rows."""
        return self._of([a["attempt"] for a in self.attempts(version)], "rows", self.schema)

    def known(self, version: int | None = None, since: int = 0) -> DataFrame:
        """The keys of a version, from the keys' own files; with ``since`` those that came after that version."""
        old = {a["attempt"] for a in self.attempts(since)} if since else set()
        return self._of([a["attempt"] for a in self.attempts(version) if a["attempt"] not in old], "keys", self._key_schema())

    def _key_schema(self):
        return self.spark.createDataFrame([], self.schema).select(*self.keys).schema

    def new_rows(self, df: DataFrame, known: DataFrame) -> DataFrame:
        """Rows whose key ``known`` lacks."""
        right = known.select(*(F.col(k).alias(f"__{i}") for i, k in enumerate(self.keys)))
        same = F.lit(True)
        for i, k in enumerate(self.keys):
            same &= df[k].eqNullSafe(right[f"__{i}"])
        return df.join(right, same, "left_anti")

    # --- writing ---

    def stage(self, df: DataFrame, order_by: Sequence[str] = ()) -> Attempt:
        """Writes the rows with new keys; of rows of one key the first by ``order_by``, then by all columns."""
        base = self.version()
        names = self.spark.createDataFrame([], self.schema).columns
        rows = self.new_rows(df.select(*names), self.known(base))
        by = [*order_by, *(c for c in names if c not in order_by and c not in self.keys)]
        if by:
            first = rows.groupBy(*self.keys).agg(F.min(F.struct(*by)).alias("__first"))
            rows = first.select(*(F.col(c) if c in self.keys else F.col("__first")[c].alias(c) for c in names))
        else:
            rows = rows.distinct()
        attempt = Attempt(self, uuid.uuid4().hex, base)
        attempt.write(rows)
        return attempt

    def append(self, df: DataFrame, gates: Sequence[Gate] = (), name: str | None = None, order_by: Sequence[str] = ()) -> int:
        """Stages, runs the gates over the staged rows, publishes; the number of rows added. A gate fails by raising."""
        if name is not None and any(a["name"] == name for a in self.attempts()):
            return 0
        attempt = self.stage(df, order_by)
        try:
            for gate in gates:
                gate(attempt.rows())
        except BaseException:
            attempt.drop()
            raise
        return attempt.publish(name)

    def tidy(self) -> int:
        """Deletes what no version names; only while nothing else writes. The number of attempts deleted."""
        kept = {a["attempt"] for a in self.attempts()}
        lost = [a for a in self._list("attempts") if a not in kept]
        for a in lost:
            self._files().delete(self._path("attempts", a), True)
        for n in self._list("versions"):
            if n.endswith(".tmp"):
                self._files().delete(self._path("versions", n), False)
        return len(lost)


class Attempt:
    """Rows that are written and not yet visible."""

    def __init__(self, ledger: Ledger, name: str, base: int):
        self.ledger, self.name, self.base = ledger, name, base

    def write(self, rows: DataFrame) -> None:
        at = f"{self.ledger.root}/attempts/{self.name}"
        rows.write.mode("overwrite").parquet(f"{at}/rows")
        self.rows().select(*self.ledger.keys).write.mode("overwrite").parquet(f"{at}/keys")

    def rows(self) -> DataFrame:
        return self.ledger._of([self.name], "rows", self.ledger.schema)

    def drop(self) -> None:
        self.ledger._files().delete(self.ledger._path("attempts", self.name), True)

    def publish(self, name: str | None = None, most_tries: int = 100) -> int:
        """Makes the rows visible; the number of them. Keys that another writer has published since are left out."""
        own = self.ledger
        for _ in range(most_tries):
            now = own.version()
            before = own.attempts(now)
            if name is not None and any(a["name"] == name for a in before):
                self.drop()
                return 0
            if now > self.base:
                newer = own.known(now, self.base)
                mine = self.rows()
                if own.new_rows(mine.select(*own.keys), newer).count() < mine.count():
                    again = Attempt(own, uuid.uuid4().hex, now)
                    again.write(own.new_rows(mine, newer))
                    self.drop()
                    self.name = again.name
                self.base = now
            n = self.rows().count()
            if not n and name is None:
                self.drop()
                return 0
            try:
                own._put(now + 1, [*before, {"attempt": self.name, "name": name, "rows": n}])
                return n
            except Conflict:
                continue
        raise Conflict(f"other writers came first {most_tries} times")
