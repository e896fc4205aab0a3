"""Token ids in seekable binary files: independent zstandard frames, a document directory and a trailing seek table.

A file has, in this order:

* frames of at most ``FRAME_TOKENS`` little-endian ids (16 bits each if the vocabulary allows, else 32), each compressed
  alone, with its own checksum;
* a skippable frame (magic 0x184D2A50) with the directory: format, width of an id, and a compressed Arrow table of each document's id and number of ids;
* a skippable frame (magic 0x184D2A5E) with the seek table of the public seekable format: for each frame its
  compressed and plain size and the low half of its XXH64, then the number of frames, a descriptor and magic 0x8F92EAB1.

Any zstandard reader decompresses a file whole; a reader of some documents reads its end, then the frames
that hold them. Each task writes one file of a range of document ids; a manifest, committed by Spark, names the
files of the attempts that won, so files of lost or repeated attempts are never read.

Documents are in ascending order of their id, null ids first; rows of one id in an order of their text's hash, each a
document of its own. A null or empty text has the end id alone. An empty table has no files and reads back as no
rows. Long texts are encoded in parts cut where no pre-token crosses, and may span frames; a text without a blank
between letters or digits is one part, about 100 bytes of memory for each of its characters. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, chunks, tidied
from .pretokens import PieceIds, parts

FRAME_TOKENS = 1 << 16
DIRECTORY, SEEK, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
FORMAT = 1


def _place(uri: str):
    """(file system, path) of a shared folder's address."""
    from pyarrow import fs

    if m := re.match(r"(?:file:/*)?(/.*)|file:/+(.*)", uri):
        return fs.LocalFileSystem(), m[1] or f"/{m[2]}"
    return fs.FileSystem.from_uri(uri)


# --- one file ---------------------------------------------------------------------


class TokenFileWriter:
    """Writes documents one after another; memory is one frame, and the directory's two numbers a document."""

    def __init__(self, out, width: int, frame_tokens: int = FRAME_TOKENS, level: int = 3):
        self.out, self.kind, self.frame_tokens = out, f"<u{width}", frame_tokens
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held, self.n, self.frames, self.ids, self.sizes, self.tokens, self.bytes = [], 0, [], [], [], 0, 0

    def add(self, ids: pa.Array, sizes: np.ndarray, tokens: np.ndarray) -> None:
        """Documents' ids and sizes, and their tokens one after another."""
        self.ids.append(ids)
        self.sizes.append(sizes)
        self.tokens += len(tokens)
        self.held.append(tokens.astype(self.kind))
        self.n += len(tokens)
        if self.n >= self.frame_tokens:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.frame_tokens * self.frame_tokens
            for at in range(0, whole, self.frame_tokens):
                self._frame(flat[at : at + self.frame_tokens])
            self.held, self.n = [flat[whole:]], len(flat) - whole

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.bytes += len(data)

    def _frame(self, tokens: np.ndarray) -> None:
        raw = tokens.tobytes()
        data = self.zip.compress(raw)
        self._put(data)
        self.frames.append((len(data), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> None:
        if self.n:
            self._frame(np.concatenate(self.held))
        table = pa.table([pa.chunked_array(self.ids), pa.array(np.concatenate(self.sizes), pa.int64())], ["id", "n"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table)
        body = struct.pack("<BB", FORMAT, int(self.kind[2:])) + self.zip.compress(sink.getvalue().to_pybytes())
        self._put(struct.pack("<II", DIRECTORY, len(body)) + body)
        rows = [*self.frames, (8 + len(body), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]
        seek = b"".join(struct.pack("<III", *r) for r in rows) + struct.pack("<IBI", len(rows), 0x80, SEEK_END)
        self._put(struct.pack("<II", SEEK, len(seek)) + seek)


class TokenFileReader:
    """Reads the end of a file, then only the frames that are asked for; ``read`` counts them."""

    def __init__(self, source, name: str = ""):
        self.source, self.name, self.read = source, name, 0
        size = source.size()
        count, flags, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEK_END or flags != 0x80:
            raise ValueError(f"{name}: no seek table at its end")
        table = np.frombuffer(self._bytes(size - 9 - 12 * count, 12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        if 17 + 12 * count + table[:, 0].sum() != size:
            raise ValueError(f"{name}: its seek table doesn't fit its size")
        self.at = np.concatenate([[0], np.cumsum(table[:, 0])])
        self.table = table
        head = self._bytes(int(self.at[-2]), int(table[-1, 0]))
        kind, form, self.width = struct.unpack("<I4xBB", head[:10])
        if kind != DIRECTORY or form != FORMAT:
            raise ValueError(f"{name}: no directory")
        self.unzip = zstandard.ZstdDecompressor()
        self.directory = pa.ipc.open_stream(self.unzip.decompress(head[10:])).read_all().combine_chunks()
        self.sizes = self.directory.column("n").to_numpy()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.first = (np.cumsum(table[:-1, 1]) - table[:-1, 1]) // self.width  # of each frame, in ids

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, i: int) -> np.ndarray:
        """The ids of a frame; a damaged one is an error."""
        self.read += 1
        try:
            raw = self.unzip.decompress(self._bytes(int(self.at[i]), int(self.table[i, 0])))
        except zstandard.ZstdError as e:
            raise ValueError(f"{self.name}: frame {i} is damaged: {e}") from e
        if len(raw) != self.table[i, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2]:
            raise ValueError(f"{self.name}: frame {i} is damaged")
        return np.frombuffer(raw, f"<u{self.width}")

    def documents(self, wanted: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the directory, ids) of all documents, or of those at rising places; each frame is read once at most."""
        held, number = np.zeros(0, np.uint32), -1
        for d in range(len(self.sizes)) if wanted is None else wanted.tolist():
            a, b = int(self.starts[d]), int(self.starts[d] + self.sizes[d])
            out = []
            i = int(np.searchsorted(self.first, a, side="right")) - 1
            while a < b:
                if i != number:
                    held, number = self.frame(i), i
                begin = int(self.first[i])
                out.append(held[a - begin : b - begin])
                a = min(b, begin + len(held))
                i += 1
            yield d, (out[0] if len(out) == 1 else np.concatenate(out) if out else held[:0]).astype(np.uint32)


# --- many files -------------------------------------------------------------------


@functools.lru_cache(2)
def library_codec(spec: str) -> LibraryCodec:
    return LibraryCodec(spec)


class LibraryCodec:
    """Encodes with the tokenizers library: its model has each different pre-token once, while it is remembered.

    Texts with characters that Unicode has classed only lately go through the library's own splitting, as
    libraries differ there. Special tokens' names are ordinary text.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(spec)
        self.own.encode_special_tokens = True
        # the public mapping of bytes to characters: printable ones stand for themselves, the others follow 255
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.chars = {b: b for b in plain} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.size = self.own.get_vocab_size()
        self.memo = PieceIds(self._resolve)

    def _resolve(self, pieces: list[str]) -> list[list[int]]:
        one = self.own.model.tokenize
        return [[t.id for t in one(p.encode().decode("latin-1").translate(self.chars))] for p in pieces]

    def whole(self, text: str | None) -> np.ndarray:
        """One text by the library alone."""
        return np.concatenate([np.array(self.own.encode(p, add_special_tokens=False).ids, np.int32) for p in parts(text, 100_000)])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last's end)."""
        odd = [i for i, t in enumerate(texts) if t and not t.isascii() and not _settled(t)]
        if not odd:
            return self.memo.encode(texts)
        ids, at = self.memo.encode(["" if i in set(odd) else t for i, t in enumerate(texts)])
        lists = [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in odd:
            lists[i] = self.whole(texts[i])
        return np.concatenate(lists), np.concatenate([[0], np.cumsum([len(x) for x in lists])])


def _settled(text: str) -> bool:
    """Whether all characters are of blocks whose classes are the same in all releases of Unicode since 7."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return bool(((cp < 0x0530) | ((cp >= 0x2000) & (cp < 0x2080)) | ((cp >= 0x20A0) & (cp < 0xA7C0))).all())


def write_tokens(docs: DataFrame, root: str, spec: str, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text", frame_tokens: int = FRAME_TOKENS, files: int | None = None) -> DataFrame:
    """Writes the files and their manifest below ``root``; the manifest: part, file, first_id, last_id, docs, tokens, bytes.

    ``spec`` is a tokenizer's JSON. ``end_id`` follows each document. The one shuffle orders texts by id; ties are
    cut by the text's hash and the row's place, so no id's rows must fit one task.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast(spec)  # the vocabulary: of fixed size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumns({"h": F.xxhash64("text"), "at": F.monotonically_increasing_id()})
    by = [F.col("id").asc_nulls_first(), F.col("h"), F.col("at")]
    rows = rows.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), *by).sortWithinPartitions(*by).select("id", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(shared.value)
        part = TaskContext.get().partitionId()
        files_, folder = _place(root)
        name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}.ids.zst"  # an attempt's own
        out, writer, first, last = None, None, None, None
        for t in chunks(batches, "text", 1_500_000):
            ids, at = codec.encode(t.column("text").to_pylist())
            sizes = np.diff(at)
            if end_id is not None:
                ids, sizes = np.insert(ids, at[1:], end_id), sizes + 1
            key = t.column("id").combine_chunks()
            if writer is None:
                files_.create_dir(folder, recursive=True)
                out = files_.open_output_stream(f"{folder}/{name}", compression=None)  # the name would ask for it
                writer, first = TokenFileWriter(out, 2 if max(codec.size, end_id or 0) <= 1 << 16 else 4, frame_tokens), key.slice(0, 1)
            writer.add(key, sizes, ids)
            last = key.slice(len(key) - 1, 1)
        if writer is not None:
            writer.close()
            out.close()
            n = sum(map(len, writer.sizes))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), _one(first), _one(last), *(pa.array([x], pa.int64()) for x in (n, writer.tokens, writer.bytes))], ["part", "file", "first_id", "last_id", "docs", "tokens", "bytes"])

    made = rows.mapInArrow(tidied(write), f"part int, file string, first_id {kind}, last_id {kind}, docs bigint, tokens bigint, bytes bigint")
    made.write.mode("error").parquet(f"{root}/manifest")
    return manifest(spark, root)


def _one(a) -> pa.Array:
    return a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/manifest")


def read_tokens(spark: SparkSession, root: str, ids: bool = True) -> DataFrame:
    """Each document of the files: id, start (ids of all documents before it), n_tokens, ids_crc32 and, as asked, ids.

    Every frame is read once and held against its checksum. The crc is of the ids as little-endian 32-bit numbers.
    """
    rows = manifest(spark, root)
    kind = rows.schema["first_id"].dataType.simpleString()
    rows = rows.withColumn("base", F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # a row a file
    rows = rows.select("part", "file", F.coalesce("base", F.lit(0)).alias("base"))
    rows = rows.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files_, folder = _place(root)
        for b in batches:
            for name, base in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                with files_.open_input_file(f"{folder}/{name}") as f:
                    r = TokenFileReader(f, name)
                    crc, lists, from_ = [], [], 0

                    def batch(to: int, r=r, base=base):
                        at = slice(from_, to)
                        cols = [r.directory.column("id").slice(from_, to - from_).combine_chunks(), pa.array(r.starts[at] + base), pa.array(r.sizes[at]), pa.array(crc, pa.int64())]
                        return pa.RecordBatch.from_arrays([_one(cols[0]), *cols[1:], *([pa.array(lists, pa.list_(pa.int32()))] if ids else [])], ["id", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

                    held = 0
                    for d, x in r.documents():
                        crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                        if ids:
                            lists.append(x.view(np.int32))
                            held += len(x)
                        if len(crc) >= 4096 or held >= 1 << 20:
                            yield batch(d + 1)
                            crc, lists, from_, held = [], [], d + 1, 0
                    if crc:
                        yield batch(len(r.sizes))

    return rows.mapInArrow(tidied(read), f"id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids)


def read_documents(spark: SparkSession, root: str, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, ids) of the documents whose id is among ``wanted``.

    Directories are read for the files that may hold a wanted id; of these, only frames that hold a wanted document.
    """
    files = manifest(spark, root)
    kind = files.schema["first_id"].dataType.simpleString()
    wanted = wanted.select(F.col(id_col).cast(kind).alias("id")).distinct()
    span = wanted.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max(F.col("id").isNull()).alias("null"))
    files = files.join(F.broadcast(span), ((F.col("first_id").isNull() | (F.col("first_id") <= F.col("high"))) & (F.col("last_id") >= F.col("low"))) | (F.col("null") & F.col("first_id").isNull())).select("file")

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_, folder = _place(root)
        for b in batches:
            for name in b.column(0).to_pylist():
                with fs_.open_input_file(f"{folder}/{name}") as f:
                    r = TokenFileReader(f, name)
                for at in range(0, len(r.sizes), 65536):
                    key = _one(r.directory.column("id").slice(at, 65536).combine_chunks())
                    yield pa.RecordBatch.from_arrays([key, pa.array([name] * len(key)), pa.array(np.arange(at, at + len(key)))], ["id", "file", "at"])

    known = files.repartition("file").mapInArrow(tidied(list_), f"id {kind}, file string, at bigint")
    hits = known.join(wanted, known["id"].eqNullSafe(wanted["id"]), "left_semi").repartition("file").sortWithinPartitions("file", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs_, folder = _place(root)
        for name, key, at in _by_file(batches):
            with fs_.open_input_file(f"{folder}/{name}") as f:
                for i, (_, x) in enumerate(TokenFileReader(f, name).documents(at)):
                    yield pa.RecordBatch.from_arrays([key.slice(i, 1), pa.array([x.view(np.int32)], pa.list_(pa.int32()))], ["id", "ids"])

    return hits.mapInArrow(tidied(read), f"id {kind}, ids array<int>")


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """(file, ids, places) in runs of one file, of some thousand rows."""
    for t in chunks(batches, "file", 1 << 20):
        names = np.array(t.column("file").to_pylist())
        cut = np.flatnonzero(np.append(True, names[1:] != names[:-1])).tolist() + [len(names)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield str(names[a]), _one(t.column("id").slice(a, b - a).combine_chunks()), t.column("at").slice(a, b - a).to_numpy()
