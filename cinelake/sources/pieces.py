"""Objects of any size as tables of pieces, read and written by byte ranges.

`binaryFile` gives an object as one value, and refuses one of 2 GiB and more. Here an object is rows (path, ext, length, piece_no, offset, content), each with at most `piece` bytes and, if asked
for, a halo of the bytes that follow. The driver lists names and lengths only; the first `limit` paths are chosen before anything is read, and small objects share a task.

The sink is the other way: rows (path, part_no, bytes) become objects whose names can be turned back into paths. Every task writes to a scratch folder of its own, and objects
appear when the whole job has succeeded; a failed task or job leaves nothing behind.

Files are reached through pyarrow's file systems, local, S3, GCS and HDFS among them. Where only Spark's readers reach the store, cut a table of objects with `cut` instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from cinelake.functions import binary as B

PIECE = 1 << 23
TASK_BYTES = 1 << 26
_SCHEMA = "path string, length long, piece_no long, offset long, content binary"
_SCRATCH = "_scratch-"


def _open(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root if "://" in root else "file://" + root.removeprefix("file:"))
    return pafs.LocalFileSystem(), root


@dataclass
class Ranges(InputPartition):
    """(path, length, first piece, pieces) of one task."""

    spans: list


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.piece = int(options.get("piece", PIECE))
        self.halo = int(options.get("halo", 0))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.which = options.get("content", "all")
        if self.which not in ("all", "ends", "none") or self.piece < 1 or self.halo < 0:
            raise ValueError("content is all, ends or none; piece at least 1, halo at least 0")

    def files(self) -> list[tuple[str, int]]:
        system, base = _open(self.root)
        base = base.rstrip("/")
        found = system.get_file_info(pafs.FileSelector(base, recursive=True))
        files = sorted(((f.path[len(base) + 1 :], f.size) for f in found if f.type == pafs.FileType.File), key=lambda f: f[0].encode())
        return files if self.limit is None else files[: self.limit]

    def partitions(self) -> list[Ranges]:
        out: list[list] = []
        room = 0
        for path, length in self.files():
            pieces = max(1, -(-length // self.piece))
            spans = [(0, pieces)] if self.which != "ends" or pieces < 3 else [(0, 1), (pieces - 1, 1)]
            for first, count in spans:
                while count:
                    if room <= 0:
                        out.append([])
                        room = TASK_BYTES
                    n = count if self.which == "none" else min(count, max(1, room // self.piece))
                    out[-1].append((path, length, first, n))
                    room -= max(1 << 12, min(length, n * self.piece)) if self.which != "none" else 1 << 12
                    first, count = first + n, count - n
        return [Ranges(spans) for spans in out] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system, base = _open(self.root)
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        for path, length, first, count in partition.spans:
            if self.which == "none":
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([0]), pa.array([0]), pa.array([None], pa.binary())], names=names)
                continue
            with system.open_input_file(f"{base.rstrip('/')}/{path}") as file:
                for i in range(first, first + count):
                    data = file.read_at(min(self.piece + self.halo, length - i * self.piece), i * self.piece) if length else b""
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([length]), pa.array([i]), pa.array([i * self.piece]), pa.array([data], pa.binary())], names=names)


@dataclass
class Written(WriterCommitMessage):
    scratch: str
    names: list


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.root = options["path"]

    def write(self, rows: Iterator) -> Written:
        """Parts in the order in which they come; those of one object lie in one task."""
        system, base = _open(self.root)
        scratch = f"{base.rstrip('/')}/{_SCRATCH}{uuid.uuid4().hex}"
        system.create_dir(scratch)
        names, stream, last = [], None, None
        try:
            for row in rows:
                if row["path"] != last or stream is None:
                    if stream is not None:
                        stream.close()
                    last = row["path"]
                    names.append(object_name(last))
                    stream = system.open_output_stream(f"{scratch}/{names[-1]}")
                stream.write(bytes(row["bytes"]) if row["bytes"] is not None else b"")
            if stream is not None:
                stream.close()
        except BaseException:
            if stream is not None and not stream.closed:
                stream.close()
            system.delete_dir(scratch)
            raise
        return Written(scratch, names)

    def commit(self, messages: list) -> None:
        system, base = _open(self.root)
        for m in messages:
            for name in m.names if m else []:
                system.move(f"{m.scratch}/{name}", f"{base.rstrip('/')}/{name}")
        self.abort(messages)  # what repeated tasks have left

    def abort(self, messages: list) -> None:
        system, base = _open(self.root)
        for f in system.get_file_info(pafs.FileSelector(base, recursive=False, allow_not_found=True)):
            if f.type == pafs.FileType.Directory and f.base_name.startswith(_SCRATCH):
                system.delete_dir(f.path)


class PieceSource(DataSource):
    """Format `pieces`. Options for reading: path, piece, halo (bytes), limit (objects), content (all; ends: first and last piece only; none: one row without bytes for each object).
    For writing: path, a folder of this job alone."""

    @classmethod
    def name(cls) -> str:
        return "pieces"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options)


def object_name(path: str) -> str:
    """One file name for a path, different for different paths: anything but letters, digits, `_`, `-`, `~` and inner dots is escaped."""
    name = quote(path, safe="")
    return "%2E" + name[1:] if name.startswith(".") else name.replace("_", "%5F", 1) if name.startswith("_") else name


def object_path(name: str) -> str:
    return unquote(name)


def scan_pieces(spark: SparkSession, root: str, piece: int = PIECE, halo: int = 0, limit: int | None = None, content: str = "all") -> DataFrame:
    """(path, ext, length, piece_no, offset, content) of every regular file below `root`, or of the first `limit` paths; an empty file has one empty piece."""
    from cinelake.operators.identify import extension  # operators import this module

    spark.dataSource.register(PieceSource)
    reader = spark.read.format("pieces").option("piece", piece).option("halo", halo).option("content", content)
    reader = reader if limit is None else reader.option("limit", limit)
    rows = reader.load(root)
    return rows.select("path", extension(F.col("path")).alias("ext"), "length", "piece_no", "offset", "content")


def cut(objects: DataFrame, piece: int = PIECE, halo: int = 0, key: str = "path", content: str = "content") -> DataFrame:
    """The same rows (key, length, piece_no, offset, content) from a table of objects; a NULL content has no pieces, an empty one a single empty piece."""
    n = B.size_of(content)
    starts = F.when(n.isNotNull(), F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long")), F.lit(piece).cast("long")))
    rows = objects.select(key, content, F.posexplode_outer(starts).alias("piece_no", "offset")).where("offset is not null")
    return rows.select(key, n.alias("length"), F.col("piece_no").cast("long").alias("piece_no"), "offset", B.slice_bytes(content, F.col("offset"), piece + halo).alias("content"))


def ends(pieces: DataFrame, size: int = 4096, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, length, head, tail) of objects whose first and last pieces are there: at most `size` bytes of each end. Pieces without halo, of `size` bytes and more."""
    own = lambda cond, value: F.max(F.when(cond, value))
    last = F.col("offset") + B.size_of("content") == F.col("length")
    tail = B.slice_bytes("content", F.greatest(F.lit(0).cast("long"), B.size_of("content") - size), size)
    return pieces.groupBy(*keys).agg(F.max("length").alias("length"), own(F.col("piece_no") == 0, B.slice_bytes("content", 0, size)).alias("head"), own(last, tail).alias("tail"))


def write_objects(parts: DataFrame, folder: str, key: str = "path") -> None:
    """Rows (key, part_no, bytes) as one file an object in `folder`, named by `object_name`. Objects are spread over tasks by path and streamed part by part."""
    parts.sparkSession.dataSource.register(PieceSource)
    rows = parts.select(F.col(key).cast("string").alias("path"), F.col("part_no").cast("long").alias("part_no"), "bytes")
    rows.repartition("path").sortWithinPartitions("path", "part_no").write.format("pieces").mode("append").save(folder)
