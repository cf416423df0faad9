"""Snapshot versions written by tasks: a Python data source with the commit and abort of Spark's write protocol.

Each task writes its rows as one compressed part below a temporary folder and reports its count, size
and hashes. The commit compares the counts with what was expected, drops parts of attempts that
did not win, writes the descriptor and renames the folder; a failing task or commit removes it, and
what tasks that still ran may leave of it goes with the next version that is published. Which
version is current is one small file per dataset, replaced at once, so that readers and syncs of
other datasets never wait. Files are reached through Arrow's file systems: local or mounted
folders, HDFS, S3, GCS.

The content's hash is the sum of the rows' 128-bit hashes: equal rows give the same one however
they lie in parts, and Spark computes it again from what is read back.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

LARGE_BYTES, HALF = 45 << 20, 1 << 64


class SnapshotError(RuntimeError):
    def __init__(self, kind: str, message: str):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder, and the folder's path in it."""
    if "://" in folder or folder.startswith("file:"):
        found, path = pafs.FileSystem.from_uri(quote(folder, safe="/:@?=&%+"))
        return found, path.rstrip("/")
    return pafs.LocalFileSystem(), folder.rstrip("/")


def read_json(folder: str, name: str) -> dict | None:
    system, base = opened(folder)
    if system.get_file_info(f"{base}/{name}").type == pafs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{base}/{name}", compression=None) as f:
        return json.loads(f.read())


def write_json(folder: str, name: str, doc: object) -> None:
    """Written beside and put in place at once."""
    system, base = opened(folder)
    staged = f"{base}/.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(staged, compression=None) as f:
        f.write(json.dumps(doc, ensure_ascii=False, indent=1).encode())
    system.move(staged, f"{base}/{name}")


def names(folder: str) -> list[str]:
    """The folder's entries; none if there is no such folder."""
    system, base = opened(folder)
    return sorted(x.base_name for x in system.get_file_info(pafs.FileSelector(base, allow_not_found=True)))


def remove(folder: str) -> None:
    system, base = opened(folder)
    if system.get_file_info(base).type == pafs.FileType.Directory:
        system.delete_dir(base)


def content_sums(line: Column) -> list[Column]:
    """The two sums that content_hash() puts together, from lines that are read back."""
    digest = F.md5(line)
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    return [F.sum(half(1)).cast("decimal(38,0)").alias("high_sum"), F.sum(half(17)).cast("decimal(38,0)").alias("low_sum")]


def content_hash(rows: int, high: int, low: int) -> str:
    return f"{rows:x}-{int(high or 0) % HALF:016x}{int(low or 0) % HALF:016x}"


@dataclass
class Part(WriterCommitMessage):
    name: str | None
    rows: int
    bytes: int
    sha256: str
    high_sum: int
    low_sum: int


class _Digested:
    """An output that keeps the hash and size of what it gets."""

    def __init__(self, out: object):
        self._out, self.sha256, self.size = out, hashlib.sha256(), 0

    def write(self, data: bytes) -> int:
        self.sha256.update(data)
        self.size += len(data)
        self._out.write(data)
        return len(data)

    def flush(self) -> None:
        pass


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.version = f"{options['path'].rstrip('/')}/{options['dataset']}", options["version"]
        self.expected = int(options["expected"]) if options.get("expected") else None
        self.descriptor = json.loads(options.get("descriptor", "{}"))

    @property
    def staged(self) -> str:
        return f"{self.folder}/.tmp-{self.version}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, base = opened(self.staged)
        out, found, high, low, rows = None, None, 0, 0, 0
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.jsonl.gz"
        for batch in iterator:
            for line in batch.column(0).to_pylist():
                if out is None:
                    system.create_dir(base, recursive=True)
                    raw = system.open_output_stream(f"{base}/{name}", compression=None)
                    found = _Digested(raw)
                    out = gzip.GzipFile("", "wb", fileobj=found, mtime=0)
                data = line.encode()
                digest = hashlib.md5(data).digest()
                high, low, rows = high + int.from_bytes(digest[:8]), low + int.from_bytes(digest[8:]), rows + 1
                out.write(data + b"\n")
        if out is None:
            return Part(None, 0, 0, "", 0, 0)
        out.close()
        raw.close()
        return Part(name, rows, found.size, found.sha256.hexdigest(), high % HALF, low % HALF)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m and m.name), key=lambda m: m.name)
        rows = sum(p.rows for p in parts)
        if not rows:
            raise SnapshotError("empty", "no rows")
        if self.expected is not None and rows != self.expected:
            raise SnapshotError("count", f"{rows} rows of {self.expected}")
        system, base = opened(self.staged)
        sizes = {x.base_name: x.size for x in system.get_file_info(pafs.FileSelector(base))}
        if odd := [p.name for p in parts if sizes.get(p.name) != p.bytes]:
            raise SnapshotError("write", f"parts differ from what was written: {odd[:3]}")
        for lost in sizes.keys() - {p.name for p in parts}:  # of attempts that failed or were not needed
            system.delete_file(f"{base}/{lost}")
        size = sum(p.bytes for p in parts)
        digest = content_hash(rows, sum(p.high_sum for p in parts), sum(p.low_sum for p in parts))
        meta = self.descriptor | {"version": self.version, "row_count": rows, "content_hash": digest, "bytes": size, "storage": "release" if size > LARGE_BYTES else "folder"}
        listed = [{k: v for k, v in asdict(p).items() if k in ("name", "rows", "bytes", "sha256")} for p in parts]
        write_json(self.staged, "snapshot.json", meta | {"parts": listed})
        system.move(base, opened(f"{self.folder}/{self.version}")[1])

    def abort(self, messages: list[Part | None]) -> None:
        remove(self.staged)


class SnapshotSink(DataSource):
    """lines.write.format("snapshot") with the options dataset, version, expected and descriptor: one column of text."""

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SnapshotSink)
