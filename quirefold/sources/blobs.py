r"""A store of contents by their hash, written by a data source with commit and abort.

    spark.dataSource.register(BlobStore)
    artifacts.write.format("quirefold_blobs").option("path", root).option("operation", id).mode("append").save()

Rows: document_id string, kind string, mime_type string, content binary, inputs array<string> (hashes that it was made of).
A task puts each content at root/blobs/<two digits>/<hash>, under a name of its own first, so a file is whole or not there
and writing it again changes nothing; the rows about its contents go to a file of the attempt. Commit publishes these
files by one small file, root/commits/<operation>.json, that names them: it is there as a whole or not at all, so readers
see all rows of an operation or none, edges with their artifacts. An operation that is committed already publishes
nothing more: a write that is repeated after a lost answer leaves one set of rows. Abort, and the commit of a repeated
operation, delete the attempts' files; contents that no row names are what orphan_blobs finds.

Null content: empty. Null inputs: none. The store must be one that Arrow opens (file, hdfs, s3, gs, abfs).
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS = pa.schema([("operation", pa.string()), ("artifact_id", pa.string()), ("document_id", pa.string()), ("kind", pa.string()), ("mime_type", pa.string()), ("hash", pa.string()), ("size", pa.int64()), ("inputs", pa.list_(pa.string()))])
FIELDS = "document_id string, kind string, mime_type string, content binary, inputs array<string>"
#: The hash of no content, which needs no file (and Spark's reader leaves empty files out).
EMPTY = hashlib.sha256(b"").hexdigest()
#: Rows about contents that a task holds before it writes them.
HELD = 10_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system for a path, and the path inside it."""
    if path.startswith(("file:", "/")):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path)


def is_file(fs: pafs.FileSystem, path: str) -> bool:
    return fs.get_file_info(path).type == pafs.FileType.File


def put(fs: pafs.FileSystem, root: str, content: bytes) -> str:
    """Stores a content once; its hash."""
    digest = hashlib.sha256(content).hexdigest()
    folder = f"{root}/blobs/{digest[:2]}"
    if content and not is_file(fs, f"{folder}/{digest}"):
        fs.create_dir(folder, recursive=True)
        own = f"{folder}/.{digest}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as out:
            out.write(content)
        fs.move(own, f"{folder}/{digest}")
    return digest


@dataclass
class Attempt(WriterCommitMessage):
    """A file of rows, and how many contents and bytes it tells of."""

    file: str
    rows: int
    bytes: int


class BlobWriter(DataSourceArrowWriter):
    def __init__(self, path: str, operation: str):
        self.path, self.operation = path, operation

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, root = file_system(self.path)
        fs.create_dir(f"{root}/rows", recursive=True)
        name, rows, count, size, out = f"{uuid.uuid4().hex}.parquet", [], 0, 0, None
        try:
            for batch in iterator:
                columns = [batch.column(f.split()[0]) for f in FIELDS.split(", ")]
                for document, kind, mime, content, inputs in zip(*columns):
                    data = content.as_py() or b""
                    digest = put(fs, root, data)
                    row = (self.operation, None, document.as_py(), kind.as_py(), mime.as_py(), digest, len(data), inputs.as_py() or [])
                    artifact = hashlib.sha256(json.dumps([self.operation, *row[2:]]).encode()).hexdigest()
                    rows.append((row[0], artifact, *row[2:]))
                    count, size = count + 1, size + len(data)
                    if len(rows) >= HELD:
                        out = self._flush(fs, root, name, rows, out)
            out = self._flush(fs, root, name, rows, out) if rows or out is None else out
        finally:
            if out is not None:
                out.close()
        return Attempt(name, count, size)

    @staticmethod
    def _flush(fs: pafs.FileSystem, root: str, name: str, rows: list[tuple], out: pq.ParquetWriter | None) -> pq.ParquetWriter:
        out = out or pq.ParquetWriter(f"{root}/rows/{name}", ROWS, filesystem=fs)
        out.write_table(pa.Table.from_pylist([dict(zip(ROWS.names, r, strict=True)) for r in rows], schema=ROWS))
        rows.clear()
        return out

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, root = file_system(self.path)
        done = f"{root}/commits/{self.operation}.json"
        if is_file(fs, done):
            self.abort(messages)
            return
        fs.create_dir(f"{root}/commits", recursive=True)
        own = f"{root}/commits/.{uuid.uuid4().hex}"
        made = [m for m in messages if m]
        with fs.open_output_stream(own) as out:
            out.write(json.dumps({"operation": self.operation, "files": [m.file for m in made], "rows": sum(m.rows for m in made), "bytes": sum(m.bytes for m in made)}).encode())
        fs.move(own, done)

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m and is_file(fs, f"{root}/rows/{m.file}"):
                fs.delete_file(f"{root}/rows/{m.file}")


class BlobStore(DataSource):
    """Options: path; operation, an identifier of letters, digits, dashes and underscores (a new one if none is given)."""

    @classmethod
    def name(cls) -> str:
        return "quirefold_blobs"

    def schema(self) -> str:
        return FIELDS

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        missing = {f.split()[0] for f in FIELDS.split(", ")} - set(schema.names)
        operation = self.options.get("operation") or uuid.uuid4().hex
        if overwrite or missing or "path" not in self.options or not operation.replace("-", "").replace("_", "").isalnum():
            raise ValueError(f"append rows with {FIELDS}, a path, and an operation of letters and digits")
        return BlobWriter(self.options["path"], operation)


def write_artifacts(artifacts: DataFrame, root: str, operation: str) -> None:
    """Stores contents and publishes their rows as one operation; again, and nothing changes."""
    artifacts.sparkSession.dataSource.register(BlobStore)
    artifacts.select(*(f.split()[0] for f in FIELDS.split(", "))).write.format("quirefold_blobs").option("path", root).option("operation", operation).mode("append").save()


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """operation, artifact_id, document_id, kind, mime_type, hash, size, inputs of committed operations: files that a commit names."""
    commits = spark.read.schema("operation string, files array<string>").json(f"{root}/commits/*.json")
    named = commits.select(F.explode("files").alias("file"))
    kinds = "operation string, artifact_id string, document_id string, kind string, mime_type string, hash string, size long, inputs array<string>"
    rows = spark.read.schema(kinds).parquet(f"{root}/rows").withColumn("file", F.col("_metadata.file_name"))
    return rows.join(named, "file", "left_semi").drop("file")


def artifact_edges(artifacts: DataFrame) -> DataFrame:
    """operation, input_hash, artifact_id: what each artifact was made of."""
    return artifacts.select("operation", F.explode("inputs").alias("input_hash"), "artifact_id")


def read_contents(spark: SparkSession, root: str) -> DataFrame:
    """hash, actual_size, intact: the stored files, each held against the hash in its name, and the empty content. Unfinished files are hidden ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/blobs")
    name = F.element_at(F.split("path", "/"), -1)
    found = files.filter(~F.startswith(name, F.lit("."))).select(name.alias("hash"), F.col("length").alias("actual_size"), (F.sha2("content", 256) == name).alias("intact"))
    return found.unionByName(spark.range(1).select(F.lit(EMPTY).alias("hash"), F.lit(0).cast("long").alias("actual_size"), F.lit(True).alias("intact")))


def orphan_blobs(spark: SparkSession, root: str) -> DataFrame:
    """Stored contents that no committed row names."""
    return read_contents(spark, root).filter(F.col("hash") != EMPTY).join(read_artifacts(spark, root).select("hash"), "hash", "left_anti")
