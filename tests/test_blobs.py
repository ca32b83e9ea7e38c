"""The content store: one copy of each content, operations that are there as a whole, repeats without effect."""

import os

import pytest
from pyspark.sql import functions as F

from quirefold.sources import blobs


def artifacts(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], blobs.FIELDS + ", extra string")


def stored(spark, root):
    return {(r.operation, r.document_id, r.kind, r.size, tuple(r.inputs)) for r in blobs.read_artifacts(spark, root).collect()}


def test_write_repeat_and_read_back(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = [("d1", "ORIGINAL", "text/plain", b"abc", None), ("d2", "ORIGINAL", "text/plain", b"abc", []), ("d3", "ORIGINAL", "text/plain", None, None)]
    blobs.write_artifacts(artifacts(spark, rows).repartition(3), root, "op-1")
    first = stored(spark, root)
    assert first == {("op-1", "d1", "ORIGINAL", 3, ()), ("op-1", "d2", "ORIGINAL", 3, ()), ("op-1", "d3", "ORIGINAL", 0, ())}
    blobs.write_artifacts(artifacts(spark, rows), root, "op-1")
    assert stored(spark, root) == first and blobs.read_artifacts(spark, root).count() == 3
    (same,) = {r.hash for r in blobs.read_artifacts(spark, root).filter("size = 3").collect()}
    blobs.write_artifacts(artifacts(spark, [("d1", "DERIVED", "text/plain", b"ABC", [same])]), root, "op-2")
    edges = blobs.artifact_edges(blobs.read_artifacts(spark, root)).collect()
    assert [(e.operation, e.input_hash) for e in edges] == [("op-2", same)]
    contents = blobs.read_contents(spark, root).collect()
    assert len(contents) == 3 and all(c.intact for c in contents)
    assert blobs.orphan_blobs(spark, root).count() == 0


def test_failed_write_publishes_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    blobs.write_artifacts(artifacts(spark, [("d0", "k", "m", b"zero", None)]), root, "op-0")
    broken = artifacts(spark, [(f"d{k}", "k", "m", b"%d" % k, None) for k in range(8)]).repartition(4)
    broken = broken.withColumn("content", F.when(F.col("document_id") == "d5", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="lost"):
        blobs.write_artifacts(broken, root, "op-1")
    assert stored(spark, root) == {("op-0", "d0", "k", 4, ())}
    assert os.listdir(tmp_path / "store/commits") == ["op-0.json"]


def test_abort_deletes_the_attempts_files(spark, tmp_path):
    import pyarrow as pa

    writer = blobs.BlobWriter(f"file://{tmp_path}", "op")
    kinds = pa.schema([("document_id", pa.string()), ("kind", pa.string()), ("mime_type", pa.string()), ("content", pa.binary()), ("inputs", pa.list_(pa.string()))])
    batch = pa.RecordBatch.from_pylist([{"document_id": "d", "kind": "k", "mime_type": "m", "content": b"x", "inputs": None}], schema=kinds)
    messages = [writer.write(iter([batch])), writer.write(iter([])), None]
    assert len(os.listdir(tmp_path / "rows")) == 2
    writer.abort(messages)
    assert os.listdir(tmp_path / "rows") == []
    assert blobs.orphan_blobs(spark, f"file://{tmp_path}").count() == 1 if os.path.isdir(tmp_path / "commits") else True


def test_damaged_content_is_found(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    blobs.write_artifacts(artifacts(spark, [("d", "k", "m", b"right", None)]), root, "op")
    (path,) = [os.path.join(d, f) for d, _, fs in os.walk(tmp_path / "store/blobs") for f in fs]
    with open(path, "wb") as f:
        f.write(b"wrong")
    assert [c.intact for c in blobs.read_contents(spark, root).filter(F.col("hash") != blobs.EMPTY).collect()] == [False]


def test_wrong_options(spark, tmp_path):
    with pytest.raises(Exception, match="append rows"):
        blobs.write_artifacts(artifacts(spark, []), f"file://{tmp_path}", "a/b")
