"""Reading documents of several kinds, importing them by content, verified reads, derived artifacts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_CHARACTERS = 2_000_000


def import_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, size, hash, content: one row for each distinct content, the first path by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    hashed = files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"), "content")
    first = hashed.groupBy("hash").agg(F.min("path").alias("path"))
    return hashed.join(first, ["hash", "path"]).select("path", "size", "hash", "content")


def import_bytes(spark: SparkSession, rows: list[tuple[str, bytes]]) -> DataFrame:
    """path, size, hash, content of contents in memory."""
    frame = spark.createDataFrame(rows, "path string, content binary")
    return frame.select("path", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("hash"), "content")


def verified(blobs: DataFrame) -> DataFrame:
    """Adds intact: whether the content still has its hash (column hash)."""
    return blobs.withColumn("intact", F.sha2("content", 256) == F.col("hash"))


def blob_listing(spark: SparkSession, path: str) -> DataFrame:
    """hash (the file's name), actual_size, actual_hash: what an integrity audit holds artifacts against."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("hash"), F.col("length").alias("actual_size"), F.sha2("content", 256).alias("actual_hash"))


def decoded_text(content: Column) -> Column:
    """UTF-8, or Latin-1 where the bytes aren't valid UTF-8."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_texts(files: DataFrame, most: int = MAX_CHARACTERS) -> DataFrame:
    """path, text, error from path and content of text files."""
    text = decoded_text(F.col("content"))
    long = F.length(text) > most
    return files.select("path", F.when(~long, text).alias("text"), F.when(long, F.lit(f"more than {most} characters")).alias("error"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def hybrid_pages(pages: DataFrame, least: int = 30) -> DataFrame:
    """pages: doc_id, page, native, recognized. Native text, or recognised text where the native is short and the other longer."""
    native, other = F.trim(F.coalesce("native", F.lit(""))), F.trim(F.coalesce("recognized", F.lit("")))
    take = (F.length(native) < least) & (F.length(other) > F.length(native))
    text = F.when(take, other).otherwise(native)
    status = F.when(text == "", F.lit("empty")).when(take, F.lit("ocr")).otherwise(F.lit("native"))
    shown = F.when(text == "", F.concat(F.lit("*Página "), F.col("page").cast("string"), F.lit(" vazia.*"))).otherwise(text)
    return pages.select("doc_id", "page", status.alias("status"), shown.alias("text"))


def joined_pages(pages: DataFrame) -> DataFrame:
    """doc_id, pages, text: hybrid pages behind their markers, separated by rules."""
    marked = F.concat(F.lit("<!-- PAGE page="), F.col("page").cast("string"), F.lit(" status="), F.col("status"), F.lit(" -->\n\n"), F.col("text"))
    rows = pages.select("doc_id", "page", marked.alias("part"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("pages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "part"))), lambda x: x["part"]), "\n\n---\n\n").alias("text"))


def commit_derived(root: str, artifacts: DataFrame, operation: DataFrame, inputs: DataFrame, outputs: DataFrame) -> str:
    """Appends artifacts and edges, and the operation row last: its presence commits the others. Returns the batch's id."""
    batch = uuid.uuid4().hex
    for name, frame in (("artifacts", artifacts), ("operation_inputs", inputs), ("operation_outputs", outputs), ("operations", operation)):
        frame.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{root}/{name}")
    return batch


def committed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Rows of a table whose batch has its operation."""
    operations = spark.read.parquet(f"{root}/operations").select("batch").distinct()
    return spark.read.parquet(f"{root}/{name}").join(operations, "batch", "left_semi").drop("batch")


def text_revision_fits(mime_type: Column, text: Column, most: int = 16 << 20) -> Column:
    return F.coalesce(mime_type.isin("text/plain", "text/markdown") & (F.octet_length(text) <= most), F.lit(False))
