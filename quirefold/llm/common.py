"""Shared pieces: scratch tables, word splitting, row keys."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but these six characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WORD_BREAKS = " \t\n\x0b\x0c\r"
#: Stands for a null id inside an operator; sorts before all others.
NULL_ID = -(2**63)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set: a temporary one on a single machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if root is None and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if root is None:
        root = "file://" + tempfile.mkdtemp(prefix="quirefold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/quirefold/{name}-{uuid.uuid4().hex}"


#: Tables written inside each open `cleared` block, by path.
_made: list[dict[str, DataFrame]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    for made in _made[-1:]:
        made[path] = table
    return table


@contextmanager
def cleared(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that stored() writes inside the block, but for those given to the function it yields."""
    made: dict[str, DataFrame] = {}
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _made.append(made)
    try:
        yield keep
    finally:
        _made.pop()
        for path, table in made.items():
            if not any(table is k for k in kept):
                delete_folder(spark, path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote and nothing reads any more, and lets Spark drop the shuffles behind them."""
    for df in tables:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete_folder(df.sparkSession, folder)
    release(tables[0].sparkSession if tables else None)


def release(spark: SparkSession | None) -> None:
    """Shuffle files go once the driver's garbage collector has seen that nothing refers to them."""
    gc.collect()
    if spark is not None:
        spark.sparkContext._jvm.System.gc()


def row_key(id_column: str = "doc_id", text_column: str = "text") -> list[Column]:
    """did and th: rows with equal keys are equal in id and text, so whatever joins on them treats repeated rows alike."""
    return [
        F.coalesce(F.col(id_column).cast("long"), F.lit(NULL_ID)).alias("did"),
        F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("th"),
    ]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
