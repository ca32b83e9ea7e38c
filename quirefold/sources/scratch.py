"""Tables between the rounds of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


class Scratch:
    """Writes tables into a folder of its own; their lineage ends there, so lost executors cost nothing but a read."""

    def __init__(self, spark: SparkSession, name: str):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if root is None:
            found = spark.sparkContext._jsc.sc().getCheckpointDir()
            root = found.get() if found.isDefined() else None
        if root is None and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        self.spark = spark
        self.path = f"{(root or 'file://' + tempfile.mkdtemp(prefix='quirefold-')).rstrip('/')}/quirefold/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def delete(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[Scratch]:
    """A scratch folder that goes if the block fails; the caller deletes it otherwise, once nothing reads it."""
    made = Scratch(spark, name)
    try:
        yield made
    except BaseException:
        made.delete()
        raise
