"""A slot for translation engines: segments in, segments out, placeholders checked. No engine is included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .segments import line_segments, mask_placeholders, restore_placeholders

Backend = Callable[[pd.Series], pd.Series]


def identity_backend(texts: pd.Series) -> pd.Series:
    """Returns its input. It translates nothing; it exists so that the flow around an engine can run and be tested."""
    return texts


def translate(docs: DataFrame, backend: Backend = identity_backend) -> DataFrame:
    """doc_id, text, error: segments are masked, sent through the backend in Arrow batches, restored and joined in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(masked=backend(frame["masked"]))

    masked = line_segments(docs).withColumn("m", mask_placeholders(F.col("segment"))).select("doc_id", "seq", "m.masked", "m.placeholders")
    done = masked.mapInPandas(run, masked.schema)
    restored = done.withColumn("r", restore_placeholders(F.col("masked"), F.col("placeholders"))).select("doc_id", "seq", F.col("r.text").alias("part"), F.col("r.error").alias("error"))
    joined = restored.groupBy("doc_id").agg(F.max("error").alias("error"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "").alias("text"))
    return joined.select("doc_id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")
