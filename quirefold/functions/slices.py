"""Python over few rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows that a task holds as Python objects at once, with what is made of them.
ROWS = 64


def map_slices(df: DataFrame, scan: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, rows: int = ROWS) -> DataFrame:
    """mapInPandas for long texts and files: Spark's batches, up to 10,000 rows of any weight, stay Arrow data but for a slice.

    scan must answer each frame by one frame.
    """
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (batch.slice(k, rows).to_pandas(integer_object_nulls=True) for batch in batches for k in range(0, batch.num_rows, rows))
        for frame in scan(slices):
            yield pa.RecordBatch.from_pandas(frame, schema=target, preserve_index=False)

    return df.mapInArrow(run, schema)
