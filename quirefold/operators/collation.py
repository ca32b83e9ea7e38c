"""Order and search as readers expect them: Spark's collations, with or without case and accents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

READERS, LOOSE = "UNICODE", "UNICODE_CI_AI"


def collated_ranks(rows: DataFrame, keys: list[str], column: str, collation: str = LOOSE, name: str = "rank") -> DataFrame:
    """rows with a dense rank inside each group: what the collation holds equal shares a rank. Distinct values are ranked first, so a group is as large as it has values."""
    values = rows.select(*keys, column).distinct()
    order = Window.partitionBy(*keys).orderBy(F.collate(F.col(column), collation))
    ranked = values.withColumn(name, F.dense_rank().over(order))
    on = F.col(f"a.{column}").eqNullSafe(F.col(f"b.{column}"))
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return rows.alias("a").join(ranked.alias("b"), on).select("a.*", f"b.{name}")


def collated_search(text: Column, query: Column, collation: str = LOOSE) -> Column:
    """Whether the query occurs in the text, as the collation compares."""
    return F.contains(F.collate(text, collation), F.collate(query, collation))
