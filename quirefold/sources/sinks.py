"""Writing tables and reports: CSV with guarded cells, typed cells, JSON, Markdown and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import csv_cell, typed_cell


def csv_line(cells: Column, delimiter: str = ",") -> Column:
    return F.array_join(F.transform(cells, lambda c: csv_cell(c, delimiter)), delimiter)


def write_csv_rows(rows: DataFrame, path: str, delimiter: str = ",") -> None:
    """rows: doc_id, page, row, cells. A folder for each document; inside, lines in order."""
    lines = rows.select("doc_id", "page", "row", csv_line(F.col("cells"), delimiter).alias("value"))
    lines.repartition("doc_id").sortWithinPartitions("doc_id", "page", "row").select("doc_id", "value").write.mode("overwrite").partitionBy("doc_id").text(path)


def typed_rows(rows: DataFrame) -> DataFrame:
    """doc_id, page, row, column, text, kind, value, style: one row for each cell, as a workbook would hold it."""
    cells = rows.select("doc_id", "page", "row", F.posexplode("cells").alias("column", "text"))
    return cells.select("*", typed_cell(F.col("text")).alias("cell")).select("doc_id", "page", "row", "column", "text", "cell.kind", "cell.value", "cell.style")


def report_json(frame: DataFrame, *drop: str) -> DataFrame:
    """value: each row as JSON, without bulky columns."""
    kept = frame.drop(*drop)
    return kept.select(F.to_json(F.struct(*kept.columns)).alias("value"))


def write_report(frame: DataFrame, path: str, *drop: str) -> None:
    report_json(frame, *drop).write.mode("overwrite").text(path)
