"""Helpers for queries: tables, columns derived from them, and inline rows, which both engines see alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, list):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    return f"CAST({value!r} AS DOUBLE)" if isinstance(value, float) else repr(value)


class Rows:
    """Inline rows: a frame for Spark, a VALUES table for SQL."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        self.names = [c.split()[0] for c in schema.split(", ")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    @property
    def sql(self) -> str:
        return f"(VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in self.rows)}) AS t({', '.join(self.names)})"


class Table:
    """Rows derived from a standard table by one SELECT in words that both engines know."""

    def __init__(self, select: str):
        self.select = select

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        names = set(re.findall(r"\b(?:FROM|JOIN) (\w+)", self.select))
        select = self.select.replace("{", "{{").replace("}", "}}")  # the tables' places are the only ones to fill
        return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", r"\1 {\2}", select), **{n: load(spark, sf_dir, n) for n in names})

    @property
    def sql(self) -> str:
        return f"({self.select}) AS t"
