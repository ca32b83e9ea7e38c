"""Overlap joins of intervals: pairs, rows that overlap nothing, and greedy acceptance, without comparing all rows of a key.

An interval belongs to a level by its length and touches few grid cells of that level's width. It is put into the cells it
touches at its own level and at those higher levels that the other side has, so any two intervals meet at the level of the
longer one, by an equi-join on (keys, level, cell); a pair is kept in the cell of the later start alone. However many
intervals one key has, they are spread over cells, and a long interval costs no more rows than a short one.

Two intervals overlap if each begins before the other ends: ends are exclusive. An empty interval overlaps what it lies
strictly inside of. Null starts, ends and keys overlap nothing.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: Width of a cell at level 0, and the factor to the next level.
WIDTH, FACTOR, LEVELS = 64, 16, 10
#: Overlapping candidates up to this many are accepted by a fold; more, by search in a sorted list.
FOLDED = 64


class Taken:
    """Disjoint spans, kept sorted."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def add(self, start: int, end: int) -> bool:
        """Takes the span unless it overlaps one that is taken."""
        k = bisect_right(self.starts, start)
        if (k and self.ends[k - 1] > start) or (k < len(self.starts) and self.starts[k] < end):
            return False
        self.starts.insert(k, start)
        self.ends.insert(k, end)
        return True


def _level(start: Column, end: Column) -> Column:
    found = F.when(end - start <= WIDTH, 0)
    for k in range(1, LEVELS - 1):
        found = found.when(end - start <= WIDTH * FACTOR**k, k)
    return found.otherwise(LEVELS - 1)


def _rest(df: DataFrame, keys: list[str], start: str, end: str) -> list[str]:
    """Columns that keys, s and e don't give back."""
    whole = [c for c in (start, end) if isinstance(df.schema[c].dataType, IntegralType)]
    return [c for c in df.columns if c not in (*keys, *whole)]


def _leveled(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Keys, s, e, level and row (all other columns, if there are any)."""
    s, e, rest = F.col(start).cast("long"), F.col(end).cast("long"), _rest(df, keys, start, end)
    rows = df.select(*keys, s.alias("s"), e.alias("e"), *([F.struct(*rest).alias("row")] if rest else []))
    return rows.filter(F.col("s").isNotNull() & F.col("e").isNotNull()).withColumn("level", _level(F.col("s"), F.col("e")))


def _as_given(df: DataFrame, side: str, keys: list[str], start: str, end: str) -> Column:
    """The row of a side with all columns in their order and of their types."""
    rest, at = _rest(df, keys, start, end), {start: "s", end: "e"}
    column = lambda c: F.col(f"{side}.row.{c}") if c in rest else F.col(f"{side}.{at.get(c, c)}").cast(df.schema[c].dataType)
    return F.struct(*(column(c).alias(c) for c in df.columns))


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur: at most LEVELS numbers."""
    return sorted(r.level for r in df.select("level").distinct().collect())


def _width(level: Column) -> Column:
    return F.element_at(F.array(*(F.lit(WIDTH * FACTOR**k) for k in range(LEVELS))), level + 1)


def _in_cells(rows: DataFrame, levels: list[int]) -> DataFrame:
    """A row for each cell at the interval's own level and the given higher ones: slot, which is cell and level in one number."""
    higher = F.filter(F.array(*(F.lit(k) for k in levels)), lambda k: k > F.col("level"))
    spread = rows.withColumn("at", F.explode(F.concat(F.array("level"), higher)))
    width = _width(F.col("at"))
    first, last = F.floor(F.col("s") / width), F.floor(F.greatest(F.col("e") - 1, F.col("s")) / width)
    cells = spread.withColumn("cell", F.explode(F.sequence(first, last)))
    return cells.withColumn("slot", F.shiftleft("cell", 4).bitwiseOR(F.col("at").cast("long"))).drop("level", "at", "cell")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """l, r: all pairs of a left and a right row that have equal keys and overlap, as structs of their columns."""
    a, b = _leveled(left, keys, start, end), _leveled(right, keys, start, end)
    a, b = _in_cells(a, _levels(b)).alias("a"), _in_cells(b, _levels(a)).alias("b")
    return a.join(b, _meet(keys)).select(_as_given(left, "a", keys, start, end).alias("l"), _as_given(right, "b", keys, start, end).alias("r"))


def _meet(keys: list[str]) -> Column:
    col = F.col
    same = [col(f"a.{c}") == col(f"b.{c}") for c in (*keys, "slot")]
    at, cell = col("a.slot").bitwiseAND(F.lit(15)).cast("int"), F.shiftright("a.slot", 4)
    level = F.greatest(_level(col("a.s"), col("a.e")), _level(col("b.s"), col("b.e")))
    once = (at == level) & (cell == F.floor(F.greatest("a.s", "b.s") / _width(at)))
    found = (col("a.s") < col("b.e")) & (col("a.e") > col("b.s")) & once
    for c in same:
        found = c & found
    return found


def without_overlaps(rows: DataFrame, others: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The rows that overlap none of the others. Equal intervals are looked up once, whatever else their rows hold."""
    distinct = lambda df: _leveled(df.select(*keys, start, end).distinct(), keys, start, end).drop("row")
    a, b = distinct(rows), distinct(others)
    a, b = _in_cells(a, _levels(b)).alias("a"), _in_cells(b, _levels(a)).alias("b")
    hit = a.join(b, _meet(keys), "left_semi").select(*keys, F.col("s"), F.col("e")).distinct().alias("h")
    same = [F.col(f"x.{c}") == F.col(f"h.{c}") for c in keys]
    on = (F.col(f"x.{start}") == F.col("h.s")) & (F.col(f"x.{end}") == F.col("h.e"))
    for c in same:
        on = c & on
    return rows.alias("x").join(hit, on, "left_anti")


def islands(rows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """rows with island: a number for each run of intervals that overlap one after the other; what overlaps shares an island."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) < reach, 0).otherwise(1)
    return rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def accept_spans(candidates: DataFrame, keys: list[str], order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Candidates in the given order, each accepted unless it overlaps one accepted before. Islands are decided apart.

    Ties of the order: by start, then end. Islands of up to FOLDED candidates by a fold over an array, larger ones by search.
    """
    columns = candidates.columns
    row = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(order)), F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), F.struct(*columns).alias("row"))
    placed = islands(candidates, keys, start, end)
    sized = placed.withColumn("size", F.count("*").over(Window.partitionBy(*keys, "island")))
    alone = sized.filter("size = 1").select(*columns)
    few = sized.filter(f"size BETWEEN 2 AND {FOLDED}").groupBy(*keys, "island").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    none = F.slice(F.col("rows"), 1, 0)

    def step(taken: Column, x: Column) -> Column:
        return F.when(F.exists(taken, lambda t: (t["s"] < x["e"]) & (t["e"] > x["s"])), taken).otherwise(F.concat(taken, F.array(x)))

    folded = few.select(F.explode(F.aggregate("rows", none, step)).alias("x")).select("x.row.*")
    first = [*order, start, end]

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        taken, ordered = Taken(), frame.sort_values(first, kind="stable")
        return ordered[[taken.add(int(s), int(e)) for s, e in zip(ordered[start], ordered[end], strict=True)]][columns]

    many = sized.filter(f"size > {FOLDED}").groupBy(*keys, "island").applyInPandas(search, candidates.schema)
    return alone.unionByName(folded).unionByName(many)
