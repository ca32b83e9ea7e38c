"""Exact order statistics of groups of any size: counts by bins first, then only the bin that holds the rank.

A pass counts each open group's values in BINS bins between its bounds (added up inside tasks, so a group moves as many
rows as it has bins and tasks), takes the bin with the wanted rank, and makes that bin's least and greatest value the new
bounds. When a bin holds few values, or one value many times, its distinct values are counted and the rank is read off.
Bounds and ranks are a row for each group and wanted statistic; no group's values meet in one buffer.

Null values: not counted; NaN: not counted, or as the greatest value. A group without values: null statistics. Equal values: one value with a count.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

BINS = 1024
#: A bin of so many distinct values is read off.
FEW = 4096


def nearest_rank(share: float) -> Column:
    """The rank, from 1, of the smallest value that at least a share of the n values doesn't exceed."""
    return F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share)).cast("long"))


def upper_median_rank() -> Column:
    """The rank of the greater of two middle values."""
    return F.floor(F.col("n") / 2).cast("long") + 1


def select_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], bins: int = BINS, few: int = FEW, nan_last: bool = False) -> DataFrame:
    """keys and, for each entry of ranks, the value of that rank in its group. A rank is an expression over the group's size n.

    nan_last: NaN counts as the greatest value.
    """
    x = F.col(value).cast("double")
    counted = x if nan_last else F.when(~F.isnan(x), x)
    rows = rows.select(*keys, F.when(~F.isnan(x), x).alias("x"), counted.alias("counted"))
    held = rows.select(*keys, "x")
    with scratch(rows.sparkSession, "selection") as made:
        sizes = made.write(rows.groupBy(*keys).agg(F.count("counted").alias("n"), F.count("x").alias("inside"), F.min("x").alias("lo"), F.max("x").alias("hi")))
        wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("stat"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
        asked = sizes.select(*keys, "lo", "hi", "n", "inside", wanted.alias("w")).select(*keys, "w.stat", "w.rank", "lo", "hi", "inside", "n")
        beyond = asked.filter((F.col("rank") > F.col("inside")) & (F.col("rank") <= F.col("n"))).select(*keys, "stat", F.lit(float("nan")).alias("x"))
        open_rows = made.write(asked.filter((F.col("rank") >= 1) & (F.col("rank") <= F.col("inside"))).drop("n"))
        found = []
        while True:
            settled = (F.col("lo") == F.col("hi")) | (F.col("inside") <= few)
            found.append(open_rows.filter(settled))
            open_rows = open_rows.filter(~settled)
            if open_rows.isEmpty():
                break
            open_rows = made.write(_narrowed(held, open_rows, keys, bins))
        last = found[0]
        for f in found[1:]:
            last = last.unionByName(f)
        last = made.write(last)
        one = last.filter("lo = hi").select(*keys, "stat", F.col("lo").alias("x"))
        more = _matched(held, last.filter("lo < hi"), keys).groupBy(*keys, "stat", "rank", "x").agg(F.count("*").alias("c"))
        order = Window.partitionBy(*keys, "stat").orderBy("x")
        upto = more.withColumn("upto", F.sum("c").over(order)).filter(F.col("upto") >= F.col("rank")).groupBy(*keys, "stat").agg(F.min("x").alias("x"))
        values = one.unionByName(upto).unionByName(beyond)
        wide = values.groupBy(*keys).agg(*(F.max(F.when(F.col("stat") == name, F.col("x"))).alias(name) for name in ranks))
        return made.write(with_statistics(sizes.select(*keys), wide, keys))


def with_statistics(groups: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Every group, null keys too."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"g.{k}").eqNullSafe(F.col(f"w.{k}"))
    return groups.alias("g").join(wide.alias("w"), on, "left").select("g.*", *(f"w.{c}" for c in wide.columns if c not in keys))


def _matched(held: DataFrame, states: DataFrame, keys: list[str]) -> DataFrame:
    """The values between the bounds of each state of their group."""
    on = (F.col("v.x") >= F.col("s.lo")) & (F.col("v.x") <= F.col("s.hi"))
    for k in keys:
        on = on & F.col(f"v.{k}").eqNullSafe(F.col(f"s.{k}"))
    return held.alias("v").join(states.alias("s"), on).select("s.*", "v.x")


def _narrowed(held: DataFrame, states: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """States with the bounds of the bin that holds their rank, and the rank inside it."""
    least, most, infinity = F.greatest("lo", F.lit(-sys.float_info.max)), F.least("hi", F.lit(sys.float_info.max)), float("inf")
    share = (F.col("x") - least) / (most - least)
    # halves before the difference, lest it overflow
    share = F.when(most / 2 - least / 2 > 8e307, (F.col("x") / 2 - least / 2) / (most / 2 - least / 2)).otherwise(share)
    # infinities have bins of their own
    number = F.when(F.col("x") == -infinity, -1).when(F.col("x") == infinity, bins).otherwise(F.least(F.lit(bins - 1), F.floor(share * bins))).cast("int")
    counted = _matched(held, states, keys).groupBy(*keys, "stat", "rank", number.alias("bin")).agg(F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    before = F.coalesce(F.sum("c").over(Window.partitionBy(*keys, "stat").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("before", before).filter((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("c")))
    return placed.select(*keys, "stat", (F.col("rank") - F.col("before")).alias("rank"), "lo", "hi", F.col("c").alias("inside"))
