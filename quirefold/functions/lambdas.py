"""Small pieces for expressions made of lambdas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it (inside other lambdas Spark would repeat it)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without_last(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def grouped(items: Column, empty: Column, joins: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column], begin: Callable[[Column], Column]) -> Column:
    """A fold over an array: each item joins the last group (merge) if joins says so, else begins a group of its own.

    empty: an empty array of groups, which gives the type. One pass; the state never holds more than the items so far.
    """

    def step(groups: Column, item: Column) -> Column:
        last = F.try_element_at(groups, F.lit(-1))
        fits = (F.size(groups) > 0) & joins(last, item)
        return F.when(fits, F.concat(without_last(groups), F.array(merge(last, item)))).otherwise(F.concat(groups, F.array(begin(item))))

    return F.aggregate(items, empty, step)
