"""Overlap joins and greedy acceptance, held against all pairs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quirefold.operators import geometry, intervals, review

SCHEMA = "key int, start long, end long, name string"


def overlap(a, b):
    return a[0] is not None and a[0] == b[0] and None not in (*a[1:3], *b[1:3]) and a[1] < b[2] and a[2] > b[1]


def made(seed, n, keys=3, wide=9000):
    """Short, long and equal spans, at cell borders too."""
    r = random.Random(seed)
    rows = []
    for k in range(n):
        start = r.choice([r.randrange(-200, wide), 64 * r.randrange(wide // 64), 1024 * r.randrange(wide // 1024 + 1)])
        length = r.choice([1, r.randrange(1, 20), r.randrange(1, 300), 64, 1024, r.randrange(1, 20_000)])
        rows.append((r.randrange(keys), start, start + length, f"n{k}"))
    return rows


ODD = [(None, 1, 5, "x"), (1, None, 5, "y"), (1, 3, None, "z"), (1, 10, 10, "empty"), (1, 64, 64, "empty at a border"), (1, 5, 40, "a"), (1, 5, 40, "a")]


@pytest.mark.parametrize("seed", range(4))
def test_pairs_match_all_pairs(spark, seed):
    left, right = made(seed, 60) + ODD, made(seed + 100, 50) + ODD
    pairs = intervals.overlap_pairs(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["key"])
    got = sorted((tuple(p.l), tuple(p.r)) for p in pairs.collect())
    assert got == sorted((a, b) for a in left for b in right if overlap(a, b))


@pytest.mark.parametrize("seed", range(4))
def test_rows_without_overlaps(spark, seed):
    left, right = made(seed, 80, wide=40_000) + ODD, made(seed + 100, 6, wide=40_000) + ODD[:5]
    got = intervals.without_overlaps(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA), ["key"]).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(a) for a in left if not any(overlap(a, b) for b in right))


@pytest.mark.parametrize(("seed", "wide"), [(0, 9000), (1, 100_000), (2, 400), (3, 130)])
def test_acceptance_in_order(spark, seed, wide):
    """Islands below and above the size that is folded."""
    rows = [(*r[:3], f"{k % 7}") for k, r in enumerate(made(seed, 300, wide=wide)) if wide > 130 or r[2] - r[1] < 400]
    got = intervals.accept_spans(spark.createDataFrame(rows, SCHEMA), ["key"], ["name"]).collect()
    taken = []
    for r in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if not any(overlap(r, t) for t in taken):
            taken.append(r)
    assert sorted(tuple(r) for r in got) == sorted(taken)


def test_one_long_text_with_many_spans(spark):
    """100,000 spans of one key: no product of all rows, and time as for many keys."""
    spans = spark.range(100_000).select(F.lit(1).alias("key"), (F.col("id") * 30).alias("start"), (F.col("id") * 30 + F.when(F.col("id") % 9000 == 0, 200_000).otherwise(12)).alias("end"))
    guards = spark.range(30_000).select(F.lit(1).alias("key"), (F.col("id") * 100).alias("start"), (F.col("id") * 100 + 15).alias("end"))
    found = intervals.without_overlaps(spans, guards, ["key"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan
    began = time.time()
    got = {(r.start, r.end) for r in found.collect()}
    assert time.time() - began < 40
    assert got == {(s, s + 12) for s in range(0, 3_000_000, 30) if s // 30 % 9000 and s % 100 >= 15 and s % 100 + 12 <= 100}


def test_empty_sides(spark):
    rows, none = spark.createDataFrame(made(1, 5), SCHEMA), spark.createDataFrame([], SCHEMA)
    assert intervals.without_overlaps(rows, none, ["key"]).count() == 5
    assert intervals.without_overlaps(none, rows, ["key"]).count() == 0
    assert intervals.overlap_pairs(rows, none, ["key"]).count() == 0
    assert intervals.accept_spans(none, ["key"], ["name"]).count() == 0


def test_match_rectangles_on_two_lines(spark):
    """A match over a line end has a box for each line; boxes of one line are one."""
    matches = spark.createDataFrame([(1, 1, 0, 8, 23, "x")], "doc_id long, page int, seq int, start int, stop int, value string")
    slices = [(1, 1, 0, 10, 10.0, 20.0, 100.0, 10.0), (1, 1, 10, 20, 110.0, 21.0, 100.0, 10.0), (1, 1, 20, 30, 10.0, 40.0, 50.0, 10.0), (1, 1, 30, 40, 60.0, 40.0, 50.0, 10.0), (1, 2, 8, 23, 0.0, 5.0, 9.0, 5.0)]
    placed = spark.createDataFrame([(*s, 200.0, 100.0) for s in slices], "doc_id long, page int, first int, last int, x double, y double, width double, font_size double, page_width double, page_height double")
    got = sorted(tuple(r) for r in geometry.match_rectangles(matches, placed).collect())
    assert got == [(1, 1, 0, 1, 45.0, 10.0, 60.0, 11.0), (1, 1, 0, 2, 5.0, 30.0, 7.5, 10.0)]


def test_merged_findings_keep_their_order(spark):
    schema = "doc_id long, start int, end int, replacement string, seq int"
    primary = spark.createDataFrame([(1, 10, 20, "a", 9), (1, 0, 5, "b", 8), (1, 18, 30, "lost", 7)], schema)
    secondary = spark.createDataFrame([(1, 19, 22, "lost", 1), (1, 40, 50, "c", 3), (1, 45, 48, "first", 2), (2, 0, 4, "d", 1)], schema)
    got = sorted((r.doc_id, r.replacement) for r in review.merge_findings(primary, secondary).collect())
    assert got == [(1, "a"), (1, "b"), (1, "first"), (2, "d")]


def test_pairs_carry_each_number_once(spark):
    left = spark.createDataFrame([(1, 2, -70, 5)], "k long, n int, start int, end int")
    right = spark.createDataFrame([(1, -64, -63, "x"), (1, 4, 5000, "y"), (1, 5, 9, "z")], "k long, start long, end long, t string")
    pairs = intervals.overlap_pairs(left, right, ["k"])
    assert sorted((tuple(r.l), tuple(r.r)) for r in pairs.collect()) == [((1, 2, -70, 5), (1, -64, -63, "x")), ((1, 2, -70, 5), (1, 4, 5000, "y"))]
    assert [f.dataType.typeName() for f in pairs.schema["l"].dataType] == ["long", "integer", "integer", "integer"]
    bare = intervals._in_cells(intervals._leveled(right.drop("t"), ["k"], "start", "end"), [0])
    assert bare.columns == ["k", "s", "e", "slot"]
