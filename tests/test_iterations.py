"""Ranks of graphs, stable orders and order statistics, held against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import graphs, selection


def ranks(nodes, edges):
    """By peeling, one node at a time."""
    ids = {n for n in nodes if n is not None} | {x for e in edges if None not in e for x in e}
    edges = {e for e in edges if None not in e}

    def peel(ids, edges):
        out, left, r = {}, set(edges), 0
        while layer := {n for n in ids if n not in out and not any(d == n for _, d in left)}:
            out |= dict.fromkeys(layer, r)
            left, r = {e for e in left if e[0] not in layer}, r + 1
        return out

    ranked = peel(ids, edges)
    rest = ids - set(ranked)
    behind = peel(rest, {(d, s) for s, d in edges if s in rest and d in rest})
    return {n: (ranked.get(n), "ranked" if n in ranked else "behind" if n in behind else "cycle") for n in ids}


@pytest.mark.parametrize("seed", range(2))
def test_ranks_match_peeling(spark, seed):
    r = random.Random(seed)
    nodes = [f"n{k}" for k in range(12)] + [None, "n1", "alone"]
    edges = [(f"n{a}", f"n{b}") for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(16)) if a < b or r.random() < 0.15] + [("n3", None), ("x", "y"), ("x", "y"), ("loop", "loop"), ("loop", "after"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")]
    got = graphs.topological_ranks(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string"))
    assert {x.id: (x["rank"], x.place) for x in got.collect()} == ranks(nodes, edges)


def test_empty_graph_and_long_paths(spark):
    nodes, none = spark.createDataFrame([("a",), ("b",)], "id string"), spark.createDataFrame([], "src string, dst string")
    assert {tuple(x) for x in graphs.topological_ranks(nodes, none).collect()} == {("a", 0, "ranked"), ("b", 0, "ranked")}
    assert graphs.topological_ranks(nodes.limit(0), none).collect() == []
    path = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    with pytest.raises(ValueError, match="more than 3"):
        graphs.topological_ranks(nodes, path, most=3)


def test_stable_order_of_recipes(spark):
    rows = [(1, 1, "a", ["c"]), (1, 2, "b", None), (1, 3, "c", ["b"]), (1, 4, "d", []), (2, 1, "x", ["y"]), (2, 2, "y", ["x"]), (3, 1, "k", ["unknown"]), (4, 1, "t", []), (4, 2, "t", []), (5, 9, "z", []), (5, 3, "w", [])]
    got = {(r.recipe, r.id): r.place for r in graphs.recipe_order(spark.createDataFrame(rows, "recipe int, position int, id string, needs array<string>")).collect()}
    assert got == {(1, "b"): 1, (1, "c"): 2, (1, "a"): 3, (1, "d"): 4, (2, "x"): None, (2, "y"): None, (3, "k"): None, (4, "t"): None, (5, "w"): 1, (5, "z"): 2}


@pytest.mark.parametrize(("bins", "few"), [(1024, 4096), (4, 3), (2, 1)])
def test_ranks_of_values(spark, bins, few):
    """Outliers, equal values, null keys, groups without values; many passes where bins are few."""
    r = random.Random(5)
    rows = [("wide", r.choice([1e300, -1e300, r.random(), 0.0, 5e-324])) for _ in range(300)] + [("same", 7.0)] * 50 + [(None, float(k % 13)) for k in range(100)]
    rows += [("none", None), ("none", float("nan")), ("one", -0.5), ("ends", -1.7e308), ("ends", 1.7e308), ("ends", 1.0)] + [("wide", None)]
    got = selection.select_ranks(
        spark.createDataFrame(rows, "g string, v double"), ["g"], "v", {"p10": selection.nearest_rank(0.1), "p50": selection.nearest_rank(0.5), "p100": selection.nearest_rank(1.0), "median": selection.upper_median_rank()}, bins, few
    )
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([v] if v is not None and v == v else [])
    pick = lambda vs, share: vs[max(1, math.ceil(len(vs) * share)) - 1]
    wanted = {g: (pick(s, 0.1), pick(s, 0.5), s[-1], s[len(s) // 2]) if (s := sorted(vs)) else (None,) * 4 for g, vs in groups.items()}
    assert {x.g: (x.p10, x.p50, x.p100, x.median) for x in got.collect()} == wanted


def test_no_task_holds_a_group(spark):
    """One group of 200,000 values: after the first pass, what is read off is a bin."""
    rows = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 7919 % 199_999).cast("double").alias("v"))
    plan = selection.select_ranks(rows, ["g"], "v", {"m": selection.nearest_rank(0.25)}, few=100)
    assert [tuple(x) for x in plan.collect()] == [(1, float(sorted(k * 7919 % 199_999 for k in range(200_000))[49_999]))]


def test_ranks_among_infinite_values_and_nan(spark):
    """Infinities take bins of their own, or no round would narrow the others; NaN is the greatest value if asked for."""
    inf, nan = float("inf"), float("nan")
    values = [inf, -inf, nan, nan, *map(float, range(50))]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", nan), (None, 1.0), (None, None)], "k string, x double")
    ranks = {"low": selection.nearest_rank(0.01), "mid": selection.nearest_rank(0.5), "high": selection.nearest_rank(0.97), "top": selection.nearest_rank(1.0)}
    picked = lambda last: {r[0]: [repr(v) for v in r[1:]] for r in selection.select_ranks(rows, ["k"], "x", ranks, bins=4, few=2, nan_last=last).collect()}
    assert picked(True) == {"a": ["-inf", "25.0", "nan", "nan"], "b": ["nan"] * 4, None: ["1.0"] * 4}
    assert picked(False) == {"a": ["-inf", "24.0", "49.0", "inf"], "b": ["None"] * 4, None: ["1.0"] * 4}


def test_given_edges_are_read_once(spark, monkeypatch):
    path = spark.range(3).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst"))
    nodes = spark.createDataFrame([("0",), ("alone",)], "id string")
    reads, write = [], graphs.Scratch.write
    monkeypatch.setattr(graphs.Scratch, "write", lambda self, df: reads.append(df._jdf.queryExecution().optimizedPlan().toString().count("Range (")) or write(self, df))
    found = sorted(map(tuple, graphs.topological_ranks(nodes, path).collect()))
    assert sum(reads) == 1
    assert found == [("0", 0, "ranked"), ("1", 1, "ranked"), ("2", 2, "ranked"), ("3", 3, "ranked"), ("alone", 0, "ranked")]
