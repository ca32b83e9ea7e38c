"""Topological ranks and cycles of graphs as large as the data, by peeling sources and sinks round by round.

A round takes the nodes that no remaining edge enters, gives them the round's number, and drops their edges. Each round is
two joins on node ids over what is left, written to the shared folder; there are as many rounds as the longest path has
nodes. What the peeling leaves hangs on a cycle; peeling sinks then tells nodes on cycles, or between two, from nodes
behind one. Nothing but a count of new nodes reaches the driver.

Repeated edges and nodes: as one. Edges from or to unknown nodes: those nodes are added. An edge from a node to itself is a
cycle. Null ids: left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch, scratch


def _peeled(made: Scratch, nodes: DataFrame, edges: DataFrame, most: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of id and rank, one for each round, and the edges that are left. edges: src, dst."""
    rounds = []
    layer = made.write(nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti"))
    while len(rounds) < most and not layer.isEmpty():
        rounds.append(layer.withColumn("rank", F.lit(len(rounds)).cast("int")))
        freed = edges.join(layer.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        rest = made.write(edges.join(layer.select(F.col("id").alias("src")), "src", "left_anti"))
        layer = made.write(freed.join(rest.select(F.col("dst").alias("id")), "id", "left_anti"))
        edges = rest
    if not layer.isEmpty():
        raise ValueError(f"a path has more than {most} nodes")
    return rounds, edges


def _union(frames: list[DataFrame], empty: DataFrame) -> DataFrame:
    for f in frames:
        empty = empty.unionByName(f)
    return empty


def topological_ranks(nodes: DataFrame, edges: DataFrame, most: int = 10_000) -> DataFrame:
    """id, rank (edges on the longest path to the node; null without an order), place (ranked, cycle, behind).

    nodes: id. edges: src, dst. most: rounds after which a path is called too long. The result is a stored table; its
    folder stays until the session's files are cleaned.
    """
    with scratch(nodes.sparkSession, "ranks") as made:
        known = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
        ids = nodes.select("id").filter(F.col("id").isNotNull())
        first = made.write(known)
        every = made.write(ids.unionByName(first.select(F.col("src").alias("id"))).unionByName(first.select(F.col("dst").alias("id"))).distinct())
        rounds, left = _peeled(made, every, first, most)
        none = every.limit(0).withColumn("rank", F.lit(0).cast("int"))
        ranked = made.write(_union(rounds, none))
        rest = made.write(every.join(ranked, "id", "left_anti"))
        # sinks of what is left are behind a cycle; so is what leads to them alone
        inside = left.join(rest.select(F.col("id").alias("src")), "src", "left_semi")
        back, _ = _peeled(made, rest, made.write(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), most)
        behind = _union([b.select("id") for b in back], none.select("id")).withColumn("at", F.lit("behind"))
        loose = rest.join(behind, "id", "left").select("id", F.lit(None).cast("int").alias("rank"), F.coalesce("at", F.lit("cycle")).alias("place"))
        return made.write(ranked.withColumn("place", F.lit("ranked")).unionByName(loose))


def recipe_order(steps: DataFrame) -> DataFrame:
    """recipe, id, place: many small graphs at once, each in stable order: again and again the first step that is ready.

    steps: recipe, position, id, needs (array of ids). A recipe with a cycle, an unknown need or a repeated id has null places.
    One fold over each recipe's steps, as many times as it has steps.
    """
    step = F.struct("position", "id", F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))
    recipes = steps.groupBy("recipe").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    ids = F.transform("steps", lambda s: s["id"])

    def next_ready(done, _):
        ready = F.filter("steps", lambda s: ~F.array_contains(done, s["id"]) & (F.size(F.array_except(s["needs"], done)) == 0))
        first = F.get(ready, F.lit(0))["id"]
        return F.when(first.isNull(), done).otherwise(F.concat(done, F.array(first)))

    order = F.aggregate(F.sequence(F.lit(1), F.size("steps")), F.array().cast("array<string>"), next_ready)
    whole = recipes.withColumn("order", order).withColumn("fine", (F.size("order") == F.size("steps")) & (F.size(F.array_distinct(ids)) == F.size("steps")))
    return whole.select("recipe", "fine", "order", F.explode("steps").alias("s")).select("recipe", F.col("s.id").alias("id"), F.when(F.col("fine"), F.array_position("order", F.col("s.id")).cast("int")).alias("place"))
