"""Operations with wrong inputs, held against the rules read one by one."""

from quirefold.operators import relational

SCHEMA = "operation_id long, artifact_id long"


def test_violations_of_each_kind(spark):
    inputs = [(1, 1), (1, 2), (2, 1), (2, 1), (3, 5), (5, None), (None, 4)] + [(4, k) for k in range(33)]
    outputs = [(1, 9), (3, 5), (3, 5), (6, 1), (6, 2), (5, None), (None, 4), (2, 1)]
    found = relational.graph_violations(spark.createDataFrame(inputs, SCHEMA), spark.createDataFrame(outputs, SCHEMA))
    shape, both, bare = "inputs must be 1 to 32 and distinct", "an input is also an output", "no input"
    wanted = [(2, shape), (2, both), (3, both), (4, shape), (5, shape), (6, bare), (None, bare)]
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in found.collect())


def test_edges_are_dealt_out_once_and_never_held_for_a_join(spark):
    none = spark.createDataFrame([], SCHEMA)
    plan = relational.graph_violations(none, none)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Expand" not in plan
