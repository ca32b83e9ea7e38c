"""Page alignment without a call for each document pair."""

from quirefold.operators import geometry


def test_page_pairs_are_aligned_in_batches(spark):
    one = [(1, 1, 0.9), (1, 2, 0.1), (1, 3, 0.2), (4, 1, 0.1), (4, 2, 0.1), (4, 3, 0.8), (1, 41, 1.0)]
    scores = spark.createDataFrame([(p, *x) for p in (7, 8, None) for x in one[:: -1 if p == 8 else 1]], "pair_id long, left_page int, right_page int, similarity double")
    df = geometry.aligned_pages(scores)
    assert "FlatMapGroupsInPandas" not in df._jdf.queryExecution().executedPlan().toString()
    steps = [(0, 1, 1), (1, None, 2), (2, 4, 3)]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(((p, *s) for p in (7, 8, None) for s in steps), key=repr)
