"""What the rounds of near copies carry on, and how often they shuffle."""

from folioscope.llm import components, near_copies


def test_only_keys_across_components_are_carried_on(spark):
    rows = spark.createDataFrame([(1, n, 9, 0) for n in (1, 2, 3)] + [(2, n, 9, 0) for n in (3, 4)], "key long, node long, size int, place int")
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)], "node long, root long")
    left = near_copies._apart(rows, parts)
    assert sorted(map(tuple, left.collect())) == [(2, 3, 9, 0, 1), (2, 4, 9, 0, 4)]
    merged = near_copies._merged(parts, spark.createDataFrame([(2, 4)], "a long, b long"))
    assert sorted(map(tuple, merged.collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)]
    assert near_copies._apart(left, merged).isEmpty()


def test_a_star_shuffles_edges_by_node_once(spark):
    edges = spark.createDataFrame([(2, 1), (3, 2), (5, 4)], "u long, v long")
    star = components._star(edges, large=False)
    star.collect()
    plan = star._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("REPARTITION_BY_COL") >= 1 and plan.count("ENSURE_REQUIREMENTS") - plan.count("ReusedExchange") <= 2
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(60, 50)], "a long, b long")
    assert {tuple(r) for r in components.connected(chain).collect()} == {(i, 0) for i in range(41)} | {(50, 50), (60, 50)}
