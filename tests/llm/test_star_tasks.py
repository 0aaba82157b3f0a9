"""Rounds over little data: how many tasks and shuffles they take."""

from folioscope.llm import components, near_copies


def tasks_of(spark, work):
    """How many tasks the jobs of work() have."""
    context, group = spark.sparkContext, f"tasks of {id(work)}"
    context.setJobGroup(group, "")
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}
    return sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def test_rounds_have_few_tasks(spark, monkeypatch):
    """Files and logs grow with a round's tasks, however little it holds."""
    monkeypatch.setattr(components, "durable", lambda df: df.localCheckpoint())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (5, 4), (5, 4), (3, 1)], "a long, b long").coalesce(1)
        made = []
        assert tasks_of(spark, lambda: made.append(components.connected(links))) <= 2 * 20  # two rounds over 4 partitions
        assert sorted(map(tuple, made[0].collect())) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_keys_across_components_are_found_in_one_shuffle_by_key(spark):
    rows = spark.createDataFrame([(1, 1, 9, 0), (1, 2, 9, 0), (2, 1, 9, 0)], "key long, node long, size int, place int")
    left = near_copies._apart(rows, spark.createDataFrame([(1, 1), (2, 2)], "node long, root long"))
    left.collect()
    plan = left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Join") == 1 and plan.count("REPARTITION_BY_COL") == 1
