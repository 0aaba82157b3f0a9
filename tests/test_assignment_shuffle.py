"""Participants are dealt out before they meet the tasks: the pairs aren't shuffled."""

import re

from folioscope.operators import relations as rel


def test_pairs_are_not_shuffled(spark):
    people, tasks = spark.range(7).toDF("participant_id"), spark.range(5).toDF("task_id")
    out = rel.study_assignment(people, tasks)
    rows = out.collect()
    assert len(rows) == 35 and all(sorted(r.place for r in rows if r.participant_id == p) == [1, 2, 3, 4, 5] for p in range(7))
    last = re.split(r"== Initial Plan ==", out._jdf.queryExecution().executedPlan().toString())[-1]
    assert "Exchange hashpartitioning" not in last[: last.index("BroadcastNestedLoopJoin")]
