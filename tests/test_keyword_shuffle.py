"""Words are counted where their text is: only texts are shuffled."""

import re

from folioscope.operators import relations as rel


def test_words_are_not_shuffled(spark):
    rows = spark.createDataFrame([(1, "eins zwei zwei drei"), (2, None), (3, "a the the vier")], "id long, body string")
    out = rel.top_keywords(rows, "id", "body", ("the",))
    assert sorted(map(tuple, out.collect())) == [(1, 1, "zwei", 2), (1, 2, "eins", 1), (1, 3, "drei", 1), (3, 1, "vier", 1)]
    plan = out._jdf.queryExecution().sparkPlan().toString(), out._jdf.queryExecution().executedPlan().toString()
    last = re.split(r"== Initial Plan ==", plan[1])[-1]
    assert "Exchange" not in last[: last.index("Generate")]
