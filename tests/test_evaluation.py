"""The gate of search quality, ranks by names, and what an update would do."""

import random

from pyspark.sql import functions as F

from folioscope.operators import evidence as ev
from folioscope.operators import relations as rel


def test_filename_ranks_are_those_of_the_whole_order(spark):
    r = random.Random(5)
    words = ["plan", "budget", "note", "harbour", "x1", "doc"]
    docs = [(i, f"{r.choice('abc')}/{i:03d}", "-".join(r.sample(words, r.randrange(1, 4))) + ".txt") for i in range(60)]
    docs = spark.createDataFrame(docs, "document_id long, path string, name string")
    asked = spark.createDataFrame([(1, "budget plan"), (2, "nothing"), (3, "plan-budget"), (4, "doc txt"), (5, "note.txt")], "query_id long, query string")
    every = rel.filename_order(docs, asked).select("query_id", "document_id", "rank")
    got = rel.filename_ranks(docs, asked, every)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect())) and got.count() == 300


def test_gate(spark):
    rows = [(1, 1, 10, True, 20), (2, 5, 9, True, 20), (3, 6, 2, True, 20), (4, None, 20, None, 20), (5, 2, 3, False, 20)]
    tasks = rel.evaluated(spark.createDataFrame(rows, "task_id long, search_rank int, baseline_rank long, explained boolean, n_documents long"))
    got = {x["task_id"]: (x["top5_hit"], x["search_steps"], x["steps_saved"], x["failure"]) for x in tasks.collect()}
    assert got == {
        1: (True, 1, 9, None), 2: (True, 5, 4, None), 3: (False, 6, -4, "relevant_document_not_in_top5"), 4: (False, 21, -1, "relevant_document_not_in_top5"), 5: (True, 2, 1, "explanation_contract_failed"),
    }
    row = rel.search_gate(tasks).first()
    assert (row["tasks"], row["top5"], row["failures"], row["unexplained"], row["meets"]) == (5, 0.6, 2, 2, False)
    assert row["reduction"] == round(1 - 35 / 44, 6) and row["mrr"] == round((1 + 0.2 + 1 / 6 + 0.5) / 5, 6)
    good = rel.search_gate(tasks.where("task_id <= 2")).first()
    assert good["meets"] is False  # its mean reciprocal rank is 0.6
    assert rel.search_gate(tasks.where("task_id = 1")).first()["meets"] is True
    assert rel.search_gate(tasks.where(F.lit(False))).first()["meets"] is False


def test_what_an_update_would_do(spark):
    docs = spark.createDataFrame([("a/old.txt",), ("a/b/x.pdf",)], "path string")
    events = spark.createDataFrame([("added", "a/n.md"), ("modified", "a/b/x.pdf"), ("modified", "a/b/x.pdf"), ("moved", "c/y.PDF"), ("deleted", "a/old.txt"), ("deleted", "never/there.txt")], "kind string, path string")
    lists = ev.update_lists(docs, events)
    assert {tuple(r) for r in lists.collect()} == {
        ("read_text", "a/n.md"), ("describe", "a/b/x.pdf"), ("describe", "c/y.PDF"), ("drop", "a/old.txt"), *(("roll_up", f) for f in (".", "a", "a/b", "c", "never")),
    }
    assert lists.count() == 9
    assert {tuple(r) for r in ev.estimated_calls(lists).collect()} == {("read_text", 1, 0), ("describe", 2, 2), ("roll_up", 5, 5), ("drop", 1, 0)}
    assert ev.estimated_calls(lists, model=False).agg(F.sum("calls")).first()[0] == 0
