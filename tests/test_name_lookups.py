"""Names are looked up with about as many candidates as results; results are those of all pairs."""

import difflib
import random

from pyspark.sql import functions as F

from folioscope.operators import grams as gr
from folioscope.operators import relations as rel


def _docs(spark, names):
    return spark.createDataFrame([(i, f"{'ab'[i % 2]}/{n}", n) for i, n in enumerate(names)], "document_id long, path string, name string")


def test_filename_best_is_the_order_of_all_names(spark):
    r = random.Random(3)
    words = ["doc", "txt", "plan", "Ab", "x", "日本語", "q1", "q2", "q3", "q4", "q5", "q6", "q7"]
    names = [" ".join(r.sample(words, r.randrange(0, 9))) or None for _ in range(120)] + [f"doc-{i}.txt" for i in range(80)]
    asked = ["doc 7 txt", "doc-12.txt", "plan", "zzz", "q1 q2 q3", "x Ab", "", "q1 q2 q3 q4 q5 q6 q7", "oc-1", "日本", None]
    docs, queries = _docs(spark, names), spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    docs, queries = docs.fillna({"name": ""}), queries.fillna({"query": "?"})
    whole = rel.filename_order(docs, queries).where("rank <= 9")
    best = rel.filename_best(docs, queries, 9)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, whole.collect()))


def test_queries_are_looked_up_by_long_grams(spark):
    names = spark.createDataFrame([(i, f"doc {i}") for i in range(3000)], "id long, name string")
    q = spark.createDataFrame([(i, f"oc {i}") for i in range(1000, 1100)], "query_id long, q string")
    hits = gr.contained(names, "name", q)
    assert sorted((r.query_id, r.id) for r in hits.collect()) == [(i, i) for i in range(1000, 1100)]
    assert 6 in gr.LENGTHS  # a query of seven characters meets few other names by six of them


def test_similar_names_by_common_subsequences(spark):
    names, asked = [f"doc {i}" for i in range(0, 4000, 3)], [f"dok {i}" for i in range(0, 4000, 171)]
    strings = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, q string")
    found = {(r.query_id, r.id) for r in gr.similar(strings, ["id"], "name", q, 0.72).collect()}
    wanted = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(names) if difflib.SequenceMatcher(None, a, b).ratio() >= 0.72}
    assert found == wanted
    common = set("do 0123456789")
    k = [[gr.subsequences(t, {n: n - 1 for n in range(5, 9)}, 0.72, common, asks) for t in texts] for texts, asks in ((asked, True), (names, False))]
    candidates = sum(not a.isdisjoint(b) for a in k[0] for b in k[1])
    assert candidates <= 2 * len(wanted)
