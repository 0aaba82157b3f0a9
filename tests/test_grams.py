"""Lookups by grams against all pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import grams as gr
from folioscope.operators import search as se


def names(seed, n, alphabet="abcd-1 é報", most=30):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(most))) for _ in range(n)]


def both(spark, strings, queries):
    return spark.createDataFrame(list(enumerate(strings)), "id long, text string"), spark.createDataFrame(list(enumerate(queries)), "query_id long, q string")


def test_contained(spark):
    strings, queries = [*names(1, 200), "", None, "ab", "a"], [*names(2, 150, most=5), "", None, "a", "報", "zz"]
    s, q = both(spark, strings, queries)
    for small in (F.broadcast, lambda d: d):
        got = sorted((r["query_id"], r["id"]) for r in gr.contained(s, "text", q, small).collect())
        assert got == sorted((i, j) for i, a in enumerate(queries) for j, t in enumerate(strings) if a and t and a in t)


def edited(r, text):
    chars = list(text)
    for _ in range(r.randrange(1 + len(text) // 2)):
        chars.insert(r.randrange(len(chars) + 1), r.choice("abcdexyz-1"))
        if r.random() < 0.6:
            chars.pop(r.randrange(len(chars)))
    return "".join(chars)


@pytest.mark.parametrize("least", [0.72, 0.5, 0.9])
def test_similar(spark, least):
    r = random.Random(4)
    strings = [*names(5, 60, most=12), *names(6, 40, "abcdefgh", 90), *("".join(r.choice("xy") for _ in range(n)) for n in (1, 2, 3, 24, 25, 26)), "", None]
    queries = [*(edited(r, t) for t in strings if t), "", None, "a"]
    s, q = both(spark, strings, queries)
    want = [(i, j, difflib.SequenceMatcher(None, a, t).ratio()) for i, a in enumerate(queries) for j, t in enumerate(strings) if a and t]
    want = sorted((i, j, round(x, 9)) for i, j, x in want if x >= least)
    got = sorted((x["query_id"], x["id"], round(x["near"], 9)) for x in gr.similar(s, ["id"], "text", q, least).collect())
    assert got == want and len(want) > 30


def test_long_strings_have_few_keys():
    assert len(gr.keys("a long file name with many different words 2024", 0.72, {}, True)) < 60
    assert gr.longest_short(0.6) == float("inf") and gr.longest_short(0.72) == 24


def test_reasons_and_scores(spark):
    docs = spark.createDataFrame([(1, "Report.txt", "Report", "Annual report", "a/Report.txt"), (2, "My report.pdf", "My report", "x", "a/My report.pdf"), (3, "repotr.md", "repotr", "", "b/repotr.md"), (4, "z.txt", "z", "The report", "c/z.txt"), (5, "q.txt", "q", "", "report/q.txt"), (6, "reports txt.x", "reports txt", None, "d")], "document_id long, name string, stem string, title string, path string")
    asked = spark.createDataFrame([(1, "report"), (2, "txt"), (3, "Report.TXT"), (4, ""), (5, "nowhere")], "query_id long, query string")
    got = {(r["query_id"], r["document_id"]): (r["tier"], round(r["score"], 6), r["reason"]) for r in se.metadata_hits(docs, asked, fuzzy=True).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 1} == {
        1: (0, 0.0, "exact name"), 2: (1, 1.0033, "name contains query"), 3: (1, round(2 + 1 - difflib.SequenceMatcher(None, "report", "repotr").ratio(), 6), "name is similar"),
        4: (2, 0.0, "title contains query"), 5: (2, 0.2, "path contains query"), 6: (1, 0.0005, "name starts with query"),
    }
    # what stands in the stem is measured there, else in the whole name
    assert got[2, 1] == (1, round(1 + 7 / 1e3 + 7 / 1e4, 6), "name contains query") and got[2, 6][2] == "name contains query"
    assert got[3, 1] == (0, 0.0, "exact name") and not any(q in (4, 5) for q, _ in got)


def test_no_nested_loops(spark):
    docs = spark.createDataFrame([(1, "a", "a", "a", "a")], "document_id long, name string, stem string, title string, path string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, query string")
    plan = se.metadata_hits(docs, asked, fuzzy=True)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
