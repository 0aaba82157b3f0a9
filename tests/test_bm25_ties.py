"""Rows alike in a query's terms have the same BM25 score to the last bit, in whatever order their gains are added up."""

import random

from pyspark.sql import functions as F

from folioscope.operators import search as se


def _pairs(spark, terms):
    """Rows 2 i and 2 i + 1 are alike, their terms come in opposite orders."""
    r, rows = random.Random(7), []
    for i in range(150):
        f = [(t, float(r.randrange(1, 40))) for t in terms]
        rows += [(2 * i, 90, t, n) for t, n in f] + [(2 * i + 1, 90, t, n) for t, n in reversed(f)]
    return spark.createDataFrame(rows, "document_id long, dl long, term string, f double").coalesce(1)


def test_bm25_of_alike_rows(spark):
    terms = [f"t{i}" for i in range(7)]
    stats = spark.createDataFrame([(900, 71.3)], "n_rows long, avgdl double")
    asked = spark.createDataFrame([(1, len(terms), t) for t in terms], "query_id long, n_terms int, term string")
    hits = se.bm25_of(_pairs(spark, terms), "document_id", stats, asked, F.broadcast)
    score = {r.document_id: r.bm25 for r in hits.collect()}
    assert len(score) == 300 and [i for i in range(150) if score[2 * i] != score[2 * i + 1]] == []
