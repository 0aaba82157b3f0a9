"""Queries that look for texts take the whole texts, not how they begin."""

from folioscope.plans import catalog


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def put_documents(spark, folder, texts):
    put(spark, folder, "documents", [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_retrieval_metrics(spark, tmp_path):
    """A document is right if it holds the whole item; its rank is that of the search."""
    start = "the same sixty characters and more at the start of both of the texts "
    put_documents(spark, tmp_path, [start * 2 + "one", "other words, and " + start + "two", "nothing", "else", "and more"])
    put(spark, tmp_path, "benchmark", [(1, start + "none"), (2, start + "two"), (3, start + "one")], "item_id long, text string")
    row = catalog.retrieval_metrics(spark, str(tmp_path)).first()
    assert (row["n"], row["hit_at_1"], row["hit_at_5"], row["mrr"]) == (3, 0.333333, 0.666667, 0.5)


def test_evidence_dedup(spark, tmp_path):
    rows = [(1, 0, "user", "what is the price of it"), (1, 1, "user", "what is the colour of it"), (1, 2, "user", "what is the price of it")]
    put(spark, tmp_path, "conversations", rows, "conv_id long, turn long, role string, text string")
    got = catalog.evidence_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["turn"], r["excerpt"], r["place"]) for r in got) == [(0, "what is the ", 1), (1, "what is the ", 2)]


def test_research_union(spark, tmp_path):
    put_documents(spark, tmp_path, ["a lighthouse by the sea", "something else", "another thing", "one more"])
    put(spark, tmp_path, "benchmark", [(1, "unknown " * 12 + "lighthouse")], "item_id long, text string")
    assert [r["document_id"] for r in catalog.research_union(spark, str(tmp_path)).collect()] == [0]
