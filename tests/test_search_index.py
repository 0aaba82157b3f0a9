"""The stored index against BM25 over the texts themselves; versions against writers that meet."""

import pytest
from pyspark.sql import functions as F

from folioscope.operators import search as se
from folioscope.operators.search_index import SearchIndex, TieredIndex, search_weighted, weighted_index
from folioscope.sources.sinks import OutdatedWriter, VersionedTables

DOC = "document_id long, title string, body string"


def found(df):
    return sorted((r["query_id"], r["document_id"], r["n_matched"], round(r["bm25"], 9)) for r in df.collect())


def test_index_is_the_texts(spark, tmp_path):
    first = spark.createDataFrame([(1, "budget", "annual budget plan"), (2, "notes", "harbour notes"), (3, None, "budget of the harbour"), (4, "", None)], DOC)
    asked = spark.createDataFrame([(1, "annual budget"), (2, "harbour light"), (3, "nothing there"), (4, "")], "query_id long, query string")
    fields = {"title": 2.0, "body": 1.0}
    index = SearchIndex(spark, str(tmp_path / "index"), "document_id", fields, buckets=4)
    index.refresh(first)
    assert found(index.search(asked)) == found(se.bm25(first, "document_id", fields, asked)) != []

    edited = spark.createDataFrame([(2, "light", "the harbour light"), (5, "annual", "annual report")], DOC)
    index.refresh(edited, first.where("document_id = 3"))
    now = first.where("document_id in (1, 4)").union(edited)
    assert found(index.search(asked)) == found(se.bm25(now, "document_id", fields, asked))
    index.refresh(first.where("document_id = 3"))
    now = now.union(first.where("document_id = 3"))
    merged = index.merge(str(tmp_path / "merged"))
    assert found(merged.search(asked)) == found(index.search(asked)) == found(se.bm25(now, "document_id", fields, asked))
    assert index.search(asked.limit(0)).count() == 0


def test_search_reads_its_own_folders(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path), "document_id", {"body": 1.0})
    index.refresh(spark.range(50).select(F.col("id").alias("document_id"), F.concat(F.lit("word"), "id").alias("body")))
    plan = index.search(spark.createDataFrame([(1, "word7")], "query_id long, query string"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_tiers_from_the_index(spark, tmp_path):
    """The tiered search in the index against the one over texts, before and after edits and removals."""
    docs = [
        (1, "budget.txt", "budget", "Budget", "a/budget.txt"), (2, "old_budget.md", "old_budget", "Harbour", "a/old_budget.md"), (3, "notes.txt", "notes", "The annual budget", "b/notes.txt"),
        (4, "x.txt", "x", "", "budget/x.txt"), (5, "y.txt", "y", "Straße", "c/y.txt"), (6, "z.txt", "z", None, "c/z.txt"),
    ]
    docs = spark.createDataFrame(docs, "document_id long, name string, stem string, title string, path string")
    texts = [("1:0", 1, "Budget", "annual budget plan"), ("1:1", 1, "Costs", "more of the budgets, budget_2024 and Été"), ("2:0", 2, "Harbour", "harbour notes"), ("3:0", 3, "Annual budget", "nothing here"), ("4:0", 4, "", None), ("5:0", 5, "Straße", "an annual walk; strasse ete"), ("6:0", 6, None, "subbudget annually")]
    passages = spark.createDataFrame(texts, "passage_id string, document_id long, heading string, body string")
    asked = spark.createDataFrame([(1, "annual budget"), (2, "budget"), (3, "strasse"), (4, "ete"), (5, ""), (6, "nowhere"), (7, "budget_2024"), (8, "ha"), (9, "bugdet"), (10, "annual annual")], "query_id long, query string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    index = TieredIndex(spark, str(tmp_path / "index"), buckets=4)
    index.refresh(docs, passages)
    want = rows(se.search_tiered(docs, passages, asked, fuzzy=True))
    assert rows(index.search(asked, fuzzy=True)) == want and len(want) > 12
    assert {(1, 1, 3), (1, 3, 2), (2, 1, 0), (3, 5, 2), (9, 1, 1)} <= {(q, d, t) for q, _, d, _, t, *_ in want}

    edited = spark.createDataFrame([(2, "old.md", "old", "Budget of the harbour", "a/old.md"), (7, "new.txt", "new", "n", "new.txt")], docs.schema)
    pages = spark.createDataFrame([("2:0", 2, "Harbour", "the annual harbour"), ("7:0", 7, "n", "annual budget of ours")], passages.schema)
    index.refresh(edited, pages, docs.where("document_id = 1"))
    kept = "document_id not in (1, 2)"
    now, parts = docs.where(kept).union(edited), passages.where(kept).union(pages)
    assert rows(index.search(asked, fuzzy=True)) == rows(se.search_tiered(now, parts, asked, fuzzy=True)) != want
    plan = index.search(asked)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "body" not in plan


def test_exact_normalisation_in_search(spark, tmp_path):
    """Full-width letters, ligatures, combining marks and final sigmas are found in either spelling, in texts and in the index."""
    docs = spark.createDataFrame([(1, "ｒｅｐｏｒｔ.txt", "ｒｅｐｏｒｔ", "ﬁnal ΟΔΟΣ", "a/x.txt"), (2, "n.txt", "n", "plain", "a/n.txt"), (3, "m.txt", "m", "t", "a/m.txt")], "document_id long, name string, stem string, title string, path string")
    texts = [("1:0", 1, "οδος", "budget ﬁnal ②"), ("2:0", 2, "Budget", "the final cafe\u0301 budget and ΟΔΟΣ"), ("3:0", 3, "budget", "ｆｉｎａｌ budget café")]
    passages = spark.createDataFrame(texts, "passage_id string, document_id long, heading string, body string")
    asked = spark.createDataFrame([(1, "report"), (2, "budget final"), (3, "ΟΔΟΣ"), (4, "budget café"), (5, "budget 2"), (6, "ＲＥＰＯＲＴ"), (7, "οδος")], "query_id long, query string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    index = TieredIndex(spark, str(tmp_path / "index"), buckets=4)
    index.refresh(docs, passages)
    got = rows(se.search_tiered(docs, passages, asked))
    assert rows(index.search(asked)) == got
    tiers = {(q, d): (t, reason) for q, _, d, _, t, _, reason, _ in got}
    assert tiers[1, 1] == tiers[6, 1] == (0, "exact name") and tiers[3, 1][0] == tiers[7, 1][0] == 2
    assert {d for q, d in tiers if q == 2} == {2} | {d for d, body in ((1, "budget ﬁnal"), (3, "ｆｉｎａｌ budget")) if (2, d) in tiers}
    assert tiers[4, 3] == (3, "text holds all parts") and tiers[7, 2][0] == 3


def test_weighted_ranker_from_the_index(spark, tmp_path):
    kind = "document_id long, node_type string, status string, quality_flags array<string>, modified_at string, source string, name string, path string, summary string, keyword string, evidence string, body string, truncated boolean"
    rows = [(i, ["text", "foldernode"][i % 2], ["current", "stale", "failed"][i % 3], ["f"] * (i % 3), "2024", "s", f"plan-{i}.txt", f"a/plan-{i}.txt", "annual budget" if i % 2 else "Harbour", "en s", "v1.2-x", ["annual budget plan", "harbour 微分", "plan of plan-3.txt"][i % 3], i == 3) for i in range(12)]
    docs = spark.createDataFrame(rows, kind)
    asked = spark.createDataFrame([(1, "annual budget"), (2, "plan-3.txt"), (3, "微分 harbour v1.2-x"), (4, "--"), (5, "none")], "query_id long, query string")
    index = weighted_index(spark, str(tmp_path / "index"), buckets=4)
    index.refresh(docs)
    got = lambda df: sorted(map(tuple, df.collect()))
    assert got(search_weighted(index, asked, k=5)) == got(se.search_weighted(docs, asked, k=5)) != []
    edited = docs.where("document_id = 2").withColumn("body", F.lit("annual annual report"))
    index.refresh(edited, docs.where("document_id = 4"))
    now = docs.where("document_id not in (2, 4)").unionByName(edited)
    merged = index.merge(str(tmp_path / "merged"))
    where = F.col("status") != "failed"
    assert got(search_weighted(index, asked, 5, where)) == got(search_weighted(merged, asked, 5, where)) == got(se.search_weighted(now, asked, 5, where))


def test_one_of_two_writers_fails(spark, tmp_path):
    """A commit computed from a version that isn't the latest any more is refused; nothing of the other writer's is lost."""
    one, two = VersionedTables(spark, str(tmp_path)), VersionedTables(spark, str(tmp_path))
    assert one.version() == 0 and one.commit({"t": spark.range(1)}, base=0) == 1
    seen = two.version()
    read = two.read("t", seen)
    assert one.commit({"t": spark.range(2)}, base=1) == 2
    with pytest.raises(OutdatedWriter):
        two.commit({"t": read.union(spark.range(9))}, base=seen)
    assert two.read("t").count() == 2 and two.version() == 2
    assert two.commit({"t": two.read("t", 2).union(spark.range(1))}, base=2) == 3 and one.read("t").count() == 3
    assert one.read("t", 1).count() == 1 and one.history("t").count() == 6


def test_a_writer_in_between(spark, tmp_path, monkeypatch):
    """The other writer publishes while this one writes its data: the same number isn't taken twice."""
    one, two = VersionedTables(spark, str(tmp_path)), VersionedTables(spark, str(tmp_path))
    one.commit({"t": spark.range(1)})
    publish = two._publish
    monkeypatch.setattr(two, "_publish", lambda version, pointer: (one.commit({"t": spark.range(5)}, base=1), publish(version, pointer)))
    with pytest.raises(OutdatedWriter):
        two.commit({"t": spark.range(9)}, base=1)
    assert one.read("t").count() == 5 and one.version() == 2


def test_recovery(spark, tmp_path):
    one = VersionedTables(spark, str(tmp_path), grace=3600)
    one.commit({"t": spark.range(2)})
    (tmp_path / "_meta" / "2.json").write_text('{"version": 2, "sche')  # a writer that died, or is at it
    spark.range(3).write.parquet(str(tmp_path / ("v2-" + "a" * 32) / "t"))
    assert one.read("t").count() == 2
    with pytest.raises(OutdatedWriter):
        one.commit({"t": spark.range(4)})
    late = VersionedTables(spark, str(tmp_path), grace=0)
    assert late.recover() == {"closed": [2], "removed": ["v2-" + "a" * 32]} and late.recover() == {"closed": [], "removed": []}
    assert one.version() == 1 and one.commit({"t": spark.range(4)}, base=1) == 3 and one.read("t").count() == 4
    (tmp_path / "_meta" / "4.json").write_text("")
    assert late.commit({"t": spark.range(5)}, base=3) == 5 and late.history("t").count() == 11
    with pytest.raises(OutdatedWriter):  # a dead writer that comes back after its pointer was closed
        one._publish(4, {"folder": "v4-x", "tables": "t"})
