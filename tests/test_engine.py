import io
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioscope.operators import relations as rel
from folioscope.operators import search as se
from folioscope.plugins import PACKAGE, TIMELINE, Plugin, Plugins, error_code, heuristic_summary
from folioscope.sources import files as fs
from folioscope.sources import sinks
from folioscope.streaming import changes


def docs(spark, *rows):
    d = spark.createDataFrame([(i, n, p, t, b) for i, (n, p, t, b) in enumerate(rows, 1)], "document_id long, name string, path string, title string, body string")
    return d.withColumn("stem", F.regexp_replace("name", r"\.[^.]*$", ""))


def passages(d):
    return d.select(F.col("document_id").alias("passage_id"), "document_id", F.col("title").alias("heading"), "body")


def test_tiers_in_order(spark):
    d = docs(
        spark,
        ("budget.txt", "a/budget.txt", "x", "nothing"), ("budget plan.txt", "a/budget plan.txt", "x", "nothing"), ("my budget.txt", "a/my budget.txt", "x", "nothing"),
        ("p.txt", "a/p.txt", "the budget", "nothing"), ("q.txt", "a/q.txt", "x", "about a budget here"), ("r.txt", "a/r.txt", "x", "unrelated"), ("budgte.txt", "z/budgte.txt", "x", "y"),
    )
    q = spark.createDataFrame([(1, "Budget")], "query_id long, query string")
    got = [(r["name"], r["tier"]) for r in se.search_tiered(d, passages(d), q).orderBy("rank").collect()]
    assert got == [("budget.txt", 0), ("budget plan.txt", 1), ("my budget.txt", 1), ("p.txt", 2), ("q.txt", 3)]
    fuzzy = se.search_tiered(d, passages(d), q, fuzzy=True).where("reason = 'name is similar'").collect()
    assert [r["name"] for r in fuzzy] == ["budgte.txt"]


def test_all_terms_else_any(spark):
    hits = spark.createDataFrame([(1, 1, 2, 2), (1, 2, 2, 1), (2, 1, 2, 1)], "query_id long, document_id long, n_terms int, n_matched int")
    assert {(r["query_id"], r["document_id"]) for r in se.all_else_any(hits).collect()} == {(1, 1), (2, 1)}


def test_many_children_expand(spark):
    kids = spark.range(50_000).select(F.lit(7).cast("long").alias("folder_id"), (F.col("id") + 100).alias("document_id"))
    results = spark.createDataFrame([(1, 7), (1, 100)], "query_id long, document_id long")
    assert se.expanded(results, kids).count() == 49_999


def test_rerank_pins_exact_names(spark):
    results = spark.createDataFrame([(1, 10, 0, 1), (1, 11, 1, 2), (1, 12, 3, 3), (1, 13, 3, 4)], "query_id long, document_id long, tier int, rank int")
    order = spark.createDataFrame([(1, 1, 13), (1, 2, 99), (1, 3, 13), (1, 4, 10)], "query_id long, position int, document_id long")
    assert [r["document_id"] for r in se.reranked(results, order).orderBy("new_rank").collect()] == [10, 13, 11, 12]


STATE = "document_id long, path string, source_kind string, size long, mtime long, content_hash string"


def test_moves_pair_one_to_one(spark):
    old = spark.createDataFrame([(1, "a", "physical", 1, 1, "h"), (2, "b", "physical", 1, 1, "h"), (3, "c", "physical", 1, 1, "k")], STATE)
    new = spark.createDataFrame([("x", "physical", 1, 1, "h"), ("c", "physical", 1, 2, "k"), ("n", "physical", 1, 1, "z")], STATE.replace("document_id long, ", ""))
    got = {(r["kind"], r["path"], r["previous_path"], r["document_id"]) for r in rel.diff(old, new).collect()}
    assert got == {("moved", "x", "a", 1), ("deleted", "b", None, 2), ("modified", "c", None, 3), ("added", "n", None, None)}
    assert rel.unique_moves(old, new).count() == 0  # two vanished with that content


def test_failed_keep_last_good(spark):
    was = spark.createDataFrame([("a", "indexed", "h1", 5), ("b", "failed", "h2", 0)], "path string, state string, content_hash string, body_chars int")
    now = spark.createDataFrame([("a", "failed", "h9", 0), ("b", "failed", "h8", 0)], was.schema)
    assert {tuple(r) for r in rel.kept_last_good(was, now).collect()} == {("a", "stale", "h1", 5), ("b", "failed", "h8", 0)}


def test_percentiles(spark):
    import statistics

    groups = {"a": list(range(1, 12)), "b": [5], "c": [2, 2, 2, 9], "d": [1.5, 7.25, 3.0, None, 3.0, 8.0], "e": [None]}
    d = spark.createDataFrame([(g, None if v is None else float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in rel.values_at(d, "g", "v", {"near": lambda n: rel.nearest_rank(n, 0.95), "up": lambda n: rel.ceiling_rank(n, 0.5)}).collect()}
    assert set(got) == set("abcd")
    for g, r in got.items():
        s = sorted(v for v in groups[g] if v is not None)
        assert (r["near"], r["up"]) == (s[round((len(s) - 1) * 0.95)], s[max(1, -(-len(s) // 2)) - 1])
    rows = d.select(F.col("g").alias("condition"), F.col("v").alias("duration_ms"), F.col("v").isNotNull().alias("success"))
    for r in rel.study_summary(rows).collect():
        s = [v for v in groups[r["condition"]] if v is not None]
        assert (r["attempts"], r["successes"], r["p50"]) == (len(groups[r["condition"]]), len(s), statistics.median(s) if s else None)


def test_office_locks(spark):
    d = spark.createDataFrame([("a/x.docx",), ("a/~$x.docx",), ("b/x.docx",)], "path string")
    assert [r["path"] for r in rel.office_locked(d).collect()] == ["a/x.docx"]


def test_privacy_guard(spark):
    with pytest.raises(ValueError):
        rel.guarded(spark.createDataFrame([("a",)], "Query string"))


def zipped(*members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def test_archives():
    inner = zipped(("deep.txt", "d"), ("more.zip", zipped(("x", "y"))))
    rows = fs.archive_members(zipped(("a.txt", "1"), ("../up.txt", "2"), ("in.zip", inner)), "o.zip", fs.ArchivePolicy())
    assert {(r[0], r[6]) for r in rows} >= {("o.zip!/a.txt", None), ("o.zip!/../up.txt", "unsafe_path"), ("o.zip!/in.zip!/deep.txt", None)}
    with pytest.warns(UserWarning):
        twice = zipped(("a", "1"), ("a", "2"))
    assert [r[0] for r in fs.archive_members(twice, "o", fs.ArchivePolicy())] == ["o!/a", "o!/a#duplicate-2"]
    assert fs.archive_members(zipped(("a", "1"), ("b", "2")), "o", fs.ArchivePolicy(members=1))[0][6] == "too_many_members"
    assert fs.archive_members(b"PK not a zip", "o", fs.ArchivePolicy())[0][6] == "damaged_archive"
    assert fs.archive_members(zipped(("a", "12345")), "o", fs.ArchivePolicy(total_bytes=3))[0][6] == "total_too_large"


def test_office_formats():
    w = 'xmlns:w="w"'
    docx = zipped(("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'))
    assert fs.read_docx(docx) == [(None, "Top", "paragraph", "1 (Heading1)"), (None, "a | b", "table", "1")]
    xlsx = zipped(
        ("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>'), ("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>'),
        ("xl/sharedStrings.xml", "<sst><si><t>hello</t></si></sst>"), ("xl/worksheets/s.xml", '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1"><v>7</v></c></row></sheetData></worksheet>'),
    )
    assert fs.read_xlsx(xlsx) == [(None, "hello | 7", "sheet", "S A1:B1")]
    pptx = zipped(("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:sld>'), ("ppt/notesSlides/notesSlide1.xml", '<p:n xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>note</a:t></a:r></a:p></p:n>'))
    assert fs.read_pptx(pptx) == [(1, "Hi\n[Notes]\nnote", "slide", "1")]
    assert fs.Registry().extract(".docx", b"junk")[3] == "parse_failed" and fs.Registry().extract(".png", b"")[3] == "metadata_only"


def test_scan_extract_and_passages(spark, tmp_path):
    for name, data in (("notes.txt", "Plain words that can be read well, enough of them to judge, and more of them still."), (".git/x.txt", "no"), ("a/~$l.txt", "no"), ("a/b.md", ""), ("node_modules/m.txt", "no"), ("c.bin", "no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(data)
    files = fs.scan_tree(spark, str(tmp_path), with_empty=True)
    assert sorted(r["path"] for r in files.collect()) == ["a/b.md", "c.bin", "notes.txt"]
    got = {r["path"]: r["error_code"] for r in fs.extract(files).collect()}
    assert got == {"a/b.md": None, "c.bin": "metadata_only", "notes.txt": None}
    assert [r["path"] for r in fs.passages_of(fs.indexed_pages(fs.extract(files))).collect()] == ["notes.txt"]


def test_versions_commit_last(spark, tmp_path):
    t = sinks.VersionedTables(spark, str(tmp_path / "t"))
    assert t.stale() and t.commit({"d": spark.range(3)}) == 1 and t.read("d").count() == 3
    spark.range(9).write.parquet(str(tmp_path / "t/v2/d"))  # a writer that died before its pointer
    assert t.read("d").count() == 3 and t.commit({"d": spark.range(5)}) == 2 and t.read("d").count() == 5
    assert not t.stale() and t.stale(algorithm="2")


def test_bundle_and_artifacts():
    a, b = (sinks.research_bundle("# m", ["@misc{x}"], ["ref"], {"id": 1}, []) for _ in range(2))
    assert a == b and "references.txt" in zipfile.ZipFile(io.BytesIO(a)).namelist()
    store = sinks.Artifacts()
    key = store.register("x.zip", a)
    assert store.resolve(key, a)["size"] == len(a)
    with pytest.raises(ValueError):
        store.resolve(key, a + b"x")


def test_stream_equals_batch(spark, tmp_path):
    rows = [[(1, 1, "a", "physical", 1, 1, "h"), (1, 2, "b", "physical", 1, 1, "k")], [(2, 90, "m/a", "physical", 1, 1, "h"), (2, 91, "c", "physical", 1, 1, "n")]]
    for r in rows:
        spark.createDataFrame(r, changes.SNAPSHOT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes.change_feed(changes.snapshot_stream(spark, str(tmp_path / "in")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    t = sinks.VersionedTables(spark, str(tmp_path / "t"))
    got = {(r["generation"], r["kind"], r["path"], r["previous_path"]) for r in t.history("events").collect()}
    assert got == {(1, "added", "a", None), (1, "added", "b", None), (2, "moved", "m/a", "a"), (2, "deleted", "b", None), (2, "added", "c", None)}
    assert t.read("state").where("path = 'm/a'").first()["document_id"] == 1


def test_debounce_from_first(spark):
    at = pd.to_datetime(["2024-01-01 00:00:00", "2024-01-01 00:00:04", "2024-01-01 00:00:06", "2024-01-01 00:00:20"])
    got = changes.debounced(spark.createDataFrame(pd.DataFrame({"workspace_id": [1] * 4, "at": at}))).orderBy("first_at").collect()
    assert [r["events"] for r in got] == [2, 1, 1]


def test_plugins(spark):
    d = spark.createDataFrame([(1, "b.txt", "2024", "abcdef0123456789", 5, "private")], "document_id long, name string, modified_at string, content_hash string, size_bytes long, body string")
    p = Plugins()
    for x in (TIMELINE, PACKAGE):
        p.register(x)
    assert "body" not in p.run("timeline", {"documents": d}).columns and p.run("package", {"documents": d}).first()["export_name"].startswith("abcdef012345-")
    with pytest.raises(ValueError):
        p.register(Plugin("x", lambda t: t, {}, frozenset({"network"})))
    assert heuristic_summary(spark.createDataFrame([(1, "One. Two! Three? Four.")], "document_id long, body string")).first()["summary"] == "One. Two! Three?"
    assert spark.createDataFrame([("HTTP 429 rate limit",)], "m string").select(error_code(F.col("m"))).first()[0] == "rate_limited"
