"""References, scopes, stable reads, dependency cycles and PDF text."""

import json
import zlib

from pyspark.sql import functions as F

from folioscope.operators import evidence as ev
from folioscope.operators import relations as rel
from folioscope.sources import files, pdf


def test_references_are_stored_or_made(spark):
    good = json.dumps({"kind": "physical", "workspace_path": "w", "virtual_path": "v", "stable_id": "s"})
    rows = [(1, good, "a/b.txt", None, None, None), (2, "{broken", "a/c.txt", "archive", None, None), (3, None, "z.zip/m/n.txt", "archive_member", "z.zip", None), (4, "[]", "d.txt", None, None, None)]
    d = spark.createDataFrame(rows, "document_id long, stored string, path string, kind string, container string, member string")
    got = {r["document_id"]: r["x"] for r in d.select("document_id", ev.source_reference(*(F.col(c) for c in ("stored", "path", "kind", "container", "member", "document_id"))).alias("x")).collect()}
    assert (got[1]["workspace_path"], got[1]["stable_id"]) == ("w", "s")
    assert (got[2]["kind"], got[2]["workspace_path"], got[2]["archive_depth"], got[2]["stable_id"]) == ("archive", "a/c.txt", 0, "2")
    assert (got[3]["kind"], got[3]["container_path"], got[3]["member_path"], got[3]["member_chain"], got[3]["archive_depth"]) == ("archive_member", "z.zip", "n.txt", ["n.txt"], 1)
    assert got[4]["kind"] == "physical" and got[4]["stable_id"] == "4"


def test_matches_stay_in_scope(spark):
    cols = "document_id long, path string, content_hash string, source_kind string, container string, member string"
    m = "archive_member"
    docs = spark.createDataFrame([(1, "a", "h1", "physical", None, None), (2, "z/x", "h2", m, "z", "x"), (3, "y/x", "h2", m, "y", "x"), (4, "b", "h4", "physical", None, None), (5, "q/h4", "h4", m, "q", "h4"), (6, "c", "h6", "physical", None, None), (7, "C", "h7", "physical", None, None)], cols)
    items = spark.createDataFrame(
        [(1, "elsewhere", "h", "physical", None, None), (1, "a", "h1", m, "a", "a"), (90, "z/x", "none", m, "Z", "x"), (91, "lost", "h4", "physical", None, None), (92, "lost", "h2", m, "z", "other"), (93, "c", "h6", "physical", None, None), (94, "c", None, "physical", None, None)], cols,
    ).withColumn("n", F.monotonically_increasing_id())
    got = [(r["found_id"], r["found_by"]) for r in rel.matched_in_scope(items, docs).orderBy("n").collect()]
    # an id of another kind doesn't count; a container's name does in any case; members' content not outside their place; two paths alike match neither
    assert got == [(1, "id"), (None, "none"), (2, "path"), (4, "hash"), (None, "none"), (6, "hash"), (None, "none")]


def test_stable_reads(spark, tmp_path, monkeypatch):
    path = tmp_path / "f"
    path.write_bytes(b"abc")
    assert files.stable_snapshot(str(path))[3] is True
    real, calls = files.os.stat, []

    def moving(p, *a, **k):
        calls.append(p)
        path.write_bytes(b"x" * len(calls))
        return real(p, *a, **k)

    monkeypatch.setattr(files.os, "stat", moving)
    assert files.stable_snapshot(str(path), attempts=3, wait=0)[3] is False and len(calls) >= 6
    monkeypatch.undo()
    got = {r["path"]: r for r in files.stable_snapshots(spark.createDataFrame([(str(path),), (str(tmp_path / "none"),)], "path string")).collect()}
    assert got[str(path)]["stable"] and got[str(tmp_path / "none")]["error_code"] == "unreadable"


def test_cycles(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (102, 100), (99, 100), (102, 103), (200, 200)]
    got = {(r["node"], r["needed"]) for r in rel.cyclic(spark.createDataFrame(edges, "node long, needed long")).collect()}
    assert got == {(100, 101), (101, 102), (102, 100), (200, 200)}
    assert rel.cyclic(spark.createDataFrame([], "node long, needed long")).count() == 0


def test_warnings_and_feeds(spark):
    from folioscope.streaming.changes import events_since, parser_warnings

    kind = "path string, error_code string"
    before = spark.createDataFrame([("a", None), ("b", "parse_failed"), ("c", "encrypted")], kind)
    now = spark.createDataFrame([("a", "parse_failed"), ("b", "parse_failed"), ("c", None), ("d", "encrypted"), ("e", None)], kind)
    assert {tuple(r) for r in parser_warnings(now, before).collect()} == {("parser_warning", "a", "parse_failed"), ("parser_warning", "d", "encrypted")}
    events = spark.range(10).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    done = events.where("event_id in (7, 9)")
    assert [r["event_id"] for r in events_since(events, "1970-01-01 00:04:00", done, limit=3).collect()] == [8, 6, 5]
    assert events_since(events, None, done).count() == 8


def pdf_file(contents, fonts=b"", more=b""):
    """A file of a page for each content stream, packed."""
    out, n = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", len(contents)
    out += b"2 0 obj << /Type /Pages /Count %d /Kids [%s] >> endobj\n" % (n, b" ".join(b"%d 0 R" % (10 + i) for i in range(n)))
    for i, c in enumerate(contents):
        packed = zlib.compress(c)
        out += b"%d 0 obj << /Type /Page /Parent 2 0 R /Resources << /Font << %s >> >> /Contents %d 0 R >> endobj\n" % (10 + i, fonts, 50 + i)
        out += b"%d 0 obj << /Length %d /Filter /FlateDecode >> stream\n%s\nendstream endobj\n" % (50 + i, len(packed), packed)
    return out + more + b"%%EOF"


def test_pdf_pages():
    one = rb"BT /F1 12 Tf 72 720 Td (Annual \(budget\) r\351port) Tj 0 -14 Td [(sec) 20 (ond) -250 (line)] TJ ET"
    table = b"beginbfchar <0001> <0041> endbfchar beginbfrange <0002> <0004> <4E2D> endbfrange"
    more = b"80 0 obj << /Type /Font /ToUnicode 81 0 R >> endobj 81 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(table), table)
    data = pdf_file([one, b"BT /F2 9 Tf <00010002> Tj (\\000\\004) Tj ET", b"q Q"], b"/F1 79 0 R /F2 80 0 R", more)
    assert pdf.page_texts(data) == ["Annual (budget) réport\nsecond line", "A中丯", ""]


def test_pdf_as_files(spark):
    rows = [("a.pdf", ".pdf", pdf_file([b"BT (words) Tj ET"])), ("b.pdf", ".pdf", b"no pdf"), ("c.pdf", ".pdf", pdf_file([b""], more=b"/Encrypt 9 0 R")), ("d.png", ".png", b"x")]
    got = {r["path"]: r for r in files.extract(spark.createDataFrame(rows, "path string, extension string, content binary")).collect()}
    assert [p["text"] for p in got["a.pdf"]["pages"]] == ["words"] and got["a.pdf"]["pages"][0]["label"] == "p. 1"
    assert (got["b.pdf"]["error_code"], got["c.pdf"]["error_code"], got["d.png"]["error_code"]) == ("parse_failed", "encrypted", "metadata_only")
