"""Attempts at pages over several runs."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioscope.functions.udfs import PARTIAL, READABLE, readability
from folioscope.sources import attempts as at

GOOD = "A page of plain words that anyone can read, quite enough of them to be judged a good page by its score, and some more of them."
FAIR = "\x01short ok page \x02 with some words"
BAD = "\x01\x02\x03\x04"


def reader(folder, kind):
    """Pages are stored as {number: {kind: text}}; each read page leaves a file."""

    def read(content, numbers):
        if content == b"broken":
            raise ValueError("encrypted")
        pages = {int(k): v for k, v in json.loads(content).items()}
        out = {n: pages[n].get(kind, "") for n in (numbers or sorted(pages))}
        for n in out:
            open(os.path.join(folder, f"{kind}-{n}-{os.urandom(6).hex()}"), "w").close()
        return out

    return read


def chosen(page):
    """The rule, for one page with all attempts that it needs."""
    score, text, method = readability(page["a"]), page["a"], "a"
    if score < READABLE and readability(page["b"]) > score:
        score, text, method = readability(page["b"]), page["b"], "b"
    if score < READABLE and page["r"] and (readability(page["r"]) >= score + 0.05 or score < PARTIAL):
        text, method = page["r"], "recognition"
    return method, text


def test_three_runs_read_each_page_once_by_each_method(spark, tmp_path):
    (tmp_path / "seen").mkdir()
    folder = str(tmp_path / "seen")
    pages = {1: {"a": GOOD, "b": "", "r": ""}, 2: {"a": BAD, "b": GOOD, "r": ""}, 3: {"a": BAD, "b": BAD, "r": GOOD}, 4: {"a": FAIR, "b": BAD, "r": BAD}, 5: {"a": BAD, "b": "", "r": ""}, 6: {"a": BAD, "b": FAIR, "r": GOOD}, 7: {"a": "", "b": "", "r": GOOD}}
    file = json.dumps(pages).encode()
    files = spark.createDataFrame([("d", "h", file), ("x", "k", b"broken"), ("e", "m", json.dumps({1: pages[1]}).encode())], "document_id string, content_hash string, content binary")
    work = lambda: at.PageAttempts(spark, str(tmp_path / "log"), (("a", reader(folder, "a")), ("b", reader(folder, "b"))), reader(folder, "r"), per_run=2)
    assert work().run(files) == {"a": 9, "b": 6, "recognition": 2}
    status = {r["document_id"]: (r["pages"], r["recognised"], r["pending"], r["error_code"]) for r in work().documents(files).collect()}
    assert status == {"d": (7, 2, 3, "ocr_budget_exhausted"), "e": (1, 0, 0, None), "x": (0, 0, 0, "encrypted")}
    assert work().run(files) == {"recognition": 2}
    assert work().run(files) == {"recognition": 1}
    assert work().run(files) == {}
    got = {r["page_number"]: (r["method"], r["text"]) for r in work().pages(files).where("document_id = 'd'").collect()}
    assert got == {n: (m, t.strip()) for n, (m, t) in ((n, chosen(p)) for n, p in pages.items())}
    seen = [f.rsplit("-", 1)[0] for f in os.listdir(folder)]
    assert sorted(s for s in seen if s != "a-1") == sorted(set(seen) - {"a-1"}) and seen.count("a-1") == 2  # of two documents
    assert {r["document_id"]: r["error_code"] for r in work().documents(files).collect()} == {"d": None, "e": None, "x": "encrypted"}
    # other contents are other pages
    changed = files.where("document_id = 'e'").withColumn("content_hash", F.lit("new"))
    assert work().run(changed) == {"a": 1}


def test_a_run_that_breaks_off_is_continued(spark, tmp_path, monkeypatch):
    (tmp_path / "seen").mkdir()
    folder = str(tmp_path / "seen")
    files = spark.createDataFrame([("d", "h", json.dumps({1: {"a": BAD, "b": GOOD}, 2: {"a": GOOD}}).encode())], "document_id string, content_hash string, content binary")

    def dies(content, numbers):
        raise SystemExit

    one = at.PageAttempts(spark, str(tmp_path / "log"), (("a", reader(folder, "a")), ("b", dies)))
    with pytest.raises(Exception):
        one.run(files)
    two = at.PageAttempts(spark, str(tmp_path / "log"), (("a", reader(folder, "a")), ("b", reader(folder, "b"))))
    assert two.run(files) == {"b": 1} and {r["page_number"]: r["method"] for r in two.pages(files).collect()} == {1: "b", 2: "a"}


def test_readers_of_pdf_files(spark, tmp_path):
    """A wrong font table makes the first reader fail; the codes themselves are read."""
    cmap = b"1 beginbfrange <20> <7e> <0001> endbfrange"
    parts = [b"<< /Type /Pages /Kids [2 0 R] /Count 1 >>", b"<< /Type /Page /Parent 1 0 R /Contents 3 0 R /Resources << /Font << /F1 4 0 R >> >> >>"]
    stream = lambda d: b"<< /Length %d >>\nstream\n%s\nendstream" % (len(d), d)
    parts += [stream(b"BT /F1 12 Tf (%s) Tj ET" % GOOD.encode()), b"<< /Type /Font /ToUnicode 5 0 R >>", stream(cmap)]
    pdf = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1))
    files = spark.createDataFrame([("p", "h", bytearray(pdf)), ("q", "k", bytearray(b"none"))], "document_id string, content_hash string, content binary")
    work = at.PageAttempts(spark, str(tmp_path / "log"))
    assert work.run(files) == {"text": 2, "codes": 1}
    assert [(r["method"], r["text"]) for r in work.pages(files).collect()] == [("codes", GOOD)]
    assert {r["document_id"]: r["error_code"] for r in work.documents(files).collect()} == {"p": None, "q": "parse_failed"}
