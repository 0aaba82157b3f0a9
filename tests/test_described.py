"""Structure, statistics and evidence of extracted files."""

import struct
import zlib

from folioscope.sources import described as de
from folioscope.sources import files as fs

PAGE = "path string, pages array<struct<number:int,text:string,kind:string,label:string>>, error_code string"


def described(spark, *rows):
    return {r["path"]: r for r in de.described(spark.createDataFrame(list(rows), PAGE)).collect()}


def test_each_kind_of_file(spark):
    got = described(
        spark,
        ("a/n.md", [(None, "# One\nbody\n  ## Two\n", "document", "")], None),
        ("a/t.txt", [(None, "\n first line \nmore", "document", "")], None),
        ("a/s.csv", [(None, 'x,y,z\n1,"a,b",3\n', "document", "")], None),
        ("a/p.pdf", [(1, "Title line\n" + "long text " * 9, "page", "p. 1"), (2, " ", "page", "p. 2")], None),
        ("a/d.docx", [(None, "Top", "paragraph", "1 (Heading 1)"), (None, "plain", "paragraph", "2"), (None, "a | b\nc | d", "table", "1")], None),
        ("a/x.xlsx", [(None, "hello | 7\nq | r", "sheet", "My S A1:B2")], None),
        ("a/q.pptx", [(1, "Hi\nthere\n[Notes]\nsay it", "slide", "1"), (2, "", "slide", "2")], None),
        ("a/u.bin", [], "metadata_only"),
        ("a/broken.pdf", None, "parse_failed"),
    )
    assert got["a/n.md"]["structure"] == ["# One", "## Two"] and got["a/n.md"]["stats"] == {"lines": 3} and [tuple(e) for e in got["a/n.md"]["evidence"]] == [("heading:1", "heading", "# One"), ("heading:2", "heading", "## Two")]
    assert [tuple(e) for e in got["a/t.txt"]["evidence"]] == [("line:1", "text", "first line")] and got["a/t.txt"]["document_type"] == "txt"
    assert got["a/s.csv"]["structure"] == ["CSV sample: 2 rows, 3 columns"]
    pdf = got["a/p.pdf"]
    assert pdf["structure"] == ["P1: Title line", "P2: [no text]"] and pdf["stats"] == {"pages": 2, "native_text_pages": 1} and pdf["quality_flags"] == ["low_text_page:2"]
    assert pdf["text"].startswith("[Page 1]\nTitle line") and [e["locator"] for e in pdf["evidence"]] == ["page:1", "page:2"]
    doc = got["a/d.docx"]
    assert doc["document_type"] == "word" and doc["structure"] == ["Heading 1: Top", "Table 1: 2 rows x 2 columns"] and doc["stats"] == {"paragraphs": 2, "headings": 1, "tables": 1}
    assert doc["text"] == "Top\n\nplain\n\n[Table 1]\na | b\nc | d" and [tuple(e) for e in doc["evidence"]] == [("paragraph:1", "heading", "Top"), ("table:1", "table", "a | b")]
    assert got["a/x.xlsx"]["structure"] == ["Sheet My S: rows=2, columns=2"] and got["a/x.xlsx"]["text"] == "[Sheet: My S]\nhello | 7\nq | r"
    slides = got["a/q.pptx"]
    assert slides["structure"] == ["Slide 1: Hi", "Slide 2: [no title]"] and slides["stats"] == {"slides": 2, "slides_with_notes": 1}
    assert [(e["locator"], e["excerpt"]) for e in slides["evidence"]] == [("slide:1", "Hi"), ("slide:1:notes", "say it"), ("slide:2", "[no title]")] and "[Slide 1 notes]\nsay it" in slides["text"]
    assert got["a/u.bin"]["unsupported"] and got["a/u.bin"]["quality_flags"] == ["unsupported_content_parser"] and got["a/u.bin"]["document_type"] == "bin"
    assert got["a/broken.pdf"]["quality_flags"] == ["parse_failed"] and got["a/broken.pdf"]["text"] == "" and not got["a/broken.pdf"]["unsupported"]


def test_limits(spark):
    got = described(spark, ("a.txt", [(None, "x" * 90_000, "document", "")], None), ("b.pdf", [(i, f"page {i} " * 9, "page", "") for i in range(1, 260)], None))
    assert got["a.txt"]["truncated"] and got["a.txt"]["text_characters"] == 90_000 and len(got["a.txt"]["text"]) < 80_050
    assert len(got["b.pdf"]["evidence"]) == 200 and len(got["b.pdf"]["structure"]) == 259


def png(width, height, kind=2):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)) + chunk(b"IEND", b"")


def test_images(spark):
    gif = b"GIF89a" + struct.pack("<HH", 7, 5) + b"\x00" * 3 + b"\x00\x21\xf9\x04" * 2
    bmp = b"BM" + b"\x00" * 16 + struct.pack("<ii", 4, -3) + b"\x01\x00" + struct.pack("<H", 24)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\x00" * 14 + b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 30, 40, 3) + b"\x00" * 9
    files = spark.createDataFrame([("a.png", ".png", bytearray(png(20, 10, 6))), ("b.gif", ".gif", bytearray(gif)), ("c.bmp", ".bmp", bytearray(bmp)), ("d.jpg", ".jpg", bytearray(jpg)), ("e.png", ".png", bytearray(b"junk"))], "path string, extension string, content binary")
    got = {r["path"]: r for r in de.described(fs.extract(files, de.with_images(fs.Registry()))).collect()}
    assert {k: list(v["structure"]) for k, v in got.items()} == {"a.png": ["Image: 20x10 RGBA"], "b.gif": ["Image: 7x5 P"], "c.bmp": ["Image: 4x3 RGB"], "d.jpg": ["Image: 40x30 RGB"], "e.png": []}
    assert got["b.gif"]["stats"] == {"frames": 2} and got["e.png"]["quality_flags"] == ["unknown_image"] and got["a.png"]["document_type"] == "image"
