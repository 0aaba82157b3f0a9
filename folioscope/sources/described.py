"""What a file's extracted pages say of it: structure, statistics, evidence, flags and its text, cut.

Everything follows from the pages that sources.files.extract() gives, as expressions on a file's own row. Images have no text here;
read_image() gives their size and mode from their heads, for those who register it.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.sources.files import Registry

# Characters and pieces of evidence that are kept, structure lines and evidence of a text, rows of a table and of a sheet,
# characters under which a page is low in text, and extensions of images.
MOST_CHARACTERS, MOST_EVIDENCE, MOST_HEADINGS, HEADING_EVIDENCE, TABLE_ROWS, SHEET_ROWS, LOW_TEXT = 80_000, 200, 100, 50, 20, 50, 40
IMAGES = (".png", ".gif", ".bmp", ".jpg", ".jpeg")
TYPES = {".docx": "word", ".xlsx": "excel", ".xlsm": "excel", ".pptx": "ppt", ".pdf": "pdf", **dict.fromkeys(IMAGES, "image")}


def read_image(data: bytes) -> list[tuple]:
    """One page without text whose label is the picture's size, mode and number of frames."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        width, height, _, kind = struct.unpack(">IIBB", data[16:26])
        mode, frames = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}[kind], 1
        if (at := data.find(b"acTL")) > 0:
            frames = struct.unpack(">I", data[at + 4 : at + 8])[0]
    elif data[:6] in (b"GIF87a", b"GIF89a"):
        width, height = struct.unpack("<HH", data[6:10])
        mode, frames = "P", max(1, data.count(b"\x00\x21\xf9\x04"))
    elif data[:2] == b"BM":
        width, height = (abs(x) for x in struct.unpack("<ii", data[18:26]))
        mode, frames = {1: "1", 8: "P", 24: "RGB", 32: "RGBA"}[struct.unpack("<H", data[28:30])[0]], 1
    elif data[:2] == b"\xff\xd8":
        at, frames = 2, 1
        while not (0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC)):  # up to the frame's head
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        height, width, parts = struct.unpack(">HHB", data[at + 5 : at + 10])
        mode = {1: "L", 3: "RGB", 4: "CMYK"}[parts]
    else:
        raise ValueError("unknown_image")
    return [(None, "", "image", f"{width}x{height} {mode} {frames}")]


def with_images(registry: Registry) -> Registry:
    for extension in IMAGES:
        registry.register(extension, "image", "1", read_image)
    return registry


EVIDENCE = "array<struct<locator:string,kind:string,excerpt:string>>"


def _lines(text: Column) -> Column:
    return F.split(text, r"\r\n|\r|\n")


def _first_line(text: Column) -> Column:
    return F.coalesce(F.get(F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0)), F.lit(""))


def _evidence(locator: Column, kind: str, excerpt: Column) -> Column:
    return F.struct(locator.alias("locator"), F.lit(kind).alias("kind"), excerpt.alias("excerpt"))


def _part(structure: Column, evidence: Column, text: Column) -> Column:
    return F.struct(structure.cast("array<string>").alias("structure"), evidence.cast(EVIDENCE).alias("evidence"), text.alias("text"))


def _of_page(page: Column, extension: Column) -> Column:
    """struct(structure, evidence, text) of one page of a file."""
    text, number = F.coalesce(page["text"], F.lit("")), page["number"].cast("string")
    label, none = F.coalesce(page["label"], F.lit("")), F.array()
    rows = F.split(text, "\n")
    columns = lambda r: F.size(F.split(F.coalesce(F.get(r, F.lit(0)), F.lit("")), r" \| "))
    first, top = _first_line(text), lambda n: F.array_join(F.slice(rows, 1, n), "\n")

    index, style = F.regexp_extract(label, r"^(\d+)", 1), F.regexp_extract(label, r"\((.*)\)$", 1)
    heading = _part(F.array(F.concat(style, F.lit(": "), F.left(text, F.lit(160)))), F.array(_evidence(F.concat(F.lit("paragraph:"), index), "heading", text)), text)
    shape = F.concat(F.lit("Table "), label, F.lit(": "), F.size(rows), F.lit(" rows x "), columns(rows), F.lit(" columns"))
    table = _part(F.array(shape), F.array(_evidence(F.concat(F.lit("table:"), label), "table", rows[0])), F.concat(F.lit("[Table "), label, F.lit("]\n"), top(TABLE_ROWS)))
    name = F.regexp_replace(label, r" A1:[A-Z]+\d+$", "")
    size = F.concat(F.lit("Sheet "), name, F.lit(": rows="), F.size(rows), F.lit(", columns="), columns(rows))
    sheet = _part(F.array(size), F.array(_evidence(F.concat(F.lit("sheet:"), name), "worksheet", rows[0])), F.concat(F.lit("[Sheet: "), name, F.lit("]\n"), top(SHEET_ROWS)))
    said = F.split(text, r"\n?\[Notes\]\n", 2)
    title, notes = _first_line(said[0]), F.get(said, F.lit(1))
    title = F.when(title == "", "[no title]").otherwise(F.left(title, F.lit(160)))
    spoken = _evidence(F.concat(F.lit("slide:"), number, F.lit(":notes")), "speaker_notes", notes)
    slide = _part(
        F.array(F.concat(F.lit("Slide "), number, F.lit(": "), title)),
        F.filter(F.array(_evidence(F.concat(F.lit("slide:"), number), "slide", title), F.when(notes.isNotNull(), spoken)), lambda x: x.isNotNull()),
        F.concat(F.lit("[Slide "), number, F.lit("]\n"), said[0], F.when(notes.isNotNull(), F.concat(F.lit("\n\n[Slide "), number, F.lit(" notes]\n"), notes)).otherwise("")),
    )
    line = F.when(first == "", "[no text]").otherwise(F.left(first, F.lit(120)))
    paper = _part(F.array(F.concat(F.lit("P"), number, F.lit(": "), line)), F.array(_evidence(F.concat(F.lit("page:"), number), "page", first)), F.concat(F.lit("[Page "), number, F.lit("]\n"), text))
    image = _part(F.array(F.concat(F.lit("Image: "), F.regexp_replace(label, r" \d+$", ""))), none, text)

    heads = F.slice(F.filter(F.transform(_lines(text), lambda x: F.trim(x)), lambda x: F.startswith(x, F.lit("#"))), 1, MOST_HEADINGS)
    cells = F.transform(F.filter(_lines(F.left(text, F.lit(50_000))), lambda x: x != ""), lambda x: F.size(F.split(F.regexp_replace(x, r'"([^"]|"")*"', "q"), ",")))
    sample = F.concat(F.lit("CSV sample: "), F.size(cells), F.lit(" rows, "), F.coalesce(F.array_max(cells), F.lit(0)), F.lit(" columns"))
    listed = F.when(extension == ".csv", F.concat(F.array(sample), heads)).otherwise(heads)
    named = F.transform(F.slice(listed, 1, HEADING_EVIDENCE), lambda x, i: _evidence(F.concat(F.lit("heading:"), i + 1), "heading", x))
    plain = _part(listed, F.when(F.size(named) > 0, named).when(first != "", F.array(_evidence(F.lit("line:1"), "text", first))).otherwise(none.cast(EVIDENCE)), text)

    kind = page["kind"]
    return (
        F.when(kind == "page", paper).when((kind == "paragraph") & (style != ""), heading).when(kind == "paragraph", _part(none, none, text)).when(kind == "table", table)
        .when(kind == "sheet", sheet).when(kind == "slide", slide).when(kind == "image", image).otherwise(plain)
    )


def described(extracted: DataFrame) -> DataFrame:
    """(path, document_type, text, text_characters, truncated, structure, evidence, stats, quality_flags, unsupported) of
    extract()'s rows (path, pages, error_code). Files that no parser reads have only their type and a flag."""
    extension = tx.extension(F.col("path"))
    kind = F
    for e, name in TYPES.items():
        kind = kind.when(extension == e, name)
    rows = extracted.select("path", "error_code", extension.alias("e"), F.coalesce("pages", F.array().cast(extracted.schema["pages"].dataType)).alias("pages"))
    rows = rows.withColumn("parts", F.transform("pages", lambda p: _of_page(p, F.col("e"))))
    text = F.array_join(F.filter(F.transform("parts", lambda x: x["text"]), lambda t: t != ""), "\n\n")
    is_ = lambda *kinds: F.filter("pages", lambda p: p["kind"].isin(*kinds))
    count = lambda test: F.size(F.filter("pages", test)).cast("long")
    stats = {
        "pages": count(lambda p: p["kind"] == "page"), "native_text_pages": count(lambda p: (p["kind"] == "page") & (F.trim(p["text"]) != "")), "paragraphs": count(lambda p: p["kind"] == "paragraph"),
        "headings": count(lambda p: (p["kind"] == "paragraph") & p["label"].like("%(%")), "tables": count(lambda p: p["kind"] == "table"), "sheets": count(lambda p: p["kind"] == "sheet"),
        "slides": count(lambda p: p["kind"] == "slide"), "slides_with_notes": count(lambda p: (p["kind"] == "slide") & F.contains(p["text"], F.lit("[Notes]\n"))),
        "lines": F.aggregate(F.transform(is_("document"), lambda p: F.size(_lines(F.regexp_replace(p["text"], r"(\r\n|\r|\n)\z", "")))), F.lit(0), lambda a, x: a + x).cast("long"),
        "frames": F.coalesce(F.regexp_extract(F.get(F.transform(is_("image"), lambda p: p["label"]), F.lit(0)), r"(\d+)$", 1).cast("long"), F.lit(0).cast("long")),
    }
    low = F.transform(F.filter("pages", lambda p: (p["kind"] == "page") & (F.length(F.trim(p["text"])) < LOW_TEXT)), lambda p: F.concat(F.lit("low_text_page:"), p["number"]))
    unsupported = F.coalesce(F.col("error_code") == "metadata_only", F.lit(False))
    flags = F.concat(low, F.when(unsupported, F.array(F.lit("unsupported_content_parser"))).when(F.col("error_code").isNotNull(), F.array("error_code")).otherwise(F.array().cast("array<string>")))
    every = F.map_from_arrays(F.array(*map(F.lit, stats)), F.array(*stats.values()))
    made = rows.withColumn("whole", text)
    return made.select(
        "path", kind.otherwise(F.when(F.col("e") == "", "text").otherwise(F.expr("substring(e, 2)"))).alias("document_type"), tx.truncated(F.col("whole"), MOST_CHARACTERS).alias("text"), F.length("whole").alias("text_characters"),
        (F.length("whole") > MOST_CHARACTERS).alias("truncated"), F.flatten(F.transform("parts", lambda x: x["structure"])).alias("structure"),
        F.slice(F.flatten(F.transform("parts", lambda x: x["evidence"])), 1, MOST_EVIDENCE).alias("evidence"), F.map_filter(every, lambda _, v: v > 0).alias("stats"),
        F.array_sort(F.array_distinct(flags)).alias("quality_flags"), unsupported.alias("unsupported"),
    )
