"""Files as relations: scans of trees, archives exploded to members, extraction to pages with locators.

Content is read by Spark's binaryFile source and parsed on the executors, a file at a time; what can't be parsed gets an
error code, not an exception. Of PDF files the text pages are read (pdf.py); image text needs libraries that may be missing:
such files stay metadata-only unless an extractor is registered for their extension.
"""

from __future__ import annotations

import hashlib
import io
import os
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.functions.udfs import MOST_CHARS, recovered_name, sniffed

# Folders that a scan leaves out, and limits of extraction.
SKIPPED = ("node_modules", "__pycache__", "venv", "dist", "build", "target")
MOST_TEXT, MOST_CELLS, MOST_PARAGRAPHS, MOST_SLIDES = 100 << 20, 100_000, 50_000, 5_000
TEXT_KINDS = (".txt", ".md", ".csv", ".json", ".py", ".html", ".xml", ".log", ".yaml", ".tex", ".rst")

PAGE = "struct<number:int,text:string,kind:string,label:string>"


def visible(path: Column) -> Column:
    """Whether a relative path is part of a tree: no hidden or generated folders, no lock files."""
    skipped = "|".join(map(re.escape, SKIPPED))
    return ~path.rlike(rf"(^|/)(\.[^/]*|({skipped})/|~\$[^/]*)")


def matches(path: Column, include: list[str] = (), ignore: list[str] = ()) -> Column:
    """Glob filters: included paths stay whatever the others say."""
    as_regex = lambda g: "^" + re.escape(g).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]") + "$"
    any_of = lambda gs: F.lit(False) if not gs else path.rlike("|".join(f"({as_regex(g)})" for g in gs))
    return any_of(list(include)) | ~any_of(list(ignore))


def empty_files(spark: SparkSession, root: str) -> DataFrame:
    """The files of length zero, which Spark's file sources leave out, listed by the driver."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    listed, rows = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while listed.hasNext():
        f = listed.next()
        if not f.getLen():
            rows.append((f.getPath().toString(), f.getModificationTime()))
    made = spark.createDataFrame(rows, "path string, ms long")
    return made.select("path", F.timestamp_millis("ms").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def scan_tree(spark: SparkSession, root: str, with_content: bool = True, with_empty: bool = False) -> DataFrame:
    """path (relative), name, extension, size, modified_at, content, content_hash of the files below root; empty ones if
    they're asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.unionByName(empty_files(spark, root)) if with_empty else files
    base = F.lit(root.split("://")[-1].rstrip("/") + "/")
    full = F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?(?=/)", "")
    rows = files.select(F.replace(full, base, F.lit("")).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), *(["content"] if with_content else []))
    rows = rows.where(visible(F.col("path")))
    more = [F.sha2("content", 256).alias("content_hash")] if with_content else []
    return rows.select("*", tx.file_name(F.col("path")).alias("name"), tx.extension(F.col("path")).alias("extension"), *more)


@dataclass
class ArchivePolicy:
    """Limits of an archive; a breach of a total ends its scan without members."""

    members: int = 10_000
    member_bytes: int = 100 << 20
    total_bytes: int = 512 << 20
    ratio: float = 100.0
    nested: int = 1


def unsafe_name(name: str) -> str | None:
    parts = name.replace("\\", "/").split("/")
    if "\x00" in name or not name:
        return "invalid_name"
    if name.startswith(("/", "\\")) or ".." in parts or re.match(r"^[A-Za-z]:", name):
        return "unsafe_path"
    return None


def member_error(info: zipfile.ZipInfo, policy: ArchivePolicy) -> str | None:
    if error := unsafe_name(info.filename):
        return error
    if (info.external_attr >> 16) & 0o170000 == 0o120000:
        return "link"
    if info.flag_bits & 1:
        return "encrypted"
    if info.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        return "unsupported_codec"
    if info.file_size > policy.member_bytes:
        return "member_too_large"
    if info.compress_size and info.file_size / info.compress_size > policy.ratio:
        return "suspicious_ratio"
    return None


class _Breach(Exception):
    pass


def _members(data: bytes, outer: str, policy: ArchivePolicy, level: int, spent: list[int], chain: tuple[str, ...]) -> Iterator[tuple]:
    seen: dict[str, int] = {}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for index, info in enumerate(z.infolist()):
            if info.is_dir():
                continue
            spent[0] += 1
            if spent[0] > policy.members:
                raise _Breach("too_many_members")
            name = info.filename if info.flag_bits & 0x800 else recovered_name(info.filename)
            seen[name] = seen.get(name, 0) + 1
            path = f"{outer}!/{name}" + (f"#duplicate-{seen[name]}" if seen[name] > 1 else "")
            error, body = member_error(info, policy), None
            if error is None:
                spent[1] += info.file_size
                if spent[1] > policy.total_bytes:
                    raise _Breach("total_too_large")
                try:
                    with z.open(info) as f:
                        body = f.read(policy.member_bytes + 1)
                    if len(body) > policy.member_bytes:
                        error, body = "member_too_large", None
                except (zipfile.BadZipFile, OSError, RuntimeError, EOFError):
                    error = "damaged_member"
            yield path, [*chain, name], index, level, info.file_size, body, error
            if body is not None and name.lower().endswith(".zip"):
                if level > policy.nested:
                    yield path, [*chain, name], index, level, info.file_size, None, "nested_too_deep"
                else:
                    try:
                        yield from _members(body, path, policy, level + 1, spent, (*chain, name))
                    except zipfile.BadZipFile:
                        yield path, [*chain, name], index, level, info.file_size, None, "damaged_archive"


def archive_members(data: bytes, outer: str, policy: ArchivePolicy) -> list[tuple]:
    """All members of an archive, or one row with the error that voids it."""
    try:
        return list(_members(data, outer, policy, 1, [0, 0], ()))
    except _Breach as e:
        return [(outer, [], None, 0, len(data), None, str(e))]
    except zipfile.BadZipFile:
        return [(outer, [], None, 0, len(data), None, "damaged_archive")]


def materialized(data: bytes, member_indexes: list[int], content_hash: str | None = None) -> bytes:
    """One member's bytes through a chain of archives, if they're what they were."""
    for index in member_indexes:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            info = z.infolist()[index]
            if error := member_error(info, ArchivePolicy()):
                raise ValueError(error)
            data = z.read(info)
    if content_hash is not None and hashlib.sha256(data).hexdigest() != content_hash:
        raise ValueError("source_changed")
    return data


MEMBERS = "container_path string, path string, member_chain array<string>, member_index int, archive_depth int, size long, content binary, error_code string"


def explode_archives(files: DataFrame, policy: ArchivePolicy | None = None) -> DataFrame:
    """Members of the ZIP files among files(path, content), nested ones too; each with its virtual path and any error."""
    policy = policy or ArchivePolicy()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                rows = [(path, *m) for m in archive_members(bytes(data), path, policy)]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBERS.split(", ")])

    return files.where(F.lower("path").endswith(".zip")).select("path", "content").mapInPandas(run, MEMBERS)


def over_budget(rows: DataFrame, key: str, order: str, size: str, most: int) -> DataFrame:
    """Rows of each key up to a running total, with the total: what a byte budget lets through."""
    from pyspark.sql import Window

    total = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", total).withColumn("allowed", F.col("running") <= most)


def stable_snapshot(path: str, attempts: int = 3, wait: float = 0.05) -> tuple[int, int, str, bool]:
    """(size, time of change in ns, SHA-256, whether it stayed as it was while it was read) of a file, the last of so many tries."""
    for left in range(attempts - 1, -1, -1):
        before, digest = os.stat(path), hashlib.sha256()
        with open(path, "rb") as f:
            while part := f.read(1 << 20):
                digest.update(part)
        after = os.stat(path)
        stable = (before.st_size, before.st_mtime_ns) == (after.st_size, after.st_mtime_ns)
        if stable or not left:
            return after.st_size, after.st_mtime_ns, digest.hexdigest(), stable
        time.sleep(wait)
    raise ValueError("at least one attempt")


def stable_snapshots(paths: DataFrame, attempts: int = 3) -> DataFrame:
    """path, size, mtime_ns, content_hash, stable, error_code of paths(path) on a file system that all executors mount."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    rows.append((path, *stable_snapshot(path, attempts), None))
                except OSError:
                    rows.append((path, None, None, None, False, "unreadable"))
            yield pd.DataFrame(rows, columns=["path", "size", "mtime_ns", "content_hash", "stable", "error_code"]).astype({"size": "Int64", "mtime_ns": "Int64"})

    return paths.select("path").mapInPandas(run, "path string, size long, mtime_ns long, content_hash string, stable boolean, error_code string")


# Extraction: bytes to (page number, text, locator kind, locator label)

Page = tuple[int | None, str, str, str]


def read_text(data: bytes) -> list[Page]:
    if len(data) > MOST_TEXT:
        raise ValueError("file_too_large")
    return [(None, sniffed(data, MOST_CHARS) or "", "document", "")]


def read_pdf(data: bytes) -> list[Page]:
    """Pages with the text that they hold; a page without one stays empty, and so is low in readability: recognition's part."""
    from folioscope.sources.pdf import page_texts

    return [(i, t[:MOST_CHARS], "page", f"p. {i}") for i, t in enumerate(page_texts(data), 1)]


def _xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    return ElementTree.fromstring(z.read(name))


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _texts(e: ElementTree.Element) -> str:
    return "".join(x.text or "" if _local(x) == "t" else "\t" if _local(x) == "tab" else "" for x in e.iter())


def read_docx(data: bytes) -> list[Page]:
    out: list[Page] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = next(e for e in _xml(z, "word/document.xml") if _local(e) == "body")
        n_paragraph = n_table = cells = 0
        for block in body:
            if _local(block) == "p" and n_paragraph < MOST_PARAGRAPHS:
                n_paragraph += 1
                style = next((v for e in block.iter() if _local(e) == "pStyle" for v in e.attrib.values()), "")
                if text := _texts(block).strip():
                    out.append((None, text, "paragraph", f"{n_paragraph}" + (f" ({style})" if style.lower().startswith("heading") else "")))
            elif _local(block) == "tbl" and cells < MOST_CELLS:
                n_table += 1
                rows = [[_texts(c).strip() for c in r if _local(c) == "tc"] for r in block if _local(r) == "tr"]
                cells += sum(map(len, rows))
                out.append((None, "\n".join(" | ".join(r) for r in rows), "table", str(n_table)))
    return out


def read_xlsx(data: bytes) -> list[Page]:
    out: list[Page] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = [_texts(e) for e in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        targets = {r.attrib["Id"]: r.attrib["Target"] for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        cells = 0
        for sheet in (e for e in _xml(z, "xl/workbook.xml").iter() if _local(e) == "sheet"):
            link = next(v for k, v in sheet.attrib.items() if k.endswith("}id"))
            rows, refs = [], []
            for row in (e for e in _xml(z, "xl/" + targets[link].removeprefix("/xl/")).iter() if _local(e) == "row"):
                values = []
                for c in row:
                    raw = next((e.text or "" for e in c if _local(e) == "v"), _texts(c))
                    values.append(shared[int(raw)] if c.attrib.get("t") == "s" and raw else raw)
                    refs.append(c.attrib.get("r", ""))
                    cells += 1
                rows.append(" | ".join(values))
                if cells >= MOST_CELLS:
                    break
            out.append((None, "\n".join(rows), "sheet", f"{sheet.attrib.get('name', '')} A1:{refs[-1]}" if refs else sheet.attrib.get("name", "")))
    return out


def read_pptx(data: bytes) -> list[Page]:
    out: list[Page] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        number = lambda n: int(re.findall(r"\d+", n)[-1])
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=number)
        for i, name in enumerate(slides[:MOST_SLIDES], 1):
            paragraphs = [_texts(e) for e in _xml(z, name).iter() if _local(e) == "p"]
            notes = f"ppt/notesSlides/notesSlide{number(name)}.xml"
            said = [_texts(e) for e in _xml(z, notes).iter() if _local(e) == "p"] if notes in z.namelist() else []
            text = "\n".join(p for p in paragraphs if p.strip())
            if any(s.strip() for s in said):
                text += "\n[Notes]\n" + "\n".join(s for s in said if s.strip())
            out.append((i, text, "slide", str(i)))
    return out


class Registry:
    """Extractors by extension, with a key and version that go into the decision whether a file must be read again."""

    def __init__(self) -> None:
        self.by_extension: dict[str, tuple[str, str, Callable[[bytes], list[Page]]]] = {}
        for e in TEXT_KINDS:
            self.register(e, "text", "1", read_text)
        for e, f in ((".docx", read_docx), (".xlsx", read_xlsx), (".xlsm", read_xlsx), (".pptx", read_pptx), (".pdf", read_pdf)):
            self.register(e, e[1:], "1", f)

    def register(self, extension: str, key: str, version: str, read: Callable[[bytes], list[Page]]) -> None:
        self.by_extension[extension] = (key, version, read)

    def extract(self, extension: str, data: bytes) -> tuple[str, str, list[Page], str | None]:
        """(parser key, version, pages, error code): metadata_only without a parser."""
        if extension not in self.by_extension:
            return "none", "0", [], "metadata_only"
        key, version, read = self.by_extension[extension]
        try:
            return key, version, read(data), None
        except Exception as e:  # whatever a damaged file makes a parser raise
            return key, version, [], str(e) if isinstance(e, ValueError) and re.fullmatch(r"[a-z_]+", str(e)) else "parse_failed"


EXTRACTED = f"path string, parser string, parser_version string, pages array<{PAGE}>, error_code string"


def extract(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """path, parser, parser_version, pages, error_code of files(path, extension, content)."""
    registry = registry or Registry()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ext, data in zip(batch["path"], batch["extension"], batch["content"]):
                key, version, pages, error = registry.extract(ext, bytes(data) if data is not None else b"")
                rows.append((path, key, version, [{"number": n, "text": t, "kind": k, "label": label} for n, t, k, label in pages], error))
            yield pd.DataFrame(rows, columns=["path", "parser", "parser_version", "pages", "error_code"])

    return files.select("path", "extension", "content").mapInPandas(run, EXTRACTED)


def indexed_pages(extracted: DataFrame) -> DataFrame:
    """Pages with quality; passages are only made of those that are readable enough."""
    from folioscope.functions.udfs import readability_score

    rows = extracted.select("path", F.posexplode("pages").alias("page_id", "page")).select("path", "page_id", "page.*")
    scored = rows.withColumn("quality_score", readability_score("text"))
    return scored.withColumn("readability", tx.readability_label(F.col("quality_score"))).withColumn("heading", tx.heading(F.col("text")))


def passages_of(pages: DataFrame) -> DataFrame:
    """passage_id, path, page_id, ordinal, heading, body of the pages that are readable enough."""
    from folioscope.functions.udfs import passage_chunks

    good = pages.where("quality_score >= 0.45 and trim(text) <> ''")
    cut = good.select("path", "page_id", "heading", F.posexplode(passage_chunks("text")).alias("ordinal", "body"))
    return cut.select(F.sha2(F.concat_ws("|", "path", "page_id", "ordinal"), 256).alias("passage_id"), "*")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; anything that isn't an object of the schema's types fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def index_header(pages: DataFrame, schema: str) -> DataFrame:
    """The JSON header of index pages (text): between a leading '<!--' or '---' pair; null where there's none."""
    raw = F.regexp_extract("text", r"(?s)^\s*(?:<!--|---)\s*(\{.*?\})\s*(?:-->|---)", 1)
    return pages.withColumn("header", F.from_json(F.when(raw != "", raw), schema))


def search_rows(leaves: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows of the older index: leaves(node_id, path, summary), and folders(node_id, path, summary, children: array of
    struct(node_id, path, summary)) with a row for each child."""
    pick = lambda d, kind: d.select("node_id", F.lit(kind).alias("node_type"), "path", "summary")
    kids = folders.select(F.explode("children").alias("c")).select("c.node_id", F.lit("text").alias("node_type"), "c.path", "c.summary")
    return pick(leaves, "leaf").unionByName(pick(folders, "foldernode")).unionByName(kids)
