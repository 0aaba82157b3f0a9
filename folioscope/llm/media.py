"""Media columns: interleaved document sequences.

HTML pages become ordered sequences of text and media-reference structs: parts(pos, kind, text, digest, caption). A
reference names its payload by digest (src="media:DIGEST"); a join on digests resolves it against a media store, each
distinct payload once, whatever number of pages show it. Positions are kept, and captions stay with their reference.

The store holds payloads as 8-bit grey PNG images 576 samples wide, written here and read back to compute features.

Nulls count as empty texts, whose payload is one row of padding. References without a stored payload keep null payload
columns. Repeated rows each give a row; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import html
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import doc_slices, durable, id_and_text, met_by_key, sieve, sifted, sized_batches, stored

WIDTH, PAD = 576, b"\xff"
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    data = text.encode()
    return data + PAD * ((-len(data)) % WIDTH if data else WIDTH)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of WIDTH columns whose samples are the payload's bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter type 0
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png has written."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, head, data = 8, b"", []
    while at < len(media):
        size, kind = struct.unpack(">I4s", media[at : at + 8])
        body = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        head, data = (body if kind == b"IHDR" else head), data + [body] * (kind == b"IDAT")
        at += 12 + size
    width, height = struct.unpack(">II", head[:8])
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line filter that isn't supported")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean and spread of the samples, and 64 bits: which of 64 equal stretches are brighter than the mean."""
    x = np.frombuffer(payload, np.uint8)
    edges = np.arange(65) * len(x) // 64
    sums = np.add.reduceat(x, edges[:-1], dtype=np.int64)
    means = sums / np.diff(edges)
    bits = np.packbits(means > x.mean()).tobytes().hex()
    return f"{x.mean():.4f}:{x.std():.4f}:{bits}"


class _Interleaver(HTMLParser):
    """Ordered parts of a page: text between media, and media references with captions (figcaption, else alt)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[dict] = []
        self.text: list[str] = []
        self.figure: dict | None = None
        self.hidden = self.caption = 0

    def flush(self) -> None:
        text = "".join(self.text)
        if text.strip():
            self.parts.append({"kind": "text", "text": text, "digest": None, "caption": None})
        self.text = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        if tag in ("script", "style", "template"):
            self.hidden += 1
        elif tag in ("img", "source", "video", "audio") and (own.get("src") or "").startswith("media:"):
            self.flush()
            self.parts.append({"kind": "media", "text": None, "digest": own["src"][6:], "caption": own.get("alt")})
            self.figure = self.parts[-1]
        elif tag == "figcaption":
            self.flush()
            self.caption += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption:
            self.caption -= 1
            if self.figure is not None:
                self.figure["caption"] = "".join(self.text)
                self.text = []
            else:
                self.flush()
        elif tag == "figure":
            self.figure = None
        elif tag in ("p", "div", "section", "li", "h1", "h2", "h3"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)

    def result(self) -> list[dict]:
        self.close()
        self.flush()
        return [{"pos": i, **p} for i, p in enumerate(self.parts)]


def parse_page(page: str) -> list[dict]:
    parser = _Interleaver()
    parser.feed(page)
    return parser.result()


PARTS = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
PARTS_SQL = "array<struct<pos:int,kind:string,text:string,digest:string,caption:string>>"


def sequences(pages: DataFrame) -> DataFrame:
    """(id, parts) of pages(id, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in doc_slices(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([parse_page(t) for t in texts], PARTS)], ["id", "parts"])

    pages = pages.select(F.col("id").cast("long").alias("id"), "html")
    return sized_batches(pages).mapInArrow(run, f"id long, parts {PARTS_SQL}")


def references(parts: DataFrame) -> DataFrame:
    """(id, pos, digest, caption): a row for each media reference of parts(id, parts)."""
    each = parts.select("id", F.explode("parts").alias("x")).where("x.kind = 'media'")
    return each.select("id", F.col("x.pos").alias("pos"), F.col("x.digest").alias("digest"), F.col("x.caption").alias("caption"))


def resolve(refs: DataFrame, store: DataFrame) -> DataFrame:
    """references() with the columns of store(digest, ...), null where it has no such digest. Digests that many references
    name don't meet in one task."""
    names = refs.groupBy("digest").agg(F.count(F.lit(1)).alias("n_refs")).where("digest is not null")
    met = met_by_key(refs, durable(names.join(store, "digest", "left")), "digest", "n_refs")
    return met.unionByName(refs.where("digest is null"), allowMissingColumns=True)


#: Characters of a paragraph that pages_of() makes, about, and of what is kept of the text beside a reference.
PARAGRAPH, BESIDE = 2_000, 40


def paragraphs(text: str, size: int = PARAGRAPH) -> list[str]:
    """A text in parts of about that size that end with a line where they can, none of them blank, unless the text is."""
    out, start = [], 0
    while start < len(text):
        end = text.find("\n", start + size) + 1 or len(text)
        end = min(end, start + 2 * size)
        if out and not text[start:end].strip():
            out[-1] += text[start:end]
        elif out and not out[-1].strip():
            out[-1] += text[start:end]
        else:
            out.append(text[start:end])
        start = end
    return out


def page_of(text: str, digest: str) -> str:
    """A page that shows a text in paragraphs and, between them, the whole text's picture with a caption."""
    caption, parts = f"{len(text)} characters", [f"<p>{html.escape(x)}</p>" for x in paragraphs(text)]
    middle = (len(parts) + 1) // 2
    figure = f'<figure><img src="media:{digest}"><figcaption>{caption}</figcaption></figure>'
    return f"<html><body>{''.join(parts[:middle])}{figure}{''.join(parts[middle:])}</body></html>"


SHOWN = "id long, pos int, digest string, caption string, before string, after string, n_parts int, text_sha256 string"


def shown_in(parts: list[dict]) -> list[tuple]:
    """(pos, digest, caption, before, after, n_parts, text_sha256) of each reference of a page: the text that stands right before
    and after it, and of the page the number of parts and the digest of its texts in order."""
    texts = [p["text"] or "" for p in parts]
    digest = hashlib.sha256("".join(texts).encode()).hexdigest()
    beside = lambda i: texts[i] if 0 <= i < len(parts) else ""
    return [(p["pos"], p["digest"], p["caption"], beside(i - 1)[-BESIDE:], beside(i + 1)[:BESIDE], len(parts), digest) for i, p in enumerate(parts) if p["kind"] == "media"]


def shown_pictures(docs: DataFrame) -> DataFrame:
    """SHOWN of docs(doc_id, text): each text is made a page that refers to the text's picture by digest, the page is parsed, and
    its references are given with what stands beside them. Pages don't leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in SHOWN.split(", ")]
        for ids, texts in doc_slices(batches):
            rows = [(i, *r) for i, t in enumerate(texts) for r in shown_in(parse_page(page_of(t, hashlib.sha256(payload_of(t)).hexdigest())))]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array([r[0] for r in rows], pa.int64())), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds, 1))], names)

    return id_and_text(docs).mapInArrow(run, SHOWN)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """(n, text) of docs(doc_id, text), each distinct text once; nulls are empty texts, n says nothing. Only texts that a sieve
    of hashes takes for repeated ones are shuffled."""
    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    repeated = rows.groupBy("hash").count().where("count > 1")
    rows = sifted(rows, "hash", sieve(durable(repeated.select("hash")), "hash"))
    once = rows.where("not _maybe").select("text").unionByName(rows.where("_maybe").select("text").distinct())
    return once.select(F.lit(0).cast("long").alias("n"), "text")


def pictures_of(docs: DataFrame) -> DataFrame:
    """(digest, media) of docs(doc_id, text): the picture of each distinct text under its payload's digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in doc_slices(batches):
            payloads = [payload_of(t) for t in texts]
            digests = [hashlib.sha256(p).hexdigest() for p in payloads]
            yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array([to_png(p) for p in payloads], pa.binary())], ["digest", "media"])

    return sized_batches(distinct_texts(docs)).mapInArrow(run, "digest string, media binary")


#: What reading a stored picture back gives.
SEEN = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}


def read_back(store: DataFrame) -> DataFrame:
    """digest and SEEN of store(digest, media), a row for each digest; n_bytes is the payload without its padding, which no
    UTF-8 text ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *(pa.int64() if k == "long" else pa.string() for k in SEEN.values())]
        for batch in batches:
            rows = []
            for digest, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                payload = from_png(blob)
                rows.append((digest, len(payload.rstrip(PAD)), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(blob), hashlib.sha256(blob).hexdigest(), feature(payload)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["digest", *SEEN])

    each = sized_batches(store.select("digest", "media")).mapInArrow(run, "digest string, " + ", ".join(f"{c} {k}" for c, k in SEEN.items()))
    return each.groupBy("digest").agg(*(F.min(c).alias(c) for c in SEEN))  # copies of a payload have the same picture


def document_media(docs: DataFrame) -> DataFrame:
    """(doc_id, SEEN, pos, caption, before, after, n_parts, text_sha256) of every text of docs(doc_id, text): shown as a picture
    between its paragraphs in a page, the picture stored, resolved by digest and read back. Narrow rows meet in the join, not
    pictures nor texts."""
    seen = read_back(stored(pictures_of(docs), "media-store"))
    shown = resolve(durable(shown_pictures(docs)), seen)
    return shown.select(F.col("id").alias("doc_id"), *SEEN, "pos", "caption", "before", "after", "n_parts", "text_sha256")
