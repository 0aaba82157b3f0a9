"""What the training-data operators share: reading, durable cuts of lineage, batches, fixed hash folds."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.operators.sieves import sieve, sifted
from folioscope.sources.corpus import durable, shared_dir, sized_batches

#: Characters of text that a Python worker holds at once, beside one document.
SLICE_CHARS = 2_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str, row_group: int | None = None) -> DataFrame:
    """df as a Parquet table of its own in the shared folder, reread: column pruning works on it, as it doesn't on checkpoint().
    row_group bounds the bytes of a row group, and so what a task holds of wide rows while it writes or reads them."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    options = {} if row_group is None else {"parquet.block.size": row_group, "parquet.block.size.row.check.min": 8}
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers each that a task reads at least, where a stored table has no more for each.
GATHERED = 100_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """A stored table of so many rows, none of them wide, in as few partitions as they ask for: tasks that read a few rows each leave
    more in files and logs than the table holds."""
    return df.coalesce(max(1, -(-rows // GATHERED)))


def joined(batches: Iterator[pa.RecordBatch], rows: int, size: int) -> Iterator[pa.RecordBatch]:
    """The batches put together to so many rows or bytes, about."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if held and (sum(b.num_rows for b in held) + batch.num_rows > rows or sum(b.nbytes for b in held) + batch.nbytes > size):
            yield pa.concat_batches(held)
            held = []
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


#: Keys that a join may find hot: each has one of so many of all rows at least, so there are no more.
HOT = 1_000


def met_by_key(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows joined to table(key, ..., count), in which each key stands once with the number of its rows (and is dropped here).
    The few hot keys are broadcast, so that no task gets all rows of one; the others meet by a shuffle."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT >= F.lit(total)
    few, many = table.where(hot).drop(count), table.where(~hot).drop(count)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti")
    return rows.join(F.broadcast(few), key).unionByName(rest.join(many, key))


def whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(columns, where keys start) of whole keys; rows come sorted by key, the first column, and a key's rows may span batches."""
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy() for c in batch.columns]
        if kept and new[0][-1] == kept[-1][0][-1]:
            kept.append(new)
            continue
        cut = int(np.searchsorted(new[0], new[0][-1]))
        whole = [np.concatenate(c) for c in zip(*kept, [c[:cut] for c in new])]
        kept = [[c[cut:] for c in new]]
        if len(whole[0]):
            yield whole, np.append(0, np.flatnonzero(np.diff(whole[0])) + 1)
    if kept:
        whole = [np.concatenate(c) for c in zip(*kept)]
        yield whole, np.append(0, np.flatnonzero(np.diff(whole[0])) + 1)


_holding: dict[str, Callable[[], None]] = {}


def trim() -> None:
    """Gives freed memory back to the system, where the libraries can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def begin(owner: str, drop: Callable[[], None] | None) -> None:
    """(A function of the module, as trim(): a closure that is sent to a worker would get copies of what it names.)"""
    if dropped := [_holding.pop(name) for name in list(_holding) if name != owner]:
        for free in dropped:
            free()
        trim()
    if drop is not None:
        _holding[owner] = drop


def alone(owner: str, drop: Callable[[], None] | None = None) -> Callable:
    """Decorates what a task runs over its batches in a Python worker: at its start what other operators keep in the worker is
    dropped, at its end freed memory goes back, since idle workers stay. drop frees what this operator keeps for its next task."""

    def decorate(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        @functools.wraps(work)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin(owner, drop)
            yield from work(batches)
            trim()

        return run

    return decorate


def doc_slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_CHARS) -> Iterator[tuple[pa.Array, list[str]]]:
    """(doc_id, texts) in slices of bounded size; null texts become empty ones."""
    for batch in batches:
        ids, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
        start = chars = 0
        for i, t in enumerate(texts):
            chars += len(t)
            if chars > most:
                yield ids.slice(start, i + 1 - start), texts[start : i + 1]
                start, chars = i + 1, 0
        if start < len(texts):
            yield ids.slice(start), texts[start:]


def doc_batches(batches: Iterator[pa.RecordBatch], most: int, column: int = 1) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in batches whose texts, in that column, have at most so many bytes, or that are one row."""
    for batch in batches:
        texts = batch.column(column % batch.num_columns)
        sizes = np.asarray(pc.binary_length(texts).fill_null(0), np.int64)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return sized_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def crc_fold(column: str, folds: int):
    """crc32 of a column's text modulo folds; a null column belongs to the fold of the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int, size: Column, most_size: int) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold, whole texts: those of the smallest id hashes, `most` of them
    at most, until they have a size of `most_size` together. The text that reaches it is taken whole. Only a text that alone is
    larger than `most_size` can't be part of a sample of about that size.

    The first bound holds before any text is read: the ids are few, so that the join that fetches the texts broadcasts them.
    Labels that are null or name no document take no part; several labels of a document count as one row each.
    """
    chosen = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (crc_fold("doc_id", folds) != held))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(most)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    met = texts.join(F.broadcast(chosen), "doc_id").withColumns({"size": size, "at": F.xxhash64("doc_id", "label", "text")})
    met = durable(met.where(F.col("size") <= most_size))
    order = Window.orderBy(F.xxhash64("doc_id"), "at").rowsBetween(Window.unboundedPreceding, -1)  # of the chosen ids alone, without their texts
    sizes = met.groupBy("doc_id", "at").agg(F.sum("size").alias("size")).withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    return met.join(F.broadcast(sizes.where(F.col("before") < most_size).select("doc_id", "at")), ["doc_id", "at"]).select("text", "label")


#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_gap = re.compile(rb"[\x20\x09-\x0D]")


def pieces(data: bytes, most: int = PIECE) -> Iterator[bytes]:
    """A text in pieces that end before a space, of about so many bytes or of one word."""
    start = 0
    while len(data) - start > most and (cut := _gap.search(data, start + most)):
        yield data[start : cut.start()]
        start = cut.start()
    yield data[start:] if start else data


def sliced(batches: Iterator[pa.RecordBatch], column: int, most: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The rows in batches of bounded text size, with the texts' bytes (null: empty)."""
    for batch in doc_batches(batches, most, column):
        yield batch, [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
