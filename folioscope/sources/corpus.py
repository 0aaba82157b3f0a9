"""The driver's tables as the engine's relations: documents with paths and states, passages, queries, snapshots, tasks.

States that the tables don't have are rules on doc_id, plain arithmetic, so that SQL can state them too.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import text as tx


#: Rows and bytes that go to a Python worker at once: one setting for all operators, so that it doesn't matter in which order plans
#: are built and run. What wants more at once gathers batches in the worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20


def sized_batches(df: DataFrame) -> DataFrame:
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with batches that bound what a Python worker gets of its texts at once."""
    return sized_batches(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. A local one only where none is set and Spark itself is local."""
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (set_.get() if set_.isDefined() else None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that all executors see")
        where = os.path.join(tempfile.gettempdir(), "folioscope-shared")
    return where.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: its lineage is cut, and a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def by_residue(key: Column, *cases: tuple[int, int, str], otherwise: str) -> Column:
    out = F
    for modulus, residue, value in cases:
        out = out.when(key % modulus == residue, value)
    return out.otherwise(otherwise)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, path, name, stem, extension, parent, title, body, content_hash, size_bytes, modified_at, lang, source,
    indexing_state, readability, source_kind, quality_flags, status, node_type."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    name = F.concat(F.lit("doc-"), i, F.lit(".txt"))
    path = F.concat_ws("/", "source", "lang", name)
    return d.select(
        i.alias("document_id"),
        path.alias("path"),
        name.alias("name"),
        F.concat(F.lit("doc-"), i).alias("stem"),
        F.lit(".txt").alias("extension"),
        F.concat_ws("/", "source", "lang").alias("parent"),
        tx.heading(F.col("text")).alias("title"),
        F.col("text").alias("body"),
        tx.text_digest(F.col("text")).alias("content_hash"),
        F.col("n_chars").alias("size_bytes"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int")), "yyyy-MM-dd").alias("modified_at"),
        "lang",
        "source",
        by_residue(i, (20, 0, "metadata_only"), (33, 0, "failed"), (47, 0, "queued"), otherwise="indexed").alias("indexing_state"),
        by_residue(i, (10, 9, "low"), (5, 2, "partial"), otherwise="readable").alias("readability"),
        by_residue(i, (25, 1, "archive_member"), otherwise="physical").alias("source_kind"),
        F.when(i % 7 == 0, F.array(F.lit("low_text"), F.lit("scanned"))).when(i % 11 == 0, F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>")).alias("quality_flags"),
        by_residue(i, (13, 0, "stale"), (17, 0, "pending_stable"), (19, 0, "failed"), otherwise="current").alias("status"),
        by_residue(i, (6, 0, "foldernode"), (6, 1, "leaf"), otherwise="text").alias("node_type"),
    )


def passages(docs: DataFrame, whole: bool = False) -> DataFrame:
    """passage_id, document_id, ordinal, heading, body of documents(document_id, title, body): overlapping chunks, or (whole)
    each text as one passage. Headings are those of the text."""
    if whole:
        return docs.select(F.col("document_id").alias("passage_id"), "document_id", F.lit(0).alias("ordinal"), F.col("title").alias("heading"), "body")
    from folioscope.functions.udfs import passage_chunks

    cut = docs.select("document_id", F.col("title").alias("heading"), F.posexplode(passage_chunks("body")).alias("ordinal", "body"))
    return cut.select(F.concat_ws(":", "document_id", "ordinal").alias("passage_id"), "document_id", "ordinal", "heading", "body")


def queries(spark: SparkSession, sf_dir: str, words: int = 3) -> DataFrame:
    """(query_id, query): of each benchmark item its first distinct words of five letters or more."""
    b = table(spark, sf_dir, "benchmark")
    long = F.filter(F.array_distinct(F.split(tx.normalized(F.col("text")), " ")), lambda w: F.length(w) >= 5)
    return b.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(long, 1, words), " ").alias("query")).where("query <> ''")


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of the same tree (path, source_kind, size, mtime, content_hash, document_id): of the second, some files are
    gone, some moved, some edited, some only touched, some new."""
    d = documents(spark, sf_dir).select("document_id", "path", "source_kind", F.col("size_bytes").alias("size"), "content_hash")
    i = F.col("document_id")
    old = d.where(i % 29 != 3).withColumn("mtime", i * 1000)
    new = d.where(i % 31 != 4).select(
        "document_id",
        F.when(i % 23 == 5, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path")).alias("path"),
        "source_kind",
        F.when(i % 19 == 6, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(i % 19 == 6, F.sha2(F.concat(F.col("content_hash"), F.lit("x")), 256)).otherwise(F.col("content_hash")).alias("content_hash"),
        F.when(i % 37 == 7, i * 1000 + 1).otherwise(i * 1000).alias("mtime"),
    )
    return old, new.drop("document_id")


def task_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated evidence: task_id, item_id, document_id (of the first snapshot), path, content_hash, slot_id, review_state,
    position."""
    old, _ = snapshots(spark, sf_dir)
    i = F.col("document_id")
    return old.where(i % 9 == 0).select(
        F.concat(F.lit("task-"), i % 12).alias("task_id"),
        F.concat(F.lit("item-"), i).alias("item_id"),
        "document_id",
        "path",
        F.when(i % 27 == 0, F.lit(None).cast("string")).otherwise(F.col("content_hash")).alias("content_hash"),
        F.concat(F.lit("slot-"), i % 3).alias("slot_id"),
        by_residue(i, (2, 0, "accepted"), otherwise="pending").alias("review_state"),
        F.col("document_id").alias("position"),
    )
