"""Extraction by page, in attempts that any number of runs continue.

Each page is read by the first reader; what isn't readable then by the next ones; what still isn't by recognition, a number of pages
of a document a run. Every attempt is a row of a log, committed before the next kind of attempt begins, so that a run that was
broken off, or had no budget left, goes on where the last one ended, and no page is read twice by the same method. Which text
counts follows from the log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.udfs import PARTIAL, READABLE, readability
from folioscope.operators.evidence import ocr_budget
from folioscope.sources.corpus import durable
from folioscope.sources.pdf import page_texts
from folioscope.sources.sinks import VersionedTables

#: reader(content, numbers) gives the text of these pages, of all of them where there are no numbers.
Reader = Callable[[bytes, list[int] | None], dict[int, str]]
KEY = ("document_id", "content_hash")
LOG = "document_id string, content_hash string, page_number int, method string, place int, quality_score double, text string, error_code string"
RECOGNITION = "recognition"
#: Pages of a document that are read, and by how much a recognised text must be better than another one.
MOST_PAGES, GAIN = 2_000, 0.05


def by_texts(tables: bool = True) -> Reader:
    def read(content: bytes, numbers: list[int] | None) -> dict[int, str]:
        every = dict(enumerate(page_texts(content, tables), 1))
        return every if numbers is None else {n: every.get(n, "") for n in numbers}

    return read


#: The readers of PDF files: by their fonts' tables, then by the codes themselves.
PDF = (("text", by_texts()), ("codes", by_texts(False)))


def attempts(method: str, place: int, read: Reader, most_pages: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a task does with files(document_id, content_hash, content, numbers): a row for each page, or one without a page that
    says why there are none."""

    def rows(file) -> Iterator[tuple]:
        numbers = None if file.numbers is None else [int(n) for n in file.numbers]
        try:
            texts = read(bytes(file.content or b""), numbers)
        except Exception as e:  # whatever a damaged file makes a reader raise
            for n in numbers or [None]:
                yield file.document_id, file.content_hash, n, method, place, 0.0, "", str(e) if str(e).isidentifier() else "parse_failed"
            return
        for n in sorted(texts):
            if n <= most_pages:
                text = (texts[n] or "").strip()
                yield file.document_id, file.content_hash, n, method, place, readability(text), text, None
        if not texts or max(texts) > most_pages:
            yield file.document_id, file.content_hash, None, method, place, 0.0, "", "page_limit_reached" if texts else "no_pages"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file in batch.itertuples():
                yield pd.DataFrame(list(rows(file)), columns=[c.split()[0] for c in LOG.split(", ")]).astype({"page_number": "Int32"})

    return work


class PageAttempts:
    def __init__(self, spark: SparkSession, root: str, readers: tuple[tuple[str, Reader], ...] = PDF, recognize: Reader | None = None, per_run: int = 25, most_pages: int = MOST_PAGES):
        self.spark, self.tables = spark, VersionedTables(spark, root)
        self.readers, self.recognize, self.per_run, self.most_pages = readers, recognize, per_run, most_pages

    def log(self) -> DataFrame:
        return self.tables.history("attempts") if self.tables.version() else self.spark.createDataFrame([], LOG)

    def pages(self, files: DataFrame) -> DataFrame:
        """(document_id, content_hash, page_number, method, quality_score, text) of the files' present contents: of the readers'
        attempts the best, the first of equal ones; the recognised text if there's one that is clearly better, or the other isn't
        even partly readable."""
        own = self.log().join(files.select(*KEY).distinct(), list(KEY), "left_semi").where("page_number is not null")
        one = F.struct("method", "quality_score", "text")
        read = F.max_by(F.when(F.col("method") != RECOGNITION, one), F.when(F.col("method") != RECOGNITION, F.struct("quality_score", -F.col("place"))))
        seen = F.max(F.when(F.col("method") == RECOGNITION, one))
        best = own.groupBy(*KEY, "page_number").agg(read.alias("a"), seen.alias("b"))
        better = (F.col("a.quality_score") < READABLE) & (F.col("b.text") != "") & ((F.col("b.quality_score") >= F.col("a.quality_score") + GAIN) | (F.col("a.quality_score") < PARTIAL))
        return best.select(*KEY, "page_number", F.when(F.coalesce(better, F.lit(False)), F.col("b")).otherwise(F.col("a")).alias("x")).select(*KEY, "page_number", "x.*")

    def _without(self, pages: DataFrame, method: str) -> DataFrame:
        done = self.log().where(F.col("method") == method).select(*KEY, "page_number")
        return pages.where(F.col("quality_score") < READABLE).join(done, [*KEY, "page_number"], "left_anti")

    def _read(self, files: DataFrame, method: str, place: int, read: Reader) -> None:
        rows = files.select(*KEY, "content", "numbers").mapInPandas(attempts(method, place, read, self.most_pages), LOG)
        self.tables.commit({"attempts": rows})

    def run(self, files: DataFrame) -> dict[str, int]:
        """Reads what is left to read of files(document_id, content_hash, content); gives how many pages each method read."""
        before = dict(self.log().groupBy("method").count().collect())
        files = files.select(F.col("document_id").cast("string").alias("document_id"), "content_hash", "content").dropDuplicates(list(KEY))
        new = files.join(self.log().select(*KEY).distinct(), list(KEY), "left_anti")
        self._read(new.withColumn("numbers", F.lit(None).cast("array<int>")), *self._named(0))
        for place in range(1, len(self.readers)):
            self._again(files, self._without(self.pages(files), self.readers[place][0]), *self._named(place))
        if self.recognize is not None:
            low = self.pages(files)
            done = self.log().where(F.col("method") == RECOGNITION).select("document_id", "page_number")
            due = ocr_budget(low, done.join(files.select("document_id"), "document_id", "left_semi"), self.per_run) if self.per_run else low.limit(0)
            self._again(files, due.join(self._without(low, RECOGNITION).select(*KEY, "page_number"), [*KEY, "page_number"], "left_semi"), RECOGNITION, len(self.readers), self.recognize)
        after = dict(self.log().groupBy("method").count().collect())
        return {m: n - before.get(m, 0) for m, n in after.items() if n > before.get(m, 0)}

    def _named(self, place: int) -> tuple[str, int, Reader]:
        method, read = self.readers[place]
        return method, place, read

    def _again(self, files: DataFrame, pages: DataFrame, method: str, place: int, read: Reader) -> None:
        wanted = durable(pages.groupBy(*KEY).agg(F.sort_array(F.collect_list("page_number")).alias("numbers")))
        if not wanted.isEmpty():
            self._read(files.join(wanted, list(KEY)), method, place, read)

    def documents(self, files: DataFrame) -> DataFrame:
        """(document_id, pages, readable, recognised, pending, error_code) of the files: pending pages wait for recognition in a
        later run."""
        pages = self.pages(files)
        left = self._without(pages, RECOGNITION).groupBy("document_id").agg(F.count(F.lit(1)).alias("pending")) if self.recognize is not None else None
        out = pages.groupBy("document_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("quality_score") >= READABLE).alias("readable"))
        seen = self.log().where(F.col("method") == RECOGNITION).join(files.select(*KEY).distinct(), list(KEY), "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("recognised"))
        faults = self.log().where("page_number is null").join(files.select(*KEY).distinct(), list(KEY), "left_semi").groupBy("document_id").agg(F.min("error_code").alias("fault"))
        met = files.select(F.col("document_id").cast("string").alias("document_id")).distinct().join(out, "document_id", "left").join(seen, "document_id", "left").join(faults, "document_id", "left")
        met = met.join(left, "document_id", "left") if left is not None else met.withColumn("pending", F.lit(0))
        met = met.fillna(0, ["pages", "readable", "recognised", "pending"])
        return met.select("document_id", "pages", "readable", "recognised", "pending", F.coalesce("fault", F.when(F.col("pending") > 0, "ocr_budget_exhausted")).alias("error_code"))
