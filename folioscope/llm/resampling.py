"""Importance resampling towards a target distribution, from a sparse matrix of hashed feature counts.

A text's words (A-Z in lower case; runs of digits, letters and what isn't ASCII) and runs of several words fall into buckets by
crc32. The counts of documents by buckets are kept once, as a Parquet table of CSR blocks: a block is some documents with row
pointers, bucket numbers and counts. Blocks and row groups are small: Spark's reader holds up to 4,096 rows of a row group at once. Column sums of the blocks are the documents' distribution, those of the target texts the
other; a bucket's gain is the logarithm of their smoothed quotient. A sparse product of each block with the gains gives the
weights; Gumbel noise from a hash of the id turns the highest scores into a draw without replacement.

What goes to all tasks has a row for each bucket. The ranks come from ranges of the scores' order, not from one sorted list.

Null texts have no words. A null id hashes like an empty one and comes last among ties; repeated rows are ranked one by one. Empty
tables give no rows, and an empty target gives gains that level the documents' own distribution. Other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import pieces, sized_batches, sliced, stored
from folioscope.operators.numbering import accumulated

BUCKETS, LONGEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: Features whose bucket a worker keeps.
MEMORY = 500_000
#: Bytes of text in a block, beside one document, and of the blocks in a row group: they bound what a task holds, however much it reads.
BLOCK_BYTES, ROW_GROUP = 1 << 17, 2 << 20

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BLOCK = "ids array<long>, words array<long>, features array<long>, ptr array<int>, bucket array<int>, count array<long>"


class Hashed(dict):
    """The bucket of each feature."""

    def __init__(self, buckets: int):
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        self[feature] = at = zlib.crc32(feature) % self.buckets
        return at


def runs(data: bytes, longest: int) -> Iterator[list[bytes]]:
    """All runs of 1 to `longest` consecutive words of a text, in lists of bounded size, the words first of each piece."""
    before: list[bytes] = []
    for piece in pieces(data.translate(_FOLD)):
        words = piece.split()
        yield words
        both = before + words
        for n in range(2, longest + 1):
            yield [b" ".join(both[i : i + n]) for i in range(max(0, len(before) - n + 1), len(both) - n + 1)]
        before = both[max(0, len(both) - longest + 1) :]


def counted(data: bytes, longest: int, hashed: Hashed) -> tuple[int, np.ndarray, np.ndarray]:
    """(words, buckets, counts) of a text."""
    words, found = 0, []
    for i, features in enumerate(runs(data, longest)):
        words += len(features) if i % longest == 0 else 0
        found.append(np.unique(np.fromiter(map(hashed.__getitem__, features), np.int64, len(features)), return_counts=True))
    if len(found) == 1:
        return words, *found[0]
    buckets, place = np.unique(np.concatenate([b for b, _ in found]), return_inverse=True)
    counts = np.zeros(len(buckets), np.int64)
    np.add.at(counts, place, np.concatenate([c for _, c in found]))
    return words, buckets, counts


def blocks(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """CSR blocks of texts(id, text): of row i of a block, buckets and counts stand at ptr[i] to ptr[i + 1]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hashed(buckets)
        for batch, data in sliced(batches, 1, BLOCK_BYTES):
            rows = [counted(d, longest, hashed) for d in data]
            words, features = [n for n, _, _ in rows], [int(c.sum()) for _, _, c in rows]
            ptr = np.append(0, np.cumsum([len(b) for _, b, _ in rows]))
            columns = [batch.column(0), words, features, ptr, np.concatenate([b for _, b, _ in rows]), np.concatenate([c for _, _, c in rows])]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            one = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, k)) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays(one, ["ids", "words", "features", "ptr", "bucket", "count"])

    return sized_batches(texts).mapInArrow(run, BLOCK)


def column_sums(matrix: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features all documents of the matrix have in each bucket; the driver gets a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(total, np.asarray(batch.column(0).flatten()), np.asarray(batch.column(1).flatten()))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in sized_batches(matrix.select("bucket", "count")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / own share)) of each bucket, shares smoothed by one feature a bucket."""
    n, s, t = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(own.tolist(), target.tolist())], np.int64)


def weighed(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of each document's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, words, features, ptr, bucket, count = (batch.column(c)[i].values for c in range(6))
                sums = np.append(0, np.cumsum(gain[np.asarray(bucket)] * np.asarray(count)))
                at, n = np.asarray(ptr), np.asarray(features)
                weight = np.where(n > 0, (sums[at[1:]] - sums[at[:-1]]) // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return sized_batches(matrix).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """floor(1000 g) of a Gumbel number g that the id and the seed give."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs(doc_id, text): of those with least_words words or more,
    that percentage with the highest scores is drawn and ranked, ties to the smaller id; the others' rank is null."""
    matrix = stored(blocks(docs.select(F.col("doc_id").cast("long"), "text"), buckets, longest), "resampling-matrix", ROW_GROUP)
    wanted = blocks(target.select(F.lit(None).cast("long"), "text"), buckets, longest)
    scored = weighed(matrix, gains(column_sums(matrix, buckets), column_sums(wanted, buckets)))
    scored = stored(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    able = F.col("n_words") >= least_words
    drawn = scored.where(able).count() * percent // 100
    placed = accumulated(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id")], "place")
    out = lambda rows, rank: rows.select("doc_id", "n_features", "weight", "score", rank.cast("long").alias("rank"))
    return out(placed, F.when(F.col("place") <= drawn, F.col("place"))).unionByName(out(scored.where(~able), F.lit(None)))
