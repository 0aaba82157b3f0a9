"""Digests of sets of lines that are merged and updated without sorting or holding the lines.

Each line's SHA-256 gives nine numbers of 28 bits; a set's sums of these add up from any parts, in any order, and what leaves a set
is subtracted. The digest of the number of lines and the sums stands for the set: equal sets have equal digests. A row has ten
numbers, however many lines it stands for (up to 2^35). It tells changes apart; it isn't meant to resist someone who
builds lines to order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of a line, and hexadecimal digits of each.
PARTS, DIGITS = 9, 7


def _numbers() -> list[Column]:
    return [F.conv(F.substring("_sha", 1 + DIGITS * i, DIGITS), 16, 10).cast("long") for i in range(PARTS)]


def sums(lines: DataFrame, by: str) -> DataFrame:
    """(by, n, sums) of lines(by, line); null lines count as empty ones."""
    each = lines.select(by, F.sha2(F.coalesce("line", F.lit("")), 256).alias("_sha"))
    return each.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(x) for x in _numbers())).alias("sums"))


def updated(held: DataFrame, by: str, gone: DataFrame, come: DataFrame) -> DataFrame:
    """held(by, n, sums) without the lines of gone(by, line) and with those of come(by, line); what has none left goes."""
    less = sums(gone, by).select(by, (-F.col("n")).alias("n"), F.transform("sums", lambda x: -x).alias("sums"))
    every = held.unionByName(less).unionByName(sums(come, by))
    added = every.groupBy(by).agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(PARTS))).alias("sums"))
    return added.where("n > 0")


def digests(held: DataFrame) -> DataFrame:
    """held(by, n, sums) with the digest of each set."""
    return held.withColumn("digest", F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.transform("sums", lambda x: x.cast("string"))), 256))
