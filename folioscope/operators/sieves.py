"""Bits of hashed keys, broadcast, that keep most rows without a match out of a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits that a sieve has at most: what bounds the table that is broadcast.
SIEVE_WORDS = 1 << 18


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """(word, bits) of the keys (a long column): a bit for each of 64 SIEVE_WORDS classes of hashes, set where a key falls in it."""
    at = F.xxhash64(F.lit("sieve"), key)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(at, 40), F.lit(64)).cast("int"))
    return keys.groupBy(F.pmod(at, F.lit(SIEVE_WORDS)).alias("_word")).agg(F.bit_or(bit).alias("_bits"))


def sifted(rows: DataFrame, key: str, by: DataFrame) -> DataFrame:
    """rows with the column _maybe: false only where the sieve shows that the key isn't one of its keys. The more keys, the more
    rows pass without being one, so an exact join must follow; it then shuffles only what has passed."""
    at = F.xxhash64(F.lit("sieve"), key)
    met = rows.withColumns({"_at": F.pmod(at, F.lit(SIEVE_WORDS)), "_bit": F.pmod(F.shiftright(at, 40), F.lit(64))})
    met = met.join(F.broadcast(by), F.col("_at") == F.col("_word"), "left")
    has = F.expr("(shiftright(_bits, cast(_bit as int)) & 1) = 1")
    return met.withColumn("_maybe", F.coalesce(has, F.lit(False))).drop("_at", "_bit", "_word", "_bits")
