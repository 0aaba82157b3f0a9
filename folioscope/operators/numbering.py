"""Running numbers and sums over whole tables, or within groups of any size, without a task that sees them all.

Rows are dealt to ranges of the wanted order. Each range is numbered or summed by itself; what a range must add is the total of
the ranges before it, a row for each range. Within groups, only the group that a range starts with can have begun before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.corpus import durable


def accumulated(rows: DataFrame, order: Sequence[str | Column], name: str, within: Sequence[str] = (), value: Column | None = None) -> DataFrame:
    """rows with the column `name`: the sum of value (1 if none) over the row itself and those before it in this order, within
    its group. Without a value these are the row numbers from 1. Null groups are a group; a null value adds nothing. Rows alike
    in the whole order stand in any order. An empty table gives none; a column of the same name is replaced."""
    rows = rows.drop(name)
    value = F.lit(1) if value is None else value
    # the group comes first in the order, so that it lies in neighbouring ranges
    dealt = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    made = dealt.select(F.struct(*rows.columns).alias("row"), F.struct(F.lit(0), *within).alias("of"), F.coalesce(value, F.lit(0)).alias("value"), F.monotonically_increasing_id().alias("at"))
    made = durable(made).withColumn("part", F.shiftright("at", 33))
    sums = made.groupBy("part", "of").agg(F.sum("value").alias("total"))
    # groups that lie in several ranges: there's one at most at each border of two ranges, which bounds what is sent to all
    borders = made.groupBy("part").agg(F.min_by("of", "at").alias("low"), F.max_by("of", "at").alias("high"))
    edges = borders.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("of"))
    sums = sums.join(F.broadcast(edges.withColumnsRenamed({"part": "p", "of": "o"})), (F.col("part") == F.col("p")) & F.col("of").eqNullSafe(F.col("o"))).select("part", "of", "total")
    earlier = Window.partitionBy("of").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.withColumn("before", F.sum("total").over(earlier)).where("before is not null").select(F.col("part").alias("p"), F.col("of").alias("o"), "before")
    own = F.sum("value").over(Window.partitionBy("part", "of").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    met = made.withColumn("own", own).join(F.broadcast(before), (F.col("part") == F.col("p")) & F.col("of").eqNullSafe(F.col("o")), "left")
    return met.select("row.*", (F.col("own") + F.coalesce("before", F.lit(0))).alias(name))
