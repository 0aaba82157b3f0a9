"""Numbers and running sums by ranges against plain ones."""

import random

from pyspark.sql import functions as F

from folioscope.operators.numbering import accumulated


def test_numbers_and_sums_over_a_table_and_within_groups(spark):
    r = random.Random(3)
    # one group holds most rows, some are single, one is null; `value` may be null
    rows = [(r.choice(["hot"] * 12 + ["b", None, f"own{i}"]), i, r.choice([1, 2, 5, None]), "x") for i in range(3000)]
    table = spark.createDataFrame(rows, "g string, i long, value long, part string").repartition(7)
    key = lambda g: (g is not None, g or "")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        every = accumulated(table, [F.desc("i")], "n").collect()
        within = accumulated(table, ["i"], "n", within=["g"]).collect()
        sums = accumulated(table, ["i"], "n", within=["g"], value=F.col("value")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {x["i"]: x["n"] for x in every} == {i: 3000 - i for i in range(3000)}
    number, total = {}, {}
    for g, i, v, _ in sorted(rows, key=lambda x: (key(x[0]), x[1])):
        number[g], total[g] = number.get(g, 0) + 1, total.get(g, 0) + (v or 0)
        number[i], total[i] = number[g], total[g]
    assert {x["i"]: x["n"] for x in within} == {i: number[i] for i in range(3000)}
    assert {x["i"]: x["n"] for x in sums} == {i: total[i] for i in range(3000)}
    assert within[0].asDict().keys() == {"g", "i", "value", "part", "n"}


def test_ties_and_empty_tables(spark):
    table = spark.createDataFrame([(1,)] * 50, "i long")
    assert sorted(x["n"] for x in accumulated(table, ["i"], "n").collect()) == list(range(1, 51))
    assert accumulated(table.limit(0), ["i"], "n").columns == ["i", "n"] and accumulated(table.limit(0), ["i"], "n", within=["i"]).count() == 0
