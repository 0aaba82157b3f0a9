import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.operators import evidence as ev
from folioscope.operators import relations as rel
from folioscope.sources import files as fs
from folioscope.sources import sinks


def test_dos_times(spark):
    d = spark.createDataFrame([((44 << 9) | (5 << 5) | 6, (7 << 11) | (8 << 5) | 9), (0, 0)], "d int, t int")
    got = [str(r[0]) for r in d.select(F.date_format(ev.dos_time(F.col("d"), F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-05-06 07:08:18", "1970-01-01 00:00:00"]


def test_stored_json(spark):
    d = spark.createDataFrame([('[{"a":1},{"a":2}]', ["x", "y", "x"]), ("nonsense", []), (None, None)], "j string, ids array<string>")
    got = d.select(ev.json_structs(F.col("j"), "struct<a:int>", 1).alias("s"), ev.positions(F.col("ids")).alias("p")).collect()
    assert [len(r["s"]) for r in got] == [1, 0, 0] and got[0]["p"] == {"x": 1, "y": 2}


def test_templates_and_confirmation(spark):
    assert ev.template_slots(spark).groupBy("template_id").count().count() == 3
    items = spark.createDataFrame([("t", "c1", 4)], "task_id string, item_id string, position int")
    proposed = spark.createDataFrame([("s1", "c1", 1, "e"), ("s1", "c2", 2, "e"), ("s2", "c3", 3, "e")], "slot_id string, candidate_id string, document_id long, excerpt string")
    got = ev.confirmed(proposed, items, "t").orderBy("position").collect()
    assert [(r["item_id"], r["position"]) for r in got] == [("c2", 5), ("c3", 6)]


def test_best_extraction(spark):
    rows = [(1, 1, "native", 1, 0.5, "a"), (1, 1, "second", 2, 0.8, "b"), (1, 1, "ocr", 3, 0.9, "c"), (2, 1, "native", 1, 0.3, "d"), (2, 1, "ocr", 3, 0.4, "e")]
    d = spark.createDataFrame(rows, "document_id long, page_number int, method string, place int, quality_score double, text string")
    assert {r["document_id"]: r["method"] for r in ev.best_extraction(d).collect()} == {1: "second", 2: "ocr"}


def test_materialized_members():
    def pack(name, data):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr(name, data)
        return out.getvalue()

    outer = pack("in.zip", pack("a.txt", b"deep"))
    assert fs.materialized(outer, [0, 0], hashlib.sha256(b"deep").hexdigest()) == b"deep"
    with pytest.raises(ValueError):
        fs.materialized(outer, [0, 0], "other")


def test_cache_eviction(spark):
    d = spark.createDataFrame([("new", 5, "2024-01-02 00:00:00"), ("mid", 5, "2024-01-01 12:00:00"), ("old", 1, "2023-01-01 00:00:00")], "path string, size int, used_at string").withColumn("used_at", F.col("used_at").cast("timestamp"))
    assert sorted(r["path"] for r in sinks.evictable(d, 6, "2024-01-02 01:00:00", 48).collect()) == ["mid", "old"]


def test_budget_and_upsert(spark):
    d = spark.createDataFrame([("z", 1, 5), ("z", 2, 5), ("z", 3, 5)], "key string, n int, size int")
    assert [r["allowed"] for r in fs.over_budget(d, "key", "n", "size", 10).orderBy("n").collect()] == [True, True, False]
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    new = spark.createDataFrame([(2, "B", 9)], "id long, v string, extra int")
    assert sorted((r["id"], r["v"], r["extra"]) for r in sinks.upserted(old, new, "id").collect()) == [(1, "a", None), (2, "B", 9)]


def test_proposals_fall_back(spark):
    slots = spark.createDataFrame([("s1",), ("s2",)], "slot_id string")
    none = spark.createDataFrame([("c1", 2, "zz"), ("c2", 1, "zz")], "candidate_id string, rank int, slot_id string")
    assert {(r["slot_id"], r["candidate_id"]) for r in rel.proposals(none, slots, 1).collect()} == {("s1", "c2")}


def test_files_to_read_again(spark):
    f = spark.createDataFrame([("a", 1, 1, "h", "p1"), ("b", 1, 1, "h", "p1"), ("c", 1, 1, "h", "p1")], "path string, size int, mtime int, content_hash string, parser string")
    known = spark.createDataFrame([("a", 1, 1, "h", "p1", "indexed"), ("b", 1, 1, "h", "p0", "indexed"), ("c", 1, 1, "h", "p1", "failed")], "path string, size int, mtime int, content_hash string, parser string, state string")
    assert sorted(r["path"] for r in rel.to_extract(f, known).collect()) == ["b", "c"]
