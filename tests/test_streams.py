"""Streams with timers against their batch forms; the feed's generations, contents and warnings."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioscope.operators import relations as rel
from folioscope.operators import search as se
from folioscope.sources.sinks import OutdatedWriter, VersionedTables
from folioscope.streaming import changes

SCAN = "path string, generation long, at long, mtime long, content_hash string, locked boolean"


class Feed:
    """A stream of Parquet files whose batches are put in one by one; event time is the clock."""

    def __init__(self, spark, folder, kind, made, name):
        self.spark, self.folder, self.kind, self.name, self.seen = spark, str(folder / "in"), kind, name, 0
        spark.createDataFrame([], kind).write.parquet(self.folder)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(self.folder)
        self.run = made(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(folder / "c")).start()

    def put(self, rows):
        """What comes out of these rows, and of the batches without data that follow."""
        if rows:
            self.spark.createDataFrame(rows, self.kind).coalesce(1).write.mode("append").parquet(self.folder)
        self.run.processAllAvailable()
        out = self.spark.table(self.name).collect()
        new, self.seen = out[self.seen :], len(out)
        return new


@pytest.fixture
def feed(spark, tmp_path):
    made = []

    def start(kind, transform):
        made.append(Feed(spark, tmp_path, kind, transform, f"feed{len(made)}_{tmp_path.name.replace('-', '_')}"))
        return made[-1]

    yield start
    for f in made:
        f.run.stop()


def test_stability_by_stream(spark, feed):
    scans = [
        [("a", 1, 1_000, 900, "h", False), ("b", 1, 1_000, 900, "x", True), ("c", 1, 1_000, 10, "k", False)],
        [("a", 2, 1_100, 900, "h", False), ("b", 2, 1_100, 900, "x", True), ("c", 2, 1_100, 10, "l", False)],
        [("a", 3, 1_200, 900, "h", False), ("b", 3, 1_200, 900, "x", False), ("c", 3, 1_200, 10, "l", False)],
        [("a", 4, 1_300, 1_290, "g", False), ("b", 4, 1_300, 900, "x", True), ("c", 4, 1_300, 1_250, "l", False)],
    ]
    f = feed(SCAN, lambda s: changes.stability_stream(s, deadline=500, forget=5_000, event_time=True))
    last = {}
    for n, rows in enumerate(scans, 1):
        last |= {r["path"]: (r["unchanged"], r["state"]) for r in f.put(rows)}
        flat = spark.createDataFrame([r for part in scans[:n] for r in part], SCAN)
        assert last == {r["path"]: (r["unchanged"], r["state"]) for r in rel.stability(flat, deadline=500).collect()}
    assert last["b"] == (3, "pending_edit")
    # only another file is seen; the clock passes b's deadline, 500 s after its lock was first seen
    assert [(r["path"], r["state"]) for r in f.put([("d", 5, 1_600, 10, "d", False)]) if r["path"] != "d"] == [("b", "stale")]
    # and later all that weren't seen for long are dropped
    gone = f.put([("d", 6, 6_400, 10, "d", False)])
    assert {(r["path"], r["state"]) for r in gone if r["path"] != "d"} == {("a", "expired"), ("b", "expired"), ("c", "expired")}
    assert [(r["path"], r["unchanged"]) for r in f.put([("a", 7, 6_500, 10, "g", False)]) if r["path"] == "a"] == [("a", 0)]


def test_debounce_by_stream(spark, feed):
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    f = feed("workspace_id long, at timestamp", lambda s: changes.debounced_stream(s, 5, event_time=True))
    rows = [[(1, at(0)), (2, at(1))], [(1, at(4)), (1, at(6))], [(3, at(12))], [(3, at(30)), (1, at(31))]]
    got = []
    for n, part in enumerate(rows):
        new = [(r["workspace_id"], r["first_at"], r["events"]) for r in f.put(part)]
        got += new
        if n == 2:  # 2's window ended without another event of its own
            assert (2, at(1), 1) in got and (1, at(6), 1) in got
    got += [(r["workspace_id"], r["first_at"], r["events"]) for r in f.put([(9, at(99))])]
    every = spark.createDataFrame([r for part in rows for r in part], "workspace_id long, at timestamp")
    assert sorted(got) == sorted((r["workspace_id"], r["first_at"], r["events"]) for r in changes.debounced(every).collect())


def test_debounce_by_the_machines_clock(spark, tmp_path):
    """A window is emitted although nothing more comes."""
    kind = "workspace_id long, at timestamp"
    spark.range(2).select(F.lit(1).cast("long").alias("workspace_id"), F.current_timestamp().alias("at")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = changes.debounced_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), 1)
    run = stream.writeStream.format("memory").queryName("machine_clock").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        until = time.time() + 60
        while time.time() < until and not spark.table("machine_clock").count():
            time.sleep(0.5)
        assert [(r["workspace_id"], r["events"]) for r in spark.table("machine_clock").collect()] == [(1, 2)]
    finally:
        run.stop()


def snapshot(spark, *files):
    return spark.createDataFrame([(i, p, "physical", 1, 1, h) for i, p, h in files], "document_id long, path string, source_kind string, size long, mtime long, content_hash string")


def test_feed_of_folders_with_contents_and_warnings(spark, tmp_path):
    """A corrupted file warns once, keeps its former text, and is found by it; a repaired one is current again."""
    root, texts = str(tmp_path), {"h1": "harbour light", "h2": "annual budget", "h3": "annual report", "h9": "repaired budget"}
    read = []

    def extract(files):
        read.append(sorted(r["path"] for r in files.collect()))
        rows = [(h, t) for h, t in texts.items()]
        met = files.join(spark.createDataFrame(rows, "content_hash string, body string"), "content_hash", "left")
        return met.select("path", "body", F.when(F.col("body").isNull(), "parse_failed").alias("error_code"))

    def step(generation, *files):
        changes.announce(snapshot(spark, *files), root, generation)
        changes.change_feed(changes.announced_stream(spark, root), f"{root}/t", f"{root}/c", extract=extract).awaitTermination()
        t = VersionedTables(spark, f"{root}/t")
        events = sorted((r["kind"], r["path"], r["error_code"] or "") for r in t.read("events").collect())
        return events, {r["path"]: (r["document_id"], r["body"], r["freshness"]) for r in t.read("contents").collect()}

    events, now = step(1, (1, "a", "h1"), (2, "b", "h2"), (3, "bad", "?"))
    assert events == [("added", "a", ""), ("added", "b", ""), ("added", "bad", ""), ("parser_warning", "bad", "parse_failed")] and read[-1] == ["a", "b", "bad"]
    assert now == {"a": (1, "harbour light", "current"), "b": (2, "annual budget", "current"), "bad": (3, None, "failed")}
    events, now = step(2, (8, "m/a", "h1"), (7, "b", "?"), (6, "bad", "?"))
    assert events == [("modified", "b", ""), ("moved", "m/a", ""), ("parser_warning", "b", "parse_failed")] and read[-1] == ["b", "bad"]
    assert now == {"m/a": (1, "harbour light", "current"), "b": (2, "annual budget", "stale"), "bad": (3, None, "failed")}
    found = se.bm25(VersionedTables(spark, f"{root}/t").read("contents"), "path", {"body": 1.0}, spark.createDataFrame([(1, "budget")], "query_id long, query string"))
    assert [r["path"] for r in found.collect()] == ["b"]
    events, now = step(3, (8, "m/a", "h1"), (7, "b", "?"), (6, "bad", "?"))
    assert events == [] and now["b"][2] == "stale"
    events, now = step(4, (8, "m/a", "h1"), (7, "b", "h9"), (6, "bad", "h3"))
    assert events == [("modified", "b", ""), ("modified", "bad", "")] and now["b"] == (2, "repaired budget", "current") and now["bad"] == (3, "annual report", "current")


def test_feed_refuses_an_old_base(spark, tmp_path, monkeypatch):
    """A writer who publishes while the feed compares isn't overwritten."""
    changes.announce(snapshot(spark, (1, "a", "h")), str(tmp_path), 1)
    run = lambda: changes.change_feed(changes.announced_stream(spark, str(tmp_path)), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    changes.announce(snapshot(spark, (1, "a", "g")), str(tmp_path), 2)
    other, diff = VersionedTables(spark, str(tmp_path / "t")), rel.diff

    def meanwhile(*a, **b):
        monkeypatch.setattr(rel, "diff", diff)
        other.commit({"state": other.read("state", 1), "events": other.read("events", 1)}, base=1)
        return diff(*a, **b)

    monkeypatch.setattr(rel, "diff", meanwhile)
    with pytest.raises(Exception, match=OutdatedWriter.__name__):
        run()
    run()  # starts from what's there now
    assert other.version() == 3 and [r["kind"] for r in other.read("events").collect()] == ["modified"]
