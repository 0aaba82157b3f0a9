"""Incremental ingest as Structured Streaming: snapshots to change events, debounce, stability by file."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators import relations as rel
from folioscope.sources.corpus import durable
from folioscope.sources.sinks import VersionedTables

SNAPSHOT = "generation long, document_id long, path string, source_kind string, size long, mtime long, content_hash string"


ANNOUNCED = "generation long, folder string"


def snapshot_stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Snapshots that arrive as Parquet files, a whole one in each, so many at a time."""
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", files).parquet(path)


def announce(snapshot: DataFrame, root: str, generation: int) -> None:
    """Writes a snapshot of any size to a folder of its own, then a small file that says so."""
    spark, folder = snapshot.sparkSession, f"{root.rstrip('/')}/snapshots/{generation}-{uuid.uuid4().hex}"
    snapshot.withColumn("generation", F.lit(generation).cast("long")).write.parquet(folder)
    spark.createDataFrame([(generation, folder)], ANNOUNCED).coalesce(1).write.mode("append").json(f"{root.rstrip('/')}/announced")


def announced_stream(spark: SparkSession, root: str) -> DataFrame:
    """The snapshots that announce() wrote, as their folders: what goes through the stream is a row for each."""
    path = f"{root.rstrip('/')}/announced"
    return spark.readStream.schema(ANNOUNCED).json(path)


def with_ids(new: DataFrame, old: DataFrame, found: DataFrame) -> DataFrame:
    """The new snapshot's files with ids: a known or moved file keeps its id, others have their own."""
    ids = old.select("path", F.col("document_id").alias("old_id"))
    moved = found.where("kind = 'moved'").select("path", F.col("document_id").alias("moved_id"))
    met = new.join(ids, "path", "left").join(moved, "path", "left")
    return met.withColumn("document_id", F.coalesce("old_id", "moved_id", "document_id")).drop("old_id", "moved_id")


def ingested(state: DataFrame, found: DataFrame, before: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(path, document_id, content_hash, body, freshness, error_code) of every file of the new state. Only files that were added or
    modified, or couldn't be read before, are extracted; one that can't be read any more keeps its last good text, marked stale."""
    known = before.select("path", "content_hash", "body", "freshness", "error_code")
    moved = found.where("kind = 'moved'").select("path", F.col("previous_path").alias("was"))
    placed = state.select("path", "document_id", "content_hash").join(moved, "path", "left").withColumn("was", F.coalesce("was", "path"))
    met = placed.join(known.withColumnsRenamed({c: f"k_{c}" for c in known.columns}), F.col("was") == F.col("k_path"), "left")
    fresh = F.coalesce((F.col("k_content_hash") == F.col("content_hash")) & F.col("k_error_code").isNull(), F.lit(False))
    met = durable(met.withColumn("fresh", fresh))
    read = extract(met.where(~F.col("fresh")).select("path", "document_id", "content_hash")).select("path", F.col("body").alias("n_body"), F.col("error_code").alias("n_error"))
    last = met.join(read, "path", "left")
    failed = ~F.col("fresh") & (F.col("n_error").isNotNull() | F.col("n_body").isNull())
    return last.select(
        "path", "document_id", "content_hash",
        F.when(F.col("fresh") | failed, F.col("k_body")).otherwise(F.col("n_body")).alias("body"),
        F.when(failed, F.when(F.col("k_body").isNull(), "failed").otherwise("stale")).otherwise("current").alias("freshness"),
        F.when(failed, F.coalesce("n_error", F.lit("unreadable"))).alias("error_code"),
    )


def change_feed(stream: DataFrame, root: str, checkpoint: str, every: str | None = None, extract: Callable[[DataFrame], DataFrame] | None = None):
    """Runs what's available, or, given an interval such as "15 minutes", goes on reconciling at it. Each of a batch's snapshots,
    whole ones (snapshot_stream) or named by folder (announced_stream), is compared with the state table, in order; a new version
    holds the state and the events (history() has all), and says which version it was computed from, so that a writer who
    publishes in between isn't overwritten. A batch that comes again after a failure finds its generation there and adds nothing.

    With extract, which takes files(path, document_id, content_hash) and gives (path, body, error_code), the version also holds
    the contents, and a file that can't be read, or no longer, or for another reason than before, makes a parser_warning event."""

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        tables = VersionedTables(spark, root)
        by_folder = "folder" in batch.columns
        for row in sorted(batch.select("generation", *(["folder"] if by_folder else [])).distinct().collect()):
            generation = row["generation"]
            new = spark.read.schema(SNAPSHOT).parquet(row["folder"]) if by_folder else batch.where(F.col("generation") == generation)
            new, base = new.drop("generation"), tables.version()
            if base:
                done = tables.read("state", base).agg(F.max("generation")).first()[0]
                if done is not None and generation <= done:
                    continue
            old = tables.read("state", base).drop("generation") if base else new.limit(0)
            found = rel.diff(old, new.drop("document_id")).select("kind", "document_id", "path", "previous_path")
            state = with_ids(new, old, found)
            events, out = found.withColumn("error_code", F.lit(None).cast("string")), {}
            if extract is not None:
                none = spark.createDataFrame([], "path string, document_id long, content_hash string, body string, freshness string, error_code string")
                before = tables.read("contents", base) if base else none
                contents = durable(ingested(durable(state), durable(found), before, extract))
                moved = found.where("kind = 'moved'").select("path", F.col("previous_path").alias("was"))
                was = before.select("path", "error_code").join(moved.withColumnsRenamed({"path": "now", "was": "path"}), "path", "left").select(F.coalesce("now", "path").alias("path"), "error_code")
                warned = parser_warnings(contents, was).join(contents.select("path", "document_id"), "path")
                events = events.unionByName(warned.withColumn("previous_path", F.lit(None).cast("string")))
                out["contents"] = contents
            tables.commit(out | {"state": state.withColumn("generation", F.lit(generation)), "events": events.withColumn("generation", F.lit(generation))}, base=base)

    when = {"processingTime": every} if every else {"availableNow": True}
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**when).start()


def parser_warnings(extracted: DataFrame, before: DataFrame) -> DataFrame:
    """Events (kind, path, error_code) of files that couldn't be read, or no longer, or for another reason than before; both are
    extracted(path, error_code)."""
    was = before.select("path", F.col("error_code").alias("_was"))
    new = extracted.where("error_code is not null").join(was, "path", "left").where("not error_code <=> _was")
    return new.select(F.lit("parser_warning").alias("kind"), "path", "error_code")


def events_since(events: DataFrame, since, acknowledged: DataFrame, limit: int = 1_000, time: str = "ts", key: str = "event_id") -> DataFrame:
    """The latest events after a time (all, if it's null) that aren't among the acknowledged ones, newest first."""
    later = events if since is None else events.where(F.col(time) > F.lit(since).cast(events.schema[time].dataType))
    return later.join(acknowledged.select(key), key, "left_anti").orderBy(F.desc(time), F.desc(key)).limit(limit)


def debounced(events: DataFrame, seconds: int = 5) -> DataFrame:
    """(workspace_id, first_at, events): pending events are collected from the first one on for so long, whatever comes in
    between, then the next one starts anew: events(workspace_id, at). A sequential rule, so one ordered pass per workspace."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for at in pdf["at"].sort_values():
            if out and at < out[-1][0] + pd.Timedelta(seconds=seconds):
                out[-1][1] += 1
            else:
                out.append([at, 1])
        return pd.DataFrame({"workspace_id": pdf["workspace_id"].iloc[0], "first_at": [o[0] for o in out], "events": [o[1] for o in out]})

    return events.select("workspace_id", F.col("at").cast("timestamp").alias("at")).groupBy("workspace_id").applyInPandas(run, "workspace_id long, first_at timestamp, events long")


def _timers(event_time: bool) -> tuple[str, Callable[[GroupState], int]]:
    """The kind of timers, and the clock in milliseconds that they go by: the watermark's or the machine's."""
    if event_time:
        return GroupStateTimeout.EventTimeTimeout, lambda state: state.getCurrentWatermarkMs()
    return GroupStateTimeout.ProcessingTimeTimeout, lambda state: state.getCurrentProcessingTimeMs()


def _wake(state: GroupState, at: int, now: int, event_time: bool) -> None:
    if event_time:
        state.setTimeoutTimestamp(max(at, now + 1))
    else:
        state.setTimeoutDuration(max(at - now, 1))


def debounced_stream(events: DataFrame, seconds: int = 5, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """The streaming form of debounced(): a workspace's window is emitted `seconds` after its first event, by a timer, whether or
    not another one comes. By event time the watermark, `late` behind the newest event, is the clock; else the machine's."""
    kind, clock = _timers(event_time)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, n = state.get if state.exists else (None, 0)
        out, span = [], seconds * 1000
        for pdf in batches:
            for at in sorted(pdf["ms"].tolist()):
                if first is not None and at >= first + span:
                    out.append((first, n))
                    first, n = None, 0
                first, n = (at, 1) if first is None else (min(first, at), n + 1)
        now = clock(state)
        if first is not None and (state.hasTimedOut or now >= first + span):
            out.append((first, n))
            first, n = None, 0
        if first is None:
            if state.exists:
                state.remove()
        else:
            state.update((first, n))
            _wake(state, first + span, now, event_time)
        yield pd.DataFrame([(key[0], x, n) for x, n in out], columns=["workspace_id", "first", "events"])

    e = events.select("workspace_id", F.col("at").cast("timestamp").alias("at"))
    e = (e.withWatermark("at", late) if event_time else e).withColumn("ms", F.unix_millis("at"))
    found = e.groupBy("workspace_id").applyInPandasWithState(step, "workspace_id long, first long, events long", "first long, n long", "append", kind)
    return found.select("workspace_id", F.timestamp_millis("first").alias("first_at"), "events")


def stability_stream(scans: DataFrame, times: int = 2, quiet: int = 120, deadline: int = 86_400, forget: int = 7 * 86_400, event_time: bool = False, late: str = "0 seconds") -> DataFrame:
    """The streaming form of relations.stability(): (path, unchanged, state, at) after each batch that saw a file of scans(path,
    generation, at, mtime, content_hash, locked), at and mtime in seconds. A timer turns a file that stays locked stale when its
    deadline passes, without a new scan; another one drops what isn't seen for `forget` seconds, as state expired."""
    kind, clock = _timers(event_time)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, unchanged, since, locked, seen, mtime, told = state.get if state.exists else (None, -1, None, False, 0, 0, "")
        now = clock(state) // 1000
        if state.hasTimedOut:
            if now >= seen + forget:
                state.remove()
                found = "expired"
            else:
                found = "stale" if locked and now >= since + deadline else told
            rows = [] if found == told else [(key[0], unchanged, found, now)]
        else:
            every = pd.concat(list(batches)).sort_values("generation")
            for row in every.itertuples():
                unchanged = unchanged + 1 if isinstance(digest, str) and row.content_hash == digest else 0
                digest, locked, seen, mtime = row.content_hash, bool(row.locked), int(row.at), int(row.mtime)
                since = int(row.at) if locked and since is None else since
            if locked:
                found = "stale" if seen - since >= deadline else "pending_edit"
            else:
                found = "queued" if unchanged >= times and seen - mtime >= quiet else "pending_stable"
            rows = [(key[0], unchanged, found, seen)]
        if found != "expired":
            state.update((digest, unchanged, since, locked, seen, mtime, found))
            due = seen + forget
            if locked and found != "stale":
                due = min(due, since + deadline)
            _wake(state, due * 1000, clock(state), event_time)
        yield pd.DataFrame(rows, columns=["path", "unchanged", "state", "at"])

    s = scans.withColumn("moment", F.timestamp_seconds("at"))
    s = s.withWatermark("moment", late) if event_time else s
    kept = "digest string, unchanged int, since long, locked boolean, seen long, mtime long, told string"
    return s.groupBy("path").applyInPandasWithState(step, "path string, unchanged int, state string, at long", kept, "append", kind)


def to_refresh(cards: DataFrame, items: DataFrame, retry: bool = False) -> DataFrame:
    """Items(id, content_hash) whose card is missing or of other content; failed ones only when a retry is asked for."""
    met = items.join(cards.select("id", F.col("content_hash").alias("card_hash"), "state"), "id", "left")
    fresh = (F.col("card_hash") == F.col("content_hash")) & ((F.col("state") == "done") | (F.lit(not retry) & (F.col("state") == "failed")))
    return met.where(~F.coalesce(fresh, F.lit(False))).select("id", "content_hash")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """User sessions of an event stream(ts, user_id): (user_id, start, events)."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if e.isStreaming else e
    return e.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("start"), "events")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("n = 1").drop("n")
