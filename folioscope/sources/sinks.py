"""Results as files and tables: versioned tables with a pointer, Markdown, bundles, artifacts, diagnostics."""

from __future__ import annotations

import hashlib
import io
import json
import re
import time
import uuid
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioscope.functions import text as tx


class OutdatedWriter(RuntimeError):
    """Another writer has published a version since this one read its own, or is about to."""


#: Seconds after which a pointer without contents, or a folder without a pointer, is taken for a dead writer's.
GRACE = 3_600.0


class VersionedTables:
    """Tables below a root: data go to a folder of the writer's own, and one small pointer file makes them current.

    A pointer is named by its version and created only if there is none of that name, so that of two writers one fails (the file
    system must refuse to create a file that's there, as HDFS and local ones do). A commit that names the version it was computed
    from is refused if that isn't the latest one any more. A writer that dies before its pointer is whole leaves the former
    version as it was: recover() closes such pointers and removes the folders that no pointer names; a commit does the former."""

    def __init__(self, spark: SparkSession, root: str, grace: float = GRACE):
        self.spark, self.root, self.grace = spark, root.rstrip("/"), grace

    def _fs(self):
        path = self._path("_meta")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self) -> dict[int, float]:
        """The age in seconds of each version's pointer, whole or not."""
        fs, meta = self._fs()
        listed = fs.listStatus(meta) if fs.exists(meta) else []
        now = time.time()
        return {int(f.getPath().getName().removesuffix(".json")): now - f.getModificationTime() / 1e3 for f in listed if f.getPath().getName().endswith(".json")}

    def _whole(self) -> dict[int, dict]:
        """The pointers that can be read, closed ones too."""
        if not self._files():
            return {}
        kind = "version long, base long, closed boolean, schema_version string, algorithm string, folder string, tables string, schemas string"
        rows = self.spark.read.schema(kind).json(f"{self.root}/_meta").where("tables is not null or closed").orderBy("version").collect()
        return {r["version"]: r.asDict() for r in rows}

    def _pointers(self) -> list[dict]:
        return [p for p in self._whole().values() if not p["closed"]]

    def current(self) -> dict | None:
        return (self._pointers() or [None])[-1]

    def version(self) -> int:
        """The latest version, 0 before the first one: what a commit that is computed from it names as its base."""
        return (self.current() or {"version": 0})["version"]

    def _publish(self, version: int, pointer: dict) -> None:
        fs, meta = self._fs()
        path, text = self.spark._jvm.org.apache.hadoop.fs.Path(meta, f"{version}.json"), json.dumps({"version": version} | pointer)
        try:
            out = fs.create(path, False)
            out.write(bytearray(text.encode()))
            out.close()
        except Exception as e:
            raise OutdatedWriter(f"version {version} is another writer's") from e
        if self._whole().get(version, {}).get("folder") != pointer.get("folder"):
            raise OutdatedWriter(f"version {version} was closed before it was whole")

    def _close_torn(self) -> list[int]:
        """Closes pointers that were left without contents; young ones may be a writer's that is at it just now."""
        fs, meta = self._fs()
        files, whole = self._files(), self._whole()
        torn = sorted(set(files) - set(whole))
        if any(files[v] < self.grace for v in torn):
            raise OutdatedWriter("another writer is publishing")
        for v in torn:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(meta, f"{v}.json"), False)
            self._publish(v, {"closed": True})
        return torn

    def recover(self) -> dict[str, list]:
        """Closes torn pointers and removes the folders of writers that died: those that no pointer names, without a new file in
        the grace time."""
        closed = self._close_torn()
        fs, _ = self._fs()
        named, removed = {p["folder"] for p in self._pointers()}, []
        for f in fs.listStatus(self._path("")) if fs.exists(self._path("")) else []:
            name = f.getPath().getName()
            if re.fullmatch(r"v\d+-[0-9a-f]{32}", name) and name not in named:
                files, last = fs.listFiles(f.getPath(), True), f.getModificationTime()
                while files.hasNext():
                    last = max(last, files.next().getModificationTime())
                if time.time() - last / 1e3 >= self.grace:
                    fs.delete(f.getPath(), True)
                    removed.append(name)
        return {"closed": closed, "removed": sorted(removed)}

    def commit(self, tables: dict[str, DataFrame], schema_version: str = "1", algorithm: str = "1", partitioned: dict[str, list[str]] | None = None, base: int | None = None) -> int:
        """Publishes tables as a new version. base: the version that they were computed from; with None they stand for themselves,
        as what an append-only table adds does."""

        def check() -> int:
            if base is not None and self.version() != base:
                raise OutdatedWriter(f"computed from version {base}, the latest is {self.version()}")
            self._close_torn()
            return max(self._files(), default=0) + 1

        folder = f"v{check()}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.partitionBy(*(partitioned or {}).get(name, [])).parquet(f"{self.root}/{folder}/{name}")
        version = check()  # writing takes its time
        about = {"schema_version": schema_version, "algorithm": algorithm, "folder": folder, "tables": ",".join(sorted(tables))}
        self._publish(version, about | {"base": base, "schemas": json.dumps({n: d.schema.jsonValue() for n, d in tables.items()})})
        return version

    def _table(self, pointer: dict, name: str) -> DataFrame:
        schema = StructType.fromJson(json.loads(pointer["schemas"])[name])  # a table without rows may have no file
        return self.spark.read.schema(schema).parquet(f"{self.root}/{pointer['folder']}/{name}").select(*schema.names)

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._table(self.current() if version is None else self._whole()[version], name)

    def history(self, name: str, with_version: bool = False) -> DataFrame:
        """An append-only table: what each committed version added."""
        out = None
        for p in self._pointers():
            if name in p["tables"].split(","):
                one = self._table(p, name)
                one = one.withColumn("version", F.lit(p["version"])) if with_version else one
                out = one if out is None else out.unionByName(one)
        if out is None:
            raise FileNotFoundError(f"{self.root} has no {name}")
        return out

    def stale(self, schema_version: str = "1", algorithm: str = "1") -> bool:
        """Whether the derived tables must be rebuilt: there are none, or they're of another schema or algorithm."""
        now = self.current()
        return now is None or (now["schema_version"], now["algorithm"]) != (schema_version, algorithm)


def upserted(old: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """old with the rows of new's keys replaced; columns that either lacks are null."""
    return old.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def without(children: DataFrame, removed: DataFrame, *key: str) -> DataFrame:
    """A child table after the removal of parents."""
    return children.join(removed.select(*key).distinct(), list(key), "left_anti")


def task_markdown(tasks: DataFrame, items: DataFrame) -> DataFrame:
    """(task_id, markdown): title and goal, then each slot's items in order: tasks(task_id, title, goal), items(task_id,
    slot_id, position, name, page_number, excerpt, review_state)."""
    where = F.when(F.col("page_number").isNotNull(), F.concat(F.lit(", page "), "page_number")).otherwise("")
    line = F.concat(F.lit("- ["), F.when(F.col("review_state") == "accepted", "x").otherwise(" "), F.lit("] "), "name", where, F.lit(": "), tx.one_line(F.col("excerpt")))
    slots = items.withColumn("line", line).groupBy("task_id", "slot_id").agg(F.expr("listagg(line, '\n') within group (order by position)").alias("lines"))
    body = slots.withColumn("part", F.concat(F.lit("## "), "slot_id", F.lit("\n\n"), "lines")).groupBy("task_id").agg(F.expr("listagg(part, '\n\n') within group (order by slot_id)").alias("body"))
    return tasks.join(body, "task_id", "left").select("task_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), F.coalesce("goal", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("_No evidence yet._")), F.lit("\n")).alias("markdown"))


def results_markdown(results: DataFrame) -> DataFrame:
    """(query_id, markdown) of results(query_id, rank, name, reason, excerpt)."""
    line = F.concat("rank", F.lit(". **"), "name", F.lit("** ("), "reason", F.lit(")\n   > "), "excerpt")
    return results.withColumn("line", line).groupBy("query_id").agg(F.expr("listagg(line, '\n') within group (order by rank)").alias("markdown"))


def folder_markdown(rollup: DataFrame, children: DataFrame) -> DataFrame:
    """(folder, markdown) of a folder's roll-up and its direct children(folder, path, name)."""
    kids = children.withColumn("line", F.concat(F.lit("- "), "name")).groupBy("folder").agg(F.expr("listagg(line, '\n') within group (order by path)").alias("kids"))
    head = F.to_json(F.struct("folder", "files", "bytes", "failed", "pending", "flags"))
    return rollup.join(kids, "folder", "left").select("folder", F.concat(F.lit("<!-- "), head, F.lit(" -->\n# "), "folder", F.lit("\n\n"), "files", F.lit(" files, "), "bytes", F.lit(" bytes\n\n"), F.coalesce("kids", F.lit(""))).alias("markdown"))


def manifest_summary(items: DataFrame) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("included")).alias("included"), F.count_if(~F.col("included")).alias("excluded"), F.coalesce(F.sum(F.when(F.col("included"), F.col("size_bytes"))), F.lit(0)).alias("bytes"))


def research_bundle(markdown: str, bibtex: list[str], references: list[str], task: dict, manifest: list[dict], sources: dict[str, bytes] | None = None) -> bytes:
    """A ZIP of one task's report (a task is small): the same bytes for the same contents."""
    parts = {
        "research.md": markdown.encode(), "references.bib": "\n\n".join(bibtex).encode(), "references.txt": "\n".join(references).encode(),
        "task.json": json.dumps(task, ensure_ascii=False, indent=2, sort_keys=True).encode(), "manifest.json": json.dumps(manifest, ensure_ascii=False, indent=2, sort_keys=True).encode(),
    }
    parts |= {f"sources/{k}": v for k, v in (sources or {}).items()}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), parts[name])
    return out.getvalue()


class Artifacts:
    """Registered exports that can be had for a day, as long as size and digest are what they were."""

    def __init__(self, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc), hours: int = 24):
        self.now, self.hours, self.rows = now, hours, {}

    def register(self, name: str, data: bytes) -> str:
        digest = hashlib.sha256(data).hexdigest()
        key = hashlib.sha256(f"{name}|{digest}".encode()).hexdigest()[:20]
        self.rows[key] = {"name": name, "size": len(data), "sha256": digest, "expires": self.now() + timedelta(hours=self.hours)}
        return key

    def resolve(self, key: str, data: bytes) -> dict:
        row = self.rows.get(key)
        if row is None or self.now() >= row["expires"]:
            raise KeyError("expired")
        if (len(data), hashlib.sha256(data).hexdigest()) != (row["size"], row["sha256"]):
            raise ValueError("changed")
        return row


def diagnostics(nodes: DataFrame, runs: DataFrame) -> dict[str, DataFrame]:
    """State counts, and the last ten runs with messages redacted."""
    last = runs.orderBy(F.desc("finished_at"), "run_id").limit(10).withColumn("message", tx.redacted(F.col("message")))
    return {"states": nodes.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "runs": last}


def evictable(cache: DataFrame, most_bytes: int, now: str, ttl_hours: int) -> DataFrame:
    """Cache entries(path, size, used_at) to delete: too old, or beyond the bytes that the most recently used ones take."""
    from folioscope.operators.numbering import accumulated

    old = F.col("used_at") < F.lit(now).cast("timestamp") - F.expr(f"interval {ttl_hours} hours")
    return accumulated(cache, [F.desc("used_at"), "path"], "_total", value=F.col("size")).where(old | (F.col("_total") > most_bytes)).select("path")
