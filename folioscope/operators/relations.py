"""Filters, lookups, change detection, folders, tasks, evaluation, citations and checks as DataFrame transformations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators import digests as dg
from folioscope.operators import grams as gr
from folioscope.operators.numbering import accumulated
from folioscope.operators.search import asked, few, ranked
from folioscope.operators.sieves import sieve, sifted
from folioscope.sources.corpus import durable

# Filters and lookups


def filtered(
    docs: DataFrame,
    prefix: str | None = None,
    extensions: list[str] | None = None,
    readability: list[str] | None = None,
    states: list[str] | None = None,
    kinds: list[str] | None = None,
    since: str | None = None,
    until: str | None = None,
    scope: DataFrame | None = None,
) -> DataFrame:
    """All given filters, ANDed; scope(document_id) restricts to a task's documents."""
    tests = [tx.is_below(F.col("path"), prefix)] if prefix else []
    tests += [F.col(c).isin(v) for c, v in (("extension", extensions), ("readability", readability), ("indexing_state", states), ("source_kind", kinds)) if v]
    tests += [F.col("modified_at") >= since] if since else []
    tests += [F.col("modified_at") <= until] if until else []
    for t in tests:
        docs = docs.where(t)
    return docs.join(scope.select("document_id").distinct(), "document_id", "left_semi") if scope is not None else docs


def post_filter(types: list[str] | None = None, prefix: str | None = None, statuses: list[str] | None = None, flags: list[str] | None = None, after: str | None = None, before: str | None = None) -> Column:
    """The older ranker's filter after its candidates' limit; rows without a time fail a time filter."""
    test = F.lit(True)
    for given, t in (
        (types, lambda: F.col("node_type").isin(types)),
        (prefix, lambda: tx.is_below(F.col("path"), prefix)),
        (statuses, lambda: F.col("status").isin(statuses)),
        (flags, lambda: F.arrays_overlap("quality_flags", F.array(*map(F.lit, flags)))),
        (after, lambda: F.coalesce(F.col("modified_at") >= after, F.lit(False))),
        (before, lambda: F.coalesce(F.col("modified_at") <= before, F.lit(False))),
    ):
        if given:
            test = test & t()
    return test


def in_given_order(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """ids(position, document_id) looked up, in their order, first mention of each."""
    return docs.join(ids.groupBy("document_id").agg(F.min("position").alias("position")), "document_id").orderBy("position")


def prefiltered(docs: DataFrame, query: str, limit: int = 2000) -> DataFrame:
    """The compatible mode for large corpora: each term in name, title or path; the first paths."""
    terms = tx.search_terms(F.lit(query))
    held = F.forall(terms, lambda t: F.contains(F.lower("name"), t) | F.contains(F.lower("title"), t) | F.contains(F.lower("path"), t))
    return docs.where(held).orderBy("path").limit(limit)


def guarded(rows: DataFrame, forbidden: tuple[str, ...] = ("query", "path", "text", "participant_name", "email")) -> DataFrame:
    """rows, unless they carry a column that must not leave the machine."""
    if found := sorted({c.lower() for c in rows.columns} & set(forbidden)):
        raise ValueError(f"forbidden columns: {', '.join(found)}")
    return rows


# Health and counts


def health(docs: DataFrame) -> DataFrame:
    ready = F.col("indexing_state") == "indexed"
    return docs.agg(
        F.count(F.lit(1)).alias("total"),
        *(F.count_if(ready & (F.col("readability") == r)).alias(r) for r in ("readable", "partial", "low")),
        *(F.count_if(F.col("indexing_state") == s).alias(s) for s in ("metadata_only", "failed", "queued")),
        F.max("modified_at").alias("last_modified"),
    )


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def document_scores(pages: DataFrame) -> DataFrame:
    """pages(document_id, page_id, quality_score, text): mean score, whether seven tenths are readable, and then the first text."""
    readable = F.avg((F.col("quality_score") >= 0.72).cast("double")) >= 0.7
    got = pages.groupBy("document_id").agg(F.round(F.avg("quality_score"), 4).alias("score"), readable.alias("overview_ok"), F.min_by("text", "page_id").alias("first_text"))
    return got.select("document_id", "score", F.when(F.col("overview_ok"), tx.one_line(F.col("first_text"))).alias("overview"))


def estimate(docs: DataFrame, costs: dict[str, tuple[float, float]], other: tuple[float, float] = (0.05, 0.2)) -> DataFrame:
    """Per format: files, bytes, and seconds by the cost table (median, high), supported or not."""
    cost = lambda i: F.coalesce(F.element_at(F.create_map(*(x for k, v in costs.items() for x in (F.lit(k), F.lit(v[i])))), F.col("extension")), F.lit(other[i]))
    g = docs.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"))
    return g.select("extension", "files", "bytes", F.col("extension").isin(list(costs)).alias("supported"), F.round(F.col("files") * cost(0), 6).alias("p50_s"), F.round(F.col("files") * cost(1), 6).alias("p95_s"), F.ceil(F.col("bytes") * 0.35).cast("long").alias("required_bytes"))


def top_keywords(texts: DataFrame, key: str, body: str, stop: tuple[str, ...], k: int = 8) -> DataFrame:
    """Most frequent words of three letters or more; of equally frequent ones, those seen first. The texts are dealt by key before
    they are split, so that their words aren't shuffled."""
    words = texts.select(key, body).repartition(key).select(key, F.posexplode(F.regexp_extract_all(F.lower(body), F.lit(r"([\p{L}\p{N}_]+)"), 1)).alias("at", "word"))
    counted = words.where((F.length("word") >= 3) & ~F.col("word").isin(*stop)).groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "first"))
    return counted.withColumn("rank", place).where(F.col("rank") <= k).select(key, "rank", "word", "n")


def merged_counters(rows: DataFrame, *counters: str) -> DataFrame:
    """Sums of map-typed counters by key: (counter, key, total)."""
    out = None
    for c in counters:
        part = rows.select(F.lit(c).alias("counter"), F.explode(c).alias("key", "value")).groupBy("counter", "key").agg(F.sum("value").alias("total"))
        out = part if out is None else out.unionByName(part)
    return out


# Snapshots


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(kind, document_id, path, previous_path): added, modified, moved and deleted files between snapshots (path,
    source_kind, size, mtime, content_hash; the old one with document_id). A vanished and a new path of the same kind and
    content are a move, paired in the order of paths; anything else that differs at a path is a modification."""
    o = old.select("document_id", F.col("path").alias("old_path"), *(F.col(c).alias(f"old_{c}") for c in ("source_kind", "size", "mtime", "content_hash")))
    both = o.join(new, o["old_path"] == new["path"], "full_outer")
    kept = both.where("old_path is not null and path is not null").where("size <> old_size or mtime <> old_mtime or content_hash <> old_content_hash")
    number = lambda kind, digest, path: F.row_number().over(Window.partitionBy(kind, digest).orderBy(path))
    gone = both.where("path is null").select("document_id", "old_path", F.col("old_source_kind").alias("kind_"), F.col("old_content_hash").alias("hash_"), number("old_source_kind", "old_content_hash", "old_path").alias("n"))
    come = both.where("old_path is null").select("path", F.col("source_kind").alias("kind_"), F.col("content_hash").alias("hash_"), number("source_kind", "content_hash", "path").alias("n"))
    paired = gone.join(come, ["kind_", "hash_", "n"], "full_outer")
    kind = F.when(F.col("old_path").isNull(), "added").when(F.col("path").isNull(), "deleted").otherwise("moved")
    moves = paired.select(kind.alias("kind"), "document_id", F.coalesce("path", "old_path").alias("path"), F.when(F.col("path").isNotNull(), F.col("old_path")).alias("previous_path"))
    return moves.unionByName(kept.select(F.lit("modified").alias("kind"), "document_id", "path", F.lit(None).cast("string").alias("previous_path")))


def unique_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """The stricter pairing: only contents that vanished once and came once are moves (old_path, path)."""
    gone = old.join(new, "path", "left_anti").select(F.col("path").alias("old_path"), "size", "content_hash", F.count(F.lit(1)).over(Window.partitionBy("size", "content_hash")).alias("n")).where("n = 1").drop("n")
    come = new.join(old, "path", "left_anti").select("path", "size", "content_hash", F.count(F.lit(1)).over(Window.partitionBy("size", "content_hash")).alias("n")).where("n = 1").drop("n")
    return gone.join(come, ["size", "content_hash"]).select("old_path", "path")


def affected_tasks(events: DataFrame, items: DataFrame) -> DataFrame:
    """Tasks that a change concerns, by document or by (old or new) path: (path, kind, tasks)."""
    i = items.select("task_id", "document_id", F.lower("path").alias("p"))
    keyed = events.select("kind", "path", "document_id", F.explode(F.array_distinct(F.array(F.lower("path"), F.lower(F.coalesce("previous_path", "path"))))).alias("p"))
    by_id = events.where("document_id is not null").join(i.select("task_id", "document_id"), "document_id").select("kind", "path", "task_id")
    by_path = keyed.join(i.select("task_id", "p"), "p").select("kind", "path", "task_id")
    return by_id.unionByName(by_path).distinct().groupBy("kind", "path").agg(F.array_join(F.array_sort(F.collect_list("task_id")), ",").alias("tasks"))


def kept_last_good(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Failed documents keep the last good content, marked stale: both (path, state, content_hash, body_chars)."""
    p = previous.select("path", F.col("state").alias("p_state"), F.col("content_hash").alias("p_hash"), F.col("body_chars").alias("p_chars"))
    keep = (F.col("state") == "failed") & F.col("p_state").isin("indexed", "stale")
    pick = lambda new, old: F.when(keep, F.col(old)).otherwise(F.col(new))
    return current.join(p, "path", "left").select("path", F.when(keep, "stale").otherwise(F.col("state")).alias("state"), pick("content_hash", "p_hash").alias("content_hash"), pick("body_chars", "p_chars").alias("body_chars"))


def to_extract(files: DataFrame, known: DataFrame, force: bool = False) -> DataFrame:
    """Files whose size, time, content or parser changed, or that failed before: what has to be read again."""
    if force:
        return files
    good = known.where("state <> 'failed'").select("path", "size", "mtime", "content_hash", "parser")
    return files.join(good, ["path", "size", "mtime", "content_hash", "parser"], "left_anti")


def stability(scans: DataFrame, times: int = 2, quiet: int = 120, deadline: int = 86_400) -> DataFrame:
    """The state of files after the last of several scans(path, generation, at, mtime, content_hash, locked), at and mtime in
    seconds: queued once unchanged for `times` scans and quiet for `quiet` seconds, else pending_stable; while locked
    pending_edit, and stale `deadline` seconds after the lock was first seen."""
    w = Window.partitionBy("path").orderBy("generation")
    changed = F.coalesce(F.lag("content_hash").over(w) != F.col("content_hash"), F.lit(True))
    run = F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = scans.withColumn("run", run)
    last = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("generation")))
    same = Window.partitionBy("path", "run")
    full = marked.withColumn("unchanged", F.count(F.lit(1)).over(same) - 1).withColumn("locked_since", F.min(F.when(F.col("locked"), F.col("at"))).over(Window.partitionBy("path"))).withColumn("last", last).where("last = 1")
    state = F.when(F.col("locked"), F.when(F.col("at") - F.col("locked_since") >= deadline, "stale").otherwise("pending_edit")).when((F.col("unchanged") >= times) & (F.col("at") - F.col("mtime") >= quiet), "queued").otherwise("pending_stable")
    return full.select("path", "unchanged", state.alias("state"))


def office_locked(files: DataFrame) -> DataFrame:
    """Files beside which a lock file (~$name) lies: files(path)."""
    named = files.select("path", tx.parent(F.col("path")).alias("dir"), tx.file_name(F.col("path")).alias("name"))
    locks = named.where(F.startswith("name", F.lit("~$"))).select("dir", F.expr("substring(name, 3)").alias("name"))
    return named.join(locks, ["dir", "name"], "left_semi").select("path")


# Folders


def folder_paths(docs: DataFrame) -> DataFrame:
    return docs.select(F.explode(tx.ancestors(F.col("path"))).alias("folder")).distinct().select("folder", F.when(F.col("folder") == ".", 0).otherwise(tx.depth(F.col("folder"))).alias("depth"))


def folder_rollup(docs: DataFrame) -> DataFrame:
    """Direct children of each folder that has files: counts, bytes, flags, troubles."""
    flags = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("quality_flags")))), ",")
    return docs.groupBy(F.col("parent").alias("folder")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.startswith("status", F.lit("pending"))).alias("pending"), flags.alias("flags"),
    )


def availability_line() -> Column:
    return F.concat_ws("|", "path", "content_hash", F.when(F.col("status") == "current", "available").otherwise("other"))


def folder_digest(docs: DataFrame) -> DataFrame:
    """Digest of a folder's direct files: over (path, content, availability)."""
    return dg.digests(dg.sums(docs.select(F.col("parent").alias("folder"), availability_line().alias("line")), "folder")).select("folder", "digest")


def fingerprint_lines(docs: DataFrame) -> DataFrame:
    """(folder, line) of every file and each folder above it: id, content and path."""
    return docs.select(F.explode(tx.ancestors(F.col("path"))).alias("folder"), F.concat_ws("|", "document_id", "content_hash", "path").alias("line"))


def folder_fingerprint(docs: DataFrame) -> DataFrame:
    """Digest over id, content and path of all files below a folder, at any depth."""
    return dg.digests(dg.sums(fingerprint_lines(docs), "folder")).select("folder", F.col("n").alias("files"), F.col("digest").alias("fingerprint"))


def tree_digest(docs: DataFrame) -> DataFrame:
    """Merkle digests, bottom-up: a folder's is over its children's paths and digests; one round a level."""
    leaves = docs.select("path", F.col("content_hash").alias("digest"))
    nodes = leaves.withColumn("depth", tx.depth(F.col("path")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    out = None
    for level in range(deepest, 0, -1):
        here = nodes.where(F.col("depth") == level)
        lines = here.select(tx.parent(F.col("path")).alias("folder"), F.concat_ws("|", "path", "digest").alias("line"))
        made = dg.digests(dg.sums(lines, "folder")).select("folder", "digest")
        nodes = nodes.where(F.col("depth") < level).unionByName(made.select(F.col("folder").alias("path"), "digest", F.lit(level - 1).alias("depth")))
        out = made if out is None else out.unionByName(made)
    return out


def tree_lines(docs: DataFrame, prefix: str = "") -> DataFrame:
    """A drawn directory tree: (path, line) of folders and files."""
    every = folder_paths(docs).select(F.col("folder").alias("path")).where("path <> '.'").union(docs.select("path"))
    return every.select("path", F.concat(F.repeat(F.lit("  "), tx.depth(F.col("path")) - 1), F.lit("- "), tx.file_name(F.col("path"))).alias("line"))


# Tasks


def matched_items(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Each item's document: by id, else by path if that's unique, else by content if that's unique; with how it was found."""
    d = docs.select(F.col("document_id").alias("d_id"), F.col("path").alias("d_path"), F.col("content_hash").alias("d_hash"))
    alone = lambda key: d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(key))).where("n = 1").drop("n")
    one = items.join(d.select(F.col("d_id").alias("a_id"), F.col("d_hash").alias("a_hash")), items["document_id"] == F.col("a_id"), "left")
    two = one.join(alone("d_path").select(F.col("d_id").alias("b_id"), F.col("d_path").alias("b_path"), F.col("d_hash").alias("b_hash")), F.col("path") == F.col("b_path"), "left")
    three = two.join(alone("d_hash").select(F.col("d_id").alias("c_id"), F.col("d_hash").alias("c_hash")), F.col("content_hash") == F.col("c_hash"), "left")
    how = F.when(F.col("a_id").isNotNull(), "id").when(F.col("b_id").isNotNull(), "path").when(F.col("c_id").isNotNull(), "hash").otherwise("none")
    return three.select(*items.columns, F.coalesce("a_id", "b_id", "c_id").alias("found_id"), F.coalesce("a_hash", "b_hash", "c_hash").alias("found_hash"), how.alias("found_by"))


def matched_in_scope(items: DataFrame, docs: DataFrame) -> DataFrame:
    """As matched_items, for items and documents that also have source_kind, container and member: only the same kind matches,
    a member's place is that in its container, and its content counts there alone and only at its own place."""
    inside = F.col("source_kind") == "archive_member"
    place = F.when(inside, F.concat_ws("\x1f", F.lower("container"), "member")).otherwise(F.lower("path"))
    named = lambda d, p: d.select(F.col("document_id").alias(f"{p}_id"), F.col("content_hash").alias(f"{p}_hash"), F.col("source_kind").alias(f"{p}_kind"), place.alias(f"{p}_place"), F.when(inside, F.lower("container")).otherwise("").alias(f"{p}_scope"))
    alone = lambda d, *keys: d.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")
    mine = items.withColumns({"_kind": F.col("source_kind"), "_place": place, "_scope": F.when(inside, F.lower("container")).otherwise("")})
    a, b, c = (named(docs, p) for p in "abc")
    met = mine.join(a, (F.col("document_id") == F.col("a_id")) & (F.col("_kind") == F.col("a_kind")), "left")
    met = met.join(alone(b, "b_kind", "b_place"), (F.col("_kind") == F.col("b_kind")) & (F.col("_place") == F.col("b_place")), "left")
    there = (F.col("_kind") != "archive_member") | (F.col("_place") == F.col("c_place"))
    met = met.join(alone(c, "c_kind", "c_scope", "c_hash"), (F.col("_kind") == F.col("c_kind")) & (F.col("_scope") == F.col("c_scope")) & (F.col("content_hash") == F.col("c_hash")) & there, "left")
    how = F.when(F.col("a_id").isNotNull(), "id").when(F.col("b_id").isNotNull(), "path").when(F.col("c_id").isNotNull(), "hash").otherwise("none")
    return met.select(*items.columns, F.coalesce("a_id", "b_id", "c_id").alias("found_id"), F.coalesce("a_hash", "b_hash", "c_hash").alias("found_hash"), how.alias("found_by"))


def reconfirmed(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Items with their freshness now: current, changed, missing or unverified; changed and missing ones go back to review."""
    m = matched_items(items, docs)
    fresh = F.when(F.col("found_id").isNull(), "missing").when(F.col("content_hash").isNull(), "unverified").when(F.col("found_hash") == F.col("content_hash"), "current").otherwise("changed")
    m = m.withColumn("freshness", fresh)
    lost = F.col("freshness").isin("missing", "changed")
    return m.select("task_id", "item_id", "found_id", "found_by", "freshness", F.when(lost, "pending").otherwise(F.col("review_state")).alias("review_state"), F.when(lost, "source_unconfirmed").otherwise("resolved").alias("source_status"))


def task_summary(items: DataFrame) -> DataFrame:
    return items.groupBy("task_id").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("review_state") == "pending").alias("pending"), F.count_if(F.col("source_status") != "resolved").alias("unresolved"), F.count_if(F.col("freshness") != "current").alias("stale"))


def task_faults(items: DataFrame, slots: DataFrame) -> DataFrame:
    """(task_id, code, key): item ids that occur twice, evidence that occurs twice, slots that don't exist."""
    twice = items.groupBy("task_id", "item_id").count().where("count > 1").select("task_id", F.lit("duplicate_item").alias("code"), F.col("item_id").alias("key"))
    same = items.groupBy("task_id", "document_id", "slot_id").count().where("count > 1").select("task_id", F.lit("duplicate_evidence").alias("code"), F.concat_ws("|", "document_id", "slot_id").alias("key"))
    none = items.join(slots, ["task_id", "slot_id"], "left_anti").select("task_id", F.lit("unknown_slot").alias("code"), F.col("item_id").alias("key"))
    return twice.unionByName(same).unionByName(none)


def proposals(candidates: DataFrame, slots: DataFrame, fallback: int = 5) -> DataFrame:
    """Candidates(candidate_id, rank, slot_id) put into slots: each once, in its best slot; slots without any get none, and
    without any match at all the first candidates go to the first slot."""
    once = candidates.join(slots, "slot_id", "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("candidate_id").orderBy("rank", "slot_id"))).where("n = 1").select("slot_id", "candidate_id", "rank")
    first = slots.agg(F.min("slot_id").alias("slot_id"))
    spare = candidates.select("candidate_id", "rank").distinct().orderBy("rank", "candidate_id").limit(fallback).crossJoin(first).select("slot_id", "candidate_id", "rank")
    any_ = once.agg(F.count(F.lit(1)).alias("n"))
    return once.unionByName(spare.crossJoin(any_).where("n = 0").drop("n"))


# Evaluation


def retrieval_metrics(ranks: DataFrame) -> DataFrame:
    """ranks(query_id, rank): rank of the judged document, null if it wasn't found."""
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("double")), 6)
    return ranks.agg(F.count(F.lit(1)).alias("n"), hit(1).alias("hit_at_1"), hit(5).alias("hit_at_5"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def filename_order(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """The baseline: documents by how many of a query's terms their name has, 100 more if it holds the query; then by path."""
    met = docs.select("document_id", "path", F.lower("name").alias("n"), tx.search_terms(F.col("name")).alias("t")).crossJoin(asked(queries.select("query_id", F.lower("query").alias("q"), tx.search_terms(F.col("query")).alias("qt"))))
    score = F.size(F.array_intersect("t", "qt")) + F.when(F.contains("n", F.col("q")), 100).otherwise(0)
    return met.select("query_id", "document_id", score.alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "path")).alias("rank"))


#: Terms of a query, or of a name that shares one with a query, at most, whose sets filename_best() goes through.
TERMS = 6


def filename_best(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The first k of filename_order of each query, without comparing it with all names. Of the names that share a set of terms with a
    query the k first by path are enough, for every set of its terms, the empty one too: what is shared beyond it only leads to a
    larger set's names. Sets are ranked once for all queries that have them. Names that hold a query are looked up by grams. Queries
    of many terms are compared with all names."""
    names = durable(docs.select("document_id", "path", F.lower("name").alias("n"), F.array_sort(tx.search_terms(F.col("name"))).alias("t")))
    q = durable(queries.select("query_id", "query", F.lower("query").alias("q"), F.array_sort(tx.search_terms(F.col("query"))).alias("qt")))
    few_terms = q.where(F.size("qt") <= TERMS)
    masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("s")) - 1)
    bit = lambda m, i: F.pmod(F.call_function("shiftright", m, i), F.lit(2)) == 1
    sets = F.transform(masks, lambda m: F.to_json(F.filter("s", lambda x, i: bit(m, i))))
    own = durable(few_terms.withColumn("s", F.col("qt")).select("query_id", F.explode(sets).alias("of")))
    small = F.broadcast if few(q) else lambda d: d
    terms = few_terms.select(F.explode("qt").alias("term")).distinct()
    # of a name only the terms that queries have; more than TERMS of them are met term by term, which no query has all of
    asked_terms = names.select("document_id", F.explode_outer("t").alias("term")).join(small(terms.withColumn("asked", F.lit(True))), "term", "left")
    shared = asked_terms.groupBy("document_id").agg(F.array_sort(F.collect_list(F.when(F.col("asked"), F.col("term")))).alias("s"))
    wanted = own.select("of").distinct()
    held = names.select("document_id", "path").join(shared, "document_id")
    sets_of = F.when(F.size("s") <= TERMS, sets).otherwise(F.array(F.lit("[]")))  # of the empty set all names are
    narrow = held.select("document_id", "path", F.explode(sets_of).alias("of"))
    narrow = sifted(narrow, "of", sieve(wanted, "of")).where("_maybe").join(wanted, "of", "left_semi").select("document_id", "path", "of")
    best = ranked(narrow, [F.asc("path"), F.asc("document_id")], k, by="of", name="at").select("of", "document_id")
    listed = own.join(best, "of").select("query_id", "document_id")
    wide = held.where(F.size("s") > TERMS).select("document_id", F.explode("s").alias("term")).join(few_terms.select("query_id", F.explode("qt").alias("term")), "term").select("query_id", "document_id")
    holds = gr.contained(names.select("document_id", F.col("n").alias("name")), "name", few_terms.select("query_id", "q"), small).select("query_id", "document_id")
    met = listed.union(wide).union(holds).distinct().join(names, "document_id").join(small(few_terms.select("query_id", "q", "qt")), "query_id")
    score = F.size(F.array_intersect("t", "qt")) + F.when(F.contains("n", F.col("q")), 100).otherwise(0)
    out = ranked(met.withColumn("score", score), [F.desc("score"), F.asc("path")], k).select("query_id", "document_id", "score", "rank")
    if (many := q.where(F.size("qt") > TERMS).select("query_id", "query")).isEmpty():
        return out
    return out.unionByName(filename_order(docs, many).where(F.col("rank") <= k))


def filename_ranks(docs: DataFrame, queries: DataFrame, judged: DataFrame) -> DataFrame:
    """(query_id, document_id, rank) of judged(query_id, document_id): the places that filename_order gives them, without ordering
    all documents for each query. Only documents whose names share a term with a query, or hold it, are listed for it; the others
    follow by path, of which each document's place is known."""
    names = durable(accumulated(docs.select("document_id", "path", F.lower("name").alias("name"), tx.search_terms(F.col("name")).alias("t")), ["path"], "place"))
    q = durable(queries.select("query_id", F.lower("query").alias("q"), tx.search_terms(F.col("query")).alias("t")))
    small = F.broadcast if few(q) else lambda d: d
    by_term = names.select("document_id", F.explode("t").alias("term")).join(small(q.select("query_id", F.explode("t").alias("term"))), "term")
    by_name = gr.contained(names.select("document_id", "name"), "name", q.select("query_id", "q"), small)
    hits = by_term.select("query_id", "document_id", F.lit(1).alias("score")).union(by_name.select("query_id", "document_id", F.lit(100)))
    hits = durable(hits.groupBy("query_id", "document_id").agg(F.sum("score").alias("score")).join(names.select("document_id", "place"), "document_id"))
    own = judged.select("query_id", "document_id").distinct().join(names.select("document_id", "place"), "document_id")
    own = own.join(hits.select("query_id", "document_id", "score"), ["query_id", "document_id"], "left").withColumn("score", F.coalesce("score", F.lit(0)))
    other = hits.select("query_id", F.col("place").alias("p"), F.col("score").alias("s"))
    ahead = (F.col("s") > F.col("score")) | ((F.col("s") == F.col("score")) & (F.col("p") < F.col("place")))
    met = own.join(other, "query_id", "left").groupBy("query_id", "document_id", "place", "score")
    met = met.agg(F.count("p").alias("n"), F.count_if(ahead).alias("ahead"), F.count_if(F.col("p") < F.col("place")).alias("before"))
    return met.select("query_id", "document_id", F.when(F.col("score") > 0, F.col("ahead") + 1).otherwise(F.col("n") + F.col("place") - F.col("before")).alias("rank"))


# The least share of tasks with a right document among the first five, the least mean reciprocal rank, and by how much
# of the names' steps a search must save.
TOP5, MRR, REDUCTION = 0.80, 0.65, 0.30


def evaluated(tasks: DataFrame) -> DataFrame:
    """(task_id, search_rank, baseline_rank, top5_hit, reciprocal_rank, steps_saved, failure) of tasks(task_id, search_rank,
    baseline_rank, explained, n_documents): the best places of a right document, null if the search didn't find one, which counts
    as one place after all documents. Explained says that the found one came with its place, target, match and evidence."""
    rank = F.col("search_rank")
    hit, steps = F.coalesce(rank <= 5, F.lit(False)), F.coalesce(rank, F.col("n_documents") + 1)
    failure = F.when(~hit, "relevant_document_not_in_top5").when(~F.coalesce("explained", F.lit(False)), "explanation_contract_failed")
    return tasks.select(
        "task_id", "search_rank", "baseline_rank", "explained", hit.alias("top5_hit"), F.coalesce(1 / rank, F.lit(0.0)).alias("reciprocal_rank"),
        steps.alias("search_steps"), (F.col("baseline_rank") - steps).alias("steps_saved"), failure.alias("failure"),
    )


def search_gate(tasks: DataFrame, top5: float = TOP5, mrr: float = MRR, reduction: float = REDUCTION) -> DataFrame:
    """One row over evaluated(): the figures, how many tasks failed, and whether all thresholds are met."""
    unexplained = ~F.coalesce("explained", F.lit(False))
    sums = tasks.agg(
        F.count(F.lit(1)).alias("tasks"), F.avg(F.col("top5_hit").cast("double")).alias("top5"), F.avg("reciprocal_rank").alias("mrr"), F.count_if(~F.col("top5_hit")).alias("failures"),
        (1 - F.sum("search_steps") / F.greatest(F.lit(1), F.sum("baseline_rank"))).alias("reduction"), F.count_if(unexplained).alias("unexplained"),
    )
    meets = (F.col("top5") >= top5) & (F.col("mrr") >= mrr) & (F.col("reduction") >= reduction) & (F.col("unexplained") == 0)
    return sums.select("tasks", F.round("top5", 6).alias("top5"), F.round("mrr", 6).alias("mrr"), "failures", F.round("reduction", 6).alias("reduction"), "unexplained", F.coalesce(meets, F.lit(False)).alias("meets"))


def step_reduction(steps: DataFrame) -> DataFrame:
    """steps(search_steps, baseline_steps): one less their quotient of sums."""
    return steps.agg(F.sum("search_steps").alias("search_steps"), F.sum("baseline_steps").alias("baseline_steps"), F.round(1 - F.sum("search_steps") / F.sum("baseline_steps"), 6).alias("reduction"))


def nearest_rank(n: Column, p: float) -> Column:
    """The place, from 1, of n sorted values that is nearest to p: round((n - 1) p) + 1, ties to even."""
    return F.bround((n - 1) * F.lit(p)) + 1


def ceiling_rank(n: Column, p: float) -> Column:
    """The place ceil(p n), 1 at least."""
    return F.greatest(F.lit(1), F.ceil(n * F.lit(p)))


def values_at(rows: DataFrame, by: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(by, names of places): of each group the values at places among its sorted non-null values, as functions of their number.
    Equal values are counted before any shuffle; running counts find the places, so no group is held in memory."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = counted.groupBy(by).agg(F.sum("_c").alias("_n"))
    met = counted.withColumn("_upto", upto).join(total, by)
    return met.groupBy(by).agg(*(F.min(F.when(F.col("_upto") >= place(F.col("_n")), F.col(value))).alias(name) for name, place in places.items()))


def study_summary(rows: DataFrame) -> DataFrame:
    """rows(condition, duration_ms, success): attempts, successes, rate, median and 95th of the durations of successes."""
    counts = rows.groupBy("condition").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("success").alias("successes"), F.round(F.avg(F.col("success").cast("double")), 6).alias("rate"))
    places = {"low": lambda n: F.floor((n + 1) / 2), "high": lambda n: F.floor(n / 2) + 1, "p95": lambda n: nearest_rank(n, 0.95)}
    at = values_at(rows.where("success"), "condition", "duration_ms", places)
    p50 = F.round((F.col("low") + F.col("high")) / 2, 6).alias("p50")
    return counts.join(at, "condition", "left").select("condition", "attempts", "successes", "rate", p50, F.round("p95", 6).alias("p95"))


#: Rows that a task of study_assignment() sorts, about.
ASSIGNED = 500_000


def study_assignment(participants: DataFrame, tasks: DataFrame) -> DataFrame:
    """All tasks of each participant in a hashed order, conditions alternating from a hashed start. Every participant has every
    task, so there are as many rows; each participant's are sorted by themselves. The participants are dealt out before they meet
    the tasks, so that, where the tasks are few enough to send them to all executors, only participants are shuffled."""
    tasks = tasks.select("task_id")
    parts = max(participants.sparkSession.sparkContext.defaultParallelism, -(-participants.count() * tasks.count() // ASSIGNED))
    dealt = participants.select("participant_id").repartition(min(parts, 20_000), "participant_id")
    met = dealt.crossJoin(F.broadcast(tasks) if few(tasks.select(F.col("task_id").alias("query_id"))) else tasks)
    order = F.unhex(F.sha2(F.concat_ws(":", F.col("participant_id").cast("string"), F.col("task_id").cast("string")), 256))
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("participant_id").orderBy(order, "task_id")))
    start = F.conv(F.substring(F.sha2(F.col("participant_id").cast("string"), 256), 1, 2), 16, 10).cast("int")
    return placed.select("participant_id", "task_id", "place", F.when(F.pmod(F.col("place") + start, F.lit(2)) == 0, "search").otherwise("baseline").alias("condition"))


def perf_gate(baseline: DataFrame, candidate: DataFrame, limits: DataFrame, most: float = 0.10) -> DataFrame:
    """(metric, regression, passed): candidate against baseline values (metric, value), within absolute limits (metric,
    most_value, approved) and, unless approved, within the relative one. A zero baseline is infinitely regressed from."""
    met = candidate.select("metric", F.col("value").alias("now")).join(baseline.select("metric", F.col("value").alias("was")), "metric").join(limits, "metric", "left")
    worse = F.when(F.col("was") == 0, F.when(F.col("now") == 0, 0.0).otherwise(F.lit(float("inf")))).otherwise((F.col("now") - F.col("was")) / F.col("was"))
    met = met.withColumn("regression", F.round(worse, 6))
    ok = (F.coalesce(F.col("now") <= F.col("most_value"), F.lit(True))) & ((F.col("regression") <= most) | F.coalesce("approved", F.lit(False)))
    return met.select("metric", "regression", ok.alias("passed"))


# Evidence and citations


def first_evidence(rows: DataFrame, key: str, *alike: str, order: str, k: int = 3) -> DataFrame:
    """Of rows alike in the given columns the first; of these the first k of each key."""
    once = rows.withColumn("n", F.row_number().over(Window.partitionBy(key, *alike).orderBy(order))).where("n = 1").drop("n")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("place") <= k)


def distinct_citations(cites: DataFrame) -> DataFrame:
    """First of each identity: the id, else the DOI in lower case, else the whole record; cites(position, citation_id, doi, title, year)."""
    key = F.coalesce(F.concat(F.lit("id:"), "citation_id"), F.concat(F.lit("doi:"), F.lower("doi")), F.concat(F.lit("rec:"), F.coalesce("title", F.lit("")), F.lit("|"), F.coalesce(F.col("year").cast("string"), F.lit(""))))
    return cites.withColumn("key", key).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("position"))).where("n = 1").drop("n")


def apa(c: DataFrame) -> Column:
    """Author, A. B., & Author, C. (year). Title. Publication, volume(issue), pages."""
    def one(a: Column) -> Column:
        parts = F.split(F.trim(a), r"\s+")
        initials = F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lit("."))), " ")
        return F.when(F.size(parts) > 1, F.concat(F.element_at(parts, -1), F.lit(", "), initials)).otherwise(F.trim(a))

    names = F.transform("authors", one)
    n = F.size("authors")
    joined = F.when(n == 0, "").when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(", & "), F.element_at(names, -1)))
    issue = F.when(F.col("issue").isNotNull(), F.concat(F.lit("("), "issue", F.lit(")"))).otherwise("")
    where = F.concat_ws(", ", "publication", F.concat(F.col("volume"), issue), "pages")
    return F.concat(joined, F.when(n == 0, "").otherwise(" "), F.lit("("), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit("). "), "title", F.lit(". "), F.when(where != "", F.concat(where, F.lit("."))).otherwise(""))


def gb_t_7714(c: DataFrame) -> Column:
    """Authors (three, then et al). Title[type]. Publication, year, volume(issue): pages."""
    n = F.size("authors")
    names = F.concat(F.array_join(F.slice(F.col("authors"), F.lit(1), F.least(n, F.lit(3))), ", "), F.when(n > 3, ", et al").otherwise(""))
    issue = F.when(F.col("issue").isNotNull(), F.concat(F.lit("("), "issue", F.lit(")"))).otherwise("")
    where = F.concat_ws(", ", "publication", F.col("year").cast("string"), F.concat(F.col("volume"), issue))
    return F.concat(names, F.when(n > 0, ". ").otherwise(""), F.col("title"), F.lit("["), F.coalesce("type_mark", F.lit("Z")), F.lit("]. "), where, F.when(F.col("pages").isNotNull(), F.concat(F.lit(": "), "pages")).otherwise(""), F.lit("."))


def bibliography(cites: DataFrame, style: str = "apa") -> DataFrame:
    """(number, entry) of distinct citations in order."""
    once = distinct_citations(cites)
    entry = {"apa": apa, "gb": gb_t_7714}[style](once)
    return accumulated(once.select("position", entry.alias("entry")), ["position"], "number").select(F.col("number").cast("int").alias("number"), "entry")


def bibtex(cites: DataFrame) -> DataFrame:
    """(position, key, entry); keys that collide get 2, 3, ... in order."""
    base = F.concat(F.lower(F.regexp_replace(F.coalesce(F.element_at(F.split(F.get("authors", F.lit(0)), r"\s+"), -1), F.lit("anon")), r"[^A-Za-z0-9]", "")), F.coalesce(F.col("year").cast("string"), F.lit("nd")))
    numbered = cites.withColumn("base", base).withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("position")))
    key = F.concat("base", F.when(F.col("n") > 1, F.col("n").cast("string")).otherwise(""))
    field = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    body = F.concat_ws(",\n", field("title", F.col("title")), field("author", F.array_join("authors", " and ")), field("year", F.col("year").cast("string")), field("journal", F.col("publication")), field("doi", F.col("doi")))
    return numbered.select("position", key.alias("key"), F.concat(F.lit("@misc{"), key, F.lit(",\n"), body, F.lit("\n}")).alias("entry"))


# Checks


def integrity(docs: DataFrame, children: DataFrame, cached: DataFrame) -> DataFrame:
    """(code, severity, n): counts of faults of a repository; children(folder, path), cached(document_id, content_hash)."""
    ids = docs.groupBy("document_id").count().where("count > 1")
    met = cached.join(docs.select("document_id", F.col("content_hash").alias("now")), "document_id")
    faults = [
        ("missing_child", "error", children.join(docs, "path", "left_anti")),
        ("orphan", "warning", docs.join(children, "path", "left_anti")),
        ("duplicate_id", "error", ids),
        ("cache_missing", "warning", docs.join(cached, "document_id", "left_anti")),
        ("cache_orphan", "warning", cached.join(docs, "document_id", "left_anti")),
        ("cache_outdated", "error", met.where("content_hash <> now")),
        ("cache_invalid", "error", cached.where("content_hash is null or document_id is null")),
        ("failed", "warning", docs.where("status = 'failed'")),
    ]
    out = None
    for code, severity, rows in faults:
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def cyclic(edges: DataFrame) -> DataFrame:
    """The edges(node, needed) between nodes of which each is needed by, and needs, another one of them: cycles, and what leads
    from one to another. Each round drops what no longer has a predecessor or a successor, and is checkpointed."""
    from folioscope.sources.corpus import durable

    left, before = durable(edges.select("node", "needed").distinct()), -1
    while (n := left.count()) not in (0, before):
        before = n
        left = left.join(left.select(F.col("node").alias("needed")).distinct(), "needed", "left_semi")
        left = durable(left.join(left.select(F.col("needed").alias("node")).distinct(), "node", "left_semi").select("node", "needed"))
    return left


def node_faults(nodes: DataFrame, indexes: DataFrame, raw: DataFrame, roots: DataFrame, shortcuts: DataFrame | None = None) -> DataFrame:
    """(code, severity, key) of a tree of nodes(node_id, path, node_type, depends_on), its written indexes(path, node_id,
    header_ok), the raw files(path, generated), the registered roots(root) and the shortcuts(path, text)."""
    leaf = nodes.where("node_type in ('leaf', 'foldernode')")
    met = leaf.join(indexes.select("path", F.col("node_id").alias("written_id"), "header_ok"), "path")
    needs = nodes.select("path", F.explode("depends_on").alias("needed"))
    a, b = roots.select(F.col("root").alias("a")), roots.select(F.col("root").alias("b"))
    faults = [
        ("index_missing", "error", leaf.join(indexes, "path", "left_anti").select("path")),
        ("index_invalid", "error", met.where("not header_ok").select("path")),
        ("id_mismatch", "error", met.where("header_ok and written_id <> node_id").select("path")),
        ("index_untracked", "warning", indexes.join(leaf, "path", "left_anti").select("path")),
        ("dependency_unknown", "error", needs.join(nodes.select(F.col("node_id").alias("needed")), "needed", "left_anti").select("path").distinct()),
        ("dependency_cycle", "error", nodes.join(cyclic(nodes.select(F.col("node_id").alias("node"), F.explode("depends_on").alias("needed")).where("needed is not null")).select(F.col("node").alias("node_id")).distinct(), "node_id", "left_semi").select("path")),
        ("raw_missing", "warning", nodes.where("node_type <> 'foldernode'").join(raw, "path", "left_anti").select("path")),
        ("generated_in_raw", "error", raw.where("generated").select("path")),
        ("roots_overlap", "error", a.join(b, F.startswith("b", F.concat(F.col("a"), F.lit("/")))).select(F.col("b").alias("path")).distinct()),
    ]
    if shortcuts is not None:
        faults.append(("invalid_shortcut", "warning", shortcuts.where(~F.startswith(F.coalesce("text", F.lit("")), F.lit("[InternetShortcut]\nURL=file:"))).select("path")))
    out = None
    for code, severity, rows in faults:
        one = rows.select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.col("path").alias("key"))
        out = one if out is None else out.unionByName(one)
    return out
