"""Cards, evidence caps, activation and plans, migration and members' moves, parsing of stored JSON, dates and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as tx
from folioscope.operators.numbering import accumulated

# Pages and passages


def page_text(pages: DataFrame, number: int, limit: int = 20_000) -> DataFrame:
    """(document_id, text): a page's texts joined by blank lines and cut; page 1 includes those without a number."""
    test = F.col("page_number") == number
    rows = pages.where(test | F.col("page_number").isNull() if number == 1 else test).withColumn("t", F.trim("text"))
    return rows.groupBy("document_id").agg(F.left(F.expr("listagg(t, '\n\n') within group (order by page_id)"), F.lit(limit)).alias("text"))


def first_passages(passages: DataFrame, k: int = 18, chars: int = 2_500) -> DataFrame:
    """The first k passages of each document, each cut: what a model is given to read."""
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("ordinal"))
    return passages.withColumn("place", place).where(F.col("place") <= k).withColumn("body", F.left("body", F.lit(chars)))


def cited_results(results: DataFrame, evidence: DataFrame, k: int = 5, each: int = 3) -> DataFrame:
    """(query_id, label, document_id, place, excerpt): the first k results that have evidence, labelled S1, S2, ..., with their
    first pieces: results(query_id, rank, document_id), evidence(query_id, document_id, position, excerpt)."""
    have = results.join(evidence, ["query_id", "document_id"], "left_semi")
    top = have.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("n") <= k)
    met = evidence.join(top.select("query_id", "document_id", "n"), ["query_id", "document_id"])
    met = met.withColumn("place", F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("position"))).where(F.col("place") <= each)
    return met.select("query_id", F.concat(F.lit("S"), "n").alias("label"), "document_id", "place", "excerpt")


def candidates(cited: DataFrame, page: Column | None = None) -> DataFrame:
    """Candidates for a task's slots with stable ids, from cited results."""
    page = F.lit(None).cast("int") if page is None else page
    return cited.select("query_id", "document_id", tx.candidate_id(F.col("document_id").cast("string"), page, F.col("place").cast("string"), F.col("excerpt")).alias("candidate_id"), "excerpt")


def tampered(proposed: DataFrame, canonical: DataFrame, *fields: str) -> DataFrame:
    """Proposed candidates that the server's own don't equal in every field (null equals null)."""
    mine = canonical.select(F.col("candidate_id").alias("_id"), *(F.col(f).alias(f"_{f}") for f in fields))
    met = proposed.join(mine, F.col("candidate_id") == F.col("_id"), "left")
    same = F.col("_id").isNotNull()
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return met.where(~same).select("candidate_id")


# Cards


def children_with_cards(docs: DataFrame, cards: DataFrame, folder: str) -> DataFrame:
    """Direct files of a folder with their cards, if any (by a true prefix, no pattern)."""
    return docs.where(F.col("parent") == folder).join(cards.select("document_id", "summary", F.col("content_hash").alias("card_hash")), "document_id", "left").select("document_id", "path", "summary", F.col("card_hash").eqNullSafe(F.col("content_hash")).alias("fresh"))


def card_status(docs: DataFrame, cards: DataFrame) -> DataFrame:
    """How many documents have a card of their content, a failed one, or none; calls that are left to make."""
    met = docs.join(cards.select("document_id", F.col("content_hash").alias("card_hash"), "state"), "document_id", "left")
    same = F.coalesce(F.col("card_hash") == F.col("content_hash"), F.lit(False))
    counts = met.agg(F.count_if(same & (F.col("state") == "done")).alias("indexed"), F.count_if(same & (F.col("state") == "failed")).alias("failed"), F.count(F.lit(1)).alias("total"))
    return counts.select("indexed", "failed", (F.col("total") - F.col("indexed") - F.col("failed")).alias("pending"), (F.col("total") - F.col("indexed")).alias("estimated_calls"))


def cache_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("node_type") == "text").alias("text"), F.count_if(F.col("node_type") != "text").alias("non_text"))


def update_plan(docs: DataFrame, events: DataFrame) -> DataFrame:
    """What an update would do, without doing it: files to read, folders to roll up, files to drop; events(kind, path)."""
    todo = events.where("kind in ('added', 'modified', 'moved')")
    folders = events.select(F.explode(tx.ancestors(F.col("path"))).alias("folder")).distinct()
    one = lambda rows, action: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(action).alias("action"), "n")
    return one(todo, "read").unionByName(one(folders, "roll_up")).unionByName(one(events.where("kind = 'deleted'"), "drop"))


#: Extensions whose files are read as text, without a model.
PLAIN = (".txt", ".md", ".markdown", ".rst", ".log")


def update_lists(docs: DataFrame, events: DataFrame, plain: tuple[str, ...] = PLAIN) -> DataFrame:
    """(action, path): what an update would do to each path: text files to read, other files to describe, folders to roll up,
    files to drop. docs are the files known before, events(kind, path)."""
    todo = events.where("kind in ('added', 'modified', 'moved')").select("path")
    reads = todo.select(F.when(tx.extension(F.col("path")).isin(*plain), "read_text").otherwise("describe").alias("action"), "path")
    folders = events.select(F.explode(tx.ancestors(F.col("path"))).alias("path")).distinct().select(F.lit("roll_up").alias("action"), "path")
    gone = events.where("kind = 'deleted'").select("path").join(docs.select("path").distinct(), "path", "left_semi")
    return reads.unionByName(folders).unionByName(gone.select(F.lit("drop").alias("action"), "path")).distinct()


def estimated_calls(lists: DataFrame, model: bool = True) -> DataFrame:
    """(action, paths, calls) of update_lists(): a call for each file to describe and each folder, none without a model."""
    calls = F.when(F.col("action").isin("describe", "roll_up") & F.lit(model), F.col("paths")).otherwise(F.lit(0).cast("long"))
    return lists.groupBy("action").agg(F.count(F.lit(1)).alias("paths")).select("action", "paths", calls.alias("calls"))


# Activation


def activation_summary(sessions: DataFrame, within_ms: int = 600_000) -> DataFrame:
    """(metric, value): rates over sessions(outcome, error_code, duration_ms) and their histograms."""
    done = F.col("outcome") == "completed"
    rates = sessions.agg(F.count(F.lit(1)).cast("double").alias("sessions"), F.round(F.avg(done.cast("double")), 6).alias("completion_rate"), F.round(F.avg((done & (F.col("duration_ms") <= within_ms)).cast("double")), 6).alias("within_limit_rate"))
    rows = rates.select(F.explode(F.create_map(*(x for c in rates.columns for x in (F.lit(c), F.col(c))))).alias("metric", "value"))
    histo = lambda c: sessions.where(F.col(c).isNotNull()).groupBy(F.concat(F.lit(f"{c}:"), F.col(c)).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return rows.unionByName(histo("outcome")).unionByName(histo("error_code"))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two ISO times; null if either isn't one."""
    return ((F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))) / 1000).cast("long")


def expired(at: Column, now: Column, hours: int = 24) -> Column:
    return now >= at + F.expr(f"interval {hours} hours")


def dos_time(date: Column, time: Column) -> Column:
    """The time of an archive member's two 16-bit fields; the epoch if they hold none."""
    part = lambda c, shift, bits: F.shiftright(c, shift).bitwiseAND(F.lit((1 << bits) - 1))
    made = F.try_make_timestamp(part(date, 9, 7) + 1980, part(date, 5, 4), part(date, 0, 5), part(time, 11, 5), part(time, 5, 6), (part(time, 0, 5) * 2).cast("decimal(16,6)"))
    return F.coalesce(made, F.timestamp_seconds(F.lit(0)))


# Stored JSON


def json_list(c: Column) -> Column:
    """A list of texts; an empty one if it isn't."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def json_structs(c: Column, schema: str, most: int = 100) -> Column:
    """A list of structs without the bad ones."""
    return F.slice(F.filter(F.coalesce(F.from_json(c, f"array<{schema}>"), F.array().cast(f"array<{schema}>")), lambda x: x.isNotNull()), 1, most)


def positions(ids: Column) -> Column:
    """id -> first place in the list."""
    once = F.array_distinct(ids)
    return F.map_from_arrays(once, F.transform(once, lambda i: F.array_position(ids, i).cast("int")))


REFERENCE = "kind string, workspace_path string, virtual_path string, container_path string, member_path string, member_chain array<string>, archive_depth int, stable_id string"


def source_reference(stored: Column, path: Column, kind: Column, container: Column, member: Column, document_id: Column) -> Column:
    """A document's reference as stored JSON has it; where that's missing or broken, made of the older columns."""
    parsed = F.from_json(stored, REFERENCE)
    kind, own = F.coalesce(kind, F.lit("physical")), document_id.cast("string")
    inner = F.coalesce(member, F.element_at(F.split(path, "/"), -1))
    whole = lambda *x: F.struct(*(v.alias(f.split()[0]) for v, f in zip(x, REFERENCE.replace("array<string>", "list").split(", "))))
    none = F.lit(None).cast("string")
    inside = whole(F.lit("archive_member"), F.coalesce(container, F.lit("")), path, F.coalesce(container, F.lit("")), inner, F.array(inner), F.lit(1), own)
    file = whole(F.when(kind == "archive", "archive").otherwise("physical"), path, path, none, none, F.array().cast("array<string>"), F.lit(0), own)
    return F.when(parsed["kind"].isNotNull() & parsed["workspace_path"].isNotNull(), parsed).when(kind == "archive_member", inside).otherwise(file)


# Moves and migrations


def member_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """Archive members that moved with or in their container: same parent, content, chain and indexes, once on either side."""
    keys = ["parent_id", "content_hash", "member_chain", "member_indexes"]
    alone = lambda d, name: d.groupBy(*keys).agg(F.min("path").alias(name), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    gone, come = old.join(new, "path", "left_anti"), new.join(old, "path", "left_anti")
    return alone(gone, "old_path").join(alone(come, "path"), keys).select("old_path", "path")


def migrated_items(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Old items' documents: by content if that's unique; else by path with that content; else, without a content, by path."""
    d = docs.select(F.col("document_id").alias("d"), F.col("path").alias("p"), F.col("content_hash").alias("h"))
    once = d.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("n = 1").select(F.col("d").alias("by_hash"), "h")
    met = items.join(once, F.col("content_hash") == F.col("h"), "left").drop("h")
    met = met.join(d.select(F.col("d").alias("by_path"), "p", "h"), F.col("path") == F.col("p"), "left")
    path = F.when(F.col("content_hash").isNull() | (F.col("content_hash") == F.col("h")), F.col("by_path"))
    return met.select("task_id", "item_id", F.coalesce("by_hash", path).alias("document_id"))


def mismatched(tasks: DataFrame, judgments: DataFrame, key: str = "task_id") -> DataFrame:
    """Keys that only one side has: none, if the sets are the same."""
    return tasks.select(key).distinct().withColumn("a", F.lit(1)).join(judgments.select(key).distinct().withColumn("b", F.lit(1)), key, "full_outer").where("a is null or b is null").select(key, F.col("a").isNotNull().alias("has_task"))


def dataset_faults(tasks: DataFrame, docs: DataFrame, required: list[str]) -> DataFrame:
    """(code, n) of an evaluation set: tasks(task_id, relevant_paths, categories) against documents and required categories."""
    asked = tasks.select("task_id", F.explode("relevant_paths").alias("path"))
    covered = tasks.select(F.explode("categories").alias("c")).agg(F.collect_set("c").alias("all"))
    one = lambda rows, code: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n")
    out = one(asked.join(docs, "path", "left_anti"), "unknown_path")
    out = out.unionByName(one(tasks.groupBy("task_id").count().where("count > 1"), "duplicate_task"))
    out = out.unionByName(one(tasks.where(F.size("relevant_paths") == 0), "no_target"))
    return out.unionByName(covered.select(F.lit("missing_category").alias("code"), F.size(F.array_except(F.array(*map(F.lit, required)), "all")).cast("long").alias("n")))


# Tasks

# Templates and their slots, in order.
TEMPLATES = {
    "research_review": ("Question", "Key findings", "Methods", "Disagreements", "References"),
    "decision_brief": ("Background", "Options", "Evidence", "Risks", "Recommendation"),
    "evidence_pack": ("Claims", "Supporting evidence", "Opposing evidence"),
}


def template_slots(spark) -> DataFrame:
    rows = [(t, f"slot-{i}", name, i) for t, names in TEMPLATES.items() for i, name in enumerate(names, 1)]
    return spark.createDataFrame(rows, "template_id string, slot_id string, name string, position int")


def with_revision(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """tasks(task_id, revision, title) with updates(task_id, expected_revision, title) that expected the revision there is;
    each says whether it was applied."""
    u = updates.select("task_id", "expected_revision", F.col("title").alias("new_title"))
    met = tasks.join(u, "task_id", "left")
    ok = F.coalesce(F.col("expected_revision") == F.col("revision"), F.lit(False))
    return met.select("task_id", (F.col("revision") + ok.cast("int")).alias("revision"), F.when(ok, F.col("new_title")).otherwise(F.col("title")).alias("title"), ok.alias("applied"), (F.col("expected_revision").isNotNull() & ~ok).alias("conflict"))


def revalidated(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items against the bytes themselves, files(path, content): current, changed or missing."""
    seen = files.select("path", F.sha2("content", 256).alias("now"))
    met = items.join(seen, "path", "left")
    return met.select("task_id", "item_id", F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("content_hash"), "current").otherwise("changed").alias("freshness"))


def confirmed(proposals: DataFrame, items: DataFrame, task_id: str) -> DataFrame:
    """Items that a confirmed proposal adds: its candidates(slot_id, candidate_id, document_id, excerpt) that the task lacks,
    in order after those it has."""
    last = items.where(F.col("task_id") == task_id).agg(F.coalesce(F.max("position"), F.lit(0)).alias("last"))
    new = proposals.join(items.where(F.col("task_id") == task_id).select("item_id"), F.col("candidate_id") == F.col("item_id"), "left_anti")
    placed = accumulated(new, ["slot_id", "candidate_id"], "place")
    return placed.crossJoin(F.broadcast(last)).select(F.lit(task_id).alias("task_id"), F.col("candidate_id").alias("item_id"), "slot_id", "document_id", "excerpt", F.lit("pending").alias("review_state"), (F.col("place") + F.col("last")).alias("position"))


# Extraction budgets


def ocr_budget(pages: DataFrame, done: DataFrame, per_run: int = 25) -> DataFrame:
    """The pages(document_id, page_number, quality_score) that this run reads by character recognition: badly readable ones that
    no earlier run did, the first per_run of each document."""
    todo = pages.where("quality_score < 0.72").join(done, ["document_id", "page_number"], "left_anti")
    return todo.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("page_number"))).where(F.col("n") <= per_run).drop("n")


def best_extraction(attempts: DataFrame) -> DataFrame:
    """Of attempts(document_id, page_number, method, place, quality_score, text) the first that's readable, else the best."""
    order = F.struct((F.col("quality_score") >= 0.72).alias("ok"), F.when(F.col("quality_score") >= 0.72, -F.col("place").cast("double")).otherwise(F.col("quality_score")).alias("by"), (-F.col("place")).alias("first"))
    return attempts.groupBy("document_id", "page_number").agg(F.max_by(F.struct("method", "quality_score", "text"), order).alias("x")).select("document_id", "page_number", "x.*")


def csv_shape(lines: DataFrame, sample: int = 50) -> DataFrame:
    """(path, rows, columns) of the first lines(path, number, line) of files: how many, and the widest (quotes respected)."""
    some = lines.where(F.col("number") <= sample)
    width = F.size(F.split(F.regexp_replace("line", r'"([^"]|"")*"', "q"), ","))
    return some.groupBy("path").agg(F.count(F.lit(1)).alias("rows"), F.max(width).alias("columns"))


def protected_blocks(text: Column, name: str) -> Column:
    """What a user wrote between the markers of a block, if anything."""
    found = F.regexp_extract(text, rf"(?s)<!-- user:{name} -->\n?(.*?)\n?<!-- /user:{name} -->", 1)
    return F.when(found != "", found)


def section(text: Column, title: str) -> Column:
    """The body below a second-level heading, up to the next one."""
    return F.trim(F.regexp_extract(text, rf"(?s)(?:^|\n)## {title}[ \t]*\n(.*?)(?=\n## |\z)", 1))
